"""License texts inside documents: MinHash bands retrieve, exact shingle containment decides. Native expressions only.

Templates and documents are compared by shingles of five words. A template of T shingles belongs to
the size class W, the next power of two; documents are cut into windows of 2 W shingles that overlap by half, so that any
run of W shingles lies whole in one of them. Shingles that no template of the class has can never count
towards containment and are left out before the windows are hashed.

Notices of one family differ in a word or two, so that most of one is held by the others. Of a template
only the longest run of shingles counts of which no template of another license holds the share c: it has the words
that tell the licenses apart, and a notice of one is not reported as another.

A window that contains at least the share c of a template has a Jaccard similarity of at least
c T / (2 W + (1 - c) T), which is above 0.19 for c = 0.8, because T is more than half of W. With bands of one hash, b bands
miss it with a chance of at most 0.81 ** b: two in ten thousand for b = 40, and none where the window holds nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.materialize import written
from regionlens.llm.license_texts import TEMPLATES

WORDING = re.compile("-(line|notice|grant|plain|text)$")


@dataclass(frozen=True)
class LicenseCfg:
    words: int = 5  # of a shingle
    containment: float = 0.8
    bands: int = 40
    rows: int = 1  # hashes of a band
    block_shingles: int = 20_000  # template shingles of one pass over the documents


GAP = "[^\\p{L}\\p{N}]+"


def _words(text: str) -> list[str]:
    """As the documents' words, for texts of templates."""
    out, word = [], ""
    for c in text.lower():
        if c.isalpha() or c.isnumeric():
            word += c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def same_license(a: str, b: str) -> bool:
    """Whether two names of templates stand for one license, or one for the family of the other (``BSD``, ``BSD-2-Clause``)."""
    a, b = WORDING.sub("", a), WORDING.sub("", b)
    return a == b or a.startswith(f"{b}-") or b.startswith(f"{a}-")


def _telling(runs: list[str], rivals: list[set[str]], share: float) -> list[str]:
    """The longest run, the first of equal ones, of which every rival holds less than ``share``; all where there is none."""
    first, last, near = 0, len(runs), []
    while True:
        found = set(runs[first:last])
        more = [r for r in rivals if len(found & r) >= share * len(found)]
        if not more:
            return runs[first:last]
        near += more
        best = None
        for i in range(len(runs)):
            seen, held = set(), [0] * len(near)
            for j in range(i, len(runs)):
                if runs[j] not in seen:
                    seen.add(runs[j])
                    held = [h + (runs[j] in r) for h, r in zip(held, near)]
                if all(h < share * len(seen) for h in held) and (best is None or j + 1 - i > best[1] - best[0]):
                    best = i, j + 1
        if best is None:
            return runs
        first, last = best


def template_shingles(templates: Sequence[tuple[str, str]], cfg: LicenseCfg) -> list[tuple[str, int, list[str]]]:
    """``(license, size class, different shingles)``; a text shorter than a shingle has none and is left out.

    The shingles are those of the run that tells the license from all others; a text that another license
    holds whole has no such run and counts whole.
    """
    texts = []
    for name, text in templates:
        w = _words(text)
        texts.append((name, [" ".join(w[i : i + cfg.words]) for i in range(len(w) - cfg.words + 1)]))
    held = [set(runs) for _, runs in texts]
    out = []
    for name, runs in texts:
        if runs:
            rivals = [h for (other, _), h in zip(texts, held) if not same_license(name, other)]
            runs = _telling(runs, rivals, cfg.containment)
            out.append((name, 1 << (len(runs) - 1).bit_length(), sorted(set(runs))))
    return out


def _bands(shingles: Column, cfg: LicenseCfg) -> Column:
    """One key per band: the hashed least values of its hash functions over the set."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(F.lit(seed), s)))

    return F.array(*[F.xxhash64(F.lit(b), *[least(b * cfg.rows + r) for r in range(cfg.rows)]) for b in range(cfg.bands)])


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, cfg: LicenseCfg = LicenseCfg(),
    id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, license, containment, start`` for every row and license found in it.

    ``containment`` is the best over all windows, ``start`` the first shared shingle (a word number, from
    0) of the first such window. NULL and short texts hold nothing; repeated rows are each
    reported; NULL ids stay; other columns are ignored; an empty table gives an empty one. The templates are a
    stated set, taken in blocks of bounded size; hits leave the scan as the few shingles some template has.
    """
    blocks: list[list] = [[]]
    for t in template_shingles(templates, cfg):
        if blocks[-1] and sum(len(x[2]) for x in blocks[-1]) + len(t[2]) > cfg.block_shingles:
            blocks.append([])
        blocks[-1].append(t)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    found = [_scan_block(plain, block, cfg) for block in blocks if block]
    if not found:
        return plain.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("start")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _scan_block(plain: DataFrame, block: list[tuple[str, int, list[str]]], cfg: LicenseCfg) -> DataFrame:
    spark = plain.sparkSession
    table = spark.createDataFrame([(n, w, s) for n, w, s in block], "license string, size int, shingles array<string>")
    # Hashes of the block's shingles, a bounded set that is part of the expression.
    hashed = {
        w: [r[0] for r in table.where(F.col("size") == w).select(F.explode("shingles").alias("s")).select(F.xxhash64("s")).distinct().collect()]
        for w in sorted({w for _, w, _ in block})
    }
    every = sorted({h for hs in hashed.values() for h in hs})
    k = cfg.words

    def starts(words: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(words) - (k - 1))
        runs = F.transform(at, lambda i: F.struct(i.alias("i"), F.concat_ws(" ", *[F.element_at(words, i + j) for j in range(k)]).alias("s")))
        return F.filter(runs, lambda x: F.xxhash64(x["s"]).isin(every))

    words = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), GAP), lambda w: w != "")
    bound = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) >= k, starts(w))), 1)
    hits = written(
        plain.select("doc_id", F.monotonically_increasing_id().alias("rid"), bound.alias("hits"))
        .where(F.size("hits") > 0)
        .select("rid", "doc_id", F.explode("hits").alias("hit"))
        .select("rid", "doc_id", (F.col("hit.i") - 1).cast("long").alias("i"), F.col("hit.s").alias("s"))
    )
    in_class = F.lit(False)
    for w, hs in hashed.items():
        in_class = in_class | ((F.col("size") == w) & F.xxhash64("s").isin(hs))
    own = F.floor(F.col("i") / F.col("size"))
    windows = (
        hits.withColumn("size", F.explode(F.array(*[F.lit(w) for w in hashed])))
        .where(in_class)
        .withColumn("window", F.explode(F.filter(F.array(own - 1, own), lambda x: x >= 0)))
        .groupBy("rid", "doc_id", "size", "window")
        .agg(F.collect_set("s").alias("shingles"), F.collect_list(F.struct("s", "i")).alias("places"))
    )
    windows = written(windows)
    keys = lambda d, *cols: d.select(*cols, F.posexplode(_bands(F.col("shingles"), cfg)).alias("band", "key"))
    met = (
        keys(windows, "rid", "size", "window")
        .join(F.broadcast(keys(table, "license", "size")), ["size", "band", "key"])
        .select("rid", "size", "window", "license")
        .distinct()
    )
    both = (
        windows.join(met, ["rid", "size", "window"])
        .join(F.broadcast(table.withColumnRenamed("shingles", "wanted")), ["license", "size"])
        .withColumn("containment", F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted"))
        .where(F.col("containment") >= cfg.containment)
        .withColumn(
            "start",
            F.array_min(F.transform(F.filter("places", lambda p: F.array_contains("wanted", p["s"])), lambda p: p["i"])),
        )
    )
    return (
        both.groupBy("rid", "doc_id", "license")
        .agg(F.min(F.struct((-F.col("containment")).alias("c"), F.col("start"))).alias("best"))
        .select("doc_id", "license", (-F.col("best.c")).alias("containment"), F.col("best.start").alias("start"))
    )
