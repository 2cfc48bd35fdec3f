"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word is the path of its length and of the number of its letters in each group.  One inserted letter
adds one to one group; a replaced letter adds one to a group and takes one from another, or stays within
its group.  So a search walks down the trie with a surplus and a deficit budget of one each, and only
paths that stay within both reach a leaf, whose words are then compared letter by letter.

Spark holds the upper trie: every word is a leaf row below its node, and a search row below every node it
can reach.  Nodes with many words are opened one level further until each holds few, or its letters are
used up; each node is then searched depth first in one task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.materialize import written
from regionlens.llm.components import _tops

RUN = re.compile("[A-Za-zÀ-ÿ]+")
PIECE = 1 << 20  # characters of a text whose runs are listed at once
HELD = 200_000  # different words a task counts before it hands them on
BLOCK = 4096  # pairs below a trie node that are compared without going deeper
CELLS = 1 << 22  # letters compared at once


@dataclass(frozen=True)
class SpellingCfg:
    letters: int = 5  # fewest code points of a word
    seen: int = 3  # fewest occurrences
    slip: int = 97  # a run whose checksum this divides loses a code point
    factor: int = 2  # a form is so many times as frequent
    groups: tuple[str, ...] = ("e", "t", "a", "i", "n", "o", "s", "r", "lu", "dhc", "mpgf", "bvwyk")  # and all other letters
    start: int = 3  # trie levels that Spark opens for every word
    node_words: int = 1000  # words from which a node is opened further


def pieces(text: str) -> Iterator[str]:
    """Parts of a text of about ``PIECE`` characters that end between two runs."""
    at = 0
    while at < len(text):
        end = at + PIECE
        inside = RUN.match(text, end) if end < len(text) else None
        end = inside.end() if inside else end
        yield text[at:end]
        at = end


def text_words(doc: str, text: bytes, slip: int) -> Counter:
    """Lower-case runs of a text with their numbers, after the deletions that ``slip`` decides."""
    found: Counter = Counter()
    for part in pieces(text.lower().decode("utf-8", "surrogatepass")):
        found.update(RUN.findall(part))
    start = zlib.crc32(f"{doc}:".encode())
    cut = []
    for word in found:
        h = zlib.crc32(word.encode(), start)
        if h % slip == 0:
            cut.append((word, h % len(word)))
    # All runs first, then the additions: a shortened word may equal another run of the text.
    for (word, at), n in [(c, found.pop(c[0])) for c in cut]:
        found[word[:at] + word[at + 1 :]] += n
    return found


def _counted(slip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                total.update(text_words(doc.as_py(), text.as_py(), slip))
                if len(total) >= HELD:
                    yield _rows(total)
                    total = Counter()
        if total:
            yield _rows(total)

    return run


def _rows(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


def words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", cfg: SpellingCfg = SpellingCfg()) -> DataFrame:
    """``word, n``: the words of all texts that are long and frequent enough."""
    return (
        docs.select(
            F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
            F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        )
        .mapInArrow(_counted(cfg.slip), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where((F.char_length("word") >= cfg.letters) & (F.col("n") >= cfg.seen))
    )


def _in_group(word: Column, level: int, cfg: SpellingCfg) -> Column:
    """How many letters of ``word`` are in the group of a level; level 0 is the length."""
    if level == 0:
        return F.char_length(word)
    if level <= len(cfg.groups):
        return F.char_length(word) - F.char_length(F.translate(word, cfg.groups[level - 1], ""))
    return F.char_length(F.translate(word, "".join(cfg.groups), ""))


def _moves(level: int, cfg: SpellingCfg) -> Column:
    """The counts a search may go to at a level, and the budgets it has left.

    A word looks for words with one letter more (a surplus and no deficit) and for words of its own
    length.  Of the latter each pair is searched from one side: the surplus comes before the deficit.
    """
    own = _in_group(F.col("word"), level, cfg)

    def to(step: int, surplus: Column, deficit: Column, when: Column) -> Column:
        return F.when(when, F.struct((own + step).alias("count"), surplus.alias("surplus"), deficit.alias("deficit")))

    s, d, none = F.col("surplus"), F.col("deficit"), F.lit(0)
    steps = F.array(
        to(0, s, d, F.lit(True)),
        to(1, none, d, s == 1),
        to(-1, none, none, (s == 0) & (d == 1)),
    )
    return F.filter(steps, lambda m: m.isNotNull())


def _deeper(rows: DataFrame, level: int, cfg: SpellingCfg) -> DataFrame:
    """Rows below the children of their nodes: leaves at their own, searches at all in reach."""
    own = F.array(F.struct(_in_group(F.col("word"), level, cfg).alias("count"), F.col("surplus"), F.col("deficit")))
    return rows.withColumn("m", F.explode(F.when(F.col("leaf"), own).otherwise(_moves(level, cfg)))).select(
        F.concat_ws(".", "node", F.col("m.count").cast("string")).alias("node"), "leaf", F.col("m.surplus").alias("surplus"), F.col("m.deficit").alias("deficit"), "word", "n"
    )


def _nodes(found: DataFrame, cfg: SpellingCfg) -> tuple[list[DataFrame], int]:
    """Leaf and search rows below nodes of few words, one table for each depth."""
    size = F.char_length("word")
    roles = F.array(
        *[
            F.struct((size + more).cast("string").alias("node"), F.lit(leaf).alias("leaf"), F.lit(s).alias("surplus"), F.lit(d).alias("deficit"))
            for more, leaf, s, d in ((0, True, 0, 0), (0, False, 1, 1), (1, False, 1, 0))
        ]
    )
    rows = found.select(F.explode(roles).alias("r"), "word", "n").select("r.*", "word", "n")
    levels = len(cfg.groups) + 2
    for level in range(1, cfg.start):
        rows = _deeper(rows, level, cfg)
    done, depth = [], cfg.start
    while True:
        rows = written(rows)
        sizes = written(rows.where("leaf").groupBy("node").agg(F.count("*").alias("words")))
        # Searches go on only where there are words.
        rows = rows.join(sizes, "node")
        small = F.col("words") <= cfg.node_words
        if depth == levels or sizes.where(~small).isEmpty():
            done.append(rows.withColumn("depth", F.lit(depth)))
            return done, levels
        done.append(rows.where(small).withColumn("depth", F.lit(depth)))
        rows = _deeper(rows.where(~small).drop("words"), depth, cfg)
        depth += 1


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` come from those of ``a`` by replacing a letter, or, where they are longer, by inserting one."""
    size = a.shape[1]
    if size == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :size], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= size


def descend(leaves: np.ndarray, searches: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first search of all ``searches`` in the trie of ``leaves``; yields pairs of row numbers to compare.

    Both hold one row of counts for each word; leaves are in lexicographic order, so that a trie node is a range.
    """
    stack = [(0, len(leaves), 0, np.arange(len(searches)), surplus, deficit)]
    while stack:
        lo, hi, level, who, s, d = stack.pop()
        if not len(who) or lo == hi:
            continue
        if level == leaves.shape[1] or (hi - lo) * len(who) <= BLOCK:
            yield np.repeat(who, hi - lo), np.tile(np.arange(lo, hi), len(who))
            continue
        column = leaves[lo:hi, level]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [hi - lo]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            step = int(column[a]) - searches[who, level]
            spent = (step == 1) & (s == 1)
            repaid = (step == -1) & (s == 0) & (d == 1)
            go = (step == 0) | spent | repaid
            stack.append((lo + a, lo + b, level + 1, who[go], np.where(spent, 0, s)[go], np.where(repaid, 0, d)[go]))


def _letters(texts: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each; runs have none above 255."""
    size = len(texts[0])
    return np.array(texts, f"U{size}").view(np.uint32).reshape(-1, size).astype(np.uint8)


def _counts(letters: np.ndarray, levels: range, cfg: SpellingCfg) -> np.ndarray:
    """How many letters of each word are in the groups of some levels."""
    group = np.full(256, len(cfg.groups) + 1, np.uint8)
    for k, own in enumerate(cfg.groups, 1):
        group[[ord(c) for c in own]] = k
    placed = group[letters]
    return np.column_stack([np.zeros((len(letters), 0), np.int64), *[(placed == level).sum(axis=1) for level in levels]])


def near_pairs(table: pa.Table, levels: int, cfg: SpellingCfg) -> Iterator[tuple[list[str], list[str]]]:
    """Pairs of words one edit apart, of which one is a leaf of the node and the other a search."""
    leaf = table["leaf"].to_numpy().astype(bool)
    every = np.array(table["word"].to_pylist(), object)
    below = range(table["depth"][0].as_py(), levels)
    names, asked = every[leaf], every[~leaf]
    full = _letters(names.tolist())
    rows = _counts(full, below, cfg)
    order = np.lexsort([np.zeros(len(names)), *rows.T[::-1]])
    rows, names, full = rows[order], names[order], full[order]
    surplus, deficit = (table[c].to_numpy()[~leaf] for c in ("surplus", "deficit"))
    sizes = np.fromiter(map(len, asked), np.int64, len(asked))
    for more in (0, 1):
        mine = np.flatnonzero(sizes + more == full.shape[1])
        if not len(mine):
            continue
        searched, short = asked[mine], _letters(asked[mine].tolist())
        counts, free = _counts(short, below, cfg), surplus[mine] == 1
        step = max(1, CELLS // full.shape[1])
        for who, where in _together(descend(rows, counts, surplus[mine], deficit[mine]), step):
            hit = one_edit(short[who], full[where])
            who, where = who[hit], where[hit]
            if not more and len(who):
                # Of two words of a length the one with the smaller path asks; of equal paths the smaller word.
                first = np.zeros(len(who), np.int64)
                for k in range(len(below) - 1, -1, -1):
                    off = np.sign(rows[where, k] - counts[who, k])
                    first = np.where(off != 0, off, first)
                smaller = np.fromiter((a < b for a, b in zip(searched[who], names[where])), bool, len(who))
                hit = ~free[who] | (first > 0) | ((first == 0) & smaller)
                who, where = who[hit], where[hit]
            yield searched[who].tolist(), names[where].tolist()


def _together(pairs: Iterator[tuple[np.ndarray, np.ndarray]], step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in portions of about ``step``."""
    held, size = [], 0
    for who, where in pairs:
        for at in range(0, len(who), step):
            held.append((who[at : at + step], where[at : at + step]))
            size += len(held[-1][0])
            if size >= step:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _searched(levels: int, cfg: SpellingCfg):
    """For each word of a node that has near words there: their number and the most frequent of them."""

    def run(table: pa.Table) -> pa.Table:
        times = dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))
        best: dict[str, tuple[int, str]] = {}
        near: Counter = Counter()
        if table["leaf"].to_numpy().any():
            for left, right in near_pairs(table, levels, cfg):
                for a, b in ((left, right), (right, left)):
                    near.update(a)
                    for word, other in zip(a, b):
                        rank = (-times[other], other)
                        if word not in best or rank < best[word]:
                            best[word] = rank
        return pa.table(
            [pa.array(near.keys(), pa.string()), pa.array(near.values(), pa.int64()), pa.array([best[w][0] for w in near], pa.int64()), pa.array([best[w][1] for w in near], pa.string())],
            names=["word", "n_near", "less", "form"],
        )

    return run


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", cfg: SpellingCfg = SpellingCfg()) -> DataFrame:
    """Frequent words of all texts with their near words, their form and its root.

    Returns ``word, n, n_near, form, form_n, root``.  A word's form is its near word of largest ``n`` (ties: the
    smallest), if that is at least ``cfg.factor`` times as frequent; ``root`` is the end of the chain of forms, the
    word itself where it has none.  NULL and empty texts hold no words, a NULL id counts as an empty one, repeated
    rows count each.  Long texts are read piece by piece, and words of any length are compared whole.  An empty
    table gives no rows; other columns are ignored.
    """
    found = written(words(docs, id_col, text, cfg))
    tables, levels = _nodes(found, cfg)
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    # A node whose letters are used up and that still holds many words is cut into shares; its searches visit each.
    shares = F.ceil(F.col("words") / cfg.node_words).cast("int")
    share = F.when(F.col("leaf"), F.array(F.pmod(F.xxhash64("word"), shares).cast("int"))).otherwise(F.sequence(F.lit(0), shares - 1))
    near = (
        rows.withColumn("share", F.explode(share))
        .select("node", "share", "leaf", "surplus", "deficit", "word", "n", "depth")
        .groupBy("node", "share")
        .applyInArrow(_searched(levels, cfg), "word string, n_near long, less long, form string")
        .groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    )
    form = F.when(-F.col("best.less") >= cfg.factor * F.col("n"), F.col("best"))
    forms = written(
        found.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form["form"].alias("form"), (-form["less"]).alias("form_n")
        )
    )
    # Counts at least double from form to form, so chains are short.
    roots = _tops(forms.select(F.col("word").alias("vertex"), F.coalesce("form", "word").alias("root")))
    return forms.join(roots.withColumnRenamed("vertex", "word"), "word")
