"""SimHash near copies by multi-index hashing.

Two texts are linked when their 64-bit fingerprints differ in at most three bits.  A fingerprint
has two segments of 32 bits.  Of three differing bits one segment holds at most one, so the pair
meets when each side looks up the other's segment and all segments one flip away.  Flips from 0
to 1 suffice, because one of two segments that differ in one bit holds the 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from regionlens.functions.materialize import written
from regionlens.llm.components import components
from regionlens.llm.text import lower_words

BITS = 3  # most differing bits of a link; two segments with balls of radius one rest on it
SEGMENT = 32
CROWD = 256  # members of a segment value from which pairs are found through midpoints
LOW = (1 << SEGMENT) - 1
SLAB = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None) -> int:
    """Majority of the bits of XXH64 (seed 42) over all word triples, as a signed 64-bit number."""
    words = lower_words(text)
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(words, words[1:], words[2:])]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8", len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLAB):
        part = hashes[at : at + SLAB].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint of ``text`` as a signed 64-bit column. NULL and blank texts get zero."""
    return docs.withColumn(name, _fingerprints(F.col(text)))


def hex16(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segment(fp: Column, upper: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT) if upper else fp.bitwiseAND(F.lit(LOW))


def _flips(value: Column, ones: bool) -> Column:
    """All values one bit away from a 32-bit value; ``ones``: only bits that were 0."""
    masks = F.array(*[F.lit(1 << i).cast("long") for i in range(SEGMENT)])
    if ones:
        masks = F.filter(masks, lambda m: value.bitwiseAND(m) == 0)
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _key(value: Column, upper: int) -> Column:
    return value + F.lit(upper << SEGMENT)


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints linked by at most ``BITS`` differing bits.

    ``fps`` holds the distinct fingerprints in a column ``fp``.  Every edge is a link; links left
    out join fingerprints that the edges given connect anyway.

    A segment value with up to ``crowd`` members is searched pair by pair, which is at most
    ``crowd`` pairs per member.  In a larger one each member writes down the points around the other
    segment that lie within two bits in all, and the members that wrote the same point are tied to
    the nearest of them where both distances add up to three or less.  Two members three bits apart
    share such a point, at one bit from one and two from the other.  A point is within reach of
    at most 1,585 members, so this is linear in the members however many there are.
    """
    fp = F.col("fp")
    owners = written(
        fps.select("fp", F.explode(F.array(*[_key(_segment(fp, u), u) for u in (0, 1)])).alias("key")).select(
            "key", "fp"
        )
    )
    probes = fps.select(
        "fp",
        F.explode(
            F.concat(
                _flips(_segment(fp, 0), True),
                F.transform(_flips(_segment(fp, 1), True), lambda v: _key(v, 1)),
            )
        ).alias("key"),
    )
    sizes = owners.groupBy("key").agg(F.count("*").alias("owners"))
    # Spark sizes what an explode gives like its input, a thirtieth here, and would broadcast it; so for _tied.
    met = written(
        probes.hint("merge").join(sizes, "key").select("key", "fp", F.lit(1).alias("off"))
    )
    reached = met.groupBy("key").agg(F.count("*").alias("probers"))
    busy = written(
        sizes.hint("merge").join(reached, "key", "left")
        .select("key", (F.col("owners") + F.coalesce("probers", F.lit(0))).alias("members"))
        .where("members > 1")
    )
    members = owners.select("key", "fp", F.lit(0).alias("off")).unionByName(met).hint("merge").join(busy, "key")
    members = written(members)
    few = members.where(F.col("members") <= crowd)
    left = few.where("off = 0").select("key", F.col("fp").alias("a"))
    right = few.select("key", F.col("fp").alias("b"), "off")
    near = (
        left.hint("merge").join(right, "key")
        # Two owners meet twice, an owner and a prober once.
        .where((F.col("off") == 1) | (F.col("a") < F.col("b")))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
        .select("a", "b")
    )
    many = members.where(F.col("members") > crowd)
    return near.unionByName(_tied(many))


def _tied(members: DataFrame) -> DataFrame:
    """Edges inside crowded segment values, through shared midpoints."""
    upper = F.col("key") >= (1 << SEGMENT)
    other = F.when(upper, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1))
    masks = F.array(*[F.lit(1 << i).cast("long") for i in range(SEGMENT)])

    def pairs(value: Column) -> Column:
        return F.flatten(
            F.transform(
                masks,
                lambda m: F.transform(F.filter(masks, lambda n: n > m), lambda n: value.bitwiseXOR(m).bitwiseXOR(n)),
            )
        )

    def at(points: Column, far: int) -> Column:
        return F.transform(points, lambda p: F.struct(p.alias("point"), (F.col("off") + far).alias("r")))

    around = F.concat(at(F.array(F.col("other")), 0), at(_flips(F.col("other"), False), 1))
    wide = F.when(F.col("off") == 0, F.concat(around, at(pairs(F.col("other")), 2))).otherwise(around)
    points = (
        members.select("key", "fp", "off", other.alias("other"))
        .select("key", "fp", F.explode(wide).alias("p"))
        .select("key", "p.point", "p.r", "fp")
    )
    centre = points.groupBy("key", "point").agg(F.min(F.struct("r", "fp")).alias("c"), F.count("*").alias("n"))
    return (
        points.hint("merge")
        .join(centre.where("n > 1 and c.r <= 1"), ["key", "point"])
        .where((F.col("fp") != F.col("c.fp")) & (F.col("r") + F.col("c.r") <= BITS))
        .select(F.col("c.fp").alias("a"), F.col("fp").alias("b"))
        .distinct()
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """Group documents whose fingerprints are linked, directly or through others.

    Returns ``doc_id, fp, component_id`` for every row: the smallest id reachable, itself
    included.  Equal texts share a fingerprint and one row in the search, so copies are never
    paired.  Blank and NULL texts have fingerprint zero and are linked like any other.  A row
    without id is searched too; ``component_id`` is NULL only where no row of a group has an id.
    Repeated rows each get a row.  Other columns are ignored, an empty table gives an empty one.
    """
    ids = written(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    own = written(ids.groupBy("fp").agg(F.min("doc_id").alias("low")))
    tied = components(links(own.select("fp"), crowd))
    named = own.hint("merge").join(tied.select(F.col("vertex").alias("fp"), "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low"
    )
    named = written(named)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = written(named.join(lows, "root").select("fp", "component_id"))
    return ids.hint("merge").join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one document of each group of near copies: that with the smallest id.

    Rows of one id and text count as one document; different texts under one id are documents of their own, of
    which the smallest digest goes first.  Rows without id stand behind all others; in a group without any id,
    rows of the same text are one document and the smallest digest stays.  All columns are kept.
    """
    digest = F.concat(F.lit("#"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    key = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string"), digest), digest)
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"_key{i or ''}" for i in range(len(taken) + 1)) if n not in taken)
    groups = near_groups(docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("key")).alias("doc_id"), F.col(text).alias("text")))
    best = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.key").alias(name)).distinct()
    # Both sides are dealt by the key, which dropping repeated rows needs anyway; a broadcast would only add memory.
    return docs.withColumn(name, key).join(written(best).hint("merge"), name, "left_semi").dropDuplicates([name]).drop(name)
