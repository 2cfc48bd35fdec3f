"""Boxes of similar size around the points of a table: a k-d tree that is cut level by level in Spark.

The tree is a table of nodes with the corners of their data; neither points nor nodes reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.materialize import written

INNER = (0.25, 0.5, 0.75)  # quantiles at which a side is cut
TAIL = (0.9, 0.99, 0.999, 1.0)  # where those are its smallest value: the first of these that is not
SKETCH = 200
FEW_NODES = 10_000  # nodes that are sent to all tasks


@dataclass(frozen=True)
class Boxes:
    """``placed``: the points with their ``box``.  ``nodes``: ``node, depth, rows, copies, low, high, leaf``."""

    placed: DataFrame
    nodes: DataFrame
    depth: int


def _root() -> Column:
    """The name of the root, as a value of each row: a constant would turn the join with its one node into a product."""
    return F.concat(F.lit("0"), F.substring(F.col("pid").cast("string"), 1, 0))


def _side(x: str, d: int) -> Column:
    """How a node would be cut along one side; smaller is better."""
    levels, low = F.col(f"q{d}"), F.col("low")[d]
    inner = F.array_distinct(F.filter(F.slice(levels, 1, len(INNER)), lambda q: q > low))
    tail = F.filter(F.slice(levels, len(INNER) + 1, len(TAIL)), lambda q: q > low)
    # The smallest value of the tail is the first quantile of it above the smallest value of the side.
    cost = F.when(F.size(inner) > 0, 0).otherwise(1 + len(TAIL) - F.size(tail))
    width = F.col("high")[d] - low
    return F.struct(cost.alias("cost"), (-width).alias("less"), F.lit(d + 1).alias("side"), F.when(F.size(inner) > 0, inner).otherwise(F.slice(tail, 1, 1)).alias("cuts"))


def _few(nodes: DataFrame) -> DataFrame:
    """``nodes`` for a join: sent to all tasks only if they are few."""
    return F.broadcast(nodes) if nodes.limit(FEW_NODES + 1).count() <= FEW_NODES else nodes


def cut_boxes(points: DataFrame, xs: Sequence[str], leaf_rows: int) -> Boxes:
    """Cut ``points`` (different vectors ``xs``, with their number in ``copies``) into boxes of at most ``leaf_rows`` points.

    Each round cuts all nodes that are too large into up to four, at the quartiles of their widest side; a side of
    which most values are the smallest gives way to the next, and where all are such, the few other points are cut off.
    Every cut leaves points on both sides, so the rounds end.
    """
    rows = points.withColumn("node", _root())
    placed, nodes, depth = [], [], 0
    while True:
        stats = written(
            rows.groupBy("node").agg(
                F.count(F.lit(1)).alias("rows"),
                F.sum("copies").alias("copies"),
                F.array(*[F.min(x) for x in xs]).alias("low"),
                F.array(*[F.max(x) for x in xs]).alias("high"),
                *[F.percentile_approx(x, F.array(*[F.lit(q) for q in INNER + TAIL]), SKETCH).alias(f"q{d}") for d, x in enumerate(xs)],
            )
        )
        leaf = F.col("rows") <= leaf_rows
        nodes.append(stats.select("node", F.lit(depth).alias("depth"), "rows", "copies", "low", "high", leaf.alias("leaf")))
        large = written(stats.where(~leaf).select("node", F.array_min(F.array(*[_side(x, d) for d, x in enumerate(xs)])).alias("cut")))
        if large.isEmpty():
            placed.append(rows)
            break
        marked = rows.join(_few(large), "node", "left")
        value = F.element_at(F.array(*xs), F.col("cut.side"))
        child = F.size(F.filter("cut.cuts", lambda c: c <= value))
        both = written(marked.withColumn("open", F.col("cut").isNotNull()).withColumn("node", F.when(F.col("open"), F.concat_ws(".", "node", child.cast("string"))).otherwise(F.col("node"))).drop("cut"))
        placed.append(both.where("NOT open").drop("open"))
        rows = both.where("open").drop("open")
        depth += 1
    table, tree = placed[0], nodes[0]
    for more in placed[1:]:
        table = table.unionByName(more)
    for more in nodes[1:]:
        tree = tree.unionByName(more)
    return Boxes(written(table.withColumnRenamed("node", "box")), written(tree), depth)


def around(boxes: Boxes, k: int) -> DataFrame:
    """``box, far_low, far_high``: for boxes of at most ``k`` rows, the corners of the smallest node above with more."""
    short = boxes.nodes.where(F.col("leaf") & (F.col("copies") <= k) & (F.col("depth") > 0))
    above = short.select(
        F.col("node").alias("box"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.array_join(F.slice(F.split("node", r"\."), 1, i), "."))).alias("node"),
    )
    enough = boxes.nodes.where(F.col("copies") > k).select("node", "depth", F.struct("low", "high").alias("corners"))
    return above.join(enough, "node").groupBy("box").agg(F.max_by("corners", "depth").alias("c")).select("box", F.col("c.low").alias("far_low"), F.col("c.high").alias("far_high"))


def touched(points: DataFrame, xs: Sequence[str], boxes: Boxes) -> DataFrame:
    """One row for every box that the ``reach`` of a point touches, found by walking down the tree level by level."""
    frontier = points.withColumn("node", _root())
    nodes = boxes.nodes.withColumn("parent", F.expr("substring_index(node, '.', depth)"))
    found = []
    for depth in range(boxes.depth + 1):
        below = nodes.where(F.col("depth") == depth).select(F.col("node").alias("_node"), "parent", "low", "high", "leaf")
        key = below["_node"] if depth == 0 else below["parent"]
        gap = [F.greatest(F.col("low")[d] - F.col(x), F.col(x) - F.col("high")[d], F.lit(0.0)) for d, x in enumerate(xs)]
        distance = F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0]))
        # A hair of slack: rounding must not lose a box that is touched exactly.
        met = frontier.join(_few(below), frontier["node"] == key).where(distance <= F.col("reach") * (1 + 1e-9))
        met = written(met.drop("node", "parent", "low", "high").withColumnRenamed("_node", "node"))
        found.append(met.where("leaf").drop("leaf"))
        frontier = met.where("NOT leaf").drop("leaf")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("node", "box")
