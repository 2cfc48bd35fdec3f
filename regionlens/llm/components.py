"""Connected components of a graph that no task and no driver holds as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.materialize import written


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable vertex of every vertex that has an edge.

    ``edges`` holds two columns ``a`` and ``b`` of one orderable type; direction, repeats and
    loops do not matter, rows with NULL are no edges.  Returns ``vertex, root``.

    Every round hangs each vertex below its smallest neighbour, follows the chains to their tops
    by pointer doubling, and replaces all edges by edges between tops.  The vertices that are no
    top drop out, so rounds are logarithmic.  The minimum over neighbours is a partial aggregate:
    a vertex with a third of all edges arrives as one row per task.  Each step is written below
    ``spark.checkpoint.dir``; a lost executor repeats one step at most.
    """
    live = _between(edges.select("a", "b"))
    labels: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("low"))
        tops = _tops(parents.select("vertex", F.least("vertex", "low").alias("root")))
        if labels is None:
            labels = tops
        else:
            moved = tops.select(F.col("vertex").alias("root"), F.col("root").alias("top"))
            # A root without live edges has no row in ``tops`` and keeps its name.
            labels = written(
                labels.join(moved, "root", "left").select("vertex", F.coalesce("top", "root").alias("root"))
            )
        live = _between(
            live.join(tops.select(F.col("vertex").alias("a"), F.col("root").alias("ra")), "a")
            .join(tops.select(F.col("vertex").alias("b"), F.col("root").alias("rb")), "b")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        )
    if labels is None:
        return edges.select(F.col("a").alias("vertex"), F.col("a").alias("root")).limit(0)
    return labels


def _between(edges: DataFrame) -> DataFrame:
    """Edges between different vertices, each once."""
    return written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _tops(parents: DataFrame) -> DataFrame:
    """Follow ``vertex -> root`` to the end of every chain; each pass halves what is left."""
    chain = written(parents)
    while True:
        above = chain.select(F.col("vertex").alias("root"), F.col("root").alias("up"))
        # A root is a vertex itself: its own row points to itself.
        step = written(
            chain.join(above, "root").select(
                "vertex", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")
            )
        )
        chain = step.select("vertex", "root")
        if step.where("moved").isEmpty():
            return chain
