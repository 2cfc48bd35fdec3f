"""Isolation forest (Liu, Ting, Zhou 2008) over a table of any size.

Trees see samples of at most 256 rows, so the model has a fixed size (trees x
2 x 256 nodes) and may be collected and shipped; rows are sampled and scored
where they are.  Every draw (rows, features, bounds) is a digest of the seed, the
tree, and the natural key or the node, so the forest depends neither on the partitions of the table
nor on a random generator, and SQL can grow the same one.
"""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regionlens.config import ForestCfg
from regionlens.functions.expr import one_value
from regionlens.functions.materialize import written
from regionlens.functions.quantile import quantiles
from regionlens.operators.features import standardize

def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def draw(*parts: Column) -> Column:
    """A number from 0 up to 1: 52 bits of the MD5 digest of the parts, joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sample_per_tree(df: DataFrame, key: Sequence[str], cfg: ForestCfg) -> DataFrame:
    """Rows drawn for each tree: the ``cfg.sample`` smallest draws of (seed, tree, key).

    Draws above a bound that four times the sample would pass are dropped
    inside the row, so about ``4 * sample * trees`` rows are shuffled whatever
    the size of the table.
    """
    n = one_value(df.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")))
    share = F.least(F.lit(1.0), F.lit(4.0 * cfg.sample) / F.col("_n.n"))
    keys = [F.col(k) for k in key]
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(cfg.trees - 1)),
        lambda t: F.struct(t.alias("tree"), draw(F.lit(cfg.seed), t, *keys).alias("draw")),
    )
    return (
        df.withColumn("_n", n)
        .withColumn("_d", F.explode(F.filter(draws, lambda d: d["draw"] < share)))
        .withColumn("tree", F.col("_d.tree"))
        .withColumn("draw", F.col("_d.draw"))
        .drop("_n", "_d")
        .withColumn("_rank", F.row_number().over(W.partitionBy("tree").orderBy("draw", *key)))
        .where(F.col("_rank") <= cfg.sample)
    )


def grow(drawn: DataFrame, cols: Sequence[str], cfg: ForestCfg) -> DataFrame:
    """The nodes of all trees: ``tree, node, feature, bound, depth``; a leaf has feature -1.

    A node splits on a drawn bound of a drawn feature among those that are not constant in it; ``node`` 1 is the root and the
    children of ``i`` are ``2 i`` and ``2 i + 1``.  All trees grow a level at a time by grouped minima and maxima;
    their rows are dealt by tree once.
    """
    limit = max(1, math.ceil(math.log2(max(cfg.sample, 2))))
    at = W.partitionBy("tree", "node")
    rows = drawn.select("tree", F.array(*cols).alias("x")).repartition("tree").withColumns({"node": F.lit(1).cast("long"), "path": F.array().cast("array<struct<node:bigint,feature:int,bound:double,depth:double>>"), "open": F.lit(True)})
    # A tree of few rows has fewer levels.
    top = F.greatest(F.ceil(F.log2(F.greatest(F.count(F.lit(1)).over(W.partitionBy("tree")), F.lit(2)))), F.lit(1))
    rows = rows.withColumn("limit", top)
    for level in range(limit + 1):
        n = F.count(F.lit(1)).over(at)
        low, high = (F.array(*[f(F.col("x")[i]).over(at) for i in range(len(cols))]) for f in (F.min, F.max))
        rows = rows.withColumns({"n": n, "low": low, "high": high})
        usable = F.filter(F.sequence(F.lit(0), F.lit(len(cols) - 1)), lambda i: F.get("high", i) > F.get("low", i))
        splits = (F.col("n") > 1) & (F.size(usable) > 0) & (F.col("limit") > level)
        which = F.floor(draw(F.lit(cfg.seed), F.col("tree"), F.col("node"), F.lit("feature")) * F.size(usable)).cast("int")
        rows = rows.withColumn("f", F.when(splits, F.get(usable, which)).otherwise(-1))
        share = draw(F.lit(cfg.seed), F.col("tree"), F.col("node"), F.lit("bound"))
        inside = F.get("low", F.col("f")) + share * (F.get("high", F.col("f")) - F.get("low", F.col("f")))
        rows = rows.withColumn("bound", F.when(F.col("f") >= 0, inside).otherwise(0.0))
        here = F.struct("node", F.col("f").alias("feature"), "bound", (F.lit(float(level)) + path_of(F.col("n"))).alias("depth"))
        right = (F.get("x", F.col("f")) > F.col("bound")).cast("long")
        rows = rows.withColumns(
            {
                "path": F.when(F.col("open"), F.array_append("path", here)).otherwise(F.col("path")),
                "node": F.when(F.col("f") >= 0, F.col("node") * 2 + right).otherwise(F.col("node")),
                "open": F.col("open") & (F.col("f") >= 0),
            }
        ).select("tree", "x", "node", "path", "open", "limit")
    nodes = rows.select("tree", F.explode("path").alias("p")).groupBy("tree", "p.node")
    return nodes.agg(*[F.first(f"p.{c}").alias(c) for c in ("feature", "bound", "depth")])


def path_of(n: Column) -> Column:
    """:func:`mean_path` of a column."""
    long = 2.0 * (F.log(n - 1.0) + float(np.euler_gamma)) - 2.0 * (n - 1.0) / n
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(long)


def fit_forest(df: DataFrame, cols: Sequence[str], key: Sequence[str], cfg: ForestCfg) -> DataFrame:
    """One row per tree with its nodes as arrays; ``left`` and ``right`` are places in them."""
    nodes = grow(sample_per_tree(df, key, cfg), list(cols), cfg)
    every = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("node", "feature", "bound", "depth"))).alias("t"))
    names = F.col("t.node")
    child = lambda side: F.transform(names, lambda i: F.array_position(names, i * 2 + side).cast("int") - 1)
    return every.select(
        "tree", F.col("t.feature").alias("feature"), F.col("t.bound").alias("bound"), F.col("t.depth").alias("depth"),
        child(0).alias("left"), child(1).alias("right"),
    )


def score_rows(df: DataFrame, cols: Sequence[str], forest: list, psi: int) -> DataFrame:
    """Add ``anomaly_score`` = 2 ** (-mean depth / mean path of the sample)."""
    trees = [
        (
            np.array(t["feature"], dtype=np.int64),
            np.array(t["bound"]),
            np.array(t["left"], dtype=np.int64),
            np.array(t["right"], dtype=np.int64),
            np.array(t["depth"]),
        )
        for t in forest
    ]
    unit = max(mean_path(psi), 1e-12)

    # Only the features cross to Python; the other columns stay in the JVM.
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([s.to_numpy(dtype=float) for s in batch])
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for feature, bound, left, right, depth in trees:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes_left = x[rows, np.maximum(f, 0)] <= bound[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                total += depth[at]
            yield pd.Series(np.exp2(-(total / max(len(trees), 1)) / unit))

    # Rounded, so that the order in which depths are added up does not part equal scores.
    return df.withColumn("anomaly_score", F.round(score(*cols), 12))


def isolation_forest(
    ml: DataFrame, cols: Sequence[str], key: Sequence[str] = ("state", "year_month"), cfg: ForestCfg = ForestCfg()
) -> DataFrame:
    """``ml`` with ``is_anomaly`` and ``anomaly_score``; about ``cfg.contamination`` of the rows are flagged.

    Rows are written before their means are taken, so ``ml`` is computed once;
    scaled rows too, so that sampling and scoring see the same values.
    """
    scaled = written(standardize(written(ml), cols, "_iso"))
    inputs = [f"{c}_iso" for c in cols]
    forest = sorted(fit_forest(scaled, inputs, key, cfg).collect(), key=lambda r: r["tree"])
    if not forest:
        return ml.withColumns({"is_anomaly": F.lit(0), "anomaly_score": F.lit(0.0)})
    # A tree of psi rows has leaves that add up to psi; the sample is the same for all trees.
    psi = min(cfg.sample, scaled.count())
    # Written as well, so that rows pass through the trees once, not again for the quantile.
    scored = written(score_rows(scaled, inputs, forest, psi).drop(*inputs))
    bound = quantiles(scored, ["anomaly_score"], [1 - cfg.contamination])["anomaly_score"][0]
    return scored.withColumn("is_anomaly", F.when(F.col("anomaly_score") > bound, 1).otherwise(0))
