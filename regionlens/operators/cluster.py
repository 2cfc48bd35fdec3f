"""Grouping of regions: features, k-means, silhouette, descriptions, projection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.config import AGE_COLUMNS, ClusterCfg
from regionlens.functions.expr import one_value
from regionlens.functions.gram import cross_sums, origins
from regionlens.functions.materialize import written
from regionlens.functions.quantile import quantiles
from regionlens.operators.features import standardize

NOT_FEATURES = ("state", "cluster", "cluster_label", "cluster_description")
KEY_METRICS = ("total_enrolments", "avg_enrolments", "avg_update_ratio", "avg_growth", "anomaly_frequency")
BLOCK = 1024
UNIT = 1 << 24  # features of k-means are whole multiples of one part of it


def state_features(scored: DataFrame) -> DataFrame:
    """All features of a region in one aggregation; missing values are 0."""
    has = set(scored.columns)
    aggs = []
    if "enrolment_count_sum" in has:
        c = F.col("enrolment_count_sum")
        aggs += [
            F.sum(c).alias("total_enrolments"),
            F.avg(c).alias("avg_enrolments"),
            F.stddev_samp(c).alias("std_enrolments"),
        ]
    if "update_count_sum" in has:
        aggs.append(F.sum("update_count_sum").alias("total_updates"))
        if "update_ratio" in has:
            aggs.append(F.avg("update_ratio").alias("avg_update_ratio"))
    if "mom_growth" in has:
        aggs += [F.avg("mom_growth").alias("avg_growth"), F.stddev_samp("mom_growth").alias("growth_volatility")]
    if "anomaly_score" in has:
        aggs += [
            F.avg("is_anomaly").alias("anomaly_frequency"),
            F.avg("anomaly_score").alias("avg_anomaly_score"),
        ]
    ages = [a for a in AGE_COLUMNS if f"{a}_sum" in has]
    aggs += [F.sum(f"{a}_sum").alias(f"{a}_pct") for a in ages]
    df = scored.where(F.col("state").isNotNull()).groupBy("state").agg(*aggs)
    if ages:
        total = sum((F.coalesce(F.col(f"{a}_pct"), F.lit(0.0)) for a in ages), F.lit(0.0))
        df = df.withColumn("_t", total).withColumns(
            {f"{a}_pct": F.try_divide(F.col(f"{a}_pct"), F.col("_t")) for a in ages}
        ).drop("_t")
    return df.select("state", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in df.columns if c != "state"])


def feature_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, added up feature by feature."""
    total = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        diff = x[:, d, None] - y[None, :, d]
        total += diff * diff
    return total


def _points(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1) / UNIT


def _farthest(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Of each run, the region farthest from the centres it has (ties: the first name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, names = _points(batch), np.array(batch.column("state").to_pylist(), object)
                for r, own in enumerate(centres):
                    near = _squared(x, own).min(axis=1)
                    far = np.flatnonzero(near == near.max())
                    i = int(far[np.argmin(names[far])])
                    row = [pa.array([r], pa.int32()), pa.array([-near[i]]), pa.array([names[i]]), batch.column("x").slice(i, 1)]
                    yield pa.RecordBatch.from_arrays(row, names=["r", "less", "state", "x"])

    best = points.mapInArrow(run, "r int, less double, state string, x array<long>").groupBy("r")
    rows = best.agg(F.min(F.struct("less", "state", "x")).alias("m")).select("r", "m.x").collect()
    return np.array([r["x"] for r in sorted(rows)], float) / UNIT


def _moved(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the regions nearest to each centre, and the squared distances of every run. A centre without regions stays."""
    runs, k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cost = np.zeros((runs, k), np.int64), np.zeros((runs, k, d), np.int64), np.zeros((runs, k))
        for batch in batches:
            x, whole = _points(batch), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            for r in range(runs):
                far = _squared(x, centres[r])
                near = far.argmin(axis=1)
                n[r] += np.bincount(near, minlength=k)
                cost[r] += np.bincount(near, far.min(axis=1), k)
                np.add.at(sums[r], near, whole)
        at = np.argwhere(n > 0)
        rows = [pa.array(at[:, i], pa.int32()) for i in (0, 1)]
        rows += [pa.array(n[n > 0]), pa.array(cost[n > 0]), pa.array(sums[n > 0].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, names=["r", "c", "n", "cost", "sums"])

    total = points.mapInArrow(run, "r int, c int, n long, cost double, sums array<long>").groupBy("r", "c")
    new, cost = centres.copy(), np.zeros(runs)
    for row in total.agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums")).collect():
        new[row["r"], row["c"]] = np.array(row["sums"], float) / row["n"] / UNIT
        cost[row["r"]] += row["cost"]
    return new, cost


def kmeans_states(sf: DataFrame, cfg: ClusterCfg = ClusterCfg()) -> DataFrame:
    """``sf`` with ``cluster`` and ``cluster_label``: the best of ``cfg.restarts`` k-means runs.

    A run starts from one of the regions farthest from the mean and takes as next centre the region farthest from the
    centres it has (ties: the first name).  All runs move in the same scans, which sum regions by run and
    cluster; features are whole multiples of ``1 / UNIT``, so these sums are exact and neither the order nor the partitions
    of the rows change the result.  Clusters are numbered by their first region.
    """
    cols = feature_cols(sf)
    scaled = standardize(written(sf), cols, "_km")
    whole = F.array(*[F.round(F.col(f"{c}_km") * UNIT).cast("long") for c in cols])
    points = written(scaled.select("state", *cols, whole.alias("x")))
    first = F.aggregate("x", F.lit(0.0), lambda s, v: s + (v / UNIT) * (v / UNIT))
    seeds = points.select("state", "x", first.alias("far")).orderBy(F.desc("far"), "state").limit(cfg.restarts).collect()
    k = min(cfg.k, points.limit(cfg.k).count())
    if k < 2:
        return points.select("state", *cols, F.lit(0).alias("cluster"), F.lit("Cluster 1").alias("cluster_label"))
    centres = np.array([[s["x"]] for s in seeds], float) / UNIT
    while centres.shape[1] < k:
        centres = np.concatenate([centres, _farthest(points, centres)[:, None]], axis=1)
    for _ in range(cfg.max_iter):
        moved, cost = _moved(points, centres)
        if (moved == centres).all():
            break
        centres = moved
    best = centres[int(np.argmin(cost))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _squared(_points(batch), best).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "_c"])

    placed = written(points.mapInArrow(assign, T.StructType([*points.schema.fields, T.StructField("_c", T.IntegerType())])))
    order = [r["_c"] for r in placed.groupBy("_c").agg(F.min("state").alias("first")).orderBy("first").collect()]
    cluster = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("_c")).cast("int") - 1
    return placed.select("state", *cols, cluster.alias("cluster")).withColumn(
        "cluster_label", F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string"))
    )


def squared_silhouette(clus: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean silhouette by squared distances, one row ``(silhouette)``; NULL with a single cluster.

    The mean squared distance to a cluster follows from its size, its sums and its sum of squares, so regions are
    compared with clusters, never with each other: for any number of regions, where the euclidean form of
    :func:`silhouette` has to meet every pair.
    """
    cols = list(cols) if cols is not None else feature_cols(clus)
    scaled = written(standardize(written(clus.select("state", "cluster", *cols)), cols, "_s"))
    xs = [F.col(f"{c}_s") for c in cols]
    square = sum((x * x for x in xs[1:]), xs[0] * xs[0])
    moments = scaled.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x) for x in xs]).alias("s"), F.sum(square).alias("q")
    )
    # One row per cluster, carried by every region as an array.
    every = one_value(moments.agg(F.collect_list(F.struct("cluster", "n", "s", "q")).alias("every")))["every"]

    def mean_to(c: Column, rows: Column) -> Column:
        dot = sum((x * c["s"][i] for i, x in enumerate(xs[1:], 1)), xs[0] * c["s"][0])
        return (c["n"] * F.col("_q") - 2 * dot + c["q"]) / rows

    own = F.filter("_every", lambda c: c["cluster"] == F.col("cluster"))[0]
    others = F.filter("_every", lambda c: c["cluster"] != F.col("cluster"))
    a = mean_to(own, F.nullif(own["n"] - 1, F.lit(0)))
    b = F.array_min(F.transform(others, lambda c: mean_to(c, c["n"])))
    rows = scaled.withColumn("_every", every).withColumn("_q", square).select(own["n"].alias("size"), a.alias("a"), b.alias("b"))
    one = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return rows.agg(F.avg(F.when(F.col("b").isNotNull(), one)).alias("silhouette"))


def silhouette(clus: DataFrame, cols: Sequence[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Mean euclidean silhouette, one row ``(silhouette)``; NULL with a single cluster.

    The mean distance from a region to a cluster needs every distance once.
    Regions are spread over blocks and each task measures one block against
    another, giving back only sums per region and cluster.
    """
    cols = list(cols) if cols is not None else feature_cols(clus)
    scaled = written(standardize(written(clus.select("state", "cluster", *cols)), cols, "_s"))
    xs = [f"x{i}" for i in range(len(cols))]
    n = one_value(scaled.agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n")))
    rows = (
        scaled.select("state", "cluster", *[F.col(f"{c}_s").alias(x) for c, x in zip(cols, xs)])
        .withColumn("_n", n["n"])
        .withColumn("own", F.pmod(F.xxhash64("state"), F.col("_n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .drop("_n")
    )

    def measure(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(a) and len(b):
            x, y = a[xs].to_numpy(dtype=float), b[[f"r_{x}" for x in xs]].to_numpy(dtype=float)
            total = np.zeros((len(x), len(y)))
            for d in range(len(xs)):
                diff = x[:, d, None] - y[None, :, d]
                total += diff * diff
            dist = np.sqrt(total)
            label = b["r_cluster"].to_numpy()
            for c in np.unique(label):
                parts.append(
                    pd.DataFrame(
                        {
                            "state": a["state"],
                            "cluster": a["cluster"],
                            "to_cluster": c,
                            "distance": dist[:, label == c].sum(axis=1),
                            "members": int((label == c).sum()),
                        }
                    )
                )
        if parts:
            return pd.concat(parts)
        return pd.DataFrame({"state": [], "cluster": [], "to_cluster": [], "distance": [], "members": []})

    left = rows.groupBy(F.col("own").alias("i"), F.col("other").alias("j"))
    facing = rows.toDF(*[f"r_{c}" for c in rows.columns])
    right = facing.groupBy(F.col("r_other").alias("i"), F.col("r_own").alias("j"))
    sums = (
        left.cogroup(right)
        .applyInPandas(measure, "state string, cluster int, to_cluster int, distance double, members long")
        .groupBy("state", "cluster", "to_cluster")
        .agg(F.sum("distance").alias("distance"), F.sum("members").alias("members"))
    )
    same = F.col("to_cluster") == F.col("cluster")
    per_state = sums.groupBy("state").agg(
        F.max(F.when(same, F.col("members"))).alias("size"),
        F.max(F.when(same, F.try_divide(F.col("distance"), F.col("members") - 1))).alias("a"),
        F.min(F.when(~same, F.col("distance") / F.col("members"))).alias("b"),
    )
    one = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return per_state.agg(F.avg(F.when(F.col("b").isNotNull(), one)).alias("silhouette"))


def cluster_stats(clus: DataFrame) -> DataFrame:
    """Size, first five regions and mean key metrics per cluster."""
    metrics = [m for m in KEY_METRICS if m in clus.columns]
    first = (
        clus.withColumn("_rank", F.row_number().over(W.partitionBy("cluster").orderBy("state")))
        .where(F.col("_rank") <= 5)
        .groupBy("cluster")
        .agg(F.array_join(F.array_sort(F.collect_list("state")), ", ").alias("states"))
    )
    sizes = clus.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("state_count"), *[F.avg(m).alias(f"avg_{m}") for m in metrics]
    )
    return sizes.join(first, "cluster")


def describe_clusters(clus: DataFrame, accuracy: int | None = None) -> DataFrame:
    """``clus`` with ``cluster_description`` built from the means of each cluster."""
    stats = clus.groupBy("cluster").agg(*[F.avg(m).alias(f"avg_{m}") for m in KEY_METRICS if m in clus.columns])
    parts = []
    if "total_enrolments" in clus.columns:
        q1, q3 = quantiles(clus, ["total_enrolments"], [0.25, 0.75], accuracy)["total_enrolments"]
        volume = F.col("avg_total_enrolments")
        parts.append(
            F.when(volume > q3, "High Volume")
            .when(volume < q1, "Low Volume")
            .otherwise("Medium Volume")
        )
    if "avg_growth" in clus.columns:
        growth = F.col("avg_avg_growth")
        parts.append(
            F.when(growth > 0.1, "Rapid Growth").when(growth < -0.05, "Declining").otherwise("Stable")
        )
    if "anomaly_frequency" in clus.columns:
        parts.append(F.when(F.col("avg_anomaly_frequency") > 0.2, "High Anomalies").otherwise("Low Anomalies"))
    text = F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string"), F.lit(": "), F.concat_ws(", ", *parts))
    return clus.join(stats.select("cluster", text.alias("cluster_description")), "cluster", "left")


def pca_2d(clus: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``clus`` with ``x`` and ``y``: projection of the unscaled features on two principal components.

    One scan sums the cross-products of the features, measured from values of their own; these are centred before the
    eigenvectors are taken.  Each axis points the way that makes its largest loading positive (ties: the first
    feature).  With fewer than two features, ``y`` is 0.
    """
    cols = list(cols) if cols is not None else feature_cols(clus)
    table = written(clus.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in clus.columns]))
    origin = origins(table, cols)
    sums = sorted(cross_sums(table, cols, origin).collect(), key=lambda r: r["i"])
    if not sums:
        return table.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    n, s = sums[0]["n"][0], np.array([r["own"][r["i"]] for r in sums])
    covariance = np.array([r["both"] for r in sums]) / n - np.outer(s, s) / (n * n)
    axes = np.linalg.eigh(covariance)[1][:, ::-1][:, :2]
    loading = np.abs(axes)
    top = (loading >= loading.max(axis=0) * (1 - 1e-9)).argmax(axis=0)
    axes = axes * np.where(axes[top, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    centre = [o + x / n for o, x in zip(origin, s)]
    at = [sum((F.col(c) - F.lit(float(m))) * F.lit(float(v)) for c, m, v in zip(cols, centre, axis)) for axis in axes.T]
    return table.withColumns({"x": at[0], "y": at[1] if len(at) > 1 else F.lit(0.0)})
