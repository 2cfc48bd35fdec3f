"""Local outlier factor (Breunig et al. 2000) with exact neighbours and no cross join.

Equal rows are merged first and carry their number, so a group of copies is
one point.  Space is cut into boxes of a bounded number of points (``boxes``).
Round one finds, inside its own box, a distance that surely holds k
neighbours; round two sends each point only to the boxes that distance
touches.  Both rounds are grouped by box.  Neighbours are exact whatever the
boxes look like; boxes only decide how much work is done.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regionlens.config import LofCfg
from regionlens.functions.materialize import written
from regionlens.functions.quantile import quantiles
from regionlens.operators.boxes import around, cut_boxes, touched
from regionlens.operators.features import standardize

CHUNK = 256


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    total = np.zeros((len(q), len(p)))
    for d in range(q.shape[1]):
        diff = q[:, d, None] - p[None, :, d]
        total += diff * diff
    return np.sqrt(total)


def _edge(dist: np.ndarray, copies: np.ndarray, rows: int) -> np.ndarray:
    """Per line, the distance within which ``rows`` rows lie, or the largest if there are fewer.

    Every point holds at least one row, so the ``rows`` nearest points suffice.
    """
    take = min(rows, dist.shape[1])
    near = np.argpartition(dist, take - 1, axis=1)[:, :take] if take < dist.shape[1] else np.argsort(dist, axis=1)
    close = np.take_along_axis(dist, near, axis=1)
    order = np.argsort(close, axis=1)
    close, held = np.take_along_axis(close, order, axis=1), copies[np.take_along_axis(near, order, axis=1)].cumsum(axis=1)
    last = np.where(held[:, -1] >= rows, np.argmax(held >= rows, axis=1), take - 1)
    return close[np.arange(len(close)), last]


def nearest(points: DataFrame, dims: int, k: int, cfg: LofCfg) -> DataFrame:
    """The points within reach of each point that can be among its ``k`` neighbours.

    ``points`` holds distinct vectors: ``pid``, ``x0..``, ``copies``.  Returns
    ``(pid, nid, distance, copies)`` and the vector of the neighbour; the
    point itself is among them at distance 0.
    """
    xs = [f"x{d}" for d in range(dims)]
    space = cut_boxes(points.select("pid", "copies", *xs), xs, cfg.leaf_rows)
    fields = "pid long, copies long, " + ", ".join(f"{x} double" for x in xs) + ", box string"
    placed = space.placed.select("pid", "copies", *xs, "box")

    def reach_inside(pdf: pd.DataFrame) -> pd.DataFrame:
        """Distance within which k other rows lie: in the same box, or in the node above that holds enough."""
        x, copies = pdf[xs].to_numpy(dtype=float), pdf["copies"].to_numpy()
        if copies.sum() > k:
            reach = np.empty(len(x))
            for a in range(0, len(x), CHUNK):
                # The point itself is one of the rows counted.
                reach[a : a + CHUNK] = _edge(_distances(x[a : a + CHUNK], x), copies, k + 1)
        else:
            # To the farthest corner of that node's data.
            low, high = (np.array(pdf[c].iloc[0], dtype=float) for c in ("far_low", "far_high"))
            reach = np.sqrt((np.maximum(x - low, high - x) ** 2).sum(axis=1))
        return pdf.drop(columns=["far_low", "far_high"]).assign(reach=reach)

    reached = placed.join(around(space, k), "box", "left").groupBy("box").applyInPandas(reach_inside, f"{fields}, reach double")
    visits = touched(written(reached.drop("box", "copies")), xs, space)

    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        """Points of the box within reach of each visitor, at most the nearest that hold k + 1 rows."""
        parts = []
        px, copies, nid = p[xs].to_numpy(dtype=float), p["copies"].to_numpy(), p["pid"].to_numpy()
        for a in range(0, len(q) if len(p) else 0, CHUNK):
            part = q.iloc[a : a + CHUNK]
            dist = _distances(part[xs].to_numpy(dtype=float), px)
            edge = _edge(dist, copies, k + 1)
            keep = (dist <= edge[:, None]) & (dist <= part["reach"].to_numpy()[:, None] * (1 + 1e-9))
            who, where = np.nonzero(keep)
            parts.append(
                pd.DataFrame(
                    {
                        "pid": part["pid"].to_numpy()[who],
                        "nid": nid[where],
                        "distance": dist[who, where],
                        "copies": copies[where],
                        **{f"n{x}": px[where, d] for d, x in enumerate(xs)},
                    }
                )
            )
        if not parts:
            return pd.DataFrame({c: [] for c in ("pid", "nid", "distance", "copies", *[f"n{x}" for x in xs])})
        return pd.concat(parts, ignore_index=True)

    # A box that many points reach meets its visitors in shares, as many as their number asks for.
    shares = visits.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / (4 * cfg.leaf_rows)).cast("int").alias("shares"))
    shares = written(shares)
    visitors = visits.join(shares, "box").withColumn("share", F.pmod(F.xxhash64("pid"), F.col("shares")).cast("int")).drop("shares")
    hosts = placed.join(shares, "box").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return (
        visitors.groupBy("box", "share")
        .cogroup(hosts.groupBy("box", "share"))
        .applyInPandas(
            compare, "pid long, nid long, distance double, copies long, " + ", ".join(f"n{x} double" for x in xs)
        )
    )


def _take(copies: Column, k: int, vector: Sequence[str]) -> Column:
    """How many of the rows a point holds are among the ``k`` nearest: nearest first, ties by vector."""
    nearest_first = W.partitionBy("pid").orderBy("distance", *vector).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(copies).over(nearest_first), F.lit(0))
    return F.greatest(F.least(copies, F.lit(k) - before), F.lit(0))


def lof(
    ml: DataFrame, cols: Sequence[str], key: Sequence[str] = ("state", "year_month"), cfg: LofCfg = LofCfg()
) -> DataFrame:
    """``ml`` with ``anomaly_score`` (factor at fit time) and ``is_anomaly``.

    The flag compares the factor of a row seen as a new query, which finds
    itself among its neighbours, with the contamination quantile of the fit-time
    factors.
    """
    dims = len(cols)
    xs = [f"x{d}" for d in range(dims)]
    # Adding 0.0 turns -0.0 into 0.0, so equal vectors group and join as equal.
    scaled = written(
        standardize(written(ml), cols, "_lof").withColumns({x: F.col(f"{c}_lof") + 0.0 for x, c in zip(xs, cols)})
        .drop(*[f"{c}_lof" for c in cols])
    )
    points = written(
        scaled.groupBy(*xs)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("pid", F.monotonically_increasing_id())
    )
    rows = int(points.agg(F.sum("copies")).first()[0] or 0)
    if rows < 2:
        return ml.withColumns({"is_anomaly": F.lit(0), "anomaly_score": F.lit(1.0)})
    k = max(1, min(cfg.neighbours, rows - 1))

    # Fit time: a row is not its own neighbour, but its copies are.  Query time:
    # the row and its copies come first, at distance 0.  One sort serves both.
    order = [f"n{x}" for x in xs]
    copies = F.col("copies")
    others = copies - F.when(F.col("pid") == F.col("nid"), 1).otherwise(0)
    picks = written(
        nearest(points, dims, k, cfg)
        .withColumns({"fit": _take(others, k, order), "query": _take(copies, k, order)})
        .where((F.col("fit") > 0) | (F.col("query") > 0))
        .select("pid", "nid", "distance", "fit", "query")
    )
    mean = lambda value, weight: F.sum(value * F.col(weight)) / F.sum(weight)
    kdist = picks.where(F.col("fit") > 0).groupBy("pid").agg(F.max("distance").alias("kdist"))
    far = F.greatest("distance", "kdist")
    density = written(
        picks.join(kdist.withColumnRenamed("pid", "nid"), "nid")
        .groupBy("pid")
        .agg((1.0 / (mean(far, "fit") + 1e-10)).alias("lrd"), (1.0 / (mean(far, "query") + 1e-10)).alias("query_lrd"))
    )
    known = density.select(F.col("pid").alias("nid"), F.col("lrd").alias("nlrd"))
    factors = (
        picks.join(known, "nid")
        .groupBy("pid")
        .agg(mean(F.col("nlrd"), "fit").alias("_fit"), mean(F.col("nlrd"), "query").alias("_q"))
        .join(density, "pid")
        .select("pid", (F.col("_fit") / F.col("lrd")).alias("anomaly_score"), (F.col("_q") / F.col("query_lrd")).alias("_query"))
    )
    scored = written(
        scaled.join(points.join(factors, "pid").select(*xs, "anomaly_score", "_query"), xs).drop(*xs)
    )
    bound = quantiles(scored, ["anomaly_score"], [1 - cfg.contamination])["anomaly_score"][0]
    return scored.withColumn("is_anomaly", F.when(F.col("_query") > bound, 1).otherwise(0)).drop("_query")
