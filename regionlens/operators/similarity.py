"""Cosine similarity between regions.

The result has one row per pair of regions, so it is quadratic in the number
of regions by definition.  The work is a product of the date-by-region matrix
with itself.  It is summed inside the tasks, block by block, and only the sums
are shuffled; no pair is emitted per date.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.expr import one_value
from regionlens.functions.globalindex import with_global_index
from regionlens.functions.materialize import written
from regionlens.operators.aggregate import date_state_cells

BLOCK = 512


def _block_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum value products of regions sharing a date; input is sorted by block pair, then date."""
    current, names, sums, held = None, {}, np.zeros((0, 0)), None
    own_block: dict[str, int] = {}
    # The roster rows (empty date) of a block pair sit in one task; only that
    # task reports pairs without a common date.
    complete = False

    def start(key: tuple) -> None:
        nonlocal current, names, sums, own_block, complete
        current, names, sums, own_block, complete = key, {}, np.zeros((0, 0)), {}, False

    def add(rows: pd.DataFrame) -> None:
        nonlocal sums, complete
        own_block.update(zip(rows["state"], rows["block"]))
        complete = complete or bool((rows["date"] == "").any())
        fresh = [s for s in rows["state"].unique() if s not in names]
        for s in fresh:
            names[s] = len(names)
        if len(names) > sums.shape[0]:
            size = max(len(names), 2 * sums.shape[0])
            grown = np.zeros((size, size))
            grown[: sums.shape[0], : sums.shape[1]] = sums
            sums = grown
        rows = rows[rows["total"].notna()]
        # A date with one region adds nothing to a product of two regions.
        rows = rows[rows["date"].duplicated(keep=False)]
        if rows.empty:
            return
        dates, _ = pd.factorize(rows["date"])
        for part in np.array_split(np.arange(dates.max() + 1), 1 + dates.max() // 1024):
            sel = (dates >= part[0]) & (dates <= part[-1])
            cells = np.zeros((len(part), sums.shape[0]))
            cells[dates[sel] - part[0], rows["state"].map(names).to_numpy()[sel]] = rows["total"].to_numpy()[sel]
            sums += cells.T @ cells

    def result() -> Iterator[pd.DataFrame]:
        order = sorted(names)
        where = np.array([names[s] for s in order], dtype=int)
        side = np.array([own_block[s] for s in order])
        a, b = current
        for i, s in enumerate(order[:-1]):
            later = np.arange(i + 1, len(order))
            if a != b:
                later = later[side[later] != side[i]]
            if not complete:
                later = later[sums[where[i], where[later]] != 0]
            if len(later):
                yield pd.DataFrame(
                    {
                        "state1": s,
                        "state2": [order[j] for j in later],
                        "dot": sums[where[i], where[later]],
                    }
                )

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        # The last date of a batch may go on in the next one.
        last = (rows["b1"] == rows["b1"].iloc[-1]) & (rows["b2"] == rows["b2"].iloc[-1])
        last &= rows["date"] == rows["date"].iloc[-1]
        held = rows[last]
        for key, part in rows[~last].groupby(["b1", "b2"], sort=True):
            if key != current:
                if current is not None:
                    yield from result()
                start(key)
            add(part)
    if held is not None and len(held):
        key = (held["b1"].iloc[0], held["b2"].iloc[0])
        if key != current:
            if current is not None:
                yield from result()
            start(key)
        add(held)
    if current is not None:
        yield from result()


def _norms(cells: DataFrame) -> DataFrame:
    return cells.groupBy("state").agg(F.sqrt(F.sum(F.col("total") * F.col("total"))).alias("norm"))


def cosine_pairs(facts: DataFrame, date: str | None = "date", block: int = BLOCK) -> DataFrame:
    """``(state1, state2, similarity)`` for every pair of regions, ``state1 < state2``.

    Vectors are sums per date; regions that share no date, or have a zero
    vector, get 0.  Without a date column the vectors have one dimension.
    """
    return _pairs(_cells(facts, date), block)


def _cells(facts: DataFrame, date: str | None) -> DataFrame:
    """Non-empty cells, written once: norms, roster and products all read them."""
    return written(
        date_state_cells(facts, date).select(
            F.coalesce(F.col("date").cast("string"), F.lit("all")).alias("date"), "state", "total"
        )
    )


def _pairs(cells: DataFrame, block: int) -> DataFrame:
    norms = _norms(cells)
    blocks = one_value(norms.agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n")))
    # A row without value for each region lets pairs without a common date appear.
    roster = norms.select(F.lit("").alias("date"), "state", F.lit(None).cast("double").alias("total"))
    placed = (
        cells.unionByName(roster)
        .withColumn("_n", blocks["n"])
        .withColumn("block", F.pmod(F.xxhash64("state"), F.col("_n")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select(
            F.least("block", "_other").alias("b1"),
            F.greatest("block", "_other").alias("b2"),
            "block",
            "date",
            "state",
            "total",
        )
    )
    dots = (
        placed.repartition("b1", "b2", "date")
        .sortWithinPartitions("b1", "b2", "date")
        .mapInPandas(_block_products, "state1 string, state2 string, dot double")
        .groupBy("state1", "state2")
        .agg(F.sum("dot").alias("dot"))
    )
    left = norms.select(F.col("state").alias("state1"), F.col("norm").alias("norm1"))
    right = norms.select(F.col("state").alias("state2"), F.col("norm").alias("norm2"))
    return (
        dots.join(left, "state1")
        .join(right, "state2")
        .select(
            "state1",
            "state2",
            F.coalesce(F.try_divide(F.col("dot"), F.col("norm1") * F.col("norm2")), F.lit(0.0)).alias("similarity"),
        )
    )


SLACK = 1e-9  # rounding must not lose a pair that just reaches the bound


def blocked(unit: DataFrame, block: int) -> DataFrame:
    """``state, block, months``: regions in blocks of the same size, those with the same strongest month together.

    ``months`` lists the lengths of the region's vector by month.
    """
    months = unit.groupBy("state", F.substring("date", 1, 7).alias("month")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    strongest = F.max_by("month", F.struct("norm", "month")).alias("top")
    regions = months.groupBy("state").agg(strongest, F.max("norm").alias("share"), F.collect_list(F.struct("month", "norm")).alias("months"))
    placed = with_global_index(regions, ["top", "share", "state"])
    return placed.select("state", F.floor(F.col("idx") / block).alias("block"), "months")


def block_pairs(blocks: DataFrame, min_similarity: float) -> DataFrame:
    """``b1, b2``: pairs of blocks that may hold similar regions.

    Within a month two vectors have at most the product of their lengths in common, so the products of the largest lengths of
    two blocks, added up over the months, bound every similarity between them.  Blocks are compared by the months they share.
    """
    longest = written(blocks.select("block", F.inline("months")).groupBy("block", "month").agg(F.max("norm").alias("norm")))
    a = longest.select(F.col("block").alias("b1"), "month", F.col("norm").alias("n1"))
    b = longest.select(F.col("block").alias("b2"), "month", F.col("norm").alias("n2"))
    bound = a.join(b, "month").where("b1 <= b2").groupBy("b1", "b2").agg(F.sum(F.col("n1") * F.col("n2")).alias("most"))
    return bound.where(F.col("most") >= min_similarity - SLACK).select("b1", "b2")


def _similar(min_similarity: float):
    """Similar pairs of two blocks: only regions whose month lengths allow it are compared by their days."""

    def dense(pdf: pd.DataFrame, keys: list, column: str, names: list) -> np.ndarray:
        out = np.zeros((len(names), len(keys)))
        out[pd.Index(names).get_indexer(pdf["state"]), pd.Index(keys).get_indexer(pdf[column])] = pdf["x"]
        return out

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        right = right.rename(columns=lambda c: c.removeprefix("r_"))
        if len(left) and len(right):
            sides = [(pdf, sorted(pdf["state"].unique())) for pdf in (left, right)]
            months = []
            for pdf, names in sides:
                m = pdf.assign(month=pdf["date"].str[:7], x=pdf["x"] ** 2).groupby(["state", "month"], as_index=False)["x"].sum()
                months.append((m.assign(x=np.sqrt(m["x"])), names))
            shared = sorted(set(months[0][0]["month"]) & set(months[1][0]["month"]))
            may = [dense(m[m["month"].isin(shared)], shared, "month", names) for m, names in months]
            open_ = may[0] @ may[1].T >= min_similarity - SLACK
            if left["b1"].iloc[0] == left["b2"].iloc[0]:
                open_ &= np.triu(np.ones_like(open_), 1)
            use = [np.flatnonzero(open_.any(axis=1 - i)) for i in (0, 1)]
            if len(use[0]):
                kept = [[names[i] for i in u] for (_, names), u in zip(sides, use)]
                rows = [pdf[pdf["state"].isin(k)] for (pdf, _), k in zip(sides, kept)]
                days = sorted(set(rows[0]["date"]) & set(rows[1]["date"]))
                total = np.zeros((len(kept[0]), len(kept[1])))
                for at in range(0, len(days), 512):
                    part = days[at : at + 512]
                    x, y = (dense(r[r["date"].isin(part)], part, "date", k) for r, k in zip(rows, kept))
                    total += x @ y.T
                hit = np.argwhere(open_[np.ix_(*use)] & (total >= min_similarity))
                parts = [(min(kept[0][i], kept[1][j]), max(kept[0][i], kept[1][j]), total[i, j]) for i, j in hit]
        return pd.DataFrame(parts, columns=["state1", "state2", "similarity"])

    return run


def similar_pairs(facts: DataFrame, min_similarity: float, date: str = "date", block: int = BLOCK) -> DataFrame:
    """``(state1, state2, similarity)`` of the pairs with at least ``min_similarity`` (above zero), ``state1 < state2``.

    Exact without all pairs, also where all regions share their dates: regions lie in blocks by their strongest month, and
    only pairs of blocks whose month lengths allow the similarity are brought together; inside them the same bound
    rules out pairs of regions before any day is looked at.
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity lies above 0 and at most at 1")
    cells = _cells(facts, date).where("total <> 0")
    unit = written(cells.join(_norms(cells), "state").select("state", "date", (F.col("total") / F.col("norm")).alias("x")))
    blocks = written(blocked(unit, block))
    pairs = written(block_pairs(blocks, min_similarity))
    rows = unit.join(blocks.select("state", "block"), "state")
    left, right = (rows.join(pairs.withColumn("block", F.col(side)), "block").drop("block") for side in ("b1", "b2"))
    facing = right.toDF(*[f"r_{c}" for c in right.columns])
    return (
        left.groupBy("b1", "b2")
        .cogroup(facing.groupBy("r_b1", "r_b2"))
        .applyInPandas(_similar(min_similarity), "state1 string, state2 string, similarity double")
    )


def cosine_matrix(facts: DataFrame, date: str | None = "date") -> DataFrame:
    """Both directions of every pair and the diagonal, in long form."""
    cells = _cells(facts, date)
    pairs = _pairs(cells, BLOCK)
    diagonal = _norms(cells).select(
        F.col("state").alias("state1"),
        F.col("state").alias("state2"),
        F.when(F.col("norm") > 0, 1.0).otherwise(0.0).alias("similarity"),
    )
    both = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("state1"), F.col("state2"), F.col("similarity")),
                F.struct(F.col("state2").alias("state1"), F.col("state1").alias("state2"), F.col("similarity")),
            )
        )
    )
    return both.unionByName(diagonal)
