"""Cross-products of many columns in one scan.

Each task sums blocks of products in numpy and hands on one row per column, whatever the number of pairs; a
missing value takes its row out of the pairs of that column only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.quantile import number

ROWS = 4096  # rows whose products are summed at once
# For a column, lists over all columns: rows that have both, sums and sums of squares of the own and of the
# other column over these rows, and the sum of products.
SUMS = ("n", "own", "own2", "other", "other2", "both")


def origins(df: DataFrame, columns: Sequence[str]) -> list[float | None]:
    """A value of each column from which its values are measured, so that a constant column is exactly zero."""
    row = df.agg(*[F.min(number(df, c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return list(row)


def _products(origin: list[float]):
    d = len(origin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = {k: np.zeros((d, d)) for k in SUMS}, False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns]) - origin
                has = np.isfinite(x).astype(float)
                x = np.where(has > 0, x, 0.0)
                own, own2 = x.T @ has, (x * x).T @ has
                for k, v in zip(SUMS, (has.T @ has, own, own2, own.T, own2.T, x.T @ x)):
                    sums[k] += v
                held = True
        if held:
            arrays = [pa.array(range(d), pa.int32()), *[pa.array(sums[k].tolist()) for k in SUMS]]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", *SUMS])

    return run


def cross_sums(df: DataFrame, columns: Sequence[str], origin: Sequence[float | None]) -> DataFrame:
    """``i`` and the lists of :data:`SUMS` for each column, measured from its origin; infinite values count as missing."""
    schema = "i int, " + ", ".join(f"{k} array<double>" for k in SUMS)

    def added(table: pa.Table) -> pa.Table:
        out = [pa.array([np.sum([v.as_py() for v in table[k]], axis=0).tolist()], pa.list_(pa.float64())) for k in SUMS]
        return pa.table([table["i"].slice(0, 1).combine_chunks(), *out], names=["i", *SUMS])

    numbers = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    tasks = numbers.mapInArrow(_products([0.0 if o is None else o for o in origin]), schema)
    return tasks.groupBy("i").applyInArrow(added, schema)
