"""A dense row index over the whole table, and windows over it, without a single task.

The order columns must form a total order (for example a date and a unique
key), otherwise the position of equal rows is arbitrary.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.materialize import written

WITHIN = (1 << 33) - 1  # monotonically_increasing_id: partition above bit 33, row below
SLICE = 1 << 18


def with_global_index(df: DataFrame, order_by: Sequence[str], name: str = "idx") -> DataFrame:
    """Add ``name`` = 0, 1, 2, ... in the order of ``order_by``.

    Range partitions follow the sampled key distribution; the unique last
    order column splits even a date that holds a third of the rows.  The
    position inside its partition is written with each row, because partition
    bounds come from a sample: counting and numbering must see the same ones.
    """
    tagged = written(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_tag", F.monotonically_increasing_id())
    )
    part = F.shiftright("_tag", 33).cast("int")
    # One count per partition, as many as the scheduler already tracks as tasks.
    sizes = sorted(tagged.groupBy(part.alias("_part")).count().collect())
    starts = np.concatenate([[0], np.cumsum([r["count"] for r in sizes])])[: len(sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(int(r["_part"]), int(s)) for r, s in zip(sizes, starts)], "_part int, _start long"
    )
    # A frame from the driver has no size Spark knows, so without the hint the table itself would be broadcast.
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_tag").bitwiseAND(F.lit(WITHIN)))
        .drop("_part", "_start", "_tag")
    )


def sliced(indexed: DataFrame, before: int, idx: str = "idx", rows: int = SLICE) -> DataFrame:
    """Cut the index into slices that also hold the ``before`` rows preceding them.

    Adds ``_slice`` and ``_extra`` (a row repeated from the slice before).
    Windows partitioned by ``_slice`` then see all they need; drop ``_extra``
    rows afterwards.
    """
    own = F.floor(F.col(idx) / rows)
    at_end = F.pmod(F.col(idx), F.lit(rows)) >= rows - before
    copies = F.when(
        at_end,
        F.array(F.struct(own.alias("s"), F.lit(False).alias("x")), F.struct((own + 1).alias("s"), F.lit(True).alias("x"))),
    ).otherwise(F.array(F.struct(own.alias("s"), F.lit(False).alias("x"))))
    return (
        indexed.withColumn("_copy", F.explode(copies))
        .withColumn("_slice", F.col("_copy.s"))
        .withColumn("_extra", F.col("_copy.x"))
        .drop("_copy")
    )
