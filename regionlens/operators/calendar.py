"""Calendar columns and gaps between rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regionlens.functions.expr import one_value, year_month
from regionlens.functions.globalindex import sliced, with_global_index


def time_features(df: DataFrame, date: str = "date") -> DataFrame:
    """year, month, day_of_week (Monday = 0) and is_weekend."""
    if date not in df.columns:
        return df
    d = F.col(date)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day_of_week": F.weekday(d),
            "is_weekend": (F.weekday(d) >= 5).cast("int"),
        }
    )


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """:func:`time_features` plus quarter and the first/last day of the month."""
    d = F.col(date)
    return time_features(df, date).withColumns(
        {
            "quarter": F.quarter(d),
            "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
            "is_month_end": (F.last_day(d) == F.to_date(d)).cast("int"),
        }
    )


def with_year_month(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn("year_month", year_month(F.col(date)))


def days_since_previous(df: DataFrame, date: str = "date", order_by: Sequence[str] = ("seq",)) -> DataFrame:
    """Whole elapsed days since the row before, in the order of ``order_by``.

    NULL on the first row, and on all rows when the table has one date only.
    """
    stamp = F.col(date).cast("timestamp_ntz")
    indexed = with_global_index(df.withColumn("_at", stamp), order_by)
    span = one_value(indexed.agg((F.min("_at") < F.max("_at")).alias("varies")))
    previous = F.lag("_at").over(W.partitionBy("_slice").orderBy("idx"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col("_at")) / 1_000_000
    return (
        sliced(indexed, before=1)
        .withColumn("_before", previous)
        .where(~F.col("_extra"))
        .withColumn("days_since_previous", F.when(span["varies"], F.floor(seconds / 86400)))
        .drop("_at", "_before", "_slice", "_extra", "idx")
    )


def rolling_mean(
    df: DataFrame, value: str, order_by: Sequence[str] = ("date", "seq"), width: int = 7
) -> DataFrame:
    """Mean of ``value`` over the row and the ``width - 1`` rows before it, over the whole table."""
    indexed = with_global_index(df, order_by)
    trailing = W.partitionBy("_slice").orderBy("idx").rowsBetween(-(width - 1), 0)
    return (
        sliced(indexed, before=width - 1)
        .withColumn("rolling_mean", F.avg(value).over(trailing))
        .where(~F.col("_extra"))
        .drop("_slice", "_extra", "idx")
    )
