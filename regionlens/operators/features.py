"""Choice and scaling of model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.expr import numeric_columns, one_value

# Features preferred for outlier models, in order.
PRIORITY = ("enrolment_count_sum", "mom_growth", "enrolment_zscore", "update_ratio", "volatility")
NEVER_FEATURES = ("year", "month", "quarter", "state_encoded")


def feature_names(df: DataFrame, cols: Sequence[str] | None = None, most: int | None = None) -> list[str]:
    """The columns asked for, else the preferred features present, else (fewer than three) all numeric columns.

    ``most`` cuts the list, which loses features; it is off unless given.
    """
    if cols is not None:
        return list(cols)
    chosen = [c for c in PRIORITY if c in df.columns]
    if len(chosen) < 3:
        chosen = numeric_columns(df, exclude=NEVER_FEATURES)
    return chosen[:most]


def select_features(df: DataFrame, keys: Sequence[str] = ("state", "year_month")) -> DataFrame:
    return df.select(*[k for k in keys if k in df.columns], *feature_names(df))


def filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_std") -> DataFrame:
    """Add ``(x - mean) / population deviation`` per column; missing counts as 0, no spread gives 0."""
    stats = one_value(
        df.agg(
            *[F.avg(filled(c)).alias(f"m_{c}") for c in cols],
            *[F.stddev_pop(filled(c)).alias(f"s_{c}") for c in cols],
        )
    )
    scale = lambda c: F.when(F.col(f"_s.s_{c}") == 0, 1.0).otherwise(F.col(f"_s.s_{c}"))
    return (
        df.withColumn("_s", stats)
        .withColumns({f"{c}{suffix}": (filled(c) - F.col(f"_s.m_{c}")) / scale(c) for c in cols})
        .drop("_s")
    )
