"""Aggregates by region and month, and the measures derived from them.

Every aggregate is a hash aggregate with a map-side partial step, so a region
holding a third of all rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regionlens.config import AGE_COLUMNS
from regionlens.functions.expr import month_start, numeric_columns, one_value, ratio_or_zero, year_month
from regionlens.functions.globalindex import with_global_index
from regionlens.functions.materialize import written

COUNT_CHOICES = ("enrolment_count", "Total_Enrolments", "enrolments")
UPDATE_CHOICES = ("update_count", "Total_Updates", "updates")


def first_present(df: DataFrame, choices: Sequence[str]) -> str | None:
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[c.lower()] for c in choices if c.lower() in by_lower), None)


def _total(c: str) -> Column:
    return F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))


def by_state_month(facts: DataFrame) -> DataFrame:
    """Sum, mean and deviation of the count and sum of updates and ages per region and month.

    Without a count or update column the first two numeric columns are summed
    under their own names.
    """
    count, updates = first_present(facts, COUNT_CHOICES), first_present(facts, UPDATE_CHOICES)
    aggs = []
    if count:
        c = F.col(count).cast("double")
        aggs += [
            _total(count).alias("enrolment_count_sum"),
            F.avg(c).alias("enrolment_count_mean"),
            F.stddev_samp(c).alias("enrolment_count_std"),
        ]
    if updates:
        # Updates alone keep their own name, and no measures are derived from them.
        aggs.append(_total(updates).alias("update_count_sum" if count else updates))
    if not aggs:
        plain = numeric_columns(facts)[:2]
        if not plain:
            raise ValueError("no numeric column to aggregate")
        aggs = [_total(c).alias(c) for c in plain]
    elif count:
        aggs += [_total(a).alias(f"{a}_sum") for a in AGE_COLUMNS if a in facts.columns]
    return (
        facts.where(F.col("state").isNotNull() & F.col("date").isNotNull())
        .groupBy("state", year_month(F.col("date")).alias("year_month"))
        .agg(*aggs)
    )


def by_state() -> W:
    """Months of one region: bounded by the calendar, because rows are unique per region and month."""
    return W.partitionBy("state")


def add_growth(agg: DataFrame, value: str, calendar: bool = False) -> DataFrame:
    """Relative change to the previous row of the region; NULL when that was zero.

    ``calendar=True`` compares with the previous calendar month only.
    """
    ordered = by_state().orderBy("year_month")
    before = F.lag(value).over(ordered)
    if calendar:
        gap = F.months_between(
            month_start(F.col("year_month")), month_start(F.lag("year_month").over(ordered))
        )
        before = F.when(gap == 1, before)
    return agg.withColumn("mom_growth", F.try_divide(F.col(value), before) - 1)


def add_zscore(agg: DataFrame, value: str) -> DataFrame:
    sd = F.stddev_samp(value).over(by_state())
    return agg.withColumn("z_score", F.when(sd > 0, (F.col(value) - F.avg(value).over(by_state())) / sd).otherwise(0.0))


def add_update_ratio(agg: DataFrame) -> DataFrame:
    base = F.col("enrolment_count_sum")
    return agg.withColumn("update_ratio", F.col("update_count_sum") / F.when(base == 0, 1.0).otherwise(base))


def monthly_aggregate(facts: DataFrame, calendar: bool = False) -> DataFrame:
    """The region-by-month table all later steps read."""
    return with_measures(by_state_month(facts), calendar)


def with_measures(agg: DataFrame, calendar: bool = False) -> DataFrame:
    """Growth, z-score and update ratio of region-by-month sums."""
    sums = [c for c in agg.columns if c.endswith("_sum") and c not in {f"{a}_sum" for a in AGE_COLUMNS}]
    if sums:
        agg = add_zscore(add_growth(agg, sums[0], calendar), sums[0])
    if len(sums) >= 2:
        agg = add_update_ratio(agg)
    return agg


def state_stats(facts: DataFrame) -> DataFrame:
    c = F.col("enrolment_count")
    return (
        facts.where(F.col("state").isNotNull())
        .groupBy("state")
        .agg(
            F.count(c).alias("record_count"),
            F.coalesce(F.sum(c), F.lit(0.0)).alias("total_enrolments"),
            F.avg(c).alias("avg_enrolments"),
            F.stddev_samp(c).alias("std_enrolments"),
        )
    )


def category_frequency(facts: DataFrame, column: str) -> DataFrame:
    """Rows per value, their share of all rows, and the number of distinct values.

    The counted values are written, so that the totals need no second pass over the rows.
    """
    counts = written(facts.groupBy(column).agg(F.count(F.lit(1)).alias("n_records")))
    totals = one_value(counts.agg(F.sum("n_records").alias("rows"), F.count(column).alias("distinct")))
    return (
        counts.where(F.col(column).isNotNull())
        .withColumn("_t", totals)
        .select(
            F.col(column).alias("value"),
            "n_records",
            (F.col("n_records") / F.col("_t.rows")).alias("frequency"),
            F.col("_t.distinct").alias("n_distinct"),
        )
    )


def state_totals(facts: DataFrame, value: str = "enrolment_count") -> DataFrame:
    return (
        facts.where(F.col("state").isNotNull())
        .groupBy("state")
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    )


def demographics(facts: DataFrame, age_cols: Sequence[str] = AGE_COLUMNS) -> DataFrame:
    """``(feature, value)``: total and percentage per age column, ratio of neighbouring columns."""
    cols = [c for c in age_cols if c in facts.columns]
    has_count = "enrolment_count" in facts.columns
    sums = facts.agg(
        *[_total(c).alias(c) for c in cols],
        *([_total("enrolment_count").alias("_all")] if has_count else []),
    )
    rows = []
    for c in cols:
        shown = F.col(c) > 0
        rows.append(F.when(shown, F.struct(F.lit(f"{c}_total").alias("feature"), F.col(c).alias("value"))))
        share = F.try_divide(F.col(c), F.col("_all")) * 100 if has_count else F.lit(None).cast("double")
        rows.append(F.when(shown, F.struct(F.lit(f"{c}_percentage").alias("feature"), share.alias("value"))))
    for a, b in zip(cols, cols[1:]):
        rows.append(
            F.struct(F.lit(f"{a}_to_{b}_ratio").alias("feature"), ratio_or_zero(F.col(a), F.col(b)).alias("value"))
        )
    return sums.select(F.inline(F.array_compact(F.array(*rows))))


def date_state_cells(facts: DataFrame, date: str | None = "date") -> DataFrame:
    """Long form of the date by region matrix: one row per cell that has data."""
    keys = [F.col(date).alias("date")] if date else [F.lit(None).cast("date").alias("date")]
    return (
        facts.where(F.col("state").isNotNull() & (F.col(date).isNotNull() if date else F.lit(True)))
        .groupBy(*keys, "state")
        .agg(F.coalesce(F.sum("enrolment_count"), F.lit(0.0)).alias("total"))
    )


def date_state_matrix(facts: DataFrame, states: Sequence[str]) -> DataFrame:
    """Wide form for a given, short list of regions; cells without data are zero."""
    return (
        date_state_cells(facts).groupBy("date").pivot("state", list(states)).agg(F.sum("total")).na.fill(0.0)
    )


def state_codes(agg: DataFrame) -> DataFrame:
    """``(state, state_code)``: alphabetical position of each region, from 0."""
    return with_global_index(agg.select("state").distinct(), ["state"], "state_code")


def add_lags(agg: DataFrame, value: str, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    ordered = by_state().orderBy("year_month")
    return agg.withColumns({f"lag_{k}": F.lag(value, k).over(ordered) for k in lags})


def ml_frame(agg: DataFrame, min_rows: int = 0, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Complete rows with date, lags, month and region code; with ``min_rows``, empty below so many aggregate rows.

    ``agg`` is read three times (size, codes, rows): pass it persisted or from a table.
    """
    sums = [c for c in agg.columns if "_sum" in c]
    if min_rows:
        agg = agg.where(one_value(agg.agg((F.count(F.lit(1)) >= min_rows).alias("ok")))["ok"])
    ages = [f"{a}_sum" for a in AGE_COLUMNS if f"{a}_sum" in agg.columns]
    numbers = [c for c in numeric_columns(agg) if c not in ("year", "month", "quarter") and c not in ages]
    df = agg.withColumn("date", month_start(F.col("year_month")))
    new = []
    if sums:
        df = add_lags(df, sums[0], lags)
        new += [f"lag_{k}" for k in lags]
    df = df.withColumn("month", F.month("date")).join(state_codes(agg), "state")
    kept = ["state", "year_month", "date", *numbers, *new, "month", "state_code"]
    return df.select(*kept, *ages).na.drop(subset=kept)
