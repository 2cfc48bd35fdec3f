"""Cleaning of daily facts: imputation, date bounds, names, ranges, repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.config import AGE_COLUMNS, CATEGORY_COLUMNS, DEDUP_KEYS, CleanCfg
from regionlens.functions.expr import (
    district_name,
    numeric_columns,
    one_value,
    parse_timestamp,
    pincode,
    region_name,
)
from regionlens.functions.quantile import bracket_aggregates, modes, quantiles, settle
from regionlens.operators.columns import standardize_columns


def drop_null_dates(df: DataFrame) -> DataFrame:
    return df.where(F.col("date").isNotNull()) if "date" in df.columns else df


def _gaps(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Per column, whether it holds a NULL (or NaN)."""
    gone = lambda c: F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False))
    numbers = set(numeric_columns(df))
    return [F.bool_or(gone(c) if c in numbers else F.col(c).isNull()).alias(f"_gap{i}") for i, c in enumerate(columns)]


def _with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that hold a NULL (or NaN); one aggregate."""
    if not columns:
        return []
    row = df.agg(*_gaps(df, columns)).first()
    return [c for i, c in enumerate(columns) if row[f"_gap{i}"]]


def _filled(df: DataFrame, medians: dict, modes: dict, texts: Sequence[str]) -> DataFrame:
    """Fill NULLs only; a column keeps its type where the filling fits it, else it becomes DOUBLE."""
    both = {}
    for c, (m, *_) in medians.items():
        if m is None:
            continue
        kind = df.schema[c].dataType
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            both[c] = F.coalesce(F.nanvl(F.col(c), F.lit(None).cast(kind)), F.lit(m).cast(kind))
        elif m == int(m):
            both[c] = F.coalesce(F.col(c), F.lit(int(m)).cast(kind))
        else:
            both[c] = F.coalesce(F.col(c).cast("double"), F.lit(m))
    both |= {c: F.coalesce(F.col(c).cast("string"), F.lit(modes.get(c, "Unknown"))) for c in texts}
    return df.withColumns(both) if both else df


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, cfg: CleanCfg = CleanCfg()) -> DataFrame:
    """Fill every numeric column that holds NULLs with its interpolated median."""
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=[cfg.order_by])
    cols = _with_nulls(df, cols)
    return _filled(df, quantiles(df, cols, [0.5], cfg.accuracy), {}, ()) if cols else df


def impute_mode(df: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS) -> DataFrame:
    """Fill each text column with its most frequent value, else ``Unknown``."""
    cols = _with_nulls(df, [c for c in columns if c in df.columns])
    return _filled(df, {}, modes(df, cols), cols) if cols else df


def impute(df: DataFrame, cfg: CleanCfg = CleanCfg()) -> DataFrame:
    """Medians and modes of the columns that hold NULLs, filled in one projection.

    One aggregate finds these columns and brackets the medians, one scan settles medians and modes.  A numeric
    pincode counts as a number, as every other numeric column.
    """
    numbers = numeric_columns(df, exclude=[cfg.order_by])
    texts = [c for c in CATEGORY_COLUMNS if c in df.columns and c not in numbers]
    every = [*numbers, *texts]
    if not every:
        return df
    brackets = [] if cfg.accuracy else bracket_aggregates(df, numbers, [0.5])
    row = df.agg(*_gaps(df, every), *brackets).first().asDict()
    gaps = [c for i, c in enumerate(every) if row[f"_gap{i}"]]
    texts = [c for c in texts if c in gaps]
    place = [i for i, c in enumerate(numbers) if c in gaps]
    numbers = [numbers[i] for i in place]
    if cfg.accuracy:
        return _filled(df, quantiles(df, numbers, [0.5], cfg.accuracy) if numbers else {}, modes(df, texts), texts)
    row = {f"_{k}{i}": row[f"_{k}{j}"] for i, j in enumerate(place) for k in "nq"}
    medians, most = settle(df, numbers, [0.5], row, texts)
    return _filled(df, medians, most, texts)


def null_share(df: DataFrame, skip: Sequence[str]) -> Column:
    cols = [c for c in df.columns if c not in skip]
    return sum((F.col(f"`{c}`").isNull().cast("int") for c in cols), F.lit(0)) / len(cols)


def drop_sparse(df: DataFrame, cfg: CleanCfg = CleanCfg()) -> DataFrame:
    """Keep rows with fewer than ``cfg.null_share`` of their values missing."""
    return df.where(null_share(df, ("source_file", cfg.order_by)) < cfg.null_share)


def in_date_bounds(date: Column, cfg: CleanCfg) -> Column:
    newest = F.lit(cfg.as_of).cast("timestamp_ntz") if cfg.as_of else F.localtimestamp()
    return F.coalesce(date.between(F.lit(cfg.min_date).cast("timestamp_ntz"), newest), F.lit(False))


def bound_dates(df: DataFrame, cfg: CleanCfg = CleanCfg()) -> DataFrame:
    """Parse ``date``; drop rows that do not parse or lie outside the bounds."""
    if "date" not in df.columns:
        return df
    return df.withColumn("date", parse_timestamp(df, "date", cfg.date_formats)).where(
        in_date_bounds(F.col("date"), cfg)
    )


def normalize_state(df: DataFrame) -> DataFrame:
    return df.withColumn("state", region_name(F.col("state"))) if "state" in df.columns else df


def normalize_district(df: DataFrame) -> DataFrame:
    return df.withColumn("district", district_name(F.col("district"))) if "district" in df.columns else df


def normalize_pincode(df: DataFrame) -> DataFrame:
    return df.withColumn("pincode", pincode(F.col("pincode"))) if "pincode" in df.columns else df


def _range_rules(df: DataFrame, cfg: CleanCfg) -> tuple[dict[str, Column], list[tuple[str, Column]]]:
    """Replacement columns and the conditions a row must meet, in order, on the raw columns."""
    has = set(df.columns)
    replaced: dict[str, Column] = {}
    rules: list[tuple[str, Column]] = []
    enrol = None
    if "enrolment_count" in has:
        raw = F.col("enrolment_count")
        enrol = F.when(raw.isNotNull(), F.least(raw, F.lit(cfg.cap)))
        rules.append(("negative_enrolment", raw >= 0))
        replaced["enrolment_count"] = enrol
    if "update_count" in has:
        updates = F.col("update_count")
        rules.append(("negative_update", updates >= 0))
        if enrol is not None:
            rules.append(("excess_update", updates <= enrol * cfg.ratio))
    ages = [c for c in AGE_COLUMNS if c in has]
    for c in ages:
        replaced[c] = F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))
    if ages and enrol is not None:
        total = sum((F.coalesce(replaced[c], F.lit(0.0)) for c in ages), F.lit(0.0))
        rules.append(("excess_age_sum", total <= enrol * cfg.tol))
    return replaced, rules


def validate_ranges(df: DataFrame, cfg: CleanCfg = CleanCfg()) -> DataFrame:
    """Drop impossible counts, cap the daily count, floor age counts at zero; NULL fails a rule."""
    replaced, rules = _range_rules(df, cfg)
    for _, keep in rules:
        df = df.where(keep)
    return df.withColumns(replaced) if replaced else df


def drop_repeats(df: DataFrame, cfg: CleanCfg = CleanCfg(), keys: Sequence[str] = DEDUP_KEYS) -> DataFrame:
    """Keep the first row of each key in the order of ``cfg.order_by``; NULL keys are equal.

    A table without that column has no first row, which is an error; the readers add it on request.  The ``= 1`` filter lets Spark keep one row per key in every map task
    (WindowGroupLimit) before the shuffle, so a key with a third of all rows
    sends one row per task.
    """
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    if cfg.order_by not in df.columns:
        raise ValueError(f"no column {cfg.order_by} tells which of repeated rows comes first; read with order={cfg.order_by!r}")
    first = W.partitionBy(*keys).orderBy(cfg.order_by)
    return df.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1).drop("_rank")


def clean(df: DataFrame, cfg: CleanCfg = CleanCfg()) -> DataFrame:
    """The whole chain in its fixed order."""
    df = standardize_columns(df)
    df = drop_null_dates(df)
    df = impute(df, cfg)
    df = drop_sparse(df, cfg)
    df = bound_dates(df, cfg)
    df = normalize_pincode(normalize_district(normalize_state(df)))
    df = validate_ranges(df, cfg)
    return drop_repeats(df, cfg)


def cleaning_audit(df: DataFrame, cfg: CleanCfg = CleanCfg()) -> DataFrame:
    """``(step, rows_removed)`` for every step of :func:`clean`.

    Each row is labelled with the first step that removes it, so all
    row-level steps are counted in one pass; repeats are counted by key.
    """
    df = standardize_columns(df)
    dated = drop_null_dates(df)
    filled = impute(dated, cfg)
    lost = F.when(null_share(filled, ("source_file", cfg.order_by)) >= cfg.null_share, "sparse")
    steps = ["sparse"]
    work = filled.withColumn("_sparse", lost)
    if "date" in filled.columns:
        work = work.withColumn("date", parse_timestamp(filled, "date", cfg.date_formats))
        lost = F.coalesce(F.col("_sparse"), F.when(~in_date_bounds(F.col("date"), cfg), "invalid_date"))
        steps.append("invalid_date")
    else:
        lost = F.col("_sparse")
    _, rules = _range_rules(filled, cfg)
    for name, keep in rules:
        lost = F.coalesce(lost, F.when(~F.coalesce(keep, F.lit(False)), name))
        steps.append(name)
    labelled = normalize_district(normalize_state(work.withColumn("_step", lost)))
    keys = [k for k in DEDUP_KEYS if k in filled.columns]
    # One pass: rows per (step, key); a surviving key with n rows loses n - 1.
    groups = labelled.groupBy("_step", *[F.when(F.col("_step").isNull(), F.col(k)).alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = groups.agg(
        *[F.coalesce(F.sum(F.when(F.col("_step") == s, F.col("n"))), F.lit(0)).alias(s) for s in steps],
        F.coalesce(F.sum(F.when(F.col("_step").isNull(), F.col("n") - 1)), F.lit(0)).alias("repeated"),
    )
    null_dates = df.agg(F.count_if(F.col("date").isNull()).alias("null_date")) if "date" in df.columns else None
    if null_dates is not None:
        counts = counts.withColumn("null_date", one_value(null_dates)["null_date"])
        steps.insert(0, "null_date")
    steps.append("repeated")
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("rows_removed")) for s in steps]))
    )
