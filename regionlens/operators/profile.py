"""Profiles, data quality, and distribution statistics of any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regionlens.functions.expr import numeric_columns, one_value, string_columns
from regionlens.functions.gram import SUMS, cross_sums, origins
from regionlens.functions.quantile import bracket_aggregates, number, quantiles, settle
from regionlens.operators.calendar import rolling_mean

COUNT_NAME_WORDS = ("count", "total", "sum", "number", "enrol")
PERCENTS = (25, 50, 75, 90, 95)


def primary_count(df: DataFrame) -> str | None:
    """The first numeric column whose name says it counts something."""
    return next((c for c in numeric_columns(df) if any(w in c.lower() for w in COUNT_NAME_WORDS)), None)


def column_samples(df: DataFrame, order_by: str, n: int = 3) -> DataFrame:
    """First ``n`` values present in each text column, all columns in one pass.

    The rank filter prunes to ``n`` rows per column in each map task.
    """
    cols = string_columns(df)
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols]))
    ranked = (
        df.select(F.col(order_by).alias("_o"), cell.alias("cell"))
        .select("_o", "cell.*")
        .where(F.col("value").isNotNull())
        .withColumn("_rank", F.row_number().over(W.partitionBy("column").orderBy("_o", "value")))
        .where(F.col("_rank") <= n)
    )
    return ranked.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda e: e["value"]).alias(
            "sample_values"
        )
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """``column, unique_values``: exact numbers of different values, all columns in one pass.

    Every cell becomes a (column, value) pair and equal pairs meet in the map-side partial aggregate, so what is
    shuffled is one short row per different value and task, never a row that carries all columns.
    """
    kinds = dict(df.dtypes)
    # Adding 0.0 turns -0.0 into 0.0; texts of numbers are as different as the numbers.
    text = lambda c: (F.col(f"`{c}`") + 0.0 if kinds[c] in ("double", "float") else F.col(f"`{c}`")).cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), text(c).alias("v")) for i, c in enumerate(df.columns)])
    names = F.array(*[F.lit(c) for c in df.columns])
    pairs = df.select(F.explode(cells).alias("x")).select("x.i", "x.v").where(F.col("v").isNotNull()).distinct()
    return pairs.groupBy("i").agg(F.count(F.lit(1)).alias("unique_values")).select(F.element_at(names, F.col("i") + 1).alias("column"), "unique_values")


def column_profile(df: DataFrame, order_by: str | None = None, rsd: float | None = None) -> DataFrame:
    """One row per column: type, missing values, distinct values, samples of text columns.

    ``rsd`` replaces the exact distinct counts by mergeable sketches; ``states.profile_states`` keeps such sketches by month.
    """
    kinds = dict(df.dtypes)
    sketches = [F.approx_count_distinct(F.col(f"`{c}`"), rsd).alias(f"d{i}") for i, c in enumerate(df.columns)] if rsd else []
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"p{i}") for i, c in enumerate(df.columns)],
        *sketches,
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kinds[c]).alias("dtype"),
            (F.col("_rows") - F.col(f"p{i}")).alias("missing_count"),
            (F.try_divide(F.col("_rows") - F.col(f"p{i}"), F.col("_rows")) * 100).alias("missing_percentage"),
            *([F.col(f"d{i}").alias("unique_values")] if rsd else []),
        )
        for i, c in enumerate(df.columns)
    ]
    profile = wide.select(F.inline(F.array(*rows)))
    if not rsd:
        profile = profile.join(distinct_counts(df), "column", "left").withColumn("unique_values", F.coalesce("unique_values", F.lit(0).cast("long")))
    if order_by is None or not string_columns(df):
        return profile.withColumn("sample_values", F.lit(None).cast("array<string>"))
    return profile.join(column_samples(df, order_by), "column", "left")


def file_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, date range and number of regions."""
    has = set(df.columns)
    none = F.lit(None).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.lit(len(df.columns)).alias("total_columns"),
        (F.to_date(F.min("date")) if "date" in has else none).alias("min_date"),
        (F.to_date(F.max("date")) if "date" in has else none).alias("max_date"),
        (F.count_distinct("state") if "state" in has else F.lit(0).cast("long")).alias("states_count"),
    )


def quality_report(profile: DataFrame, has_date: bool = True) -> DataFrame:
    """Issues, score and recommendations from a column profile (one row per column)."""
    bad = F.col("missing_percentage") > 50
    text = F.concat(
        F.lit("Column '"), F.col("column"), F.lit("' has "),
        F.format_string("%.1f", "missing_percentage"), F.lit("% missing values"),
    )
    tips = [F.when(F.size("issues") > 0, "Consider data imputation for columns with high missing values")]
    if not has_date:
        tips.append(F.lit("No date column found. Temporal analysis will be limited"))
    return (
        profile.agg(F.array_sort(F.collect_list(F.when(bad, text))).alias("issues"))
        .withColumn("issue_count", F.size("issues"))
        .withColumn("score", 100 - F.col("issue_count") * 10)
        .withColumn("recommendations", F.array_compact(F.array(*tips)))
    )


def kpis(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric columns and missing cells."""
    missing = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        sum(missing[1:], missing[0]).alias("total_missing"),
    )


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


MOMENTS = {
    "n": F.count,
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "skewness": F.skewness,
    "kurtosis": F.kurtosis,
}


def numeric_stats(df: DataFrame, cols: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """One row per numeric column with moments and percentiles; a column without values is left out.

    The first scan takes the moments and the sketches of all columns, the second settles the percentiles.
    """
    cols = list(cols) if cols else numeric_columns(df)
    probs = [p / 100 for p in PERCENTS]
    moments = [f(number(df, c)).cast("long" if m == "n" else "double").alias(f"_{m}_{i}") for i, c in enumerate(cols) for m, f in MOMENTS.items()]
    if not cols:
        row, ranks = {}, {}
    elif accuracy:
        row, ranks = df.agg(*moments).first().asDict(), quantiles(df, cols, probs, accuracy)
    else:
        row = df.agg(*moments, *bracket_aggregates(df, cols, probs)).first().asDict()
        ranks = settle(df, cols, probs, row)[0]
    found = [
        (c, *[row[f"_{m}_{i}"] for m in MOMENTS], ranks[c][1], *ranks[c]) for i, c in enumerate(cols) if row[f"_n_{i}"]
    ]
    fields = ["column string", "n long", *[f"{m} double" for m in [*MOMENTS][1:]], "median double", *[f"percentile_{p} double" for p in PERCENTS]]
    return df.sparkSession.createDataFrame(found, ", ".join(fields))


FLAT = 1e-13  # share of a sum of squares below which a variance is rounding


def pairwise_pearson(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Correlation of each pair of columns over the rows that have both; NULL when one is constant there.

    One scan takes the smallest values, a second one all cross-products; nothing grows with the number of pairs
    but the result.
    """
    cols = list(cols) if cols else numeric_columns(df)
    schema = "column1 string, column2 string, correlation double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    names = F.array(*[F.lit(c) for c in cols])
    pair = F.explode(F.slice(F.arrays_zip(F.sequence(F.lit(1), F.lit(len(cols))).alias("j"), *SUMS), F.col("i") + 2, len(cols)))
    v = lambda own: F.col("p.n") * F.col(f"p.{own}2") - F.col(f"p.{own}") * F.col(f"p.{own}")
    spread = lambda own: F.when(v(own) > F.col("p.n") * F.col(f"p.{own}2") * FLAT, v(own))
    product = F.col("p.n") * F.col("p.both") - F.col("p.own") * F.col("p.other")
    return (
        cross_sums(df, cols, origins(df, cols))
        .where(F.col("i") < len(cols) - 1)
        .select("i", pair.alias("p"))
        .select(
            F.element_at(names, F.col("i") + 1).alias("column1"),
            F.element_at(names, F.col("p.j")).alias("column2"),
            (product / (F.sqrt(spread("own")) * F.sqrt(spread("other")))).alias("correlation"),
        )
    )


def _moments(df: DataFrame, value: str) -> Column:
    return one_value(df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")))


def z_scores(df: DataFrame, col: str) -> DataFrame:
    """Rows with a value and its distance from the mean in standard deviations; none when constant."""
    return (
        df.where(F.col(col).isNotNull())
        .withColumn("_m", _moments(df, col))
        .where(F.col("_m.sd") > 0)
        .withColumn("z", (F.col(col) - F.col("_m.mean")) / F.col("_m.sd"))
        .drop("_m")
    )


def z_outliers(df: DataFrame, col: str | None = None) -> DataFrame:
    """Rows beyond 2 and 3 standard deviations; no row when the table has no count column or no spread."""
    col = col or primary_count(df)
    if col is None:
        return df.sparkSession.createDataFrame(
            [], "outlier_count long, outlier_percentage double, extreme_outlier_count long"
        )
    far = F.count_if(F.abs("z") > 2)
    return (
        z_scores(df, col)
        .agg(
            F.count(F.lit(1)).alias("n"),
            far.alias("outlier_count"),
            F.count_if(F.abs("z") > 3).alias("extreme_outlier_count"),
        )
        .where(F.col("n") > 0)
        .select(
            "outlier_count",
            (F.col("outlier_count") / F.col("n") * 100).alias("outlier_percentage"),
            "extreme_outlier_count",
        )
    )


def iqr_outliers(df: DataFrame, col: str, accuracy: int | None = None) -> DataFrame:
    """Rows outside the quartiles by more than 1.5 times their distance."""
    q1, q3 = (F.lit(q).cast("double") for q in quantiles(df, [col], [0.25, 0.75], accuracy)[col])
    step = (q3 - q1) * 1.5
    return df.agg(
        F.max(q1 - step).alias("lower_bound"),
        F.max(q3 + step).alias("upper_bound"),
        F.count_if((F.col(col) < q1 - step) | (F.col(col) > q3 + step)).alias("iqr_outlier_count"),
    )


def temporal_outliers(
    df: DataFrame, value: str, order_by: Sequence[str] = ("date", "seq"), width: int = 7
) -> DataFrame:
    """Rows whose residual to the trailing mean is beyond 2 standard deviations of the residuals."""
    residual = rolling_mean(df.select(value, *order_by), value, order_by, width).select(
        (F.col(value) - F.col("rolling_mean")).alias("residual")
    )
    return z_scores(residual, "residual").agg(F.count_if(F.abs("z") > 2).alias("temporal_outlier_count"))
