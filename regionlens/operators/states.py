"""Monthly states that can be merged: what new rows add is stored beside what is there, and tables are rebuilt from it.

A state is one row per region, month and batch: counts, sums and squared deviations.  Batches of a month
are added up when they are read, so a batch that is written again replaces itself and a failed run can simply be
repeated.  Only the months that the new rows touch are rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.config import AGE_COLUMNS
from regionlens.functions.expr import year_month
from regionlens.functions.materialize import written
from regionlens.operators.aggregate import COUNT_CHOICES, UPDATE_CHOICES, first_present, with_measures

PARTS = ("enrolment_count", "update_count", *AGE_COLUMNS)


def monthly_states(facts: DataFrame, batch: str) -> DataFrame:
    """``batch, state, year_month``, and the number, sum and squared deviation of the count and the sums of the other columns."""
    source = {c: c for c in AGE_COLUMNS if c in facts.columns}
    source |= {c: n for c, names in (("enrolment_count", COUNT_CHOICES), ("update_count", UPDATE_CHOICES)) if (n := first_present(facts, names))}
    value = lambda c: F.col(source[c]).cast("double") if c in source else F.lit(None).cast("double")
    count = value("enrolment_count")
    return (
        facts.where(F.col("state").isNotNull() & F.col("date").isNotNull())
        .groupBy("state", year_month(F.col("date")).alias("year_month"))
        .agg(
            F.count(count).alias("n"),
            (F.var_pop(count) * F.count(count)).alias("m2"),
            *[(F.sum(value(c)) if c in source else F.lit(None).cast("double")).alias(f"{c}_sum") for c in PARTS],
        )
        .select(F.lit(batch).alias("batch"), "*")
    )


def merged(states: DataFrame) -> DataFrame:
    """One state per region and month from those of all batches.

    The deviations of two parts add up to more than their sum by what parts their means.
    """
    part = F.struct("n", (F.col("enrolment_count_sum") / F.col("n")).alias("mean"), "m2")
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def joined(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        off = b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + off * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + off * off * a["n"] * b["n"] / n).alias("m2")
        )

    parts = F.array_sort(F.collect_list(F.when(F.col("n") > 0, part)))
    total = F.aggregate(parts, none, joined)
    return (
        states.groupBy("state", "year_month")
        .agg(total.alias("t"), *[F.sum(f"{c}_sum").alias(f"{c}_sum") for c in PARTS])
        .select("state", "year_month", F.col("t.n").alias("n"), F.col("t.m2").alias("m2"), *[f"{c}_sum" for c in PARTS])
    )


def aggregate_of_states(states: DataFrame, calendar: bool = False) -> DataFrame:
    """The table of ``monthly_aggregate`` from states instead of facts; columns without any value are left out."""
    whole = merged(states)
    has = whole.agg(*[F.count(f"{c}_sum").alias(c) for c in PARTS]).first()
    n = F.col("n")
    total = lambda c: F.coalesce(F.col(f"{c}_sum"), F.lit(0.0)).alias(f"{c}_sum")
    agg = whole.select(
        "state",
        "year_month",
        total("enrolment_count"),
        F.when(n > 0, F.col("enrolment_count_sum") / n).alias("enrolment_count_mean"),
        F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("enrolment_count_std"),
        *[total(c) for c in PARTS[1:] if has[c]],
    )
    return with_measures(agg, calendar)


def load_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_states(facts: DataFrame, path: str, batch: str) -> list[str]:
    """Add a batch of facts to the states below ``path`` and return the months that were rewritten.

    States lie in one folder per month.  The months of the batch are read (no others), the rows of the same batch in them
    are replaced, and Spark's dynamic overwrite exchanges just these folders.  A batch keeps its name and its
    months when it is repeated.
    """
    spark = facts.sparkSession
    new = written(monthly_states(facts, batch))
    # As many as the batch has months.
    months = sorted(r[0] for r in new.select("year_month").distinct().collect())
    if not months:
        return []
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        kept = load_states(spark, path).where(F.col("year_month").isin(months) & (F.col("batch") != batch))
        # Written first, because their folders are about to be exchanged.
        new = new.unionByName(written(kept.withColumn("year_month", F.col("year_month").cast("string"))))
    writer = new.repartition("year_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year_month").parquet(path)
    return months


def profile_states(df: DataFrame, date: str = "date", lg_k: int = 12) -> DataFrame:
    """``year_month, column, dtype, rows, present, sketch``: per month and column what a profile needs, mergeable.

    ``sketch`` is a HyperLogLog state of ``2 ** lg_k`` cells (standard error about ``1.04 / sqrt(2 ** lg_k)``); equal
    values of one column give equal cells in every month.  Rows without a date are in a month NULL.
    """
    kinds = dict(df.dtypes)
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    text = lambda c: (F.col(f"`{c}`") + 0.0 if kinds[c] in ("double", "float") else F.col(f"`{c}`")).cast("string")
    wide = df.groupBy(year_month(F.col(date)).alias("year_month")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"{n}_present") for c, n in names.items()],
        *[F.hll_sketch_agg(text(c), lg_k).alias(f"{n}_sketch") for c, n in names.items()],
    )
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"{n}_present").alias("present"), F.col(f"{n}_sketch").alias("sketch"))
        for c, n in names.items()
    ]
    return wide.select("year_month", "rows", F.inline(F.array(*cells)))


def profile_of_states(states: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The column profile of the months from ``first`` to ``last``, from their states alone; distinct counts are estimates."""
    if first is not None:
        states = states.where(F.col("year_month") >= first)
    if last is not None:
        states = states.where(F.col("year_month") <= last)
    missing = F.sum("rows") - F.sum("present")
    return states.groupBy("column", "dtype").agg(
        missing.alias("missing_count"),
        (F.try_divide(missing, F.sum("rows")) * 100).alias("missing_percentage"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_values"),
    )
