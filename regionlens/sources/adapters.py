"""Canonical facts derived from the star-schema tables.

The adapters give the operators realistic input: one row per order
(``trade_fact``), one per event (``event_fact``), and an order table with
planted defects (``dirty_fact``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order.

    Line items are summed per order before they meet the orders, so the wide
    side of that join is already reduced and already partitioned by its key.
    No side is hinted: sizes are left to the optimizer and to AQE, which also
    splits a skewed part or customer key.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    size, qty = F.col("p_size"), F.col("l_quantity")
    in_band = lambda cond: F.sum(F.when(cond, qty).otherwise(F.lit(0.0)))
    sums = (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(
            F.sum(qty).alias("enrolment_count"),
            in_band(F.col("l_returnflag") == "R").alias("update_count"),
            in_band(size <= 12).alias("age_0_18"),
            in_band(size.between(13, 25)).alias("age_19_40"),
            in_band(size.between(26, 38)).alias("age_41_60"),
            in_band(size > 38).alias("age_60_plus"),
        )
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_orderkey").alias("seq"),
            F.to_date("o_orderdate").alias("date"),
            F.col("n_name").alias("state"),
            F.col("c_mktsegment").alias("district"),
            "enrolment_count",
            "update_count",
            "age_0_18",
            "age_19_40",
            "age_41_60",
            "age_60_plus",
        )
    )


def event_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("date"),
        F.col("event_type").alias("state"),
        (F.col("user_id") % 10).cast("string").alias("district"),
        F.col("value").alias("enrolment_count"),
        F.lit(0.0).alias("update_count"),
    )


def dash_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order facts with the columns the dashboards read."""
    fact = trade_fact(spark, sf_dir)
    count, updates = F.col("enrolment_count"), F.col("update_count")
    return fact.select(
        "seq",
        "date",
        "state",
        F.date_format("date", "yyyy-MM").alias("year_month"),
        count.alias("enrolments"),
        (count - updates).alias("successful_enrolments"),
        updates.alias("updates"),
        ((count - updates) / count).alias("success_rate"),
        (F.col("age_0_18") / count).alias("population_coverage"),
        F.when(updates > count * 0.9, 1).otherwise(0).alias("is_anomaly"),
        (updates / count).alias("anomaly_score"),
    )


def dirty_fact(spark: SparkSession, sf_dir: str, shift_years: int = 0) -> DataFrame:
    """Order facts with deterministic defects; ``date`` is text."""
    fact = trade_fact(spark, sf_dir)
    k = F.col("seq")
    moved = F.add_months("date", 12 * shift_years)
    enrol = F.col("enrolment_count")
    state, district = F.col("state"), F.col("district")
    bad = fact.select(
        k.alias("seq"),
        F.when(k % 97 == 0, None)
        .when(k % 89 == 1, "not-a-date")
        .when(k % 83 == 2, F.col("date").cast("string"))
        .otherwise(moved.cast("string"))
        .alias("date"),
        F.when(k % 61 == 4, None)
        .when(k % 7 == 0, F.lower(state))
        .when(k % 7 == 1, F.upper(state))
        .otherwise(state)
        .alias("state"),
        F.when(k % 59 == 5, None)
        .when(k % 11 == 0, F.concat(district, F.lit("-2")))
        .otherwise(district)
        .alias("district"),
        F.when(k % 13 == 0, "12")
        .otherwise(F.concat(F.lit("PIN "), (100000 + k % 900000).cast("string"), F.lit(".0")))
        .alias("pincode"),
        F.when(k % 53 == 3, None).when(k % 71 == 6, F.lit(-1.0)).otherwise(enrol).alias("enrolment_count"),
        F.when(k % 73 == 7, enrol * 6).otherwise(F.col("update_count")).alias("update_count"),
        "age_0_18",
        "age_19_40",
        "age_41_60",
        "age_60_plus",
    )
    # Repeats come from the same pass over the joins: emit such a row twice.
    times = F.when(k % 41 == 8, F.array(F.lit(0), F.lit(1_000_000_000))).otherwise(F.array(F.lit(0)))
    return bad.withColumn("_add", F.explode(times)).withColumn("seq", k + F.col("_add")).drop("_add")


def stand_in_scores(agg: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Anomaly columns computed from ``z_score`` alone, for runs that need no fitted model."""
    size = F.abs("z_score")
    return agg.withColumn("is_anomaly", F.when(size > threshold, 1).otherwise(0)).withColumn(
        "anomaly_score", F.least(size / 4, F.lit(1.0))
    )
