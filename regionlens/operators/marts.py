"""Tables behind the dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.config import MAP_CENTRE, REGION_ALIASES, REGION_COORDINATES
from regionlens.functions.expr import one_value
from regionlens.functions.materialize import written
from regionlens.operators.anomalies import flagged


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join of a lookup table; rows without a match get ``defaults``.

    No hint: the optimizer broadcasts ``dim`` when its size allows.
    """
    joined = df.join(dim, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def filter_states(df: DataFrame, states: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the given regions; a long selection comes as a table with a ``state`` column."""
    if isinstance(states, DataFrame):
        return df.join(states.select("state"), "state", "left_semi")
    return df.where(F.col("state").isin(list(states)))


def top_k(df: DataFrame, by: str, k: int, tie: Sequence[str] = ("state",)) -> DataFrame:
    return df.orderBy(F.desc(by), *tie).limit(k)


def leaderboard(df: DataFrame, metric: str, k: int, how: str = "sum") -> DataFrame:
    """Best ``k`` regions by the sum or mean of a metric."""
    agg = {"sum": F.sum, "mean": F.avg}[how]
    return top_k(df.groupBy("state").agg(agg(metric).alias(metric)), metric, k)


def extreme(df: DataFrame, key: str, value: str, largest: bool = True) -> DataFrame:
    """One row: the group with the extreme value, first by key on ties."""
    order = -F.col(value) if largest else F.col(value)
    return df.agg(F.min(F.struct(order.alias("o"), F.col(key), F.col(value))).alias("e")).select(
        f"e.{key}", f"e.{value}"
    )


def distinct_states(df: DataFrame) -> DataFrame:
    return df.where(F.col("state").isNotNull()).select("state").distinct()


def kpi_row(df: DataFrame) -> DataFrame:
    """Totals in millions, mean coverage in percent, flagged rows and regions."""
    has = set(df.columns)
    first = lambda *names: next((n for n in names if n in has), None)
    millions = {
        "total_enrolments_m": first("enrolments", "enrolments_sum", "enrolment_count_sum"),
        "total_success_m": first("successful_enrolments"),
        "total_updates_m": first("updates", "updates_sum", "update_count_sum"),
    }
    aggs = [(F.sum(c) / 1_000_000).alias(n) for n, c in millions.items() if c]
    if "population_coverage" in has:
        aggs.append((F.avg("population_coverage") * 100).alias("coverage_pct"))
    if "is_anomaly" in has:
        aggs.append(F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("anomaly_count"))
    return df.agg(*aggs, F.count_distinct("state").alias("active_states"))


def trend(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return df.groupBy("date").agg(*[F.sum(m).alias(m) for m in metrics])


def success_rate(df: DataFrame) -> DataFrame:
    rate = F.try_divide(F.sum("successful_enrolments"), F.sum("enrolments")) * 100
    return df.agg(rate.alias("success_rate_pct"))


def coordinates(spark) -> DataFrame:
    """Positions under the names of the table and those that cleaning gives the same regions."""
    renamed = [(REGION_ALIASES[s.upper()], lat, lon) for s, lat, lon in REGION_COORDINATES if s.upper() in REGION_ALIASES]
    return spark.createDataFrame([*REGION_COORDINATES, *renamed], "state string, lat double, lon double")


def geo_mart(df: DataFrame, coords: DataFrame | None = None) -> DataFrame:
    """Totals and means per region with its position and a size relative to the largest region."""
    coords = coords if coords is not None else coordinates(df.sparkSession)
    per_state = written(
        df.groupBy("state").agg(
            F.sum("enrolments").alias("enrolments"),
            F.avg("success_rate").alias("success_rate"),
            F.avg("population_coverage").alias("population_coverage"),
        )
    )
    largest = one_value(per_state.agg(F.max("enrolments").alias("m")))["m"]
    sized = per_state.withColumn("size", F.try_divide(F.col("enrolments"), largest) * 100)
    return lookup(sized, coords, ["state"], {"lat": MAP_CENTRE[0], "lon": MAP_CENTRE[1]})


def state_series(df: DataFrame, states: Sequence[str], value: str = "enrolment_count_sum") -> DataFrame:
    return filter_states(df, states).select("state", "date", value)


def percent_text(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def anomaly_table(df: DataFrame) -> DataFrame:
    """Flagged rows with percentages as text, largest count first."""
    return (
        flagged(df)
        .select(
            "state",
            "year_month",
            "enrolments",
            percent_text(F.col("success_rate")).alias("success_rate"),
            percent_text(F.col("anomaly_score")).alias("anomaly_score"),
        )
        .orderBy(F.desc("enrolments"), "state", "year_month")
    )


def filter_facts(
    df: DataFrame,
    date_range: tuple[str, str] | None = None,
    states: Sequence[str] | None = None,
    risk_level: str = "All",
    risk: DataFrame | None = None,
) -> DataFrame:
    """Rows inside the date range (both days), of the regions, and of regions at the risk level.

    The bounds are literals of the column's own type, so they reach the scan.
    """
    if date_range:
        kind = df.schema["date"].dataType
        first, after = F.lit(date_range[0]).cast("date"), F.date_add(F.lit(date_range[1]).cast("date"), 1)
        df = df.where((F.col("date") >= first.cast(kind)) & (F.col("date") < after.cast(kind)))
    if states:
        df = filter_states(df, states)
    if risk_level != "All":
        if "risk_level" in df.columns:
            return df.where(F.col("risk_level") == risk_level)
        df = filter_states(df, risk.where(F.col("risk_level") == risk_level))
    return df
