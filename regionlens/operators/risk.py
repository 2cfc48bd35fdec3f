"""Risk of a region from volume, anomalies, volatility, completeness and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.config import (
    BLEND_CUTS,
    BLEND_ICONS,
    LOWEST_LEVEL,
    RISK_COLOURS,
    RISK_CUTS,
    RISK_FULL_SCALE,
    RISK_ICONS,
    RISK_WEIGHTS,
    RiskCfg,
)
from regionlens.functions.expr import clip01, level_of, month_start, ordered_names, pick, side_by_side


def scaled(raw: Column, component: str) -> Column:
    return clip01(F.coalesce(raw, F.lit(0.0)) / RISK_FULL_SCALE[component])


def consistency(months: Column, first: Column, last: Column) -> Column:
    """1 - share of the spanned months (of 30 days) that have data; 0 when all data is of one day."""
    span = F.datediff(last, first) / 30
    return F.when(span > 0, 1 - scaled(months / span, "consistency_risk")).otherwise(0.0)


def risk_components(scored: DataFrame) -> DataFrame:
    """One row per region with every component the columns allow, from 0 to 1, in one aggregation."""
    df = scored
    if "date" not in df.columns:
        df = df.withColumn("date", month_start(F.col("year_month")))
    has = set(df.columns)
    aggs = {}
    if "enrolment_count_sum" in has:
        aggs["volume_risk"] = F.sum("enrolment_count_sum")
    if "is_anomaly" in has:
        aggs["anomaly_frequency_risk"] = F.avg("is_anomaly")
        if "anomaly_score" in has:
            aggs["anomaly_severity_risk"] = F.avg(F.when(F.col("is_anomaly") == 1, F.col("anomaly_score")))
    if "mom_growth" in has:
        aggs["volatility_risk"] = F.stddev_samp("mom_growth")
    if "update_ratio" in has:
        aggs["update_pattern_risk"] = F.stddev_samp("update_ratio")
    base = (
        df.where(F.col("state").isNotNull())
        .groupBy("state")
        .agg(
            *[a.alias(c) for c, a in aggs.items()],
            F.count_distinct("year_month").alias("_months"),
            F.min("date").alias("_first"),
            F.max("date").alias("_last"),
        )
    )
    out = {c: scaled(F.col(c), c) for c in aggs}
    out["consistency_risk"] = consistency(F.col("_months"), F.col("_first"), F.col("_last"))
    return base.select("state", *[out[c].alias(c) for c in RISK_WEIGHTS if c in out])


def weighted_score(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``risk_score``: weighted mean of the components present."""
    unknown = set(weights or ()) - set(RISK_WEIGHTS)
    if unknown:
        raise ValueError(f"unknown risk components: {sorted(unknown)}")
    used = {c: w for c, w in {**RISK_WEIGHTS, **(weights or {})}.items() if c in df.columns}
    total = sum(used.values())
    score = sum((F.col(c) * w for c, w in used.items()), F.lit(0.0))
    return df.withColumn("risk_score", score / total if total > 0 else score)


def risk_level(df: DataFrame, cuts=RISK_CUTS) -> DataFrame:
    level = level_of(F.col("risk_score"), cuts, LOWEST_LEVEL)
    return df.withColumn("risk_level", level).withColumn(
        "risk_color", pick(F.col("risk_level"), RISK_COLOURS, RISK_COLOURS[LOWEST_LEVEL])
    )


def risk_scores(scored: DataFrame, cfg: RiskCfg = RiskCfg()) -> DataFrame:
    return risk_level(weighted_score(risk_components(scored), cfg.weights), cfg.cuts)


def by_risk(risk: DataFrame) -> DataFrame:
    """Highest score first; order at the sink only."""
    return risk.orderBy(F.desc("risk_score"), "state")


def level_names(risk: DataFrame, level: str, n: int) -> DataFrame:
    """One row: how many regions have the level, and the ``n`` with the highest scores as text."""
    hit = risk.where(F.col("risk_level") == level)
    top = hit.orderBy(F.desc("risk_score"), "state").limit(n)
    names = top.agg(
        ordered_names(F.collect_list(F.struct((-F.col("risk_score")).alias("o"), "state"))).alias("names")
    )
    return hit.agg(F.count(F.lit(1)).alias("n")).withColumn("names", F.when(F.col("n") > 0, names.scalar()))


def risk_report(risk: DataFrame) -> DataFrame:
    """One summary row."""
    top = F.min(F.struct((-F.col("risk_score")).alias("o"), "state"))
    return risk.agg(
        F.count(F.lit(1)).alias("total_states"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_states"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_states"),
        F.avg("risk_score").alias("average_risk_score"),
        top["state"].alias("highest_risk_state"),
        F.max("risk_score").alias("highest_risk_score"),
    )


def critical_states(risk: DataFrame) -> DataFrame:
    return risk.where(F.col("risk_level") == "CRITICAL").select("state", "risk_score")


def risk_recommendations(risk: DataFrame) -> DataFrame:
    """``(priority, action, description, timeline)`` rows that apply."""
    facts = side_by_side(
        risk.sparkSession,
        level_names(risk, "CRITICAL", 5),
        risk.agg(F.count_if(F.col("risk_level") == "HIGH").alias("high")),
    )
    row = lambda p, a, d, t: F.struct(
        F.lit(p).alias("priority"), F.lit(a).alias("action"), d.alias("description"), F.lit(t).alias("timeline")
    )
    n, high = F.col("n"), F.col("high")
    return facts.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(
                        n > 0,
                        row(
                            "HIGH",
                            "Immediate Investigation",
                            F.concat(F.lit("Critical risk detected in "), n.cast("string"), F.lit(" states: "), F.col("names")),
                            "48 hours",
                        ),
                    ),
                    F.when(
                        high > 0,
                        row(
                            "MEDIUM",
                            "Priority Review",
                            F.concat(F.lit("High risk detected in "), high.cast("string"), F.lit(" states")),
                            "1 week",
                        ),
                    ),
                    row(
                        "LOW",
                        "Continuous Monitoring",
                        F.lit("Regular monitoring of all states with monthly risk assessment"),
                        "Ongoing",
                    ),
                )
            )
        )
    )


def level_distribution(risk: DataFrame) -> DataFrame:
    return risk.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("state_count"), F.sum("risk_score").alias("score_sum")
    )


def blended_risk(df: DataFrame, cuts=BLEND_CUTS) -> DataFrame:
    """Overall risk from ``risk_score``, ``fraud_risk``, ``data_quality`` and ``operational_risk``."""
    overall = (
        F.col("risk_score") * 0.4
        + F.col("fraud_risk") * 0.3
        + (1 - F.col("data_quality")) * 0.2
        + F.col("operational_risk") * 0.1
    )
    return (
        df.withColumn("risk_score", overall)
        .withColumn("risk_level", level_of(F.col("risk_score"), cuts, LOWEST_LEVEL))
        .withColumn("icon", pick(F.col("risk_level"), BLEND_ICONS, BLEND_ICONS[LOWEST_LEVEL]))
    )


def risk_table(risk: DataFrame) -> DataFrame:
    """Display table: rounded score, icon and level, highest first."""
    icon = pick(F.col("risk_level"), RISK_ICONS, RISK_ICONS[LOWEST_LEVEL])
    return risk.select(
        "state",
        F.round("risk_score", 3).alias("risk_score"),
        F.concat_ws(" ", icon, F.col("risk_level")).alias("risk_level"),
    ).orderBy(F.desc("risk_score"), "state")
