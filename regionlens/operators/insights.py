"""Rules that turn the result tables into insight and recommendation rows.

A rule is a one-row aggregate and a condition; it gives one row or none.  All
rules read the small region-by-month, region or cluster tables, except the
metadata row, which reads the facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.expr import one_value, side_by_side
from regionlens.operators.anomalies import HIGH_SEVERITY, flagged
from regionlens.operators.risk import level_names

MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _text(c: Column) -> Column:
    return c.cast("string")


def _insight(
    base: DataFrame, when: Column, kind: str, title: Column | str, description: Column | str,
    severity: Column | str, confidence: str = "HIGH",
) -> DataFrame:
    lift = lambda v: F.lit(v) if isinstance(v, str) else v
    return base.where(when).select(
        F.lit(kind).alias("type"),
        lift(title).alias("title"),
        lift(description).alias("description"),
        lift(severity).alias("severity"),
        F.lit(confidence).alias("confidence"),
    )


def extremes(totals: DataFrame, key: str, value: str) -> DataFrame:
    """One row with the groups of the largest and smallest value; first by key on ties."""
    top = F.min(F.struct((-F.col(value)).alias("o"), F.col(key).alias("k")))["k"]
    low = F.min(F.struct(F.col(value).alias("o"), F.col(key).alias("k")))["k"]
    return totals.agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg(value).alias("mean"),
        top.alias("top"),
        F.max(value).alias("top_value"),
        low.alias("bottom"),
        F.min(value).alias("bottom_value"),
    )


def metadata(facts: DataFrame) -> DataFrame:
    """Period, rows and regions of the facts."""
    return facts.agg(
        F.to_date(F.min("date")).alias("start_date"),
        F.to_date(F.max("date")).alias("end_date"),
        F.datediff(F.max("date"), F.min("date")).alias("duration_days"),
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("state").alias("states_covered"),
    )


def executive_summary(agg: DataFrame, scored: DataFrame, risk: DataFrame) -> DataFrame:
    monthly = agg.groupBy("year_month").agg(F.sum("enrolment_count_sum").alias("total"))
    row = side_by_side(
        agg.sparkSession,
        monthly.agg(F.sum("total").alias("total_enrolments"), F.avg("total").alias("avg_monthly_enrolments")),
        agg.agg((F.avg("mom_growth") * 100).alias("avg_growth_pct")),
        scored.agg(
            F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("anomalies_detected"),
            (F.avg("is_anomaly") * 100).alias("anomaly_rate_pct"),
        ),
        risk.agg(
            F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_risk_states"),
            F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_states"),
        ),
    )
    critical = F.col("critical_risk_states")
    return row.withColumns(
        {
            "avg_growth_rate": F.format_string("%.1f%%", "avg_growth_pct"),
            "anomaly_rate": F.format_string("%.1f%%", "anomaly_rate_pct"),
            "growth_trend": F.when(F.col("avg_growth_pct") > 0, "positive").otherwise("negative"),
            "key_findings": F.array_compact(
                F.array(
                    F.when(F.col("total_enrolments") > 10_000_000, "Large-scale enrolment operations detected"),
                    F.when(F.col("anomaly_rate_pct") > 5, "Higher than expected anomaly rate"),
                    F.when(critical > 0, F.concat(_text(critical), F.lit(" states require immediate attention"))),
                )
            ),
        }
    )


def monthly_change(agg: DataFrame) -> DataFrame:
    last_two = (
        agg.groupBy("year_month")
        .agg(F.sum("enrolment_count_sum").alias("total"))
        .orderBy(F.desc("year_month"))
        .limit(2)
    )
    pct = F.when(F.col("previous") > 0, (F.col("latest") - F.col("previous")) / F.col("previous") * 100).otherwise(0.0)
    base = last_two.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("total", "year_month").alias("latest"),
        F.min_by("total", "year_month").alias("previous"),
    ).withColumn("pct", pct)
    up = F.col("pct") > 0
    return _insight(
        base,
        (F.col("n") > 1) & (F.abs("pct") > 10),
        "trend",
        F.concat(F.lit("Significant Monthly "), F.when(up, "Increased").otherwise("Decreased")),
        F.concat(
            F.lit("Enrolments "), F.when(up, "increased").otherwise("decreased"), F.lit(" by "),
            F.format_string("%.1f", F.abs("pct")), F.lit("% from previous month"),
        ),
        F.when(F.abs("pct") > 20, "HIGH").otherwise("MEDIUM"),
    )


def seasonality(agg: DataFrame) -> DataFrame:
    month = F.col("month") if "month" in agg.columns else F.substring("year_month", 6, 2).cast("int")
    base = extremes(
        agg.groupBy(month.alias("month")).agg(F.avg("enrolment_count_sum").alias("mean")), "month", "mean"
    )
    name = lambda c: F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), c)
    return _insight(
        base,
        F.col("top_value") > F.col("bottom_value") * 1.5,
        "seasonality",
        "Clear Seasonal Pattern Detected",
        F.concat(F.lit("Peak in "), name(F.col("top")), F.lit(", lowest in "), name(F.col("bottom"))),
        "MEDIUM",
    )


def state_disparity(agg: DataFrame) -> DataFrame:
    base = extremes(agg.groupBy("state").agg(F.sum("enrolment_count_sum").alias("total")), "state", "total")
    return _insight(
        base,
        (F.col("groups") > 1) & (F.col("top_value") > F.col("bottom_value") * 10),
        "performance",
        "Significant State Disparity",
        F.concat(F.col("top"), F.lit(" has significantly higher enrolments than "), F.col("bottom")),
        "MEDIUM",
    )


def temporal_cluster(scored: DataFrame) -> DataFrame:
    base = extremes(
        flagged(scored).groupBy("year_month").agg(F.count(F.lit(1)).alias("n")), "year_month", "n"
    )
    return _insight(
        base,
        F.col("top_value") > F.col("mean") * 2,
        "temporal_anomaly",
        "Anomaly Cluster Detected",
        F.concat(
            F.lit("Concentration of anomalies in "), F.col("top"), F.lit(" ("), _text(F.col("top_value")),
            F.lit(" anomalies)"),
        ),
        "HIGH",
        "MEDIUM",
    )


def geographic_concentration(scored: DataFrame) -> DataFrame:
    base = extremes(flagged(scored).groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state", "n")
    return _insight(
        base,
        F.col("top_value") > F.col("mean") * 3,
        "geographic_anomaly",
        "Geographic Anomaly Concentration",
        F.concat(
            F.col("top"), F.lit(" has "), _text(F.col("top_value")), F.lit(" anomalies, significantly above average")
        ),
        "HIGH",
    )


def high_severity(scored: DataFrame) -> DataFrame:
    base = flagged(scored).agg(F.count_if(F.col("anomaly_score") > HIGH_SEVERITY).alias("n"))
    return _insight(
        base,
        F.col("n") > 0,
        "severity",
        "High Severity Anomalies Detected",
        F.concat(_text(F.col("n")), F.lit(" anomalies with very high severity scores")),
        "CRITICAL",
    )


def critical_risk(risk: DataFrame) -> DataFrame:
    base = level_names(risk, "CRITICAL", 3)
    return _insight(
        base,
        F.col("n") > 0,
        "risk",
        "Critical Risk States Identified",
        F.concat(_text(F.col("n")), F.lit(" states at critical risk level: "), F.col("names")),
        "CRITICAL",
    )


def risk_spread(risk: DataFrame) -> DataFrame:
    return _insight(
        risk.agg(F.stddev_samp("risk_score").alias("sd")),
        F.col("sd") > 0.3,
        "risk_distribution",
        "Wide Risk Distribution",
        "Significant variability in risk scores across states",
        "MEDIUM",
    )


def cluster_imbalance(clus: DataFrame) -> DataFrame:
    base = extremes(clus.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster", "n")
    return _insight(
        base,
        (F.col("groups") > 1) & (F.col("top_value") > F.col("bottom_value") * 5),
        "cluster_imbalance",
        "Uneven State Distribution Across Clusters",
        F.concat(
            F.lit("Largest cluster has "), _text(F.col("top_value")), F.lit(" states, smallest has "),
            _text(F.col("bottom_value")),
        ),
        "LOW",
    )


def strong_cluster(clus: DataFrame) -> DataFrame:
    base = extremes(clus.groupBy("cluster").agg(F.avg("total_enrolments").alias("mean")), "cluster", "mean")
    return _insight(
        base,
        F.col("top_value") > F.col("bottom_value") * 2,
        "cluster_performance",
        "High-Performance Cluster Identified",
        F.concat(
            F.lit("Cluster "), _text(F.col("top") + 1), F.lit(" shows significantly higher enrolment volumes")
        ),
        "MEDIUM",
    )


def insights(
    agg: DataFrame, scored: DataFrame, risk: DataFrame, clus: DataFrame | None = None
) -> DataFrame:
    """All insight rows, with the section they belong to."""
    rules = [
        ("trend_insights", monthly_change(agg)),
        ("trend_insights", seasonality(agg)),
        ("trend_insights", state_disparity(agg)),
        ("anomaly_insights", temporal_cluster(scored)),
        ("anomaly_insights", geographic_concentration(scored)),
        ("anomaly_insights", high_severity(scored)),
        ("risk_insights", critical_risk(risk)),
        ("risk_insights", risk_spread(risk)),
    ]
    if clus is not None:
        rules += [("cluster_insights", cluster_imbalance(clus)), ("cluster_insights", strong_cluster(clus))]
    return reduce(
        DataFrame.unionByName, [df.select(F.lit(section).alias("section"), "*") for section, df in rules]
    )


def recommendations(agg: DataFrame, scored: DataFrame, risk: DataFrame) -> DataFrame:
    """``(category, action, description, priority, timeline, responsible)`` rows that apply."""
    facts = side_by_side(
        agg.sparkSession,
        scored.agg(F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("anomalies")),
        level_names(risk, "CRITICAL", 3),
        agg.agg(F.count_if(F.col("mom_growth") < -0.1).alias("shrinking")),
    )

    def row(category, action, description, priority, timeline, responsible):
        lift = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(
            F.lit(category).alias("category"),
            F.lit(action).alias("action"),
            lift(description).alias("description"),
            lift(priority).alias("priority"),
            F.lit(timeline).alias("timeline"),
            F.lit(responsible).alias("responsible"),
        )

    anomalies, n = F.col("anomalies"), F.col("n")
    return facts.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(
                        anomalies > 0,
                        row(
                            "Data Quality", "Anomaly Investigation",
                            F.concat(F.lit("Investigate "), _text(anomalies), F.lit(" detected anomalies")),
                            F.when(anomalies > 50, "HIGH").otherwise("MEDIUM"),
                            "2 weeks", "Data Quality Team",
                        ),
                    ),
                    F.when(
                        n > 0,
                        row(
                            "Risk Management", "Immediate Risk Mitigation",
                            F.concat(F.lit("Address critical risk in "), _text(n), F.lit(" states: "), F.col("names")),
                            "CRITICAL", "48 hours", "Risk Management Team",
                        ),
                    ),
                    F.when(
                        F.col("shrinking") > 0,
                        row(
                            "Operations", "Performance Review",
                            "Review operations in regions showing negative growth",
                            "MEDIUM", "1 month", "Operations Team",
                        ),
                    ),
                    row(
                        "Monitoring", "Regular Dashboard Review",
                        "Review dashboard metrics weekly for early issue detection",
                        "LOW", "Weekly", "All Teams",
                    ),
                    row(
                        "Improvement", "Model Retraining",
                        "Retrain ML models quarterly with latest data",
                        "MEDIUM", "Quarterly", "Data Science Team",
                    ),
                )
            )
        )
    )


def dashboard_insights(facts: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """``(type, title, description, action)`` from success rate, anomalies and critical regions."""
    base = facts.agg(
        (F.try_divide(F.sum("successful_enrolments"), F.sum("enrolments")) * 100).alias("rate"),
        F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("anomalies"),
    )
    critical = F.lit(0)
    if risk is not None:
        critical = one_value(risk.agg(F.count_if(F.col("risk_level") == "CRITICAL").alias("n")))["n"]
    base = base.withColumn("critical", critical)
    row = lambda kind, title, text, action: F.struct(
        F.lit(kind).alias("type"), F.lit(title).alias("title"), text.alias("description"), F.lit(action).alias("action")
    )
    return base.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("rate") > 90,
                        row(
                            "success", "Excellent Performance",
                            F.concat(F.lit("Overall success rate: "), F.format_string("%.1f", "rate"), F.lit("%")),
                            "Maintain current operational excellence",
                        ),
                    ),
                    F.when(
                        F.col("anomalies") > 0,
                        row(
                            "warning", "Anomalies Detected",
                            F.concat(_text(F.col("anomalies")), F.lit(" anomalies need review")),
                            "Investigate detected anomalies in Anomalies tab",
                        ),
                    ),
                    F.when(
                        F.col("critical") > 0,
                        row(
                            "danger", "Critical Risk Detected",
                            F.concat(_text(F.col("critical")), F.lit(" states at critical risk level")),
                            "Immediate action required - check Risks tab",
                        ),
                    ),
                )
            )
        )
    )


def quick_insights(scored: DataFrame, risk: DataFrame) -> DataFrame:
    """One row: top region, flagged rows, critical regions and the first three of them."""
    totals = scored.groupBy("state").agg(
        F.sum("enrolment_count_sum").alias("total"), F.sum("is_anomaly").alias("anomalies")
    )
    return side_by_side(
        scored.sparkSession,
        totals.agg(
            F.min(F.struct((-F.col("total")).alias("o"), "state"))["state"].alias("top_state"),
            F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomaly_count"),
        ),
        level_names(risk, "CRITICAL", 3).select(F.col("n").alias("critical_count"), F.col("names").alias("critical_states")),
    )
