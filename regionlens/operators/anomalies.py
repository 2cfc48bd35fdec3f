"""Confidence, explanation and summaries of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.config import ForestCfg, LofCfg
from regionlens.functions.expr import one_value
from regionlens.operators.features import feature_names
from regionlens.operators.iforest import isolation_forest
from regionlens.operators.lof import lof

HIGH_SEVERITY = 0.8


def confidence(scored: DataFrame) -> DataFrame:
    """Band of the score between the smallest and largest score; ``LOW`` when all are equal."""
    ends = one_value(scored.agg(F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high")))
    rel = F.try_divide(F.col("anomaly_score") - F.col("_e.low"), F.col("_e.high") - F.col("_e.low"))
    return (
        scored.withColumn("_e", ends)
        .withColumn(
            "anomaly_confidence",
            F.when(rel > 0.8, "VERY_HIGH").when(rel > 0.6, "HIGH").when(rel > 0.4, "MEDIUM").otherwise("LOW"),
        )
        .drop("_e")
    )


def detect_anomalies(ml: DataFrame, model: str = "isolation_forest", cfg: ForestCfg | LofCfg | None = None) -> DataFrame:
    """Flag, score and band every row of the model frame."""
    cols = feature_names(ml)
    if not cols:
        return ml.withColumns(
            {"is_anomaly": F.lit(0), "anomaly_score": F.lit(0.0), "anomaly_confidence": F.lit("LOW")}
        )
    if model == "isolation_forest":
        return confidence(isolation_forest(ml, cols, cfg=cfg or ForestCfg()))
    if model == "local_outlier_factor":
        return confidence(lof(ml, cols, cfg=cfg or LofCfg()))
    raise ValueError(f"unknown model: {model}")


def flagged(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("is_anomaly") == 1)


def _reasons(df: DataFrame) -> Column:
    has = set(df.columns)
    zscore = next((c for c in ("enrolment_zscore", "z_score") if c in has), None)
    out = []
    if zscore:
        z = F.col(zscore)
        out.append(
            F.when(F.abs(z) > 3, F.concat(F.lit("Extreme enrolment volume (z-score: "), F.format_string("%.2f", z), F.lit(")")))
        )
    if "mom_growth" in has:
        g = F.col("mom_growth")
        out.append(
            F.when(
                F.abs(g) > 0.5,
                F.concat(
                    F.lit("Sudden "), F.when(g > 0, "increase").otherwise("decrease"), F.lit(" ("),
                    F.format_string("%.1f", F.abs(g) * 100), F.lit("% change)"),
                ),
            )
        )
    if "update_ratio" in has:
        r = F.col("update_ratio")
        shown = F.format_string("%.2f", r)
        out.append(
            F.when(r > 0.5, F.concat(F.lit("High update ratio ("), shown, F.lit(")")))
            .when(r < 0.05, F.concat(F.lit("Low update ratio ("), shown, F.lit(")")))
        )
    if "volatility" in has:
        v = F.col("volatility")
        out.append(F.when(v > 0.5, F.concat(F.lit("High volatility ("), F.format_string("%.2f", v), F.lit(")"))))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def explain(scored: DataFrame) -> DataFrame:
    """Ordered reasons and an action for every flagged row."""
    score = F.col("anomaly_score")
    band = F.col("anomaly_confidence") if "anomaly_confidence" in scored.columns else F.lit("MEDIUM")
    return (
        flagged(scored)
        .withColumn("_r", _reasons(scored))
        .select(
            "state",
            F.col("year_month").alias("period"),
            F.round(score, 3).alias("anomaly_score"),
            band.alias("confidence"),
            F.coalesce(F.try_element_at("_r", F.lit(1)), F.lit("")).alias("primary_reason"),
            F.slice("_r", 2, F.greatest(F.size("_r"), F.lit(1))).alias("supporting_factors"),
            F.when(score > 0.8, "Immediate investigation required")
            .when(score > 0.6, "Priority review recommended")
            .otherwise("Review data quality and verify with field teams")
            .alias("recommended_action"),
        )
    )


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Counts, latest period, mean score and the region with most flagged rows (first by name on ties)."""
    per_state = (
        flagged(scored)
        .groupBy("state")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("anomaly_score") > HIGH_SEVERITY).alias("high"),
            F.sum("anomaly_score").alias("score"),
            F.max("year_month").alias("latest"),
        )
    )
    return per_state.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("anomaly_count"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_severity_count"),
        F.count(F.lit(1)).alias("states_affected"),
        F.max("latest").alias("latest_period"),
        F.try_divide(F.sum("score"), F.sum("n")).alias("mean_severity"),
        F.min(F.struct((-F.col("n")).alias("o"), "state"))["state"].alias("top_state"),
    )


def anomalies_by_date(scored: DataFrame) -> DataFrame:
    return flagged(scored).groupBy("date").agg(F.count(F.lit(1)).alias("anomaly_count"))


def top_anomalies(scored: DataFrame, k: int | None = 20) -> DataFrame:
    """Flagged rows by falling score, ties by region and month; ``k=None`` gives all of them."""
    listed = (
        flagged(scored)
        .select("state", "year_month", "enrolment_count_sum", F.round("anomaly_score", 3).alias("anomaly_score"))
        .orderBy(F.desc("anomaly_score"), "state", "year_month")
    )
    return listed if k is None else listed.limit(k)
