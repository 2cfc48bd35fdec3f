"""The three ways the operators are chained: batch analysis, any table, dashboards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.config import CleanCfg, ClusterCfg, ForestCfg, LofCfg, RiskCfg
from regionlens.functions.expr import numeric_columns
from regionlens.functions.materialize import written
from regionlens.operators import aggregate, anomalies, calendar, clean, cluster, columns, insights, marts, profile
from regionlens.operators import risk as risk_ops
from regionlens.operators import similarity
from regionlens.sources import readers, sinks
from regionlens.sources.adapters import stand_in_scores


@dataclass
class Features:
    facts: DataFrame
    aggregates: DataFrame
    ml: DataFrame


@dataclass
class Analysis:
    facts: DataFrame
    aggregates: DataFrame
    scored: DataFrame
    explanations: DataFrame
    clusters: DataFrame
    risk: DataFrame
    metadata: DataFrame
    summary: DataFrame
    insights: DataFrame
    recommendations: DataFrame


def create_features(facts: DataFrame) -> Features:
    """Facts with calendar columns, the region-by-month table, and the model frame.

    The region-by-month table is written: it is small (regions x months) and
    everything after it reads it again.
    """
    timed = calendar.time_features(facts)
    agg = written(aggregate.monthly_aggregate(timed))
    return Features(timed, agg, aggregate.ml_frame(agg))


def analyze(
    raw: DataFrame,
    clean_cfg: CleanCfg = CleanCfg(),
    model: str = "isolation_forest",
    model_cfg: ForestCfg | LofCfg | None = None,
    cluster_cfg: ClusterCfg = ClusterCfg(),
    risk_cfg: RiskCfg = RiskCfg(),
) -> Analysis:
    """Raw facts to insights.

    Cleaned facts, scores and risk are read by several results, so each is
    written once instead of being computed again.
    """
    facts = written(clean.clean(raw, clean_cfg))
    made = create_features(facts)
    scored = written(anomalies.detect_anomalies(made.ml, model, model_cfg))
    grouped = written(cluster.kmeans_states(cluster.state_features(scored), cluster_cfg))
    clusters = cluster.describe_clusters(grouped)
    risk = written(risk_ops.risk_scores(scored, risk_cfg))
    return Analysis(
        facts,
        made.aggregates,
        scored,
        anomalies.explain(scored),
        clusters,
        risk,
        insights.metadata(facts),
        insights.executive_summary(made.aggregates, scored, risk),
        insights.insights(made.aggregates, scored, risk, clusters),
        insights.recommendations(made.aggregates, scored, risk),
    )


def save_analysis(result: Analysis, directory: str) -> None:
    """Tables of an analysis under the names the dashboards load, and all parts of its insight document."""
    sinks.save_table(result.aggregates, "monthly_aggregates", directory)
    sinks.save_table(result.scored, "anomalies", directory)
    sinks.save_table(result.risk, "risk_scores", directory)
    sinks.save_table(result.clusters, "clusters", directory)
    sinks.save_insights(result.insights, f"{directory}/insights")
    sinks.save_insights(result.recommendations, f"{directory}/recommendations")
    sinks.save_insights(result.summary, f"{directory}/executive_summary")
    sinks.save_insights(result.metadata, f"{directory}/metadata")
    sinks.save_insights(result.explanations, f"{directory}/explanations")


def process_file(spark: SparkSession, path: str, order_by: Sequence[str]) -> tuple[DataFrame, list[columns.Detected]]:
    """Any CSV to canonical columns and types."""
    return columns.process_any(readers.read_csv_any_encoding(spark, path), list(order_by))


def extract_features(df: DataFrame, order_by: str = "seq") -> dict[str, DataFrame]:
    """Every profile the columns of a table allow.

    The table is written once, because every entry reads it. Entries that rest on counts or quantiles of the
    whole table (frequencies, statistics, outlier bounds, gaps, similarity) run these jobs when called.
    """
    df = written(df)
    has = set(df.columns)
    out: dict[str, DataFrame] = {}
    if "date" in has:
        out["temporal"] = calendar.days_since_previous(calendar.calendar_features(df), order_by=[order_by])
    for c in ("state", "district"):
        if c in has:
            out[f"{c}_frequency"] = aggregate.category_frequency(df, c)
    if {"state", "enrolment_count"} <= has:
        totals = aggregate.state_totals(df)
        out["state_totals"] = totals
        out["top_states"] = marts.top_k(totals, "total", 5)
        out["state_aggregates"] = aggregate.state_stats(df)
        out["state_similarity"] = similarity.cosine_pairs(df, "date" if "date" in has else None)
    if any(c.startswith("age_") for c in has):
        out["demographic"] = aggregate.demographics(df)
    numbers = numeric_columns(df, exclude=[order_by])
    if numbers:
        out["statistical"] = profile.numeric_stats(df, numbers)
    if len(numbers) > 1:
        out["correlation"] = profile.pairwise_pearson(df, numbers)
    primary = profile.primary_count(df)
    if primary:
        out["z_outliers"] = profile.z_outliers(df, primary)
        out["iqr_outliers"] = profile.iqr_outliers(df, primary)
        if "date" in has:
            out["temporal_outliers"] = profile.temporal_outliers(df, primary, ["date", order_by])
    return out


def flagship(facts: DataFrame) -> DataFrame:
    """Facts to risk table: ranges, first of repeats, months, flags, weighted risk, level."""
    kept = clean.drop_repeats(clean.validate_ranges(facts))
    scored = stand_in_scores(aggregate.monthly_aggregate(kept))
    return risk_ops.risk_scores(scored).withColumn("risk_score", F.round("risk_score", 6))
