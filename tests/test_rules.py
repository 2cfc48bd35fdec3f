"""Hand-computed rows for the rules on nulls, ties and zeros."""

import datetime as dt

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.config import CleanCfg, RiskCfg
from regionlens.operators import aggregate, anomalies, calendar, clean, columns, insights, marts, profile
from regionlens.operators import features, risk


def months(spark, data):
    return spark.createDataFrame(data, "state string, year_month string, enrolment_count_sum double")


def test_growth_and_zscore(spark):
    df = months(
        spark,
        [("A", "2024-01", 100.0), ("A", "2024-02", 150.0), ("A", "2024-04", 0.0), ("A", "2024-05", 60.0), ("B", "2024-01", 10.0)],
    )
    out = aggregate.add_zscore(aggregate.add_growth(df, "enrolment_count_sum"), "enrolment_count_sum")
    got = rows(out.withColumn("z_score", F.round("z_score", 6)), "state", "year_month", "mom_growth", "z_score")
    assert got == [
        ("A", "2024-01", None, 0.35465),
        ("A", "2024-02", 0.5, 1.14276),
        ("A", "2024-04", -1.0, -1.221571),
        ("A", "2024-05", None, -0.275839),
        ("B", "2024-01", None, 0.0),
    ]
    spaced = aggregate.add_growth(df, "enrolment_count_sum", calendar=True).where("year_month = '2024-04'")
    assert spaced.first()["mom_growth"] is None


def test_single_row_month(spark):
    facts = spark.createDataFrame(
        [("B", dt.date(2024, 1, 5), 10.0, None), (None, dt.date(2024, 1, 5), 1.0, 1.0), ("B", None, 1.0, 1.0)],
        "state string, date date, enrolment_count double, update_count double",
    )
    row = aggregate.monthly_aggregate(facts).collect()
    assert len(row) == 1
    assert row[0]["enrolment_count_std"] is None and row[0]["update_count_sum"] == 0.0 and row[0]["update_ratio"] == 0.0


def test_growth_spans_year_end(spark):
    df = months(spark, [("A", "2023-12", 50.0), ("A", "2024-01", 75.0)])
    assert rows(aggregate.add_growth(df, "enrolment_count_sum"), "mom_growth") == [(0.5,), (None,)]


def test_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (10.0, "c"), (12.0, "a"), (None, "b"), (None, None)], "x double, state string")
    assert rows(clean.impute_median(df, ["x"]).where("state is null or x = 6.5"), "x") == [(6.5,), (6.5,)]
    assert clean.impute_mode(df, ["state"]).where("state = 'a'").count() == 3
    empty = spark.createDataFrame([(None, None)], "x double, state string")
    both = clean.impute(empty).first()
    assert both["x"] is None and both["state"] == "Unknown"


def test_names(spark):
    df = spark.createDataFrame(
        [("o'neil NAGAR-2 west", " PIN 110001.0"), ("new delhi", "12345"), ("ÉTAT du nord", "1234567"), (None, None)],
        "t string, p string",
    )
    out = df.select(clean.region_name(F.col("t")), clean.district_name(F.col("t")), clean.pincode(F.col("p")))
    assert [tuple(r) for r in out.collect()] == [
        ("O'Neil Nagar-2 West", "ONeil Nagar West", "110001"),
        ("NCT of Delhi", "New Delhi", None),
        ("État Du Nord", "tat Du Nord", "123456"),
        (None, None, None),
    ]


def test_range_rules(spark):
    df = spark.createDataFrame(
        [(1, 2e6, 6e6, 1.0), (2, 2e6, 5e6, -4.0), (3, -1.0, 0.0, 0.0), (4, 10.0, 50.0, 11.0), (5, 10.0, 1.0, 11.1), (6, 5.0, None, 0.0)],
        "seq long, enrolment_count double, update_count double, age_0_18 double",
    )
    assert rows(clean.validate_ranges(df)) == [(2, 1e6, 5e6, 0.0), (4, 10.0, 50.0, 11.0)]


def test_first_of_repeats_with_null_keys(spark):
    df = spark.createDataFrame(
        [(2, None, "A", "x", 2.0), (1, None, "A", "x", 1.0), (3, None, "A", None, 3.0), (4, None, "A", None, 4.0)],
        "seq long, date date, state string, district string, v double",
    )
    for n in (1, 7):
        assert rows(clean.drop_repeats(df.repartition(n)), "seq") == [(1,), (3,)]


def test_sparse_rows_and_dates(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-05", None, None), (2, "12/31/2023", "A", None), (3, "2008-12-31", "A", "x"), (4, "junk", "A", "x"), (5, "2030-01-01", "A", "x")],
        "seq long, date string, state string, district string",
    )
    assert rows(clean.drop_sparse(df), "seq") == [(2,), (3,), (4,), (5,)]
    kept = clean.bound_dates(df, CleanCfg(as_of="2025-01-01"))
    assert rows(kept, "seq", "date") == [(1, dt.datetime(2024, 1, 5)), (2, dt.datetime(2023, 12, 31))]


def test_audit_adds_up(spark, sf_dir):
    from regionlens.sources.adapters import dirty_fact

    df, cfg = dirty_fact(spark, sf_dir, 15), CleanCfg(as_of="2020-01-01")
    removed = clean.cleaning_audit(df, cfg).agg(F.sum("rows_removed")).first()[0]
    assert df.count() - removed == clean.clean(df, cfg).count()


def test_gap_is_elapsed_not_calendar(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 23)), (2, dt.datetime(2024, 1, 2, 1)), (3, dt.datetime(2024, 1, 1, 0))], "seq long, date timestamp_ntz"
    )
    assert rows(calendar.days_since_previous(df), "seq", "days_since_previous") == [(1, None), (2, 0), (3, -2)]
    same = df.withColumn("date", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {r[0] for r in rows(calendar.days_since_previous(same), "days_since_previous")} == {None}


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 3, 2),)], "date date")
    got = rows(calendar.calendar_features(df), "year", "month", "day_of_week", "is_weekend", "quarter", "is_month_start", "is_month_end")
    assert got == [(2024, 2, 3, 0, 1, 0, 1), (2024, 3, 5, 1, 1, 0, 0)]


def test_rolling_mean(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "seq long, v double").repartition(5)
    got = dict(rows(calendar.rolling_mean(df, "v", ["seq"]), "seq", "rolling_mean"))
    assert (got[1], got[7], got[8]) == (1.0, 4.0, 5.0)


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0), (10.0, 7.0)], "x double, one double")
    s = profile.numeric_stats(df, ["x"]).first()
    assert round(s["skewness"], 6) == 1.018234 and round(s["kurtosis"], 4) == -0.7696
    assert round(s["percentile_90"], 6) == 7.9 and round(s["std"], 6) == 4.082483
    assert rows(profile.pairwise_pearson(df), "correlation") == [(None,)]
    iqr = profile.iqr_outliers(spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 100.0)], "v double"), "v").first()
    assert tuple(iqr) == (-1.0, 7.0, 1)
    assert profile.z_outliers(df, "one").count() == 0
    assert profile.numeric_stats(df.withColumn("x", F.lit(None).cast("double")), ["x"]).count() == 0
    assert profile.z_outliers(df).count() == 0


def test_sketch_switch(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert profile.iqr_outliers(df, "x", accuracy=10000).first()["lower_bound"] == pytest.approx(-500, abs=5)


def test_scaling_of_constant_and_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (2.0, 5.0)], "a double, b double")
    got = features.standardize(df, ["a", "b"]).select("a_std", "b_std").collect()
    assert [round(r[0], 6) for r in got] == [0.0, -1.224745, 1.224745] and all(r[1] == 0.0 for r in got)


def test_feature_choice(spark):
    full = spark.createDataFrame([], "enrolment_count_sum double, mom_growth double, update_ratio double, other double")
    assert features.feature_names(full) == ["enrolment_count_sum", "mom_growth", "update_ratio"]
    few = spark.createDataFrame([], "year int, month int, s string, " + ", ".join(f"c{i} double" for i in range(12)))
    assert features.feature_names(few) == [f"c{i}" for i in range(12)]
    assert features.feature_names(few, most=10) == [f"c{i}" for i in range(10)]
    assert features.feature_names(few, ["c3"]) == ["c3"]


def risk_row(spark, **extra):
    months_ = ["2024-01", "2024-02", "2024-04"]
    df = spark.createDataFrame([("A", m) for m in months_], "state string, year_month string")
    return df.withColumns(extra)


def test_consistency(spark):
    c = risk.risk_components(risk_row(spark)).first()
    assert round(c["consistency_risk"], 6) == 0.010989
    one = risk.risk_components(risk_row(spark).where("year_month = '2024-01'")).first()
    assert one["consistency_risk"] == 0.0


def test_weighted_score_and_level(spark):
    df = spark.createDataFrame(
        [("A", 0.5, 0.5, 0.7, 0.5, 0.0, 0.5)],
        "state string, volume_risk double, anomaly_frequency_risk double, anomaly_severity_risk double, "
        "volatility_risk double, consistency_risk double, update_pattern_risk double",
    )
    row = risk.risk_level(risk.weighted_score(df)).first()
    assert round(row["risk_score"], 10) == 0.5 and row["risk_level"] == "MEDIUM" and row["risk_color"] == "#FFC107"
    part = risk.weighted_score(df.select("state", "volume_risk", "anomaly_severity_risk")).first()
    assert round(part["risk_score"], 6) == round((0.5 * 0.15 + 0.7 * 0.25) / 0.4, 6)
    with pytest.raises(ValueError):
        risk.weighted_score(df, {"volume": 0.2})


def test_risk_bounds(spark):
    df = spark.createDataFrame(
        [("A", "2024-01", 2e7, 1, 1.7), ("A", "2024-02", 1.0, 0, 9.0)],
        "state string, year_month string, enrolment_count_sum double, is_anomaly int, anomaly_score double",
    )
    c = risk.risk_components(df).first()
    assert (c["volume_risk"], c["anomaly_frequency_risk"], c["anomaly_severity_risk"]) == (1.0, 0.5, 1.0)


def test_cluster_imbalance_needs_more_than_five_times(spark):
    frame = lambda n: spark.createDataFrame([(0,)] * n + [(1,)], "cluster int")
    assert insights.cluster_imbalance(frame(6)).count() == 1
    assert insights.cluster_imbalance(frame(5)).count() == 0
    assert insights.cluster_imbalance(frame(5).where("cluster = 0")).count() == 0


def test_rules_on_empty_tables(spark):
    scored = spark.createDataFrame(
        [], "state string, year_month string, enrolment_count_sum double, mom_growth double, is_anomaly int, anomaly_score double"
    )
    risks = spark.createDataFrame([], "state string, risk_score double, risk_level string")
    assert insights.insights(scored, scored, risks).count() == 0
    assert insights.recommendations(scored, scored, risks).count() == 2
    assert risk.risk_recommendations(risks).count() == 1
    assert anomalies.anomaly_summary(scored).first()["anomaly_count"] == 0


def test_explanations(spark):
    df = spark.createDataFrame(
        [("A", "2024-01", 1, 0.9, 3.5, -0.75, 0.6), ("B", "2024-02", 1, 0.7, 0.0, None, 0.2), ("C", "2024-02", 0, 0.9, 4.0, 2.0, 0.9)],
        "state string, year_month string, is_anomaly int, anomaly_score double, z_score double, mom_growth double, update_ratio double",
    )
    a, b = anomalies.explain(df).orderBy("state").collect()
    assert a["primary_reason"] == "Extreme enrolment volume (z-score: 3.50)"
    assert a["supporting_factors"] == ["Sudden decrease (75.0% change)", "High update ratio (0.60)"]
    assert a["recommended_action"] == "Immediate investigation required" and a["confidence"] == "MEDIUM"
    assert b["primary_reason"] == "" and b["supporting_factors"] == []
    assert b["recommended_action"] == "Priority review recommended"


def test_equal_scores_are_low(spark):
    df = spark.createDataFrame([(0.5,), (0.5,)], "anomaly_score double")
    assert rows(anomalies.confidence(df), "anomaly_confidence") == [("LOW",), ("LOW",)]


def test_names_to_schema(spark):
    pairs = lambda cols: {d.original: d.standard for d in columns.match_names(cols)}
    assert pairs(["update_count", "date"]) == {"date": "date", "update_count": "update_count"}
    assert pairs(["Date", "State_Name", "Total_Enrolments", "Total_Updates"]) == {
        "Date": "date", "State_Name": "state", "Total_Enrolments": "enrolment_count", "Total_Updates": "update_count",
    }


def test_alias_clash_keeps_both(spark):
    df = spark.createDataFrame([(1, 2)], "Date int, timestamp int")
    assert columns.standardize_columns(df).columns == ["date", "timestamp"]
    both = columns.unique_names(spark.sql("select 1 as date").join(spark.sql("select 2 as Date"), F.lit(True)))
    assert both.columns == ["date", "Date_2"]


def test_content_detection_ignores_numbers(spark):
    df = spark.createDataFrame([(20240101, "2024-01-01", 3.0)], "a long, b string, my_sum double")
    assert {(d.original, d.standard, d.kind) for d in columns.detect(df)} == {
        ("b", "date", "auto_detected_date"), ("my_sum", "enrolment_count", "auto_detected_numeric"),
    }


def test_types(spark):
    df = spark.createDataFrame([("2024-13-01", 5, "x7"), ("2024-01-02", None, "7")], "date string, state int, total string")
    assert rows(columns.standardize_types(df)) == [(dt.datetime(2024, 1, 2), None, 7.0), (None, "5", None)]


def test_dates_in_many_formats(spark):
    texts = ["15-01-2024", "20240115", "15 Jan 2024", "15/01/2024", "01/15/2024", "1/15/2024", "2024/1/15", "Jan 15, 2024", " 2024-01-15 ", "15-Jan-2024"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, "junk")], "seq long, date string")
    kept = clean.bound_dates(df, CleanCfg(as_of="2024-12-31"))
    assert rows(kept, "date") == [(dt.datetime(2024, 1, 15),)] * len(texts)


def test_whole_column_decides(spark):
    df = spark.createDataFrame([(i, "2024-01-05" if i < 10 else "junk", "x" if i % 2 else "7") for i in range(100)], "id long, a string, b string")
    assert not columns.looks_like_date(df, "a") and columns.looks_like_date(df, "a", min_share=0.1)
    assert columns.detect(df) == []
    assert not columns.looks_like_date(df.limit(0), "a")


def test_day_and_month(spark):
    one = lambda *texts: spark.createDataFrame([(t,) for t in texts], "date string")
    first = lambda df, **k: columns.process_any(df, ["date"], **k)[0].orderBy("date").first()["date"]
    assert first(one("03/04/2024", "13/04/2024")) == dt.datetime(2024, 4, 3)
    assert first(one("03/04/2024", "04/13/2024")) == dt.datetime(2024, 3, 4)
    assert first(one("03/03/2024")) == dt.datetime(2024, 3, 3)
    for unclear in (one("03/04/2024"), one("13/04/2024", "04/13/2024")):
        with pytest.raises(ValueError):
            columns.process_any(unclear, ["date"])
    assert first(one("03/04/2024"), day_first=True) == dt.datetime(2024, 4, 3)


def test_text_columns_keep_their_values(spark):
    df = spark.createDataFrame([("India", "Rampur", "7", "x", "1"), ("Nepal", "Kot", "n/a", "8", "2")], "country string, village string, total string, age string, sum_2 string")
    assert rows(columns.standardize_types(df, coerce=False)) == [("India", "Rampur", 7.0, "x", 1.0), ("Nepal", "Kot", None, "8", 2.0)]
    assert columns.standardize_types(df).schema["age"].dataType.simpleString() == "double"


def test_names_stay_different(spark):
    named = lambda *c: spark.createDataFrame([tuple(range(len(c)))], T.StructType([T.StructField(x, T.IntegerType()) for x in c]))
    for cols in (("a", "A", "A_2"), ("a", "A", "a_2", "A_2"), ("x", "X", "x")):
        got = columns.unique_names(named(*cols)).columns
        assert len({c.lower() for c in got}) == len(cols)
    got = columns.standardize_columns(named("Date", "timestamp", "date_raw")).columns
    assert len({c.lower() for c in got}) == 3


def test_filling_keeps_types_and_values(spark):
    df = spark.createDataFrame([(9007199254740993, 1, 1, 1.5), (9007199254740995, 3, 2, float("nan")), (1, None, None, 2.5)], "a long, b int, c int, d double")
    out = clean.impute_median(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "double", "double"]
    assert rows(out) == [(1, 2, 1.5, 2.5), (9007199254740993, 1, 1.0, 1.5), (9007199254740995, 3, 2.0, 2.0)]


def test_first_of_repeats_needs_an_order(spark):
    df = spark.createDataFrame([(1, "A", 9.0), (2, "A", 1.0)], "seq long, state string, enrolment_count double")
    assert rows(clean.drop_repeats(df), "enrolment_count") == [(9.0,)]
    with pytest.raises(ValueError):
        clean.drop_repeats(df.drop("seq"))


def test_delhi_is_on_the_map_under_both_names(spark):
    df = spark.createDataFrame([(s, 1.0, 0.5, 0.5) for s in ("Delhi", "NCT of Delhi", "Nowhere")], "state string, enrolments double, success_rate double, population_coverage double")
    assert rows(marts.geo_mart(df), "state", "lat") == [("Delhi", 28.7041), ("NCT of Delhi", 28.7041), ("Nowhere", 20.5937)]


def test_short_tables_have_a_model_frame(spark):
    agg = spark.createDataFrame([("A", f"2024-{m:02d}", float(m)) for m in range(1, 6)], "state string, year_month string, enrolment_count_sum double")
    assert aggregate.ml_frame(agg).count() == 2 and aggregate.ml_frame(agg, min_rows=10).count() == 0


def test_lookup_default_and_filters(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "state string, v double")
    dim = spark.createDataFrame([("A", 9.0)], "state string, lat double")
    assert rows(marts.lookup(df, dim, ["state"], {"lat": 0.0}), "state", "lat") == [("A", 9.0), ("B", 0.0)]
    assert rows(marts.filter_states(df, dim), "state") == [("A",)]
    tied = spark.createDataFrame([("B", 2.0), ("A", 2.0), ("C", 1.0)], "state string, v double")
    assert tuple(marts.extreme(tied, "state", "v").first()) == ("A", 2.0)
    assert tuple(marts.extreme(tied, "state", "v", largest=False).first()) == ("C", 1.0)


def test_unknown_weights_config(spark):
    with pytest.raises(ValueError):
        risk.risk_scores(risk_row(spark, enrolment_count_sum=F.lit(1.0)), RiskCfg(weights={"frequency": 1.0}))


def test_numeric_pincode_is_filled_as_a_number(spark):
    df = spark.createDataFrame([(110001.0,), (110003.0,), (None,)], "pincode double")
    out = clean.normalize_pincode(clean.impute(df))
    assert rows(out) == [("110001",), ("110002",), ("110003",)]


def test_updates_alone_keep_their_name(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1), 3.0)], "state string, date date, update_count double")
    assert aggregate.monthly_aggregate(df).columns == ["state", "year_month", "update_count"]


def test_all_anomalies_or_the_first(spark):
    df = spark.createDataFrame(
        [("A", f"2024-{m:02d}", 1.0, 1, m / 100) for m in range(1, 13)] + [("B", "2024-01", 1.0, 0, 0.9)],
        "state string, year_month string, enrolment_count_sum double, is_anomaly int, anomaly_score double",
    )
    assert anomalies.top_anomalies(df, None).count() == 12
    assert [r["anomaly_score"] for r in anomalies.top_anomalies(df, 2).collect()] == [0.12, 0.11]
