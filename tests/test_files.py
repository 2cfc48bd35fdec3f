"""Readers, writers and the chained plans."""

import datetime as dt
import json

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.config import CleanCfg, ClusterCfg
from regionlens.operators import aggregate, profile, states
from regionlens.plans import pipeline
from regionlens.sources import readers, sinks
from regionlens.sources.adapters import dirty_fact, trade_fact


def test_mixed_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,state,n\n2024-01-01,A,1\n")
    (tmp_path / "b.csv").write_text("state,n,extra\nB,2,x\nC,,y\n")
    (tmp_path / "c.csv").write_text("state,n,extra\nD,high,z\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "skip.txt").write_text("nothing")
    df = readers.read_csv_dir(spark, str(tmp_path))
    assert rows(df, "state", "n", "extra") == [("A", "1", None), ("B", "2", "x"), ("C", None, "y"), ("D", "high", "z")]
    typed = readers.read_csv_dir(spark, str(tmp_path), schema=T.StructType([T.StructField("n", T.DoubleType())]))
    assert rows(typed, "state", "n") == [("A", 1.0), ("B", 2.0), ("C", None), ("D", None)]
    named = readers.read_csv_dir(spark, str(tmp_path), provenance=True)
    assert rows(named.where("state = 'B'"), "source_file") == [("b.csv",)]


def test_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,text,m\n1,"A ""x"", B",5\n2,plain,6\n3,short\n4,a,b,c,d\n')
    df = readers.read_csv_dir(spark, str(tmp_path))
    assert rows(df) == [(1, 'A "x", B', "5"), (2, "plain", "6"), (3, "short", None)]
    assert rows(readers.csv_rejects(spark, str(tmp_path))) == [("a.csv", "more fields than the header", ["4", "a", "b", "c"])]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.csv").write_text('n,text\n1,"two\nlines"\n2,"say ""so"""\n')
    df = readers.read_csv_dir(spark, str(tmp_path / "b"), multi_line=True)
    assert rows(df) == [(1, "two\nlines"), (2, 'say "so"')]
    odd = spark.createDataFrame([(1, 'q "u", o'), (2, None), (3, "\\\\ back"), (4, "")], "n int, text string")
    sinks.save_table(odd, "t", str(tmp_path / "out"), "csv")
    assert rows(readers.load_table(spark, "t", str(tmp_path / "out"), fmt="csv").where("n in (1, 3)")) == rows(odd.where("n in (1, 3)"))
    import csv

    lines = [r for f in (tmp_path / "out" / "t").glob("part-*") for r in csv.reader(f.open()) if r[0] != "n"]
    assert sorted(r[1] for r in lines if r[0] in "13") == sorted(['q "u", o', "\\\\ back"])


def test_truncated_file_is_never_read_in_part(spark, tmp_path):
    import gzip

    whole = gzip.compress("".join(["state,n\n", *[f"A{i * 7919 % 100_003},{i}\n" for i in range(50_000)]]).encode())
    (tmp_path / "bad.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "good.csv").write_text("state,n\nB,1\n")
    with pytest.raises(Exception):
        readers.read_csv_dir(spark, str(tmp_path)).count()
    assert rows(readers.read_csv_dir(spark, str(tmp_path), on_bad_file="skip")) == [("B", 1)]
    assert rows(readers.read_csv_any_encoding(spark, str(tmp_path), on_bad_file="skip")) == [("B", 1)]
    rejected = readers.csv_rejects(spark, str(tmp_path), on_bad_file="skip").collect()
    assert len(rejected) == 1 and rejected[0].source_file.endswith("bad.csv.gz") and rejected[0].fields is None


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    import csv
    import random

    rnd = random.Random(4)
    want = []
    with (tmp_path / "a.csv").open("w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["n", "the text", "m"])
        for i in range(400):
            text = "".join(rnd.choice(["a", "b,", '"', "\n", ' "x" ', "\n\n"]) for _ in range(rnd.choice([1, 5, 40, 900 if i == 77 else 9])))
            out.writerow([i, text, rnd.choice([i, ""])])
            want.append(text)
    df = readers.read_csv_dir(spark, str(tmp_path), multi_line=True, order="seq", provenance=True)
    got = df.orderBy("seq").collect()
    assert [r["n"] for r in got] == list(range(400)) and [r["the text"] for r in got] == want
    assert {r["source_file"] for r in got} == {"a.csv"} and dict(df.dtypes)["m"] == "int"
    assert len({r["seq"]["start"] for r in got}) > 10
    assert rows(readers.csv_rejects(spark, str(tmp_path), multi_line=True)) == []


def test_quotes_inside_fields_open_nothing(spark, tmp_path, small_ranges):
    lines = ["n,text"] + [f'{i},5" disk' if i % 3 else f'{i},"two\r\nlines ""q"""' for i in range(200)]
    (tmp_path / "a.csv").write_bytes("\r\n".join(lines).encode())
    got = readers.read_csv_dir(spark, str(tmp_path), multi_line=True).orderBy("n").collect()
    assert [(r["n"], r["text"]) for r in got] == [(i, '5" disk' if i % 3 else 'two\r\nlines "q"') for i in range(200)]


@pytest.mark.parametrize("indent", [None, 1])
def test_one_json_array_is_read_by_many_tasks(spark, tmp_path, small_ranges, indent):
    import random

    rnd = random.Random(5)
    want = [
        {"n": i, "text": "".join(rnd.choice(["a", "}", "{", '"', "]", "\\", "\n", "é"]) for _ in range(rnd.choice([1, 9, 900 if i == 50 else 3]))), "deep": {"list": [{"x": i}, {}], "m": {}}}
        for i in range(300)
    ]
    (tmp_path / "a.json").write_text(json.dumps(want, indent=indent))
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"n": 300 + i}) for i in range(100)))
    (tmp_path / "c.json").write_text(json.dumps({"n": 400, "text": "one object"}, indent=2))
    (tmp_path / "d.json").write_text("[]")
    got = readers.read_json(spark, str(tmp_path), multi_line=True).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(401))
    assert [r["text"] for r in got[:300]] == [w["text"] for w in want] and got[7]["deep"]["list"][0]["x"] == 7
    from regionlens.sources import ranges

    cut = ranges.records(spark, [str(tmp_path / "a.json")], ranges.JsonCutter)
    assert cut.select("start").distinct().count() > 10
    typed = readers.read_json(spark, str(tmp_path), T.StructType([T.StructField("n", T.DoubleType())]), multi_line=True)
    assert typed.agg(F.sum("n")).first()[0] == sum(range(401))


def test_survey_finds_headers_encodings_and_faults(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfstate,n\nA,1\n")
    (tmp_path / "b.csv").write_bytes(b"state,n\nS\xe9o,1\n")
    (tmp_path / "c.csv").write_bytes(b"")
    whole = gzip.compress(b"state,n\n" + bytes(range(65, 91)) * 3000)
    (tmp_path / "d.csv.gz").write_bytes(whole)
    (tmp_path / "e.csv.gz").write_bytes(whole + whole)
    (tmp_path / "f.csv.gz").write_bytes(whole[:-20])
    (tmp_path / "g.csv.gz").write_bytes(whole[:40] + b"xxxx" + whole[44:])
    files = readers.list_files(spark, str(tmp_path))
    found = {f.rsplit("/", 1)[-1]: s for f, s in readers.survey(spark, files, check=True).items()}
    assert [found[f"{c}"].header for c in ("a.csv", "b.csv", "c.csv", "d.csv.gz")] == ["state,n", "state,n", None, "state,n"]
    assert [found[c].utf8 for c in ("a.csv", "b.csv")] == [True, False]
    assert {c for c, s in found.items() if s.fault} == {"f.csv.gz", "g.csv.gz"}


def test_order_column_follows_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,v\n" + "".join(f"{i},9\n" for i in range(50)))
    (tmp_path / "b + c.csv").write_text("v,n\n1,0\n1,1\n")
    df = readers.read_csv_dir(spark, str(tmp_path), order="seq")
    assert [r.n for r in df.orderBy("seq").collect()] == [*range(50), 0, 1]
    assert [r.v for r in df.orderBy("seq").collect()] == [9] * 50 + [1] * 2


def test_no_readable_file(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_csv_dir(spark, str(tmp_path))


def test_gzip_header(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"state,n\nA,1\n"))
    (tmp_path / "b.csv").write_text("n,state\n2,B\n")
    assert rows(readers.read_csv_dir(spark, str(tmp_path)), "state", "n") == [("A", 1), ("B", 2)]


def test_mixed_types_become_text_or_double(spark):
    a = spark.createDataFrame([(1, 1)], "x int, y int")
    b = spark.createDataFrame([("u", 2.5)], "x string, y double")
    assert rows(readers.union_by_name([a, b])) == [("1", 1.0), ("u", 2.5)]


def test_encodings(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes(b"state,n\nS\xe9o,1\n")
    assert rows(readers.read_csv_any_encoding(spark, str(tmp_path / "latin.csv"))) == [("Séo", 1)]
    (tmp_path / "utf.csv").write_bytes("state,n\nÅs�,2\n".encode())
    assert rows(readers.read_csv_any_encoding(spark, str(tmp_path))) == [("Séo", 1), ("Ås�", 2)]
    assert rows(readers.read_csv_any_encoding(spark, str(tmp_path / "utf.csv"))) == [("Ås�", 2)]


def test_encodings_by_whole_path_and_header(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "part.csv").write_bytes(b"k,state\n1,S\xe9o\n")
    (tmp_path / "b" / "part.csv").write_bytes("state,k\nÅs,2\nB,3\n".encode())
    (tmp_path / "b" / "my file.txt").write_bytes(b"k,state\n4,\xc9t\xe9\n")
    want = [(1, "Séo"), (2, "Ås"), (3, "B"), (4, "Été")]
    assert rows(readers.read_csv_any_encoding(spark, str(tmp_path)), "k", "state") == want
    assert rows(readers.read_csv_any_encoding(spark, str(tmp_path / "b" / "my file.txt")), "k", "state") == want[3:]


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"state": "A", "n": 1}, {"state": "B"}]))
    assert rows(readers.read_json(spark, str(tmp_path / "a.json"), multi_line=True), "state", "n") == [("A", 1), ("B", None)]


def test_missing_table_has_declared_schema(spark, tmp_path):
    schema = T.StructType([T.StructField("state", T.StringType()), T.StructField("risk_score", T.DoubleType())])
    df = readers.load_table(spark, "risk_scores", str(tmp_path), schema)
    assert df.schema == schema and df.count() == 0


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_table_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("A", "2024-02", 1.5, ["x", "y"])], "state string, year_month string, v double, tags array<string>")
    sinks.save_table(df, "t", str(tmp_path), fmt)
    back = readers.load_table(spark, "t", str(tmp_path), fmt=fmt).first()
    assert (back["state"], back["v"], back["date"]) == ("A", 1.5, dt.date(2024, 2, 1))
    assert back["tags"] == ("x; y" if fmt == "csv" else ["x", "y"])


def test_appended_states_equal_the_full_run(spark, tmp_path):
    """Batches that share months, a batch repeated, a late batch: only its months are rewritten."""
    import random

    rnd = random.Random(3)
    facts = [(dt.date(2024, rnd.randint(1, 6), rnd.randint(1, 28)), rnd.choice(["A", "B", None]), rnd.choice([None, rnd.gauss(1e6, 3.0)]), float(rnd.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame(facts, "date date, state string, enrolment_count double, update_count double")
    path = str(tmp_path / "states")
    early, late = df.where("date < '2024-05-10'"), df.where("date >= '2024-05-10'")
    assert states.append_states(early, path, "one") == [f"2024-0{m}" for m in range(1, 6)]
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "states" / "year_month=2024-03").iterdir()}
    for _ in range(2):
        assert states.append_states(late, path, "two") == ["2024-05", "2024-06"]
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "states" / "year_month=2024-03").iterdir()} == kept
    assert states.append_states(df.limit(0), path, "none") == []
    got = states.aggregate_of_states(states.load_states(spark, path))
    want = aggregate.monthly_aggregate(df)
    assert set(got.columns) == set(want.columns)
    pairs = zip(got.orderBy("state", "year_month").collect(), want.orderBy("state", "year_month").collect(), strict=True)
    for a, b in pairs:
        for c in want.columns:
            assert a[c] == pytest.approx(b[c], rel=1e-6, abs=1e-9) if isinstance(b[c], float) else a[c] == b[c], c


def test_profiles_of_any_months_from_states(spark):
    df = spark.range(40_000).select(
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("date"),
        (F.col("id") % 9000).alias("k"), F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("t"), (F.col("id") % 7 * 0.5 - 0.0).alias("v"),
    )
    stored = states.profile_states(df)
    for first, last in ((None, None), ("2023-03", "2023-08"), ("2024-01", None)):
        part = df.where(F.date_format("date", "yyyy-MM").between(first or "0", last or "9"))
        exact = {r["column"]: r for r in profile.column_profile(part).collect()}
        got = {r["column"]: r for r in states.profile_of_states(stored, first, last).collect()}
        assert got.keys() == exact.keys()
        for c, r in got.items():
            assert r["missing_count"] == exact[c]["missing_count"] and r["dtype"] == exact[c]["dtype"]
            # Four standard errors of 4,096 cells.
            assert r["unique_values"] == pytest.approx(exact[c]["unique_values"], rel=4 * 1.04 / 64)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert rows(readers.nan_to_null(df)) == [(1.0,), (None,)]


def test_batch_analysis(spark, sf_dir, tmp_path):
    result = pipeline.analyze(dirty_fact(spark, sf_dir, 15), CleanCfg(as_of="2020-01-01"), cluster_cfg=ClusterCfg(restarts=2))
    scored = result.scored
    share = scored.agg(F.avg("is_anomaly")).first()[0]
    assert 0.05 < share < 0.15
    assert result.explanations.count() == scored.where("is_anomaly = 1").count()
    states = scored.select("state").distinct().count()
    assert result.risk.count() == result.clusters.count() == states
    assert result.clusters.where("cluster_description is null").count() == 0
    assert result.summary.count() == 1 and result.metadata.first()["total_records"] == result.facts.count()
    assert {r["action"] for r in result.recommendations.collect()} >= {"Anomaly Investigation", "Model Retraining"}
    pipeline.save_analysis(result, str(tmp_path))
    assert readers.load_table(spark, "risk_scores", str(tmp_path)).count() == states
    assert spark.read.json(str(tmp_path / "insights")).columns
    assert spark.read.json(str(tmp_path / "metadata")).first()["total_records"] == result.facts.count()
    assert spark.read.json(str(tmp_path / "explanations")).count() == result.explanations.count()


def test_any_file(spark, sf_dir, tmp_path):
    path = str(tmp_path / "any")
    trade_fact(spark, sf_dir).select(
        F.col("seq").alias("nr"), F.col("date").alias("When_Date"), F.col("state").alias("Region"),
        F.col("enrolment_count").alias("Volume"), F.col("age_0_18").alias("minor"), F.col("age_19_40").alias("adult"),
    ).write.option("header", True).csv(path)
    df, found = pipeline.process_file(spark, path, ["nr"])
    assert {d.standard for d in found} == {"date", "state", "enrolment_count", "age_0_18", "age_19_40"}
    made = pipeline.extract_features(df, "nr")
    assert set(made) >= {
        "temporal", "state_frequency", "state_totals", "top_states", "state_aggregates", "state_similarity",
        "demographic", "statistical", "correlation", "z_outliers", "iqr_outliers", "temporal_outliers",
    }
    n = df.count()
    assert made["temporal"].count() == n
    assert made["top_states"].count() == 5
    assert made["state_frequency"].agg(F.sum("frequency")).first()[0] == pytest.approx(1.0)
    assert made["statistical"].count() == 3


def test_planted_months_are_found(spark):
    """A month multiplied by 2.5 in one region gets that region's highest z-score."""
    days = spark.sql("select explode(sequence(date'2023-01-01', date'2023-06-30')) as date")
    facts = days.select("date", F.explode(F.array(*[F.lit(s) for s in ("A", "B", "C")])).alias("state")).select(
        "date", "state",
        (
            F.lit(1000.0)
            + F.pmod(F.xxhash64("date", "state"), F.lit(100))
        ).alias("base"),
    ).withColumn(
        "enrolment_count",
        F.col("base") * F.when((F.col("state") == "A") & (F.month("date") == 3), 2.5)
        .when((F.col("state") == "B") & (F.month("date") == 4), 3.0)
        .when((F.col("state") == "C") & (F.month("date") == 5), 0.4)
        .otherwise(1.0),
    )
    made = pipeline.create_features(facts)
    top = made.aggregates.groupBy("state").agg(F.max_by("year_month", F.abs("z_score")).alias("m"))
    assert rows(top, "state", "m") == [("A", "2023-03"), ("B", "2023-04"), ("C", "2023-05")]


def test_records_are_cut_once_and_strings_passed_whole(spark, tmp_path):
    from regionlens.sources import ranges

    texts = ["}", '"', "\\", '\\"', "{[", "]}\\\\", "", "é\n", "a\\\"}{\\"]
    (tmp_path / "a.json").write_text(json.dumps([{"n": n, "t": t, "o": {"k": [t]}} for n, t in enumerate(texts)]))
    cut = ranges.records(spark, [str(tmp_path / "a.json")], ranges.JsonCutter)
    assert "MapInArrow" not in cut._jdf.queryExecution().toString()  # read from what was written, whole records and parts
    got = [json.loads(bytes(r["text"])) for r in cut.orderBy("start", "row").collect()]
    assert [r["t"] for r in got] == texts and [r["o"]["k"] for r in got] == [[t] for t in texts]
    assert [m.group(1) for m in ranges.JSON_MARKS.finditer(rb'{"a":"x\"}","b":["y"]}')] == [b"{", b"[", b"]", b"}"]


def test_json_arrays_are_written_in_parts():
    import pyarrow as pa

    from regionlens.plans import registry

    def text(*batches):
        given = iter([pa.RecordBatch.from_arrays([pa.array(b, pa.string())], names=["value"]) for b in batches])
        return " ".join(v for b in registry._array_parts(given) for v in b.column(0).to_pylist())

    assert json.loads(text(["1", "2"], [], ["3"])) == [1, 2, 3] and json.loads(text([], ["1"])) == [1]
    assert json.loads(text()) == json.loads(text([])) == []
