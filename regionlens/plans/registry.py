"""Every operator as a query over the given tables, with the same query in SQL.

``cols`` names the compared columns: ``~x`` is rounded to six decimals, ``#x``
is an integer, anything else is compared as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.config import CleanCfg, ClusterCfg, RiskCfg
from regionlens.functions.expr import month_start, nan_to_null
from regionlens.functions.materialize import written, scratch_path
from regionlens.operators import aggregate as agg_ops
from regionlens.operators import anomalies as ano
from regionlens.operators import calendar as cal
from regionlens.operators import clean as cln
from regionlens.operators import cluster as clu
from regionlens.operators import columns as col_ops
from regionlens.operators import features as feat
from regionlens.operators import iforest as ifo
from regionlens.operators import insights as ins
from regionlens.operators import lof as lof_ops
from regionlens.operators import marts as mrt
from regionlens.operators import profile as prf
from regionlens.operators import risk as rsk
from regionlens.operators import similarity as sim
from regionlens.operators import states as sta
from regionlens.plans import oracle_models as models
from regionlens.plans import pipeline
from regionlens.plans.oracle import _D3, with_ctes
from regionlens.sources import readers, sinks
from regionlens.sources.adapters import (
    dash_fact,
    dirty_fact,
    event_fact,
    stand_in_scores,
    table,
    trade_fact,
)

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Case:
    name: str
    cols: str
    build: Build
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if not self.cols:
            return df
        out = []
        for c in self.cols.split():
            name = c.lstrip("~#")
            if c[0] == "~":
                # + 0.0 turns a rounded -0.0 into 0.0
                out.append((F.round(F.col(name).cast("double"), 6) + F.lit(0.0)).alias(name))
            elif c[0] == "#":
                out.append(F.col(name).cast("long").alias(name))
            else:
                out.append(F.col(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for c in self.cols.split():
            name = c.lstrip("~#")
            if c[0] == "~":
                out.append(f"round(CAST({name} AS DOUBLE), 6) + 0.0 AS {name}")
            elif c[0] == "#":
                out.append(f"CAST({name} AS BIGINT) AS {name}")
            else:
                out.append(name)
        return with_ctes(f"SELECT {', '.join(out)} FROM ({self.sql}) AS answer")


CASES: dict[str, Case] = {}


def case(name: str, cols: str, build: Build, sql: str | None = None) -> None:
    CASES[name] = Case(name, cols, build, sql)


# --- inputs -----------------------------------------------------------------

CLEAN = CleanCfg(as_of="2020-01-01")
# Cut-offs that spread the order facts over all levels.
CUTS = (("CRITICAL", 0.37), ("HIGH", 0.35), ("MEDIUM", 0.335), ("LOW", 0.33))
LEVELS = RiskCfg(cuts=CUTS)


def agg_of(s: SparkSession, d: str) -> DataFrame:
    return agg_ops.monthly_aggregate(trade_fact(s, d))


def scored(agg: DataFrame) -> DataFrame:
    return stand_in_scores(agg).withColumn("date", month_start(F.col("year_month")))


def scored_of(s: SparkSession, d: str) -> DataFrame:
    return scored(agg_of(s, d))


def risk_of(s: SparkSession, d: str) -> DataFrame:
    """The risk table, written because most queries read it more than once."""
    return written(rsk.risk_scores(scored_of(s, d), LEVELS))


def written_agg(s: SparkSession, d: str) -> DataFrame:
    """The region-by-month table cut from its lineage, for queries that read it several times."""
    return written(agg_of(s, d))


def planted(agg: DataFrame) -> DataFrame:
    """Months with a planted seasonal peak, a planted dominant region and a planted last-month jump."""
    x = F.col("enrolment_count_sum")
    return agg.withColumn(
        "enrolment_count_sum",
        x
        * F.when(F.col("year_month").endswith("-03"), 2.5).otherwise(1.0)
        * F.when(F.col("state") == "NATION_7", 40.0).otherwise(1.0)
        * F.when(F.col("year_month") >= "2001-08", 30.0).otherwise(1.0),
    )


def planted_of(s: SparkSession, d: str) -> DataFrame:
    return planted(agg_of(s, d))


def planted_scores(agg: DataFrame) -> DataFrame:
    """Scores with flags crowded into one region and one month."""
    hot = (F.col("state") == "NATION_7") | (F.col("year_month") == "1997-03")
    return scored(agg).withColumns(
        {
            "is_anomaly": F.when(hot, 1).otherwise(F.col("is_anomaly")),
            "anomaly_score": F.when(hot, 0.9).otherwise(F.col("anomaly_score")),
        }
    )


def planted_scores_of(s: SparkSession, d: str) -> DataFrame:
    return planted_scores(agg_of(s, d))


def labelled(agg: DataFrame) -> DataFrame:
    """Region features with a label computed from the name."""
    return clu.state_features(scored(agg)).withColumn("cluster", (F.ascii(F.right("state", F.lit(1))) % 3).cast("int"))


def labelled_of(s: SparkSession, d: str) -> DataFrame:
    return labelled(written_agg(s, d))


def ml_of(s: SparkSession, d: str) -> DataFrame:
    return agg_ops.ml_frame(written_agg(s, d))


DIRTY = lambda s, d: dirty_fact(s, d, 15)
FACT = "seq date state district ~enrolment_count ~update_count"
DIRTY_COLS = FACT.replace("date state", "date state pincode") + " ~age_0_18 ~age_19_40 ~age_41_60 ~age_60_plus"
AGG = (
    "state year_month ~enrolment_count_sum ~enrolment_count_mean ~enrolment_count_std "
    "~update_count_sum ~mom_growth ~z_score ~update_ratio"
)

# --- sources and sinks ------------------------------------------------------


def _two_headers(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "csv")
    fact = trade_fact(s, d)
    fact = fact.withColumn("state", F.concat("state", F.lit(' "Q", new')))
    even, odd = fact.where("seq % 2 = 0"), fact.where("seq % 2 = 1")
    even.select("seq", "state", "enrolment_count").write.options(**sinks.CSV_OUT).csv(f"{path}/a b")
    odd.select("update_count", "state", "enrolment_count", "seq").write.options(**sinks.CSV_OUT).csv(f"{path}/c")
    return readers.read_csv_dir(s, path)


def _json(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "json")
    trade_fact(s, d).write.json(path)
    return readers.read_json(s, path, multi_line=False)


def _array_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of a JSON array one after another, its brackets and commas with them."""
    mark = "["
    for batch in batches:
        if batch.num_rows:
            marks = pa.array([mark] + [","] * (batch.num_rows - 1))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, batch.column(0), "")], names=["value"])
            mark = ","
    yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])


def _json_arrays(s: SparkSession, d: str) -> DataFrame:
    """Files that are one array in one line, with braces and quotes inside texts."""
    path = scratch_path(s, "json")
    fact = trade_fact(s, d).withColumn("state", F.concat("state", F.lit(' } "]{ \\'), F.col("seq")))
    # Each task writes one file with blanks for line ends, so no array is held as a whole.
    texts = fact.select(F.to_json(F.struct("*")).alias("value"))
    texts.mapInArrow(_array_parts, "value string").write.option("lineSep", " ").text(path)
    return readers.read_json(s, path, multi_line=True)


def _line_breaks(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "csv")
    fact = trade_fact(s, d).select("seq", F.concat("state", F.lit(' "Q",\nnew\n')).alias("state"), "enrolment_count", "district")
    fact.where("seq % 2 = 0").write.options(**sinks.CSV_OUT).csv(f"{path}/a")
    fact.where("seq % 2 = 1").select("district", "enrolment_count", "state", "seq").write.options(**sinks.CSV_OUT).csv(f"{path}/b")
    return readers.read_csv_dir(s, path, multi_line=True)


def _rejects(s: SparkSession, d: str) -> DataFrame:
    """Rows with more fields than their header, from lines written as text."""
    path = scratch_path(s, "csv")
    line = F.concat_ws(",", "seq", F.when(F.col("seq") % 3 == 0, F.concat("state", F.lit(",over"))).otherwise(F.col("state")), F.col("enrolment_count").cast("long"))
    lines = trade_fact(s, d).select(F.spark_partition_id().alias("part"), line.alias("value"))
    text = lines.groupBy("part").agg(F.concat(F.lit("seq,state,n\n"), F.array_join(F.collect_list("value"), "\n")).alias("value"))
    text.select("value").repartition(4).write.text(path)
    # Text files have no suffix that marks them as CSV.
    return readers.csv_rejects(s, f"{path}/part-*").select("reason", F.array_join("fields", "|").alias("fields"))




def _two_encodings(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "encoded")
    fact = trade_fact(s, d).select("seq", F.concat("state", F.lit("é")).alias("state"), "enrolment_count")
    fact.where("seq % 3 = 0").write.option("header", True).csv(f"{path}/a b")
    fact.where("seq % 3 = 1").select("state", "enrolment_count", "seq").write.option("header", True).csv(f"{path}/c")
    fact.where("seq % 3 = 2").write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/d/e")
    return readers.read_csv_any_encoding(s, path)


def _saved(fmt: str, partitions: tuple[str, ...] = ()) -> Build:
    def build(s: SparkSession, d: str) -> DataFrame:
        base = scratch_path(s, "table")
        sinks.save_table(agg_of(s, d), "monthly_aggregates", base, fmt, partition_by=partitions)
        return readers.load_table(s, "monthly_aggregates", base, fmt=fmt)

    return build


def _exported(s: SparkSession, d: str) -> DataFrame:
    path = sinks.save_table(dash_fact(s, d), "export", scratch_path(s, "csv"), "csv")
    return nan_to_null(s.read.csv(path, header=True, inferSchema=True))


def _all_insights(s: SparkSession, d: str) -> DataFrame:
    agg = written_agg(s, d)
    risk = written(rsk.risk_scores(scored(agg), LEVELS))
    return ins.insights(planted(agg), planted_scores(agg), risk, labelled(agg))


def _insight_file(s: SparkSession, d: str) -> DataFrame:
    return s.read.json(sinks.save_insights(_all_insights(s, d), scratch_path(s, "insights")))


case(
    "src1_read_csv_dir", "#seq state ~enrolment_count ~update_count", _two_headers,
    """SELECT seq, state || ' "Q", new' AS state, enrolment_count, CASE WHEN seq % 2 = 1 THEN update_count END AS update_count
        FROM trade""",
)
case(
    "src1_read_csv_multiline", "#seq state ~enrolment_count district", _line_breaks,
    """SELECT seq, state || ' "Q",' || chr(10) || 'new' || chr(10) AS state, enrolment_count, district FROM trade""",
)
case(
    "src1_csv_rejects", "reason fields", _rejects,
    "SELECT 'more fields than the header' AS reason, seq || '|' || state || '|over|' || CAST(enrolment_count AS BIGINT) AS fields FROM trade WHERE seq % 3 = 0",
)
case(
    "src2_read_json_array", "#seq state district ~enrolment_count ~update_count", _json_arrays,
    "SELECT * REPLACE (state || ' } \"]{ \\' || seq AS state) FROM trade",
)
case("src2_read_json", "#seq state district ~enrolment_count ~update_count", _json, "SELECT * FROM trade")
case(
    "src3_read_csv_any_encoding", "#seq state ~enrolment_count", _two_encodings,
    "SELECT seq, state || 'é' AS state, enrolment_count FROM trade",
)
case("src4_load_table", AGG, _saved("parquet", ("year_month",)), "SELECT * FROM agg")
case("src4_load_table_csv", AGG, _saved("csv"), "SELECT * FROM agg")
case(
    "src5_month_start", "state year_month date ~enrolment_count_sum", _saved("parquet"),
    "SELECT *, CAST(year_month || '-01' AS DATE) AS date FROM agg",
)
case(
    "snk1_save_table", "#seq state ~enrolments ~successful_enrolments ~updates ~success_rate ~population_coverage #is_anomaly",
    _exported, "SELECT * FROM dash",
)
case(
    "snk2_save_insights", "section type title description severity confidence", _insight_file,
    "SELECT section, type, title, description, severity, confidence FROM all_insights",
)

# --- columns ----------------------------------------------------------------


def _aliased(s: SparkSession, d: str) -> DataFrame:
    names = {
        "date": "Date", "state": "State_Name", "district": "DISTRICT_NAME",
        "enrolment_count": "Total_Enrolments", "update_count": "Total_Updates",
    }
    return col_ops.standardize_columns(trade_fact(s, d).withColumnsRenamed(names))


def _odd_names(s: SparkSession, d: str) -> DataFrame:
    return trade_fact(s, d).select(
        F.col("date").alias("reg_timestamp"), F.col("state").alias("Region"), F.col("district").alias("sales_zone"),
        F.col("enrolment_count").alias("Volume"), F.col("update_count"), F.col("age_0_18").alias("minor"),
        F.col("age_60_plus").alias("seniors"),
    )


def _detected(s: SparkSession, d: str) -> DataFrame:
    df = _odd_names(s, d)
    filled = prf.column_profile(df, rsd=0.05).select(F.col("column").alias("original"), "missing_count")
    rows = prf.file_summary(df).select("total_records")
    return (
        col_ops.detect_schema(df)
        .join(filled, "original")
        .withColumn("non_null", rows.scalar() - F.col("missing_count"))
    )


def _by_content(s: SparkSession, d: str) -> DataFrame:
    fact = trade_fact(s, d)
    day = F.to_date("date")
    written_as = F.when(F.col("seq") % 3 == 0, F.date_format(day, "d-M-yyyy")).when(F.col("seq") % 3 == 1, F.date_format(day, "yyyyMMdd"))
    df = fact.select(
        F.when(F.col("seq") < 12, F.lit("2024-01-05")).otherwise("junk").alias("first_ten"),
        F.col("seq").alias("nr"), written_as.otherwise(day.cast("string")).alias("seen_on"), F.col("state").alias("grp"),
        F.col("enrolment_count").alias("qty_sum"),
    )
    found, _ = col_ops.process_any(df, ["nr"])
    return found.groupBy(F.to_date("date").alias("date")).agg(F.sum("enrolment_count").alias("enrolment_count"))


def _filled(s: SparkSession, d: str) -> DataFrame:
    bare = trade_fact(s, d).select("seq", "district")
    return col_ops.fill_required(bare, ["seq"]).withColumn("date", F.to_date("date"))


def _typed(s: SparkSession, d: str) -> DataFrame:
    raw = dirty_fact(s, d).select(
        "seq", "date", "state",
        F.when(F.col("seq") % 10 == 3, "n/a").otherwise(F.col("enrolment_count").cast("string")).alias("enrolment_count"),
        F.col("age_0_18").cast("string").alias("age_0_18"),
        F.col("state").alias("country"), F.col("district").alias("village"), F.col("district").alias("total_area"),
    )
    return col_ops.standardize_types(raw, coerce=False).withColumn("date", F.to_date("date"))


case("map1_standardize_columns", FACT, _aliased, "SELECT * FROM trade")
case(
    "map2_detect_schema", "original standard confidence kind #non_null", _detected,
    """SELECT v.*, (SELECT count(*) FROM trade) AS non_null FROM (VALUES
        ('reg_timestamp', 'date', 'MEDIUM', 'name'), ('Region', 'state', 'HIGH', 'name'),
        ('sales_zone', 'district', 'MEDIUM', 'name'), ('Volume', 'enrolment_count', 'HIGH', 'name'),
        ('update_count', 'update_count', 'MEDIUM', 'name'), ('minor', 'age_0_18', 'HIGH', 'name'),
        ('seniors', 'age_60_plus', 'MEDIUM', 'name')) AS v(original, standard, confidence, kind)""",
)
case(
    "map3_detect_date_and_map4_count", "date ~enrolment_count", _by_content,
    "SELECT CAST(date AS DATE) AS date, sum(enrolment_count) AS enrolment_count FROM trade GROUP BY 1",
)
case(
    "map5_fill_required", "seq date state ~enrolment_count", _filled,
    """SELECT seq, DATE '2023-01-01' + CAST(row_number() OVER (ORDER BY seq) - 1 AS INTEGER) AS date,
        'Unknown_State' AS state, 1.0 AS enrolment_count FROM trade""",
)
case(
    "map6_standardize_types", "seq date state ~enrolment_count ~age_0_18 country village total_area", _typed,
    """SELECT seq, TRY_CAST(date AS DATE) AS date, state,
        CASE WHEN seq % 10 <> 3 THEN enrolment_count END AS enrolment_count, age_0_18,
        state AS country, district AS village, district AS total_area FROM dirty""",
)

# --- cleaning ---------------------------------------------------------------


def _sparse(s: SparkSession, d: str) -> DataFrame:
    gap = lambda c, n: F.when(F.col("seq") % n != 0, F.col(c)).alias(c)
    return trade_fact(s, d).select(
        "seq", gap("date", 31), gap("state", 31), gap("district", 31), gap("enrolment_count", 31),
        F.when(F.col("seq") % 31 != 0, F.when(F.col("seq") % 37 != 0, F.col("update_count"))).alias("update_count"),
        gap("age_0_18", 37), "age_19_40", "age_41_60", "age_60_plus",
    )


case("cln0_clean", DIRTY_COLS.replace(" date", " date"), lambda s, d: cln.clean(DIRTY(s, d), CLEAN).withColumn("date", F.to_date("date")), "SELECT * FROM cleaned")
case("cln1_drop_null_dates", "seq date", lambda s, d: cln.drop_null_dates(dirty_fact(s, d)), "SELECT * FROM dirty WHERE date IS NOT NULL")
case(
    "cln2_impute_median", "seq ~enrolment_count ~update_count ~age_0_18 #serial",
    lambda s, d: cln.impute_median(cln.drop_null_dates(dirty_fact(s, d)).withColumn("serial", F.lit(9_007_199_254_740_993) + F.col("seq"))),
    """SELECT seq, coalesce(enrolment_count, (SELECT median(enrolment_count) FROM dirty WHERE date IS NOT NULL)) AS enrolment_count,
        update_count, age_0_18, 9007199254740993 + seq AS serial FROM dirty WHERE date IS NOT NULL""",
)
case(
    "cln3_impute_mode", "seq state district pincode", lambda s, d: cln.impute_mode(dirty_fact(s, d)),
    """SELECT seq, coalesce(state, (SELECT state FROM dirty WHERE state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, state LIMIT 1)) AS state,
        coalesce(district, (SELECT district FROM dirty WHERE district IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, district LIMIT 1)) AS district,
        pincode FROM dirty""",
)
case("cln4_drop_sparse", FACT, lambda s, d: cln.drop_sparse(_sparse(s, d)), """SELECT * FROM (
    SELECT seq, CASE WHEN seq % 31 <> 0 THEN date END AS date, CASE WHEN seq % 31 <> 0 THEN state END AS state,
        CASE WHEN seq % 31 <> 0 THEN district END AS district, CASE WHEN seq % 31 <> 0 THEN enrolment_count END AS enrolment_count,
        CASE WHEN seq % 31 <> 0 AND seq % 37 <> 0 THEN update_count END AS update_count FROM trade) WHERE seq % 31 <> 0""")
case("cln5_bound_dates", "seq date", lambda s, d: cln.bound_dates(DIRTY(s, d), CLEAN).withColumn("date", F.to_date("date")), "SELECT seq, d AS date FROM shifted_dates WHERE d BETWEEN DATE '2009-01-01' AND DATE '2020-01-01'")
case("cln6_normalize_state", "seq state", lambda s, d: cln.normalize_state(dirty_fact(s, d)), "SELECT seq, state_name AS state FROM named")
case("cln7_normalize_district", "seq district", lambda s, d: cln.normalize_district(dirty_fact(s, d)), "SELECT seq, district_name AS district FROM named")
case("cln8_normalize_pincode", "seq pincode", lambda s, d: cln.normalize_pincode(dirty_fact(s, d)), "SELECT seq, nullif(regexp_extract(trim(pincode), '\\d{6}'), '') AS pincode FROM dirty")
case(
    "cln9_validate_ranges", "seq ~enrolment_count ~update_count ~age_0_18 ~age_60_plus",
    lambda s, d: cln.validate_ranges(dirty_fact(s, d), CleanCfg(cap=200.0)),
    """SELECT seq, least(enrolment_count, 200) AS enrolment_count, update_count, greatest(age_0_18, 0) AS age_0_18, greatest(age_60_plus, 0) AS age_60_plus
        FROM dirty WHERE enrolment_count >= 0 AND update_count >= 0 AND update_count <= 5 * least(enrolment_count, 200)
        AND age_0_18 + age_19_40 + age_41_60 + age_60_plus <= 1.1 * least(enrolment_count, 200)""",
)
case(
    "cln10_drop_repeats", FACT, lambda s, d: cln.drop_repeats(trade_fact(s, d)),
    "SELECT * FROM trade QUALIFY row_number() OVER (PARTITION BY date, state, district ORDER BY seq) = 1",
)
case("cln11_cleaning_audit", "step #rows_removed", lambda s, d: cln.cleaning_audit(DIRTY(s, d), CLEAN), "SELECT step, rows_removed FROM clean_audit")

# --- calendar ---------------------------------------------------------------

case(
    "cal1_time_features", "seq #year #month #day_of_week #is_weekend", lambda s, d: cal.time_features(trade_fact(s, d)),
    """SELECT seq, year(date) AS year, month(date) AS month, isodow(date) - 1 AS day_of_week,
        CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM trade""",
)
case(
    "cal2_calendar_features", "seq #quarter #is_month_start #is_month_end", lambda s, d: cal.calendar_features(event_fact(s, d)),
    """SELECT seq, quarter(date) AS quarter, CASE WHEN day(date) = 1 THEN 1 ELSE 0 END AS is_month_start,
        CASE WHEN last_day(CAST(date AS DATE)) = CAST(date AS DATE) THEN 1 ELSE 0 END AS is_month_end FROM event""",
)
case(
    "cal3_days_since_previous", "seq #days_since_previous", lambda s, d: cal.days_since_previous(event_fact(s, d)),
    """SELECT seq, floor((epoch_us(date) - lag(epoch_us(date)) OVER (ORDER BY seq)) / 86400000000.0) AS days_since_previous FROM event""",
)
case("cal4_year_month", "seq year_month", lambda s, d: cal.with_year_month(trade_fact(s, d)), "SELECT seq, strftime(date, '%Y-%m') AS year_month FROM trade")

# --- aggregates and windows -------------------------------------------------



def _appended(s: SparkSession, d: str) -> DataFrame:
    """The order facts stored as three batches that share months, one of them written twice."""
    fact, path = written(trade_fact(s, d)), scratch_path(s, "states")
    day = F.col("date")
    parts = {"a": day < "1996-05-20", "b": (day >= "1996-05-20") & (F.col("seq") % 3 > 0), "c": (day >= "1996-05-20") & (F.col("seq") % 3 == 0)}
    for batch in ("a", "b", "c", "b"):
        sta.append_states(fact.where(parts[batch]), path, batch)
    return sta.aggregate_of_states(sta.load_states(s, path))


case("agg1_monthly_aggregate", AGG, agg_of, "SELECT * FROM agg")
case("agg1_appended", AGG, _appended, "SELECT * FROM agg")
case(
    "agg2_metric_choice", "state year_month ~retail ~size",
    lambda s, d: agg_ops.monthly_aggregate(
        trade_fact(s, d).select("state", "date", F.col("age_0_18").alias("retail"), F.col("age_19_40").alias("size"), F.col("age_41_60").alias("rest"))
    ),
    "SELECT state, strftime(date, '%Y-%m') AS year_month, sum(age_0_18) AS retail, sum(age_19_40) AS size FROM trade GROUP BY 1, 2",
)
case(
    "agg3_update_ratio", "state year_month ~update_ratio",
    lambda s, d: agg_ops.add_update_ratio(agg_ops.by_state_month(event_fact(s, d).withColumn("update_count", F.col("enrolment_count") / 2))),
    """SELECT state, strftime(date, '%Y-%m') AS year_month,
        sum(enrolment_count / 2) / CASE WHEN sum(enrolment_count) = 0 THEN 1 ELSE sum(enrolment_count) END AS update_ratio FROM event GROUP BY 1, 2""",
)
case(
    "agg4_state_stats", "state #record_count ~total_enrolments ~avg_enrolments ~std_enrolments", lambda s, d: agg_ops.state_stats(trade_fact(s, d)),
    """SELECT state, count(*) AS record_count, sum(enrolment_count) AS total_enrolments, avg(enrolment_count) AS avg_enrolments,
        stddev_samp(enrolment_count) AS std_enrolments FROM trade GROUP BY 1""",
)
case(
    "agg5_category_frequency", "value #n_records ~frequency #n_distinct", lambda s, d: agg_ops.category_frequency(dirty_fact(s, d), "district"),
    """SELECT district AS value, count(*) AS n_records, count(*) / (SELECT count(*) FROM dirty) AS frequency,
        (SELECT count(DISTINCT district) FROM dirty) AS n_distinct FROM dirty WHERE district IS NOT NULL GROUP BY 1""",
)
case("agg6_state_totals", "state ~total", lambda s, d: agg_ops.state_totals(trade_fact(s, d)), "SELECT state, sum(enrolment_count) AS total FROM trade GROUP BY 1")
case("agg7_demographics", "feature ~value", lambda s, d: agg_ops.demographics(trade_fact(s, d)), """
    SELECT u.feature, u.value FROM (SELECT sum(age_0_18) AS a, sum(age_19_40) AS b, sum(age_41_60) AS c, sum(age_60_plus) AS e, sum(enrolment_count) AS t FROM trade) AS x,
    LATERAL (VALUES ('age_0_18_total', a), ('age_19_40_total', b), ('age_41_60_total', c), ('age_60_plus_total', e),
      ('age_0_18_percentage', a / t * 100), ('age_19_40_percentage', b / t * 100), ('age_41_60_percentage', c / t * 100), ('age_60_plus_percentage', e / t * 100),
      ('age_0_18_to_age_19_40_ratio', a / b), ('age_19_40_to_age_41_60_ratio', b / c), ('age_41_60_to_age_60_plus_ratio', c / e)) AS u(feature, value)""")
NATIONS = [f"NATION_{i}" for i in range(25)]
case("agg8_date_state_matrix", "date " + " ".join(f"~{n}" for n in NATIONS), lambda s, d: agg_ops.date_state_matrix(trade_fact(s, d), NATIONS),
    "SELECT date, " + ", ".join(f"sum(CASE WHEN state = '{n}' THEN enrolment_count ELSE 0 END) AS {n}" for n in NATIONS) + " FROM trade GROUP BY 1")
case("agg8_date_state_cells", "date state ~total", lambda s, d: agg_ops.date_state_cells(trade_fact(s, d)), "SELECT date, state, sum(enrolment_count) AS total FROM trade GROUP BY 1, 2")
case(
    "win1_mom_growth", "state year_month ~mom_growth",
    lambda s, d: agg_ops.add_growth(agg_ops.by_state_month(trade_fact(s, d)), "enrolment_count_sum"), "SELECT * FROM agg",
)
case(
    "win2_z_score", "state year_month ~z_score",
    lambda s, d: agg_ops.add_zscore(agg_ops.by_state_month(trade_fact(s, d)), "enrolment_count_sum"), "SELECT * FROM agg",
)
case(
    "win3_lags", "state year_month ~lag_1 ~lag_2 ~lag_3", lambda s, d: agg_ops.add_lags(agg_of(s, d), "enrolment_count_sum"),
    """SELECT state, year_month, lag(enrolment_count_sum, 1) OVER w AS lag_1, lag(enrolment_count_sum, 2) OVER w AS lag_2,
        lag(enrolment_count_sum, 3) OVER w AS lag_3 FROM agg WINDOW w AS (PARTITION BY state ORDER BY year_month)""",
)
case(
    "win4_rolling_mean", "seq ~rolling_mean", lambda s, d: cal.rolling_mean(event_fact(s, d), "enrolment_count"),
    "SELECT seq, avg(enrolment_count) OVER (ORDER BY date, seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_mean FROM event",
)
case("ml1_ml_frame", AGG + " date ~lag_1 ~lag_2 ~lag_3 #month #state_code", ml_of, "SELECT * FROM ml")

# --- joins, top-k, sets -----------------------------------------------------

FEATURES = (
    "state ~total_enrolments ~avg_enrolments ~std_enrolments ~total_updates ~avg_update_ratio ~avg_growth ~growth_volatility "
    "~anomaly_frequency ~avg_anomaly_score ~age_0_18_pct ~age_19_40_pct ~age_41_60_pct ~age_60_plus_pct"
)
FEATURE_COLS = FEATURES.replace("~", "").split()[1:]


def _region_of(s: SparkSession, d: str) -> DataFrame:
    nation, region = table(s, d, "nation"), table(s, d, "region")
    return (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_name").alias("state"), F.col("r_name").alias("region"))
    )


case(
    "jon1_state_metrics", "state ~total_enrolments ~total_updates ~avg_growth",
    lambda s, d: clu.state_features(agg_of(s, d)),
    "SELECT state, sum(enrolment_count_sum) AS total_enrolments, sum(update_count_sum) AS total_updates, coalesce(avg(mom_growth), 0) AS avg_growth FROM agg GROUP BY 1",
)
case(
    "jon2_lookup", "state region ~total",
    # Event types are in no region.
    lambda s, d: mrt.lookup(
        agg_ops.state_totals(trade_fact(s, d)).unionByName(agg_ops.state_totals(event_fact(s, d))), _region_of(s, d), ["state"], {"region": "elsewhere"}
    ),
    """SELECT t.state, coalesce(r_name, 'elsewhere') AS region, total FROM (SELECT state, sum(enrolment_count) AS total FROM trade GROUP BY 1
          UNION ALL SELECT event_type, sum(value) FROM events GROUP BY 1) AS t
        LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) AS x ON t.state = n_name""",
)
case("jon3_cluster_description", "state #cluster cluster_description", lambda s, d: clu.describe_clusters(labelled_of(s, d)), "SELECT * FROM described")
case(
    "jon4_membership", "state year_month ~enrolment_count_sum",
    lambda s, d: mrt.filter_states(agg_of(s, d), table(s, d, "nation").where("n_regionkey = 3").select(F.col("n_name").alias("state"))),
    "SELECT * FROM agg WHERE state IN (SELECT n_name FROM nation WHERE n_regionkey = 3)",
)
case("top1_top_states", "state ~total", lambda s, d: mrt.top_k(agg_ops.state_totals(trade_fact(s, d)), "total", 5), "SELECT state, sum(enrolment_count) AS total FROM trade GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
case("top2_best_success", "state ~success_rate", lambda s, d: mrt.leaderboard(dash_fact(s, d), "success_rate", 8, "mean"), "SELECT state, avg(success_rate) AS success_rate FROM dash GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
case("top3_highest_risk", "state ~risk_score", lambda s, d: mrt.top_k(risk_of(s, d), "risk_score", 10), "SELECT state, risk_score FROM risk ORDER BY risk_score DESC, state LIMIT 10")
case(
    "top4_extreme_month", "year_month ~total",
    lambda s, d: mrt.extreme(agg_of(s, d).groupBy("year_month").agg(F.sum("enrolment_count_sum").alias("total")), "year_month", "total"),
    "SELECT year_month, sum(enrolment_count_sum) AS total FROM agg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
)
case(
    "top4_least_month", "year_month ~total",
    lambda s, d: mrt.extreme(agg_of(s, d).groupBy("year_month").agg(F.sum("enrolment_count_sum").alias("total")), "year_month", "total", largest=False),
    "SELECT year_month, sum(enrolment_count_sum) AS total FROM agg GROUP BY 1 ORDER BY 2, 1 LIMIT 1",
)
case(
    "top5_top_anomalies", "state year_month ~enrolment_count_sum ~anomaly_score", lambda s, d: ano.top_anomalies(scored_of(s, d)),
    """SELECT state, year_month, enrolment_count_sum, round(anomaly_score, 3) AS anomaly_score FROM scored WHERE is_anomaly = 1
        ORDER BY round(anomaly_score, 3) DESC, state, year_month LIMIT 20""",
)
case("srt1_by_risk", "state ~risk_score", lambda s, d: rsk.by_risk(risk_of(s, d)), "SELECT state, risk_score FROM risk ORDER BY 2 DESC, 1")
case(
    "set1_union_by_name", "#seq state ~enrolment_count ~update_count",
    lambda s, d: readers.union_by_name([trade_fact(s, d).select("seq", "state", "enrolment_count"), event_fact(s, d).select("update_count", "state", "seq")]),
    "SELECT seq, state, enrolment_count, CAST(NULL AS DOUBLE) AS update_count FROM trade UNION ALL SELECT seq, state, NULL, 0.0 FROM event",
)
case("set2_distinct_states", "state", lambda s, d: mrt.distinct_states(trade_fact(s, d)), "SELECT DISTINCT state FROM trade")

# --- profiles ---------------------------------------------------------------

PROFILE_COLS = ("seq", "date", "state", "district", "pincode", "enrolment_count", "update_count", "age_0_18", "age_19_40", "age_41_60", "age_60_plus")
_profile_sql = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) * 100 AS missing_percentage,
    count(DISTINCT {c}) AS unique_values, """
    + (
        f"(SELECT string_agg({c}, '|' ORDER BY seq) FROM (SELECT seq, {c} FROM dirty WHERE {c} IS NOT NULL ORDER BY seq LIMIT 3))"
        if c in ("date", "state", "district", "pincode")
        else "CAST(NULL AS VARCHAR)"
    )
    + " AS samples FROM dirty"
    for c in PROFILE_COLS
)


def _profile(s: SparkSession, d: str) -> DataFrame:
    profile = prf.column_profile(dirty_fact(s, d), "seq").withColumn("samples", F.array_join("sample_values", "|"))
    return profile.withColumnRenamed("column", "name")


def _mostly_missing(s: SparkSession, d: str) -> DataFrame:
    df = trade_fact(s, d)
    return df.select(
        "seq", "state",
        F.when(F.col("seq") % 3 == 0, F.col("district")).alias("district"),
        F.when(F.col("seq") % 5 < 2, F.col("enrolment_count")).alias("enrolment_count"),
        F.when(F.col("seq") % 5 < 3, F.col("update_count")).alias("update_count"),
    )




def _profile_of_months(s: SparkSession, d: str) -> DataFrame:
    """Profile of two years from monthly states, with whether the estimated numbers of different values are close to the exact ones."""
    fact = trade_fact(s, d)
    stored = written(sta.profile_states(fact))
    exact = prf.distinct_counts(fact.where(F.col("date").between("1996-03-01", "1998-02-28"))).withColumnRenamed("unique_values", "exact")
    found = sta.profile_of_states(stored, "1996-03", "1998-02").join(exact, "column")
    return found.withColumn("close", F.abs(F.col("unique_values") / F.col("exact") - 1) < 0.08).withColumnRenamed("column", "name")


case(
    "prf1_profile_of_states", "name #missing_count ~missing_percentage #exact close", _profile_of_months,
    "WITH part AS (SELECT * FROM trade WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-02-28') " + " UNION ALL ".join(
        f"SELECT '{c}' AS name, 0 AS missing_count, 0.0 AS missing_percentage, count(DISTINCT {c}) AS exact, true AS close FROM part"
        for c in ("seq", "date", "state", "district", "enrolment_count", "update_count", "age_0_18", "age_19_40", "age_41_60", "age_60_plus")
    ),
)
case("prf1_column_profile", "name #missing_count ~missing_percentage #unique_values samples", _profile, _profile_sql)
case(
    "prf2_file_summary", "#total_records #total_columns min_date max_date #states_count", lambda s, d: prf.file_summary(trade_fact(s, d)),
    "SELECT count(*) AS total_records, 10 AS total_columns, min(date) AS min_date, max(date) AS max_date, count(DISTINCT state) AS states_count FROM trade",
)
case(
    "prf3_quality_report", "#issue_count #score issues recommendations",
    lambda s, d: prf.quality_report(prf.column_profile(_mostly_missing(s, d)), has_date=False).withColumns({c: F.array_join(c, "|") for c in ("issues", "recommendations")}),
    """SELECT count(t) AS issue_count, 100 - 10 * count(t) AS score, coalesce(string_agg(t, '|' ORDER BY t), '') AS issues,
        CASE WHEN count(t) > 0 THEN 'Consider data imputation for columns with high missing values|' ELSE '' END || 'No date column found. Temporal analysis will be limited' AS recommendations
        FROM (SELECT CASE WHEN p > 50 THEN 'Column ' || chr(39) || c || chr(39) || ' has ' || printf('%.1f', p) || '% missing values' END AS t FROM (
        SELECT 'district' AS c, count(CASE WHEN seq % 3 <> 0 THEN 1 END) / count(*) * 100 AS p FROM trade
        UNION ALL SELECT 'enrolment_count', count(CASE WHEN seq % 5 >= 2 THEN 1 END) / count(*) * 100 FROM trade
        UNION ALL SELECT 'update_count', count(CASE WHEN seq % 5 >= 3 THEN 1 END) / count(*) * 100 FROM trade))""",
)
_stats = lambda c: f"""SELECT '{c}' AS name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
    sum({c}) AS sum, avg(pow({c} - m, 3)) / pow(stddev_pop({c}), 3) AS skewness, kurtosis_pop({c}) AS kurtosis, median({c}) AS median,
    quantile_cont({c}, 0.25) AS percentile_25, quantile_cont({c}, 0.9) AS percentile_90, quantile_cont({c}, 0.95) AS percentile_95
    FROM dirty_small, (SELECT avg({c}) AS m FROM dirty_small) AS mm"""
NUMBERS = ("seq", "enrolment_count", "update_count", "age_0_18", "age_19_40", "age_41_60", "age_60_plus")
case(
    "prf4_numeric_stats", "name #n ~mean ~std ~min ~max ~sum ~skewness ~kurtosis ~median ~percentile_25 ~percentile_90 ~percentile_95",
    lambda s, d: prf.numeric_stats(dirty_fact(s, d).withColumn("seq", F.col("seq") % 1_000_000)).withColumnRenamed("column", "name"),
    "WITH dirty_small AS (SELECT * REPLACE (seq % 1000000 AS seq) FROM dirty) " + " UNION ALL ".join(_stats(c) for c in NUMBERS),
)
case(
    "prf5_pairwise_pearson", "column1 column2 ~correlation",
    lambda s, d: prf.pairwise_pearson(dirty_fact(s, d).withColumn("one", F.lit(0.1))),
    " UNION ALL ".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, {f'corr({a}, {b})' if b != 'one' else 'NULL'} AS correlation FROM {'dirty' if b != 'one' else '(SELECT 1)'}"
        for i, a in enumerate((*NUMBERS, "one")) for b in (*NUMBERS, "one")[i + 1 :]
    ),
)
case(
    "prf6_z_outliers", "#outlier_count ~outlier_percentage #extreme_outlier_count", lambda s, d: prf.z_outliers(trade_fact(s, d)),
    """SELECT count(CASE WHEN abs(z) > 2 THEN 1 END) AS outlier_count, count(CASE WHEN abs(z) > 2 THEN 1 END) / count(*) * 100 AS outlier_percentage,
        count(CASE WHEN abs(z) > 3 THEN 1 END) AS extreme_outlier_count
        FROM (SELECT (enrolment_count - avg(enrolment_count) OVER ()) / stddev_samp(enrolment_count) OVER () AS z FROM trade)""",
)
case("prf6_z_scores", "seq ~z", lambda s, d: prf.z_scores(trade_fact(s, d), "enrolment_count"), "SELECT seq, (enrolment_count - avg(enrolment_count) OVER ()) / stddev_samp(enrolment_count) OVER () AS z FROM trade")
case(
    "prf7_iqr_outliers", "~lower_bound ~upper_bound #iqr_outlier_count", lambda s, d: prf.iqr_outliers(trade_fact(s, d), "enrolment_count"),
    """SELECT max(q1 - 1.5 * (q3 - q1)) AS lower_bound, max(q3 + 1.5 * (q3 - q1)) AS upper_bound,
        count(CASE WHEN enrolment_count < q1 - 1.5 * (q3 - q1) OR enrolment_count > q3 + 1.5 * (q3 - q1) THEN 1 END) AS iqr_outlier_count
        FROM trade, (SELECT quantile_cont(enrolment_count, 0.25) AS q1, quantile_cont(enrolment_count, 0.75) AS q3 FROM trade) AS q""",
)
case(
    "prf8_temporal_outliers", "#temporal_outlier_count", lambda s, d: prf.temporal_outliers(event_fact(s, d), "enrolment_count"),
    """SELECT count(CASE WHEN abs((r - m) / sd) > 2 THEN 1 END) AS temporal_outlier_count FROM (SELECT r, avg(r) OVER () AS m, stddev_samp(r) OVER () AS sd FROM
        (SELECT enrolment_count - avg(enrolment_count) OVER (ORDER BY date, seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r FROM event))""",
)
case(
    "prf9_kpis", "#total_records #total_columns #numeric_columns #total_missing", lambda s, d: prf.kpis(dirty_fact(s, d)),
    """SELECT count(*) AS total_records, 11 AS total_columns, 7 AS numeric_columns,
        5 * count(*) - count(date) - count(state) - count(district) - count(pincode) - count(enrolment_count) AS total_missing FROM dirty""",
)
case("prf10_preview", FACT, lambda s, d: prf.preview(trade_fact(s, d), ["seq"]), "SELECT * FROM trade ORDER BY seq LIMIT 10")

# --- similarity -------------------------------------------------------------

case("sim1_cosine_pairs", "state1 state2 ~similarity", lambda s, d: sim.cosine_pairs(trade_fact(s, d)), "SELECT * FROM similar_pairs WHERE state1 < state2")
case("sim1_similar_pairs", "state1 state2 ~similarity", lambda s, d: sim.similar_pairs(trade_fact(s, d), 0.15), "SELECT * FROM similar_pairs WHERE state1 < state2 AND similarity >= 0.15")
case("sim2_cosine_matrix", "state1 state2 ~similarity", lambda s, d: sim.cosine_matrix(trade_fact(s, d)), "SELECT * FROM similar_pairs")

# --- anomalies --------------------------------------------------------------

_lof = lambda s, d: lof_ops.lof(ml_of(s, d), ["enrolment_count_sum", "mom_growth", "update_ratio"])
_forest = lambda s, d: ifo.isolation_forest(ml_of(s, d), ["enrolment_count_sum", "mom_growth", "update_ratio"])
case("ano1_select_features", "state year_month ~enrolment_count_sum ~mom_growth ~update_ratio", lambda s, d: feat.select_features(ml_of(s, d)), "SELECT * FROM ml")
case(
    "ano2_standardize", "state year_month ~enrolment_count_sum_std ~mom_growth_std",
    lambda s, d: feat.standardize(agg_of(s, d), ["enrolment_count_sum", "mom_growth"]),
    """SELECT state, year_month, (enrolment_count_sum - avg(enrolment_count_sum) OVER ()) / stddev_pop(enrolment_count_sum) OVER () AS enrolment_count_sum_std,
        (coalesce(mom_growth, 0) - avg(coalesce(mom_growth, 0)) OVER ()) / stddev_pop(coalesce(mom_growth, 0)) OVER () AS mom_growth_std FROM agg""",
)
case("ano3_isolation_forest", "state year_month #is_anomaly ~anomaly_score", _forest, models.forest_sql("lof_points", 3))
case("ano4_lof", "state year_month #is_anomaly ~anomaly_score", _lof, "SELECT * FROM lof_scored")
case("ano5_confidence", "state year_month ~anomaly_score anomaly_confidence", lambda s, d: ano.confidence(scored_of(s, d)), "SELECT * FROM banded")
case(
    "ano6_explain", "state period ~anomaly_score confidence primary_reason factors recommended_action",
    lambda s, d: ano.explain(ano.confidence(scored_of(s, d)))
    .withColumn("factors", F.array_join("supporting_factors", "; ")),
    "SELECT * FROM explained",
)
SUMMARY = "#anomaly_count #high_severity_count #states_affected latest_period ~mean_severity top_state"
case("ano7_anomaly_summary", SUMMARY, lambda s, d: ano.anomaly_summary(scored_of(s, d)), """
    SELECT sum(n) AS anomaly_count, sum(high) AS high_severity_count, count(*) AS states_affected, max(latest) AS latest_period, sum(score) / sum(n) AS mean_severity,
      (SELECT state FROM scored WHERE is_anomaly = 1 GROUP BY 1 ORDER BY count(*) DESC, state LIMIT 1) AS top_state
    FROM (SELECT state, count(*) AS n, count(CASE WHEN anomaly_score > 0.8 THEN 1 END) AS high, sum(anomaly_score) AS score, max(year_month) AS latest FROM scored WHERE is_anomaly = 1 GROUP BY 1)""")
case("ano8_anomalies_by_date", "date #anomaly_count", lambda s, d: ano.anomalies_by_date(scored_of(s, d)), "SELECT date, count(*) AS anomaly_count FROM scored WHERE is_anomaly = 1 GROUP BY 1")
case("ano_detect_pipeline", "state year_month #is_anomaly ~anomaly_score anomaly_confidence", lambda s, d: ano.detect_anomalies(ml_of(s, d), "local_outlier_factor"), """
    SELECT *, CASE WHEN r > 0.8 THEN 'VERY_HIGH' WHEN r > 0.6 THEN 'HIGH' WHEN r > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS anomaly_confidence FROM
    (SELECT *, (anomaly_score - min(anomaly_score) OVER ()) / (max(anomaly_score) OVER () - min(anomaly_score) OVER ()) AS r FROM lof_scored)""")

# --- clusters ---------------------------------------------------------------

case("clu1_state_features", FEATURES, lambda s, d: clu.state_features(scored_of(s, d)), "SELECT * FROM state_features")
case("clu2_kmeans", "state #cluster cluster_label", lambda s, d: clu.kmeans_states(clu.state_features(scored_of(s, d)), ClusterCfg()), models.kmeans_sql("state_features", FEATURE_COLS))
case("clu3_silhouette", "~silhouette", lambda s, d: clu.silhouette(labelled_of(s, d), ["total_enrolments", "avg_growth", "avg_update_ratio"]), "SELECT silhouette FROM silhouettes")
case("clu3_squared_silhouette", "~silhouette", lambda s, d: clu.squared_silhouette(labelled_of(s, d), ["total_enrolments", "avg_growth", "avg_update_ratio"]), f"""
    SELECT avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
      SELECT state, max(CASE WHEN c = oc THEN n END) AS size, max(CASE WHEN c = oc AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN c <> oc THEN s / n END) AS b
      FROM (SELECT a.state, a.cluster AS c, b.cluster AS oc, sum({_D3} * {_D3}) AS s, count(*) AS n FROM label_points AS a CROSS JOIN label_points AS b GROUP BY 1, 2, 3) GROUP BY 1)""")
case("clu4_cluster_stats", "#cluster #state_count states ~avg_total_enrolments ~avg_avg_enrolments ~avg_avg_update_ratio ~avg_avg_growth ~avg_anomaly_frequency", lambda s, d: clu.cluster_stats(labelled_of(s, d)), """
    SELECT cluster, count(*) AS state_count, array_to_string(list_sort(list(state))[1:5], ', ') AS states, avg(total_enrolments) AS avg_total_enrolments, avg(avg_enrolments) AS avg_avg_enrolments,
      avg(avg_update_ratio) AS avg_avg_update_ratio, avg(avg_growth) AS avg_avg_growth, avg(anomaly_frequency) AS avg_anomaly_frequency FROM labelled GROUP BY 1""")
case("clu5_describe_clusters", "state #cluster cluster_description ~total_enrolments", lambda s, d: clu.describe_clusters(labelled_of(s, d)), "SELECT * FROM described")
# Nine digits of the larger axis: the second one rests on differences of its squares.
case("clu6_pca_2d", "state ~x ~y", lambda s, d: clu.pca_2d(labelled_of(s, d)).withColumns({c: F.col(c) / 1000 for c in "xy"}), f"SELECT state, x / 1000 AS x, y / 1000 AS y FROM ({models.pca_sql('labelled', FEATURE_COLS)})")

# --- risk -------------------------------------------------------------------

COMPONENTS = "state ~volume_risk ~anomaly_frequency_risk ~anomaly_severity_risk ~volatility_risk ~consistency_risk ~update_pattern_risk"
case("rsk1_risk_components", COMPONENTS, lambda s, d: rsk.risk_components(scored_of(s, d)), "SELECT * FROM components")
case("rsk2_consistency", "state ~consistency_risk", lambda s, d: rsk.risk_components(scored_of(s, d).drop("is_anomaly", "anomaly_score")), "SELECT * FROM components")
case("rsk3_weighted_score", "state ~risk_score", lambda s, d: rsk.weighted_score(rsk.risk_components(scored_of(s, d))), "SELECT * FROM risk")
case("rsk4_risk_level", "state ~risk_score risk_level risk_color", risk_of, "SELECT * FROM risk")
case("rsk5_risk_report", "#total_states #critical_states #high_risk_states ~average_risk_score highest_risk_state ~highest_risk_score", lambda s, d: rsk.risk_report(risk_of(s, d)), """
    SELECT count(*) AS total_states, count(CASE WHEN risk_level = 'CRITICAL' THEN 1 END) AS critical_states, count(CASE WHEN risk_level = 'HIGH' THEN 1 END) AS high_risk_states,
      avg(risk_score) AS average_risk_score, (SELECT state FROM risk ORDER BY risk_score DESC, state LIMIT 1) AS highest_risk_state, max(risk_score) AS highest_risk_score FROM risk""")
case("rsk5_recommendations", "priority action description timeline", lambda s, d: rsk.risk_recommendations(risk_of(s, d)), """
    SELECT 'HIGH' AS priority, 'Immediate Investigation' AS action, 'Critical risk detected in ' || n || ' states: ' || names AS description, '48 hours' AS timeline
      FROM (SELECT count(*) AS n, (SELECT string_agg(state, ', ' ORDER BY risk_score DESC, state) FROM (SELECT * FROM risk WHERE risk_level = 'CRITICAL' ORDER BY risk_score DESC, state LIMIT 5)) AS names FROM risk WHERE risk_level = 'CRITICAL') WHERE n > 0
    UNION ALL SELECT 'MEDIUM', 'Priority Review', 'High risk detected in ' || n || ' states', '1 week' FROM (SELECT count(*) AS n FROM risk WHERE risk_level = 'HIGH') WHERE n > 0
    UNION ALL SELECT 'LOW', 'Continuous Monitoring', 'Regular monitoring of all states with monthly risk assessment', 'Ongoing'""")
case("rsk5_critical_states", "state ~risk_score", lambda s, d: rsk.critical_states(risk_of(s, d)), "SELECT state, risk_score FROM risk WHERE risk_level = 'CRITICAL'")
case("rsk6_level_distribution", "risk_level #state_count ~score_sum", lambda s, d: rsk.level_distribution(risk_of(s, d)), "SELECT risk_level, count(*) AS state_count, sum(risk_score) AS score_sum FROM risk GROUP BY 1")
case(
    "rsk7_blended_risk", "state ~risk_score risk_level",
    lambda s, d: rsk.blended_risk(
        rsk.weighted_score(rsk.risk_components(scored_of(s, d))).select(
            "state", "risk_score", F.col("anomaly_severity_risk").alias("fraud_risk"),
            (1 - F.col("consistency_risk")).alias("data_quality"), F.col("volatility_risk").alias("operational_risk"),
        )
    ),
    """SELECT state, x AS risk_score, CASE WHEN x >= 0.7 THEN 'CRITICAL' WHEN x >= 0.5 THEN 'HIGH' WHEN x >= 0.3 THEN 'MEDIUM' WHEN x >= 0.1 THEN 'LOW' ELSE 'VERY_LOW' END AS risk_level
        FROM (SELECT state, risk_score * 0.4 + anomaly_severity_risk * 0.3 + consistency_risk * 0.2 + volatility_risk * 0.1 AS x FROM risk)""",
)

# --- insights ---------------------------------------------------------------



def _over_tables(rule, finish=lambda df: df) -> Build:
    """A rule over the region-by-month table, its scores and the risk table."""

    def build(s: SparkSession, d: str) -> DataFrame:
        agg = written_agg(s, d)
        scores = scored(agg)
        return finish(rule(agg, scores, rsk.risk_scores(scores, LEVELS)))

    return build


RULE = "type title description severity confidence"
case(
    "ins0_metadata", "start_date end_date #duration_days #total_records #states_covered", lambda s, d: ins.metadata(trade_fact(s, d)),
    """SELECT min(date) AS start_date, max(date) AS end_date, max(date) - min(date) AS duration_days, count(*) AS total_records, count(DISTINCT state) AS states_covered FROM trade""",
)
case(
    "ins1_executive_summary",
    "~total_enrolments ~avg_monthly_enrolments ~avg_growth_pct growth_trend #anomalies_detected ~anomaly_rate_pct #critical_risk_states #high_risk_states findings avg_growth_rate anomaly_rate",
    _over_tables(ins.executive_summary, lambda df: df.withColumn("findings", F.array_join("key_findings", "|"))),
    """SELECT *, CASE WHEN avg_growth_pct > 0 THEN 'positive' ELSE 'negative' END AS growth_trend, printf('%.1f%%', avg_growth_pct) AS avg_growth_rate, printf('%.1f%%', anomaly_rate_pct) AS anomaly_rate,
        array_to_string(list_filter([CASE WHEN total_enrolments > 10000000 THEN 'Large-scale enrolment operations detected' END, CASE WHEN anomaly_rate_pct > 5 THEN 'Higher than expected anomaly rate' END,
          CASE WHEN critical_risk_states > 0 THEN critical_risk_states || ' states require immediate attention' END], lambda x: x IS NOT NULL), '|') AS findings FROM (SELECT
        (SELECT sum(enrolment_count_sum) FROM agg) AS total_enrolments, (SELECT avg(t) FROM (SELECT sum(enrolment_count_sum) AS t FROM agg GROUP BY year_month)) AS avg_monthly_enrolments,
        (SELECT avg(mom_growth) * 100 FROM agg) AS avg_growth_pct, (SELECT sum(is_anomaly) FROM scored) AS anomalies_detected, (SELECT avg(is_anomaly) * 100 FROM scored) AS anomaly_rate_pct,
        (SELECT count(*) FROM risk WHERE risk_level = 'CRITICAL') AS critical_risk_states, (SELECT count(*) FROM risk WHERE risk_level = 'HIGH') AS high_risk_states)""",
)
case("ins2_monthly_change", RULE, lambda s, d: ins.monthly_change(planted_of(s, d)), "SELECT * FROM ins2")
case("ins3_seasonality", RULE, lambda s, d: ins.seasonality(planted_of(s, d)), "SELECT * FROM ins3")
case("ins4_state_disparity", RULE, lambda s, d: ins.state_disparity(planted_of(s, d)), "SELECT * FROM ins4")
case("ins5_temporal_cluster", RULE, lambda s, d: ins.temporal_cluster(planted_scores_of(s, d)), "SELECT * FROM ins5")
case("ins6_geographic_concentration", RULE, lambda s, d: ins.geographic_concentration(planted_scores_of(s, d)), "SELECT * FROM ins6")
case("ins7_high_severity", RULE, lambda s, d: ins.high_severity(planted_scores_of(s, d)), "SELECT * FROM ins7")
case("ins8_critical_risk", RULE, lambda s, d: ins.critical_risk(risk_of(s, d)), "SELECT * FROM ins8")
case(
    "ins9_risk_spread", RULE,
    lambda s, d: ins.risk_spread(risk_of(s, d).withColumn("risk_score", F.col("risk_score") * F.when(F.col("state") < "NATION_17", 6.0).otherwise(1.0))),
    """SELECT 'risk_distribution' AS type, 'Wide Risk Distribution' AS title, 'Significant variability in risk scores across states' AS description, 'MEDIUM' AS severity, 'HIGH' AS confidence
        FROM (SELECT stddev_samp(risk_score * CASE WHEN state < 'NATION_17' THEN 6.0 ELSE 1.0 END) AS sd FROM risk) WHERE sd > 0.3""",
)
case("ins10_cluster_imbalance", RULE, lambda s, d: ins.cluster_imbalance(labelled_of(s, d).withColumn("cluster", F.when(F.col("state") == "NATION_7", 1).otherwise(0))), """
    SELECT 'cluster_imbalance' AS type, 'Uneven State Distribution Across Clusters' AS title, 'Largest cluster has ' || a || ' states, smallest has ' || b AS description, 'LOW' AS severity, 'HIGH' AS confidence
      FROM (SELECT max(n) AS a, min(n) AS b, count(*) AS g FROM (SELECT count(*) AS n FROM labelled GROUP BY CASE WHEN state = 'NATION_7' THEN 1 ELSE 0 END)) WHERE g > 1 AND a > 5 * b""")
case("ins11_strong_cluster", RULE, lambda s, d: ins.strong_cluster(labelled_of(s, d).withColumn("total_enrolments", F.col("total_enrolments") * F.when(F.col("cluster") == 1, 5.0).otherwise(1.0))), """
    SELECT 'cluster_performance' AS type, 'High-Performance Cluster Identified' AS title, 'Cluster ' || (top + 1) || ' shows significantly higher enrolment volumes' AS description, 'MEDIUM' AS severity, 'HIGH' AS confidence
      FROM (SELECT arg_max(cluster, m) AS top, max(m) AS a, min(m) AS b FROM (SELECT cluster, avg(total_enrolments * CASE WHEN cluster = 1 THEN 5.0 ELSE 1.0 END) AS m FROM labelled GROUP BY 1)) WHERE a > 2 * b""")
case("ins_all_insights", "section " + RULE, _all_insights, "SELECT * FROM all_insights")
case("ins12_recommendations", "category action description priority timeline responsible", _over_tables(ins.recommendations), "SELECT * FROM recommended")
case("ins13_dashboard_insights", "type title description action", lambda s, d: ins.dashboard_insights(dash_fact(s, d).withColumn("successful_enrolments", F.col("enrolments") * 0.95), risk_of(s, d)), """
    SELECT 'success' AS type, 'Excellent Performance' AS title, 'Overall success rate: ' || printf('%.1f', r) || '%' AS description, 'Maintain current operational excellence' AS action FROM (SELECT sum(enrolments * 0.95) / sum(enrolments) * 100 AS r FROM dash) WHERE r > 90
    UNION ALL SELECT 'warning', 'Anomalies Detected', n || ' anomalies need review', 'Investigate detected anomalies in Anomalies tab' FROM (SELECT sum(is_anomaly) AS n FROM dash) WHERE n > 0
    UNION ALL SELECT 'danger', 'Critical Risk Detected', n || ' states at critical risk level', 'Immediate action required - check Risks tab' FROM (SELECT count(*) AS n FROM risk WHERE risk_level = 'CRITICAL') WHERE n > 0""")
case("ins14_quick_insights", "top_state #anomaly_count #critical_count critical_states", _over_tables(lambda agg, scores, risk: ins.quick_insights(scores, risk)), """
    SELECT (SELECT state FROM agg GROUP BY 1 ORDER BY sum(enrolment_count_sum) DESC, state LIMIT 1) AS top_state, (SELECT sum(is_anomaly) FROM scored) AS anomaly_count,
      (SELECT count(*) FROM risk WHERE risk_level = 'CRITICAL') AS critical_count,
      (SELECT string_agg(state, ', ' ORDER BY risk_score DESC, state) FROM (SELECT * FROM risk WHERE risk_level = 'CRITICAL' ORDER BY risk_score DESC, state LIMIT 3)) AS critical_states""")

# --- chains -----------------------------------------------------------------


def _analyzed(s: SparkSession, d: str) -> DataFrame:
    """Dirty facts to risk, with outlier factors, saved and read back."""
    made = pipeline.analyze(DIRTY(s, d), CLEAN, model="local_outlier_factor", cluster_cfg=ClusterCfg(restarts=2), risk_cfg=LEVELS)
    base = scratch_path(s, "analysis")
    pipeline.save_analysis(made, base)
    return readers.load_table(s, "risk_scores", base).select("state", "risk_score", "risk_level")


# Of every profile, sums that each of its values has a part in; the same sums in SQL, over the trade facts.
_NUMBERS = ("enrolment_count", "update_count", "age_0_18", "age_19_40", "age_41_60", "age_60_plus")
_over_trade = lambda parts: "SELECT sum(v) AS v FROM (" + " UNION ALL ".join(f"SELECT {p} AS v FROM trade" for p in parts) + ")"
_frequency = lambda c: f"""SELECT sum(n * (n / t) + k * length({c})) AS v FROM (SELECT {c}, count(*) AS n, (SELECT count(*) FROM trade) AS t,
    (SELECT count(DISTINCT {c}) FROM trade) AS k FROM trade GROUP BY 1)"""  # noqa: E731
EXTRACTED = {
    "temporal": ("sum(quarter * 10 + day_of_week + month + days_since_previous)", """
        SELECT sum(quarter(date) * 10 + isodow(date) - 1 + month(date) + d) AS v FROM (SELECT date, date - lag(date) OVER (ORDER BY seq) AS d FROM (SELECT seq, CAST(date AS DATE) AS date FROM trade))"""),
    "state_frequency": ("sum(n_records * frequency + n_distinct * length(value))", _frequency("state")),
    "district_frequency": ("sum(n_records * frequency + n_distinct * length(value))", _frequency("district")),
    "state_totals": ("sum(sqrt(total))", "SELECT sum(sqrt(t)) AS v FROM (SELECT sum(enrolment_count) AS t FROM trade GROUP BY state)"),
    "top_states": ("sum(sqrt(total))", "SELECT sum(sqrt(t)) AS v FROM (SELECT state, sum(enrolment_count) AS t FROM trade GROUP BY state ORDER BY t DESC, state LIMIT 5)"),
    "state_aggregates": ("sum(record_count * avg_enrolments + std_enrolments + total_enrolments)", """
        SELECT sum(n * a + sd + t) AS v FROM (SELECT count(*) AS n, avg(enrolment_count) AS a, stddev_samp(enrolment_count) AS sd, sum(enrolment_count) AS t FROM trade GROUP BY state)"""),
    "state_similarity": ("sum(similarity * similarity)", "SELECT sum(similarity * similarity) AS v FROM similar_pairs WHERE state1 < state2"),
    "demographic": ("sum(sqrt(value))", """
        SELECT sqrt(a) + sqrt(b) + sqrt(c) + sqrt(e) + sqrt(a / t * 100) + sqrt(b / t * 100) + sqrt(c / t * 100) + sqrt(e / t * 100) + sqrt(a / b) + sqrt(b / c) + sqrt(c / e) AS v
        FROM (SELECT sum(age_0_18) AS a, sum(age_19_40) AS b, sum(age_41_60) AS c, sum(age_60_plus) AS e, sum(enrolment_count) AS t FROM trade)"""),
    "statistical": ("sum(mean + std + median + percentile_25 + percentile_90 + kurtosis + min + max)", _over_trade(
        f"avg({c}) + stddev_samp({c}) + median({c}) + quantile_cont({c}, 0.25) + quantile_cont({c}, 0.9) + kurtosis_pop({c}) + min({c}) + max({c})" for c in _NUMBERS)),
    "correlation": ("sum(correlation)", _over_trade(f"corr({a}, {b})" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :])),
    "z_outliers": ("sum(outlier_count + 1000 * extreme_outlier_count)", """
        SELECT count(CASE WHEN abs(z) > 2 THEN 1 END) + 1000 * count(CASE WHEN abs(z) > 3 THEN 1 END) AS v FROM (SELECT (enrolment_count - avg(enrolment_count) OVER ()) / stddev_samp(enrolment_count) OVER () AS z FROM trade)"""),
    "iqr_outliers": ("sum(lower_bound + upper_bound * 10 + iqr_outlier_count)", """
        SELECT max(q1 - 1.5 * (q3 - q1)) + 10 * max(q3 + 1.5 * (q3 - q1)) + count(CASE WHEN enrolment_count < q1 - 1.5 * (q3 - q1) OR enrolment_count > q3 + 1.5 * (q3 - q1) THEN 1 END) AS v
        FROM trade, (SELECT quantile_cont(enrolment_count, 0.25) AS q1, quantile_cont(enrolment_count, 0.75) AS q3 FROM trade) AS q"""),
    "temporal_outliers": ("sum(temporal_outlier_count)", """
        SELECT count(CASE WHEN abs((r - m) / sd) > 2 THEN 1 END) AS v FROM (SELECT r, avg(r) OVER () AS m, stddev_samp(r) OVER () AS sd FROM
        (SELECT enrolment_count - avg(enrolment_count) OVER (ORDER BY date, seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r FROM trade))"""),
}


def _extracted(s: SparkSession, d: str) -> DataFrame:
    """Every profile of the order facts, and of each a sum over its values."""
    made = pipeline.extract_features(trade_fact(s, d))
    out = None
    for k, f in sorted(made.items()):
        row = f.agg(F.expr(EXTRACTED[k][0]).cast("double").alias("value")).select(F.lit(k).alias("feature"), "value")
        out = row if out is None else out.unionByName(row)
    return out


case("pln1_analyze", "state ~risk_score risk_level", _analyzed, "SELECT * FROM chain_risk")
case("pln2_extract_features", "feature ~value", _extracted, " UNION ALL ".join(f"SELECT '{k}' AS feature, v AS value FROM ({sql})" for k, (_, sql) in EXTRACTED.items()))

# --- marts ------------------------------------------------------------------


def _coords(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(
        F.col("n_name").alias("state"), (F.col("n_nationkey") * 1.5).alias("lat"), (F.col("n_regionkey") * 10.0).alias("lon")
    )


case("mrt1_kpi_row", "~total_enrolments_m ~total_success_m ~total_updates_m ~coverage_pct #anomaly_count #active_states", lambda s, d: mrt.kpi_row(dash_fact(s, d)), """
    SELECT sum(enrolments) / 1000000 AS total_enrolments_m, sum(successful_enrolments) / 1000000 AS total_success_m, sum(updates) / 1000000 AS total_updates_m,
      avg(population_coverage) * 100 AS coverage_pct, sum(is_anomaly) AS anomaly_count, count(DISTINCT state) AS active_states FROM dash""")
case("mrt2_trend", "date ~enrolments ~successful_enrolments", lambda s, d: mrt.trend(dash_fact(s, d), ["enrolments", "successful_enrolments"]), "SELECT date, sum(enrolments) AS enrolments, sum(successful_enrolments) AS successful_enrolments FROM dash GROUP BY 1")
case("mrt3_success_rate", "~success_rate_pct", lambda s, d: mrt.success_rate(dash_fact(s, d)), "SELECT sum(successful_enrolments) / sum(enrolments) * 100 AS success_rate_pct FROM dash")
case("mrt4_leaderboard", "state ~enrolments", lambda s, d: mrt.leaderboard(dash_fact(s, d), "enrolments", 8), "SELECT state, sum(enrolments) AS enrolments FROM dash GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
case("mrt5_geo_mart", "state ~enrolments ~success_rate ~population_coverage ~size ~lat ~lon", lambda s, d: mrt.geo_mart(dash_fact(s, d), _coords(s, d)), """
    SELECT g.*, enrolments / max(enrolments) OVER () * 100 AS size, coalesce(n_nationkey * 1.5, 20.5937) AS lat, coalesce(n_regionkey * 10.0, 78.9629) AS lon
      FROM (SELECT state, sum(enrolments) AS enrolments, avg(success_rate) AS success_rate, avg(population_coverage) AS population_coverage FROM dash GROUP BY 1) AS g
      LEFT JOIN nation ON n_name = state""")
case("mrt6_state_series", "state date ~enrolment_count_sum", lambda s, d: mrt.state_series(scored_of(s, d), ["NATION_7", "NATION_3", "NATION_14"]), "SELECT state, date, enrolment_count_sum FROM scored WHERE state IN ('NATION_7', 'NATION_3', 'NATION_14')")
case("mrt7_anomaly_table", "state year_month ~enrolments success_rate anomaly_score", lambda s, d: mrt.anomaly_table(dash_fact(s, d)), """
    SELECT state, year_month, enrolments, printf('%.1f%%', round(success_rate * 100, 1)) AS success_rate, printf('%.1f%%', round(anomaly_score * 100, 1)) AS anomaly_score
      FROM dash WHERE is_anomaly = 1""")
case("mrt8_risk_table", "state ~risk_score risk_level", lambda s, d: rsk.risk_table(risk_of(s, d)), """
    SELECT state, round(risk_score, 3) AS risk_score, CASE risk_level WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' WHEN 'LOW' THEN '🟢' ELSE '⚫' END || ' ' || risk_level AS risk_level FROM risk""")
case(
    "mrt9_filter_facts", FACT,
    lambda s, d: mrt.filter_facts(trade_fact(s, d), ("1996-01-01", "1998-12-31"), ["NATION_7", "NATION_3", "NATION_14", "NATION_17", "NATION_1"], "CRITICAL", risk_of(s, d)),
    """SELECT * FROM trade WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND state IN ('NATION_7', 'NATION_3', 'NATION_14', 'NATION_17', 'NATION_1')
        AND state IN (SELECT state FROM risk WHERE risk_level = 'CRITICAL')""",
)
case("flagship_risk", "state ~risk_score risk_level", lambda s, d: pipeline.flagship(trade_fact(s, d)), "SELECT * FROM flagship")
