"""Readers for raw files and processed tables."""

from __future__ import annotations

import logging
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.functions.expr import month_start, nan_to_null, string_columns
from regionlens.operators.columns import unique_names
from regionlens.sources.ranges import CsvCutter, JsonCutter, records

log = logging.getLogger(__name__)


# Quotes as CSV writers everywhere put them: a quote inside a quoted field is doubled.
CSV = {"header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
MORE, FILE, PLACE = "_more_fields", "_file_name", "_place"


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv", ".csv.gz")) -> list[str]:
    """Files matching ``path`` (file, folder or glob), folders with all below them, listed by Hadoop's FileSystem.

    The suffixes are asked of files found in folders; hidden files and folders are left out.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []

    def visit(status, named: bool) -> None:
        name = status.getPath().getName()
        if not named and name.startswith(("_", ".")):
            return
        if status.isDirectory():
            for entry in fs.listStatus(status.getPath()):
                visit(entry, False)
        elif named or not suffixes or name.endswith(suffixes):
            found.append(status.getPath().toString())

    for status in fs.globStatus(target) or []:
        visit(status, True)
    return sorted(found)


def same_path(path: str) -> str:
    """A path in one spelling, whether or not its scheme is followed by an empty host."""
    return re.sub(r"^([a-z][a-z0-9+.-]*:)/+", r"\1/", path)


def literal(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; a column missing on one side is NULL there.

    A column whose type differs between the sides becomes DOUBLE when all its
    types are numeric, else STRING, so no value is lost to a failed cast.
    """
    kinds = defaultdict(set)
    for frame in frames:
        for f in frame.schema.fields:
            kinds[f.name].add(f.dataType)
    common = {
        c: T.DoubleType() if all(isinstance(t, T.NumericType) for t in types) else T.StringType()
        for c, types in kinds.items()
        if len(types) > 1
    }
    aligned = [
        f.select(*[F.col(f"`{c}`").cast(common[c]).alias(c) if c in common else F.col(f"`{c}`") for c in f.columns])
        for f in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def _path() -> Column:
    """The path of a row's file, in the spelling of :func:`same_path`."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^([a-z][a-z0-9+.-]*:)/+", "$1/")


def _gzip_fault(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Why compressed files cannot be read to their end, NULL if they can."""
    for batch in batches:
        reasons = []
        for value in batch.column("content"):
            data, reason = memoryview(value.as_buffer()), None
            try:
                while len(data) and reason is None:
                    member, at = zlib.decompressobj(31), 0
                    while not member.eof and at < len(data):
                        member.decompress(data[at : at + CHUNK], 16 * CHUNK)
                        at += CHUNK
                        while member.unconsumed_tail:
                            member.decompress(member.unconsumed_tail, 16 * CHUNK)
                    reason = None if member.eof else "the compressed file ends too early"
                    data = data[min(at, len(data)) - len(member.unused_data) :] if member.eof else data[:0]
            except zlib.error as e:
                reason = str(e)
            reasons.append(reason)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(reasons, pa.string())], names=["file", "fault"])


CHUNK = 1 << 20


@dataclass(frozen=True)
class Surveyed:
    header: str | None  # first line; NULL in an empty file
    utf8: bool
    fault: str | None  # why the file cannot be read to its end


def survey(spark: SparkSession, files: list[str], check: bool = False) -> dict[str, Surveyed]:
    """Header, encoding and first fault of every file, from one scan of them all; one short row a file reaches the driver.

    ``check`` also looks whether the files can be read to their end: a file of which nothing can be read, and, in one more
    distributed scan, compressed files that end too early or are damaged.
    """
    if not files:
        return {}
    paths = [literal(f) for f in files]
    lines = spark.read.option("ignoreCorruptFiles", check).text(paths)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    seen = lines.select(_path().alias("file"), "value", place.alias("place")).groupBy("file").agg(
        # A byte order mark is no part of the first name.
        F.regexp_replace(F.min_by("value", "place"), "^\ufeff|\r$", "").alias("header"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.lit(None).cast("string").alias("fault"),
    )
    out = {same_path(f): Surveyed(None, True, None) for f in files}
    out |= {r["file"]: Surveyed(r["header"], r["utf8"], None) for r in seen.collect()}
    if check:
        sizes = spark.read.format("binaryFile").load(paths).select(_path().alias("file"), "length").where("length > 0")
        for r in sizes.toLocalIterator():
            if out[r["file"]].header is None:
                out[r["file"]] = Surveyed(None, True, "nothing can be read")
        packed = [literal(f) for f in files if f.endswith(".gz")]
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(rows)
        spark.conf.set(rows, "1")  # a file is a row
        try:
            content = spark.read.format("binaryFile").load(packed).select(_path().alias("file"), "content") if packed else None
            faults = content.mapInArrow(_gzip_fault, "file string, fault string").where("fault IS NOT NULL").collect() if packed else []
        finally:
            spark.conf.set(rows, before)
        out |= {r["file"]: Surveyed(None, True, r["fault"]) for r in faults}
    return out


def _header_groups(
    spark: SparkSession, files: list[str], any_encoding: bool, on_bad_file: str
) -> tuple[dict[tuple[str, str], list[str]], dict[str, str]]:
    """Files by header line and encoding, and the files set aside with the reason. Empty files are in no group."""
    if on_bad_file not in ("fail", "skip"):
        raise ValueError("on_bad_file is 'fail' or 'skip'")
    found = survey(spark, files, on_bad_file == "skip")
    groups: dict[tuple[str, str], list[str]] = defaultdict(list)
    bad: dict[str, str] = {}
    for file in files:
        seen = found[same_path(file)]
        if seen.fault is not None:
            log.error("cannot read %s: %s", file, seen.fault)
            bad[file] = seen.fault
        elif seen.header:
            groups[seen.header, "ISO-8859-1" if any_encoding and not seen.utf8 else "UTF-8"].append(file)
    return groups, bad


def _group_frame(spark: SparkSession, files: list[str], encoding: str, infer: bool, multi_line: bool) -> DataFrame:
    """Files of one header with one more text column for what exceeds it, the file, its name and the place of each row."""
    if multi_line:
        return _record_frame(spark, files, encoding, infer)
    options = {**CSV, "encoding": encoding}
    paths = [literal(f) for f in files]
    found = spark.read.options(**options).csv(paths, inferSchema=infer).schema
    wide = T.StructType([*found.fields, T.StructField(MORE, T.StringType())])
    # A field over the header would otherwise be dropped in silence.
    rows = spark.read.options(**options).schema(wide).csv(paths)
    place = [F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")]
    return rows.select("*", F.col("_metadata.file_name").alias(FILE), F.struct(_file(), *place).alias(PLACE))


def _texts_as(texts: DataFrame, fmt: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """What Spark's reader of a format makes of the texts of a column instead of the lines of files."""
    spark = texts.sparkSession
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader
    # Spark reads a dataset of texts so; its Python side takes RDDs only.
    lines = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(getattr(reader._jreader, fmt)(lines), spark)


def _record_frame(spark: SparkSession, files: list[str], encoding: str, infer: bool) -> DataFrame:
    """As :func:`_group_frame`, from records that may go over line ends and that many tasks cut from each file."""
    cut = records(spark, [literal(f) for f in files], CsvCutter)
    text = F.decode("text", encoding) if encoding != "UTF-8" else F.col("text").cast("string")
    text = F.regexp_replace(text, "\r$", "")
    cut = cut.select("file", "start", "row", text.alias("text")).where("text <> ''")
    first = F.min(F.struct("start", "row", "text"))
    # Files of a group have one header; of it, one row is enough.
    head = cut.groupBy("file").agg(first.alias("h"))
    header = head.agg(F.min("h.text")).first()[0]
    names = _texts_as(spark.createDataFrame([(header.lstrip("\ufeff"),)], "text string"), "csv", **{**CSV, "multiLine": True}).columns
    body = cut.join(head.select("file", F.col("h.start").alias("s0"), F.col("h.row").alias("r0")), "file").where("NOT (start = s0 AND row = r0)").drop("s0", "r0")
    options = {**CSV, "header": False, "multiLine": True}
    kinds = [T.StringType()] * len(names)
    if infer:
        found = _texts_as(body.select("text"), "csv", **options, inferSchema=True).schema.fields
        kinds = [found[i].dataType if i < len(found) else T.StringType() for i in range(len(names))]
    wide = ", ".join(f"c{i} {t.simpleString()}" for i, t in enumerate([*kinds, T.StringType()]))
    fields = F.from_csv("text", wide, {k: str(v) for k, v in options.items()})
    return body.withColumn("_f", fields).select(
        *[F.col(f"_f.c{i}").alias(c) for i, c in enumerate([*names, MORE])],
        F.substring_index("file", "/", -1).alias(FILE),
        F.struct("file", "start", "row").alias(PLACE),
    )


def _file() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file")


def _union_groups(
    spark: SparkSession, groups: dict[tuple[str, str], list[str]], infer: bool, multi_line: bool,
    provenance: bool, order: str | None, known: dict[str, T.DataType],
) -> DataFrame:
    frames = []
    for header, encoding in sorted(groups):
        df = _group_frame(spark, groups[header, encoding], encoding, infer, multi_line)
        named = df.columns[: df.columns.index(MORE)]
        # Spark's names of columns without a name or with that of another give way to names of their own.
        names = unique_names(df.select(*[F.col(f"`{c}`") for c in named])).columns
        extra = [F.col(FILE).alias("source_file")] if provenance else []
        extra += [F.col(PLACE).alias(order)] if order else []
        rows = df.where(F.col(MORE).isNull()).select(*[F.col(f"`{c}`") for c in named], *extra)
        df = unique_names(rows.toDF(*names, *rows.columns[len(named) :]))
        if known:
            df = df.select(
                *[
                    F.col(f"`{c}`").try_cast(known[c.lower()]).alias(c) if c.lower() in known else F.col(f"`{c}`")
                    for c in df.columns
                ]
            )
        frames.append(nan_to_null(df))
    return union_by_name(frames)


def read_csv_dir(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    infer_types: bool = True,
    provenance: bool = False,
    order: str | None = None,
    multi_line: bool = False,
    on_bad_file: str = "fail",
) -> DataFrame:
    """All CSV files of a folder and the folders below as one table, matched by column name.

    Spark matches the columns of several files by position, so files are
    grouped by their header line and each group is read once.  Only file names
    and header lines reach the driver, from one scan of all files.  With ``schema`` or ``infer_types=False`` the extra pass that
    infers types is saved; columns of ``schema`` get its types, others are text.

    ``order`` names a column with the place of each row in the input (file, then position), to keep
    the first of repeated rows by.  Rows shorter than the header end in NULLs; rows with more fields
    than the header are left out here and returned by :func:`csv_rejects`.  ``multi_line=True`` reads line
    breaks inside quotes, in byte ranges by many tasks, and writes the records it cuts.  A file that cannot be read to its end fails the
    read, or with ``on_bad_file="skip"``, which looks at compressed files once more, is left out as a whole.
    """
    groups, _ = _header_groups(spark, list_files(spark, path), False, on_bad_file)
    if not groups:
        raise ValueError(f"no readable CSV file in {path}")
    known = {f.name.lower(): f.dataType for f in schema.fields} if schema else {}
    return _union_groups(spark, groups, infer_types and schema is None, multi_line, provenance, order, known)


def csv_rejects(
    spark: SparkSession, path: str, multi_line: bool = False, on_bad_file: str = "fail", any_encoding: bool = False
) -> DataFrame:
    """``source_file, reason, fields`` of what the CSV readers leave out.

    Rows with more fields than their header come with those of the header and the first one over; a file set aside comes as one row without
    fields and the error as reason.
    """
    files = list_files(spark, path, () if any_encoding else (".csv", ".csv.gz"))
    groups, bad = _header_groups(spark, files, any_encoding, on_bad_file)
    kind = "source_file string, reason string, fields array<string>"
    out = spark.createDataFrame([(f, why, None) for f, why in sorted(bad.items())], kind)
    for (_, encoding), members in sorted(groups.items()):
        df = _group_frame(spark, members, encoding, False, multi_line)
        fields = df.columns[: df.columns.index(MORE) + 1]
        rows = df.where(F.col(MORE).isNotNull()).select(
            F.col(FILE).alias("source_file"),
            F.lit("more fields than the header").alias("reason"),
            F.array(*[F.col(f"`{c}`") for c in fields]).alias("fields"),
        )
        out = out.unionByName(rows)
    return out


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """JSON file or folder, a record per line; ``multi_line`` reads objects over many lines and top-level arrays of objects.

    Also a file that is one array, in one line or many, is read by as many tasks as it has byte ranges.
    """
    if not multi_line:
        reader = spark.read.schema(schema) if schema else spark.read
        return nan_to_null(reader.json(path))
    cut = records(spark, [literal(f) for f in list_files(spark, path, ())], JsonCutter)
    return nan_to_null(_texts_as(cut.select(F.col("text").cast("string").alias("text")), "json", schema))


def read_csv_any_encoding(
    spark: SparkSession,
    path: str,
    infer_types: bool = True,
    order: str | None = None,
    multi_line: bool = False,
    on_bad_file: str = "fail",
) -> DataFrame:
    """CSV in UTF-8, file by file in Latin-1 where the bytes are not valid UTF-8.

    Takes every file whatever its suffix, otherwise as :func:`read_csv_dir`. Spark does not fail on bytes that are not
    UTF-8, so the scan that finds the headers looks for such lines as well.
    """
    groups, _ = _header_groups(spark, list_files(spark, path, ()), True, on_bad_file)
    if not groups:
        raise ValueError(f"no readable CSV file in {path}")
    return _union_groups(spark, groups, infer_types, multi_line, False, order, {})


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_table(
    spark: SparkSession, name: str, directory: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A processed table; an empty one with the declared schema when it is not there.

    A ``year_month`` key without a date also gives the ``date`` of its month.
    """
    path = f"{directory}/{name}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema or T.StructType([]))
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.options(**CSV)
        if schema is None:
            # Dates and keys stay text; numbers are inferred.
            found = spark.read.options(**CSV).csv(path, inferSchema=True).schema
            times = (T.DateType, T.TimestampType, T.TimestampNTZType)
            reader = reader.schema(
                T.StructType([T.StructField(f.name, T.StringType()) if isinstance(f.dataType, times) else f for f in found])
            )
    df = nan_to_null(reader.format(fmt).load(path))
    return with_month_date(df)


def with_month_date(df: DataFrame) -> DataFrame:
    if "year_month" in df.columns and "date" not in df.columns:
        return df.withColumn("date", month_start(F.date_format("year_month", "yyyy-MM")
                             if "year_month" not in string_columns(df) else F.col("year_month")))
    return df
