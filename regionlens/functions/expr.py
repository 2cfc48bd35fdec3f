"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.config import REGION_ALIASES


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere after ingest; NaN would poison sums and averages."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def region_name(c: Column) -> Column:
    """Title-cased region name with outdated spellings replaced."""
    known = F.create_map(*[F.lit(v) for pair in REGION_ALIASES.items() for v in pair])
    return F.coalesce(known[F.upper(F.trim(c))], title_case(c))


def district_name(c: Column) -> Column:
    return F.regexp_replace(title_case(c), r"[^a-zA-Z\s]", "")


def pincode(c: Column) -> Column:
    """The first run of six digits, NULL when there is none."""
    return F.regexp_substr(F.trim(c.cast("string")), F.lit(r"\d{6}"))


def parse_timestamp(df: DataFrame, name: str, formats: Sequence[str] = ()) -> Column:
    """NTZ timestamp of a date, timestamp or text column; NULL when it does not parse."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    text = F.trim(c.cast("string"))
    return F.coalesce(
        text.try_cast("timestamp_ntz"),
        *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats],
    )


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_start(c: Column) -> Column:
    """Date of the first day of a ``yyyy-MM`` key."""
    return F.to_date(F.concat(c, F.lit("-01")))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def level_of(score: Column, cuts: Sequence[tuple[str, float]], lowest: str) -> Column:
    """Name of the first cut whose bound the score reaches."""
    out = None
    for name, bound in cuts:
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return out.otherwise(lowest)


def pick(c: Column, table: dict[str, str], default: str) -> Column:
    """Literal lookup of a text value."""
    known = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(known[c], F.lit(default))


def one_value(df: DataFrame) -> Column:
    """The single row of a global aggregate as one struct-valued scalar subquery.

    The subquery runs once and its value is inlined, so no join is planned.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("v")).scalar()


def side_by_side(spark: SparkSession, *frames: DataFrame) -> DataFrame:
    """Columns of several one-row aggregates in one row."""
    packed = spark.range(1).select(*[one_value(f).alias(f"f{i}") for i, f in enumerate(frames)])
    return packed.select(*[f"f{i}.*" for i in range(len(frames))])


def ordered_names(entries: Column) -> Column:
    """Join the ``state`` fields of a small array of structs in the order of its sort key."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e["state"]), ", ")
