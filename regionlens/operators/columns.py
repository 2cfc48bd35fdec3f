"""Resolving columns of unknown tables to the canonical schema.

Name resolution looks at metadata only.  What depends on the content (a date column no name rule claims, the
order of day and month, numbers kept as text) is decided by one aggregate over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.config import COLUMN_ALIASES, COLUMN_PATTERNS, COUNT_WORDS, DATE_FORMATS, MISSING, NUMERIC_WORDS
from regionlens.functions.expr import numeric_columns, parse_timestamp
from regionlens.functions.globalindex import with_global_index


def unique_names(df: DataFrame) -> DataFrame:
    """Make column names differ also when case is ignored (``date``, ``Date`` -> ``Date_2``).

    A new name never takes one that is already there (``a, A, A_2`` -> ``a, A_3, A_2``).
    """
    return df.toDF(*_distinct(df.columns))


def _distinct(columns: list[str]) -> list[str]:
    taken = {c.lower() for c in columns}
    seen: set[str] = set()
    names = []
    for c in columns:
        name, n = c, 1
        if c.lower() in seen:
            while name.lower() in taken:
                n += 1
                name = f"{c}_{n}"
            taken.add(name.lower())
        seen.add(name.lower())
        names.append(name)
    return names


def _rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])


def standardize_columns(df: DataFrame, mapping: dict[str, list[str]] = COLUMN_ALIASES) -> DataFrame:
    """Rename the first alias present of each canonical column.

    A column is claimed once, and a name already in use is never produced
    twice: another column that carries it keeps its data under ``<name>_raw``.
    """
    by_lower = {}
    for c in df.columns:
        by_lower.setdefault(c.lower(), c)
    renamed: dict[str, str] = {}
    for canonical, aliases in mapping.items():
        hit = next(
            (by_lower[a.lower()] for a in aliases if a.lower() in by_lower and by_lower[a.lower()] not in renamed),
            None,
        )
        if hit is not None:
            renamed[hit] = canonical
    taken = {v.lower() for v in renamed.values()}
    taken_raw = taken | {c.lower() for c in df.columns}
    for c in df.columns:
        if c not in renamed and c.lower() in taken:
            name = f"{c}_raw"
            while name.lower() in taken_raw:
                name += "_raw"
            taken_raw.add(name.lower())
            renamed[c] = name
    return _rename(df, renamed)


@dataclass(frozen=True)
class Detected:
    original: str
    standard: str
    confidence: str
    kind: str


def match_names(columns: list[str], patterns: dict[str, list[str]] = COLUMN_PATTERNS) -> list[Detected]:
    """Map column names to canonical names by regular expression.

    A column that already carries a canonical name keeps it.  Then every
    canonical name takes an exact match, then those left take a partial match
    among unclaimed columns.  Patterns are tried in their order, columns in
    table order, and a claimed column is never claimed again.
    """
    found: dict[str, Detected] = {}
    claimed: set[str] = set()

    def claim(standard: str, column: str) -> None:
        exact = any(re.fullmatch(p, column, re.IGNORECASE) for p in patterns[standard])
        claimed.add(column)
        found[standard] = Detected(column, standard, "HIGH" if exact else "MEDIUM", "name")

    def search(standard: str, test) -> None:
        for pattern in patterns[standard]:
            for c in columns:
                if c not in claimed and test(pattern, c, re.IGNORECASE):
                    return claim(standard, c)

    for c in columns:
        if c.lower() in patterns and c.lower() not in found:
            claim(c.lower(), c)
    for test in (re.fullmatch, re.search):
        for standard in patterns:
            if standard not in found:
                search(standard, test)
    return [found[s] for s in patterns if s in found]


DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def date_columns(df: DataFrame, columns: list[str], formats: Sequence[str] = DATE_FORMATS, min_share: float = 1.0) -> list[str]:
    """Those of the columns whose values are dates: all present ones, or at least ``min_share`` of them.

    One aggregate counts present and parsed values of every text column.
    """
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return [c for c in columns if isinstance(df.schema[c].dataType, DATES)]
    counts = df.agg(
        *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(texts)],
        *[F.count(parse_timestamp(df, c, formats)).alias(f"d{i}") for i, c in enumerate(texts)],
    ).first()
    dated = {c for i, c in enumerate(texts) if counts[f"n{i}"] and counts[f"d{i}"] >= min_share * counts[f"n{i}"]}
    return [c for c in columns if c in dated or isinstance(df.schema[c].dataType, DATES)]


def looks_like_date(df: DataFrame, column: str, formats: Sequence[str] = DATE_FORMATS, min_share: float = 1.0) -> bool:
    """Whether the values present in the column are dates."""
    return bool(date_columns(df, [column], formats, min_share))


def date_formats(df: DataFrame, column: str, day_first: bool | None = None) -> tuple[str, ...]:
    """Formats for a text column, with day and month in the order its values show.

    One aggregate counts the dates that only one order can read. Without any such date, or with
    some for each order, the order is not told by the column: give ``day_first``, or where
    numbers differ in meaning this is an error.
    """
    pairs = (("M/d/yyyy", "d/M/yyyy"), ("M-d-yyyy", "d-M-yyyy"))
    if isinstance(df.schema[column].dataType, DATES):
        return DATE_FORMATS
    if day_first is None:
        text = F.col(f"`{column}`").cast("string")
        read = lambda f: F.try_to_timestamp(text, F.lit(f))
        either = lambda i: F.coalesce(*[read(p[i]) for p in pairs])
        month, day = either(0), either(1)
        m, d, both = df.agg(
            F.count_if(month.isNotNull() & day.isNull()), F.count_if(day.isNotNull() & month.isNull()), F.count_if(month != day)
        ).first()
        if (both or (m and d)) and bool(m) == bool(d):
            raise ValueError(f"day and month of {column} cannot be told apart; say day_first=True or False")
        day_first = d > 0
    order = [p[int(day_first)] for p in pairs]
    return (*order, *[f for f in DATE_FORMATS if not any(f in p for p in pairs)])


def detect(
    df: DataFrame, patterns: dict[str, list[str]] = COLUMN_PATTERNS, formats: Sequence[str] = DATE_FORMATS, min_share: float = 1.0
) -> list[Detected]:
    """Name rules, then a date column by content, then a count column by name and type.

    Only text and date columns are tried as dates: numbers would always parse.
    """
    found = match_names(df.columns, patterns)
    standards = {d.standard for d in found}
    claimed = {d.original for d in found}
    if "date" not in standards:
        for c in date_columns(df, [c for c in df.columns if c not in claimed], formats, min_share)[:1]:
            found.append(Detected(c, "date", "HIGH", "auto_detected_date"))
            claimed.add(c)
    if "enrolment_count" not in standards:
        for c in numeric_columns(df):
            if c not in claimed and any(w in c.lower() for w in COUNT_WORDS):
                found.append(Detected(c, "enrolment_count", "MEDIUM", "auto_detected_numeric"))
                break
    return found


def detect_schema(df: DataFrame, patterns: dict[str, list[str]] = COLUMN_PATTERNS) -> DataFrame:
    """``(original, standard, confidence, kind)``, one row per resolved column."""
    return df.sparkSession.createDataFrame(
        [(d.original, d.standard, d.confidence, d.kind) for d in detect(df, patterns)],
        "original string, standard string, confidence string, kind string",
    )


def apply_detected(df: DataFrame, found: list[Detected]) -> DataFrame:
    return _rename(df, {d.original: d.standard for d in found})


def fill_required(df: DataFrame, order_by: list[str], start: str = "2023-01-01") -> DataFrame:
    """Add the columns every report needs when a table lacks them.

    A missing date counts days from ``start`` in the order of ``order_by``.
    """
    if "date" not in df.columns:
        df = (
            with_global_index(df, order_by, "_row")
            .withColumn("date", F.date_add(F.lit(start).cast("date"), F.col("_row").cast("int")).cast("timestamp_ntz"))
            .drop("_row")
        )
    if "state" not in df.columns:
        df = df.withColumn("state", F.lit("Unknown_State"))
    if "enrolment_count" not in df.columns:
        df = df.withColumn("enrolment_count", F.lit(1.0))
    return df


def _number(column: Column) -> Column:
    """The value of a text as a number, NULL for texts that stand for a missing one."""
    text = F.trim(column.cast("string"))
    value = F.when(~F.lower(text).isin(*MISSING), text.try_cast("double"))
    return F.nanvl(value, F.lit(None).cast("double"))


def standardize_types(df: DataFrame, formats: Sequence[str] = DATE_FORMATS, coerce: bool = True) -> DataFrame:
    """Dates to timestamps, count-like columns to DOUBLE, names to text.

    A column is count-like when one of its name's words is (``total_count``, not ``country``). Values that do
    not parse become NULL; with ``coerce=False`` a text column with such values stays as it is,
    which one aggregate over all of them tells.
    """
    kept = ("date", "state", "district", "pincode")
    counts = [
        f.name
        for f in df.schema.fields
        if f.name not in kept
        and isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType))
        and set(re.split("[^a-z]+", f.name.lower())) & set(NUMERIC_WORDS)
    ]
    texts = [c for c in counts if isinstance(df.schema[c].dataType, T.StringType)]
    if texts and not coerce:
        odd = lambda c: F.count_if(F.col(f"`{c}`").isNotNull() & ~F.lower(F.trim(f"`{c}`")).isin(*MISSING) & F.col(f"`{c}`").try_cast("double").isNull())  # noqa: E731, E501
        bad = df.agg(*[odd(c).alias(str(i)) for i, c in enumerate(texts)]).first()
        counts = [c for c in counts if c not in texts or not bad[str(texts.index(c))]]
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c == "date":
            col = parse_timestamp(df, "date", formats)
        elif c in kept:
            col = col.cast("string")
        elif c in counts:
            text = isinstance(df.schema[c].dataType, T.StringType)
            col = _number(col) if text else F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))
        out.append(col.alias(c))
    return df.select(*out)


def process_any(df: DataFrame, order_by: list[str], day_first: bool | None = None) -> tuple[DataFrame, list[Detected]]:
    """Detect, rename, fill and type any table; no value is lost to a type that does not fit its column."""
    found = detect(df)
    named = apply_detected(df, found)
    formats = date_formats(named, "date", day_first) if "date" in named.columns else DATE_FORMATS
    return standardize_types(fill_required(named, order_by), formats, coerce=False), found
