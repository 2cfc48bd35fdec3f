"""Writers for tables and insight documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# A quote inside a field is doubled, which every CSV reader understands; blanks around a text belong to it.
CSV_OUT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def save_table(
    df: DataFrame,
    name: str,
    directory: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: tuple[str, ...] = (),
) -> str:
    """Write ``df`` below ``directory``; CSV gets a header and joins arrays with ``; ``."""
    path = f"{directory}/{name}"
    if fmt == "csv":
        df = df.select(
            *[
                F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name)
                if isinstance(f.dataType, T.ArrayType)
                else F.col(f.name)
                for f in df.schema.fields
            ]
        )
    if partition_by:
        # One task per partition value would meet a hot month; let AQE split it.
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(fmt).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.options(**CSV_OUT)
    writer.save(path)
    return path


def save_insights(insights: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Insight rows as JSON lines."""
    insights.write.mode(mode).json(path)
    return path
