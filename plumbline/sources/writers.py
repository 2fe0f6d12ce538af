"""Sinks for samples, masked tables, check results and lineage events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without them."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields
                           if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))})


def write_sample(df: DataFrame, path: str, source_format: str) -> str:
    """Samples of text sources become Parquet, others keep their format."""
    kind = source_format if source_format in ("parquet", "orc") else "parquet"
    df.write.mode("overwrite").format(kind).save(path)
    return kind


def masked_name(name: str, strategy: str) -> str:
    return f"{name}_masked_{strategy}.csv"


def write_masked(df: DataFrame, folder: str, name: str, strategy: str, fmt: str = "csv") -> str:
    path = f"{folder}/{masked_name(name, strategy)}" if fmt == "csv" else f"{folder}/{name}_masked_{strategy}.{fmt}"
    out = flat(df) if fmt == "csv" else df
    out.write.mode("overwrite").options(**({"header": True} if fmt == "csv" else {})).format(fmt).save(path)
    return path


def write_results(results: DataFrame, path: str, fmt: str = "json") -> None:
    """Check results as JSON lines, CSV or Parquet."""
    out = flat(results) if fmt == "csv" else results
    out.write.mode("overwrite").options(**({"header": True} if fmt == "csv" else {})).format(fmt).save(path)


def append_runs(rows: DataFrame, path: str, time_column: str = "created_at") -> None:
    """Run tables are append-only Parquet partitioned by day."""
    rows.withColumn("day", F.to_date(time_column)).write.mode("append").partitionBy("day").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """One JSON document per line."""
    events.select(F.col("event").alias("value")).write.mode("overwrite").text(path)
