"""Sources: a (type, config) record becomes a DataFrame.

Files use Spark's own readers. Databases go through JDBC with a partitioned
read when a partition column is given; vendor systems through their connector
format. Those need the driver or connector jar on the class path.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson"}
# JDBC address, driver class and default port per database.
JDBC = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "redshift": ("jdbc:redshift://{host}:{port}/{database}", "com.amazon.redshift.jdbc42.Driver", 5439),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC", None),
    "duckdb": ("jdbc:duckdb:{database}", "org.duckdb.DuckDBDriver", None),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver", 1521),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
}
# What a source can do by itself.
CAPABILITIES = {
    "file": ("lazy", "sampling", "schema_inference"),
    "memory": ("lazy", "sampling", "row_count"),
    "jdbc": ("lazy", "sql_pushdown", "row_count", "connection_test"),
    "vendor": ("lazy", "sql_pushdown", "row_count", "connection_test"),
    "document": ("schema_inference", "connection_test"),
    "stream": ("streaming", "connection_test"),
}
KIND = {**{k: "file" for k in ("csv", "parquet", "json", "ndjson", "orc")}, "pandas": "memory", "dataframe": "memory",
        **{k: "jdbc" for k in JDBC}, **{k: "vendor" for k in ("bigquery", "snowflake", "databricks")},
        "mongodb": "document", "elasticsearch": "document", "kafka": "stream"}
ENCODINGS = {"utf-8": "UTF-8", "utf8": "UTF-8", "utf-16": "UTF-16", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1"}
# Spark's text readers know no cp1252. It is Latin-1 but for these characters.
CP1252 = {bytes([b]).decode("latin-1"): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}


@dataclass(frozen=True)
class SourceSpec:
    type: str
    config: dict[str, Any] = field(default_factory=dict, hash=False)


def format_of(path: str) -> str:
    """File format by suffix."""
    for suffix, kind in SUFFIXES.items():
        if path.lower().rstrip("/").endswith(suffix):
            return kind
    raise ValueError(f"unknown file type: {path}")


def capabilities(source_type: str) -> tuple[str, ...]:
    return CAPABILITIES[KIND[source_type]]


def read_file(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None,
              delimiter: str = ",", encoding: str = "utf-8", header: bool = True, ignore_errors: bool = False,
              corrupt_column: str | None = None) -> DataFrame:
    """CSV, Parquet, JSON (an array or one document), NDJSON, ORC.

    Without a schema text formats are inferred, which reads them twice: give
    the schema in production. Malformed rows are kept with nulls, dropped with
    ``ignore_errors``, or kept whole in ``corrupt_column``.
    """
    kind = kind or format_of(path)
    if encoding.lower() in ("cp1252", "windows-1252") and kind in ("csv", "json", "ndjson"):
        return from_latin(read_file(spark, path, kind, schema, delimiter, "latin-1", header, ignore_errors, corrupt_column))
    charset = ENCODINGS.get(encoding.lower(), encoding)
    reader: DataFrameReader = spark.read
    if schema is not None:
        if corrupt_column:
            base = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            schema = T.StructType([*base.fields, T.StructField(corrupt_column, T.StringType())])
        reader = reader.schema(schema)
    mode = "DROPMALFORMED" if ignore_errors else "PERMISSIVE"
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "orc":
        return reader.orc(path)
    options: dict[str, Any] = {"mode": mode, "encoding": charset}
    if corrupt_column:
        options["columnNameOfCorruptRecord"] = corrupt_column
    if kind == "csv":
        return reader.options(sep=delimiter, header=header, inferSchema=schema is None, **options).csv(path)
    if kind in ("json", "ndjson"):
        if charset == "UTF-8":
            options.pop("encoding")
        return reader.options(multiLine=kind == "json", **options).json(path)
    raise ValueError(f"unknown format {kind!r}")


def from_latin(df: DataFrame) -> DataFrame:
    """Text read as Latin-1 that was written as cp1252."""
    known = {k: v for k, v in CP1252.items() if v}
    fix = {f.name: F.translate(F.col(f.name), "".join(known), "".join(known.values())) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(fix) if fix else df


def jdbc_options(kind: str, config: dict[str, Any]) -> dict[str, str]:
    url, driver, port = JDBC[kind]
    options = {"url": url.format(host=config.get("host", "localhost"), port=config.get("port") or port, database=config["database"]),
               "driver": config.get("driver", driver)}
    if config.get("query"):
        options["query"] = config["query"]
    else:
        schema = config.get("schema")
        options["dbtable"] = f"{schema}.{config['table']}" if schema else config["table"]
    for key, name in (("user", "user"), ("username", "user"), ("password", "password"), ("fetchsize", "fetchsize")):
        if config.get(key) is not None:
            options[name] = str(config[key])
    if config.get("partition_column"):
        # Spark reads the ranges in parallel; a query must be given as a table for this.
        if "query" in options:
            options["dbtable"] = f"({options.pop('query')}) q"
        options.update(partitionColumn=config["partition_column"], lowerBound=str(config["lower_bound"]),
                       upperBound=str(config["upper_bound"]), numPartitions=str(config.get("num_partitions", 64)))
    return options


def vendor_options(kind: str, config: dict[str, Any]) -> tuple[str, dict[str, str]]:
    """(format, options) of warehouse and document connectors."""
    c = config
    if kind == "bigquery":
        return "bigquery", {"parentProject": c["project"], "table": f"{c['project']}.{c['dataset']}.{c['table']}"}
    if kind == "snowflake":
        out = {"sfURL": f"{c['account']}.snowflakecomputing.com", "sfUser": c["user"], "sfPassword": c["password"],
               "sfDatabase": c["database"], "sfSchema": c.get("schema", "PUBLIC"), "sfWarehouse": c.get("warehouse", "")}
        return "snowflake", {**out, **({"query": c["query"]} if c.get("query") else {"dbtable": c["table"]})}
    if kind == "databricks":
        return "jdbc", {"url": f"jdbc:databricks://{c['host']}:443;httpPath={c['http_path']};AuthMech=3;UID=token;PWD={c['access_token']}",
                        "driver": "com.databricks.client.jdbc.Driver", "dbtable": f"{c.get('catalog', 'main')}.{c.get('schema', 'default')}.{c['table']}"}
    if kind == "mongodb":
        return "mongodb", {"connection.uri": c["uri"], "database": c["database"], "collection": c["collection"]}
    if kind == "elasticsearch":
        hosts = c["hosts"] if isinstance(c["hosts"], str) else ",".join(c["hosts"])
        return "org.elasticsearch.spark.sql", {"es.nodes": hosts, "es.resource": c["index"], **({"es.query": c["query"]} if c.get("query") else {})}
    raise ValueError(f"unknown source type {kind!r}")


def kafka_options(config: dict[str, Any], batch: bool) -> dict[str, str]:
    """Options of a Kafka read. A stream takes at most ``max_messages`` per trigger. A batch with ``max_messages`` and
    the number of ``partitions`` ends at an offset in each, so that about as many messages come (the offsets must
    exist); any other batch ends at the latest offsets."""
    out = {"kafka.bootstrap.servers": config["bootstrap_servers"], "subscribe": config["topic"],
           "startingOffsets": config.get("auto_offset_reset", "earliest")}
    if config.get("group_id"):
        out["kafka.group.id"] = config["group_id"]
    for key, name in (("security_protocol", "kafka.security.protocol"), ("sasl_mechanism", "kafka.sasl.mechanism"),
                      ("sasl_jaas_config", "kafka.sasl.jaas.config")):
        if config.get(key):
            out[name] = config[key]
    if batch and config.get("max_messages") and config.get("partitions"):
        # Offsets are per partition: the batch ends when each has given its share. ``starting_offsets`` are numbers.
        start = config.get("starting_offsets") or [0] * int(config["partitions"])
        share = -(-int(config["max_messages"]) // int(config["partitions"]))
        out["startingOffsets"] = json.dumps({config["topic"]: {str(i): int(x) for i, x in enumerate(start)}})
        out["endingOffsets"] = json.dumps({config["topic"]: {str(i): int(x) + share for i, x in enumerate(start)}})
    elif batch:
        out["endingOffsets"] = "latest"
    else:
        out["maxOffsetsPerTrigger"] = str(config.get("max_messages", 10_000))
    return out


def read(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Batch DataFrame of a source."""
    kind, config = spec.type.lower(), dict(spec.config)
    group = KIND.get(kind)
    if group == "file" or kind == "file":
        path = config.pop("path")
        return read_file(spark, path, None if kind == "file" else kind, **config)
    if kind == "pandas":
        frame = config["frame"]
        return spark.createDataFrame(frame if isinstance(frame, pd.DataFrame) else pd.DataFrame(frame))
    if kind == "dataframe":
        return config["frame"]
    if group == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options(kind, config)).load()
    if kind == "kafka":
        return spark.read.format("kafka").options(**kafka_options(config, True)).load()
    fmt, options = vendor_options(kind, config)
    return spark.read.format(fmt).options(**options).load()


def read_stream(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Streaming DataFrame: Kafka, or a folder that files arrive in."""
    kind, config = spec.type.lower(), dict(spec.config)
    if kind == "kafka":
        return spark.readStream.format("kafka").options(**kafka_options(config, False)).load()
    if KIND.get(kind) == "file":
        reader = spark.readStream.schema(config["schema"])
        if config.get("max_files"):
            reader = reader.option("maxFilesPerTrigger", config["max_files"])
        return reader.format("json" if kind == "ndjson" else kind).load(config["path"])
    raise ValueError(f"{kind} cannot be read as a stream")
