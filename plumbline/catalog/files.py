"""Queries of sources and sinks: tables written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import register, shown, table
from plumbline.operators import privacy, sampling
from plumbline.plans.planner import run
from plumbline.plans.registry import CheckConfig
from plumbline.session import checkpoint_folder
from plumbline.sources.readers import SourceSpec, read, read_file
from plumbline.sources.writers import append_runs, write_masked, write_results, write_sample

SCHEMAS = {"orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"}
TOTALS = "select count(*) as n, sum(o_orderkey)::bigint as keys, count(distinct o_orderpriority) as kinds, max(o_orderdate) as newest from orders"


def place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("o_orderpriority").alias("kinds"),
                  F.max(F.col("o_orderdate").cast("timestamp")).alias("newest"))


def round_trip(kind: str, suffix: str):
    def fn(spark: SparkSession, sf: str) -> DataFrame:
        path, df = place(spark, f"orders{suffix}"), table(spark, sf, "orders")
        if kind == "csv":
            df.write.option("header", True).option("sep", ";").csv(path)
            return totals(read(spark, SourceSpec("csv", {"path": path, "delimiter": ";", "schema": SCHEMAS["orders"]})))
        if kind == "json":
            df.write.json(path)
            return totals(read_file(spark, path, "ndjson", SCHEMAS["orders"]))
        df.write.format(kind).save(path)
        return totals(read(spark, SourceSpec(kind, {"path": path})))
    return fn


def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold one JSON array each, of at most 10,000 orders."""
    path, df = place(spark, "arrays"), table(spark, sf, "orders")
    arrays = df.groupBy(F.floor(F.col("o_orderkey") / 10_000).alias("part")).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return totals(read_file(spark, path, "json", SCHEMAS["orders"]))


def masked_file(spark: SparkSession, sf: str) -> DataFrame:
    out = write_masked(privacy.mask(table(spark, sf, "customer"), ["c_name"], "hash"), place(spark, "masked"), "customer", "hash")
    return read_file(spark, out, "csv", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").select("c_custkey", "c_name")


def sampled_file(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "sample")
    kind = write_sample(sampling.random_sample(table(spark, sf, "events"), 200, ["event_id"]), path, "csv")
    return read_file(spark, path, kind).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


def exported_results(kind: str):
    def fn(spark: SparkSession, sf: str) -> DataFrame:
        path = place(spark, "results")
        result = run(table(spark, sf, "customer"), [CheckConfig("Positive", {"column": "c_acctbal"}), CheckConfig("Null", {"columns": ["c_name"]})])
        write_results(result, path, kind)
        return shown(read_file(spark, path, "ndjson" if kind == "json" else kind, result.schema))
    return fn


def run_table(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "runs")
    append_runs(table(spark, sf, "events").withColumnRenamed("ts", "created_at"), path)
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


for _kind, _suffix in (("csv", ".csv"), ("json", ".ndjson"), ("parquet", ".parquet"), ("orc", ".orc")):
    register(f"source_{_kind}", round_trip(_kind, _suffix), TOTALS)
register("sink_masked", masked_file, "select c_custkey, sha256(c_name) as c_name from customer")
register("sink_sample", sampled_file, "select least(200, count(*)) as n, least(200, count(*)) as ids from events")
register("source_json_array", json_arrays, TOTALS)
RESULTS = ("select 'Positive' as check_name, 'c_acctbal' as column_name, case when count(*) filter (where c_acctbal <= 0) = 0 then 'pass' else 'fail' end as status, "
         "count(*) filter (where c_acctbal <= 0) as unexpected_count, count(c_acctbal) as total_count, null::double as observed from customer union all "
         "select 'Null', 'c_name', case when count(*) = count(c_name) then 'pass' else 'fail' end, count(*) - count(c_name), count(*), null from customer")
for _kind, _name in (("json", "sink_results"), ("csv", "sink_results_csv")):
    register(_name, exported_results(_kind), RESULTS)
register("sink_run_table", run_table, "select ts::date as day, count(*) as n from events group by 1")
