"""Readers, option builders and exports."""

import json

import pandas as pd
import pytest

from plumbline.operators import rules
from plumbline.sources import readers as R
from plumbline.sources import writers as W


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;name\n1;Zoë\n2;Jürgen, Dr. – 5 €\n".encode("cp1252"))
    rows = R.read_file(spark, str(tmp_path / "a.csv"), delimiter=";", encoding="cp1252").collect()
    assert [(r.id, r.name) for r in rows] == [(1, "Zoë"), (2, "Jürgen, Dr. – 5 €")]
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1, "deep": {"list": ["x"]}}, {"id": 2, "deep": {"list": []}}], indent=1))
    assert R.read_file(spark, str(tmp_path / "b.json")).select("deep.list").count() == 2
    (tmp_path / "c.ndjson").write_text('{"id": 1, "a": 1.5}\n{"id": 2, "b": "x"}\nnot json\n')
    assert R.read_file(spark, str(tmp_path / "c.ndjson"), schema="id long, a double, b string").filter("id is not null").count() == 2
    assert R.read_file(spark, str(tmp_path / "c.ndjson"), schema="id long", ignore_errors=True).count() == 2


def test_rows_with_too_many_fields_are_kept(spark, tmp_path):
    (tmp_path / "o.csv").write_text("id,price,address\n1,2.5,12 Main St, Springfield, US\n2,3.5,plain\n")
    df = R.read_file(spark, str(tmp_path / "o.csv"), schema="id long, price double, address string", corrupt_column="bad")
    rows = df.orderBy("id").collect()
    assert [(r.id, r.address) for r in rows] == [(1, "12 Main St"), (2, "plain")]
    assert rows[0].bad == "1,2.5,12 Main St, Springfield, US" and rows[1].bad is None


def test_formats_by_suffix_and_capabilities():
    assert [R.format_of(f"x{s}") for s in (".csv", ".pq", ".parquet", ".json", ".jsonl", ".ndjson")] == ["csv", "parquet", "parquet", "json", "ndjson", "ndjson"]
    with pytest.raises(ValueError):
        R.format_of("x.xls")
    assert "streaming" in R.capabilities("kafka") and "sql_pushdown" in R.capabilities("oracle")


def test_connector_options():
    o = R.jdbc_options("postgresql", {"host": "h", "database": "d", "query": "select 1", "user": "u", "partition_column": "id", "lower_bound": 0, "upper_bound": 10})
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["dbtable"] == "(select 1) q" and "query" not in o and o["numPartitions"] == "64"
    for kind in R.JDBC:
        assert R.jdbc_options(kind, {"database": "d", "table": "t", "schema": "s"})["dbtable"] == "s.t"
    assert R.vendor_options("bigquery", {"project": "p", "dataset": "d", "table": "t"}) == ("bigquery", {"parentProject": "p", "table": "p.d.t"})
    assert R.vendor_options("mongodb", {"uri": "u", "database": "d", "collection": "c"})[0] == "mongodb"
    assert R.vendor_options("elasticsearch", {"hosts": ["a", "b"], "index": "i"})[1]["es.nodes"] == "a,b"
    assert R.kafka_options({"bootstrap_servers": "b", "topic": "t"}, False)["maxOffsetsPerTrigger"] == "10000"
    assert R.kafka_options({"bootstrap_servers": "b", "topic": "t", "security_protocol": "SSL"}, True)["endingOffsets"] == "latest"


def test_memory_and_sinks(spark, tmp_path):
    df = R.read(spark, R.SourceSpec("pandas", {"frame": pd.DataFrame({"a": [1, 2], "b": ["x", "y"]})}))
    assert W.write_sample(df, str(tmp_path / "s"), "csv") == "parquet" and spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert W.write_masked(df, str(tmp_path), "t", "hash").endswith("t_masked_hash.csv")
    W.write_events(df.selectExpr("to_json(struct(*)) as event"), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).count() == 2


def test_rule_export(spark):
    df = spark.createDataFrame([(i, f"m{i}@x.org", float(i)) for i in range(50)], "user_id long, email string, amount double")
    suite = rules.generate_suite(df, "comprehensive")
    names = {(r.column, r.check) for r in suite.collect()}
    assert {("user_id", "Unique"), ("email", "Email"), ("amount", "Range"), ("amount", "NonNegative"), ("email", "NotNull")} <= names
    loaded = json.loads(rules.export_rules(suite, "json"))["rules"]
    assert len(loaded) == len(names)
    import tomllib
    assert len(tomllib.loads(rules.export_rules(suite, "toml"))["rules"]) == len(names)
    assert "- check: Unique" in rules.export_rules(suite, "yaml")
    compile(rules.export_rules(suite, "python"), "suite.py", "exec")
