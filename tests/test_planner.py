"""Runs: fusion, errors, severities, unexpected rows, physical plans."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from plumbline.plans.planner import plan, run, unexpected_rows
from plumbline.plans.registry import CheckConfig as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def text_of(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def rows_of(result):
    return {(r["check"], r["column"]): r for r in result.collect()}


ROW_CHECKS = [C("Null", {"columns": ["l_quantity", "l_tax"]}), C("Between", {"column": "l_quantity", "min_value": 1, "max_value": 40}),
              C("Positive", {"column": "l_extendedprice"}), C("MeanBetween", {"column": "l_discount", "max_value": 1}),
              C("InSet", {"column": "l_returnflag", "value_set": ["A", "N"]}), C("TableNotEmpty"), C("StdBetween", {"column": "l_tax"})]


def test_row_checks_share_one_scan(lineitem):
    text = text_of(run(lineitem, ROW_CHECKS))
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_orderkey" not in schema and "l_shipdate" not in schema
    assert "Arguments: SinglePartition" in text and "PythonUDF" not in text


def test_statistics_requests_are_answered_together(lineitem):
    planned = plan(lineitem, [C("Outlier", {"column": "l_quantity"}), C("IQRAnomaly", {"column": "l_quantity"}), C("ZScoreOutlier", {"column": "l_tax"})])
    assert all(p.error is None for p in planned)
    text = text_of(run(lineitem, [C("Outlier", {"column": "l_quantity"}), C("ZScoreOutlier", {"column": "l_tax"})]))
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 1


def test_key_checks_share_one_count(lineitem):
    checks = [C("Unique", {"column": "l_partkey"}), C("DistinctCount", {"column": "l_partkey"}), C("PrimaryKey", {"column": "l_partkey"}),
              C("UniqueRatio", {"column": "l_partkey"})]
    text = text_of(run(lineitem, checks))
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 1
    # The only window-free shuffles are the value counts and the final row.
    assert "Window" not in text


def test_parent_lookup_counts_keys_before_the_join(spark, lineitem):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    text = text_of(run(lineitem, [C("ForeignKey", {"column": "l_orderkey", "reference_source_id": "o", "reference_column": "o_orderkey"})], {"o": orders}))
    join = min(i for i in (text.find("SortMergeJoin"), text.find("BroadcastHashJoin"), text.find("ShuffledHashJoin")) if i >= 0)
    assert join < text.find("HashAggregate", join) and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_window_over_unpartitioned_rows(spark):
    from plumbline.plans.primitives import adjacent_stats
    events = spark.read.parquet(f"{SF}/events.parquet")
    text = text_of(adjacent_stats(events, ["event_id"], {"v": F.col("value")}, {"up": ("sum", lambda c, p: c("v") > p("v"))}), "extended")
    assert "rangepartitioning" in text
    final = text[text.rfind("== Physical Plan =="):]
    # The single-partition window runs on one row per partition, above an aggregate by partition id.
    single = final.find("Exchange SinglePartition")
    assert single < final.find("hashpartitioning(__pid") and "Sort [o0" in final[final.find("hashpartitioning(__pid"):] or "o0" in final


def test_a_broken_check_becomes_an_error_row(lineitem):
    out = rows_of(run(lineitem, [*ROW_CHECKS, C("Positive", {"column": "nope"}), C("Nonsense"), C("Between", {"column": "l_tax"}),
                                 C("ForeignKey", {"column": "l_orderkey", "reference_source_id": "gone", "reference_column": "x"}),
                                 C("Outlier", {"column": "missing"}), C("Outlier", {"column": "l_tax"})]))
    assert sum(r.status == "error" for r in out.values()) == 5
    assert out[("Between", "l_quantity")].status == "fail" and out[("Null", "l_tax")].status == "pass"
    assert out[("Outlier", "l_tax")].total_count == lineitem.count()
    with pytest.raises(ValueError):
        run(lineitem, [C("Nonsense")], catch_exceptions=False)


def test_severity_filter_and_override(lineitem):
    checks = [C("NotNull", {"column": "l_tax"}), C("Null", {"columns": ["l_tax"]}, severity="low"), C("Positive", {"column": "l_tax"}, enabled=False)]
    assert {(r["check"], r.severity) for r in run(lineitem, checks).collect()} == {("NotNull", "critical"), ("Null", "low")}
    assert {r["check"] for r in run(lineitem, checks, min_severity="high").collect()} == {"NotNull"}


def test_unexpected_rows(spark, lineitem):
    bad = unexpected_rows(lineitem, C("Between", {"column": "l_quantity", "min_value": 1, "max_value": 40}), limit=None)
    assert bad.count() == lineitem.filter("l_quantity > 40").count() > 0
    assert unexpected_rows(lineitem, C("Between", {"column": "l_quantity", "min_value": 1, "max_value": 40}), limit=3).count() == 3
    few = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderstatus = 'F'")
    lost = unexpected_rows(lineitem, C("ForeignKey", {"column": "l_orderkey", "reference_source_id": "o", "reference_column": "o_orderkey"}), {"o": few}, limit=None)
    assert lost.count() == lineitem.join(few, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count() > 0
    with pytest.raises(ValueError):
        unexpected_rows(lineitem, C("RowCount", {"expected": 3}))


def test_many_checks_are_chunked(lineitem):
    checks = [C("Between", {"column": c, "min_value": i, "max_value": 10 ** 7}) for i in range(60) for c in ("l_quantity", "l_extendedprice")]
    out = run(lineitem, checks).collect()
    assert len(out) == 120 and all(r.status in ("pass", "fail") for r in out)


def test_only_expressions_that_can_fail_run_at_once(lineitem):
    from plumbline.plans.planner import cannot_fail
    good = ["l_quantity > 0", "l_extendedprice * (1 - l_discount) >= 0", "l_linenumber in (1, 2) or not (l_tax is null)", "l_partkey between 1 and 5"]
    bad = ["1 / l_quantity > 0", "l_linenumber + 1 > 0", "l_returnflag > 3", "cast(l_tax as int) > 1", "abs(l_tax) > 1", "l_tax % 2 = 0", "nope > 1", "l_returnflag = 'A'"]
    assert all(cannot_fail(lineitem, x) for x in good) and not any(cannot_fail(lineitem, x) for x in bad)
    text = text_of(run(lineitem, [*ROW_CHECKS, *[C("RowLevel", {"expression": x}) for x in good]]))
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 1
    mixed = text_of(run(lineitem, [*ROW_CHECKS, C("RowLevel", {"expression": "1 / l_linenumber > 0"})]))
    assert len(re.findall(r"^\(\d+\) Scan parquet", mixed, re.M)) == 1
