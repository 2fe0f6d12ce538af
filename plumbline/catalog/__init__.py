"""Everything the engine registers, by query name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.catalog import checks_relations, checks_rows, checks_values, files, governance, profiles, streams  # noqa: F401
from plumbline.catalog.base import ORACLES, QUERIES, shown, table
from plumbline.plans.planner import run
from plumbline.plans.registry import CheckConfig


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A mixed check run: row checks and statistics in one scan, keys by
    counted groups, the reference by counted keys."""
    configs = [
        CheckConfig("Null", {"columns": ["l_quantity", "l_shipdate"]}),
        CheckConfig("Between", {"column": "l_quantity", "min_value": 1, "max_value": 50}),
        CheckConfig("InSet", {"column": "l_returnflag", "value_set": ["A", "N", "R"]}),
        CheckConfig("MeanBetween", {"column": "l_discount", "min_value": 0.0, "max_value": 0.1}),
        CheckConfig("Outlier", {"column": "l_extendedprice"}),
        CheckConfig("CompoundKey", {"columns": ["l_orderkey", "l_linenumber"]}),
        CheckConfig("ForeignKey", {"column": "l_orderkey", "reference_source_id": "orders", "reference_column": "o_orderkey"}),
    ]
    return shown(run(table(spark, sf, "lineitem"), configs, {"orders": table(spark, sf, "orders")}))
