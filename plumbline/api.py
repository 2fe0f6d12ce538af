"""The seven verbs, on DataFrames.

    from plumbline import api
    api.check(df, [api.CheckConfig("NotNull", {"column": "id"})])
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import drift, privacy, rules
from plumbline.operators import profile as profiles
from plumbline.operators.checks.schema import as_schema
from plumbline.plans.planner import run, unexpected_rows
from plumbline.plans.registry import SEVERITIES, CheckConfig, by_category, check as register_check, find, search

__all__ = ["CheckConfig", "by_category", "check", "compare", "find", "generate_suite", "learn", "mask", "profile", "register_check", "scan",
           "search", "summary", "unexpected_rows"]


def check(df: DataFrame, configs: Sequence[CheckConfig] | None = None, refs: dict[str, DataFrame] | None = None, as_of: Any = None,
          schema: Any = None, auto_schema: bool = False, min_severity: str | None = None, result_format: str = "summary",
          catch_exceptions: bool = True, include_unexpected_rows: bool = False, max_unexpected_rows: int = 1000) -> DataFrame:
    """Run checks; one result row per check and column.

    ``schema`` adds a TableSchema check; ``auto_schema`` adds the rules learned
    from the table itself. ``result_format`` boolean_only keeps the verdict,
    basic adds the counts, summary and complete keep every column. The rows a
    check rejects come from ``unexpected_rows``, or as JSON in a column of that
    name with ``include_unexpected_rows``.
    """
    wanted = list(configs or ())
    if schema is not None:
        wanted.append(CheckConfig("TableSchema", {"schema": as_schema(schema)}))
    if auto_schema or (not wanted):
        wanted += rules.suite_configs(rules.generate_suite(df, "default"))
    out = run(df, wanted, refs, as_of, min_severity, catch_exceptions, include_unexpected_rows, max_unexpected_rows)
    keep = {"boolean_only": ["check", "column", "status"],
            "basic": ["check", "column", "severity", "status", "unexpected_count", "total_count"]}.get(result_format)
    return out.select(*keep, *(["unexpected_rows"] if include_unexpected_rows else [])) if keep else out


def summary(result: DataFrame) -> DataFrame:
    """One row for a run: verdict and failures by severity."""
    bad = F.col("status") != "pass"
    return result.agg((F.count_if(bad) == 0).alias("passed"), F.count(F.lit(1)).alias("checks"), F.count_if(bad).alias("failed"),
                      F.count_if(F.col("status") == "error").alias("errors"),
                      *[F.count_if(bad & (F.col("severity") == s)).alias(s) for s in reversed(SEVERITIES)])


def learn(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return profiles.learn(df, columns)


def profile(df: DataFrame, columns: Sequence[str] | None = None, **options: Any) -> DataFrame:
    return profiles.profile(df, columns, **options)


def compare(baseline: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, method: str = "auto",
            threshold: float | None = None) -> DataFrame:
    return drift.compare(baseline, current, columns, method, threshold)


def scan(df: DataFrame, columns: Sequence[str] | None = None, regulations: Sequence[str] | None = None,
         min_confidence: float = 0.0) -> DataFrame:
    """Personal data found, or with ``regulations`` the violations."""
    found = privacy.scan(df, columns, min_confidence=min_confidence)
    return privacy.violations(found, regulations) if regulations else found


def mask(df: DataFrame, columns: Sequence[str] | None = None, strategy: str = "redact") -> DataFrame:
    return privacy.mask(df, columns, strategy)


def generate_suite(df: DataFrame, preset: str = "default", columns: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    return rules.generate_suite(df, preset, columns, exclude)
