"""Routing rules over run events, as boolean columns, and rule matching."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("info", "low", "medium", "high", "critical")


def level(c: Column) -> Column:
    """Rank of a severity; unknown ones rank lowest."""
    return F.greatest(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower(c)) - 1, F.lit(0))


def severity_at_least(minimum: str) -> Column:
    return F.col("severity").isNotNull() & (level(F.col("severity")) >= LEVELS.index(minimum))


def issues_at_least(n: int) -> Column:
    return F.coalesce(F.col("issue_count") >= n, F.lit(False))


def pass_rate_at_most(rate: float) -> Column:
    return F.coalesce(F.col("pass_rate") <= rate, F.lit(False))


def in_hours(start: int = 9, end: int = 17, weekdays: Sequence[int] = (0, 1, 2, 3, 4), timezone: str | None = None) -> Column:
    """Hour and weekday (0 = Monday) of the event; start after end is overnight."""
    ts = F.col("ts").cast("timestamp")
    ts = F.from_utc_timestamp(ts, timezone) if timezone else ts
    h = F.hour(ts)
    inside = (h >= start) & (h < end) if start <= end else (h >= start) | (h < end)
    return F.weekday(ts).isin(list(weekdays)) & inside


def has_tags(tags: Sequence[str], match_all: bool = False) -> Column:
    wanted = F.array(*[F.lit(t) for t in tags])
    if not tags:
        return F.lit(True)
    own = F.coalesce("tags", F.array().cast("array<string>"))
    return F.size(F.array_intersect(own, wanted)) == len(set(tags)) if match_all else F.arrays_overlap(own, wanted)


def glob_regex(pattern: str) -> str:
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return f"^{body}$"


def asset_like(pattern: str) -> Column:
    return F.coalesce(F.lower("asset").rlike(glob_regex(pattern)), F.lit(False))


def metadata_matches(key: str, op: str, value: Any) -> Column:
    """Comparison with an entry of the metadata map (text values)."""
    actual = F.try_element_at("metadata", F.lit(key))
    number, wanted = actual.try_cast("double"), F.lit(str(value))
    tests = {"eq": lambda: actual == wanted, "ne": lambda: actual != wanted, "contains": lambda: actual.contains(str(value)),
             "regex": lambda: actual.rlike(str(value)), "gt": lambda: number > float(value), "lt": lambda: number < float(value),
             "gte": lambda: number >= float(value), "lte": lambda: number <= float(value), "exists": lambda: actual.isNotNull()}
    return F.coalesce(tests[op](), F.lit(False))


def status_in(statuses: Sequence[str]) -> Column:
    return F.coalesce(F.lower("status").isin([s.lower() for s in statuses]), F.lit(False))


def error_matches(pattern: str) -> Column:
    return F.coalesce(F.col("error").rlike(f"(?i){pattern}"), F.lit(False))


def always() -> Column:
    return F.lit(True)


def never() -> Column:
    return F.lit(False)


def expression(text: str) -> Column:
    """A user's Spark SQL predicate over the event's columns."""
    return F.coalesce(F.expr(text), F.lit(False))


def all_of(*rules: Column) -> Column:
    return reduce(lambda a, b: a & b, rules, F.lit(True))


def any_of(*rules: Column) -> Column:
    return reduce(lambda a, b: a | b, rules, F.lit(False))


def negate(rule: Column) -> Column:
    return ~rule


def route(events: DataFrame, routes: dict[str, Column], event_id: str = "event_id") -> DataFrame:
    """(event, route) for every rule that matches; each event is read once."""
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in routes.items()]))
    return events.select(F.col(event_id).alias("event"), F.explode(names).alias("route"))


# Which rule conditions an event type can meet.
CONDITIONS = {"validation_failed": ("validation_failed", "critical_issues", "high_issues"),
              "schedule_failed": ("schedule_failed", "validation_failed"), "drift_detected": ("drift_detected",),
              "schema_changed": ("schema_changed", "breaking_schema_change"), "test": ()}


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(event_id, rule_id) of active rules an event meets.

    ``events``: event_id, event_type, source_id, has_critical, has_high,
    has_breaking; ``rules``: rule_id, condition, source_ids, is_active.
    """
    table = F.create_map(*[x for k, v in CONDITIONS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]).cast("array<string>"))])
    able = events.withColumn("condition", F.explode(F.coalesce(F.try_element_at(table, F.col("event_type")), F.array("event_type"))))
    able = able.filter((F.col("condition") != "critical_issues") | F.col("has_critical")).filter(
        (F.col("condition") != "high_issues") | F.col("has_critical") | F.col("has_high")).filter(
        (F.col("condition") != "breaking_schema_change") | F.col("has_breaking"))
    able = able.select("event_id", "condition", "source_id")
    active = rules.filter("is_active").select("rule_id", "condition", "source_ids")
    # Rules for named sources meet the events of those sources only.
    named = active.select("rule_id", "condition", F.explode("source_ids").alias("source_id"))
    open_ = active.filter(F.col("source_ids").isNull() | (F.size("source_ids") == 0)).select("rule_id", "condition")
    return (able.join(named, ["condition", "source_id"]).select("event_id", "rule_id")
            .unionByName(able.join(open_, "condition").select("event_id", "rule_id")).distinct())


def fingerprint(parts: dict[str, Column]) -> Column:
    """First 32 hex digits of SHA-256 over the sorted ``name:value`` parts."""
    items = F.array_compact(F.array(*[F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{k}:"), v.cast("string")))
                                      for k, v in parts.items()]))
    return F.substring(F.sha2(F.array_join(F.array_sort(items), "|"), 256), 1, 32)


def policy_fingerprint(policy: str, checkpoint: Column, action: Column, severity: Column | None = None, issues: Column | None = None,
                       ts: Column | None = None, bucket_seconds: int = 300, event: Column | None = None, **custom: Column) -> Column:
    """Fingerprint under none, basic, severity, issue_based, strict or custom."""
    if policy == "none":
        return F.substring(F.sha2(event.cast("string"), 256), 1, 32)  # every event is its own
    parts = {"cp": checkpoint, "act": action}
    if policy in ("severity", "strict") and severity is not None:
        parts["sev"] = severity
    if policy == "issue_based" and issues is not None:
        parts["ish"] = F.substring(F.sha2(issues.cast("string"), 256), 1, 16)
    if policy == "strict":
        parts["ts"] = F.floor(F.unix_micros(ts) / F.lit(bucket_seconds * 1e6)).cast("long")
    return fingerprint({**parts, **custom})
