"""Retention and storage-tier policies: which items to delete or move."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.runs import before, moment
from plumbline.plans.primitives import ordered_scan


def older_than(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    return rows.filter(F.col("created_at") < before(as_of, days))


def older_by_status(rows: DataFrame, as_of: str, days: int, failed_days: int) -> DataFrame:
    """Failed rows live longer than the others."""
    return rows.filter(F.when(F.col("status") == "failed", F.col("created_at") < before(as_of, failed_days))
                       .otherwise(F.col("created_at") < before(as_of, days)))


def surplus_per_source(rows: DataFrame, keep: int = 5) -> DataFrame:
    """Rows beyond the newest ``keep`` of their source.

    The newest ones are found with a limited rank (each task sends at most
    ``keep`` rows of a source) and taken out by an anti join, so a busy source
    is not gathered in one task.
    """
    w = Window.partitionBy("source_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    newest = (rows.select("source_id", "created_at", "run_id").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep)
              .select(F.col("run_id").alias("run_id")))
    return rows.join(newest, "run_id", "left_anti")


def oldest_over_limit(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Oldest rows to delete until the total is at most 80 % of the limit;
    none while the total is within it."""
    total = rows.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    if total <= max_bytes:
        return rows.limit(0)
    to_free = total - int(max_bytes * 0.8)
    run = ordered_scan(rows, ["created_at", "run_id"], sums=["size_bytes"])
    return run.filter(F.col("cum_size_bytes") - F.col("size_bytes") < to_free).drop("cum_size_bytes")


# -- tier policies over items: item_id, tier, created_at, last_accessed, access_count, size_bytes
def age_policy(as_of: str, after_days: float = 0, after_hours: float = 0) -> Column:
    return F.col("created_at") <= before(as_of, after_days, after_hours)


def access_policy(as_of: str, inactive_days: float | None = None, min_access_count: int | None = None) -> Column:
    hit = F.lit(False)
    if inactive_days:
        hit = hit | F.coalesce(F.col("last_accessed") <= before(as_of, inactive_days), F.lit(False))
    if min_access_count:
        hit = hit | (F.col("access_count") >= min_access_count)
    return hit


def size_policy(min_size_bytes: int = 0, min_size_kb: int = 0, min_size_mb: int = 0, min_size_gb: int = 0) -> Column:
    return F.col("size_bytes") >= min_size_bytes + 1024 * (min_size_kb + 1024 * (min_size_mb + 1024 * min_size_gb))


def scheduled_policy(as_of: str, on_days: Sequence[int] | None = None, at_hour: int | None = None, min_age_days: float = 0) -> Column:
    now, ok = moment(as_of), F.lit(True)
    if on_days:
        ok = ok & F.weekday(now).isin(list(on_days))
    if at_hour is not None:
        ok = ok & (F.hour(now) == at_hour)
    return ok & (F.col("created_at") <= before(as_of, min_age_days)) if min_age_days else ok


def custom_policy(predicate: str) -> Column:
    """A user's Spark SQL predicate; undefined counts as false."""
    return F.coalesce(F.expr(predicate), F.lit(False))


def composite(policies: Sequence[Column], require_all: bool = True) -> Column:
    return reduce(lambda a, b: a & b if require_all else a | b, policies)


def migration_plan(items: DataFrame, policies: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """(item_id, policy, from_tier, to_tier) for (name, from, to, predicate);
    an item follows the first policy that wants to move it."""
    choice = F.coalesce(*[F.when((F.col("tier") == a) & p, F.struct(F.lit(n).alias("policy"), F.lit(a).alias("from_tier"), F.lit(b).alias("to_tier")))
                          for n, a, b, p in policies])
    return items.withColumn("m", choice).filter(F.col("m").isNotNull()).select("item_id", "m.policy", "m.from_tier", "m.to_tier", "size_bytes")
