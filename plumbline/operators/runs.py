"""Rollups of run tables: validations, incidents, notifications, audits,
storage tiers and artifacts. All take plain frames and an ``as_of`` moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.primitives import latest_in_window


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def before(as_of: str, days: float = 0, hours: float = 0) -> Column:
    return F.timestamp_micros(F.unix_micros(moment(as_of)) - F.lit(int((days * 24 + hours) * 3_600_000_000)))


def pct(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(empty))


# -- validation history: run_id, source_id, created_at, passed, issues ------
def history_summary(runs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per source: runs, passed, failed and success rate in the period."""
    n, good, bad = F.count(F.lit(1)), F.count_if(F.col("passed")), F.count_if(~F.col("passed"))
    return runs.filter(F.col("created_at") >= before(as_of, days)).groupBy("source_id").agg(
        n.alias("total_runs"), good.alias("passed_runs"), bad.alias("failed_runs"), pct(good, n).alias("success_rate"))


def history_trend(runs: DataFrame, as_of: str, days: int = 30, granularity: str = "daily") -> DataFrame:
    """Per source and hour, day or week (from Monday)."""
    unit = {"hourly": "hour", "daily": "day", "weekly": "week"}[granularity]
    n, good = F.count(F.lit(1)), F.count_if(F.col("passed"))
    return runs.filter(F.col("created_at") >= before(as_of, days)).groupBy(
        "source_id", F.date_format(F.date_trunc(unit, "created_at"), "yyyy-MM-dd HH:mm").alias("period")).agg(
        n.alias("run_count"), good.alias("passed_count"), (n - good).alias("failed_count"), pct(good, n).alias("success_rate"))


def failure_frequency(issues: DataFrame, n: int = 10) -> DataFrame:
    """(issue, count): most frequent column.issue_type over issue rows
    (column, issue_type, count)."""
    name = F.concat_ws(".", F.coalesce("column", F.lit("unknown")), F.coalesce("issue_type", F.lit("unknown")))
    return (issues.groupBy(name.alias("issue")).agg(F.sum(F.coalesce("count", F.lit(1))).alias("count"))
            .orderBy(F.desc("count"), "issue").limit(n))


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


# -- fleet: sources, incidents, artifacts -----------------------------------
def source_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: totals, active, healthy, unhealthy, unowned sources."""
    latest = runs.groupBy("source_id").agg(F.max_by("status", F.struct("created_at", "run_id")).alias("latest"))
    owned = F.col("owner_id").isNotNull() | F.col("team_id").isNotNull() | F.col("domain_id").isNotNull()
    return sources.join(latest, "source_id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if(F.col("latest") == "success").alias("healthy"),
        F.count_if(F.col("latest").isin("failed", "error")).alias("unhealthy"), F.count_if(~owned).alias("unowned"))


def backlog(queues: DataFrame, incidents: DataFrame) -> DataFrame:
    """(queue_id, count): open incidents per queue, empty queues included."""
    open_ = incidents.filter(F.col("state") != "resolved").groupBy("queue_id").agg(F.count(F.lit(1)).alias("n"))
    return queues.join(open_, "queue_id", "left").select("queue_id", F.coalesce("n", F.lit(0)).alias("count"))


def workload(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("state") != "resolved").groupBy(
        F.coalesce(F.col("assignee_id").cast("string"), F.lit("unassigned")).alias("assignee")).agg(F.count(F.lit(1)).alias("count"))


def sources_by(sources: DataFrame, column: str) -> DataFrame:
    """(id, count) of sources per owner, team or domain."""
    return sources.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("count"))


def artifact_freshness(artifacts: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Per owner: artifacts of the last 24 hours and those older than 7 days."""
    owned = artifacts.join(sources.select("source_id", "owner_id"), "source_id", "left")
    return owned.groupBy("owner_id").agg(
        F.count_if(F.col("created_at") >= before(as_of, 1)).alias("fresh_24h"), F.count_if(F.col("created_at") < before(as_of, 7)).alias("stale"))


def artifact_statistics(artifacts: DataFrame) -> DataFrame:
    """(artifact_type, status, artifacts, total_bytes, downloads)."""
    return artifacts.groupBy("artifact_type", "status").agg(
        F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("downloads"), F.lit(0)).alias("downloads"))


def expired_artifacts(artifacts: DataFrame, as_of: str) -> DataFrame:
    return artifacts.filter(F.col("expires_at").isNotNull() & (F.col("expires_at") < moment(as_of)))


# -- incidents: incident_id, created_at, severity, status, source_name, queue_id
def find_incidents(incidents: DataFrame, queue: object = None, assignee: object = None, status: str | None = None,
                   source: str | None = None, severity: str | None = None, text: str | None = None) -> DataFrame:
    """Filters of the incident list, newest first; text is searched without
    case in title, message, source and queue name."""
    cond = F.lit(True)
    for column, value in (("queue_id", queue), ("assignee_id", assignee), ("status", status), ("source_name", source), ("severity", severity)):
        if value is not None:
            cond = cond & (F.col(column) == F.lit(value))
    if text:
        fields = [c for c in ("title", "message", "source_name", "queue_name") if c in incidents.columns]
        hit = F.lit(False)
        for c in fields:
            hit = hit | F.lower(c).contains(text.lower())
        cond = cond & hit
    return incidents.filter(cond).orderBy(F.desc("created_at"), F.desc("incident_id"))


def incident_counts(incidents: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """(dimension, value, count) by severity, source and status, in one pass."""
    recent = incidents.filter(F.col("created_at") >= before(as_of, hours=hours))
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in
                      (("severity", "severity"), ("source", "source_name"), ("status", "status"))])
    return recent.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("count"))


def incident_trend(incidents: DataFrame, as_of: str) -> DataFrame:
    """(hour, count): 25 hourly points up to now, empty hours included."""
    now = F.date_trunc("hour", moment(as_of))
    counted = incidents.groupBy(F.date_trunc("hour", "created_at").cast("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = incidents.sparkSession.range(25).select(F.timestamp_micros(F.unix_micros(now) - F.col("id") * 3_600_000_000).alias("hour"))
    return hours.join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("count"))


def top_sources(incidents: DataFrame, as_of: str, hours: int = 24, n: int = 5) -> DataFrame:
    return (incidents.filter(F.col("created_at") >= before(as_of, hours=hours)).groupBy("source_name")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "source_name").limit(n))


def correlations(incidents: DataFrame, hours: int = 1, n: int = 10) -> DataFrame:
    """(incident_id, related_id, correlation_type, score): for every incident
    the newest ``n`` others within the hours around it, of the same queue
    (0.9), and of the same source in another queue (0.7).

    Other queues of a source are looked up one by one, so no incident meets
    more than n candidates per queue.
    """
    rows = incidents.select("incident_id", F.col("created_at").cast("timestamp").alias("ts"), "queue_id", "source_name")
    span = F.lit(int(hours * 3_600_000_000))
    lo, hi = F.timestamp_micros(F.unix_micros("ts") - span), F.timestamp_micros(F.unix_micros("ts") + span)

    def ranked(found: DataFrame, kind: str, score: float) -> DataFrame:
        w = Window.partitionBy("pid").orderBy(F.desc("ts"), F.desc("id"))
        return (found.filter(F.col("pid") != F.col("id")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
                .select(F.col("pid").alias("incident_id"), F.col("id").alias("related_id"), F.lit(kind).alias("correlation_type"),
                        F.lit(score).alias("score")))

    queued = rows.filter(F.col("queue_id").isNotNull())
    point = queued.select(F.struct(F.col("queue_id").cast("string").alias("q")).alias("g"), "ts", F.col("incident_id").alias("id"))
    probe = queued.select(F.col("incident_id").alias("pid"), F.struct(F.col("queue_id").cast("string").alias("q")).alias("g"), lo.alias("lo"), hi.alias("hi"))
    # One more than n, because an incident finds itself as well.
    same_queue = ranked(latest_in_window(point, probe, n + 1), "same_queue", 0.9)

    queue = F.coalesce(F.col("queue_id").cast("string"), F.lit(""))
    group = F.struct(F.col("source_name").alias("s"), queue.alias("q"))
    point = rows.select(group.alias("g"), "ts", F.col("incident_id").alias("id"))
    others = rows.select("source_name", queue.alias("q")).distinct()
    own = queue
    probe = (rows.withColumn("own", own).join(others, "source_name")
             # A row without a queue shares none, so its own group counts as well.
             .filter((F.col("q") != F.col("own")) | (F.col("own") == ""))
             .select(F.col("incident_id").alias("pid"), F.struct(F.col("source_name").alias("s"), F.col("q").alias("q")).alias("g"), lo.alias("lo"), hi.alias("hi")))
    same_source = ranked(latest_in_window(point, probe, n + 1), "same_source", 0.7)
    return same_queue.unionByName(same_source)


# -- notifications, escalations, audits, tiers ------------------------------
def notification_stats(log: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """(channel_id, status, count) in the period."""
    return log.filter(F.col("created_at") >= before(as_of, hours=hours)).groupBy("channel_id", "status").agg(F.count(F.lit(1)).alias("count"))


def notification_success(log: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """One row: total and success rate (100 when nothing was sent)."""
    n, sent = F.count(F.lit(1)), F.count_if(F.col("status") == "sent")
    return log.filter(F.col("created_at") >= before(as_of, hours=hours)).agg(n.alias("total"), pct(sent, n, 100.0).alias("success_rate"))


def escalation_stats(incidents: DataFrame) -> DataFrame:
    """One row: total, active, mean seconds from creation to resolution."""
    took = (F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    return incidents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") != "resolved").alias("active"),
                         F.round(F.avg(F.when(F.col("state") == "resolved", took)), 3).alias("avg_resolution_seconds"))


def escalations_by_state(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("state").agg(F.count(F.lit(1)).alias("count"))


def config_stats(configs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of dedup or throttle settings by the given columns, with how
    many of them are active."""
    return configs.groupBy(*columns).agg(F.count(F.lit(1)).alias("configs"), F.count_if("is_active").alias("active"))


def find_audits(events: DataFrame, event_type: str | None = None, status: str | None = None, start: str | None = None,
                end: str | None = None, item: object = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Audit list: filtered first, then paged, newest first."""
    cond = F.lit(True)
    for column, value in (("event_type", event_type), ("status", status), ("item_id", item)):
        if value is not None:
            cond = cond & (F.col(column) == F.lit(value))
    if start:
        cond = cond & (F.col("ts") >= moment(start))
    if end:
        cond = cond & (F.col("ts") <= moment(end))
    return page(events.filter(cond), [F.desc("ts"), F.desc("event_id")], offset, limit)


def audit_stats(events: DataFrame, as_of: str) -> DataFrame:
    """One row: total, today, last 7 days, error rate, mean duration."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col("status").isin("failure", "error"))
    return events.agg(
        n.alias("total_events"), F.count_if(F.to_date("ts") == F.to_date(moment(as_of))).alias("events_today"),
        F.count_if(F.col("ts") >= before(as_of, 7)).alias("events_this_week"),
        F.when(n > 0, F.round(bad / n, 6)).otherwise(F.lit(0.0)).alias("error_rate"),
        F.round(F.avg(F.when(F.col("duration_ms") != 0, F.col("duration_ms"))), 6).alias("avg_duration_ms"))


def audit_counts(events: DataFrame) -> DataFrame:
    """(kind, value, count): audit events by type and by status, from one pass."""
    return (events.select(F.explode(F.array(F.struct(F.lit("type").alias("kind"), F.col("event_type").alias("value")),
                                            F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")))).alias("c"))
            .groupBy("c.kind", "c.value").agg(F.count(F.lit(1)).alias("count")))


def tier_stats(migrations: DataFrame) -> DataFrame:
    """One row: migrations, completed, failed, bytes of completed ones."""
    return migrations.agg(
        F.count(F.lit(1)).alias("migrations"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("size_bytes"))), F.lit(0)).alias("bytes_moved"))


def policies_per_tier(tiers: DataFrame, policies: DataFrame) -> DataFrame:
    counted = policies.groupBy(F.col("from_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return tiers.join(counted, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("policies"))
