"""Queries of event logic and detectors: batch forms, and streams run to
their end over the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.catalog.base import register, table
from plumbline.session import stored
from plumbline.streaming import automata as A
from plumbline.streaming import detectors as D
from plumbline.streaming import forests, jobs, keyed

USER, TYPE = "user_id", "event_type"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def stream(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.file_stream(spark, f"{sf}/events*.parquet", events(spark, sf).schema)


def counts(passed: str, frm: str) -> str:
    return f"select k as key, count(*) filter (where {passed}) as passed, count(*) filter (where not ({passed})) as suppressed from {frm} group by k"


T0 = "(select user_id::varchar k, epoch_us(ts) / 1e6 t, event_id, lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) p from events) e"
# Events of a key in order, numbered, for the recursive forms.
SEQ = "e as materialized (select user_id::varchar k, epoch_us(ts) / 1e6 t, event_id, row_number() over (partition by user_id order by ts, event_id) n from events)"


def recursive(fields: str, first: str, step: str, passed: str) -> str:
    """Fold over the numbered events of each key."""
    return (f"with recursive {SEQ}, w(k, n, t, event_id, {fields}, ok) as (select k, n, t, event_id, {first}, true from e where n = 1 union all "
            f"select e.k, e.n, e.t, e.event_id, {step}, {passed} from w join e on e.k = w.k and e.n = w.n + 1) ")


def dedup_queries() -> None:
    key = lambda: F.col(USER)
    register("dedup_tumbling", lambda s, d: keyed.tumbling_first(events(s, d), key(), "ts", "event_id", 3600),
             "select user_id::varchar as key, (floor(epoch_us(ts) / 3600e6) * 3600)::bigint as window_start, arg_min(event_id, row(ts, event_id)) as event_id, count(*) as events from events group by 1, 2")
    register("dedup_sliding", lambda s, d: keyed.outcome(keyed.sliding_first(events(s, d), key(), "ts", "event_id", 7200)), counts("p is null or t - p > 7200", T0))
    register("dedup_sliding_automaton", lambda s, d: keyed.outcome(keyed.decide(events(s, d), key(), "ts", "event_id", A.sliding_dedup(7200.0))), counts("p is null or t - p > 7200", T0))
    session = recursive("s", "t", "case when e.t - w.t > 20000 or e.t - w.s >= 50000 then e.t else w.s end", "e.t - w.t > 20000 or e.t - w.s >= 50000")
    register("dedup_session", lambda s, d: keyed.outcome(keyed.decide(events(s, d), key(), "ts", "event_id", A.session_dedup(20000.0, 50000.0))), session + counts("ok", "w"))
    faded = "(w.c * greatest(0.0, 1 - (e.t - w.t) / 40000.0))::double"
    width = f"least(30000.0, greatest(600.0, case when floor({faded}) = 0 then 600.0 else floor(600.0 * (1 + ln(1 + floor({faded})) * 2.0)) end))"
    adaptive = recursive("c, q", "1.0::double, t", f"floor({faded}) + 1.0, case when e.t - w.q > {width} then e.t else w.q end", f"e.t - w.q > {width}")
    register("dedup_adaptive", lambda s, d: keyed.outcome(keyed.decide(events(s, d), key(), "ts", "event_id", A.adaptive_dedup(600.0, 30000.0, 2.0, 40000.0))), adaptive + counts("ok", "w"))


def throttle_queries() -> None:
    key = lambda: F.col(USER)
    fixed = "(select user_id::varchar k, event_id, row_number() over (partition by user_id, floor(epoch_us(ts) / 86400e6) order by ts, event_id) <= 2 as ok from events) e"
    register("throttle_fixed", lambda s, d: keyed.fixed_window(events(s, d), key(), "ts", "event_id", 2, 86400), f"select k as key, event_id, ok as passed from {fixed}")
    register("throttle_fixed_counts", lambda s, d: keyed.fixed_window_counts(events(s, d), key(), "ts", "event_id", 2, 86400),
             f"select k as key, count(*) filter (where ok) as allowed, count(*) filter (where not ok) as denied from {fixed} group by 1")
    register("throttle_fixed_automaton", lambda s, d: keyed.outcome(keyed.decide(events(s, d), key(), "ts", "event_id", A.fixed_throttle(2, 86400.0))), counts("ok", fixed))
    win = "floor(e.t / 86400.0) * 86400.0"
    cur, pre = f"case when w.s = {win} then w.c else 0 end", f"case when w.s = {win} then w.b when w.s = {win} - 86400 then w.c else 0 end"
    ok = f"({cur}) + ({pre}) * (1 - (e.t - {win}) / 86400.0) < 3"
    sliding = recursive("s, c, b", "floor(t / 86400.0) * 86400.0, 1.0::double, 0.0::double", f"{win}, ({cur}) + case when {ok} then 1.0 else 0.0 end, ({pre})::double", ok)
    register("throttle_sliding", lambda s, d: keyed.outcome(keyed.decide(events(s, d), key(), "ts", "event_id", A.sliding_throttle(3, 86400.0))), sliding + counts("ok", "w"))
    tokens = "least(3.0, w.b + (e.t - w.a) / 40000.0)"
    bucket = recursive("b, a", "2.0::double, t", f"case when {tokens} >= 1 then {tokens} - 1 else w.b end, case when {tokens} >= 1 then e.t else w.a end", f"{tokens} >= 1")
    register("throttle_token_bucket", lambda s, d: keyed.outcome(keyed.decide(events(s, d), key(), "ts", "event_id", A.token_bucket(3.0, 1 / 40000.0))), bucket + counts("ok", "w"))
    both = recursive("b, a, f, c", "2.0::double, t, floor(t / 86400.0), 1.0::double",
                     f"case when {tokens} >= 1 then {tokens} - 1 else w.b end, case when {tokens} >= 1 then e.t else w.a end, "
                     f"case when {tokens} >= 1 then floor(e.t / 86400.0) else w.f end, case when {tokens} >= 1 then (case when w.f = floor(e.t / 86400.0) then w.c + 1 else 1.0 end) else w.c end",
                     f"{tokens} >= 1 and case when w.f = floor(e.t / 86400.0) then w.c + 1 else 1.0 end <= 2")
    register("throttle_composite", lambda s, d: keyed.outcome(keyed.decide(events(s, d), key(), "ts", "event_id", A.composite(
        A.token_bucket(3.0, 1 / 40000.0), A.fixed_throttle(2, 86400.0)))), both + counts("ok", "w"))


STATES = ("case event_type when 'view' then 'triggered' when 'click' then 'acknowledged' when 'error' then 'escalated' when 'purchase' then 'resolved' else 'pending' end")


def escalation_queries() -> None:
    log = lambda s, d: events(s, d).withColumn("state", F.expr(STATES)).withColumn("incident", (F.col("event_id") / F.lit(8)).cast("long"))
    seq = f"(select event_id // 8 as incident, {STATES} as to_state, coalesce(lag({STATES}) over (partition by event_id // 8 order by ts, event_id), 'pending') as from_state from events) s"
    legal = ", ".join(f"('{a}', '{b}')" for a, b in keyed.LEGAL)
    register("escalation_transitions", lambda s, d: keyed.transitions(log(s, d), "incident", "state", "ts", ["event_id"]).groupBy("from_state", "to_state", "legal").agg(F.count(F.lit(1)).alias("n")),
             f"select from_state, to_state, (from_state, to_state) in ({legal}) as legal, count(*) as n from {seq} group by all")
    register("escalation_current", lambda s, d: keyed.current_states(log(s, d), "incident", "state", "ts", ["event_id"]),
             f"select event_id // 8 as incident, arg_max({STATES}, row(ts, event_id)) as state, count(*) as steps from events group by 1")


def points(df: DataFrame) -> DataFrame:
    return D.points(df, TYPE, "ts", "event_id", "value")


ROLLING = ("(select *, case when up >= 10 and k >= 2 then abs(value - m) / case when sd = 0 then 1e-10 else sd end else 0 end as score from (select event_type as session, event_id, value, "
           "avg(value) over w m, stddev_pop(value) over w sd, count(*) over w k, count(*) over v up from events "
           "window w as (partition by event_type order by ts, event_id rows between 49 preceding and 1 preceding), v as (partition by event_type order by ts, event_id rows between 49 preceding and current row)) a) b")
EMA = ("with recursive e as materialized (select event_type k, value v, event_id, row_number() over (partition by event_type order by ts, event_id) n, "
       "stddev_samp(value) over (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding) sd from events), "
       "w(k, n, event_id, m, score) as (select k, n, event_id, v, 0.0::double from e where n = 1 union all "
       "select e.k, e.n, e.event_id, 0.1 * e.v + 0.9 * w.m, case when e.sd > 0 then abs(e.v - w.m) / e.sd else 0 end from w join e on e.k = w.k and e.n = w.n + 1) ")


def detector_queries() -> None:
    shape = lambda df: df.select("session", "event_id", F.round("score", 4).alias("score"))
    register("stream_rolling_zscore", lambda s, d: shape(D.alerts(D.rolling_zscore(points(events(s, d)), 50, 2.0, 2000))),
             f"select session, event_id, round(score, 4) as score from {ROLLING} where score > 2.0")
    register("stream_rolling_zscore_live", lambda s, d: shape(D.alerts(jobs.drain(D.rolling_zscore_stream(points(stream(s, d)), 50, 2.0)))),
             f"select session, event_id, round(score, 4) as score from {ROLLING} where score > 2.0")
    register("stream_ema", lambda s, d: shape(D.alerts(D.ema(points(events(s, d)), 0.1, 1.0, 1.8, 1500))), EMA + "select k as session, event_id, round(score, 4) as score from w where score > 1.8")
    register("stream_ema_live", lambda s, d: shape(D.alerts(jobs.drain(D.ema_stream(points(stream(s, d)), 0.1, 1.0, 1.8)))), EMA + "select k as session, event_id, round(score, 4) as score from w where score > 1.8")
    stats = "select event_type as session, count(*) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, max(value) as max from events group by 1"
    rounded = lambda df: df.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})
    register("stream_running_stats", lambda s, d: rounded(D.running_stats(points(events(s, d)))), stats)
    register("stream_running_stats_live", lambda s, d: rounded(jobs.drain(D.running_stats(points(stream(s, d))), "complete")), stats)
    register("stream_half_space_trees", lambda s, d: D.half_space_trees(points(events(s, d)), 50, 2.0).filter("is_anomaly").groupBy("session", "served_by").agg(F.count(F.lit(1)).alias("alerts")),
             f"select session, 'zscore_rolling' as served_by, count(*) as alerts from {ROLLING} where score > 2.0 group by 1")
    register("stream_session_stats", lambda s, d: D.session_stats(D.rolling_zscore(points(events(s, d)), 50, 2.0, 3000)),
             f"select session, count(*) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, max(value) as max, count(*) filter (where score > 2.0) as anomaly_count, "
             f"round(count(*) filter (where score > 2.0) * 1.0 / count(*), 6)::double as anomaly_rate from {ROLLING} group by 1")
    register("stream_recent_points", lambda s, d: D.recent_points(points(events(s, d)), 20).select("session", "event_id"),
             "select event_type as session, event_id from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) r from events) x where r <= 20")
    register("stream_expired_sessions", lambda s, d: D.expired_sessions(D.points(events(s, d), USER, "ts", "event_id", "value"), "2024-01-31 00:00:00", 1440).select("session"),
             "select user_id::varchar as session from events group by 1 having max(ts) < timestamp '2024-01-30 00:00:00'")
    register("stream_tumbling_live", lambda s, d: jobs.drain(keyed.watermarked_tumbling(stream(s, d), F.col(USER), "ts", 3600, "40 days")).groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n")),
             "select user_id::varchar as dedup_key, count(distinct floor(epoch_us(ts) / 3600e6)) as n from events group by 1")
    tokens = "least(3.0, w.b + (e.t - w.a) / 40000.0)"
    bucket = recursive("b, a", "2.0::double, t", f"case when {tokens} >= 1 then {tokens} - 1 else w.b end, case when {tokens} >= 1 then e.t else w.a end", f"{tokens} >= 1")
    register("stream_token_bucket_live", lambda s, d: keyed.outcome(jobs.drain(keyed.decide_stream(stream(s, d), F.col(USER), "ts", "event_id", A.token_bucket(3.0, 1 / 40000.0), "40 days"))),
             bucket + counts("ok", "w"))
    register("stream_escalation_live", lambda s, d: jobs.drain(keyed.current_states_stream(stream(s, d).withColumn("state", F.expr(STATES)).withColumn("incident", (F.col("event_id") / F.lit(8)).cast("long")),
                                                                                          "incident", "state", "ts"), "complete"),
             f"select event_id // 8 as incident, arg_max({STATES}, ts) as state, count(*) as steps from events group by 1")
    register("stream_late_rows", lambda s, d: keyed.late_rows(events(s, d), "ts", "2024-01-10 00:00:00"),
             "select count(*) filter (where ts < timestamp '2024-01-10') as late, count(*) as rows from events")
    register("stream_forest_batches", forest)


def forest(spark: SparkSession, sf: str) -> DataFrame:
    """Forest refitted per micro-batch; alerts per batch."""
    folder = f"{jobs.checkpoint_folder(spark)}/forest-{jobs.uuid.uuid4().hex}"
    query = (points(stream(spark, sf)).writeStream.foreachBatch(D.forest_batch(f"{folder}/alerts", 0.02, 20)).trigger(availableNow=True)
             .option("checkpointLocation", f"{folder}/state").start())
    query.awaitTermination()
    return spark.read.schema("id long, score double, epoch long").parquet(f"{folder}/alerts").groupBy("epoch").agg(F.count(F.lit(1)).alias("alerts"))


# Every 89th event is moved far away, each to a place of its own.
PLANTED = "event_id % 89 = 7"


def planted(df: DataFrame) -> DataFrame:
    far = F.when(F.expr(PLANTED), 1e6 * (1 + F.col("event_id"))).otherwise(F.col("value"))
    return forests.wide_points(df.withColumn("moved", far), TYPE, "ts", "event_id", ["moved", "value"])


def caught(spark: SparkSession, sf: str, kind: forests.Turning) -> DataFrame:
    """Per session: points, planted ones behind the first window and how many of them were found, and the points that stream and batch judge
    differently."""
    batch = forests.as_batch(planted(events(spark, sf)), kind)
    live = jobs.drain(forests.as_stream(planted(stream(spark, sf)), kind)).select(F.col("session").alias("s"), F.col("event_id").alias("e"), F.col("score").alias("live"))
    both = stored(batch.join(live, (F.col("session") == F.col("s")) & (F.col("event_id") == F.col("e")), "full")
                  .select("session", "ts", "event_id", "is_anomaly", (~F.col("score").eqNullSafe(F.col("live"))).alias("different")))
    # A session's first points are found by a limited rank and taken off again, so that no task sorts a whole session.
    first = both.withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy("ts", "event_id"))).filter(F.col("nth") <= kind.back).drop("nth")
    rows, far = both.withColumn("sign", F.lit(1)).unionByName(first.withColumn("sign", F.lit(-1))), F.expr(PLANTED)
    whole, late = F.col("sign") > 0, lambda hit: F.coalesce(F.sum(F.when(hit, F.col("sign"))), F.lit(0).cast("long"))
    return rows.groupBy("session").agg(F.count_if(whole & F.col("event_id").isNotNull()).alias("points"), late(far).alias("planted"), late(far & F.col("is_anomaly")).alias("found"),
                                       F.count_if(whole & F.col("different")).alias("different"))


def turning_queries() -> None:
    for name, kind in (("windowed_forest", forests.windowed_forest(50, 0.15, 30)), ("half_space_mass", forests.half_space_trees(50, 0.7, 15, 6)), ("random_cuts", forests.robust_random_cut_forest(40, 0.2, 6, 160))):
        seen = f"(select *, row_number() over (partition by event_type order by ts, event_id) > {kind.back} as late from events) e"
        register(f"stream_{name}", lambda s, d, kind=kind: caught(s, d, kind),
                 f"select event_type as session, count(*) as points, count(*) filter (where late and {PLANTED}) as planted, count(*) filter (where late and {PLANTED}) as found, 0::bigint as different from {seen} group by 1")
    register("stream_rolling_columns", lambda s, d: forests.rolling_columns(events(s, d).withColumn("double_value", F.col("value") * 2), TYPE, "ts", "event_id", ["value", "double_value"], 50, 2.0)
             .filter("is_anomaly").select("session", "event_id", F.round("score", 4).alias("score"), F.size("anomaly_columns").alias("columns"), F.size("details").alias("judged")),
             f"select session, event_id, round(score, 4) as score, 2::int as columns, 2::int as judged from {ROLLING} where score > 2.0")


for part in (dedup_queries, throttle_queries, escalation_queries, detector_queries, turning_queries):
    part()
