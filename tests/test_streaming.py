"""Streams against their batch twins and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import automata as A
from plumbline.streaming import detectors as D
from plumbline.streaming import jobs, keyed


@pytest.fixture(scope="module")
def raw():
    rng = random.Random(8)
    t, rows = 0.0, []
    for i in range(1500):
        t += rng.choice([0.5, 3, 20, 70, 400]) if i % 40 else 5000
        # Two thirds of the events share a key.
        rows.append((i, "hot" if rng.random() < 0.66 else f"k{rng.randint(0, 5)}", t, rng.gauss(50, 5) + (60 if i in (700, 1100) else 0)))
    return rows


@pytest.fixture(scope="module")
def events(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in"))
    df = spark.createDataFrame(raw, "event_id long, key string, s double, value double").select(
        "event_id", "key", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "value")
    df.repartitionByRange(3, "event_id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def expected(raw, automaton):
    state, out = {}, {}
    for i, k, t, _ in sorted(raw, key=lambda r: (r[2], r[0])):
        state[k], out[i] = automaton.step(state.get(k), t)
    return out


MACHINES = [A.sliding_dedup(60.0), A.tumbling_dedup(300.0), A.session_dedup(60.0, 600.0), A.adaptive_dedup(), A.fixed_throttle(3, 120.0),
            A.sliding_throttle(4, 120.0), A.token_bucket(5.0, 0.02), A.composite(A.token_bucket(5.0, 0.05), A.fixed_throttle(4, 300.0))]


@pytest.mark.parametrize("machine", MACHINES, ids=[m.name for m in MACHINES])
def test_batch_automata(events, raw, machine):
    got = {r.event_id: r.passed for r in keyed.decide(events[0], F.col("key"), "ts", "event_id", machine).collect()}
    assert got == expected(raw, machine)


@pytest.mark.parametrize("machine", [MACHINES[3], MACHINES[6]], ids=["adaptive", "token_bucket"])
def test_stream_automata(spark, events, raw, machine):
    stream = spark.readStream.schema(events[0].schema).option("maxFilesPerTrigger", 1).parquet(events[1])
    got = {r.event_id: r.passed for r in jobs.drain(keyed.decide_stream(stream, F.col("key"), "ts", "event_id", machine, "30 days")).collect()}
    assert got == expected(raw, machine)


def test_sql_forms_agree_with_automata(events, raw):
    sliding = {r.event_id: r.passed for r in keyed.sliding_first(events[0], F.col("key"), "ts", "event_id", 60).collect()}
    assert sliding == expected(raw, A.sliding_dedup(60.0))
    fixed = {r.event_id: r.passed for r in keyed.fixed_window(events[0], F.col("key"), "ts", "event_id", 3, 120).collect()}
    assert fixed == expected(raw, A.fixed_throttle(3, 120.0))
    tumbling = {r.event_id for r in keyed.tumbling_first(events[0], F.col("key"), "ts", "event_id", 300).collect()}
    assert tumbling == {i for i, ok in expected(raw, A.tumbling_dedup(300.0)).items() if ok}


def scores(df):
    return {r.event_id: (round(r.score, 6), r.is_anomaly) for r in df.collect()}


def test_detectors_agree_with_their_streams(spark, events):
    batch = D.points(events[0], "key", "ts", "event_id", "value")
    live = lambda: D.points(spark.readStream.schema(events[0].schema).option("maxFilesPerTrigger", 1).parquet(events[1]), "key", "ts", "event_id", "value")
    rolling = scores(D.rolling_zscore(batch, 30, 3.0, 64))
    assert rolling == scores(D.rolling_zscore(batch, 30, 3.0)) == scores(jobs.drain(D.rolling_zscore_stream(live(), 30, 3.0, "30 days")))
    assert rolling[700][1] and rolling[1100][1]
    ema = scores(D.ema(batch, 0.1, 3.0, 2.0, 50))
    assert ema == scores(D.ema(batch, 0.1, 3.0, 2.0)) == scores(jobs.drain(D.ema_stream(live(), 0.1, 3.0, 2.0, "30 days")))
    assert ema[700][1]


def test_running_stats_stream(spark, events):
    live = D.points(jobs.file_stream(spark, events[1], events[0].schema), "key", "ts", "event_id", "value")
    a = {r.session: (r["count"], round(r.mean, 9), r.max) for r in jobs.drain(D.running_stats(live), "complete").collect()}
    b = {r.session: (r["count"], round(r.mean, 9), r.max) for r in D.running_stats(D.points(events[0], "key", "ts", "event_id", "value")).collect()}
    assert a == b


def test_escalation_log(spark):
    log = spark.createDataFrame([(1, 1, "triggered"), (1, 2, "acknowledged"), (1, 3, "resolved"), (1, 4, "triggered"), (2, 1, "resolved"), (2, 2, "escalated")],
                                "incident long, at long, state string")
    got = {(r.incident, r.at): (r.from_state, r.legal) for r in keyed.transitions(log, "incident", "state", "at", ["state"]).collect()}
    assert got == {(1, 1): ("pending", True), (1, 2): ("triggered", True), (1, 3): ("acknowledged", True), (1, 4): ("resolved", False),
                   (2, 1): ("pending", False), (2, 2): ("resolved", False)}
