"""Streaming anomaly detectors and their batch twins.

Points are rows of session, ts, event_id and value. A batch twin gives the
same numbers as the stream on the same points; it cuts the order into equal
chunks, so a session that holds most of the points is shared out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.anomaly import Prepared, isolation_forest
from plumbline.plans.primitives import chunked
from plumbline.session import checkpointed
from plumbline.streaming.ordered import Fold, fold_stream

CHUNK = 250_000
TINY = 1e-10


def points(df: DataFrame, session: str, ts: str, event_id: str, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).select(
        F.col(session).cast("string").alias("session"), F.col(ts).cast("timestamp").alias("ts"),
        F.col(event_id).cast("long").alias("event_id"), F.col(value).cast("double").alias("value"))


def running_stats(pts: DataFrame) -> DataFrame:
    """count, mean, std, min, max per session; works on batch and stream."""
    return pts.groupBy("session").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
                                      F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"),
                                      F.max("value").alias("max"))


def rolling_zscore(pts: DataFrame, window: int = 100, threshold: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """(session, event_id, ts, value, score, is_anomaly): deviation from the
    last ``window`` - 1 points in population deviations; points with fewer
    than min(window, 10) points up to them are not judged."""
    need, back = min(window, 10), window - 1
    rows = chunked(pts, ["session", "ts", "event_id"], max(chunk, window)).withColumn("own", F.lit(True))
    size = max(chunk, window)
    # The end of a chunk is also shown to the next one.
    halo = rows.filter(F.pmod(F.col("idx"), F.lit(size)) >= size - back).withColumn("chunk", F.col("chunk") + 1).withColumn("own", F.lit(False))
    w = Window.partitionBy("chunk", "session").orderBy("idx")
    last = w.rowsBetween(-back, -1)
    seen = w.rowsBetween(-back, 0)
    out = (rows.unionByName(halo)
           .withColumns({"m": F.avg("value").over(last), "sd": F.stddev_pop("value").over(last),
                         "k": F.count(F.lit(1)).over(last), "up": F.count(F.lit(1)).over(seen)})
           .filter("own"))
    judged = (F.col("up") >= need) & (F.col("k") >= 2)
    sd = F.when(F.col("sd") == 0, F.lit(TINY)).otherwise(F.col("sd"))
    score = F.when(judged, F.abs(F.col("value") - F.col("m")) / sd).otherwise(F.lit(0.0))
    return out.withColumn("score", score).select("session", "event_id", "ts", "value", "score", (F.col("score") > threshold).alias("is_anomaly"))


ALERT = "session string, event_id long, ts timestamp, value double, score double, is_anomaly boolean"


def keyed_stream(pts: DataFrame, advance, fresh, state_schema: str, lateness: str, idle_ms: int) -> DataFrame:
    """Stateful pass over a stream of points, in event order however they
    arrive; a session idle for ``idle_ms`` of event time is forgotten."""
    def fold(state: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        current = list(state) if state is not None else fresh()
        scores, hits = [], []
        for v in pdf["value"]:
            current, score, hit = advance(current, float(v))
            scores.append(float(score))
            hits.append(bool(hit))
        return tuple(current), pd.DataFrame({"event_id": pdf["event_id"], "t": pdf["t_us"], "value": pdf["value"], "score": scores, "is_anomaly": hits})

    return alert_stream(pts, Fold(state_schema, "event_id long, t long, value double, score double, is_anomaly boolean", fold, idle_ms), lateness)


def alert_stream(pts: DataFrame, fold: Fold, lateness: str) -> DataFrame:
    """A fold over points as a stream of judged points; the fold's ``t`` becomes the time."""
    told = fold_stream(pts.withColumnsRenamed({"session": "key", "ts": "event_time"}), fold, lateness)
    rest = [c for c in told.columns if c not in ("key", "event_id", "t")]
    out = told.select(F.col("key").alias("session"), "event_id", F.timestamp_micros("t").alias("ts"), *rest)
    out.closing = told.closing
    return out


def rolling_zscore_stream(pts: DataFrame, window: int = 100, threshold: float = 3.0, lateness: str = "10 minutes",
                          idle_ms: int = 3_600_000) -> DataFrame:
    """Stream form; the state is the last ``window`` - 1 values."""
    need = min(window, 10)

    def advance(state: list, v: float) -> tuple[list, float, bool]:
        past, score = list(state[0]), 0.0
        if len(past) + 1 >= need and len(past) >= 2:
            mean = sum(past) / len(past)
            sd = (sum((p - mean) ** 2 for p in past) / len(past)) ** 0.5
            score = abs(v - mean) / (sd if sd > 0 else TINY)
        return [(past + [v])[-(window - 1):]], score, score > threshold

    return keyed_stream(pts, advance, lambda: [[]], "past array<double>", lateness, idle_ms)


def ema_step(state: list, v: float, alpha: float, limit: float) -> tuple[list, float, bool]:
    """State: started, average, count, mean, sum of squares (all earlier points)."""
    started, ema, n, mean, m2 = state
    score = 0.0
    if started:
        sd = (m2 / (n - 1)) ** 0.5 if n >= 2 else 0.0
        score = abs(v - ema) / sd if sd > 0 else 0.0
        ema = alpha * v + (1 - alpha) * ema
    else:
        ema = v
    n += 1
    delta = v - mean
    mean += delta / n
    return [1.0, ema, n, mean, m2 + delta * (v - mean)], score, score > limit


def ema_stream(pts: DataFrame, alpha: float = 0.1, threshold: float = 3.0, multiplier: float = 2.0, lateness: str = "10 minutes",
               idle_ms: int = 3_600_000) -> DataFrame:
    """Deviation from the moving average in running deviations of all earlier
    points; an alert needs threshold * multiplier."""
    limit = threshold * multiplier
    return keyed_stream(pts, lambda s, v: ema_step(s, v, alpha, limit), lambda: [0.0, 0.0, 0.0, 0.0, 0.0],
                        "started double, ema double, n double, mean double, m2 double", lateness, idle_ms)


def ema(pts: DataFrame, alpha: float = 0.1, threshold: float = 3.0, multiplier: float = 2.0, chunk: int = CHUNK) -> DataFrame:
    """Batch twin in two passes: every chunk of a session is first reduced to
    one row (how it changes the average, and its moments); the few rows of a
    session are chained; then each chunk starts from the state it inherits."""
    limit = threshold * multiplier
    rows = checkpointed(chunked(pts, ["session", "ts", "event_id"], chunk))

    def reduce_part(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("idx")["value"].to_numpy()
        ema_value, n, mean, m2 = 0.0, 0, 0.0, 0.0
        for x in v:
            ema_value = alpha * x + (1 - alpha) * ema_value
            n += 1
            delta = x - mean
            mean += delta / n
            m2 += delta * (x - mean)
        return pd.DataFrame({"session": [pdf["session"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "first": [v[0]],
                             "end": [ema_value], "keep": [(1 - alpha) ** n], "n": [float(n)], "mean": [mean], "m2": [m2]})

    parts = rows.groupBy("session", "chunk").applyInPandas(
        reduce_part, "session string, chunk long, first double, end double, keep double, n double, mean double, m2 double")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, state = [], [0.0, 0.0, 0.0, 0.0, 0.0]
        for r in pdf.sort_values("chunk").itertuples():
            out.append((r.session, r.chunk, *state))
            started, avg, n, mean, m2 = state
            # A session's first value sets the average instead of being mixed in.
            start = avg if started else r.first
            total, delta = n + r.n, r.mean - mean
            state = [1.0, r.end + r.keep * start, total, mean + delta * r.n / total, m2 + r.m2 + delta * delta * n * r.n / total]
        return pd.DataFrame(out, columns=["session", "chunk", "started", "ema", "n", "mean", "m2"])

    carried = parts.groupBy("session").applyInPandas(
        chain, "session string, chunk long, started double, ema double, n double, mean double, m2 double")

    def judge(key: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        state = list(start[["started", "ema", "n", "mean", "m2"]].iloc[0])
        scores, hits = [], []
        for v in pdf["value"]:
            state, score, hit = ema_step(state, float(v), alpha, limit)
            scores.append(score)
            hits.append(hit)
        return pdf.assign(score=scores, is_anomaly=hits)[["session", "event_id", "ts", "value", "score", "is_anomaly"]]

    return rows.groupBy("session", "chunk").cogroup(carried.groupBy("session", "chunk")).applyInPandas(judge, ALERT)


def forest_batch(path: str, contamination: float = 0.02, trees: int = 50):
    """foreachBatch function: fit a forest on the micro-batch, score it, and write the alerts to ``path``, a folder that
    all executors share. Each epoch has a folder of its own that a repeated epoch overwrites, so no alert is told twice."""
    def handle(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            found = isolation_forest(Prepared(batch, "event_id", ["value"]), trees, contamination).filter("is_anomaly")
            found.select("id", "score").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return handle


def half_space_trees(pts: DataFrame, window: int = 100, threshold: float = 3.0) -> DataFrame:
    """Served by the rolling z-score, and named so in the result."""
    return rolling_zscore(pts, window, threshold).withColumn("served_by", F.lit("zscore_rolling"))


robust_random_cut_forest = half_space_trees


def alerts(scored: DataFrame) -> DataFrame:
    return scored.filter("is_anomaly").select("session", "event_id", "ts", "value", "score")


def recent_points(pts: DataFrame, n: int = 100) -> DataFrame:
    """Newest points of every session; the rank limit acts before the shuffle."""
    w = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("event_id"))
    return pts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def session_stats(scored: DataFrame) -> DataFrame:
    """Running statistics with the number and rate of alerts."""
    return scored.groupBy("session").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count_if("is_anomaly").alias("anomaly_count"),
        F.round(F.count_if("is_anomaly") / F.count(F.lit(1)), 6).alias("anomaly_rate"))


def expired_sessions(pts: DataFrame, as_of: str, idle_minutes: int = 60) -> DataFrame:
    """(session, last_seen) of sessions idle for longer than the limit."""
    limit = F.timestamp_micros(F.unix_micros(F.lit(as_of).cast("timestamp")) - F.lit(idle_minutes * 60_000_000))
    return pts.groupBy("session").agg(F.max("ts").alias("last_seen")).filter(F.col("last_seen") < limit)
