"""Checks on time series."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from plumbline.operators.checks.datetime import moment
from plumbline.operators.checks.table import period_number
from plumbline.operators.stats import trend_stats
from plumbline.plans.primitives import running_totals
from plumbline.plans.registry import check

SECONDS = {"s": 1, "m": 60, "min": 60, "h": 3600, "d": 86400, "w": 604800}


def interval_seconds(text) -> float:
    """Seconds of '1h', '30m', '15 min', '1d', 'hourly', 'daily' or a number."""
    named = {"hourly": "1h", "daily": "1d", "weekly": "1w"}
    found = re.fullmatch(r"\s*([0-9.]+)\s*([a-z]*)\s*", named.get(str(text).lower(), str(text).lower()))
    if not found:
        raise ValueError(f"unreadable interval {text!r}")
    unit = found.group(2) or "s"
    unit = unit if unit in SECONDS else unit[0]
    return float(found.group(1)) * SECONDS[unit]


def moments(t, column):
    """Pairs of consecutive distinct times, as microseconds."""
    frame = t.frame(f"times:{column}", lambda: t.df.select(F.unix_micros(moment(column)).alias("us"))
                    .dropna().distinct())
    return t.pairs(["us"], {"us": F.col("us")}, source=frame)


def gap(cur, prev):
    return cur("us") - prev("us")


def pairs_total():
    return F.greatest(F.col("rows") - 1, F.lit(0))


@check("timeseries", "high")
def TimeSeriesGap(t, timestamp_column, expected_interval, tolerance=0.1):
    """Consecutive times are at most the interval (plus tolerance) apart."""
    p, limit = moments(t, timestamp_column), interval_seconds(expected_interval) * (1 + tolerance) * 1e6
    bad = t.stat(("sum", lambda cur, prev: gap(cur, prev) > limit), p, f"gap_{limit:.0f}")
    t.verdict(timestamp_column, bad, pairs_total(), frame=p, observed=t.stat(("max", gap), p, "widest") / 1e6)


@check("timeseries")
def TimeSeriesInterval(t, timestamp_column, interval, strict=False):
    """Consecutive times are one interval apart (within 10 % unless strict)."""
    p, us = moments(t, timestamp_column), interval_seconds(interval) * 1e6
    slack = 0.0 if strict else 0.1 * us
    bad = t.stat(("sum", lambda cur, prev: F.abs(gap(cur, prev) - us) > slack), p, f"off_{us:.0f}_{bool(strict)}")
    t.verdict(timestamp_column, bad, pairs_total(), frame=p)


@check("timeseries", "high")
def TimeSeriesDuplicate(t, timestamp_column, group_columns=None):
    """No time occurs twice (per group)."""
    keys = [*(group_columns or ()), timestamp_column]
    g = t.groups(keys, F.col(timestamp_column).isNotNull())
    n = F.col("n")
    t.verdict(timestamp_column, t.stat(F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)), g),
              t.stat(F.coalesce(F.sum(n), F.lit(0)), g), frame=g)


def in_sequence(t, column, order_by, up, strict):
    """Times along a unique sequence column (the order of arrival)."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    p = t.pairs(order, {"v": moment(column)}, F.col(column).isNotNull())

    def wrong(cur, prev):
        a, b = (prev("v"), cur("v")) if up else (cur("v"), prev("v"))
        return a >= b if strict else a > b
    bad = t.stat(("sum", wrong), p, f"wrong_{up}_{strict}")
    t.verdict(column, bad, pairs_total(), frame=p)


@check("timeseries", "high")
def TimeSeriesMonotonic(t, timestamp_column, order_by, direction="increasing", strict=True):
    """Times rise (or fall) in the order of arrival."""
    in_sequence(t, timestamp_column, order_by, direction == "increasing", strict)


@check("timeseries")
def TimeSeriesOrder(t, timestamp_column, order_by, allow_equal=False):
    """Times are chronological in the order of arrival."""
    in_sequence(t, timestamp_column, order_by, True, not allow_equal)


PHASES = {"daily": F.hour, "weekly": F.weekday, "monthly": F.dayofmonth,
          "quarterly": lambda ts: F.pmod(F.month(ts) - 1, F.lit(3)), "yearly": F.month}


@check("timeseries")
def Seasonality(t, timestamp_column, value_column, period, min_strength=0.3):
    """Share of the variance explained by the phase of the period.

    Phase means are taken about the mean of the column, so large values lose no digits.
    """
    (centre,) = yield [F.avg(value_column)]
    g = t.frame(f"season:{timestamp_column}:{value_column}:{period}", lambda: t.df.filter(
        F.col(value_column).isNotNull()).groupBy(PHASES[period](moment(timestamp_column)).alias("phase")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(value_column) - F.lit(float(centre or 0.0))).alias("m"), F.var_pop(value_column).alias("v")))
    n, total = F.col("n"), t.stat(F.sum("n"), g)
    mean = t.stat(F.sum(F.col("m") * n), g) / total
    between = t.stat(F.sum(F.col("m") * F.col("m") * n), g) - mean * mean * total
    within = t.stat(F.sum(F.col("v") * n), g)
    strength = F.when(between + within > 0, F.greatest(between, F.lit(0.0)) / (between + within)).otherwise(F.lit(0.0))
    t.value(value_column, strength, ok=strength >= min_strength, frame=g)


@check("timeseries")
def Trend(t, timestamp_column, value_column, expected_trend, significance=0.05):
    """Direction of the regression over time (in days), if significant."""
    days = F.unix_micros(moment(timestamp_column)) / F.lit(86400e6)
    g = t.frame(f"trend:{timestamp_column}:{value_column}", lambda: trend_stats(t.df, days, F.col(value_column)))
    slope, p = t.stat(F.max("slope"), g), t.stat(F.max("p"), g)
    real = p < significance
    ok = {"increasing": real & (slope > 0), "decreasing": real & (slope < 0), "stable": ~real}[expected_trend]
    t.value(value_column, slope, ok=ok, frame=g)


@check("timeseries")
def TrendBreak(t, timestamp_column, value_column, sensitivity=0.5):
    """Largest shift between the means before and after a moment, in
    deviations; moments with less than a tenth of the rows on a side are
    left out."""
    v = F.col(value_column)
    n, total, sd = yield [F.count(v), F.sum(v), F.stddev_samp(v)]

    def build():
        points = t.df.filter(v.isNotNull()).groupBy(moment(timestamp_column).alias("ts")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"))
        return running_totals(points, "ts", ["n", "s"])

    g = t.frame(f"break:{timestamp_column}:{value_column}", build)
    left = F.col("cum_n")
    shift = F.abs(F.col("cum_s") / left - (F.lit(total) - F.col("cum_s")) / (F.lit(n) - left)) / (sd or 1.0)
    usable = (left >= 0.1 * (n or 0)) & (left <= 0.9 * (n or 0))
    t.value(value_column, t.stat(F.coalesce(F.max(F.when(usable, shift)), F.lit(0.0)), g), hi=float(sensitivity), frame=g)


@check("timeseries", "high")
def TimeSeriesCompleteness(t, timestamp_column, start_date=None, end_date=None, min_completeness=0.95):
    """Share of the calendar days of the range that occur."""
    day = period_number(moment(timestamp_column), "daily")
    bounds = [period_number(F.lit(str(d)).cast("timestamp"), "daily") if d else None for d in (start_date, end_date)]
    g = t.frame(f"days:{timestamp_column}", lambda: t.df.select(day.alias("d")).dropna().distinct())
    lo = bounds[0] if bounds[0] is not None else t.stat(F.min("d"), g)
    hi = bounds[1] if bounds[1] is not None else t.stat(F.max("d"), g)
    inside = F.lit(True)
    if bounds[0] is not None:
        inside = inside & (F.col("d") >= bounds[0])
    if bounds[1] is not None:
        inside = inside & (F.col("d") <= bounds[1])
    seen, expected = t.stat(F.count_if(inside), g), hi - lo + 1
    share = seen / expected
    t.verdict(timestamp_column, expected - seen, expected, share >= float(min_completeness), share, g)


@check("timeseries")
def TimeSeriesDateRange(t, timestamp_column, min_date=None, max_date=None):
    """Times lie in a closed range."""
    ts, ok = moment(timestamp_column), F.lit(True)
    if min_date is not None:
        ok = ok & (ts >= F.lit(str(min_date)).cast("timestamp"))
    if max_date is not None:
        ok = ok & (ts <= F.lit(str(max_date)).cast("timestamp"))
    t.rows(timestamp_column, ~ok, ts.isNotNull())


@check("timeseries")
def TimeSeriesValueCompleteness(t, timestamp_column, value_column, max_null_ratio=0.05):
    """Share of the time points that have no value."""
    g = t.frame(f"points:{timestamp_column}:{value_column}", lambda: t.df.filter(F.col(timestamp_column).isNotNull())
                .groupBy(timestamp_column).agg(F.count(value_column).alias("filled")))
    bad, total = t.stat(F.count_if(F.col("filled") == 0), g), t.stat(F.count(F.lit(1)), g)
    share = F.when(total > 0, bad / total).otherwise(F.lit(0.0))
    t.verdict(value_column, bad, total, share <= float(max_null_ratio), share, g)
