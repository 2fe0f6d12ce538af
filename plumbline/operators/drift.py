"""Two-table drift: fourteen methods, one result row per column.

Binned methods never shuffle values of a numeric column: the bin counts of
both tables are conditional counts in one aggregate. Distribution-function
methods count distinct values first and add running totals over range
partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numeric import chi_square_sf, kolmogorov_sf
from plumbline.plans.primitives import exact_quantiles, paired_counts, running_totals

# Default threshold of each method.
THRESHOLDS = {"auto": 0.05, "ks": 0.05, "psi": 0.1, "chi2": 0.05, "js": 0.1, "kl": 0.1, "wasserstein": 0.1,
              "cvm": 0.05, "anderson": 0.05, "hellinger": 0.1, "bhattacharyya": 0.1, "tv": 0.1, "energy": 0.1,
              "mmd": 0.1}
P_VALUE_METHODS = ("ks", "chi2", "cvm", "anderson")
BINNED = ("psi", "js", "kl", "hellinger", "bhattacharyya", "tv")
CUMULATIVE = ("ks", "cvm", "anderson", "wasserstein", "energy")
BINS = 10
EPS = 1e-6
MMD_FEATURES = 32


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def two_sided(base: DataFrame, cur: DataFrame, a: Column, b: Column) -> DataFrame:
    """(x, side): side 0 is the baseline."""
    return base.select(a.alias("x"), F.lit(0).alias("side")).unionByName(cur.select(b.alias("x"), F.lit(1).alias("side")))


def on(side: int, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def terms(method: str, p: Column, q: Column) -> Column:
    """One bin's share of a binned distance (p baseline, q current)."""
    m = (p + q) / 2
    return {
        "psi": (p - q) * F.log(p / q),
        "kl": p * F.log(p / q),
        "js": (p * F.log(p / m) + q * F.log(q / m)) / 2,
        "hellinger": F.pow(F.sqrt(p) - F.sqrt(q), 2) / 2,
        "bhattacharyya": F.sqrt(p * q),
        "tv": F.abs(p - q) / 2,
    }[method]


def finish(method: str, total: Column) -> Column:
    if method == "hellinger":
        return F.sqrt(total)
    if method == "bhattacharyya":
        return -F.log(F.least(total, F.lit(1.0)))
    return total


def bin_edges(base: DataFrame, c: Column, n_bins: int = BINS) -> list[float]:
    """Inner edges: distinct baseline quantiles."""
    edges = exact_quantiles(base, [(c, i / n_bins) for i in range(1, n_bins)])
    return sorted({e for e in edges if e is not None})


def bin_counts(both: DataFrame, edges: Sequence[float]) -> DataFrame:
    """One row: n0, n1 and arrays c0, c1 of the counts per bin ]e(i-1), e(i)]."""
    x = F.col("x").cast("double")
    aggs = [F.count(on(s, x)).alias(f"n{s}") for s in (0, 1)]
    for s in (0, 1):
        aggs += [F.count_if((F.col("side") == s) & (x <= e)).alias(f"u{s}_{i}") for i, e in enumerate(edges)]
    row = both.agg(*aggs)

    def bins(s: int) -> Column:
        ups = [F.lit(0)] + [F.col(f"u{s}_{i}") for i in range(len(edges))] + [F.col(f"n{s}")]
        return F.array(*[(b - a).cast("long") for a, b in zip(ups, ups[1:])])

    return row.select("n0", "n1", bins(0).alias("c0"), bins(1).alias("c1"))


def binned_rows(base: DataFrame, cur: DataFrame, a: Column, b: Column, numeric: bool, n_bins: int = BINS) -> DataFrame:
    """Rows (bin, p, q): smoothed shares of baseline and current."""
    if numeric:
        counts = bin_counts(two_sided(base, cur, a, b), bin_edges(base, a, n_bins))
        return counts.select("n0", "n1", F.posexplode(F.arrays_zip("c0", "c1")).alias("i", "c")).select(
            F.col("i").cast("string").alias("bin"), *shares(F.col("c.c0"), F.col("c.c1"), F.col("n0"), F.col("n1")))
    counts = paired_counts(base, cur, a.cast("string"), b.cast("string"))
    n0, n1 = totals(base, cur, a, b)
    return counts.select(F.col("v").alias("bin"), *shares(F.col("na"), F.col("nb"), F.lit(n0), F.lit(n1)))


def shares(c0: Column, c1: Column, n0: Column, n1: Column) -> list[Column]:
    return [F.greatest(c0 / F.greatest(n0, F.lit(1)), F.lit(EPS)).alias("p"),
            F.greatest(c1 / F.greatest(n1, F.lit(1)), F.lit(EPS)).alias("q")]


def totals(base: DataFrame, cur: DataFrame, a: Column, b: Column) -> tuple[int, int]:
    row = two_sided(base, cur, a.isNotNull(), b.isNotNull()).agg(
        F.count_if((F.col("side") == 0) & F.col("x")).alias("n0"),
        F.count_if((F.col("side") == 1) & F.col("x")).alias("n1")).first()
    return row["n0"], row["n1"]


def binned(method: str, base: DataFrame, cur: DataFrame, a: Column, b: Column, numeric: bool,
           n_bins: int = BINS) -> DataFrame:
    rows = binned_rows(base, cur, a, b, numeric, n_bins)
    return rows.agg(finish(method, F.sum(terms(method, F.col("p"), F.col("q")))).alias("statistic"),
                    F.lit(None).cast("double").alias("p_value"))


def chi2(base: DataFrame, cur: DataFrame, a: Column, b: Column, numeric: bool,
         min_expected: float = 0.0) -> DataFrame:
    """2 x k contingency of values (or baseline bins); expected counts at or
    below ``min_expected`` are left out of the sum."""
    if numeric:
        counts = bin_counts(two_sided(base, cur, a, b), bin_edges(base, a))
        rows = counts.select(F.explode(F.arrays_zip("c0", "c1")).alias("c"), "n0", "n1").select(
            F.col("c.c0").alias("na"), F.col("c.c1").alias("nb"), "n0", "n1")
    else:
        n0, n1 = totals(base, cur, a, b)
        rows = paired_counts(base, cur, a.cast("string"), b.cast("string")).select(
            "na", "nb", F.lit(n0).alias("n0"), F.lit(n1).alias("n1"))
    t = F.col("na") + F.col("nb")
    e0, e1 = t * F.col("n0") / (F.col("n0") + F.col("n1")), t * F.col("n1") / (F.col("n0") + F.col("n1"))
    part = reduce(lambda x, y: x + y, [
        F.when(e > min_expected, F.pow(o - e, 2) / e).otherwise(0.0) for o, e in ((F.col("na"), e0), (F.col("nb"), e1))])
    stat, df = F.sum(part), F.count_if(t > 0) - 1
    return rows.agg(stat.alias("statistic"), chi_square_sf(stat, df).alias("p_value"))


@F.pandas_udf(T.DoubleType())
def cvm_p(stat: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Limit distribution of the two-sample statistic (one row per column)."""
    def one(t: float, a: float, b: float) -> float:
        if not (t == t) or a < 1 or b < 1:
            return 1.0
        total = a + b
        var = (total + 1) / total ** 2 * (4 * a * b * total - 3 * (a * a + b * b) - 2 * a * b) / (180 * a * b)
        x = 1 / 6 + (t - (1 + 1 / total) / 6) / math.sqrt(45 * max(var, 1e-300))
        return limit_cvm_sf(x)
    return pd.Series([one(*r) for r in zip(stat, n, m)])


def limit_cvm_sf(x: float) -> float:
    """1 - CDF of the Cramer-von Mises limit law by its Bessel series."""
    if x <= 0.003:
        return 1.0
    u = np.linspace(0.0, 12.0, 4001)
    total = 0.0
    for k in range(12):
        y = 4 * k + 1
        q = y * y / (16 * x)
        if q > 600:
            break
        vals = np.exp(-q * np.cosh(u)) * np.cosh(0.25 * u)
        bessel = float(np.sum((vals[1:] + vals[:-1]) / 2) * (u[1] - u[0]))
        coef = math.gamma(k + 0.5) / (math.gamma(0.5) * math.gamma(k + 1))
        total += coef * math.sqrt(y) * math.exp(-q) * bessel
    return float(min(1.0, max(0.0, 1.0 - total / (math.pi * math.sqrt(x)))))


def harmonic(n: int) -> float:
    """1 + 1/2 + ... + 1/n by the asymptotic series at n + 16, for any n."""
    m = n + 16
    far = math.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m ** 2) + 1 / (120 * m ** 4) - 1 / (252 * m ** 6)
    return far - sum(1 / k for k in range(n + 1, m + 1))


def harmonic_squares(n: int) -> float:
    """1 + 1/4 + ... + 1/n^2, likewise."""
    m = n + 16
    far = math.pi ** 2 / 6 - 1 / m + 1 / (2 * m ** 2) - 1 / (6 * m ** 3) + 1 / (30 * m ** 5) - 1 / (42 * m ** 7)
    return far - sum(1 / k ** 2 for k in range(n + 1, m + 1))


@F.pandas_udf(T.DoubleType())
def anderson_p(stat: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Scholz-Stephens p-value, kept within the tabled 0.001 to 0.25."""
    def one(a2: float, a: float, b: float) -> float:
        if not (a2 == a2) or a < 2 or b < 2:
            return 1.0
        total = int(a + b)
        big_h = 1 / a + 1 / b
        h = harmonic(total - 1)
        # The double sum of 1 / ((n - i) j) over i < j < n in closed form.
        g = harmonic_squares(total) - (h + harmonic(total)) / total
        c_a = (4 * g - 6) * 1 + (10 - 6 * g) * big_h
        c_b = (2 * g - 4) * 4 + 8 * h * 2 + (2 * g - 14 * h - 4) * big_h - 8 * h + 4 * g - 6
        c_c = (6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * big_h + 4 * h
        c_d = (2 * h + 6) * 4 - 4 * h * 2
        var = (c_a * total ** 3 + c_b * total ** 2 + c_c * total + c_d) / ((total - 1.0) * (total - 2.0) * (total - 3.0))
        a2n = (a2 - 1) / math.sqrt(max(var, 1e-12))
        # Critical points for two samples at these levels.
        levels = np.log([0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001])
        critical = np.array([0.675 - 0.245 - 0.105, 1.281 + 0.25 - 0.305, 1.645 + 0.678 - 0.362, 1.96 + 1.149 - 0.391,
                             2.326 + 1.822 - 0.396, 2.573 + 2.364 - 0.345, 3.085 + 3.615 - 0.154])
        if a2n < critical[0]:
            return 0.25
        if a2n > critical[-1]:
            return 0.001
        return float(np.exp(np.polyval(np.polyfit(critical, levels, 2), a2n)))
    return pd.Series([one(*r) for r in zip(stat, n, m)])


def cumulative(method: str, base: DataFrame, cur: DataFrame, a: Column, b: Column, normalize: bool = True) -> DataFrame:
    """Distances between the two empirical distribution functions."""
    a, b = a.cast("double"), b.cast("double")
    run = running_totals(paired_counts(base, cur, a, b), "v", ["na", "nb"])
    row = two_sided(base, cur, a, b).agg(
        F.count(on(0, F.col("x"))).alias("n0"), F.count(on(1, F.col("x"))).alias("n1"),
        F.stddev_samp(on(0, F.col("x"))).alias("sd")).first()
    n0, n1 = float(max(row["n0"], 1)), float(max(row["n1"], 1))
    gap = F.col("cum_na") / n0 - F.col("cum_nb") / n1
    step = F.coalesce(F.col("next_v") - F.col("v"), F.lit(0.0))
    size, none = F.col("na") + F.col("nb"), F.lit(None).cast("double")
    if method == "ks":
        d = F.max(F.abs(gap))
        return run.agg(d.alias("statistic"), kolmogorov_sf(d, F.lit(n0), F.lit(n1)).alias("p_value"))
    if method == "wasserstein":
        scale = row["sd"] if normalize and row["sd"] else 1.0
        return run.agg((F.sum(F.abs(gap) * step) / scale).alias("statistic"), none.alias("p_value"))
    if method == "energy":
        return run.agg((F.sum(gap * gap * step) * 2).alias("statistic"), none.alias("p_value"))
    if method == "cvm":
        t = F.sum(size * gap * gap) * (n0 * n1 / (n0 + n1) ** 2)
        return run.agg(t.alias("statistic")).select(
            "statistic", cvm_p(F.col("statistic"), F.lit(n0), F.lit(n1)).alias("p_value"))
    if method == "anderson":
        total = n0 + n1
        mid_all = F.col("cum_na") + F.col("cum_nb") - size / 2
        mids = ((F.col("cum_na") - F.col("na") / 2, n0), (F.col("cum_nb") - F.col("nb") / 2, n1))
        weight = mid_all * (total - mid_all) - size * (total / 4)
        parts = reduce(lambda x, y: x + y, [F.pow(m * total - mid_all * n, 2) / n for m, n in mids])
        stat = F.sum(F.when(weight > 0, size * parts / weight)) * ((total - 1) / total ** 2)
        return run.agg(stat.alias("statistic")).select(
            "statistic", anderson_p(F.col("statistic"), F.lit(n0), F.lit(n1)).alias("p_value"))
    raise ValueError(f"unknown method {method!r}")


def mmd(base: DataFrame, cur: DataFrame, a: Column, b: Column) -> DataFrame:
    """Squared maximum mean discrepancy of an RBF kernel by Fourier features.

    The bandwidth is the pooled interquartile range over sqrt(2), which is the
    median pair distance of normal data; frequencies are normal quantiles, so
    the result is repeatable.
    """
    both = two_sided(base, cur, a.cast("double"), b.cast("double"))
    q1, q3 = exact_quantiles(both, [(F.col("x"), 0.25), (F.col("x"), 0.75)])
    width = ((q3 - q1) / math.sqrt(2) if q1 is not None else 0) or 1.0
    parts = []
    for at in range(0, MMD_FEATURES, 8):
        # A few frequencies per aggregate; more would not compile to fast code.
        aggs, terms_ = [], []
        for i in range(at, min(at + 8, MMD_FEATURES)):
            w = NormalDist().inv_cdf((i + 0.5) / MMD_FEATURES) / width
            for k, f in (("c", F.cos), ("s", F.sin)):
                aggs += [F.avg(on(s, f(F.col("x") * w))).alias(f"{k}{i}_{s}") for s in (0, 1)]
                terms_.append(F.pow(F.col(f"{k}{i}_0") - F.col(f"{k}{i}_1"), 2))
        parts.append(both.agg(*aggs).select(reduce(lambda x, y: x + y, terms_).alias("part")))
    return reduce(lambda x, y: x.unionByName(y), parts).agg((F.sum("part") / MMD_FEATURES).alias("statistic"),
                                                            F.lit(None).cast("double").alias("p_value"))


def measure(method: str, base: DataFrame, cur: DataFrame, a: Column, b: Column, numeric: bool) -> DataFrame:
    """One row (statistic, p_value)."""
    if method in BINNED:
        return binned(method, base, cur, a, b, numeric)
    if method == "chi2":
        return chi2(base, cur, a, b, numeric)
    if not numeric:
        raise ValueError(f"{method} needs a numeric column")
    return mmd(base, cur, a, b) if method == "mmd" else cumulative(method, base, cur, a, b)


def compare(base: DataFrame, cur: DataFrame, columns: Sequence[str] | None = None, method: str = "auto",
            threshold: float | None = None) -> DataFrame:
    """Drift of the common (or given) columns, one row each."""
    kinds = {f.name: f.dataType for f in base.schema.fields}
    cur_kinds = {f.name: f.dataType for f in cur.schema.fields}
    chosen = list(columns) if columns else [c for c in kinds if c in cur_kinds]
    parts = []
    for c in chosen:
        numeric = is_numeric(kinds[c]) and is_numeric(cur_kinds[c])
        how = ("psi" if numeric else "chi2") if method == "auto" else method
        if not numeric and (how in CUMULATIVE or how == "mmd"):
            if columns:
                raise ValueError(f"{how} needs a numeric column, {c} is {kinds[c].simpleString()}")
            continue
        limit = threshold if threshold is not None else THRESHOLDS[how]
        hit = F.col("p_value") < limit if how in P_VALUE_METHODS else F.col("statistic") > limit
        parts.append(measure(how, base, cur, F.col(c), F.col(c), numeric).select(
            F.lit(c).alias("column"), F.lit(kinds[c].simpleString()).alias("dtype"), F.lit(how).alias("method"),
            F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"),
            F.lit(float(limit)).alias("threshold"), F.coalesce(hit, F.lit(False)).alias("drifted")))
    if not parts:
        raise ValueError("no column to compare")
    return reduce(lambda x, y: x.unionByName(y), parts)


def summary(drift: DataFrame) -> DataFrame:
    """Overall verdict of a comparison."""
    n, bad = F.count(F.lit(1)), F.count_if("drifted")
    return drift.agg(n.alias("total_columns"), bad.alias("drifted_columns"),
                     F.round(bad * 100.0 / n, 6).alias("drift_percentage"), (bad > 0).alias("has_drift"))
