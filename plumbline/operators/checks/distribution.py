"""Checks on value ranges, outliers and distributions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.functions.numeric import chi_square_sf, finite, normal_cdf
from plumbline.plans.planner import Quantile
from plumbline.plans.primitives import running_totals, value_counts
from plumbline.plans.registry import check


def in_bounds(c, lo, hi, inclusive_min=True, inclusive_max=True):
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (c >= lo if inclusive_min else c > lo)
    if hi is not None:
        ok = ok & (c <= hi if inclusive_max else c < hi)
    return ok


@check("distribution")
def Between(t, column, min_value, max_value, mostly=None):
    """Values lie in a closed range."""
    c = F.col(column)
    t.rows(column, ~c.between(min_value, max_value), c.isNotNull(), mostly)


@check("distribution")
def Range(t, column, min_value=None, max_value=None, inclusive_min=True, inclusive_max=True):
    """Values lie in a range with chosen open ends."""
    c = F.col(column)
    t.rows(column, ~in_bounds(c, min_value, max_value, inclusive_min, inclusive_max), c.isNotNull())


@check("distribution", "high")
def Positive(t, column):
    """Values are greater than zero."""
    t.rows(column, F.col(column) <= 0, F.col(column).isNotNull())


@check("distribution", "high")
def NonNegative(t, column):
    """Values are zero or more."""
    t.rows(column, F.col(column) < 0, F.col(column).isNotNull())


@check("distribution")
def InSet(t, column, value_set, mostly=None):
    """Values belong to a set."""
    c = F.col(column)
    t.rows(column, ~c.isin(list(value_set)), c.isNotNull(), mostly)


@check("distribution", "high")
def NotInSet(t, column, forbidden_set):
    """Values do not belong to a set."""
    c = F.col(column)
    t.rows(column, c.isin(list(forbidden_set)), c.isNotNull())


def monotonic(t, column, strict, order_by, up):
    """Neighbours in the order of ``order_by`` (which must be unique)."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    p = t.pairs(order, {"v": F.col(column)}, F.col(column).isNotNull())

    def wrong(cur, prev):
        a, b = (prev("v"), cur("v")) if up else (cur("v"), prev("v"))
        return (a >= b) if strict else (a > b)

    name = f"wrong_{'up' if up else 'down'}_{'strict' if strict else 'loose'}"
    bad = t.stat(("sum", wrong), p, name)
    t.verdict(column, bad, F.greatest(F.col("rows") - 1, F.lit(0)), frame=p)


@check("distribution")
def Increasing(t, column, order_by, strict=False):
    """Values rise along an explicit order."""
    monotonic(t, column, strict, order_by, True)


@check("distribution")
def Decreasing(t, column, order_by, strict=False):
    """Values fall along an explicit order."""
    monotonic(t, column, strict, order_by, False)


@check("distribution")
def Outlier(t, column, iqr_multiplier=1.5):
    """Values beyond the quartiles by a multiple of their distance."""
    c = F.col(column)
    q1, q3 = yield [Quantile(c, 0.25), Quantile(c, 0.75)]
    if q1 is None:
        return t.rows(column, F.lit(False), c.isNotNull())
    reach = iqr_multiplier * (q3 - q1)
    t.rows(column, (c < q1 - reach) | (c > q3 + reach), c.isNotNull())


@check("distribution")
def ZScoreOutlier(t, column, threshold=3.0):
    """Values more than ``threshold`` sample deviations from the mean; NaN and infinities are not judged."""
    c = finite(F.col(column))
    mean, sd = yield [F.avg(c), F.stddev_samp(c)]
    far = F.abs(c - mean) / sd > threshold if sd else F.lit(False)
    t.rows(column, far, c.isNotNull())


@check("distribution", name="Quantile")
def QuantileAtMost(t, column, quantile, max_value):
    """A quantile does not exceed a maximum."""
    (q,) = yield [Quantile(F.col(column), float(quantile))]
    t.value(column, F.lit(q).cast("double"), hi=max_value)


@check("distribution", "low")
def Distribution(t, column, distribution, alpha=0.05):
    """Kolmogorov distance to a fitted distribution stays below the critical
    value c(alpha)/sqrt(n).

    The fit uses the sample moments. For poisson and binomial the distance is
    taken between cumulative shares at the observed whole numbers.
    """
    c = F.col(column).cast("double")
    n, mean, sd, lo, hi = yield [F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)]
    if not n or n < 2 or not sd:
        return t.value(column, F.lit(None).cast("double"))
    frame = t.frame(f"ecdf:{column}", lambda: running_totals(
        value_counts(t.df.filter(c.isNotNull()), {"v": c}), "v", ["n"]))
    v = F.col("v")
    if distribution == "normal":
        cdf = normal_cdf((v - mean) / sd)
    elif distribution == "uniform":
        cdf = (v - lo) / (hi - lo)
    elif distribution == "exponential":
        cdf = F.when(v > 0, F.lit(1.0) - F.exp(-v / mean)).otherwise(F.lit(0.0))
    elif distribution in ("poisson", "binomial"):
        # Normal approximation with continuity correction to the discrete CDF.
        var = mean if distribution == "poisson" else max(mean * (1 - mean / max(hi, 1e-9)), 1e-12)
        cdf = normal_cdf((v + 0.5 - mean) / math.sqrt(max(var, 1e-12)))
    else:
        raise ValueError(f"unknown distribution {distribution!r}")
    after = F.abs(F.col("cum_n") / n - cdf)
    before = F.abs((F.col("cum_n") - F.col("n")) / n - cdf)
    gap = after if distribution in ("poisson", "binomial") else F.greatest(after, before)
    distance = t.stat(F.max(gap), frame)
    t.value(column, distance, hi=math.sqrt(-math.log(alpha / 2) / 2) / math.sqrt(n), frame=frame)


def shares(t, column):
    """Value counts with the total of the non-null rows beside them."""
    return t.groups([column], F.col(column).isNotNull())


@check("distribution")
def KLDivergence(t, column, reference_distribution, threshold=0.1):
    """Sum of p ln(p/q) against reference shares (1e-10 where q is absent)."""
    (n,) = yield [F.count(F.col(column))]
    g = shares(t, column)
    q = F.lit(1e-10)
    for value, share in dict(reference_distribution).items():
        q = F.when(F.col("k0") == F.lit(value), F.lit(max(float(share), 1e-10))).otherwise(q)
    p = F.col("n") / F.lit(float(max(n, 1)))
    t.value(column, t.stat(F.coalesce(F.sum(p * F.log(p / q)), F.lit(0.0)), g), hi=threshold, frame=g)


@check("distribution")
def ChiSquare(t, column, expected_frequencies, alpha=0.05):
    """Goodness of fit of value counts to expected counts or shares.

    Expected numbers are scaled to the observed total of the listed values;
    the p-value uses the Wilson-Hilferty approximation.
    """
    wanted = dict(expected_frequencies)
    c = F.col(column)
    (n,) = yield [F.count_if(c.isin(list(wanted)))]
    scale = n / sum(float(v) for v in wanted.values())
    g = shares(t, column)
    stat = F.lit(0.0)
    for value, share in wanted.items():
        seen = t.stat(F.coalesce(F.sum(F.when(F.col("k0") == F.lit(value), F.col("n"))), F.lit(0)), g)
        e = float(share) * scale
        if e > 0:
            stat = stat + F.pow(seen - F.lit(e), 2) / F.lit(e)
    p = chi_square_sf(stat, F.lit(float(len(wanted) - 1)))
    t.value(column, stat, ok=p >= alpha, frame=g)


def mode_stats(t, column):
    """(frame, most common value, its share); ties go to the smaller value."""
    g = shares(t, column)
    mode = t.stat(F.min_by("k0", F.struct(-F.col("n"), F.col("k0"))), g)
    top, total = t.stat(F.max("n"), g), t.stat(F.sum("n"), g)
    return g, mode, top / total


@check("distribution", "low")
def MostCommonValue(t, column, expected_value=None, min_frequency=None):
    """The most common value is as expected and frequent enough."""
    g, mode, share = mode_stats(t, column)
    ok = F.lit(True)
    if expected_value is not None:
        ok = ok & (mode == F.lit(expected_value))
    if min_frequency is not None:
        ok = ok & (share >= min_frequency)
    t.value(column, share, ok=ok, frame=g)
