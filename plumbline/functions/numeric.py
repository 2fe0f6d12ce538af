"""Distribution functions and distances as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def col(c: Column | float) -> Column:
    return c if isinstance(c, Column) else F.lit(float(c))


def erfc(x: Column) -> Column:
    """Complementary error function (Chebyshev fit, relative error 1.2e-7)."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.5)
    # Coefficients of the published fit, lowest order first.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
                    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(coefficients[-1])
    for a in reversed(coefficients[:-1]):
        poly = poly * t + F.lit(a)
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


def finite(c: Column) -> Column:
    """``c`` as a double; NaN and infinities are missing numbers."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def normal_cdf(z: Column) -> Column:
    return erfc(-z / math.sqrt(2.0)) * 0.5


def two_sided_normal(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2.0)))


def chi_square_sf(stat: Column, df: Column) -> Column:
    """Upper tail by the Wilson-Hilferty cube-root approximation."""
    k = F.lit(2.0) / (F.lit(9.0) * df)
    z = (F.cbrt(stat / df) - (F.lit(1.0) - k)) / F.sqrt(k)
    return F.when(df <= 0, F.lit(1.0)).otherwise(F.lit(1.0) - normal_cdf(z))


def two_sided_t(t: Column, df: Column) -> Column:
    """Two-sided Student t: normal beyond 100 degrees of freedom, below it
    the exact finite series for the whole part of ``df``."""
    n = F.greatest(F.floor(df).cast("int"), F.lit(1))
    theta = F.atan(F.abs(t) / F.sqrt(n.cast("double")))
    cos2 = F.pow(F.cos(theta), F.lit(2.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    # term_k = term_(k-1) * cos^2 * (m-1)/m, m = 2,4,.. (even) or 3,5,.. (odd)
    odd = n % 2 == 1
    count = F.when(odd, ((n - 1) / 2).cast("int")).otherwise((n / 2).cast("int"))
    steps = F.when(count >= 1, F.sequence(F.lit(1), F.least(count, F.lit(60)))).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(
        steps, start,
        lambda acc, k: F.struct(
            (acc["term"] * cos2 * F.when(odd, (k * 2.0) / (k * 2.0 + 1.0)).otherwise((k * 2.0 - 1.0) / (k * 2.0))).alias("term"),
            (acc["sum"] + acc["term"]).alias("sum")))["sum"]
    inside = F.when(odd, F.lit(2 / math.pi) * (theta + F.sin(theta) * F.cos(theta) * series)).otherwise(F.sin(theta) * series)
    exact = F.greatest(F.lit(0.0), F.lit(1.0) - inside)
    return F.when(df > 100, two_sided_normal(t)).otherwise(exact)


def kolmogorov_sf(d: Column, n1: Column, n2: Column) -> Column:
    """p-value of the two-sample Kolmogorov-Smirnov distance ``d``."""
    ne = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (ne + 0.12 + F.lit(0.11) / ne) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
                        * F.exp(lam * lam * (k * k * -2.0)))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total * 2.0)))


def f_over(num: Column, den: Column) -> Column:
    """Quotient, null where the divisor is zero."""
    return F.when(den != 0, num / den)


def haversine_km(lat1: Column, lon1: Column, lat2: Column | float, lon2: Column | float) -> Column:
    a1, o1, a2, o2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_KM)


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a (lat, lon) ring."""
    inside = F.lit(False)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        crosses = ((lat < y1) != (lat < y2)) & (lon < F.lit((x2 - x1) / (y2 - y1)) * (lat - y1) + x1)
        inside = inside != crosses
    return inside


def tolerance_equal(a: Column, b: Column | float, tol: float) -> Column:
    return F.abs(a - col(b) if not isinstance(b, Column) else a - b) <= tol


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparison by name (long and short spellings)."""
    return {
        "eq": lambda: a == b, "equal": lambda: a == b, "==": lambda: a == b,
        "ne": lambda: a != b, "not_equal": lambda: a != b, "!=": lambda: a != b,
        "gt": lambda: a > b, "greater": lambda: a > b, ">": lambda: a > b,
        "gte": lambda: a >= b, "greater_equal": lambda: a >= b, ">=": lambda: a >= b,
        "lt": lambda: a < b, "less": lambda: a < b, "<": lambda: a < b,
        "lte": lambda: a <= b, "less_equal": lambda: a <= b, "<=": lambda: a <= b,
    }[op]()
