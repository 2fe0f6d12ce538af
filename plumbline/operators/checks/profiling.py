"""Checks of column characteristics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.checks.distribution import mode_stats, shares
from plumbline.operators.checks.uniqueness import DistinctCount, UniqueRatio
from plumbline.plans.primitives import running_totals, value_counts
from plumbline.plans.registry import check


@check("profiling")
def Cardinality(t, column, min_cardinality=None, max_cardinality=None):
    """Number of distinct values is within bounds."""
    DistinctCount(t, column, min_cardinality, max_cardinality)


@check("profiling")
def UniquenessRatio(t, column, min_ratio=None, max_ratio=None):
    """Distinct share of the values is within bounds."""
    UniqueRatio(t, column, min_ratio, max_ratio)


def entropy_of(t, g, n="n"):
    """Shannon entropy in bits of the counts of a frame: log2 N - E[log2 n]."""
    total, weighted = t.stat(F.sum(n), g), t.stat(F.sum(F.col(n) * F.log2(F.col(n))), g)
    return F.coalesce(F.greatest(F.log2(total) - weighted / total, F.lit(0.0)), F.lit(0.0))


@check("profiling")
def Entropy(t, column, min_entropy=None, max_entropy=None):
    """Shannon entropy in bits is within bounds."""
    g = shares(t, column)
    t.value(column, entropy_of(t, g), min_entropy, max_entropy, frame=g)


def pair_entropy(df, a, b):
    """One row: n, and sum of n log2 n over pairs and over each margin."""
    pairs = value_counts(df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna(),
                         {"a": F.col("a"), "b": F.col("b")})
    rows = (pairs.select(F.lit("ab").alias("m"), F.col("n")).unionByName(
        pairs.groupBy("a").agg(F.sum("n").alias("n")).select(F.lit("a").alias("m"), "n")).unionByName(
        pairs.groupBy("b").agg(F.sum("n").alias("n")).select(F.lit("b").alias("m"), "n")))
    part = F.col("n") * F.log2("n")
    return rows.agg(F.sum(F.when(F.col("m") == "ab", F.col("n"))).alias("n"),
                    *[F.sum(F.when(F.col("m") == m, part)).alias(f"s_{m}") for m in ("ab", "a", "b")])


def mutual_information(row):
    """I(a;b) in bits from the sums of ``pair_entropy``."""
    n = row("n")
    return F.greatest(F.log2(n) + (row("s_ab") - row("s_a") - row("s_b")) / n, F.lit(0.0))


@check("profiling", "low")
def InformationGain(t, feature_column, target_column, min_gain=None):
    """Information the feature gives about the target, in bits."""
    g = t.frame(f"mi:{feature_column}:{target_column}", lambda: pair_entropy(t.df, feature_column, target_column))
    gain = mutual_information(lambda c: t.stat(F.max(c), g))
    t.value(f"{feature_column},{target_column}", gain, lo=min_gain, frame=g)


@check("profiling", "low")
def ValueFrequency(t, column, expected_distribution="uniform", tolerance=0.1):
    """Ranked value shares follow a shape; largest gap within tolerance.

    Shapes over k values ranked by falling share: uniform 1/k, exponential
    2^-r normalised, power_law 1/r normalised, normal exp(-z^2/2) with z from
    0 to 3 along the ranks. The k shares are ranked over range partitions.
    """
    c = F.col(column)
    (total,) = yield [F.count(c)]
    counts = value_counts(t.df.filter(c.isNotNull()), {"v": c})
    ranked = running_totals(counts.select("v", "n", (-F.col("n")).alias("neg"), F.lit(1).alias("one")),
                            "neg", ["one"], ["v"])
    g = t.frame(f"ranked:{column}", lambda: ranked)
    k, r = ranked.count(), F.col("cum_one").cast("double")
    if expected_distribution == "normal":
        w = F.exp(-F.pow((r - 1) * 3.0 / max(k - 1, 1), 2) / 2)
    elif expected_distribution == "exponential":
        w = F.pow(F.lit(2.0), -r)
    elif expected_distribution == "power_law":
        w = F.lit(1.0) / r
    else:
        w = F.lit(1.0)
    norm = ranked.agg(F.sum(w)).first()[0] or 1.0
    gap = t.stat(F.max(F.abs(F.col("n") / float(max(total, 1)) - w / float(norm))), g)
    t.value(column, F.coalesce(gap, F.lit(0.0)), hi=float(tolerance), frame=g)


@check("profiling", "low")
def DistributionShape(t, column, max_skewness=None, max_kurtosis=None):
    """Skewness and population excess kurtosis are small enough."""
    s, k = t.stat(F.skewness(column)), t.stat(F.kurtosis(column))
    ok = F.lit(True)
    if max_skewness is not None:
        ok = ok & (F.abs(s) <= max_skewness)
    if max_kurtosis is not None:
        ok = ok & (F.abs(k) <= max_kurtosis)
    t.value(column, s, ok=ok)


@check("profiling", "low")
def MostCommonValue(t, column, expected_value=None, max_frequency_ratio=None):
    """The most common value is as expected and not too frequent."""
    g, mode, share = mode_stats(t, column)
    ok = F.lit(True)
    if expected_value is not None:
        ok = ok & (mode == F.lit(expected_value))
    if max_frequency_ratio is not None:
        ok = ok & (share <= max_frequency_ratio)
    t.value(column, share, ok=ok, frame=g)


CASTS = {"integer": "bigint", "float": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"}


@check("profiling")
def DataTypeConsistency(t, column, expected_type):
    """Every value can be read as the expected type."""
    c = F.col(column)
    text = c.cast("string")
    bad = F.lit(False) if expected_type in ("string", "categorical") else text.try_cast(CASTS[expected_type]).isNull()
    t.rows(column, bad, c.isNotNull())
