"""Checks of machine-learning features."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.checks.distribution import shares
from plumbline.operators.checks.profiling import mutual_information, pair_entropy
from plumbline.operators.ranks import kendall, spearman
from plumbline.functions.numeric import finite
from plumbline.plans.planner import Quantile
from plumbline.plans.registry import check


@check("ml_feature")
def FeatureNullImpact(t, column, target_column=None, max_null_ratio=0.1, max_impact_score=None):
    """Null share, and the change of the target mean where the value is null."""
    c = F.col(column)
    share = t.stat(F.avg(c.isNull().cast("int")))
    ok = share <= float(max_null_ratio)
    if target_column and max_impact_score is not None:
        y = F.col(target_column)
        impact = F.abs(t.stat(F.avg(F.when(c.isNull(), y))) - t.stat(F.avg(F.when(c.isNotNull(), y))))
        ok = ok & (F.coalesce(impact, F.lit(0.0)) <= float(max_impact_score))
    t.value(column, share, ok=ok)


@check("ml_feature")
def FeatureScale(t, column, expected_scale, tolerance=0.1):
    """The column is standardised, min-max scaled, robustly scaled or of unit norm.

    The observed number is the largest departure from the expected constants.
    """
    c = F.col(column)
    if expected_scale == "robust":
        q1, q2, q3 = yield [Quantile(c, 0.25), Quantile(c, 0.5), Quantile(c, 0.75)]
        off = F.lit(max(abs(q2), abs(q3 - q1 - 1.0)) if q2 is not None else None).cast("double")
    elif expected_scale == "standard":
        off = F.greatest(F.abs(t.stat(F.avg(c))), F.abs(t.stat(F.stddev_pop(c)) - 1.0))
    elif expected_scale == "minmax":
        off = F.greatest(F.abs(t.stat(F.min(c))), F.abs(t.stat(F.max(c)) - 1.0))
    elif expected_scale == "unit_norm":
        off = F.abs(F.sqrt(t.stat(F.sum(c * c))) - 1.0)
    else:
        raise ValueError(f"unknown scale {expected_scale!r}")
    t.value(column, off, hi=float(tolerance))


@check("ml_feature")
def FeatureCorrelationMatrix(t, columns, max_correlation=0.9, method="pearson"):
    """No pair of features is correlated beyond the maximum."""
    for a, b in combinations(columns, 2):
        if method == "pearson":
            r = t.stat(F.corr(a, b))
            t.value(f"{a},{b}", r, ok=F.abs(r) <= max_correlation)
        else:
            f = {"spearman": spearman, "kendall": kendall}[method]
            g = t.frame(f"{method}:{a}:{b}", lambda a=a, b=b, f=f: f(t.df, F.col(a), F.col(b)))
            r = t.stat(F.max("value"), g)
            t.value(f"{a},{b}", r, ok=F.abs(r) <= max_correlation, frame=g)


@check("ml_feature", "critical")
def TargetLeakage(t, feature_columns, target_column, leakage_threshold=0.95):
    """No feature determines the target: correlation of numbers, share of the
    target's entropy explained for categories."""
    kinds = {f.name: f.dataType for f in t.df.schema.fields}
    for c in feature_columns:
        if isinstance(kinds[c], T.NumericType) and isinstance(kinds[target_column], T.NumericType):
            r = t.stat(F.abs(F.corr(c, target_column)))
            t.value(c, r, hi=float(leakage_threshold))
        else:
            g = t.frame(f"mi:{c}:{target_column}", lambda c=c: pair_entropy(t.df, c, target_column))
            row = lambda k, g=g: t.stat(F.max(k), g)
            entropy = F.log2(row("n")) - row("s_b") / row("n")
            share = F.when(entropy > 0, mutual_information(row) / entropy).otherwise(F.lit(0.0))
            t.value(c, share, hi=float(leakage_threshold), frame=g)


@check("ml_feature", "low")
def FeatureImportance(t, column, target_column, min_importance=0.01, method="mutual_info"):
    """Mutual information (nats; numbers in ten quantile bins), absolute
    correlation, or the ANOVA F of the feature over the target classes."""
    c = F.col(column)
    if method == "correlation":
        return t.value(column, t.stat(F.abs(F.corr(column, target_column))), lo=float(min_importance))
    if method == "f_score":
        (centre,) = yield [F.avg(c)]  # class means about it, so large values lose no digits
        g = t.frame(f"anova:{column}:{target_column}", lambda: t.df.filter(c.isNotNull()).groupBy(target_column).agg(
            F.count(F.lit(1)).alias("n"), F.avg(c - F.lit(float(centre or 0.0))).alias("m"), F.var_pop(c).alias("v")))
        n, k = t.stat(F.sum("n"), g), t.stat(F.count(F.lit(1)), g)
        mean = t.stat(F.sum(F.col("m") * F.col("n")), g) / n
        between = t.stat(F.sum(F.col("m") * F.col("m") * F.col("n")), g) - mean * mean * n
        within = t.stat(F.sum(F.col("v") * F.col("n")), g)
        score = F.when(within > 0, (between / (k - 1)) / (within / (n - k)))
        return t.value(column, score, ok=score >= float(min_importance), frame=g)
    edges = []
    if isinstance(t.df.schema[column].dataType, T.NumericType):
        edges = yield [Quantile(c, i / 10) for i in range(1, 10)]
        edges = sorted({e for e in edges if e is not None})

    def build():
        src = t.df
        if edges:
            binned = F.lit(0)
            for e in edges:
                binned = binned + (c > e).cast("int")
            src = src.filter(c.isNotNull()).withColumn(column, binned)
        return pair_entropy(src, column, target_column)

    g = t.frame(f"mi10:{column}:{target_column}", build)
    score = mutual_information(lambda k: t.stat(F.max(k), g)) * math.log(2)
    t.value(column, score, lo=float(min_importance), frame=g)


@check("ml_feature")
def FeatureVariance(t, column, min_variance=0.01):
    """Sample variance is large enough."""
    t.value(column, t.stat(F.var_samp(column)), lo=float(min_variance))


@check("ml_feature")
def FeatureOutlierRatio(t, column, max_outlier_ratio=0.05, method="iqr"):
    """Share of outliers by quartile fences, z-score 3 or MAD 3.5; NaN and infinities are not judged."""
    c = finite(F.col(column))
    hit = F.lit(False)
    if method == "iqr":
        q1, q3 = yield [Quantile(c, 0.25), Quantile(c, 0.75)]
        if q1 is not None:
            hit = (c < q1 - 1.5 * (q3 - q1)) | (c > q3 + 1.5 * (q3 - q1))
    elif method == "zscore":
        mean, sd = yield [F.avg(c), F.stddev_samp(c)]
        if sd:
            hit = F.abs(c - mean) / sd > 3.0
    else:
        (median,) = yield [Quantile(c, 0.5)]
        if median is not None:
            (mad,) = yield [Quantile(F.abs(c - median), 0.5)]
            if mad:
                hit = F.abs(c - median) * 0.6745 / mad > 3.5
    bad, total = t.stat(F.count_if(hit & c.isNotNull())), t.stat(F.count(c))
    share = F.when(total > 0, bad / total).otherwise(F.lit(0.0))
    t.verdict(column, bad, total, share <= float(max_outlier_ratio), share, violation=hit & c.isNotNull())


@check("ml_feature", "high")
def ClassImbalance(t, column, max_imbalance_ratio=10, min_samples_per_class=10):
    """Largest over smallest class, and the size of every class."""
    g = shares(t, column)
    lo, hi = t.stat(F.min("n"), g), t.stat(F.max("n"), g)
    small = t.stat(F.count_if(F.col("n") < min_samples_per_class), g)
    ratio = hi / lo
    t.verdict(column, small, t.stat(F.count(F.lit(1)), g), (ratio <= float(max_imbalance_ratio)) & (small == 0), ratio, g)
