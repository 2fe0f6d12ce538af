"""Outlier checks: the share of flagged rows stays below a maximum.

NaN and infinities are missing numbers: they are not judged.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import functions as F

from plumbline.functions.numeric import finite
from plumbline.functions.special import grubbs_critical
from plumbline.operators import anomaly as A
from plumbline.plans.planner import Quantile
from plumbline.plans.registry import check


def flagged(t, column, hit, applicable, max_ratio):
    """Row predicate whose share of hits is limited."""
    bad, total = t.stat(F.count_if(applicable & hit)), t.stat(F.count_if(applicable))
    share = F.when(total > 0, bad / total).otherwise(F.lit(0.0))
    t.verdict(column, bad, total, share <= float(max_ratio), share, violation=applicable & hit)


@check("anomaly")
def IQRAnomaly(t, column, iqr_multiplier=1.5, max_anomaly_ratio=0.05, detect_lower=True, detect_upper=True):
    """Values beyond the quartile fences."""
    c = finite(F.col(column))
    q1, q3 = yield [Quantile(c, 0.25), Quantile(c, 0.75)]
    hit = F.lit(False)
    if q1 is not None:
        reach = iqr_multiplier * (q3 - q1)
        if detect_lower:
            hit = hit | (c < q1 - reach)
        if detect_upper:
            hit = hit | (c > q3 + reach)
    flagged(t, column, hit, c.isNotNull(), max_anomaly_ratio)


@check("anomaly")
def ZScoreAnomaly(t, column, threshold=3.0, max_anomaly_ratio=0.05):
    """Values far from the mean in sample deviations."""
    c = finite(F.col(column))
    mean, sd = yield [F.avg(c), F.stddev_samp(c)]
    flagged(t, column, F.abs(c - mean) / sd > threshold if sd else F.lit(False), c.isNotNull(), max_anomaly_ratio)


@check("anomaly")
def MADAnomaly(t, column, threshold=3.5, max_anomaly_ratio=0.05):
    """Values far from the median in median absolute deviations."""
    c = finite(F.col(column))
    (median,) = yield [Quantile(c, 0.5)]
    mad = None
    if median is not None:
        (mad,) = yield [Quantile(F.abs(c - median), 0.5)]
    hit = F.abs(c - median) * 0.6745 / mad > threshold if mad else F.lit(False)
    flagged(t, column, hit, c.isNotNull(), max_anomaly_ratio)


@check("anomaly")
def GrubbsTest(t, column, alpha=0.05, max_iterations=10, max_anomaly_ratio=0.05):
    """Grubbs' test, removing one extreme value per round.

    Only the ``max_iterations`` smallest and largest values can be removed, so
    they and the moments of the column are all the test needs.
    """
    c = finite(F.col(column))
    n, mean, var = yield [F.count(c), F.avg(c), F.var_samp(c)]
    filled = t.df.select(c.alias("x")).filter(F.col("x").isNotNull())
    low = [r[0] for r in filled.orderBy("x").limit(max_iterations).collect()]
    ends = deque(low)
    if n > max_iterations:
        high = [r[0] for r in filled.orderBy(F.desc("x")).limit(min(max_iterations, n - max_iterations)).collect()]
        ends.extend(reversed(high))
    total, m, s2, removed = n, mean or 0.0, (var or 0.0) * max(n - 1, 0), 0
    while removed < max_iterations and n > 2 and s2 > 0 and ends:
        below = m - ends[0] > ends[-1] - m
        x = ends[0] if below else ends[-1]
        if abs(x - m) / math.sqrt(s2 / (n - 1)) <= grubbs_critical(n, alpha):
            break
        ends.popleft() if below else ends.pop()
        rest = (m * n - x) / (n - 1)
        s2 -= (x - m) * (x - rest)
        m, n, removed = rest, n - 1, removed + 1
    share = removed / total if total else 0.0
    t.verdict(column, F.lit(removed), F.lit(total), F.lit(share <= max_anomaly_ratio), F.lit(share))


@check("anomaly")
def TukeyFences(t, column, detect_mild=True, detect_extreme=True, max_anomaly_ratio=0.05):
    """Mild values lie beyond 1.5, extreme ones beyond 3 quartile distances."""
    c = finite(F.col(column))
    q1, q3 = yield [Quantile(c, 0.25), Quantile(c, 0.75)]
    hit = F.lit(False)
    if q1 is not None:
        r = q3 - q1
        extreme = (c < q1 - 3.0 * r) | (c > q3 + 3.0 * r)
        mild = ((c < q1 - 1.5 * r) | (c > q3 + 1.5 * r)) & ~extreme
        if detect_mild:
            hit = hit | mild
        if detect_extreme:
            hit = hit | extreme
    flagged(t, column, hit, c.isNotNull(), max_anomaly_ratio)


@check("anomaly")
def PercentileAnomaly(t, column, lower_percentile=1.0, upper_percentile=99.0, max_anomaly_ratio=0.02):
    """Values outside two percentiles."""
    c = finite(F.col(column))
    lo, hi = yield [Quantile(c, lower_percentile / 100.0), Quantile(c, upper_percentile / 100.0)]
    hit = (c < lo) | (c > hi) if lo is not None else F.lit(False)
    flagged(t, column, hit, c.isNotNull(), max_anomaly_ratio)


def model(t, name, columns, max_ratio, run):
    """Verdict on the flags of a detector; rows are told apart by content."""
    cols = A.numeric_columns(t.df, columns)
    src = t.df.select(*cols).withColumn("row_key", F.xxhash64(*cols))
    g = t.frame(f"{name}:{cols}", lambda: run(A.Prepared(src, "row_key", cols)))
    bad, total = t.stat(F.count_if("is_anomaly"), g), t.stat(F.count(F.lit(1)), g)
    share = F.when(total > 0, bad / total).otherwise(F.lit(0.0))
    t.verdict(",".join(cols), bad, total, share <= float(max_ratio), share, g)


@check("anomaly")
def IsolationForest(t, columns=None, contamination=0.1, n_estimators=100, max_samples=None, random_state=None,
                    max_anomaly_ratio=0.1):
    """Rows isolated by few random cuts."""
    model(t, f"iforest:{contamination}:{n_estimators}:{max_samples}:{random_state}", columns, max_anomaly_ratio,
          lambda p: A.isolation_forest(p, n_estimators, contamination, max_samples, random_state))


@check("anomaly")
def LOF(t, columns=None, n_neighbors=20, contamination=0.1, metric="euclidean", max_anomaly_ratio=0.1):
    """Rows in thinner surroundings than their neighbours."""
    model(t, f"lof:{n_neighbors}:{contamination}", columns, max_anomaly_ratio,
          lambda p: A.local_outlier_factor(p, n_neighbors, contamination, metric))


@check("anomaly")
def DBSCAN(t, columns=None, eps=0.5, min_samples=5, metric="euclidean", max_anomaly_ratio=0.1):
    """Rows that belong to no dense cluster."""
    if metric != "euclidean":
        raise ValueError("DBSCAN uses the euclidean metric")
    def noise(p):
        state, rows, _ = A.dbscan_flags(p, eps, min_samples)
        return rows.join(state.select("id", F.col("noise").alias("is_anomaly")), "id")
    model(t, f"dbscan:{eps}:{min_samples}", columns, max_anomaly_ratio, noise)


@check("anomaly")
def Mahalanobis(t, columns=None, threshold_percentile=97.5, use_robust_covariance=True, max_anomaly_ratio=0.05):
    """Rows far from the centre in covariance units."""
    model(t, f"mahalanobis:{threshold_percentile}:{use_robust_covariance}", columns, max_anomaly_ratio,
          lambda p: A.mahalanobis(p, threshold_percentile, use_robust_covariance))


@check("anomaly")
def OneClassSVM(t, columns=None, kernel="rbf", nu=0.1, gamma="scale", max_anomaly_ratio=0.1):
    """Rows outside a learned support region."""
    model(t, f"ocsvm:{kernel}:{nu}:{gamma}", columns, max_anomaly_ratio, lambda p: A.one_class_svm(p, kernel, nu, gamma))


@check("anomaly")
def EllipticEnvelope(t, columns=None, contamination=0.1, max_anomaly_ratio=0.1):
    """Rows outside a robust Gaussian ellipse."""
    model(t, f"envelope:{contamination}", columns, max_anomaly_ratio, lambda p: A.elliptic_envelope(p, contamination))


@check("anomaly")
def PCAnomaly(t, columns=None, n_components=None, variance_ratio=0.95, error_percentile=95, max_anomaly_ratio=0.05):
    """Rows the leading components reconstruct badly."""
    model(t, f"pca:{n_components}:{variance_ratio}:{error_percentile}", columns, max_anomaly_ratio,
          lambda p: A.pca(p, n_components, variance_ratio, error_percentile))


@check("anomaly")
def ZScoreMultivariate(t, columns=None, threshold=3.0, method="any", max_anomaly_ratio=0.05):
    """Rows whose combined z-score is large."""
    model(t, f"zmulti:{threshold}:{method}", columns, max_anomaly_ratio,
          lambda p: A.multivariate_zscore(p, threshold, method))


@check("anomaly")
def AutoEncoder(t, columns=None, encoding_dim=None, epochs=50, error_percentile=95, max_anomaly_ratio=0.05):
    """Rows a linear autoencoder reconstructs badly."""
    model(t, f"autoencoder:{encoding_dim}:{error_percentile}", columns, max_anomaly_ratio,
          lambda p: A.autoencoder(p, encoding_dim, epochs, error_percentile))


@check("anomaly")
def KMeansAnomaly(t, columns=None, n_clusters=5, distance_percentile=95, max_anomaly_ratio=0.05):
    """Rows far from every cluster centre."""
    model(t, f"kmeans:{n_clusters}:{distance_percentile}", columns, max_anomaly_ratio,
          lambda p: A.kmeans(p, n_clusters, distance_percentile))
