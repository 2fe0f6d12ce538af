"""Drift checks of a column against a reference table (the baseline)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.operators import drift as D
from plumbline.plans.primitives import exact_quantiles, paired_counts
from plumbline.plans.registry import check


def ends(t, column, reference_source_id, reference_column):
    base = t.ref(reference_source_id)
    return base, F.col(reference_column or column), F.col(column)


def judged(t, column, key, build, ok):
    """Verdict on a one-row (statistic, p_value) frame."""
    g = t.frame(key, build)
    stat, p = t.stat(F.max("statistic"), g), t.stat(F.max("p_value"), g)
    t.value(column, stat, ok=ok(stat, p), frame=g)


@check("drift", "high")
def KSTest(t, column, reference_source_id, reference_column=None, p_value_threshold=0.05, statistic_threshold=None):
    """Kolmogorov-Smirnov distance to the baseline."""
    base, a, b = ends(t, column, reference_source_id, reference_column)
    def ok(stat, p):
        good = p >= p_value_threshold
        return good if statistic_threshold is None else good & (stat <= statistic_threshold)
    judged(t, column, f"ks:{column}:{reference_source_id}:{reference_column}",
           lambda: D.cumulative("ks", base, t.df, a, b), ok)


@check("drift", "high")
def PSI(t, column, reference_source_id, reference_column=None, threshold=0.25, n_bins=10, is_categorical=False):
    """Population stability index."""
    base, a, b = ends(t, column, reference_source_id, reference_column)
    judged(t, column, f"psi:{column}:{reference_source_id}:{reference_column}:{n_bins}:{is_categorical}",
           lambda: D.binned("psi", base, t.df, a, b, not is_categorical, n_bins), lambda stat, p: stat <= threshold)


@check("drift", "high")
def ChiSquareDrift(t, column, reference_source_id, reference_column=None, p_value_threshold=0.05,
                   min_expected_frequency=5.0):
    """Chi-square test of category counts."""
    base, a, b = ends(t, column, reference_source_id, reference_column)
    judged(t, column, f"chi2:{column}:{reference_source_id}:{reference_column}:{min_expected_frequency}",
           lambda: D.chi2(base, t.df, a, b, False, min_expected_frequency), lambda stat, p: p >= p_value_threshold)


@check("drift")
def JSDivergence(t, column, reference_source_id, reference_column=None, threshold=0.1, is_categorical=False, n_bins=10):
    """Jensen-Shannon divergence."""
    base, a, b = ends(t, column, reference_source_id, reference_column)
    judged(t, column, f"js:{column}:{reference_source_id}:{reference_column}:{n_bins}:{is_categorical}",
           lambda: D.binned("js", base, t.df, a, b, not is_categorical, n_bins), lambda stat, p: stat <= threshold)


@check("drift")
def Wasserstein(t, column, reference_source_id, threshold, reference_column=None, normalize=True):
    """Earth mover's distance."""
    base, a, b = ends(t, column, reference_source_id, reference_column)
    judged(t, column, f"emd:{column}:{reference_source_id}:{reference_column}:{normalize}",
           lambda: D.cumulative("wasserstein", base, t.df, a, b, normalize), lambda stat, p: stat <= threshold)


@check("drift")
def CSI(t, column, reference_source_id, reference_column=None, threshold_per_bin=0.25, n_bins=10):
    """Stability index per bin: no single bin exceeds the threshold."""
    base, a, b = ends(t, column, reference_source_id, reference_column)
    g = t.frame(f"csi:{column}:{reference_source_id}:{reference_column}:{n_bins}",
                lambda: csi_bins(base, t.df, a, b, n_bins))
    term = F.abs(F.col("csi"))
    t.verdict(column, t.stat(F.count_if(term > threshold_per_bin), g), t.stat(F.count(F.lit(1)), g),
              observed=t.stat(F.max(term), g), frame=g)


def csi_bins(base, cur, a, b, n_bins=10):
    """One row per bin with its stability term."""
    return D.binned_rows(base, cur, a, b, True, n_bins).withColumn("csi", D.terms("psi", F.col("p"), F.col("q")))


def sides(t, column, reference_source_id, reference_column):
    """Frame (x, side) shared by all two-aggregate checks of the column."""
    base, a, b = ends(t, column, reference_source_id, reference_column)
    return t.frame(f"sides:{column}:{reference_source_id}:{reference_column}",
                   lambda: D.two_sided(base, t.df, a, b))


def change(a, b):
    """Relative change; from zero it is 0 or 1."""
    return F.when(a != 0, F.abs(b - a) / F.abs(a)).otherwise(F.when(b == 0, 0.0).otherwise(1.0))


@check("drift")
def MeanDrift(t, column, reference_source_id, reference_column=None, threshold_pct=None, threshold_abs=None):
    """Change of the mean, relative or absolute."""
    g = sides(t, column, reference_source_id, reference_column)
    a, b = (t.stat(F.avg(D.on(s, F.col("x"))), g) for s in (0, 1))
    ok = F.lit(True)
    if threshold_pct is not None:
        ok = ok & (change(a, b) <= threshold_pct)
    if threshold_abs is not None:
        ok = ok & (F.abs(b - a) <= threshold_abs)
    t.value(column, b - a, ok=ok, frame=g)


@check("drift")
def VarianceDrift(t, column, reference_source_id, reference_column=None, threshold_pct=0.2, use_std=True):
    """Relative change of the variance or deviation."""
    g = sides(t, column, reference_source_id, reference_column)
    f = F.stddev_samp if use_std else F.var_samp
    a, b = (t.stat(f(D.on(s, F.col("x"))), g) for s in (0, 1))
    t.value(column, change(a, b), hi=float(threshold_pct), frame=g)


@check("drift")
def QuantileDrift(t, column, reference_source_id, reference_column=None, quantiles=("0.25", "0.5", "0.75"),
                  threshold_pct=0.2):
    """Largest relative change among the given quantiles."""
    base, a, b = ends(t, column, reference_source_id, reference_column)
    qs = [float(q) for q in quantiles]
    before = exact_quantiles(base, [(a, q) for q in qs])
    after = exact_quantiles(t.df, [(b, q) for q in qs])
    worst = F.lit(0.0)
    for x, y in zip(before, after):
        if x is not None and y is not None:
            worst = F.greatest(worst, change(F.lit(float(x)), F.lit(float(y))))
    t.value(column, worst, hi=float(threshold_pct))


@check("drift")
def RangeDrift(t, column, reference_source_id, reference_column=None, threshold_pct=0.1, allow_expansion=False):
    """Shift of minimum or maximum relative to the baseline range.

    With ``allow_expansion`` only a narrower range counts.
    """
    g = sides(t, column, reference_source_id, reference_column)
    lo0, lo1 = (t.stat(F.min(D.on(s, F.col("x"))), g) for s in (0, 1))
    hi0, hi1 = (t.stat(F.max(D.on(s, F.col("x"))), g) for s in (0, 1))
    low, high = lo1 - lo0, hi0 - hi1
    shift = F.greatest(low, high, F.lit(0.0)) if allow_expansion else F.greatest(F.abs(low), F.abs(high))
    t.value(column, F.when(hi0 > lo0, shift / (hi0 - lo0)).otherwise(F.when(shift == 0, 0.0).otherwise(1.0)),
            hi=float(threshold_pct), frame=g)


@check("drift", "high")
def FeatureDrift(t, columns, reference_source_id, method="psi", threshold=0.25, alert_on_any=True, min_drift_count=1,
                 categorical_columns=None):
    """Drift over several features; p-value methods drift below the threshold."""
    how = {"chi_square": "chi2"}.get(method, method)
    cats, base = set(categorical_columns or ()), t.ref(reference_source_id)
    def build():
        parts = []
        for c in columns:
            numeric = c not in cats and D.is_numeric(t.df.schema[c].dataType)
            m = how if numeric or how in D.BINNED or how == "chi2" else "chi2"
            limit = 0.05 if m == "chi2" and how != "chi2" else threshold
            hit = F.col("p_value") < limit if m in D.P_VALUE_METHODS else F.col("statistic") > limit
            parts.append(D.measure(m, base, t.df, F.col(c), F.col(c), numeric)
                         .select("statistic", hit.alias("drifted")))
        return reduce(lambda x, y: x.unionByName(y), parts)
    g = t.frame(f"features:{columns}:{reference_source_id}:{how}:{threshold}:{sorted(cats)}", build)
    bad = t.stat(F.count_if("drifted"), g)
    limit = 1 if alert_on_any else min_drift_count
    t.verdict(",".join(columns), bad, F.lit(len(columns)), bad < limit, t.stat(F.max("statistic"), g), g)


@check("drift")
def NullRateDrift(t, column, reference_source_id, reference_column=None, threshold_abs=0.05):
    """Change of the share of nulls."""
    g = sides(t, column, reference_source_id, reference_column)
    a, b = (t.stat(F.avg(D.on(s, F.col("x").isNull().cast("int"))), g) for s in (0, 1))
    t.value(column, F.abs(b - a), hi=float(threshold_abs), frame=g)


@check("drift")
def CardinalityDrift(t, column, reference_source_id, reference_column=None, threshold_pct=0.2, detect_new_values=True,
                     detect_missing_values=True):
    """Change of the distinct count, and values that appeared or vanished."""
    base, a, b = ends(t, column, reference_source_id, reference_column)
    g = t.frame(f"paired:{column}:{reference_source_id}:{reference_column}", lambda: paired_counts(base, t.df, a, b))
    d0, d1 = t.stat(F.count_if(F.col("na") > 0), g), t.stat(F.count_if(F.col("nb") > 0), g)
    new, gone = t.stat(F.count_if(F.col("na") == 0), g), t.stat(F.count_if(F.col("nb") == 0), g)
    bad = F.lit(0)
    if detect_new_values:
        bad = bad + new
    if detect_missing_values:
        bad = bad + gone
    t.verdict(column, bad, t.stat(F.count(F.lit(1)), g), (change(d0, d1) <= threshold_pct) & (bad == 0),
              change(d0, d1), g)
