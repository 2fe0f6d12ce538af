"""Two-sample and trend tests from sufficient statistics, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import chi_square_sf, f_over, two_sided_normal, two_sided_t
from plumbline.operators.drift import on, two_sided
from plumbline.plans.primitives import paired_counts, running_totals

OUT = ("test", "statistic", "p_value", "effect_size", "effect", "significance", "is_significant", "n1", "n2")


def significance(p: Column) -> Column:
    return (F.when(p >= 0.10, "not_significant").when(p >= 0.05, "marginally_significant")
            .when(p >= 0.01, "significant").when(p >= 0.001, "highly_significant")
            .otherwise("very_highly_significant"))


def effect(size: Column, small: float, medium: float, large: float) -> Column:
    a = F.abs(size)
    return F.when(a < small, "negligible").when(a < medium, "small").when(a < large, "medium").otherwise("large")


def shaped(row: DataFrame, test: str, alpha: float, label: Column) -> DataFrame:
    p = F.coalesce(F.col("p"), F.lit(1.0))
    return row.select(
        F.lit(test).alias("test"), F.round(F.coalesce("stat", F.lit(0.0)), 6).alias("statistic"),
        F.round(p, 6).alias("p_value"), F.round(F.coalesce("size", F.lit(0.0)), 6).alias("effect_size"),
        label.alias("effect"), significance(p).alias("significance"), (p < alpha).alias("is_significant"),
        F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"))


def sides(a: DataFrame, b: DataFrame, ca: Column, cb: Column) -> DataFrame:
    x = F.col("x").cast("double")
    return two_sided(a, b, ca, cb).agg(
        F.count(on(0, x)).alias("n1"), F.count(on(1, x)).alias("n2"), F.avg(on(0, x)).alias("m1"),
        F.avg(on(1, x)).alias("m2"), F.var_samp(on(0, x)).alias("v1"), F.var_samp(on(1, x)).alias("v2"))


def pooled_d() -> Column:
    """Cohen's d over columns n1, n2, m1, m2, v1, v2 (0 without spread)."""
    n1, n2 = F.col("n1"), F.col("n2")
    sd = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2))
    return F.coalesce(f_over(F.abs(F.col("m1") - F.col("m2")), sd), F.lit(0.0))


def cohens_d(a: DataFrame, b: DataFrame, ca: Column, cb: Column) -> DataFrame:
    row = sides(a, b, ca, cb).withColumn("d", pooled_d())
    return row.select(F.round("d", 6).alias("cohens_d"), effect(F.col("d"), 0.2, 0.5, 0.8).alias("effect"))


def welch_t(a: DataFrame, b: DataFrame, ca: Column, cb: Column, alpha: float = 0.05) -> DataFrame:
    """Welch's t with Welch-Satterthwaite degrees of freedom."""
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    df = F.pow(e1 + e2, 2) / (F.pow(e1, 2) / (F.col("n1") - 1) + F.pow(e2, 2) / (F.col("n2") - 1))
    row = (sides(a, b, ca, cb)
           .withColumn("stat", f_over(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2)))
           .withColumn("p", two_sided_t(F.col("stat"), df)).withColumn("size", pooled_d()))
    return shaped(row, "welch_t", alpha, effect(F.col("size"), 0.2, 0.5, 0.8))


def mann_whitney(a: DataFrame, b: DataFrame, ca: Column, cb: Column, alpha: float = 0.05) -> DataFrame:
    """U with tie-averaged ranks from value counts, normal approximation."""
    run = running_totals(paired_counts(a, b, ca.cast("double"), cb.cast("double")), "v", ["na", "nb"])
    t = (F.col("na") + F.col("nb")).cast("double")
    rank = F.col("cum_na") + F.col("cum_nb") - t + (t + 1) / 2
    row = run.agg(F.sum("na").cast("double").alias("n1"), F.sum("nb").cast("double").alias("n2"),
                  F.sum(F.col("na") * rank).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    row = (row.withColumn("stat", F.least(u1, n1 * n2 - u1))
           .withColumn("sd", F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))))
           .withColumn("p", F.when(F.col("sd") > 0, two_sided_normal((F.col("stat") - n1 * n2 / 2) / F.col("sd"))))
           .withColumn("size", F.lit(1.0) - F.col("stat") * 2 / (n1 * n2)))
    return shaped(row, "mann_whitney_u", alpha, effect(F.col("size"), 0.1, 0.3, 0.5))


def chi_square(a: DataFrame, b: DataFrame, ca: Column, cb: Column, alpha: float = 0.05) -> DataFrame:
    """2 x k contingency with Cramer's V."""
    counts = paired_counts(a, b, ca, cb)
    # Sum of (o-e)^2/e over both rows equals n * (sum o^2/(row*col) - 1).
    t = (F.col("na") + F.col("nb")).cast("double")
    row = counts.agg(F.sum("na").cast("double").alias("n1"), F.sum("nb").cast("double").alias("n2"),
                     F.sum(F.pow(F.col("na").cast("double"), 2) / t).alias("s1"),
                     F.sum(F.pow(F.col("nb").cast("double"), 2) / t).alias("s2"),
                     F.count(F.lit(1)).alias("k"))
    n = F.col("n1") + F.col("n2")
    row = (row.withColumn("stat", F.greatest(F.lit(0.0), n * (F.col("s1") / F.col("n1") + F.col("s2") / F.col("n2") - 1)))
           .withColumn("p", chi_square_sf(F.col("stat"), F.col("k") - 1)).withColumn("size", F.sqrt(F.col("stat") / n)))
    return shaped(row, "chi_square", alpha, effect(F.col("size"), 0.1, 0.3, 0.5))


def trend_stats(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: n, slope, r2, t, p of the regression of y on x."""
    both = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).dropna()
    row = both.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"),
                   F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    sse = F.greatest(F.col("syy") * (F.lit(1.0) - F.col("r2")), F.lit(0.0))
    se = F.sqrt(sse / (F.col("n") - 2) / F.col("sxx"))
    return (row.withColumn("t", F.when((F.col("n") > 2) & (se > 0), F.col("slope") / se))
            .withColumn("p", F.coalesce(two_sided_t(F.col("t"), F.col("n") - 2), F.lit(1.0))))


def trend(df: DataFrame, x: Column, y: Column, alpha: float = 0.05) -> DataFrame:
    row = trend_stats(df, x, y).select(F.col("t").alias("stat"), "p", F.col("slope").alias("size"),
                                       F.col("n").alias("n1"), F.lit(0).alias("n2"))
    return shaped(row, "trend", alpha, F.when(F.col("size") > 0, "increasing").when(F.col("size") < 0, "decreasing")
                  .otherwise("flat"))


def comprehensive(a: DataFrame, b: DataFrame, ca: Column, cb: Column, alpha: float = 0.05) -> DataFrame:
    """Both location tests; ``recommended`` marks the one to trust."""
    both = welch_t(a, b, ca, cb, alpha).unionByName(mann_whitney(a, b, ca, cb, alpha))
    small = (F.col("n1") < 30) | (F.col("n2") < 30)
    return both.withColumn("recommended", F.when(small, F.col("test") == "mann_whitney_u").otherwise(
        F.col("test") == "welch_t"))
