"""Rank correlations from counted value pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.primitives import row_numbers, running_totals, value_counts
from plumbline.session import checkpointed


def pair_counts(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return checkpointed(value_counts(df.select(a.alias("a"), b.alias("b")).dropna(),
                                     {"a": F.col("a"), "b": F.col("b")}))


def spearman(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row (value): Pearson correlation of tie-averaged ranks."""
    pairs = pair_counts(df, a, b)
    for c in ("a", "b"):
        run = running_totals(pairs.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias("m")), "v", ["m"])
        ranks = run.select(F.col("v").alias(c), (F.col("cum_m") - F.col("m") + (F.col("m") + 1) / 2).alias(f"r{c}"))
        pairs = pairs.join(ranks, c)
    n, x, y = F.col("n"), F.col("ra"), F.col("rb")
    mean = pairs.agg(F.sum(n).alias("n"), (F.sum(n * x) / F.sum(n)).alias("m")).first()
    m = mean["m"] or 0.0  # both rank columns have the same mean
    return pairs.agg((F.sum(n * (x - m) * (y - m)) / F.sqrt(F.sum(n * (x - m) * (x - m)) * F.sum(n * (y - m) * (y - m))))
                     .alias("value"))


def kendall(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row (value): tau-b, exact, without comparing pairs of rows.

    Two values of b are ordered by the highest bit in which their dense ranks
    differ. Per bit, rows are grouped by the bits above it, and running
    counts along a tell how many earlier rows have the bit clear.
    """
    pairs = pair_counts(df, a, b)
    dense = row_numbers(pairs.select(F.col("b")).distinct(), ["b"], "rb")
    pairs = checkpointed(pairs.join(dense, "b").select("a", "rb", "n"))
    top = pairs.agg(F.max("rb")).first()[0] or 0
    concordant = 0
    for bit in range(int(top).bit_length()):
        upper = F.shiftright("rb", bit + 1)
        one = F.pmod(F.shiftright("rb", bit), F.lit(2)) == 1
        groups = pairs.groupBy(F.struct(upper.alias("p"), F.col("a")).alias("o")).agg(
            F.sum(F.when(one, 0).otherwise(F.col("n"))).alias("clear"), F.sum(F.when(one, F.col("n")).otherwise(0)).alias("set"))
        run = running_totals(groups, "o", ["clear"])
        before = F.col("cum_clear") - F.col("clear")
        part = run.groupBy("o.p").agg(
            (F.sum(F.col("set").cast("decimal(38,0)") * before) - F.sum("set").cast("decimal(38,0)") * F.min(before)).alias("c"))
        concordant += int(part.agg(F.sum("c")).first()[0] or 0)

    def tied(keys: list[str]) -> int:
        n = F.col("m").cast("decimal(38,0)")
        return int(pairs.groupBy(*keys).agg(F.sum("n").alias("m")).agg(F.sum(n * (n - 1))).first()[0] or 0) // 2

    n = int(pairs.agg(F.sum("n")).first()[0] or 0)
    total, ta, tb, tab = n * (n - 1) // 2, tied(["a"]), tied(["rb"]), tied(["a", "rb"])
    discordant = total - ta - tb + tab - concordant
    scale = ((total - ta) * (total - tb)) ** 0.5
    value = (concordant - discordant) / scale if scale else None
    return pairs.agg(F.count(F.lit(1)).alias("k")).select(F.lit(value).cast("double").alias("value"))
