"""Distinct, frequency and membership sketches."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hll_distinct(df: DataFrame, column: str, precision: int = 14) -> DataFrame:
    """HyperLogLog estimate with its standard error 1.04/sqrt(2^p)."""
    sketch = F.hll_sketch_agg(F.col(column), F.lit(precision))
    return df.agg(F.hll_sketch_estimate(sketch).alias("estimate")).select(
        "estimate", F.round(F.lit(1.04 / math.sqrt(2 ** precision)), 6).alias("standard_error"))


def buckets(value: Column, depth: int, width: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(d)), F.lit(width)).cast("int") for d in range(depth)]


def count_min(df: DataFrame, column: str, width: int = 2000, depth: int = 5) -> DataFrame:
    """(row, bucket, n): the counter table, at most width x depth rows.

    Buckets are computed in the JVM; each task keeps one counter array and
    emits its non-zero cells once.
    """
    hashed = df.filter(F.col(column).isNotNull()).select(*[b.alias(f"b{d}") for d, b in enumerate(buckets(F.col(column), depth, width))])

    def tally(batches: Any) -> Any:
        total = np.zeros((depth, width), dtype=np.int64)
        for pdf in batches:
            for d in range(depth):
                total[d] += np.bincount(pdf[f"b{d}"].to_numpy(), minlength=width)
        r, b = np.nonzero(total)
        yield pd.DataFrame({"row": r.astype("int32"), "bucket": b.astype("int32"), "n": total[r, b]})

    return hashed.mapInPandas(tally, "row int, bucket int, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n"))


def count_min_lookup(sketch: DataFrame, values: DataFrame, column: str, width: int = 2000, depth: int = 5) -> DataFrame:
    """(value, estimate): least counter over the rows; never too small."""
    cells = F.array(*[F.struct(F.lit(d).alias("row"), b.alias("bucket")) for d, b in enumerate(buckets(F.col(column), depth, width))])
    asked = values.select(F.col(column).alias("value"), F.explode(cells).alias("c")).select("value", "c.row", "c.bucket")
    return (asked.join(sketch, ["row", "bucket"], "left").groupBy("value")
            .agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate")))


def bloom_shape(capacity: int, error_rate: float) -> tuple[int, int]:
    """(bits, hash functions)."""
    bits = max(64, math.ceil(-capacity * math.log(error_rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / capacity * math.log(2)))


def positions(value: Column, bits: int, hashes: int) -> Column:
    """Bit positions by double hashing."""
    a, b = F.xxhash64(value, F.lit(1)), F.xxhash64(value, F.lit(2))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)),
                       lambda i: F.pmod(F.pmod(a, F.lit(bits)) + F.pmod(b, F.lit(bits)) * i, F.lit(bits)))


def bloom(df: DataFrame, column: str, capacity: int, error_rate: float = 0.01) -> DataFrame:
    """(word, bits): the filter as 64-bit words, set bits joined by OR. Words
    are combined in the tasks before they meet."""
    bits, hashes = bloom_shape(capacity, error_rate)
    spots = df.filter(F.col(column).isNotNull()).select(F.explode(positions(F.col(column), bits, hashes)).alias("p"))
    word, bit = F.floor(F.col("p") / 64).cast("long"), F.pmod(F.col("p"), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return spots.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))


def bloom_contains(filter_words: DataFrame, values: DataFrame, column: str, capacity: int, error_rate: float = 0.01) -> DataFrame:
    """(value, maybe): false only for values that were never added."""
    bits, hashes = bloom_shape(capacity, error_rate)
    asked = values.select(F.col(column).alias("value"), F.explode(positions(F.col(column), bits, hashes)).alias("p")).select(
        "value", F.floor(F.col("p") / 64).cast("long").alias("word"), F.pmod(F.col("p"), F.lit(64)).cast("int").alias("bit"))
    hit = F.expr("coalesce((bits & shiftleft(cast(1 as bigint), bit)) <> 0, false)")
    return asked.join(filter_words, "word", "left").groupBy("value").agg(F.bool_and(hit).alias("maybe"))


def heavy_hitters(df: DataFrame, column: str, n: int = 10, min_share: float = 0.01) -> DataFrame:
    """(value, count, share): exact top values with at least the share."""
    total = df.count()
    share = F.col("count") / float(max(total, 1))
    return (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
            .filter(share >= min_share).select("value", "count", F.round(share, 6).alias("share"))
            .orderBy(F.desc("count"), "value").limit(n))


def approx_heavy_hitters(df: DataFrame, column: str, n: int = 10, tracked: int = 10_000) -> DataFrame:
    """(value, count): top values from a bounded frequent-items sketch."""
    return df.agg(F.call_function("approx_top_k", F.col(column), F.lit(n), F.lit(tracked)).alias("t")).select(
        F.explode("t").alias("t")).select(F.col("t.item").alias("value"), F.col("t.count").alias("count"))
