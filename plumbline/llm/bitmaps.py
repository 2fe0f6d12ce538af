"""Bit maps of hashed keys: a filter of fixed size before an exact join.

A map has at most ``1 << BITS`` bits whatever the number of keys, so it can go to every task. Keys that pass it by
chance are sorted out by the exact join that follows; when a map fills up, more rows take that join, none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23


def bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(word, mask): the set bits of the hashes, 64 to a row; at most ``1 << (bits - 6)`` rows."""
    bit = F.pmod(F.col(column), F.lit(1 << bits))
    return (hashes.filter(F.col(column).isNotNull()).select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("mask"))
            .groupBy("word").agg(F.bit_or("mask").alias("mask")))


def maybe(df: DataFrame, hashed: Column, ids: DataFrame, id_hash: str, name: str = "__maybe", bits: int = BITS) -> DataFrame:
    """``df`` with a boolean column ``name``: whether the row's hash may be among those of ``ids``. No row is shuffled."""
    h, word, mask = (fresh(df, x) for x in ("__h", "__word", "__mask"))
    marks = F.broadcast(bitmap(ids, id_hash, bits).select(F.col("word").alias(word), F.col("mask").alias(mask)))  # bounded by 1 << (bits - 6) rows
    df = df.withColumn(h, hashed).withColumn(word, F.shiftright(F.pmod(h, F.lit(1 << bits)), 6))
    hit = F.expr(f"coalesce((`{mask}` & shiftleft(1L, cast(pmod(`{h}`, 64) as int))) != 0, false)")
    return df.join(marks, word, "left").withColumn(name, hit).drop(word, mask, h)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split(docs: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is surely not in ``ids`` (or null), and the others."""
    name, columns = fresh(docs, "__maybe"), [F.col(f"`{c}`") for c in docs.columns]
    marked = maybe(docs, F.xxhash64(F.col(key).cast("string")), ids.select(F.xxhash64(F.col(key).cast("string")).alias("h")), "h", name)
    unsure = F.col(name) & F.col(key).isNotNull()
    return marked.filter(~unsure).select(*columns), marked.filter(unsure).select(*columns)


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``dropped`` (key); rows without a key stay. Whole rows are shuffled only
    where the bit map cannot rule them out."""
    kept, unsure = split(docs, dropped, key)
    return kept.unionByName(unsure.join(dropped.select(key).distinct(), key, "left_anti").select(*[f"`{c}`" for c in docs.columns]))


def within(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids`` (key)."""
    return split(docs, ids, key)[1].join(ids.select(key).distinct(), key, "left_semi").select(*[f"`{c}`" for c in docs.columns])
