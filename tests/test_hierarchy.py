"""Cycles among nodes of several parents, against a search from every node."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import hierarchy


def brute(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = set()
    for a in up:
        seen, todo = set(), list(up[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += up.get(b, ())
        if a in seen:
            out.add(a)
    return out


def graphs():
    rng = random.Random(5)
    ring = [(i, (i + 1) % 40) for i in range(40)]
    tail = [(100 + i, 101 + i) for i in range(30)] + [(130, 3)]
    yield ring + tail + [(7, 29)]
    yield ring + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 203), (5, 300), (300, 301)]
    yield [(i, i // 2) for i in range(1, 60)] + [(400, 400), (400, 401), (401, 402), (401, 403), (403, 404), (402, 404)] + [(0, 33), (9, 70), (70, 71), (71, 9)]
    for n, m in ((40, 60),):
        yield sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize("edges", list(graphs()), ids=lambda e: f"{len(e)}")
def test_cycle_members_against_search(spark, edges):
    df = spark.createDataFrame(edges, "id long, up long")
    assert {r.id for r in hierarchy.cycle_members(df).collect()} == brute(edges)


def test_long_ring_with_one_more_parent(spark):
    n = 12_000
    ring = spark.range(n).select("id", ((F.col("id") + 1) % n).alias("up"))
    df = ring.union(spark.range(1).select(F.lit(17).cast("long"), F.lit(11_111).cast("long"))).union(spark.range(n, n + 500).select("id", (F.col("id") - 1).alias("up")))
    got = hierarchy.on_cycle(df, F.col("id"), F.col("up"))
    assert got.count() == n and got.agg(F.max("id")).first()[0] == n - 1


def test_rounds_of_joins_keep_sizes_small(spark):
    """A chain into a ring of three and a lone chain: what the driver knows about the size of the result has few digits, whatever the rounds."""
    n = 3_000
    chain = spark.range(n).select("id", F.when(F.col("id") == 0, 2).otherwise(F.col("id") - 1).cast("long").alias("up"))
    df = chain.union(spark.range(n, 2 * n).select("id", F.when(F.col("id") > n, F.col("id") - 1).alias("up")))
    df = df.union(spark.createDataFrame([(2 * n, 2 * n), (2 * n + 1, None), (None, 5)], "id long, up long"))
    for got, expected in ((hierarchy.on_cycle(df, F.col("id"), F.col("up")).select("id"), [0, 1, 2, 2 * n]),
                          (hierarchy.climb(df, F.col("id"), F.col("up"), n + 1).filter("not root_reached").select("id"), [*range(n), 2 * n])):
        assert sorted(r.id for r in got.collect()) == expected
        assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
