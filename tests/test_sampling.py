"""Sizes, nesting, repeatability and sketch bounds."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import sampling as S
from plumbline.operators import sketches as K


@pytest.fixture(scope="module")
def df(spark):
    # One stratum holds two thirds of the rows.
    return spark.range(30000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 17).cast("string"))).alias("g"),
                                     (F.col("id") % 100).cast("double").alias("x")).repartition(6)


def ids(d):
    return [r.id for r in d.select("id").collect()]


def test_random_is_exact_and_repeatable(df):
    for n in (1, 100, 5000, 40000):
        a, b = ids(S.random_sample(df, n, ["id"])), ids(S.random_sample(df.repartition(3), n, ["id"]))
        assert len(a) == len(set(a)) == min(n, 30000) and sorted(a) == sorted(b)
    assert set(ids(S.random_sample(df, 50, ["id"]))) <= set(ids(S.random_sample(df, 500, ["id"])))
    assert set(ids(S.random_sample(df, 50, ["id"], 1))) != set(ids(S.random_sample(df, 50, ["id"], 2)))


def test_stratified_quotas(df):
    out = S.stratified(df, 3000, "g", ["id"])
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    got = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert sum(got.values()) == 3000 and set(got) == set(sizes)
    assert all(got[g] <= sizes[g] * 3300 // 30000 for g in got)


def test_block_multistage_systematic(df):
    out = S.block(df, 900, ["id"], 1000)
    per = {r.b: r.n for r in out.groupBy(F.floor(F.col("id") / 1000).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert len(per) == 30 and set(per.values()) == {30}
    assert S.multi_stage(df, 500, ["id"]).count() == 500
    assert sorted(ids(S.systematic(df, 1000, ["id"], 3))) == list(range(3, 30000, 1000))


def test_hash_sample_keeps_whole_keys(df):
    kept = {r.g for r in S.hash_sample(df, ["g"], 1, 2).select("g").distinct().collect()}
    assert S.hash_sample(df, ["g"], 1, 2).count() == df.filter(F.col("g").isin(list(kept))).count()


def test_progressive_stops_when_means_settle(df):
    p = S.progressive(df.select("id", "x"), 20000, ["id"], tolerance=0.2)
    assert p.converged and p.stages == 2 and p.sample.count() == 20000


def test_size_plan(df):
    r = S.size_plan(df, "sketch").first()
    assert (r.population, r.scale, r.recommended, r.min_size, r.max_size, r.strategy) == (30000, "small", 10000, 5000, 30000, "none")
    assert S.scale_of(2 * 10 ** 9) == "xxlarge" and S.needs_sampling(200 * 2 ** 20) and not S.needs_sampling(1)


def test_sketches(df):
    assert K.hll_distinct(df, "id").first().estimate == pytest.approx(30000, rel=0.03)
    table = K.count_min(df, "g", 500, 4)
    exact = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    for r in K.count_min_lookup(table, df.select("g").distinct(), "g", 500, 4).collect():
        assert exact[r.value] <= r.estimate <= exact[r.value] + 30000 * 2.72 / 500
    words = K.bloom(df, "id", 30000, 0.01)
    assert K.bloom_contains(words, df, "id", 30000, 0.01).filter("not maybe").count() == 0
    other = df.select((F.col("id") + 10 ** 6).alias("id"))
    assert K.bloom_contains(words, other, "id", 30000, 0.01).filter("maybe").count() < 30000 * 0.02
    top = K.heavy_hitters(df, "g").first()
    assert top.value == "hot" and top["count"] == 20000


def test_weighted_reservoir(spark):
    """The n rows of least priority, whatever the partitions; chances follow the weights."""
    import math
    rows = [(i, float(i % 5) if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, w double")
    draw = (F.pmod(F.col("id") * 7919 + 13, F.lit(10_007)) + 0.5) / 10_007.0
    want = sorted((-math.log(((i * 7919 + 13) % 10_007 + 0.5) / 10_007) / w, i) for i, w in rows if w)[:100]
    for parts in (1, 3, 40):
        got = S.reservoir(df.repartition(parts), 100, ["id"], "w", draw=draw)
        assert {r.id for r in got.collect()} == {i for _, i in want} and got.columns == ["id", "w"]
    share = S.reservoir(df, 600, ["id"], "w").groupBy("w").count().collect()
    count = {r.w: r["count"] for r in share}
    assert set(count) == {1.0, 2.0, 3.0, 4.0} and count[4.0] > 1.8 * count[1.0]
    assert S.reservoir(df, 10_000, ["id"]).count() == 3000 and S.reservoir(df.limit(0), 5, ["id"]).collect() == [] and S.reservoir(df, 0, ["id"]).collect() == []
