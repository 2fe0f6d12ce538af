"""Scale-safe primitives against plain Python on small, skewed inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.components import components
from plumbline.operators.hierarchy import climb, on_cycle
from plumbline.operators.ranks import kendall, spearman
from plumbline.plans import primitives as P


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    # A third of the rows share one key.
    return [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 9)}", rng.randint(0, 40), rng.random()) for i in range(900)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, t int, x double").repartition(7)


def test_exact_quantiles_small_and_bracketed(df, rows):
    qs = [0.0, 0.013, 0.25, 0.5, 0.731, 0.99, 1.0]
    for col, at in (("x", 3), ("t", 2)):
        want = np.quantile([r[at] for r in rows], qs)
        for limit in (None, 50, 7):
            got = P.exact_quantiles(df, [(F.col(col), q) for q in qs], limit)
            assert got == pytest.approx(list(want), abs=1e-12), (col, limit)


def test_exact_quantiles_hot_value(spark):
    df = spark.createDataFrame([(5.0,)] * 700 + [(float(i),) for i in range(300)], "v double")
    want = np.quantile([5.0] * 700 + list(range(300)), [0.3, 0.5, 0.8])
    assert P.exact_quantiles(df, [(F.col("v"), q) for q in (0.3, 0.5, 0.8)], 40) == pytest.approx(list(want))


def test_running_totals(df, rows):
    counts = df.groupBy("t").agg(F.count("*").alias("n"))
    got = {r.t: (r.cum_n, r.next_t) for r in P.running_totals(counts, "t", ["n"]).collect()}
    ts = sorted({r[2] for r in rows})
    total = 0
    for a, b in zip(ts, ts[1:] + [None]):
        total += sum(r[2] == a for r in rows)
        assert got[a] == (total, b)


def test_ordered_scan_and_rank(df, rows):
    scan = P.ordered_scan(df, ["k", "t", "id"], ["t"], ["x"], ["id"]).orderBy("k", "t", "id").collect()
    total, top, prev = 0, None, None
    for r, w in zip(scan, sorted(rows, key=lambda r: (r[1], r[2], r[0]))):
        total, top = total + w[2], w[3] if top is None else max(top, w[3])
        assert (r.id, r.cum_t, r.top_x, r.prev_id) == (w[0], total, top, prev)
        prev = w[0]
    ranked = {r.id: r["rank"] for r in P.rank_in_group(df, ["k"], ["t", "id"]).collect()}
    for key in {r[1] for r in rows}:
        for i, w in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])), 1):
            assert ranked[w[0]] == i


def test_row_numbers(df, rows):
    got = {r.id: r.row_index for r in P.row_numbers(df, ["x"]).collect()}
    for i, w in enumerate(sorted(rows, key=lambda r: r[3])):
        assert got[w[0]] == i


def test_adjacent_stats(df, rows):
    out = P.adjacent_stats(df, ["k", "t", "id"], {"k": F.col("k"), "t": F.col("t")}, {
        "same": ("sum", lambda c, p: c("k") == p("k")), "gap": ("max", lambda c, p: F.when(c("k") == p("k"), c("t") - p("t")))}).first()
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    pairs = [(a, b) for a, b in zip(order, order[1:]) if a[1] == b[1]]
    assert (out.rows, out.same, out.gap) == (900, len(pairs), max(b[2] - a[2] for a, b in pairs))


def test_latest_in_window(spark, rows):
    pts = spark.createDataFrame([(r[1], r[2] * 60 + r[0] / 1000, r[0]) for r in rows], "g string, s double, id long").select(
        "g", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "id")
    probes = pts.select(F.col("id").alias("pid"), "g", F.timestamp_micros(F.unix_micros("ts") - 300_000_000).alias("lo"),
                        F.timestamp_micros(F.unix_micros("ts") + 300_000_000).alias("hi"))
    got = {}
    for r in P.latest_in_window(pts, probes, 4).collect():
        got.setdefault(r.pid, set()).add(r.id)
    at = {r[0]: (r[1], r[2] * 60 + r[0] / 1000) for r in rows}
    for pid, (g, s) in at.items():
        want = sorted((x for x, (h, t) in at.items() if h == g and s - 300 <= t <= s + 300), key=lambda x: -at[x][1])[:4]
        assert got[pid] == set(want)


def test_reach_and_hierarchy(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    found = {(r.id, r.depth) for r in P.reach(spark.createDataFrame([(1,)], "id long"), edges, 10).collect()}
    assert found == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    # Ring 1-2-3, tail 4 -> 1, long chain 100 .. 160 ending at a root.
    parents = [(1, 2), (2, 3), (3, 1), (4, 1), (9, 9)] + [(i, i + 1) for i in range(100, 160)] + [(160, None)]
    df = spark.createDataFrame(parents, "id long, parent long")
    assert {r.id for r in on_cycle(df, F.col("id"), F.col("parent"), 5).collect()} == {1, 2, 3, 9}
    depth = {r.id: (r.depth, r.root_reached) for r in climb(df, F.col("id"), F.col("parent"), 80).collect()}
    assert depth[100] == (60, True) and depth[160] == (0, True) and not depth[4][1]


def test_components_end_at_stars(spark, monkeypatch):
    from plumbline.operators import components as module
    tables = []
    monkeypatch.setattr(module, "stored", lambda df, f=module.stored: tables.append(1) or f(df))
    edges = spark.createDataFrame([(1, 2), (3, 1), (4, 5), (5, 5), (6, None)], "a long, b long")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6)], "id long")
    assert {r.id: r.component for r in components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert len(tables) == 2  # the links as given and after one round; no further round only confirms the stars


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 230), rng.randint(200, 230)) for _ in range(40)]
    nodes = sorted({x for e in edges for x in e} | {999})
    parent = {n: n for n in nodes}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in components(spark.createDataFrame([(n,) for n in nodes], "id long"),
                                                 spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in nodes}


def test_rank_correlations(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 12), rng.randint(0, 9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b int")
    sign = lambda v: (v > 0) - (v < 0)
    num = sum(sign(a - c) * sign(b - d) for a, b in rows for c, d in rows)
    den = (sum(abs(sign(a - c)) for a, _ in rows for c, _ in rows) * sum(abs(sign(b - d)) for _, b in rows for _, d in rows)) ** 0.5
    assert kendall(df, F.col("a"), F.col("b")).first().value == pytest.approx(num / den)
    rank = lambda v: np.array([sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v])
    want = np.corrcoef(rank([r[0] for r in rows]), rank([r[1] for r in rows]))[0, 1]
    assert spearman(df, F.col("a"), F.col("b")).first().value == pytest.approx(want)


def test_quantile_between_two_hot_values(spark):
    """The two values that a quantile lies between fill the bracket: nothing narrower holds both."""
    df = spark.createDataFrame([(float(i % 2),) for i in range(200)] + [(1e300,), (-1e300,), (None,), (float("nan"),)], "v double")
    assert P.exact_quantiles(df, [(F.col("v"), q) for q in (0.5, 0.25, 0.75, 0.0, 1.0)], 40) == [0.5, 0.0, 1.0, -1e300, 1e300]


def test_long_expression_is_computed_once(spark):
    df = P.once(spark.range(5).select(F.col("id").cast("double").alias("x")), {"root": F.sqrt("x")})
    plan = df.filter((F.col("root") >= 1) & (F.col("root") < 2) & (F.abs("root") > 0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") == 1 and [r.root for r in df.filter("root >= 1 and root < 1.5").collect()] == [1.0, 2 ** 0.5]
