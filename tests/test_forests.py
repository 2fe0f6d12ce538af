"""Detectors that learn anew at every turn: streams against batch forms, and both against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.streaming import forests, jobs

PLANTED = (333, 401, 577)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Rows of two sessions in files whose order has nothing to do with time."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else "k", 1e9 + i * 7, rng.gauss(0, 1) + (60 if i in PLANTED else 0), rng.gauss(5, 2), "x") for i in range(600)]
    path = str(tmp_path_factory.mktemp("wide"))
    df = spark.createDataFrame(rows, "event_id long, session string, s double, a double, b double, x string").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    df.repartition(4, F.xxhash64("event_id")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


KINDS = {"forest": forests.windowed_forest(40, 0.05, 10), "half_spaces": forests.half_space_trees(40, 0.55, 8, 5), "cuts": forests.robust_random_cut_forest(30, 0.25, 5, 60)}


@pytest.mark.parametrize("name", KINDS)
def test_streams_agree_with_batches(spark, events, name):
    df, path = events
    wide = lambda d: forests.wide_points(d, "session", "ts", "event_id", ["a", "b"])
    shape = lambda d: {(r.session, r.event_id): (tuple(r.x), round(r.score, 9), r.is_anomaly) for r in d.collect()}
    batch = shape(forests.as_batch(wide(df), KINDS[name]))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert batch == shape(jobs.drain(forests.as_stream(wide(live), KINDS[name], "30 days")))
    assert len(batch) == 600 and all(batch[("k" if i % 3 == 0 else "hot", i)][2] for i in PLANTED)
    assert sum(hit for _, _, hit in batch.values()) < 90


def test_odd_points(spark):
    rows = [(1, "a", 1.0, 2.0), (2, "a", None, 2.0), (3, None, 4.0, float("nan")), (4, None, 4.0, 4.0), (5, "a", 1.0, 2.0)] + [(i, "same", 1.0, 1.0) for i in range(10, 100)]
    df = spark.createDataFrame(rows, "event_id long, session string, a double, b double").withColumn("ts", F.timestamp_seconds("event_id"))
    wide = forests.wide_points(df, "session", "ts", "event_id", ["a", "b"])
    for kind in KINDS.values():
        got = forests.as_batch(wide, kind).collect()
        assert sorted(r.event_id for r in got) == [1, 4, 5, *range(10, 100)] and not any(r.is_anomaly for r in got)
        assert forests.as_batch(wide.limit(0), kind).collect() == []


def test_half_spaces_against_plain_python():
    rng = np.random.default_rng(2)
    before, new = rng.normal(size=(50, 2)), rng.normal(size=(30, 2)) * 2
    model = forests.half_space_trees(50, 0.9, 6, 4).start(1, before, np.stack([before.min(0), before.max(0)]))

    def path(tree, p):
        unit = (p - model.low) / model.span
        node, out = 0, [0]
        for _ in range(4):
            node = 2 * node + 1 + bool(unit[model.feature[tree, node]] >= model.split[tree, node])
            out.append(node)
        return out

    masses = [{} for _ in range(6)]
    for p in before:
        for tree in range(6):
            for node in path(tree, p):
                masses[tree][node] = masses[tree].get(node, 0) + 1
    for p, s in zip(new, model.scores(new), strict=True):
        total = 0.0
        for tree in range(6):
            for level, node in enumerate(path(tree, p)):
                m = masses[tree].get(node, 0)
                if m <= 5 or level == 4:
                    total += m * 2.0 ** level
                    break
        assert abs(s - 1 / (1 + total / 6 / 50)) < 1e-12
    model.judge(new)
    assert model.latest[:, 0].tolist() == [30] * 6


def members(node):
    return [node] if node.left is None else members(node.left) + members(node.right)


def test_cut_trees_hold_their_window():
    rng = np.random.default_rng(7)
    points = [rng.integers(0, 6, 2).astype(float) for _ in range(200)]
    tree = forests.CutTree(np.random.default_rng(1))
    for i, p in enumerate(points):
        if i >= 25:
            tree.delete(i - 25)
        tree.insert(i, p)
        held = points[max(0, i - 24):i + 1]
        assert tree.root.n == len(held) and len(members(tree.root)) == len({tuple(q) for q in held})
        todo = [tree.root]
        while todo:
            node = todo.pop()
            inside = [q for q in held if (q >= node.low).all() and (q <= node.high).all()]
            leaves = members(node)
            assert node.n == sum(x.n for x in leaves) <= len(inside)
            assert (node.low == np.min([x.low for x in leaves], 0)).all() and (node.high == np.max([x.high for x in leaves], 0)).all()
            if node.left is not None:
                assert node.left.high[node.axis] <= node.cut < node.right.low[node.axis] and node.left.up is node.right.up is node
                todo += [node.left, node.right]
        # Displacement by its definition, from the sets of points below each node.
        node, most = tree.leaves[i], 0.0
        while node.up is not None:
            most = max(most, (node.up.n - node.n) / node.n)
            node = node.up
        assert tree.displacement(i) == most
    for i in range(175, 200):
        tree.delete(i)
    assert tree.root is None and not tree.leaves


def test_rolling_score_of_several_columns(spark):
    rows = [(i, "s", float(i % 5), 10.0 + i % 3 + (100 if i == 50 else 0)) for i in range(80)] + [(200, "s", None, 11.0)]
    df = spark.createDataFrame(rows, "event_id long, session string, a double, b double").withColumn("ts", F.timestamp_seconds("event_id"))
    got = {r.event_id: r for r in forests.rolling_columns(df, "session", "ts", "event_id", ["a", "b"], 30, 3.0).collect()}
    assert got[50].is_anomaly and got[50].anomaly_columns == ["b"] and set(got[50].details) == {"a", "b"} and got[50].details["b"].value == 112.0
    assert got[50].score == got[50].details["b"].score and list(got[200].details) == ["b"] and not got[20].is_anomaly


def test_cut_trees_take_plain_arithmetic():
    """Judging points costs less than a few array operations for each tree and level would."""
    from time import process_time
    x = np.random.default_rng(4).normal(size=(540, 2))
    model = forests.robust_random_cut_forest(40, 0.2, 6, 160).start(0, x[:40], None)
    a, b = np.zeros(2), np.ones(2)

    def timed(work):
        start = process_time()
        work()
        return process_time() - start

    arrays = lambda: [np.minimum(a, b) for _ in range(500 * 6 * 130)]
    assert min(timed(lambda: model.judge(x[40:])) for _ in range(3)) < min(timed(arrays) for _ in range(3))
