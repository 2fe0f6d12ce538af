"""Detectors against brute force and planted outliers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import anomaly as A
from plumbline.operators.neighbours import knn


def cloud(seed=0, hot=120):
    rng = np.random.default_rng(seed)
    a = rng.normal([0, 0], 0.4, (220, 2))
    b = rng.normal([6, 1], 0.3, (160, 2))
    # A third of the rows sit on one spot; four lie far out.
    return np.vstack([a, b, np.tile([[0.1, 0.2]], (hot, 1)), [[20, 20], [-15, 9], [3, -14], [12, 2]]])


@pytest.fixture(scope="module")
def data(spark):
    x = cloud()
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "u": x[:, 0], "v": x[:, 1]})).repartition(6)
    return df, x


def standard(x):
    return (x - x.mean(0)) / x.std(0)


def test_knn_matches_brute_force(spark, data):
    _, x = data
    z = standard(x)
    uniq, w = np.unique(z, axis=0, return_counts=True)
    pts = spark.createDataFrame([(i, [float(v) for v in p], int(n)) for i, (p, n) in enumerate(zip(uniq, w))], "id long, x array<double>, w long")
    got = {}
    for r in knn(pts, 2, 7, cell_rows=25).collect():
        got.setdefault(r.id, []).extend([r.d] * r.w)
    for i, p in enumerate(uniq):
        d = np.sort(np.repeat(np.sqrt(((uniq - p) ** 2).sum(1)), w))[1:8]
        assert np.allclose(sorted(got[i]), d)


def brute_lof(z, k):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    reach = np.maximum(kd[near], np.take_along_axis(d, near, 1))
    lrd = 1 / (reach.mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


def test_lof_matches_brute_force(spark):
    x = cloud(2, 0)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "u": x[:, 0], "v": x[:, 1]}))
    got = {r.id: r.score for r in A.detect(df, "id", "lof", n_neighbors=10, contamination=0.02).collect()}
    want = brute_lof(standard(x), 10)
    assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-6)


def brute_dbscan(z, eps, m):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= m
    label = np.full(len(z), -1)
    for i in np.nonzero(core)[0]:
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = i
        while todo:
            j = todo.pop()
            for n in np.nonzero((d[j] <= eps) & core)[0]:
                if label[n] < 0:
                    label[n] = i
                    todo.append(n)
    noise = ~core & ~((d <= eps) & core[None]).any(1)
    return core, noise, label


def test_dbscan_matches_brute_force(spark, data):
    df, x = data
    z = standard(x)
    for eps, m in ((0.15, 5), (0.05, 4), (0.6, 8)):
        core, noise, label = brute_dbscan(z, eps, m)
        got = {r.id: r for r in A.detect(df, "id", "dbscan", eps=eps, min_samples=m).collect()}
        assert [got[i].is_anomaly for i in range(len(x))] == list(noise)
        # Rows without border ties: centroids of core points decide the score of noise rows closely.
        centres = np.array([z[label == c].mean(0) for c in sorted(set(label[core]))])
        want = np.sqrt(((z[:, None] - centres[None]) ** 2).sum(-1)).min(1)
        assert np.abs(np.array([got[i].score for i in range(len(x))]) - want).max() < 0.2


@pytest.mark.parametrize("point_pairs", [5_000_000, 0])
def test_linked_cells_separate_touching_clusters(spark, monkeypatch, point_pairs):
    # Two dense strips with a gap just above eps, then just below; with 0, cells are halved to the end.
    monkeypatch.setattr(A, "POINT_PAIRS", point_pairs)
    monkeypatch.setattr(A, "MAX_HALVINGS", 6)
    for gap, clusters in ((0.31, 2), (0.29, 1)):
        left = [(i * 0.05, 0.0) for i in range(40)]
        right = [(39 * 0.05 + gap + i * 0.05, 0.0) for i in range(40)]
        pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(left + right)], "id long, x array<double>")
        side = 0.3 / np.sqrt(2)
        core = pts.withColumn("cell", F.xxhash64(F.floor(F.col("x")[0] / side), F.floor(F.col("x")[1] / side)))
        from plumbline.operators.components import components
        found = components(core.select(F.col("cell").alias("id")).distinct(), A.linked_cells(core, 2, 0.3))
        assert found.select("component").distinct().count() == clusters


@pytest.mark.parametrize("name,params", [
    ("isolation_forest", {"contamination": 0.01, "n_estimators": 60}), ("mahalanobis", {"use_robust_covariance": False}),
    ("elliptic_envelope", {"contamination": 0.01}), ("kmeans", {"n_clusters": 2, "distance_percentile": 99}),
    ("one_class_svm", {"nu": 0.02}), ("multivariate_zscore", {"threshold": 3.0}), ("statistical", {"method": "zscore", "threshold": 3.0}),
])
def test_planted_outliers_are_found(data, name, params):
    df, x = data
    found = {r.id for r in A.detect(df, "id", name, **params).filter("is_anomaly").collect()}
    far = {len(x) - 4, len(x) - 3}
    assert far <= found and len(found) < 0.06 * len(x)


def test_pca_reconstruction(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(0, 1, 400)
    x = np.column_stack([t, 2 * t + rng.normal(0, 0.01, 400)])
    x[7] = [3.0, -6.0]
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "u": x[:, 0], "v": x[:, 1]}))
    top = A.detect(df, "id", "autoencoder", encoding_dim=1, error_percentile=99).orderBy(F.desc("score")).first()
    assert top.id == 7 and top.is_anomaly


def test_forest_is_repeatable_and_bounded(data):
    df, _ = data
    p = A.Prepared(df, "id", None)
    a, b = ({r.id: r.score for r in A.forest_scores(p, 30, 64).collect()} for _ in range(2))
    assert a == b and all(0 < v < 1 for v in a.values())


def test_explain_points_at_the_odd_column(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 3))
    x[11, 1] = 25.0
    df = spark.createDataFrame(pd.DataFrame({"id": range(500), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    rows = A.explain(df, "id", [11], trees=60).collect()
    assert max(rows, key=lambda r: r.contribution).feature == "b"


def test_nearest_centre_beyond_the_broadcast_limit(spark, monkeypatch):
    rng = np.random.default_rng(6)
    p, c = rng.uniform(0, 1, (300, 2)), rng.uniform(0, 1, (40, 2))
    pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(p)], "id long, x array<double>")
    cen = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(c)], "component long, x array<double>")
    monkeypatch.setattr(A, "CENTRES_IN_TASKS", 10)
    got = {r.id: r.score for r in A.nearest_centre(pts, cen, 2).collect()}
    want = np.sqrt(((p[:, None] - c[None]) ** 2).sum(-1)).min(1)
    assert np.allclose([got[i] for i in range(300)], want)


def test_robust_distance_takes_one_quantile_a_round(spark, monkeypatch):
    rows = [(i, float(i % 17), float((i * 7) % 23)) for i in range(300)] + [(999, 500.0, -400.0)]
    p = A.Prepared(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"])
    calls, pairs = [], A.order_pairs
    monkeypatch.setattr(A, "order_pairs", lambda *args: calls.append(1) or pairs(*args))
    monkeypatch.setattr(A, "exact_quantiles", lambda *args: pytest.fail("a second quantile"))
    dist = A.robust_distance(p, True)
    assert 2 <= len(calls) <= 7
    assert p.df.select("id", dist.alias("d")).orderBy(F.desc("d")).first().id == 999


def test_one_class_svm_sends_plain_columns(spark, monkeypatch):
    rows = [(i, float(i % 17), float((i * 7) % 23)) for i in range(300)]
    p = A.Prepared(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"])
    monkeypatch.setattr(A, "cut_at", lambda scores, q: scores)
    scores = A.one_class_svm(p, nu=0.1, rounds=2)
    assert scores.count() == 300 and "array(" not in scores._jdf.queryExecution().optimizedPlan().toString()
