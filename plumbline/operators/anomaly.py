"""Anomaly detection. Every detector returns the table's ids with a score and
a flag; models are small and travel to the rows, never the rows to a model.

Row identity is an explicit id column. Missing numbers, NaN and infinities
included, are replaced by the mean of the finite ones before any detector sees
them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numeric import finite
from plumbline.functions.special import chi_square_quantile
from plumbline.operators.components import components
from plumbline.operators.neighbours import knn
from plumbline.plans.primitives import agg_row, between, exact_quantiles, once, order_pairs
from plumbline.session import checkpointed


def numeric_columns(df: DataFrame, columns: Sequence[str] | None, id_col: str | None = None) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    chosen = list(columns) if columns else [c for c in kinds if c != id_col]
    return [c for c in chosen if isinstance(kinds[c], T.NumericType)]


class Prepared:
    """Mean-imputed (and standardised) expressions of the numeric columns."""

    def __init__(self, df: DataFrame, id_col: str, columns: Sequence[str] | None):
        self.id_col, self.columns = id_col, numeric_columns(df, columns, id_col)
        if not self.columns:
            raise ValueError("no numeric column to analyse")
        self.df = df.select(F.col(id_col).alias("id"), *[finite(F.col(c)).alias(f"x{i}") for i, c in enumerate(self.columns)])
        self.d = len(self.columns)
        aggs = {"n": F.count(F.lit(1))}
        for i in range(self.d):
            aggs |= {f"m{i}": F.avg(f"x{i}"), f"p{i}": F.stddev_pop(f"x{i}"), f"c{i}": F.count(f"x{i}")}
        self.stats = agg_row(self.df, aggs)
        self.n = self.stats["n"]
        self.x = [F.coalesce(f"x{i}", F.lit(self.stats[f"m{i}"] or 0.0)) for i in range(self.d)]
        # Deviations of the imputed column: imputed rows add nothing to the squares.
        self.pop_sd = [(self.stats[f"p{i}"] or 0.0) * math.sqrt(self.stats[f"c{i}"] / max(self.n, 1)) for i in range(self.d)]
        self.z = [(x - F.lit(self.stats[f"m{i}"] or 0.0)) / (self.pop_sd[i] or 1.0) for i, x in enumerate(self.x)]

    def samp_sd(self, i: int) -> float:
        return self.pop_sd[i] * math.sqrt(self.n / max(self.n - 1, 1))

    def scored(self, score: Column, hit: Column | None = None) -> DataFrame:
        out = self.df.select("id", score.cast("double").alias("score"))
        return out if hit is None else self.df.select(
            "id", score.cast("double").alias("score"), F.coalesce(hit, F.lit(False)).alias("is_anomaly"))


def cut_at(scores: DataFrame, q: float) -> DataFrame:
    """Flag scores above their exact ``q`` quantile."""
    scores = checkpointed(scores)
    (limit,) = exact_quantiles(scores, [(F.col("score"), q)])
    return scores.withColumn("is_anomaly", F.col("score") > F.lit(limit).cast("double"))


# -- statistical ------------------------------------------------------------
def statistical(p: Prepared, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Largest column-wise score per row: zscore, iqr or mad."""
    if method == "zscore":
        parts = [F.abs(x - p.stats[f"m{i}"]) / p.samp_sd(i) for i, x in enumerate(p.x) if p.samp_sd(i) > 0]
        score = F.greatest(F.lit(0.0), F.lit(0.0), *parts)
        return p.scored(score, score > threshold)
    if method == "iqr":
        qs = exact_quantiles(p.df, [(x, q) for x in p.x for q in (0.25, 0.75)])
        parts, hits = [], F.lit(False)
        for x, q1, q3 in zip(p.x, qs[::2], qs[1::2]):
            iqr = q3 - q1
            lo, hi = q1 - threshold * iqr, q3 + threshold * iqr
            hits = hits | (x < lo) | (x > hi)
            if iqr > 0:
                parts += [(lo - x) / iqr, (x - hi) / iqr]
        return p.scored(F.greatest(F.lit(0.0), F.lit(0.0), *parts), hits)
    if method == "mad":
        medians = exact_quantiles(p.df, [(x, 0.5) for x in p.x])
        mads = exact_quantiles(p.df, [(F.abs(x - m), 0.5) for x, m in zip(p.x, medians)])
        parts = [F.abs(x - m) * (0.6745 / s) for x, m, s in zip(p.x, medians, mads) if s]
        score = F.greatest(F.lit(0.0), F.lit(0.0), *parts)
        return p.scored(score, score > threshold)
    raise ValueError(f"unknown method {method!r}")


# -- isolation forest -------------------------------------------------------
def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Isolation tree as rows [feature, threshold, left, right, depth value]."""
    nodes: list[list[float]] = []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(x.shape[1])
        open_ = np.nonzero(spread > 0)[0]
        if depth >= limit or len(rows) <= 1 or len(open_) == 0:
            nodes.append([-1.0, 0.0, 0.0, 0.0, depth + average_path(len(rows))])
            return at
        f = int(rng.choice(open_))
        t = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        nodes.append([float(f), t, 0.0, 0.0, 0.0])
        nodes[at][2] = node(rows[rows[:, f] <= t], depth + 1)
        nodes[at][3] = node(rows[rows[:, f] > t], depth + 1)
        return at

    node(x, 0)
    return nodes


@F.pandas_udf(T.IntegerType())
def poisson(u: pd.Series, mean: pd.Series) -> pd.Series:
    """Quantiles of the Poisson law, added up in chunks of a mean of at most 32, so that no term underflows."""
    u, mean = u.to_numpy(float), mean.to_numpy(float)
    out, rest, part = np.zeros(len(u), np.int64), mean.copy(), 0
    while (rest > 0).any():
        m = np.minimum(rest, 32.0)
        p, total, k = np.exp(-m), np.exp(-m), np.zeros(len(u), np.int64)
        # Each chunk needs a number of its own; it is drawn from the digits of the first.
        v = np.modf(np.sin((u + part) * 78.233 + 12.9898) * 43758.5453)[0] % 1.0 if part else u
        while ((total < v) & (k < 400)).any():
            step = (total < v) & (k < 400)
            k += step
            p = np.where(step, p * m / np.maximum(k, 1), p)
            total = np.where(step, total + p, total)
        out += np.where(rest > 0, k, 0)
        rest, part = rest - m, part + 1
    return pd.Series(out.astype(np.int32))


def forest_rows(p: Prepared, trees: int, samples: int, seed: int) -> DataFrame:
    """(tree, no, x): the rows that fit each tree, about ``samples`` of them.

    Drawn from distinct rows with their counts: a row that occurs w times is drawn a number of times that follows its
    weight, and every draw falls to a tree by hash. So copies are as likely as any other rows, and no task ever holds
    the copies of one. Where all different rows fit one sample, each tree gets them all in proportion to their counts,
    and each at least once, so that a rare row among a few frequent ones is seen.
    """
    distinct = p.df.select(F.array(*p.x).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    if distinct.limit(samples + 1).count() <= samples:
        share = F.greatest(F.lit(1), F.least(F.col("w"), F.round(F.col("w") * (samples / p.n)).cast("long"))).cast("int")
        draws = distinct.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("no", F.explode(F.sequence(F.lit(1), share)))
        return draws.select("tree", F.col("no").cast("long").alias("no"), "x")
    unit = F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    times = poisson(unit, F.col("w") * (1.3 * samples * trees / p.n))
    draws = distinct.withColumn("times", times).filter("times > 0").withColumn("no", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return draws.select(F.pmod(F.xxhash64("x", "no", F.lit(seed + 1)), F.lit(trees)).cast("int").alias("tree"), F.col("no").cast("long").alias("no"), "x")


def fit_forest(p: Prepared, trees: int, samples: int, seed: int) -> tuple[list[np.ndarray], float]:
    """Trees fitted in parallel, each on its own rows (at most ``samples``); the model is bounded by the parameters.
    A table without rows has no forest."""
    if not p.n:
        raise ValueError("no row to fit a forest on")
    rows = forest_rows(p, trees, samples, seed)
    limit = math.ceil(math.log2(max(samples, 2)))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(k=pdf["x"].map(tuple)).sort_values(["no", "k"])
        # First draws of different rows go before further draws of the same one.
        pdf = pd.concat([pdf[pdf["no"] == 1].sample(frac=1.0, random_state=seed + int(key[0])), pdf[pdf["no"] > 1].sample(frac=1.0, random_state=seed + int(key[0]))]).head(samples)
        tree = grow(np.array(pdf["x"].tolist(), dtype=float), np.random.default_rng(seed + int(key[0])), limit)
        return pd.DataFrame({"tree": [int(key[0])], "rows": [len(pdf)], "model": [json.dumps(tree)]})

    fitted = rows.groupBy("tree").applyInPandas(fit, "tree int, rows int, model string").collect()
    fitted.sort(key=lambda r: r["tree"])
    if not fitted:
        raise ValueError("no row was drawn for any tree")
    size = float(np.mean([r["rows"] for r in fitted]))
    return [np.array(json.loads(r["model"])) for r in fitted], average_path(size) or 1.0


def forest_scores(p: Prepared, trees: int = 100, samples: int = 256, seed: int = 42) -> DataFrame:
    model, norm = fit_forest(p, trees, samples, seed)
    shared = p.df.sparkSession.sparkContext.broadcast((model, norm))
    score = forest_udf(shared)
    return p.scored(score(F.array(*p.x)))


def forest_udf(shared: Any) -> Callable[[Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        model, norm = shared.value
        rows = np.array(x.tolist(), dtype=float)
        total = np.zeros(len(rows))
        for tree in model:
            at = np.zeros(len(rows), dtype=int)
            while True:
                feature = tree[at, 0].astype(int)
                inner = feature >= 0
                if not inner.any():
                    break
                left = rows[np.arange(len(rows)), np.maximum(feature, 0)] <= tree[at, 1]
                at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(int), at)
            total += tree[at, 4]
        return pd.Series(np.power(2.0, -(total / max(len(model), 1)) / norm))
    return score


def isolation_forest(p: Prepared, n_estimators: int = 100, contamination: float = 0.1, max_samples: int | None = 256,
                     random_state: int | None = 42) -> DataFrame:
    scores = forest_scores(p, n_estimators, int(max_samples or 256), random_state or 42)
    return cut_at(scores, 1.0 - contamination)


# -- neighbours -------------------------------------------------------------
def weighted_points(p: Prepared) -> tuple[DataFrame, DataFrame]:
    """Distinct standardised points (id, x, w) and the rows (rid, id)."""
    rows = p.df.select(F.col("id").alias("rid"), F.array(*p.z).alias("x"))
    rows = checkpointed(rows.withColumn("id", F.xxhash64("x")))
    return rows.groupBy("id").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("w")), rows.select("rid", "id")


def local_outlier_factor(p: Prepared, n_neighbors: int = 20, contamination: float = 0.1,
                         metric: str = "euclidean") -> DataFrame:
    """LOF over exact neighbours; copies of a point count as neighbours."""
    if metric != "euclidean":
        raise ValueError("LOF uses the euclidean metric")
    points, rows = weighted_points(p)
    k = max(1, min(n_neighbors, p.n - 1))
    near = checkpointed(knn(points, p.d, k))
    kdist = near.groupBy("id").agg(F.max("d").alias("kd"), F.sum("w").alias("got"))
    reach = (near.join(kdist.select(F.col("id").alias("other"), "kd"), "other")
             .groupBy("id").agg((F.sum("w") / (F.sum(F.greatest("kd", "d") * F.col("w")) + 1e-10 * F.sum("w"))).alias("lrd")))
    reach = checkpointed(reach)
    lof = (near.join(reach.select(F.col("id").alias("other"), F.col("lrd").alias("olrd")), "other")
           .groupBy("id").agg((F.sum(F.col("olrd") * F.col("w")) / F.sum("w")).alias("around"))
           .join(reach, "id").select("id", (F.col("around") / F.col("lrd")).alias("score")))
    return cut_at(rows.join(lof, "id").select(F.col("rid").alias("id"), "score"), 1.0 - contamination)


def dbscan_flags(p: Prepared, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points with ``core`` and ``noise`` flags, rows, neighbour list.

    A point is core when the copies within eps, itself included, reach
    ``min_samples``. The list of a non-core point is complete, so a border
    point sees all its core neighbours.
    """
    points, rows = weighted_points(p)
    points = checkpointed(points)
    near = checkpointed(knn(points, p.d, max(min_samples - 1, 1), eps))
    size = near.groupBy("id").agg(F.sum("w").alias("around"))
    state = checkpointed(points.join(size, "id", "left").withColumn(
        "core", F.coalesce("around", F.lit(0)) + 1 >= min_samples).select("id", "x", "w", "core"))
    beside = (near.join(state.filter("core").select(F.col("id").alias("other")), "other")
              .groupBy("id").agg(F.min_by("other", F.struct("d", "other")).alias("host")))
    state = state.join(beside, "id", "left").withColumn("noise", ~F.col("core") & F.col("host").isNull())
    return checkpointed(state), rows, near


MAX_HALVINGS = 40
POINT_PAIRS = 5_000_000


def linked_cells(core: DataFrame, dims: int, eps: float) -> DataFrame:
    """(a, b): pairs of grid cells that hold core points within eps.

    Cells have a diagonal of at most eps, so all core points of a cell belong
    together. Whether two nearby cells are linked is settled on tight boxes:
    all pairs within eps, none within eps, or both cells are halved and only
    the undecided parts are compared again.
    """
    side = eps / math.sqrt(dims)
    grid = core.withColumnRenamed("cell", "top")
    axes = min(dims, 3)
    span = math.ceil(math.sqrt(dims))

    def key(level: int) -> Column:
        s = side / (2 ** level)
        return F.concat_ws("_", *[F.floor(F.col("x")[i] / s).cast("string") for i in range(dims)])

    def boxes(level: int, by_point: bool = False) -> DataFrame:
        """Tight boxes of the cells of a level, or of single points, with the
        cell of the level above they lie in."""
        parent = key(max(level - 1, 0))
        if by_point:
            return grid.select("top", parent.alias("parent"), F.col("id").cast("string").alias("part"),
                               F.col("x").alias("lo"), F.col("x").alias("hi"), F.lit(1).cast("long").alias("n"))
        return grid.withColumn("parent", parent).withColumn("part", key(level)).groupBy("top", "parent", "part").agg(
            F.array(*[F.min(F.col("x")[i]) for i in range(dims)]).alias("lo"),
            F.array(*[F.max(F.col("x")[i]) for i in range(dims)]).alias("hi"), F.count(F.lit(1)).alias("n"))

    def bounds(pairs: DataFrame) -> DataFrame:
        low, high = F.lit(0.0), F.lit(0.0)
        for i in range(dims):
            gap = F.greatest(F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i], F.lit(0.0))
            wide = F.greatest(F.col("hi_a")[i] - F.col("lo_b")[i], F.col("hi_b")[i] - F.col("lo_a")[i])
            low, high = low + gap * gap, high + wide * wide
        pairs = pairs.withColumn("low", F.sqrt(low)).withColumn("high", F.sqrt(high))
        return pairs.filter(F.col("low") <= eps).select("a", "b", "pa", "pb", "high", "n_a", "n_b")

    def sides(cells: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
        return tuple(cells.select(F.col("top").alias(s), F.col("part").alias(f"p{s}"), F.col("lo").alias(f"lo_{s}"),
                                  F.col("hi").alias(f"hi_{s}"), F.col("n").alias(f"n_{s}"),
                                  *[F.col(e).alias(f"{e}_{s}") for e in extra]) for s in "ab")

    first = checkpointed(boxes(0).withColumns({f"g{i}": F.floor(F.col("lo")[i] / side) for i in range(axes)}))
    spots = [f"g{i}" for i in range(axes)]
    left, right = sides(first, *spots)
    offsets = F.array(*[F.array(*[F.lit(int(o) - span) for o in off]) for off in np.ndindex(*([2 * span + 1] * axes))])
    left = left.withColumn("off", F.explode(offsets))
    for i, g in enumerate(spots):
        left = left.withColumn(g, F.col(f"{g}_a") + F.col("off")[i])
        right = right.withColumnRenamed(f"{g}_b", g)
    near = checkpointed(bounds(left.join(right, spots).filter("a < b")))
    links, level, by_point = None, 0, False
    while True:
        sure = near.filter(F.col("high") <= eps).select("a", "b").distinct()
        links = checkpointed(sure if links is None else links.unionByName(sure).distinct())
        open_ = checkpointed(near.filter(F.col("high") > eps).drop("high").join(links, ["a", "b"], "left_anti"))
        if by_point or open_.isEmpty():
            return links
        level += 1
        # Few undecided pairs of points are compared as they are; so are points
        # so close that they differ in their last bits only.
        undecided = open_.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).first()[0]
        by_point = undecided <= POINT_PAIRS or level > MAX_HALVINGS
        left, right = sides(checkpointed(boxes(level, by_point)), "parent")
        open_ = open_.select("a", "b", F.col("pa").alias("parent_a"), F.col("pb").alias("parent_b"))
        near = checkpointed(bounds(open_.join(left, ["a", "parent_a"]).join(right, ["b", "parent_b"])))


def dbscan(p: Prepared, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean") -> DataFrame:
    """Noise points are anomalies; the score is the distance to the nearest
    cluster centroid, for every row."""
    if metric != "euclidean":
        raise ValueError("DBSCAN uses the euclidean metric")
    state, rows, _ = dbscan_flags(p, eps, min_samples)
    side = eps / math.sqrt(p.d)
    cell = F.xxhash64(*[F.floor(F.col("x")[i] / side) for i in range(p.d)])
    core = checkpointed(state.filter("core").withColumn("cell", cell))
    nodes = core.select(F.col("cell").alias("id")).distinct()
    joined = components(nodes, linked_cells(core, p.d, eps))
    cores = core.join(joined.withColumnRenamed("id", "cell"), "cell").select("id", "x", "w", "component")
    border = (state.filter("not core and not noise").join(
        cores.select(F.col("id").alias("host"), "component"), "host").select("id", "x", "w", "component"))
    members = cores.unionByName(border)
    centres = members.groupBy("component").agg(*[
        (F.sum(F.col("x")[i] * F.col("w")) / F.sum("w")).alias(f"c{i}") for i in range(p.d)])
    centres = centres.select("component", F.array(*[f"c{i}" for i in range(p.d)]).alias("x"))
    scored = nearest_centre(state.select("id", "x", "noise"), centres, p.d)
    return rows.join(scored, "id").select(F.col("rid").alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"),
                                          F.col("noise").alias("is_anomaly"))


CENTRES_IN_TASKS = 10_000


def nearest_centre(points: DataFrame, centres: DataFrame, dims: int) -> DataFrame:
    """Distance of each point to the nearest centre.

    Up to CENTRES_IN_TASKS centres travel to the tasks; more of them are
    searched through the exact neighbour operator.
    """
    n = centres.count()
    if n == 0:
        return points.withColumn("score", F.lit(0.0))
    if n <= CENTRES_IN_TASKS:
        shared = points.sparkSession.sparkContext.broadcast(np.array([r["x"] for r in centres.select("x").collect()]))

        @F.pandas_udf(T.DoubleType())
        def distance(x: pd.Series) -> pd.Series:
            c, rows = shared.value, np.array(x.tolist(), dtype=float)
            out = np.empty(len(rows))
            for a in range(0, len(rows), 256):
                out[a:a + 256] = np.sqrt(((rows[a:a + 256, None, :] - c[None, :, :]) ** 2).sum(-1)).min(1)
            return pd.Series(out)
        return points.withColumn("score", distance("x"))
    # Rows of weight 0 ask but are nobody's neighbour; every centre has weight 1.
    both = points.select("id", "x", F.lit(0).alias("w")).unionByName(
        centres.select(F.xxhash64("component", F.lit("centre")).alias("id"), "x", F.lit(1).alias("w")))
    near = knn(both.withColumn("w", F.col("w").cast("long")), dims, 1)
    return points.join(near.groupBy("id").agg(F.min("d").alias("score")), "id", "left")


# -- linear models ----------------------------------------------------------
def covariance(frame: DataFrame, cols: Sequence[Column]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector and sample covariance matrix by aggregates."""
    d = len(cols)
    aggs = {"n": F.count(F.lit(1)), **{f"m{i}": F.avg(c) for i, c in enumerate(cols)}}
    aggs |= {f"v{i}_{j}": F.covar_samp(cols[i], cols[j]) for i in range(d) for j in range(i, d)}
    row = agg_row(frame, aggs)
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = row[f"v{i}_{j}"] or 0.0
    return np.array([row[f"m{i}"] or 0.0 for i in range(d)]), cov, row["n"]


def quadratic(cols: Sequence[Column], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """(x - m)' A (x - m) as a Column expression."""
    c = [x - float(m) for x, m in zip(cols, mean)]
    terms = [c[i] * c[j] * float(inverse[i, j] * (1 if i == j else 2)) for i in range(len(c)) for j in range(i, len(c))]
    return reduce(lambda a, b: a + b, terms)


def robust_distance(p: Prepared, robust: bool, rounds: int = 6) -> Column:
    """Squared Mahalanobis distance; the robust form re-estimates mean and
    covariance on the nearer half until it settles (concentration steps)."""
    mean, cov, _ = covariance(p.df, p.z)
    dist = quadratic(p.z, mean, np.linalg.pinv(cov))
    if not robust or p.n <= 2 * (p.d + 1):
        return dist
    previous = None
    zs = [F.col(f"z{i}") for i in range(p.d)]
    table = once(p.df, {f"z{i}": z for i, z in enumerate(p.z)}).select(*zs)
    apart = once(table, {"dist": quadratic(zs, mean, np.linalg.pinv(cov))})
    (middle,) = order_pairs(apart, [(F.col("dist"), 0.5)])
    for _ in range(rounds):
        half = between(*middle)
        mean, cov, _ = covariance(apart.filter(F.col("dist") <= F.lit(half)), zs)
        inverse = np.linalg.pinv(cov)
        dist = raw = quadratic(p.z, mean, inverse)
        apart = once(table, {"dist": quadratic(zs, mean, inverse)})
        (middle,) = order_pairs(apart, [(F.col("dist"), 0.5)])
        median = between(*middle)
        if median:  # Scale so that the median distance is that of normal data; the scaled middle is that of the next round.
            scale = chi_square_quantile(0.5, p.d) / median
            dist, middle = raw * scale, (middle[0] * scale, middle[1] * scale, middle[2])
            apart = once(table, {"dist": quadratic(zs, mean, inverse) * scale})
        if previous is not None and abs(half - previous) < 1e-9:
            break
        previous = half
    return dist


def mahalanobis(p: Prepared, threshold_percentile: float = 97.5, use_robust_covariance: bool = True) -> DataFrame:
    dist = robust_distance(p, use_robust_covariance)
    limit = chi_square_quantile(threshold_percentile / 100.0, p.d)
    return p.scored(F.sqrt(dist), dist > limit)


def elliptic_envelope(p: Prepared, contamination: float = 0.1) -> DataFrame:
    return cut_at(p.scored(F.sqrt(robust_distance(p, True))), 1.0 - contamination)


def pca_error(p: Prepared, n_components: int | None = None, variance_ratio: float = 0.95) -> Column:
    """Mean squared reconstruction error on the leading components."""
    mean, cov, _ = covariance(p.df, p.z)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    if n_components is None:
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        n_components = int(np.searchsorted(share, variance_ratio) + 1)
    lost = range(min(int(n_components), p.d), p.d)
    error = F.lit(0.0)
    for k in lost:
        along = reduce(lambda a, b: a + b, [(z - float(m)) * float(vectors[i, k])
                                            for i, (z, m) in enumerate(zip(p.z, mean))])
        error = error + along * along
    return error / float(p.d)


def pca(p: Prepared, n_components: int | None = None, variance_ratio: float = 0.95,
        error_percentile: float = 95) -> DataFrame:
    return cut_at(p.scored(pca_error(p, n_components, variance_ratio)), error_percentile / 100.0)


def autoencoder(p: Prepared, encoding_dim: int | None = None, epochs: int = 50, error_percentile: float = 95) -> DataFrame:
    """Linear autoencoder: its optimum is the projection on the leading
    components, so no epochs are needed."""
    size = min(encoding_dim or max(1, p.d // 2), p.d)
    return cut_at(p.scored(pca_error(p, size)), error_percentile / 100.0)


def kmeans(p: Prepared, n_clusters: int = 5, distance_percentile: float = 95, seed: int = 42) -> DataFrame:
    """Distance to the nearest of k centres."""
    frame = p.df.select("id", *[z.alias(f"z{i}") for i, z in enumerate(p.z)])
    vectors = VectorAssembler(inputCols=[f"z{i}" for i in range(p.d)], outputCol="features").transform(frame)
    model = KMeans(k=n_clusters, seed=seed, maxIter=20).fit(vectors.select("features"))
    spots = [F.sqrt(reduce(lambda a, b: a + b, [F.pow(z - float(c[i]), 2) for i, z in enumerate(p.z)]))
             for c in model.clusterCenters()]
    return cut_at(p.scored(spots[0] if len(spots) == 1 else F.least(*spots)), distance_percentile / 100.0)


def one_class_svm(p: Prepared, kernel: str = "rbf", nu: float = 0.1, gamma: Any = "scale", features: int = 32,
                  rounds: int = 8, seed: int = 42) -> DataFrame:
    """One-class SVM on random Fourier features, by full-table subgradient
    steps: the direction moves towards the mean feature vector of the rows
    below the margin. A step reads the table once for the margin's quantile
    and once for the sums, one row of sums per task."""
    if kernel == "linear":
        freq = None
    elif kernel == "rbf":
        g = 1.0 / p.d if gamma in ("scale", "auto") else float(gamma)
        freq = np.random.default_rng(seed).normal(0.0, math.sqrt(2.0 * g), (p.d, features))
    else:
        raise ValueError("kernel must be rbf or linear")
    zs = [f"z{i}" for i in range(p.d)]
    frame = p.df.select("id", *[z.alias(name) for z, name in zip(p.z, zs)])
    size = p.d if freq is None else 2 * features

    def phi(z: Sequence[pd.Series]) -> np.ndarray:
        rows = np.column_stack([x.to_numpy(float) for x in z])
        if freq is None:
            return rows
        angle = rows @ freq
        return np.hstack([np.cos(angle), np.sin(angle)]) / math.sqrt(features)

    def margin(w: np.ndarray) -> Column:
        @F.pandas_udf(T.DoubleType())
        def score(*z: pd.Series) -> pd.Series:
            return pd.Series(phi(z) @ w)
        return score(*zs)

    def mean_below(w: np.ndarray | None, rho: float) -> np.ndarray | None:
        def sums(batches: Any) -> Any:
            total = np.zeros(size + 1)
            for pdf in batches:
                f = phi([pdf[name] for name in zs])
                low = np.ones(len(f), bool) if w is None else f @ w <= rho
                total += np.append(f[low].sum(0), low.sum())
            yield pd.DataFrame([total], columns=[f"t{i}" for i in range(size + 1)])
        parts = frame.select(*zs).mapInPandas(sums, ", ".join(f"t{i} double" for i in range(size + 1)))
        row = np.array(parts.agg(*[F.sum(f"t{i}") for i in range(size + 1)]).first(), dtype=float)
        return row[:-1] / row[-1] if row[-1] > 0 else None

    weight = mean_below(None, 0.0)
    for step in range(rounds):
        (rho,) = frame.agg(F.percentile_approx(margin(weight), nu, 10000)).first()
        low = mean_below(weight, rho)
        if low is None:
            break
        eta = 1.0 / (step + 2.0)
        weight = (1 - eta) * weight + eta * low
    return cut_at(frame.select("id", (-margin(weight)).alias("score")), 1.0 - nu)


def multivariate_zscore(p: Prepared, threshold: float = 3.0, method: str = "any") -> DataFrame:
    """Column-wise z-scores combined by any, all, mean or max."""
    z = [F.abs(x - p.stats[f"m{i}"]) / (p.samp_sd(i) or 1.0) for i, x in enumerate(p.x)]
    top = F.greatest(F.lit(0.0), *z)
    if method == "all":
        score = F.least(F.lit(float("inf")), *z)
    elif method == "mean":
        score = reduce(lambda a, b: a + b, z) / float(p.d)
    else:
        score = top
    return p.scored(score, score > threshold)


# -- ensemble ---------------------------------------------------------------
def ensemble(p: Prepared, strategy: str = "weighted_average", weights: Sequence[float] = (0.3, 0.3, 0.4),
             vote_threshold: float = 0.5) -> DataFrame:
    """z-score, IQR and isolation forest, their scores scaled by the maximum
    for averaging; cut at mean + 2 deviations, or by votes."""
    parts = [statistical(p, "zscore", 3.0), statistical(p, "iqr", 1.5), isolation_forest(p, 100)]
    joined = None
    for i, part in enumerate(parts):
        part = part.select("id", F.col("score").alias(f"s{i}"), F.col("is_anomaly").alias(f"a{i}"))
        joined = part if joined is None else joined.join(part, "id")
    joined = checkpointed(joined)
    s = [F.col(f"s{i}") for i in range(3)]
    votes = reduce(lambda a, b: a + b, [F.col(f"a{i}").cast("int") for i in range(3)])
    if strategy in ("vote", "unanimous"):
        share = votes / 3.0
        hit = share >= vote_threshold if strategy == "vote" else votes == 3
        return joined.select("id", share.alias("score"), hit.alias("is_anomaly"))
    w = [weights[i] if i < len(weights) else 1 / 3 for i in range(3)]
    raw = {"average": reduce(lambda a, b: a + b, s) / 3.0, "max": F.greatest(*s), "min": F.least(*s),
           "weighted_average": reduce(lambda a, b: a + b, [x * float(v) for x, v in zip(s, w)])}[strategy]
    row = joined.agg(F.max(raw).alias("top"), F.avg(raw).alias("m"), F.stddev_pop(raw).alias("sd")).first()
    top = row["top"] if row["top"] and row["top"] > 0 else 1.0
    return joined.select("id", (raw / top).alias("score"),
                         (raw / top > F.lit((row["m"] + 2 * row["sd"]) / top)).alias("is_anomaly"))


ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "statistical": statistical, "isolation_forest": isolation_forest, "lof": local_outlier_factor,
    "one_class_svm": one_class_svm, "dbscan": dbscan, "autoencoder": autoencoder, "ensemble": ensemble,
    "mahalanobis": mahalanobis, "elliptic_envelope": elliptic_envelope, "pca": pca, "kmeans": kmeans,
    "multivariate_zscore": multivariate_zscore,
}


def detect(df: DataFrame, id_col: str, algorithm: str, columns: Sequence[str] | None = None, **params: Any) -> DataFrame:
    """(id, score, is_anomaly) for every row of the table."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return ALGORITHMS[algorithm](Prepared(df, id_col, columns), **params)


def report(scored: DataFrame) -> DataFrame:
    """Totals of a detection."""
    hits = F.count_if("is_anomaly")
    return scored.agg(F.count(F.lit(1)).alias("total_rows"), hits.alias("anomaly_count"),
                      F.round(F.coalesce(hits / F.count(F.lit(1)), F.lit(0.0)), 6).alias("anomaly_rate"))


def top_anomalies(scored: DataFrame, n: int = 100) -> DataFrame:
    return scored.filter("is_anomaly").orderBy(F.desc("score"), "id").limit(n)


def column_summaries(df: DataFrame, id_col: str, scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: anomalies among its filled rows, rate, mean score, range."""
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]).join(scored, "id")
    long = rows.unpivot(["id", "score", "is_anomaly"], list(columns), "column", "value")
    hit = F.col("is_anomaly") & F.col("value").isNotNull()
    return long.groupBy("column").agg(
        F.count_if(hit).alias("anomaly_count"), F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("anomaly_rate"),
        F.round(F.coalesce(F.avg(F.when(F.col("is_anomaly"), F.col("score"))), F.lit(0.0)), 6).alias("mean_anomaly_score"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"))


# -- comparing detectors ----------------------------------------------------
def run_many(df: DataFrame, id_col: str, runs: dict[str, dict[str, Any]], columns: Sequence[str] | None = None) -> DataFrame:
    """(algorithm, id) of the anomalies of several detectors."""
    parts = []
    for name, params in runs.items():
        params = dict(params)
        found = detect(df, id_col, params.pop("algorithm", name), columns, **params)
        parts.append(found.filter("is_anomaly").select(F.lit(name).alias("algorithm"), "id"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def agreement(found: DataFrame, n_algorithms: int) -> DataFrame:
    """Per row: how many detectors flagged it, and the level of agreement."""
    n = F.col("detection_count")
    return (found.groupBy("id").agg(F.count_distinct("algorithm").alias("detection_count"),
                                    F.array_sort(F.collect_set("algorithm")).alias("detected_by"))
            .withColumn("agreement_level", F.when(n == n_algorithms, "all").when(n >= n_algorithms // 2 + 1, "majority")
                        .when(n >= 2, "some").otherwise("one"))
            .withColumn("confidence", F.round(n / n_algorithms, 6)))


def agreement_summary(found: DataFrame, n_algorithms: int) -> DataFrame:
    """Cumulative counts: majority includes all, some includes majority."""
    n = F.col("detection_count")
    return agreement(found, n_algorithms).agg(
        F.count(F.lit(1)).alias("total_unique_anomalies"), F.count_if(n == n_algorithms).alias("all_agree"),
        F.count_if(n >= n_algorithms // 2 + 1).alias("majority_agree"), F.count_if(n >= 2).alias("some_agree"),
        F.count_if(n == 1).alias("one_only"))


def overlap_matrix(found: DataFrame) -> DataFrame:
    """(algorithm_i, algorithm_j, overlap): pairs come from the few detector
    names of a row, not from pairs of rows."""
    named = found.distinct().groupBy("id").agg(F.collect_set("algorithm").alias("names"))
    return (named.select(F.explode("names").alias("algorithm_i"), "names")
            .select("algorithm_i", F.explode("names").alias("algorithm_j"))
            .groupBy("algorithm_i", "algorithm_j").agg(F.count(F.lit(1)).alias("overlap")))


def batch(sources: dict[str, tuple[DataFrame, str]], algorithm: str, columns: Sequence[str] | None = None,
          **params: Any) -> DataFrame:
    """One row per source; a source that fails keeps a row with its error."""
    parts = []
    for name, (df, id_col) in sources.items():
        try:
            row = report(detect(df, id_col, algorithm, columns, **params)).withColumn("error", F.lit(None).cast("string"))
        except Exception as exc:  # noqa: BLE001 - one bad source must not stop the batch
            row = df.sparkSession.range(1).select(
                F.lit(None).cast("long").alias("total_rows"), F.lit(None).cast("long").alias("anomaly_count"),
                F.lit(None).cast("double").alias("anomaly_rate"), F.lit(str(exc)[:200]).alias("error"))
        parts.append(row.select(F.lit(name).alias("source"), "total_rows", "anomaly_count", "anomaly_rate", "error"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def explain(df: DataFrame, id_col: str, ids: Sequence[Any], columns: Sequence[str] | None = None, trees: int = 100,
            samples: int = 256, seed: int = 42, donors: int = 20) -> DataFrame:
    """Feature contributions of chosen rows under an isolation forest.

    The contribution of a feature is the score minus the mean score with that
    value replaced by the values of ``donors`` hash-ordered other rows.
    """
    p = Prepared(df, id_col, columns)
    model, norm = fit_forest(p, trees, samples, seed)
    score = forest_udf(p.df.sparkSession.sparkContext.broadcast((model, norm)))
    pool = p.df.select(*[x.alias(f"x{i}") for i, x in enumerate(p.x)], F.xxhash64("id", F.lit(seed)).alias("h"))
    lenders = pool.orderBy("h").limit(donors).collect()
    chosen = p.df.filter(F.col("id").isin(list(ids))).select("id", F.array(*p.x).alias("x"))
    variants = [F.struct(F.lit(-1).alias("f"), F.col("x").alias("v"))]
    for i in range(p.d):
        for r in lenders:
            swapped = F.array(*[F.lit(float(r[f"x{i}"])) if j == i else F.col("x")[j] for j in range(p.d)])
            variants.append(F.struct(F.lit(i).alias("f"), swapped.alias("v")))
    scored = chosen.select("id", "x", F.explode(F.array(*variants)).alias("s")).select(
        "id", "x", F.col("s.f").alias("f"), score(F.col("s.v")).alias("score"))
    base = scored.filter("f = -1").select("id", F.col("score").alias("base"))
    names = F.array(*[F.lit(c) for c in p.columns])
    means = F.array(*[F.lit(float(p.stats[f"m{i}"] or 0.0)) for i in range(p.d)])
    out = (scored.filter("f >= 0").groupBy("id", "f").agg(F.avg("score").alias("without"), F.first("x").alias("x"))
           .join(base, "id"))
    value = F.get(F.col("x"), F.col("f"))
    return out.select("id", F.get(names, F.col("f")).alias("feature"), value.alias("value"),
                      F.round(F.col("base") - F.col("without"), 6).alias("contribution"),
                      F.when(value > F.get(means, F.col("f")), "above mean").otherwise("at or below mean").alias("direction"))
