"""Detectors over points of several numbers that learn anew at every turn: windowed isolation forest, half-space trees, and
robust random cut forest.

A session's points are counted; at every ``turn``-th point a model starts from the ``back`` points before it and judges the points up to the
next turn. So a stretch of points can be judged with no more than the points before it. As a stream, a session's state is its number of points
and the last of them; its points leave the ordered part in stretches, which are then dealt out to all tasks. As a batch, each
stretch of a session is a group of its own. A session that holds most points is shared out in both; both give equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.anomaly import average_path, grow
from plumbline.plans.primitives import range_sorted
from plumbline.session import checkpointed
from plumbline.streaming import lanes
from plumbline.streaming.ordered import MOST_IDLE_MS, Fold, fold_stream


class Model(Protocol):
    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and verdict of the next points (rows of ``x``), in order."""


@dataclass(frozen=True)
class Turn:
    """Points ``x`` from a turn on, the points before it, and the least and greatest numbers of the session's first points."""

    number: int
    before: np.ndarray
    ends: np.ndarray | None
    x: np.ndarray


@dataclass(frozen=True)
class Turning:
    """``start(turn, before, ends)`` makes the model of a turn: ``before`` holds the points before it, at most ``back`` of them, ``ends`` the
    least and greatest numbers of the session's first ``back`` points. Points of turn 0 are not judged, unless ``early``. ``together`` gives
    the scores and verdicts of many turns, equal to those of their models."""

    turn: int
    back: int
    start: Callable[[int, np.ndarray, np.ndarray], Model]
    early: bool = False
    together: Callable[[Sequence[Turn]], list[tuple[np.ndarray, np.ndarray]]] | None = None

    def judged(self, turns: Sequence[Turn]) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.together is not None:
            return self.together(turns)
        return [self.start(t.number, t.before, t.ends).judge(t.x) for t in turns]


@dataclass
class Stretch:
    """Points of a session in order: ``x`` from the ``first``-th on, of which those from the ``fresh``-th on are to be judged."""

    first: int
    fresh: int
    ends: np.ndarray | None
    x: np.ndarray


def judged(kind: Turning, stretches: Sequence[Stretch]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Scores and verdicts of the fresh points of each stretch."""
    turns, places = [], []
    out = [(np.zeros(len(s.x)), np.zeros(len(s.x), bool)) for s in stretches]
    for k, s in enumerate(stretches):
        for number in range(s.fresh // kind.turn, -(-(s.first + len(s.x)) // kind.turn)):
            if number or kind.early:
                at = number * kind.turn - s.first
                turns.append(Turn(number, s.x[max(0, at - kind.back):at], s.ends if number else None, s.x[at:at + kind.turn]))
                places.append((k, at))
    for (k, at), (scores, hits) in zip(places, kind.judged(turns) if turns else [], strict=True):
        out[k][0][at:at + len(scores)], out[k][1][at:at + len(scores)] = scores, hits
    return [(scores[s.fresh - s.first:], hits[s.fresh - s.first:]) for s, (scores, hits) in zip(stretches, out, strict=True)]


def wide_points(df: DataFrame, session: str, ts: str, event_id: str, values: Sequence[str]) -> DataFrame:
    """(session, ts, event_id, x): points of several numbers; rows with a missing one are left out, as are those without a time."""
    numbers = [F.col(c).cast("double") for c in values]
    whole = F.col(ts).isNotNull()
    for n in numbers:
        whole = whole & n.isNotNull() & ~F.isnan(n)
    return df.filter(whole).select(F.col(session).cast("string").alias("session"), F.col(ts).cast("timestamp").alias("ts"),
                                   F.col(event_id).cast("long").alias("event_id"), F.array(*numbers).alias("x"))


def matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=float)


def flat(x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Points of an Arrow column as a matrix."""
    whole = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


#: Points that a group of the batch form judges, points of a stretch of the stream, and points judged at once.
GROUP, PIECE, AT_ONCE = 65_536, 16_384, 131_072
JUDGED = "session string, event_id long, t long, x array<double>, score double, is_anomaly boolean"


def told(df: DataFrame) -> DataFrame:
    return df.select("session", "event_id", F.timestamp_micros("t").alias("ts"), "x", "score", "is_anomaly")


def as_stream(pts: DataFrame, kind: Turning, lateness: str = "10 minutes", idle_ms: int = MOST_IDLE_MS) -> DataFrame:
    """(session, event_id, ts, x, score, is_anomaly) of a stream of wide points, in event order."""
    def advance(state: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        n, kept, ends = cloudpickle.loads(bytes(state[0])) if state is not None else (0, None, None)
        new, out = matrix(pdf["x"]), []
        for at in range(0, len(new), PIECE):
            x = new[at:at + PIECE] if kept is None else np.concatenate([kept, new[at:at + PIECE]])
            first, end = n - (0 if kept is None else len(kept)), n + len(new[at:at + PIECE])
            if ends is None and end >= kind.back:  # no point has been let go so far
                ends = np.stack([x[:kind.back].min(0), x[:kind.back].max(0)])
            part = pdf.iloc[at:at + PIECE]
            out.append((n, cloudpickle.dumps((Stretch(first, n, ends, x), part["event_id"].to_numpy(), part["t_us"].to_numpy()))))
            n, kept = end, x[max(0, end // kind.turn * kind.turn - kind.back - first):].copy()
        return (cloudpickle.dumps((n, kept, ends)),), pd.DataFrame(out, columns=["n", "stretch"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = max(1, AT_ONCE // PIECE)
            for k in range(0, batch.num_rows, some):
                keys = batch.column("session")[k:k + some].to_pylist()
                rows = [cloudpickle.loads(s) for s in batch.column("stretch")[k:k + some].to_pylist()]
                for key, (s, event_id, t), (scores, hits) in zip(keys, rows, judged(kind, [r[0] for r in rows]), strict=True):
                    x = s.x[s.fresh - s.first:]
                    points = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(x), pa.string()), pa.array(event_id, pa.int64()), pa.array(t, pa.int64()), points,
                                                      pa.array(scores), pa.array(hits)], names=["session", "event_id", "t", "x", "score", "is_anomaly"])

    spark = pts.sparkSession
    stretches = fold_stream(pts.withColumnsRenamed({"session": "key", "ts": "event_time"}), Fold("kept binary", "n long, stretch binary", advance, idle_ms), lateness)
    dealt = stretches.withColumnRenamed("key", "session").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session", "n")
    out = told(dealt.mapInArrow(judge, JUDGED))
    out.closing = stretches.closing
    return out


def numbered(pts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with ``n``, their place in the session, and the number of points (``points``) of each session. Rows are sorted in ranges, so a
    session goes on over borders; only the first session of a range has points in earlier ones."""
    parts = checkpointed(range_sorted(pts, ["session", "ts", "event_id"]))
    counts = parts.groupBy("__pid", "session").agg(F.count(F.lit(1)).alias("points"))
    ahead = Window.partitionBy("session").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("ahead", F.sum("points").over(ahead)).filter("ahead is not null").select(F.col("__pid").alias("p"), F.col("session").alias("s"), "ahead")
    rows = parts.withColumn("n", F.row_number().over(Window.partitionBy("__pid", "session").orderBy("ts", "event_id")).cast("long") - 1)
    rows = rows.join(F.broadcast(carried), (F.col("__pid") == F.col("p")) & F.col("session").eqNullSafe(F.col("s")), "left")
    return (rows.withColumn("n", F.col("n") + F.coalesce("ahead", F.lit(0))).drop("p", "s", "ahead", "__pid"),
            counts.groupBy("session").agg(F.sum("points").alias("points")))


# Roles of a row in its group: a point to be judged, one before them, the least and the greatest numbers of the session's first points.
OWN, BEFORE, LEAST, GREATEST = range(4)


def as_batch(pts: DataFrame, kind: Turning) -> DataFrame:
    """The same of a table of wide points; stretches of ``GROUP`` points, or a turn, and the ``back`` before them bound what a task holds of a
    session."""
    if kind.turn < kind.back:
        raise ValueError("a turn is at least as long as what it looks back on")
    size = max(1, GROUP // kind.turn) * kind.turn
    rows, sessions = numbered(pts)
    rows = rows.select("session", "event_id", F.unix_micros("ts").alias("t"), "x", "n", F.floor(F.col("n") / size).cast("long").alias("group"), F.lit(OWN).alias("role"))
    halo = rows.filter(F.pmod(F.col("n"), F.lit(size)) >= size - kind.back).withColumn("group", F.col("group") + 1).withColumn("role", F.lit(BEFORE))
    ends = rows.filter(F.col("n") < kind.back).select("session", F.posexplode("x").alias("i", "v")).groupBy("session", "i").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    ends = ends.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("ends"))
    # They go to each group of the session by a join of rows per group.
    groups = sessions.select(F.col("session").alias("of"), F.explode(F.sequence(F.lit(0), F.floor((F.col("points") - 1) / size).cast("long"))).alias("group"))
    both = F.explode(F.array(F.struct(F.col("ends.low").alias("x"), F.lit(LEAST).alias("role")), F.struct(F.col("ends.high").alias("x"), F.lit(GREATEST).alias("role"))))
    ends = groups.join(ends, F.col("session").eqNullSafe(F.col("of"))).select("session", "group", both.alias("end"))
    none = F.lit(None).cast("long")
    ends = ends.select("session", none.alias("event_id"), none.alias("t"), "end.x", none.alias("n"), "group", "end.role")

    def judge(group: pa.Table) -> pa.Table:
        role, x = group["role"].to_numpy(), flat(group["x"])
        place = group["n"].fill_null(-1).to_numpy()
        points = np.nonzero(role <= BEFORE)[0]
        points = points[place[points].argsort(kind="stable")]
        own = points[role[points] == OWN]
        if not len(own):
            return pa.table({c: group[c][:0] for c in ("session", "event_id", "t", "x")} | {"score": pa.array([], pa.float64()), "is_anomaly": pa.array([], pa.bool_())})
        ends = np.stack([x[role == LEAST][0], x[role == GREATEST][0]])
        scores, hits = judged(kind, [Stretch(int(place[points[0]]), int(place[own[0]]), ends, x[points])])[0]
        out = group.select(["session", "event_id", "t", "x"]).take(pa.array(own))
        return out.append_column("score", pa.array(scores)).append_column("is_anomaly", pa.array(hits))

    dealt = rows.unionByName(halo).unionByName(ends).repartition(int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "session", "group")
    return told(dealt.groupBy("session", "group").applyInArrow(judge, JUDGED))


#: Trees that take their steps together.
LANES = 4_096


def usual(x: np.ndarray) -> bool:
    """Finite numbers whose differences are finite as well."""
    return bool((np.abs(x) < 1e150).all())


# -- windowed isolation forest -------------------------------------------------
@dataclass
class Forest:
    """Trees of one window, and the score that a share of its own points exceeds."""

    trees: list[np.ndarray]
    norm: float
    cut: float = math.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), dtype=int)
            while (inner := tree[at, 0] >= 0).any():
                feature = np.maximum(tree[at, 0].astype(int), 0)
                left = x[np.arange(len(x)), feature] <= tree[at, 1]
                at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(int), at)
            total += tree[at, 4]
        return np.power(2.0, -(total / len(self.trees)) / self.norm)

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.scores(x)
        return s, s > self.cut


def windowed_forest(window: int = 256, contamination: float = 0.1, trees: int = 50, seed: int = 42) -> Turning:
    """An isolation forest of the last full window judges the next; a point is an anomaly when its score exceeds that of all but
    the given share of the window."""
    def start(turn: int, before: np.ndarray, ends: Any) -> Forest:
        sample = min(256, len(before))
        limit = math.ceil(math.log2(max(sample, 2)))
        fitted = []
        for k in range(trees):
            rng = np.random.default_rng([seed, turn, k])
            fitted.append(np.array(grow(before[rng.permutation(len(before))[:sample]], rng, limit)))
        forest = Forest(fitted, average_path(sample) or 1.0)
        forest.cut = float(np.quantile(forest.scores(before), 1 - contamination))
        return forest

    def together(turns: Sequence[Turn]) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list[Any] = [None] * len(turns)
        fit = [k for k, t in enumerate(turns) if 0 < len(t.before) == window <= lanes.MOST and usual(t.before)]
        limit, paths, norm, some = math.ceil(math.log2(max(window, 2))), [average_path(n) for n in range(window + 1)], average_path(window) or 1.0, max(1, LANES // trees)
        for at in range(0, len(fit), some):
            part = [turns[k] for k in fit[at:at + some]]
            rngs = [np.random.default_rng([seed, t.number, k]) for t in part for k in range(trees)]
            for rng in rngs:
                rng.permutation(window)  # a window of at most 256 points is its own sample; the order of points does not matter
            forest = lanes.IsolationLanes(np.stack([t.before for t in part]), rngs, limit, paths)
            of, sizes = np.arange(len(part)), [len(t.x) for t in part]
            known, new = (np.power(2.0, -(forest.totals(x, of.repeat(n)) / trees) / norm)
                          for x, n in ((np.concatenate([t.before for t in part]), window), (np.concatenate([t.x for t in part]), sizes)))
            cuts = np.quantile(known.reshape(-1, window), 1 - contamination, axis=1)
            for k, s, cut in zip(fit[at:at + some], np.split(new, np.cumsum(sizes)[:-1]), cuts, strict=True):
                out[k] = s, s > cut
        return [start(t.number, t.before, t.ends).judge(t.x) if o is None else o for t, o in zip(turns, out, strict=True)]

    return Turning(window, window, start, together=together)


# -- half-space trees --------------------------------------------------------
@dataclass
class HalfSpaces:
    """Random trees that halve a work range; nodes hold the mass of the window before. The masses of the points judged are counted as well:
    they are what the next window is judged by."""

    feature: np.ndarray  # (trees, inner nodes)
    split: np.ndarray
    low: np.ndarray
    span: np.ndarray
    mass: np.ndarray  # (trees, nodes) of the reference window
    latest: np.ndarray
    window: int
    threshold: float

    def walk(self, x: np.ndarray) -> np.ndarray:
        """(tree, level, point): the nodes that points pass."""
        unit = (x - self.low) / self.span
        trees, inner = self.feature.shape
        at = np.zeros((trees, len(x)), dtype=int)
        out = [at]
        for _ in range(int(math.log2(inner + 1))):
            f = np.take_along_axis(self.feature, at, 1)
            right = unit[np.arange(len(x))[None], f] >= np.take_along_axis(self.split, at, 1)
            at = 2 * at + 1 + right
            out.append(at)
        return np.stack(out, axis=1)

    def count(self, x: np.ndarray) -> np.ndarray:
        mass = np.zeros_like(self.mass)
        for tree, nodes in enumerate(self.walk(x)):
            mass[tree] += np.bincount(nodes.ravel(), minlength=mass.shape[1])
        return mass

    def scores(self, x: np.ndarray) -> np.ndarray:
        """1 / (1 + density against an even spread), where a tree stops at the first node of few points."""
        nodes = self.walk(x)
        mass = np.take_along_axis(self.mass[:, None, :].repeat(nodes.shape[1], 1), nodes, 2)
        few = mass <= 0.1 * self.window
        few[:, -1] = True
        level = few.argmax(1)
        end = np.take_along_axis(mass, level[:, None], 1)[:, 0]
        return 1 / (1 + (end * 2.0 ** level).mean(0) / self.window)

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.scores(x)
        self.latest += self.count(x)
        return s, s > self.threshold


@lru_cache(maxsize=8)
def planted(seed: int, trees: int, depth: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and places of the cuts of trees over ``d`` numbers, the same at every turn."""
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    feature, split = rng.integers(0, d, (trees, inner)), np.zeros((trees, inner))
    for t in range(trees):
        centre = rng.random(d)
        reach = 2 * np.maximum(centre, 1 - centre)
        box = {0: (centre - reach, centre + reach)}
        for node in range(inner):
            low, high = box.pop(node)
            f = feature[t, node]
            split[t, node] = (low[f] + high[f]) / 2
            left, right = high.copy(), low.copy()
            left[f] = right[f] = split[t, node]
            box[2 * node + 1], box[2 * node + 2] = (low, left), (right, high)
    return feature, split


def half_space_trees(window: int = 256, threshold: float = 0.95, trees: int = 25, depth: int = 8, seed: int = 42) -> Turning:
    """Half-space trees by Tan, Ting and Liu: fixed random trees over a work range around the first window's; the mass of the last window
    judges the next."""
    def scale(ends: np.ndarray) -> np.ndarray:
        return np.where(ends[1] > ends[0], ends[1] - ends[0], 1.0)

    def start(turn: int, before: np.ndarray, ends: np.ndarray) -> HalfSpaces:
        feature, split = planted(seed, trees, depth, before.shape[1])
        empty = np.zeros((trees, 2 * feature.shape[1] + 1), dtype=np.int64)
        out = HalfSpaces(feature, split, ends[0], scale(ends), empty, empty.copy(), window, threshold)
        out.mass = out.count(before)
        return out

    def together(turns: Sequence[Turn]) -> list[tuple[np.ndarray, np.ndarray]]:
        out, some = [], max(1, 4_096 // window)
        for at in range(0, len(turns), some):
            part = turns[at:at + some]
            feature, split = planted(seed, trees, depth, part[0].x.shape[1])
            unit = lambda xs: np.concatenate([(x - t.ends[0]) / scale(t.ends) for t, x in zip(part, xs, strict=True)])
            scores = lanes.mass_scores(feature, split, depth, unit([t.before for t in part]), [len(t.before) for t in part], unit([t.x for t in part]),
                                       [len(t.x) for t in part], window)
            out += [(s, s > threshold) for s in scores]
        return out

    return Turning(window, window, start, together=together)


# -- robust random cut forest -----------------------------------------------------
class Node:
    """A box of points: a leaf holds copies of one point, an inner node cuts its box along one number. Points are lists: for the few
    numbers of one, plain arithmetic takes a tenth of the time of arrays."""

    __slots__ = ("up", "left", "right", "axis", "cut", "low", "high", "n")

    def __init__(self, point: Sequence[float], up: Node | None = None):
        self.up, self.left, self.right, self.axis, self.cut = up, None, None, -1, 0.0
        self.low = self.high = point
        self.n = 1


class CutTree:
    """A random cut tree over the points of a window, by Guha, Mishra, Roy and Schrijvers: points come and go."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.root, self.leaves = rng, None, {}

    def insert(self, name: int, point: Sequence[float]) -> None:
        if self.root is None:
            self.root = self.leaves[name] = Node(point)
            return
        node, random = self.root, self.rng.random
        while True:
            low = [p if p < a else a for p, a in zip(point, node.low)]
            high = [p if p > b else b for p, b in zip(point, node.high)]
            sides = [b - a for a, b in zip(low, high)]
            total = sum(sides)
            if total == 0:  # a copy of this leaf's point
                self.leaves[name] = node
                node.n += 1
                return
            drawn, ahead = random() * total, 0.0
            for axis, side in enumerate(sides):
                ahead += side
                if ahead > drawn:
                    break
            cut = min(max(low[axis] + drawn - (ahead - side), low[axis]), math.nextafter(high[axis], -math.inf))
            if cut >= node.high[axis] or cut < node.low[axis]:  # parts the point from the box
                break
            node.low, node.high = low, high
            node.n += 1
            node = node.left if point[node.axis] <= node.cut else node.right
        leaf, above = Node(point), Node(point, node.up)
        above.axis, above.cut, above.low, above.high, above.n = axis, cut, low, high, node.n + 1
        above.left, above.right = (leaf, node) if point[axis] <= cut else (node, leaf)
        if node.up is None:
            self.root = above
        elif node.up.left is node:
            node.up.left = above
        else:
            node.up.right = above
        node.up = leaf.up = above
        self.leaves[name] = leaf

    def removed(self, node: Node | None, point: Sequence[float]) -> None:
        """Sizes and boxes from a changed node up, when a copy of ``point`` has gone; a box changes only where the point was on its edge."""
        edge = True
        while node is not None:
            node.n -= 1
            if edge and node.left is not None:
                edge = any(p == a or p == b for p, a, b in zip(point, node.low, node.high))
                if edge:
                    left, right = node.left, node.right
                    node.low = [a if a < b else b for a, b in zip(left.low, right.low)]
                    node.high = [a if a > b else b for a, b in zip(left.high, right.high)]
            node = node.up

    def delete(self, name: int) -> None:
        leaf = self.leaves.pop(name)
        if leaf.n > 1:
            while leaf is not None:
                leaf.n -= 1
                leaf = leaf.up
            return
        above = leaf.up
        if above is None:
            self.root = None
            return
        other = above.right if above.left is leaf else above.left
        other.up = above.up
        if above.up is None:
            self.root = other
            return
        if above.up.left is above:
            above.up.left = other
        else:
            above.up.right = other
        self.removed(above.up, leaf.low)

    def __getstate__(self) -> tuple:
        """Nodes as a flat list, as a deep tree would be too deep to be stored as it is."""
        order, todo = [], [self.root] if self.root else []
        while todo:
            order.append(todo.pop())
            todo += [x for x in (order[-1].left, order[-1].right) if x is not None]
        at = {id(node): k for k, node in enumerate(order)}
        flat = [(at.get(id(x.up)), at.get(id(x.left)), at.get(id(x.right)), x.axis, x.cut, x.low, x.high, x.n) for x in order]
        return self.rng, flat, {name: at[id(leaf)] for name, leaf in self.leaves.items()}

    def __setstate__(self, state: tuple) -> None:
        self.rng, flat, leaves = state
        nodes = [Node(f[5]) for f in flat]
        for node, (up, left, right, node.axis, node.cut, node.low, node.high, node.n) in zip(nodes, flat, strict=True):
            node.up, node.left, node.right = (None if k is None else nodes[k] for k in (up, left, right))
        self.root = nodes[0] if nodes else None
        self.leaves = {name: nodes[k] for name, k in leaves.items()}

    def displacement(self, name: int) -> float:
        """How many points at most, for each that is taken out with it, move up when this one goes."""
        node, most = self.leaves[name], 0.0
        while (up := node.up) is not None:
            share = (up.n - node.n) / node.n
            if share > most:
                most = share
            node = up
        return most


class CutForest:
    """Cut trees over the last ``window`` points."""

    def __init__(self, before: np.ndarray, window: int, trees: int, threshold: float, seed: Sequence[int]):
        self.window, self.threshold, self.n = window, threshold, 0
        self.trees = [CutTree(np.random.default_rng([*seed, k])) for k in range(trees)]
        for point in before.tolist():
            self.add(point)

    def add(self, point: list[float]) -> None:
        for tree in self.trees:
            if self.n >= self.window:
                tree.delete(self.n - self.window)
            tree.insert(self.n, point)
        self.n += 1

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = np.zeros(len(x))
        for i, point in enumerate(x.tolist()):
            self.add(point)
            scores[i] = float(np.mean([tree.displacement(self.n - 1) for tree in self.trees]))
        full = np.arange(self.n - len(x), self.n) >= self.window - 1
        return scores, (scores > self.threshold * self.window) & full


def robust_random_cut_forest(window: int = 128, threshold: float = 0.25, trees: int = 20, turn: int | None = None, seed: int = 42) -> Turning:
    """Mean collusive displacement of each point in trees over the last ``window`` points, a point being an anomaly above the share
    ``threshold`` of them. Trees are planted anew every ``turn`` points (default four windows) from the window before."""
    def start(number: int, before: np.ndarray, ends: Any) -> CutForest:
        return CutForest(before[-(window - 1):], window, trees, threshold, (seed, number))

    def together(turns: Sequence[Turn]) -> list[tuple[np.ndarray, np.ndarray]]:
        # A step in arrays costs as much as about 60 trees do; numbers near the greatest would overflow.
        plain = [k for k, t in enumerate(turns) if len(turns) * trees < 60 or window < 2 or not usual(t.before) or not usual(t.x)]
        out: list[Any] = [None] * len(turns)
        for k in plain:
            out[k] = start(turns[k].number, turns[k].before, None).judge(turns[k].x)
        rest, some = [k for k in range(len(turns)) if out[k] is None], max(1, LANES // trees)
        for at in range(0, len(rest), some):
            part = [turns[k] for k in rest[at:at + some]]
            known = [t.before[-(window - 1):] for t in part]
            scores = lanes.displacements([(np.concatenate([b, t.x]), len(b)) for b, t in zip(known, part, strict=True)], window, trees, [(seed, t.number) for t in part])
            for k, b, s in zip(rest[at:at + some], known, scores, strict=True):
                out[k] = s, (s > threshold * window) & (np.arange(len(b), len(b) + len(s)) >= window - 1)
        return out

    return Turning(turn or 4 * window, window, start, True, together)


def rolling_columns(df: DataFrame, session: str, ts: str, event_id: str, values: Sequence[str], window: int = 100, threshold: float = 3.0) -> DataFrame:
    """(session, event_id, ts, score, is_anomaly, anomaly_columns, details): the rolling z-score of several columns at once. The
    score is the greatest of them; ``details`` gives value and score of each column. A missing value is left out of its column."""
    from plumbline.streaming.detectors import rolling_zscore
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in values])).alias("p")
    long = df.select(F.col(session).cast("string").alias("s"), F.col(ts).cast("timestamp").alias("ts"), F.col(event_id).cast("long").alias("event_id"), pairs)
    long = long.select(F.to_json(F.struct("s", "p.column")).alias("session"), "ts", "event_id", "p.value").filter("value is not null and not isnan(value)")
    judged = rolling_zscore(long, window, threshold).withColumn("of", F.from_json("session", "s string, column string"))
    hit = F.when(F.col("is_anomaly"), F.col("of.column"))
    return (judged.groupBy(F.col("of.s").alias("session"), "event_id", "ts")
            .agg(F.max("score").alias("score"), F.max("is_anomaly").alias("is_anomaly"), F.array_sort(F.collect_list(hit)).alias("anomaly_columns"),
                 F.map_from_entries(F.collect_list(F.struct("of.column", F.struct("value", "score")))).alias("details")))
