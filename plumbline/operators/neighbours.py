"""Exact k nearest neighbours of distinct points, without quadratic joins.

Space is cut into cells of bounded row count along sample-free medians. Each
cell answers its own points, which bounds the radius still to be searched;
a point then visits only the cells its ball touches. Copies of a point are
one row with a weight, so a place that holds a third of the table is one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import checkpointed

CELL_ROWS = 3000
FAN = 8
BROADCAST_CELLS = 20_000


def cut_into_cells(points: DataFrame, dims: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add ``cell`` so that no cell holds more than ``cell_rows`` points.

    Each round splits every too large cell along its widest dimension at
    approximate quantiles; distinct points always differ somewhere, so every
    round makes progress.
    """
    x = [F.col("x")[i] for i in range(dims)]
    state = checkpointed(points.withColumn("cell", F.lit("r")))
    while True:
        sizes = state.groupBy("cell").agg(F.count(F.lit(1)).alias("n"),
                                          *[(F.max(c) - F.min(c)).alias(f"w{i}") for i, c in enumerate(x)])
        big = sizes.filter(F.col("n") > cell_rows)
        widest = F.array(*[F.col(f"w{i}") for i in range(dims)])
        big = checkpointed(big.select("cell", (F.array_position(widest, F.array_max(widest)) - 1).cast("int").alias("dim")))
        if big.isEmpty():
            return state
        # The list of cells still too large is small next to the points.
        marked = state.join(big, "cell", "left").withColumn("v", F.get(F.col("x"), F.col("dim")))
        qs = [i / FAN for i in range(1, FAN)]
        cuts = (marked.filter(F.col("dim").isNotNull()).groupBy("cell")
                .agg(F.percentile_approx("v", qs, 1000).alias("cuts")))
        # A value up to a cut lies left of it. A value at which several cuts fall holds a large share of the cell and
        # becomes a cell of its own; so no cell has few points, and every round still parts the least from the greatest.
        child = (F.size(F.filter("cuts", lambda c: c < F.col("v"))) * 2
                 + F.when(F.size(F.filter("cuts", lambda c: c == F.col("v"))) > 1, 1).otherwise(0))
        state = checkpointed(
            marked.join(cuts, "cell", "left")
            .withColumn("cell", F.when(F.col("dim").isNotNull(), F.concat("cell", F.lit("."), child.cast("string")))
                        .otherwise(F.col("cell")))
            .select(*points.columns, "cell"))


def nearest_in(ids: np.ndarray, x: np.ndarray, w: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int,
               radius: np.ndarray, skip_self: bool) -> pd.DataFrame:
    """Per query the closest rows until k copies are covered, within radius."""
    held = w > 0
    ids, x, w = ids[held], x[held], w[held]
    out = []
    for a in range(0, len(q) if len(x) else 0, 512):
        part, pid = q[a:a + 512], qid[a:a + 512]
        d2 = np.maximum(((part[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0.0)
        if skip_self:
            d2[pid[:, None] == ids[None, :]] = np.inf
        m = min(k, x.shape[0])
        best = np.argpartition(d2, m - 1, axis=1)[:, :m]
        d = np.sqrt(np.take_along_axis(d2, best, 1))
        rows, cols = np.nonzero((d <= radius[a:a + 512, None]) & np.isfinite(d))
        hit = best[rows, cols]
        out.append(pd.DataFrame({"id": pid[rows], "other": ids[hit], "d": d[rows, cols], "w": w[hit]}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "d": [], "w": []})


NEIGHBOUR = "id long, other long, d double, w long"


def knn(points: DataFrame, dims: int, k: int, max_radius: float = float("inf"),
        cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, other, d, w): for every point its nearest other points, as many
    as cover ``k`` copies (its own further copies included, as ``other`` =
    ``id`` at distance 0), none beyond ``max_radius``.

    ``points``: id long, x array<double>, w long (copies); ids are unique.
    Points of weight 0 ask for neighbours but are none themselves.
    """
    cells = checkpointed(cut_into_cells(points, dims, cell_rows))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["id"].to_numpy(), np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
        return nearest_in(ids, x, pdf["w"].to_numpy(), ids, x, k, np.full(len(pdf), max_radius), True)

    inside = cells.groupBy("cell").applyInPandas(local, NEIGHBOUR)
    own = cells.filter(F.col("w") > 1).select("id", F.col("id").alias("other"), F.lit(0.0).alias("d"),
                                              (F.col("w") - 1).alias("w"))
    first = checkpointed(covered(inside.unionByName(own), k))
    radius = first.groupBy("id").agg(F.sum("w").alias("got"), F.max("d").alias("r"))
    queries = cells.join(radius, "id", "left").select(
        "id", "x", "cell", F.when(F.coalesce("got", F.lit(0)) >= k, F.col("r")).otherwise(F.lit(max_radius)).alias("r"))
    boxes = cells.filter("w > 0").groupBy("cell").agg(
        F.array(*[F.min(F.col("x")[i]) for i in range(dims)]).alias("lo"),
        F.array(*[F.max(F.col("x")[i]) for i in range(dims)]).alias("hi"))
    visits = checkpointed(touched(queries, checkpointed(boxes)))
    # Spread the visitors of one cell over groups of at most about a cell's size.
    per_cell = visits.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("copies"))
    visitors = (visits.join(per_cell, "target")
                .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("copies")).cast("long")))
    hosts = (cells.join(per_cell, cells.cell == per_cell.target)
             .select("target", F.col("id").alias("hid"), F.col("x").alias("hx"), F.col("w").alias("hw"),
                     F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")))

    def visit(guests: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        if guests.empty or home.empty:
            return pd.DataFrame({"id": [], "other": [], "d": [], "w": []})
        x = np.array(home["hx"].tolist(), dtype=float).reshape(len(home), -1)
        q = np.array(guests["x"].tolist(), dtype=float).reshape(len(guests), -1)
        return nearest_in(home["hid"].to_numpy(), x, home["hw"].to_numpy(), guests["id"].to_numpy(), q, k,
                          guests["r"].to_numpy(), False)

    outside = (visitors.select("target", "salt", "id", "x", "r").groupBy("target", "salt")
               .cogroup(hosts.groupBy("target", "salt")).applyInPandas(visit, NEIGHBOUR))
    return covered(first.unionByName(outside), k)


def covered(found: DataFrame, k: int) -> DataFrame:
    """Keep the closest rows of each id until their copies reach k; the last
    one's weight is cut so that the sum is at most k."""
    w = Window.partitionBy("id").orderBy("d", "other")
    before = F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (found.withColumn("before", before).filter(F.col("before") < k)
            .select("id", "other", "d", F.least(F.col("w"), F.lit(k) - F.col("before")).cast("long").alias("w")))


def touched(queries: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, x, r, target): cells other than the own one within the radius.

    Few boxes travel to every task. More of them are first grouped into
    coarser boxes (the cell path cut short), and each query looks only inside
    the coarse boxes it touches.
    """
    def away(lo: Column, hi: Column) -> Column:
        gaps = F.transform(F.arrays_zip(F.col("x").alias("x"), lo.alias("lo"), hi.alias("hi")),
                           lambda z: F.greatest(z["lo"] - z["x"], z["x"] - z["hi"], F.lit(0.0)))
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g * g))

    def scan(q: DataFrame, table: DataFrame, name: str) -> DataFrame:
        rows = table.select(name, "lo", "hi").collect()
        names = np.array([r[0] for r in rows])
        lo, hi = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        shared = q.sparkSession.sparkContext.broadcast((names, lo, hi))

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def hits(x: pd.Series, r: pd.Series) -> pd.Series:
            names, lo, hi = shared.value
            out = []
            for p, reach in zip(x, r):
                p = np.asarray(p, dtype=float)
                gap = np.maximum(np.maximum(lo - p, p - hi), 0.0)
                out.append(list(names[np.sqrt((gap ** 2).sum(1)) <= reach]))
            return pd.Series(out)
        return q.withColumn("target", F.explode(hits("x", "r")))

    n = boxes.count()
    if n <= BROADCAST_CELLS:
        return scan(queries, boxes, "cell").filter("target != cell").select("id", "x", "r", "target")
    depth, coarse = 1, None
    while True:
        # Shorten the path until the table of coarse boxes is small enough.
        level = boxes.withColumn("top", F.substring_index("cell", ".", depth + 1))
        d = len(boxes.first()["lo"])
        grouped = level.groupBy("top").agg(F.array(*[F.min(F.col("lo")[i]) for i in range(d)]).alias("lo"),
                                           F.array(*[F.max(F.col("hi")[i]) for i in range(d)]).alias("hi"))
        if grouped.count() > BROADCAST_CELLS:
            break
        coarse, keyed, depth = grouped, level, depth + 1
    entered = scan(queries, coarse, "top").withColumnRenamed("target", "top")
    return (entered.join(keyed.select("top", F.col("cell").alias("target"), "lo", "hi"), "top")
            .filter((away(F.col("lo"), F.col("hi")) <= F.col("r")) & (F.col("target") != F.col("cell")))
            .select("id", "x", "r", "target"))
