"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. After a rotation that spreads their content evenly, they are
split into low-dimensional blocks; of two vectors within the whole distance at least one block lies within its share
of it. Each block is range-joined on a grid: a vector lives in the cell of its first coordinates and visits the cells
that its range touches. Every pair that meets is verified in double precision, in the first block that brings it
together, so it counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.components import components
from plumbline.session import checkpointed

COSINE = 0.98
BLOCKS = 8
#: Coordinates of a block that its grid uses.
GRID = 3
#: Vectors that live in one chunk of a cell. A fuller cell is cut into chunks, each of which sees all visitors as they
#: stream by.
CHUNK = 2_000
SEED = 20_240
#: Room for rounding: a candidate may be this much farther than its budget.
SLACK = 1e-7
OFFSET = 1 << 19


@lru_cache(maxsize=4)
def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + width).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def blocks_of(width: int, blocks: int) -> list[slice]:
    """Near-equal blocks, no more than there are coordinates."""
    cuts = np.linspace(0, width, min(blocks, width) + 1).round().astype(int)
    return [slice(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one. Scaled by their largest part first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def turned(unit: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; rounded, so that all tasks see the same numbers."""
    return np.round(unit @ rotation(unit.shape[1]), 10)


def matrix(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def placed(vectors: DataFrame, cosine: float, blocks: int, grid: int) -> DataFrame:
    """(label, width, block, cell, visit, id, copies, embedding): each vector at home (visit false) in one cell of every
    block, and as a visitor in those neighbouring cells that its range touches and that come after its own."""
    whole = 2 - 2 * cosine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                x = turned(units(matrix(part.column("embedding"), width)))
                for b, block in enumerate(blocks_of(width, blocks)):
                    reach = np.sqrt(whole * (block.stop - block.start) / width) + SLACK
                    y = x[:, block][:, :grid]
                    home = np.floor(y / (2 * reach)).astype(np.int64)
                    low, high = np.floor((y - reach) / (2 * reach)).astype(np.int64), np.floor((y + reach) / (2 * reach)).astype(np.int64)
                    for step in product((-1, 0, 1), repeat=y.shape[1]):
                        if step < (0,) * len(step):
                            continue  # that cell's vectors visit this one
                        cell = home + np.array(step)
                        rows = np.flatnonzero(((cell >= low) & (cell <= high)).all(axis=1))
                        if not len(rows):
                            continue
                        key = np.zeros(len(rows), np.int64)
                        for c in range(cell.shape[1]):
                            key = key * (2 * OFFSET) + cell[rows, c] + OFFSET
                        take = part.take(pa.array(rows))
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [take.column("label"), take.column("width"), pa.array(np.full(n, b, np.int32)), pa.array(key), pa.array(np.full(n, any(step))), take.column("id"), take.column("copies"), take.column("embedding")],
                            ["label", "width", "block", "cell", "visit", "id", "copies", "embedding"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("label", "width", "id", "copies", "embedding").mapInArrow(
        run, f"label {kinds['label']}, width int, block int, cell long, visit boolean, id long, copies long, embedding {kinds['embedding']}")


class Meeting:
    """The vectors at home in one chunk of a cell, and what they share with those that come by."""

    def __init__(self, width: int, block: int, cosine: float, blocks: int):
        self.width, self.block, self.cosine, self.slices = width, block, cosine, blocks_of(width, blocks)
        self.budgets = np.array([(2 - 2 * cosine) * (s.stop - s.start) / width for s in self.slices]) + SLACK
        self.starts = [s.start for s in self.slices]
        self.ids, self.copies = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.raw = self.turn = np.zeros((0, width))
        self.links: dict[int, int] = {}
        self.root: dict[int, int] = {}

    def top(self, i: int) -> int:
        path = []
        while (up := self.root.get(i, i)) != i:
            path.append(i)
            i = up
        for p in path:
            self.root[p] = i
        return i

    def meet(self, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, visit: bool, stay: bool) -> None:
        """Compare newcomers with those at home and, unless they visit, with each other. Those that ``stay`` are at home."""
        turn = turned(units(raw))
        if len(self.ids):
            self.compare(ids, copies, raw, turn, self.ids, self.copies, self.raw, self.turn, False)
        if not visit and stay:
            self.compare(ids, copies, raw, turn, ids, copies, raw, turn, True)
        if stay:
            self.ids, self.copies = np.concatenate([self.ids, ids]), np.concatenate([self.copies, copies])
            self.raw, self.turn = np.concatenate([self.raw, raw]), np.concatenate([self.turn, turn])

    def compare(self, ids_a, copies_a, raw_a, turn_a, ids_b, copies_b, raw_b, turn_b, own: bool) -> None:
        s = self.slices[self.block]
        a, b = turn_a[:, s], turn_b[:, s]
        apart = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
        i, j = np.nonzero(apart <= self.budgets[self.block] + SLACK)
        if own:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 50_000):
            p, q = i[at:at + 50_000], j[at:at + 50_000]
            parts = np.add.reduceat((turn_a[p] - turn_b[q]) ** 2, self.starts, axis=1) <= self.budgets
            first = parts.argmax(axis=1)
            keep = parts[np.arange(len(p)), self.block] & (first == self.block)
            p, q = p[keep], q[keep]
            u, v = raw_a[p], raw_b[q]
            linked = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u)) / np.sqrt(np.einsum("ij,ij->i", v, v)) >= self.cosine
            for x, y, cx, cy in zip(ids_a[p[linked]].tolist(), ids_b[q[linked]].tolist(), copies_a[p[linked]].tolist(), copies_b[q[linked]].tolist(), strict=True):
                self.links[x] = self.links.get(x, 0) + cy
                self.links[y] = self.links.get(y, 0) + cx
                x, y = self.top(x), self.top(y)
                if x != y:
                    self.root[max(x, y)] = min(x, y)

    def result(self) -> tuple[list[int], list[int], list[int]]:
        """Per linked vector: its links found here, and one vector that it is connected with."""
        ids = list(self.links)
        return ids, [self.links[i] for i in ids], [self.top(i) for i in ids]


def links(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid: int = GRID, chunk: int = CHUNK) -> DataFrame:
    """(id, n, other): links found in one place, and a vector of the same component. ``vectors``: label, width, id,
    copies, embedding; all embeddings different within a label and width."""
    rows = placed(vectors, cosine, blocks, grid)
    key = ["label", "width", "block", "cell"]
    # Full cells are cut by a hash; visitors, and those at home in an earlier chunk, come by in every later chunk.
    sizes = rows.filter("not visit").groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    at_home = F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int")
    # A cell where nobody is at home is dropped by the join: its visitors meet no one.
    rows = (rows.join(sizes, key)
            .withColumn("own", F.when(F.col("visit"), F.lit(-1)).otherwise(at_home))
            .withColumn("chunk", F.explode(F.when(F.col("visit"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.sequence("own", F.col("chunks") - 1))))
            .withColumn("visit", F.col("visit") | (F.col("own") != F.col("chunk"))).drop("own", "chunks"))
    key = [*key, "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, meeting = None, None

        def told(m: Meeting) -> pa.RecordBatch:
            ids, n, other = m.result()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(other, pa.int64())], ["id", "n", "other"])

        for batch in batches:
            names = [*key, "visit"]
            columns = [batch.column(k).to_pylist() for k in names]
            marks = list(zip(*columns, strict=True))
            start = 0
            while start < len(marks):
                stop = start + 1
                while stop < len(marks) and marks[stop] == marks[start]:
                    stop += 1
                *place, visit = marks[start]
                if place != now:
                    if meeting and meeting.links:
                        yield told(meeting)
                    now, meeting = place, Meeting(place[1], place[2], cosine, blocks)
                part = batch.slice(start, stop - start)
                meeting.meet(part.column("id").to_numpy(), part.column("copies").to_numpy(), matrix(part.column("embedding"), place[1]), visit, not visit)
                start = stop
        if meeting and meeting.links:
            yield told(meeting)

    met = rows.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, "visit").select(*key, "visit", "id", "copies", "embedding")
    return met.mapInArrow(run, "id long, n long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid: int = GRID, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine in double precision is at least ``cosine``.
    A vector that is null, empty, zero or holds a null or non-finite number links with nothing, nor do vectors of
    different widths. Equal vectors are one class: they are compared once, and all copies count as links. Repeated
    rows are copies. A row without an id links like any other; its component is that of the smallest id there is, null if there is
    none. Rows that share an id are in one component, and each counts the links of its own vector. An empty table gives an empty result.
    """
    plain = vectors.select("vec_id", "label", "embedding")
    usable = (F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    good = plain.filter(usable)
    different = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("width", F.size("embedding"))
    # Classes have numbers of their own: rows may lack an id, and different vectors may share one.
    classes = checkpointed(checkpointed(different).withColumn("id", F.monotonically_increasing_id()))
    found = checkpointed(links(classes.select("label", "width", "id", "copies", "embedding"), cosine, blocks, grid, chunk))
    direct = found.groupBy("id").agg(F.sum("n").alias("n"))
    # The same id under several vectors joins their components.
    shared = (good.filter("vec_id is not null").select("label", "embedding", "vec_id").distinct().join(classes.select("label", "embedding", "id"), ["label", "embedding"])
              .groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("most"), F.collect_set("id").alias("ids")).filter("a != most"))
    joined = shared.select("a", F.explode("ids").alias("b")).filter("a != b")
    linked_with = found.select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(joined)
    group = checkpointed(components(linked_with.select(F.explode(F.array("a", "b")).alias("id")).distinct(), linked_with))
    placed_in = classes.select("id", "least").join(group, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed_in.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = (classes.join(direct, "id", "left").join(placed_in.select("id", "component"), "id").join(least, "component")
                .select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    linked = good.join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = plain.filter(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
