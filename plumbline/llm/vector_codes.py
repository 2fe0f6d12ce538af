"""Vector codes: every vector becomes one small number per part, the nearest entry of that part's codebook.

Vectors are whole numbers here (``floor(1024 x)``), so distances, sums and codebooks are exact and do not depend on how the
rows are spread. A codebook starts from the vectors of the smallest ids and is moved to the means of its parts a few times.
Each round is one narrow pass whose tasks send a sum and a count per entry, so that the driver sees the size of the
codebooks whatever the number of vectors.

The nearest entry of a part is found through memoised grid cells. A part's coarse cell is hashed; for a cell seen for the first time
the entries are kept that some point of its box may have as its nearest. The difference of two squared distances is linear,
so its least value over the box is known: an entry is dominated when even that is above zero against the entry nearest to
the centre. Only what is left is evaluated exactly, for each part of the cell; ties go to the lower index. A hash that stands for two cells is
told by the cell itself.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; a null id is coded like
any other but starts no codebook; rows of one id start it with their least vector; repeated rows count as often as they
come. The codebooks' length is that of the vector of the smallest id; vectors of another length keep a null code and error. If the length is no
multiple of the number of parts, the first parts get one component more. Fewer ids than entries give a smaller codebook.
Whole numbers beyond 2 ** 62 are held there, errors at the largest long.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.base import Scratch, spans_index

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: A grid cell is ``1 << CELL_BITS`` whole numbers wide.
CELL_BITS = 6
#: Cells that a task remembers of each part.
MEMO_CELLS = 20_000
#: Vectors worked on together, and pairs of a vector and an entry evaluated together.
BLOCK_ROWS, BLOCK_PAIRS = 2_048, 200_000
LARGEST, HELD = (1 << 63) - 1, 1 << 62
MULTIPLIER = 0x9E3779B97F4A7C15
#: The length of codebooks without entries; no vector has it.
NO_LENGTH = -2


@dataclass
class Codebooks:
    """``books[p]`` holds the entries of part ``p``, a row each. ``length`` is that of the vectors."""

    length: int
    books: list[np.ndarray]

    def cuts(self) -> list[slice]:
        return cuts_of(max(self.length, 0), len(self.books))

    def digest(self) -> str:
        """All components as decimal whole numbers by part, entry and position, joined by commas."""
        return sha256(",".join(str(int(x)) for book in self.books for x in book.reshape(-1)).encode()).hexdigest()


def cuts_of(length: int, parts: int = PARTS) -> list[slice]:
    ends = np.cumsum([0] + [length // parts + (k < length % parts) for k in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def whole(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``, exact as the scale is a power of two."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * SCALE), -HELD, HELD).astype(np.int64)


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: the flat components (null as NaN), every row's first component and its length, -1 where the row is dropped."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)
    flat = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), float("nan")), dtype=np.float64)
    real = np.maximum(lengths, 0)
    starts = np.cumsum(real) - real
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    return flat, starts, np.where(bad[starts + real] > bad[starts], -1, lengths)


def blocks(batch: pa.RecordBatch, vector: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole-number vectors) of the vectors of a length, some at a time."""
    flat, starts, lengths = usable(batch.column(batch.schema.get_field_index(vector)))
    rows = np.flatnonzero(lengths == length)
    for k in range(0, len(rows), BLOCK_ROWS):
        some = rows[k:k + BLOCK_ROWS]
        yield some, whole(flat[starts[some][:, None] + np.arange(length)])


def seeds(vectors: DataFrame, vector: str, key: str, entries: int = ENTRIES) -> list[list[float]]:
    """The vectors of the smallest ids, ascending; each task offers its own smallest ones."""
    slim = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            lengths = usable(batch.column(1))[2]
            batch = batch.filter(pc.and_(pa.array(lengths >= 0), pc.is_valid(batch.column(0))))
            offers = batch.take(pc.sort_indices(batch.column(0)))
            ids = offers.column(0)
            last = sorted(best)[-1] if len(best) == entries else None
            for k in range(offers.num_rows):
                i = ids[k].as_py()
                if (last is not None and i > last) or (len(best) >= 2 * entries and i not in best):
                    break
                v = offers.column(1)[k].as_py()
                best[i] = min(best.get(i, v), v)
            best = {i: best[i] for i in sorted(best)[:entries]}
        if schema is not None and best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), schema.field(0).type), pa.array(list(best.values()), schema.field(1).type)], schema=schema)

    least = slim.mapInArrow(run, slim.schema).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries)
    return [r.v for r in least.collect()]


class Nearest:
    """Nearest entries of one part's codebook, through the memo of its cells."""

    def __init__(self, book: np.ndarray, bits: int = CELL_BITS, cells: int = MEMO_CELLS):
        self.book, self.bits, self.limit = book, bits, cells
        self.width = book.shape[1]
        self.memo: OrderedDict[int, tuple[bytes, np.ndarray]] = OrderedDict()
        # Up to this size all distances, of centres too, are exact in double precision.
        self.exact = int((2.0 ** 50 / (4 * max(1, self.width))) ** 0.5) - (1 << bits)
        self.small = len(book) > 0 and int(abs(book).max(initial=0)) <= self.exact
        if self.small:
            wide = book.astype(np.float64)
            self.squares = (wide * wide).sum(1)
            self.apart = np.stack([abs(wide - e).sum(1) for e in wide])
        self.factors = np.array([pow(MULTIPLIER, k + 1, 1 << 64) for k in range(self.width)], dtype=np.uint64)

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """Per cell the indices, ascending, of the entries that may be nearest within its box."""
        half = ((1 << self.bits) - 1) / 2
        centre = (cells << self.bits) + half
        out = []
        for k in range(0, len(cells), 1024):
            c = centre[k:k + 1024]
            far = self.squares - 2 * (c @ self.book.T.astype(np.float64))  # less the centre's own square
            pivot = far.argmin(1)
            keep = far - far[np.arange(len(c)), pivot][:, None] <= 2 * half * self.apart[pivot]
            row, entry = np.nonzero(keep)
            out += np.split(entry.astype(np.int32), np.searchsorted(row, np.arange(1, len(c))))
        return out

    def candidates(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Lists of entries, and for each row of ``x`` the number of its list."""
        cells = x >> self.bits
        keys = (cells.astype(np.uint64) * self.factors).sum(1, dtype=np.uint64)
        keys ^= keys >> np.uint64(32)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        other = np.flatnonzero((cells != cells[first][which]).any(1))  # another cell of the same hash
        lists: list = [None] * len(first)
        named = [(int(keys[i]), cells[i].tobytes()) for i in first]
        missing = []
        for n, (key, cell) in enumerate(named):
            held = self.memo.get(key)
            if held is not None and held[0] == cell:
                lists[n] = held[1]
                self.memo.move_to_end(key)
            else:
                missing.append(n)
        if missing:
            for n, entries in zip(missing, self.undominated(cells[first[missing]]), strict=True):
                lists[n] = entries
                self.memo[named[n][0]] = (named[n][1], entries)
            while len(self.memo) > self.limit:
                self.memo.popitem(last=False)
        if len(other):
            which[other] = len(lists)
            lists.append(np.arange(len(self.book), dtype=np.int32))
        return lists, which

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of every row."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        small = (abs(x) <= self.exact).all(1) if self.small else np.zeros(len(x), bool)
        for i in np.flatnonzero(~small):
            far = [sum((a - b) ** 2 for a, b in zip(x[i].tolist(), e, strict=True)) for e in self.book.tolist()]
            index[i] = min(range(len(far)), key=far.__getitem__)
            distance[i] = far[index[i]]
        rows = np.flatnonzero(small)
        if not len(rows):
            return index, distance
        lists, which = self.candidates(x[rows])
        sizes = np.array([len(e) for e in lists])
        flat, at = np.concatenate(lists), np.cumsum(sizes) - sizes
        lengths = sizes[which]
        group = np.cumsum(lengths) // BLOCK_PAIRS
        for g in np.unique(group):
            some = np.flatnonzero(group == g)
            n = lengths[some]
            entry = flat[spans_index(at[which[some]], n)]
            far = np.square(np.repeat(x[rows[some]], n, axis=0) - self.book[entry]).sum(1)
            starts = np.cumsum(n) - n
            least = np.minimum.reduceat(far, starts)
            hits = np.flatnonzero(far == np.repeat(least, n))
            index[rows[some]] = entry[hits[np.searchsorted(hits, starts)]]
            distance[rows[some]] = least
        return index, distance


def moved(vectors: DataFrame, vector: str, codebooks: Codebooks, bits: int = CELL_BITS) -> Codebooks:
    """Codebooks whose entries are the floored means of the parts nearest to them; an entry without parts stays."""
    slim = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("position", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("total", T.DecimalType(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = codebooks.cuts()
        nearest = [Nearest(b, bits) for b in codebooks.books]
        totals = [np.zeros(b.shape, object) for b in codebooks.books]
        counts = [np.zeros(len(b), np.int64) for b in codebooks.books]
        for batch in batches:
            for _, x in blocks(batch, "v", codebooks.length):
                for p, cut in enumerate(cuts):
                    entry = nearest[p](x[:, cut])[0]
                    counts[p] += np.bincount(entry, minlength=len(counts[p]))
                    order = np.argsort(entry, kind="stable")
                    used, starts = np.unique(entry[order], return_index=True)
                    part = x[order][:, cut]
                    if abs(part).max(initial=0) > 1 << 50:
                        part = part.astype(object)
                    totals[p][used] += np.add.reduceat(part, starts, axis=0).astype(object)
        rows = [(p, int(e), k, int(counts[p][e]), Decimal(int(totals[p][e, k])))
                for p in range(len(cuts)) for e in np.flatnonzero(counts[p]) for k in range(totals[p].shape[1])]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

    books = [b.copy() for b in codebooks.books]
    sums = slim.mapInArrow(run, schema).groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in sums.collect():  # a row per component of the codebooks
        books[r.part][r.entry, r.position] = int(r.total) // r.n
    return Codebooks(codebooks.length, books)


def learn(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = CELL_BITS) -> Codebooks:
    """Codebooks of all vectors after the given number of rounds. Each round reads the vectors once and shuffles sums only."""
    first = seeds(vectors, vector, key, entries)
    length = len(first[0]) if first else NO_LENGTH
    same = [v for v in first if len(v) == length]
    start = whole(np.array(same, dtype=np.float64).reshape(len(same), max(length, 0)))
    books = Codebooks(length, [start[:, c].copy() for c in cuts_of(max(length, 0), parts)])
    for _ in range(rounds if first else 0):
        books = moved(vectors, vector, books, bits)
    return books


def encode(vectors: DataFrame, codebooks: Codebooks, vector: str = "embedding", code: str = "code", error: str = "error", keep: list[str] | None = None, bits: int = CELL_BITS) -> DataFrame:
    """The rows whose vector is usable, with ``code`` (two hex digits a part, four beyond 256 entries) and ``error`` (squared
    distance to the coded vector); the columns ``keep`` pass through (default: all, the vector included)."""
    vectors = vectors.drop(code, error)
    kept = [c for c in vectors.columns if keep is None or c in keep]
    name = "__vector"
    while name in kept:
        name += "_"
    slim = vectors.select(*[F.col(f"`{c}`") for c in kept], F.col(vector).cast("array<double>").alias(name))
    schema = slim.drop(name).schema.add(code, "string").add(error, "long")
    digits = 2 if all(len(b) <= 256 for b in codebooks.books) else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = [Nearest(b, bits) for b in codebooks.books]
        for batch in batches:
            codes, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            for rows, x in blocks(batch, name, codebooks.length):
                told = [near(x[:, cut]) for near, cut in zip(nearest, codebooks.cuts(), strict=True)]
                errors[rows] = np.minimum(sum(d for _, d in told), LARGEST)
                codes[rows] = ["".join(f"{i:0{digits}x}" for i in row) for row in zip(*[i.tolist() for i, _ in told], strict=True)]
            good = usable(batch.column(batch.schema.get_field_index(name)))[2] >= 0
            out = pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], [*kept, code, error])
            yield out.filter(pa.array(good))

    return slim.mapInArrow(run, schema)


def decode(codes: DataFrame, codebooks: Codebooks, code: str = "code", vector: str = "decoded") -> DataFrame:
    """``codes`` with the vector that each code stands for (the middle of its whole numbers' range), null for a null code."""
    codes = codes.drop(vector)
    schema = codes.select("*").schema.add(vector, T.ArrayType(T.DoubleType()))
    digits = 2 if all(len(b) <= 256 for b in codebooks.books) else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [((b.astype(np.float64) + 0.5) / SCALE).tolist() for b in codebooks.books]
        for batch in batches:
            lists = [None if c is None else [x for p, b in enumerate(books) for x in b[int(c[p * digits:(p + 1) * digits], 16)]]
                     for c in batch.column(batch.schema.get_field_index(code)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.float64()))], [*batch.schema.names, vector])

    return codes.mapInArrow(run, schema)


def report(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row. The coded rows are written once; errors are added
    up per label before they are joined, so a hot label travels as one row a task."""
    books = learn(vectors, vector, key)
    coded = Scratch(vectors.sparkSession).keep(
        encode(vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("embedding")), books, keep=["vec_id", "label"]))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(total, F.lit(LARGEST)).cast("long").alias("label_error"))
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
            .select(F.col("vec_id").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")))
