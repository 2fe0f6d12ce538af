"""Fill-in-the-middle by secondary sort: documents become pieces, pieces become rearranged documents.

A narrow pass cuts every text into pieces of at most ``CHUNK`` code points, keyed by document and place in the output. One
exchange by document and a sort within its partitions put the pieces in output order, so that a task streams any document,
however long, through an incremental digest. The pieces are then sorted once more within the same partitions, now by their
place in the source, and the restored text is digested in the same way. Nothing larger than a batch of pieces is held.

Rows that agree in id and text are one stream with a count of copies and come out as often as they went in. A null text is
empty; a null id is hashed as the empty string. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.base import pieces, small_batches, text_or_empty

#: Code points of a piece; a batch of 512 pieces stays below some 30 MB.
CHUNK = 16_384
#: Bytes of text that go out in one batch.
OUT_BYTES = 1_000_000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Documents of a hundred that are rearranged, and those of a hundred rearranged ones that start with the suffix.
RATE, SPM_RATE = 90, 20
#: Sections in the order of the output, each with its marker.
ORDERS = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}
#: Place of a section in the source; ``END`` is the row that closes a document.
RANKS, END = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}, 3


def cut(doc_id, text: str, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, int, int]:
    """Form, end of the prefix and end of the middle of a text, all drawn from its id."""
    drawn = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or h3 % 100 >= rate or any(m in text for m in RANKS):
        return PLAIN, n, n
    return (SPM if h4 % 100 < spm_rate else PSM), a, b


def sections(text: str, form: str, a: int, b: int) -> list[tuple[str, str]]:
    """(marker, text) of the sections in output order; a plain text is one without a marker."""
    if form == PLAIN:
        return [("", text)]
    parts = {PREFIX: text[:a], MIDDLE: text[a:b], SUFFIX: text[b:]}
    return [(m, parts[m]) for m in ORDERS[form]]


def chunks(text: str, form: str, a: int, b: int, size: int) -> Iterator[tuple[int, str]]:
    """(place, piece) of the output. A marker opens the first piece of its section, so every piece but that of an empty text has characters."""
    place = 0
    for marker, part in sections(text, form, a, b):
        for k in range(0, max(1, len(part)), size):
            piece = (marker if k == 0 else "") + part[k:k + size]
            yield place, piece
            place += len(piece)


def restore(output: str, form: str) -> str:
    """The text that an output of the given form was made from."""
    if form == PLAIN:
        return output
    at = [output.index(m) for m in ORDERS[form]]
    parts = {m: output[i + len(m):j] for m, i, j in zip(ORDERS[form], at, [*at[1:], len(output)], strict=True)}
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


class Rows:
    """Rows gathered into batches of a schema, flushed when their texts reach ``OUT_BYTES``."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.load = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.load += size + 64
        if self.load >= OUT_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.load = [], 0


def arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def fim_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(stream, place, id, form, copies, piece): the outputs in pieces, in no order. ``stream`` is a digest of id and text.

    One narrow pass; equal rows of a batch travel once, with their number.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
    schema = T.StructType([T.StructField("stream", T.BinaryType()), T.StructField("place", T.LongType()), T.StructField("id", slim.schema["id"].dataType),
                           T.StructField("form", T.StringType()), T.StructField("copies", T.LongType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow(schema))
        for batch in pieces(batches):
            copies: dict[tuple, int] = {}
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                copies[row] = copies.get(row, 0) + 1
            for (i, body), n in copies.items():
                stream = blake2b(f"{'-' if i is None else '+'}{i}\0{body}".encode(), digest_size=16).digest()
                form, a, b = cut(i, body, rate, spm_rate)
                for place, piece in chunks(body, form, a, b, size):
                    yield from out.add((stream, place, i, form, n, piece), len(piece))
        yield from out.flush()

    return slim.mapInArrow(run, schema)


def in_order(df: DataFrame) -> DataFrame:
    """The pieces of a document in one partition, in output order: one exchange by a digest, so that no key is hot."""
    return df.repartition("stream").sortWithinPartitions("stream", "place")


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(whether a document starts, row) of sorted pieces. A piece that comes again, from a copy of its document, is left
    out; copies add up in the rows of place 0, which all come before the piece of place 0 is handed on."""
    held = None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held is not None and held[:2] == row[:2]:
                if row[1] == 0:
                    held = (*held[:4], held[4] + row[4], held[5])
                continue
            if held is not None:
                yield held[1] == 0, held
            held = row
    if held is not None:
        yield held[1] == 0, held


def fim_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(id, form, output) of every row of ``docs``: the whole rearranged text, put together from its sorted pieces."""
    ordered = in_order(fim_pieces(docs, key, text, size, rate, spm_rate))
    schema = T.StructType([ordered.schema["id"], ordered.schema["form"], T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parts, of = Rows(arrow(schema)), [], None

        def close() -> Iterator[pa.RecordBatch]:
            if of is not None:
                whole = "".join(parts)
                for _ in range(of[4]):
                    yield from out.add((of[2], of[3], whole), len(whole))

        for starts, row in documents(batches):
            if starts:
                yield from close()
                parts, of = [], row
            parts.append(row[5])
        yield from close()
        yield from out.flush()

    return ordered.mapInArrow(run, schema)


def with_digests(ordered: DataFrame) -> DataFrame:
    """Pieces without their markers, by (stream, rank, place) of the source, and per document a row of rank ``END`` with the
    digest of the output as its piece. Sections are told from the output alone: a rearranged text holds no marker of its own."""
    schema = T.StructType([ordered.schema["stream"], T.StructField("rank", T.IntegerType()), *ordered.schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, of, rank = Rows(arrow(schema)), None, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if of is not None:
                yield from out.add((of[0], END, 0, *of[2:5], digest.hexdigest()), 64)

        for starts, row in documents(batches):
            stream, place, i, form, copies, piece = row
            if starts:
                yield from close()
                digest, of, rank = sha256(), row, 0
            digest.update(piece.encode())
            if form != PLAIN and piece[:3] in RANKS:
                rank, piece = RANKS[piece[:3]], piece[3:]
            yield from out.add((stream, rank, place, i, form, copies, piece), len(piece))
        yield from close()
        yield from out.flush()

    return ordered.mapInArrow(run, schema)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of ``docs``.

    Lengths and the restored text are read back from the output: its sections are sorted into source order within the
    partition they are in, without another exchange.
    """
    back = with_digests(in_order(fim_pieces(docs, key, text, size))).sortWithinPartitions("stream", "rank", "place")
    schema = T.StructType([T.StructField(key, back.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, lengths = Rows(arrow(schema)), sha256(), [0, 0, 0]
        for batch in batches:
            for _, rank, _, i, form, copies, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rank < END:
                    digest.update(piece.encode())
                    lengths[rank] += len(piece)
                    continue
                told = (None, None) if form == PLAIN else lengths[:2]
                for _ in range(copies):
                    yield from out.add((i, sum(lengths), form, *told, piece, digest.hexdigest()), 160)
                digest, lengths = sha256(), [0, 0, 0]
        yield from out.flush()

    return back.mapInArrow(run, schema)
