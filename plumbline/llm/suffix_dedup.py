"""Removal of repeated byte strings by a sparse, distributed suffix array.

Every string of ``LENGTH`` bytes has one anchor, the place of the least hash among its short substrings, so equal
strings have equal anchors. Suffixes are sorted only where they begin at an anchor, and only those whose anchor occurs
elsewhere: sampled splitters range-partition them by their leading bytes, each bucket sorts its part by multikey
quicksort, and the common prefixes of neighbours, to the right and to the left of the anchors, tell which strings occur
twice. Stretches around an anchor that are equal as a whole are found before, by their digest. An anchor that is too
frequent for one bucket is compared across buckets, by digests of its single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.base import Scratch, pieces, small_batches
from plumbline.llm.bitmaps import bitmap, maybe
from plumbline.session import checkpointed

LENGTH = 200
#: Bytes of an anchor.
GRAM = 32
#: Bytes of text that are worked on at a time; longer texts are cut, with an overlap.
SEGMENT = 1_500_000
#: Bits of a place within a block.
PLACE_BITS = (SEGMENT + 2 * LENGTH).bit_length()
#: Rows that a bucket sorts at a time, and rows of one anchor above which it is compared across buckets.
SORTED, HOT = 20_000, 50_000
#: Leading bytes by which suffixes are range-partitioned.
LEAD = 16
#: Names of the columns that tell an anchor's place: document, digest of its text, place, first string that it serves.
PLACE = ["doc", "rid", "at", "first"]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``length`` bytes within the stretches [start, end) of ``data``.

    Returned, as places in ``data``: the anchor, the first and the last string that it serves; and the hash of the
    anchor and of all that its strings cover.
    """
    n, width = len(data), length - gram + 1
    good = ends - starts >= length
    if not good.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    power, inverse = W.powers(1 << max(16, (n + 1).bit_length()))
    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64))
    grams = W.mix((total[gram:] - total[:-gram]) * inverse[:n - gram + 1])
    bits = np.uint64(PLACE_BITS)  # the same for all blocks, so that equal strings choose equally
    least = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the first place is least
    span = 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    where = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, starts[good], 1)
    np.add.at(inside, ends[good] - length + 1, -1)
    string = np.flatnonzero(np.cumsum(inside)[:len(where)] > 0)
    place = where[string]
    head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (string[1:] != string[:-1] + 1)))
    first, last, at = string[head], string[np.append(head[1:], len(string)) - 1], place[head]
    whole = (total[last + length] - total[first]) * inverse[first]
    shape = ((at - first) << 10 | (last - first)).astype(np.uint64)
    return at, first, last, grams[at], W.mix(W.mix(whole) + shape * W.MULTIPLIER)


def segments(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, row, offset, start, end) of blocks of texts: stretch [start, end) of ``data`` is the row's text from offset."""
    raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(batch.schema.get_field_index("raw"))]
    cuts = [(i, o, t[o:o + SEGMENT + length - 1]) for i, t in enumerate(raw) for o in range(0, max(1, len(t) - length + 1), SEGMENT)]
    at = 0
    while at < len(cuts):
        stop, load = at, 0
        while stop < len(cuts) and (stop == at or load + len(cuts[stop][2]) <= SEGMENT + length):
            load += len(cuts[stop][2])
            stop += 1
        part = cuts[at:stop]
        sizes = np.array([len(t) for _, _, t in part], dtype=np.int64)
        ends = np.cumsum(sizes)
        yield np.frombuffer(b"".join(t for _, _, t in part), np.uint8), np.array([i for i, _, _ in part]), np.array([o for _, o, _ in part], dtype=np.int64), ends - sizes, ends
        at = stop


def anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, rid, at, first, last, g, whole) of all anchors; places are offsets in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "raw", SEGMENT):
            for data, row, offset, start, end in segments(batch, length):
                at, first, last, g, whole = anchors(data, start, end, length, gram)
                which = np.searchsorted(end, first, side="right")
                shift = (offset - start)[which]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row[which])), batch.column(1).take(pa.array(row[which])), *[pa.array((x + shift).astype(np.int32)) for x in (at, first, last)],
                    pa.array(g.view(np.int64)), pa.array(whole.view(np.int64))], [*PLACE, "last", "g", "whole"])

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, rid long, at int, first int, last int, g long, whole long")


def place_hash(rid: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of an anchor's place, for bit maps."""
    return W.mix(rid.astype(np.int64).view(np.uint64) ^ W.mix(at.astype(np.uint64) << np.uint64(32) | first.astype(np.uint64)))


def slices(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(place..., g, low, high, right, left) of the ``wanted`` anchors: their bytes to the right and, turned round, to the
    left. Strings that begin ``low`` to ``high`` bytes left of the anchor are its own. A bit map of the places picks
    candidates while the texts are read again; an exact join follows."""
    hashed = wanted.select("rid", "at", "first").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(place_hash(*(b.column(c).to_numpy() for c in ("rid", "at", "first"))).view(np.int64))], ["h"]) for b in batches), "h long")
    # Two maps over different bits of the hash; each has at most 1 << 17 rows of two numbers.
    maps = np.zeros((2, 1 << 17), dtype=np.int64)
    for k in range(2):
        rows = bitmap(hashed.select(F.shiftrightunsigned("h", 23 * k).alias("h")), "h").collect()
        maps[k, [r["word"] for r in rows]] = [r["mask"] for r in rows]
    filled = docs.sparkSession.sparkContext.broadcast(maps.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, low23 = filled.value, np.uint64((1 << 23) - 1)
        for batch in pieces(batches, "raw", SEGMENT):
            for data, row, offset, start, end in segments(batch, length):
                at, first, last, g, whole = anchors(data, start, end, length, gram)
                which = np.searchsorted(end, first, side="right")
                shift = (offset - start)[which]
                spot = place_hash(batch.column(1).take(pa.array(row[which])).to_numpy(), at + shift, first + shift)
                hit = [mask[k, ((spot >> np.uint64(23 * k) & low23) >> np.uint64(6)).astype(np.int64)] >> (spot >> np.uint64(23 * k) & np.uint64(63)) & np.uint64(1) for k in range(2)]
                keep = np.flatnonzero(hit[0] & hit[1])
                at, first, last, g, which, shift = at[keep], first[keep], last[keep], g[keep], which[keep], shift[keep]
                raw = data.tobytes()
                right = [raw[a:z] for a, z in zip(at.tolist(), (last + length).tolist(), strict=True)]
                left = [raw[f:a][::-1] for f, a in zip(first.tolist(), at.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row[which])), batch.column(1).take(pa.array(row[which])), pa.array((at + shift).astype(np.int32)), pa.array((first + shift).astype(np.int32)),
                    pa.array(g.view(np.int64)), pa.array((at - last).astype(np.int32)), pa.array((at - first).astype(np.int32)), pa.array(right, pa.binary()), pa.array(left, pa.binary())],
                    [*PLACE, "g", "low", "high", "right", "left"])

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, rid long, at int, first int, g long, low int, high int, right binary, left binary")


def multikey_sort(strings: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix: one key of eight bytes at a time, and only within ties of the keys before."""
    n, width = strings.shape
    keys = np.zeros((n, (width + 7) // 8 * 8), np.uint8)
    keys[:, :width] = strings
    keys = keys.view(">u8").astype(np.uint64)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # by place in the order
    tied = np.arange(n)
    for k in range(keys.shape[1]):
        key = keys[order[tied], k]
        turn = np.lexsort((key, group[tied]))
        order[tied] = order[tied][turn]
        key = key[turn]
        new = np.append(True, (key[1:] != key[:-1]) | (group[tied][1:] != group[tied][:-1]))
        # A tie is named by its first place.
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        single = new & np.append(new[1:], True)
        tied = tied[~single]
        if not len(tied):
            break
    return order


def padded(strings: list[bytes], width: int) -> np.ndarray:
    """A matrix of the first ``width`` bytes, zeros behind the end."""
    out = np.zeros((len(strings), width), np.uint8)
    sizes = np.minimum([len(s) for s in strings], width)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(s[:width] for s in strings), np.uint8)
    return out


def ranked(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each with the one before it in that order (-1 for the first)."""
    order = multikey_sort(strings)
    a, b = strings[order[1:]], strings[order[:-1]]
    differ = a != b
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return order, np.append(-1, common)


def repeated(right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, j): strings of ``length`` that begin j bytes left of the row's anchor and belong to another row as well."""
    n = len(right)
    r_order, r_common = ranked(padded(right, length))
    l_order, l_common = ranked(padded(left, length - gram))
    rows, steps = [], []
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(int(low.min()), int(high.max()) + 1):
        # Equal bytes right of the anchor, and equal bytes left of it.
        r_class[r_order] = np.cumsum(r_common < length - j)
        l_class[l_order] = np.cumsum(l_common < j)
        own = np.flatnonzero((low <= j) & (j <= high))
        if len(own) < 2:
            continue
        key = r_class[own] * (n + 1) + l_class[own]
        turn = np.argsort(key, kind="stable")
        same = key[turn][1:] == key[turn][:-1]
        twice = np.append(same, False) | np.append(False, same)
        rows.append(own[turn[twice]])
        steps.append(np.full(int(twice.sum()), j))
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *steps])


def runs(row: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, least j, greatest j) of the runs of consecutive j."""
    order = np.lexsort((j, row))
    row, j = row[order], j[order]
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1))) if len(row) else np.zeros(0, np.int64)
    return row[head], j[head], j[np.append(head[1:], len(row)) - 1] if len(row) else head


def bucket_spans(suffixes: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, rid, start, stop): repeated stretches around the anchors of ``suffixes``, sorted in range partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(part: pa.Table) -> Iterator[pa.RecordBatch]:
            right, left = part.column("right").to_pylist(), part.column("left").to_pylist()
            row, j = repeated(right, left, part.column("low").to_numpy(), part.column("high").to_numpy(), length, gram)
            row, least, most = runs(row, j)
            if len(row):
                picked = part.select(["doc", "rid", "at"]).take(pa.array(row)).combine_chunks()
                at = picked.column("at").to_numpy()
                yield from pa.table([picked.column("doc"), picked.column("rid"), pa.array((at - most).astype(np.int32)), pa.array((at - least + length).astype(np.int32))], names=["doc", "rid", "start", "stop"]).to_batches()

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            g = table.column("g").to_numpy()
            # The last anchor's rows may go on in the next batch.
            cut = len(g) if last else int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            if cut:
                yield from told(table.slice(0, cut))
            held.extend(table.slice(cut).to_batches())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= SORTED:
                yield from flush(False)
        if held:
            yield from flush(True)

    lead = F.substring("right", 1, LEAD)
    # Sampled splitters; equal leading bytes stay together, so an anchor's suffixes are in one bucket.
    parts = suffixes.withColumn("lead", lead).repartitionByRange("lead").sortWithinPartitions("lead", "g").drop("lead")
    return parts.mapInArrow(run, f"doc {suffixes.schema['doc'].dataType.simpleString()}, rid long, start int, stop int")


def digest_spans(suffixes: DataFrame, length: int) -> DataFrame:
    """The same as ``bucket_spans`` for anchors of any frequency: single strings are counted by their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                low, high = batch.column("low")[i].as_py(), batch.column("high")[i].as_py()
                whole = batch.column("left")[i].as_py()[::-1] + batch.column("right")[i].as_py()
                js = list(range(low, high + 1))
                n = len(js)
                row = batch.slice(i, 1).select(["doc", "rid", "at"])
                take = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays([*[c.take(take) for c in row.columns], pa.array(js, pa.int32()), pa.array([hashlib.blake2b(whole[high - j:high - j + length], digest_size=16).digest() for j in js], pa.binary())], ["doc", "rid", "at", "j", "digest"])

    kind = suffixes.schema["doc"].dataType.simpleString()
    strings = checkpointed(suffixes.select("doc", "rid", "at", "low", "high", "right", "left").mapInArrow(run, f"doc {kind}, rid long, at int, j int, digest binary"))
    twice = strings.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    return strings.join(twice, "digest").select("doc", "rid", (F.col("at") - F.col("j")).alias("start"), (F.col("at") - F.col("j") + length).alias("stop"))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, rid, raw): id, hash of id and text, and the text's bytes; a null text is empty."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(key), plain).alias("rid"), plain.cast("binary").alias("raw"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc, rid, spans): per document with any, the stretches (start, stop) in bytes that strings of ``length`` bytes
    cover which also start anywhere else, in this or another row; touching stretches are one.

    ``doc`` is the id and ``rid`` a hash of id and text, so rows that share an id but not the text are told apart.
    Repeated rows repeat each other's strings. Null and short texts have none.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs, key, text).filter(F.length("raw") >= length)
    table = scratch.keep(anchor_table(rows, length, gram))
    # Anchors that occur once are dropped. Where all stretches around an anchor are equal, they are repeated as a whole.
    groups = scratch.keep(table.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")).filter("n > 1"))
    shared = maybe(table, F.col("g"), groups, "g").filter("__maybe").drop("__maybe").join(groups.select("g", "mixed"), "g")
    shared = scratch.keep(shared)
    mixed = shared.filter("mixed")
    stretches = scratch.keep(mixed.groupBy("g", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("p")))
    open_ = stretches.select("g", "whole", "n", "p.*")
    equal = shared.filter("not mixed").select("doc", "rid", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    equal = equal.unionByName(mixed.join(stretches.filter("n > 1").select("g", "whole"), ["g", "whole"]).select("doc", "rid", F.col("first").alias("start"), (F.col("last") + length).alias("stop")))
    # One suffix of each different stretch is compared; those of repeated stretches only stand for them.
    sizes = stretches.groupBy("g").agg(F.count(F.lit(1)).alias("suffixes"))
    wanted = open_.join(sizes, "g").select(*[F.col(c).alias(f"w_{c}") for c in PLACE], (F.col("suffixes") > hot).alias("hot"))
    suffixes = slices(rows, open_, length, gram)
    suffixes = scratch.keep(suffixes.join(wanted, [suffixes[c].eqNullSafe(wanted[f"w_{c}"]) for c in PLACE]).select(*suffixes.columns, "hot"))
    found = equal.unionByName(bucket_spans(suffixes.filter("not hot").drop("hot"), length, gram))
    if not suffixes.filter("hot").isEmpty():
        found = found.unionByName(digest_spans(suffixes.filter("hot").drop("hot"), length))
    per = found.groupBy("doc", "rid").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s"))
    # Merge: a stretch that begins at or before the greatest end so far goes on with it.
    merged = F.expr("""aggregate(s, cast(array() as array<struct<start:int,stop:int>>), (acc, x) -> case
        when size(acc) > 0 and element_at(acc, -1).stop >= x.start
        then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, x.stop))))
        else concat(acc, array(x)) end)""")
    out = Scratch(docs.sparkSession).keep(per.select("doc", "rid", merged.alias("spans")))
    scratch.drop()
    return out


def removed(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row: ``kept`` are the bytes outside its spans, joined."""
    rows = keyed(docs, key, text)
    kind = rows.schema["doc"].dataType.simpleString()
    ids = found.select(F.xxhash64("doc", "rid").alias("h"))
    marked = maybe(rows, F.xxhash64("doc", "rid"), ids, "h")
    whole = marked.filter("not __maybe").select(F.col("doc").alias(key), F.length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("raw").alias("kept"))
    theirs = found.select(F.col("doc").alias("d"), F.col("rid").alias("r"), "spans")
    some = marked.filter("__maybe").drop("__maybe").join(theirs, F.col("doc").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")), "left").select("doc", "raw", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "raw", SEGMENT):
            kept, gone, count = [], [], []
            for raw, cuts in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, out, at = raw.as_buffer().to_pybytes(), [], 0
                for cut in cuts or ():
                    out.append(raw[at:cut["start"]])
                    at = cut["stop"]
                out.append(raw[at:])
                kept.append(b"".join(out))
                gone.append(len(raw) - len(kept[-1]))
                count.append(len(cuts or ()))
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], [key, "n_bytes", "n_removed", "n_spans", "kept"])

    return whole.unionByName(some.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return removed(docs, spans(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
