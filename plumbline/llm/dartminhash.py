"""MinHash near-duplicates by DartMinHash.

Every shingle owns a strip of the plane, as wide as its weight and unbounded in rank. Darts are thrown into it by hash,
one per unit of area on average, in bands of doubling rank. A document keeps, for each coordinate of its signature, the
dart of lowest rank that hit one of its shingles; bands are thrown until all coordinates are taken. Two documents share
a coordinate with the probability of their weighted Jaccard similarity. Groups of coordinates form the keys of a banded
join; what meets there is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.base import Scratch, list_array, pieces, small_batches
from plumbline.llm.bitmaps import within, without
from plumbline.operators.components import components
from plumbline.session import checkpointed

WIDTH = 5
SIMILARITY = 0.8
#: 30 keys of 5 coordinates: a pair of similarity 0.8 shares no key with a probability of 7e-6.
ROWS, KEYS = 5, 30
#: Ranks below 2 ** FIRST form the first band; each further band doubles the rank.
FIRST = -6
#: Shingles that one block of darts is thrown for.
BLOCK = 400_000
#: A pair is verified exactly when the share of equal coordinates is at least this; 0.8 shows as less with 2e-8.
ESTIMATE = 0.62
#: Area that the darts of one draw fall into; a larger one is drawn part by part.
AREA = 256.0
#: Turns in which documents outside a key's largest class are compared with members of it, and members that a key offers.
TURNS, HUBS = 2, 4
#: Members that one document meets in a turn; whom it does not meet there it meets in the chunks.
MEETINGS = 4
#: Documents, and shingles of documents, at home in one chunk of a shared key.
CHUNK, CHUNK_SHINGLES = 1_000, 1_000_000


@lru_cache(maxsize=64)
def dart_counts(area: float) -> np.ndarray:
    """Cumulative Poisson probabilities of the number of darts in an area."""
    p, out, n = np.exp(-area), [], 0
    total = p
    while total < 1 - 1e-13 and n < area * 3 + 60:
        out.append(total)
        n += 1
        p *= area / n
        total += p
    return np.array(out)


def throw(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray | None, documents: int, size: int) -> np.ndarray:
    """Signatures (documents x size) of weighted sets; ``owner`` is sorted. A document without elements has all ones."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full(documents * size, none)
    strips = [(0.0, 1.0)]
    if weights is not None:
        while strips[-1][1] < weights.max(initial=0):
            strips.append((strips[-1][1], 2 * strips[-1][1]))
    open_ = np.zeros(documents, bool)
    open_[owner] = True
    band, low = 0, 0.0
    while open_.any():
        high = 2.0 ** (FIRST + band)
        live = open_[owner]
        e, o = elements[live], owner[live]
        for s, (left, right) in enumerate(strips):
            if s:
                wide = weights[live] > left
                e_s, o_s, w_s = e[wide], o[wide], weights[live][wide]
            else:
                e_s, o_s, w_s = e, o, None if weights is None else weights[live]
            area = (right - left) * (high - low)
            for part in range(max(1, int(np.ceil(area / AREA)))):
                seed = W.mix(e_s + np.uint64((band * 64 + s) * 0x51_7CC1 + 1))
                if part:
                    seed = W.mix(seed + np.uint64(part))
                count = np.searchsorted(dart_counts(min(AREA, area - part * AREA)), (seed >> np.uint64(11)).astype(np.float64) * 2.0 ** -53, side="right")
                hit = np.flatnonzero(count)
                n = count[hit]
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                dart = W.mix(np.repeat(seed[hit], n) ^ W.mix(number.astype(np.uint64) + np.uint64(0x1234_5678_9ABC)))
                who = np.repeat(o_s[hit], n)
                if w_s is not None:  # a dart counts when it falls within the weight
                    across = left + (right - left) * (W.mix(dart + np.uint64(77)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
                    inside = across < np.repeat(w_s[hit], n)
                    dart, who = dart[inside], who[inside]
                coordinate = (W.mix(dart + np.uint64(13)) % np.uint64(size)).astype(np.int64)
                # The band and the place within it order the ranks; the same number tells darts apart.
                rank = np.uint64(band) << np.uint64(58) | dart >> np.uint64(6)
                np.minimum.at(signature, who * size + coordinate, rank)
        open_ &= (signature.reshape(documents, size) == none).any(axis=1)
        band, low = band + 1, high
    return signature.reshape(documents, size)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all runs of five words; of all its words for a text of fewer."""
    w = W.split(texts)
    at, hashes = W.windows(w.hash, w.text, WIDTH)
    owner = w.text[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < WIDTH))
    if len(short):
        ends = np.cumsum(w.counts)
        for t in short.tolist():
            total = w.counts[t:t + 1].astype(np.uint64)
            for k in range(ends[t] - w.counts[t], ends[t]):
                total = W.mix(total + w.hash[k:k + 1])
            hashes, owner = np.append(hashes, total), np.append(owner, t)
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles per text, by text and hash, with their number."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])) if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", weighted: bool = False, rows: int = ROWS, keys: int = KEYS) -> DataFrame:
    """(id, digest, keys, sketch): per row the hash of its text, the keys of the banded join, and a byte of every
    coordinate. A text without words has no keys. With ``weighted``, a shingle weighs as often as it occurs."""
    small_batches(docs.sparkSession)
    size = rows * keys
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null").withColumn("digest", F.md5("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=W.BLOCK_BYTES):
            texts = [x.as_buffer().to_pybytes() for x in batch.column(1)]
            found, owner = shingles(texts)
            signature = np.empty((len(texts), size), np.uint64)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            start = 0
            while start < len(texts):  # blocks of whole documents
                stop = max(start + 1, int(np.searchsorted(cuts, cuts[start] + BLOCK, side="right")) - 1)
                e, o = found[cuts[start]:cuts[stop]], owner[cuts[start]:cuts[stop]] - start
                weight = None
                if weighted:
                    e, o, n = distinct(e, o)
                    weight = n.astype(np.float64)
                signature[start:stop] = throw(e, o, weight, stop - start, size)
                start = stop
            some = cuts[1:] > cuts[:-1]
            part = signature.reshape(len(texts), keys, rows)
            joined = np.zeros((len(texts), keys), np.uint64) + np.arange(keys, dtype=np.uint64)
            for r in range(rows):
                joined = W.mix(joined * W.MULTIPLIER + part[:, :, r])
            sketch = (W.mix(signature.ravel()) & np.uint64(255)).astype(np.uint8).reshape(signature.shape)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), list_array(joined[some].ravel().view(np.int64), np.where(some, keys, 0), pa.int64()),
                pa.array([x.tobytes() for x in sketch], pa.binary())], ["id", "digest", "keys", "sketch"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, digest string, keys array<long>, sketch binary")


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose share of equal coordinates makes the similarity possible."""
    sketches = classes.select("id", "sketch")
    both = (pairs.join(sketches.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a").join(sketches.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                yield batch.filter(pa.array(estimate((x == y).mean(axis=1)) >= ESTIMATE)).select(["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, pairs.select("a", "b").schema)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal bytes; one in 256 is equal by chance."""
    return (equal - 1 / 256) / (1 - 1 / 256)


def shingle_sets(docs: DataFrame, key: str, text: str, weighted: bool) -> DataFrame:
    """(id, set, n): the shingles of each row, ascending, and how often they occur."""
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=W.BLOCK_BYTES):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
            e, o, n = distinct(*shingles(texts))
            counts = np.bincount(o, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(e.view(np.int64), counts, pa.int64()), list_array(n if weighted else np.ones(len(n), np.int64), counts, pa.int32())], ["id", "set", "n"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, set array<long>, n array<int>")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, weighted: bool, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity, the sum of lesser by the sum of greater weights, reaches the threshold."""
    pairs = checkpointed(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    sets = checkpointed(shingle_sets(within(docs.select(key, text), ids, key), key, text, weighted).dropDuplicates(["id"]))
    both = (pairs.join(sets.withColumnsRenamed({"id": "a", "set": "ea", "n": "na"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "eb", "n": "nb"}), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ea, na, eb, nb in zip(*(batch.column(c) for c in ("ea", "na", "eb", "nb")), strict=True):
                x, y, wx, wy = (v.values.to_numpy() for v in (ea, eb, na, nb))
                _, i, j = np.intersect1d(x.view(np.uint64), y.view(np.uint64), assume_unique=True, return_indices=True)
                low = int(np.minimum(wx[i], wy[j]).sum())
                total = int(wx.sum()) + int(wy.sum()) - low
                keep.append(total > 0 and low >= similarity * total - 1e-9)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "ea", "na", "eb", "nb").mapInArrow(run, pairs.schema)


def hub_pairs(meets: DataFrame, group: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of documents outside the largest class of a shared key with a member of that class. Each key offers
    a few members, chosen by hash, so a document that shares several keys meets several members."""
    rows = meets.select("h", "id").join(group, "id")
    sizes = rows.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.min_by("id", F.xxhash64("id", "h", F.lit(turn * HUBS + k))) for k in range(HUBS)]).alias("hubs"))
    largest = sizes.groupBy("h").agg(F.max_by(F.struct("component", "hubs"), F.struct("n", -F.col("component"))).alias("lead"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    outside = rows.join(largest, "h").filter("component != lead.component")
    hub = F.element_at("lead.hubs", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(HUBS)).cast("int") + 1)
    few = outside.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(hub)), 1, MEETINGS).alias("hubs")).select("id", F.explode("hubs").alias("hub"))
    return few.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def crossing(mixed: DataFrame) -> DataFrame:
    """(h, place, own, chunk, visit, lead, id, component): the documents of every key, cut into chunks that are held whole.

    ``mixed`` has h, place, id, component and size. A document stays in its own chunk; one outside the largest class of its
    key also visits the other chunks. So any two of different components meet in a chunk that one of them is at home in, and a
    large class travels once however many documents are compared with it.
    """
    parts = mixed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    sizes = parts.groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("largest"),
                                   F.ceil(F.greatest(F.sum("n") / CHUNK, F.sum("s") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    rows = mixed.join(sizes, "h").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int")).withColumn("lead", F.col("component") == F.col("largest"))
    return (rows.withColumn("chunk", F.explode(F.when(F.col("lead"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
            .withColumn("visit", F.col("own") != F.col("chunk")).select("h", "place", "own", "chunk", "visit", "lead", "id", "component"))


def dealt(met: DataFrame, *carried: DataFrame) -> DataFrame:
    """``met`` with the columns of the tables ``carried`` (id, ...), every chunk in one task, those at home first. What is carried joins
    at the end, so that it is shuffled once by id and once by chunk."""
    for table in carried:
        met = met.join(table, "id")
    return met.repartition("h", "chunk").sortWithinPartitions("h", "chunk", "visit")


class Homes:
    """The documents at home in one chunk, and what is compared with them."""

    def __init__(self, place: int):
        self.place, self.parts, self.own, self.root = place, [], 0, {}

    def add(self, part: pa.RecordBatch) -> None:
        """More documents, in ascending order of arrival; they are numbered on."""
        self.parts.append(part)
        self.group = np.concatenate([p.column("component").to_numpy() for p in self.parts])
        self.lead = np.concatenate([np.asarray(p.column("lead")) for p in self.parts])
        self.sketch, self.marks = (np.concatenate([f(p) for p in self.parts]) for f in (sketches_of, marks_of))
        self.id = np.concatenate([p.column("id").to_numpy() for p in self.parts])
        if "set" in part.schema.names:
            self.set, self.n = ([x for p in self.parts for x in lists_of(p, c)] for c in ("set", "n"))
            self.total = np.array([x.sum() for x in self.n])
        self.own = len(self.id)

    def top(self, component: int) -> int:
        while (up := self.root.get(component, component)) != component:
            component = up
        return component

    def near(self, sketch: np.ndarray, marks: np.ndarray, component: int, before: int, visits: bool, own: int, chunk: int) -> np.ndarray:
        """Numbers, below ``before``, of the promising documents of other components that share no earlier key. Of two that visit
        each other's chunks the one of the greater chunk number is the visitor."""
        other = self.group[:before] != component
        if visits and own < chunk:
            other &= self.lead[:before]
        at = np.flatnonzero(other)
        at = at[estimate((self.sketch[at] == sketch).mean(axis=1)) >= ESTIMATE]
        return at[~(self.marks[at, :self.place] == marks[:self.place]).any(axis=1)]


def sketches_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def marks_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack(lists_of(batch, "marks"))


def lists_of(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    cuts = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[cuts[0]:cuts[-1]], cuts[1:-1] - cuts[0])


def chunk_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Homes, pa.RecordBatch, int, np.ndarray]]:
    """(homes, batch, row, numbers of the homes that the row is to be compared with), chunk by chunk."""
    now, homes = None, None
    for batch in batches:
        marks = list(zip(*(batch.column(c).to_pylist() for c in ("h", "chunk", "visit")), strict=True))
        start = 0
        while start < len(marks):
            stop = start + 1
            while stop < len(marks) and marks[stop] == marks[start]:
                stop += 1
            part = batch.slice(start, stop - start)
            if marks[start][:2] != now:
                now, homes = marks[start][:2], Homes(part.column("place")[0].as_py())
            visits, before = marks[start][2], homes.own
            if not visits:
                homes.add(part)
            if homes.own:
                sketch, keys, group, own = sketches_of(part), marks_of(part), part.column("component").to_numpy(), part.column("own").to_numpy()
                for r in range(part.num_rows):
                    near = homes.near(sketch[r], keys[r], group[r], homes.own if visits else before + r, visits, own[r], now[1])
                    if len(near):
                        yield homes, part, r, near
            start = stop


def hopeful(met: DataFrame) -> DataFrame:
    """(h, id) of the documents that have someone to be compared with; ``met`` as ``crossing`` returns it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for homes, part, r, near in chunk_meetings(batches):
            h = part.column("h")[0].as_py()
            new = [i for i in (*homes.id[near].tolist(), part.column("id")[r].as_py()) if i not in homes.root]
            if new:
                homes.root.update(dict.fromkeys(new))
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(new), pa.int64()), pa.array(new, pa.int64())], ["h", "id"])

    return met.select("h", "place", "own", "chunk", "visit", "lead", "id", "component", "sketch", "marks").mapInArrow(run, "h long, id long").distinct()


def forest(met: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components, found by exact comparison within each chunk: no more than join what meets there into trees,
    so that rows stay in proportion to documents, though no alike pair is left apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for homes, part, r, near in chunk_meetings(batches):
            component = int(part.column("component")[r].as_py())
            here = homes.top(component)
            near = near[[homes.top(c) != here for c in homes.group[near].tolist()]]
            if not len(near):
                continue
            one = part.slice(r, 1)
            own, weight = lists_of(one, "set")[0].view(np.uint64), lists_of(one, "n")[0]
            lengths = np.array([len(homes.set[k]) for k in near])
            flat, n = np.concatenate([homes.set[k] for k in near]).view(np.uint64), np.concatenate([homes.n[k] for k in near])
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            low = np.add.reduceat(np.where(own[at] == flat, np.minimum(weight[at], n), 0), np.cumsum(lengths) - lengths)
            alike = near[low >= similarity * (homes.total[near] + weight.sum() - low) - 1e-9]
            found = []
            for k in alike.tolist():
                a, b = homes.top(component), homes.top(int(homes.group[k]))
                if a != b:
                    homes.root[max(a, b)] = min(a, b)
                    found.append(k)
            if found:
                i, ids = part.column("id")[r].as_py(), homes.id[found]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids, i)), pa.array(np.maximum(ids, i))], ["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighted: bool = False, rows: int = ROWS, keys: int = KEYS) -> DataFrame:
    """(key, class_id, kept) of every row: the least id of its class of near copies, and whether that is its own.

    Texts are alike when their sets of five-word shingles (with ``weighted``: their counts, the sum of the lesser by the sum of the
    greater) have a Jaccard similarity of at least ``similarity``; equal texts always are. Classes are the connected components of
    alike texts. First every document is compared with the least id of one of its keys, then documents outside a key's largest class with a few
    members of it, chosen by hash, which settles large groups in linear work; at last all documents that share a key but
    not yet a class are compared with each other, chunk by chunk.

    A null text is a class of its own; texts without words are alike only when equal. Rows that share an id are one
    document. A null id has a null class and is kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col(key).cast("long").alias(key), text)
    scratch = Scratch(docs.sparkSession)
    signed = signatures(docs, key, text, weighted, rows, keys)
    classes = scratch.keep(signed.groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    keyed = classes.select("id", F.posexplode("keys").alias("place", "h"))
    shared = keyed.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least != most").select("h", "least")
    meets = scratch.keep(keyed.join(shared, "h").select("h", "place", "id", "least"))
    direct = meets.filter("id != least").groupBy(F.col("id").alias("b")).agg(F.min("least").alias("a")).select("a", "b")
    links = checkpointed(verified(promising(direct, classes), docs, key, text, weighted, similarity))
    nodes = meets.select("id").distinct()
    group = checkpointed(components(nodes, links))
    for turn in range(TURNS):
        more = checkpointed(verified(promising(hub_pairs(meets, group, turn), classes), docs, key, text, weighted, similarity))
        if more.isEmpty():
            break
        links = checkpointed(links.unionByName(more))
        group = checkpointed(components(nodes, links))
    grouped = meets.select("h", "place", "id").join(group, "id")
    several = grouped.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("h")
    mixed = scratch.keep(grouped.join(several, "h", "left_semi"))
    signs = classes.select("id", "sketch", F.transform("keys", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("marks"))
    near = scratch.keep(hopeful(dealt(crossing(mixed.withColumn("size", F.lit(0))), signs)))
    sets = shingle_sets(within(docs.select(key, text), near.select(F.col("id").alias(key)).distinct(), key), key, text, weighted).dropDuplicates(["id"])
    sets = scratch.keep(sets.withColumn("size", F.size("set")))
    hoping = scratch.keep(mixed.join(near, ["h", "id"], "left_semi").join(sets.select("id", "size"), "id"))
    more = checkpointed(forest(dealt(crossing(hoping), signs, sets.drop("size")), similarity))
    if not more.isEmpty():
        group = checkpointed(components(nodes, links.unionByName(more)))
    of_text = classes.select("id", "digest").join(group, "id", "left").select("digest", F.coalesce("component", F.col("id")).alias("class_id"))
    # The same id under several texts joins their classes.
    names = docs.select(F.col(key).alias("id"), F.md5(text).alias("digest")).filter("id is not null and digest is not null")
    of_id = names.join(of_text, "digest").groupBy("id").agg(F.min("class_id").alias("class_id"))
    return (docs.select(key).join(of_id.withColumnRenamed("id", key), key, "left")
            .select(key, F.coalesce("class_id", F.col(key)).alias("class_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("class_id"), F.lit(True))))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: the one of the least id. Of rows that repeat an id one stays, that of
    the least text. Whole rows are shuffled only where an id may be dropped or repeated."""
    classes = checkpointed(near_duplicates(docs, **options))
    gone = classes.filter("not kept").select("doc_id")
    once = without(docs, gone)
    repeated = classes.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return once
    columns = docs.columns
    first = within(once, repeated).groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in columns if c not in ("text", "doc_id")])).alias("r")).select("doc_id", "r.*").select(*columns)
    return without(once, repeated).unionByName(first)
