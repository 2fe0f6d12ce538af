"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In every round each word merges its pair of lowest rank, wherever it
stands in the word; pairs are looked up by binary search over sorted pair keys. Words without a known pair leave. A very long word
has arrays of its own, in which a round touches only the places it merges and their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.base import list_array, pieces, small_batches, spans_index, text_or_empty, texts_of
from plumbline.llm.bytebpe import PRE_TOKEN, Vocabulary, cut_spaces, cut_special, load

#: Pieces of text a task remembers; beyond it, the memory starts over.
REMEMBERED = 200_000
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 500_000
DIGESTS = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
NO_RANK = np.iinfo(np.int64).max
#: Bytes from which a word is merged by itself; both ways give the same ids.
LONG_WORD = 1_000


class Merger:
    """Encodes words in batches."""

    def __init__(self, vocabulary: Vocabulary):
        a, b, made = (np.array(x, dtype=np.int64) for x in zip(*vocabulary.pairs, strict=True)) if vocabulary.pairs else (np.zeros(0, np.int64),) * 3
        keys = a << 24 | b
        self.order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.ranks = np.append(self.order, NO_RANK).astype(np.int64)
        self.made = made
        self.first = np.array(vocabulary.first, dtype=np.int64)

    def rank(self, symbols: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Rank of every adjacent pair within a word."""
        key = symbols[:-1] << 24 | symbols[1:]
        at = np.searchsorted(self.keys, key)
        return np.where(same & (self.keys[at] == key), self.ranks[at], NO_RANK)

    def encode_long(self, word: bytes) -> np.ndarray:
        """Token ids of one word. Places wait under the rank of their pair; a place whose pair has changed meanwhile is passed over."""
        symbols = self.first[np.frombuffer(word, dtype=np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        rank = np.append(self.rank(symbols, np.ones(n - 1, bool)), NO_RANK)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> list[int]:
            """Put places under their ranks; the ranks that none waited under."""
            of = rank[places]
            places, of = places[of != NO_RANK], of[of != NO_RANK]
            order = np.argsort(of, kind="stable")
            places, of = places[order], of[order]
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
            fresh = []
            for r, part in zip(of[starts].tolist(), np.split(places, starts[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    fresh.append(r)
                waiting[r].append(part)
            return fresh

        heap = wait(np.arange(n))
        heapify(heap)
        while heap:
            r = heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[rank[places] == r]
            if not len(places):
                continue
            # Of overlapping occurrences every second counts, from the left.
            fresh = np.append(True, after[places[:-1]] != places[1:])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            gone = after[places]
            symbols[places] = self.made[r]
            alive[gone], rank[gone] = False, NO_RANK
            after[places] = then = after[gone]
            before[then] = places  # the last entry, behind the word, is never read
            touched = np.concatenate([places, before[places]])
            touched = np.unique(touched[touched >= 0])
            right = after[touched]
            key = symbols[touched] << 24 | symbols[np.minimum(right, n - 1)]
            at = np.searchsorted(self.keys, key)
            rank[touched] = np.where((right < n) & (self.keys[at] == key), self.ranks[at], NO_RANK)
            for new in wait(touched):
                heappush(heap, new)
        return symbols[alive]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after another, and their number per word. An empty word has none."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        done_symbols = [self.encode_long(words[i]) for i in long]
        done_words = [np.full(len(s), i) for i, s in zip(long, done_symbols, strict=True)]
        short = words if not long else [b"" if len(w) > LONG_WORD else w for w in words]
        lengths = np.array([len(w) for w in short], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(short), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            rank = np.append(self.rank(symbols, word[1:] == word[:-1]), NO_RANK)
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(symbols))))
            over = least == NO_RANK
            if over.any():
                done_words.append(word[over])
                done_symbols.append(symbols[over])
                symbols, word, rank, least = symbols[~over], word[~over], rank[~over], least[~over]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == least)
            # Of overlapping occurrences (aaa) every second counts, from the left.
            fresh = np.append(True, np.diff(chosen) != 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            symbols[chosen] = self.made[rank[chosen]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        # A word leaves as a whole, so a stable sort keeps its order.
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes batches of texts; remembers pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.merger, self.special = Merger(vocabulary), vocabulary.special
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for token, i in self.special.items():
            self.add([token], np.array([i]), np.array([1]))

    def add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.index.update(zip(names, range(len(self.index), len(self.index) + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, lengths])

    def learn(self, new: list[str]) -> None:
        words: dict[str, int] = {}
        of = [[words.setdefault(w, len(words)) for w in PRE_TOKEN.findall(piece)] for piece in new]
        ids, lengths = self.merger.encode([w.encode("utf-8", "surrogatepass") for w in words])
        starts, flat = np.cumsum(lengths) - lengths, np.array([w for ws in of for w in ws], dtype=np.int64)
        per_piece = np.repeat(np.arange(len(new)), [len(ws) for ws in of])
        self.add(new, ids[spans_index(starts[flat], lengths[flat])], np.bincount(per_piece, weights=lengths[flat], minlength=len(new)).astype(np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number per text."""
        if len(self.index) > REMEMBERED:
            self.forget()
        names = {i: t for t, i in self.special.items()}
        cut = []
        for text in texts:
            row: list[str] = []
            for part in cut_special(text, self.special):
                if isinstance(part, int):
                    row.append(names[part])
                else:
                    row += cut_spaces(part)
            cut.append(row)
        new = list({p for row in cut for p in row if p not in self.index})
        if new:
            self.learn(new)
        at = np.array([self.index[p] for row in cut for p in row], dtype=np.int64)
        lengths = self.lengths[at]
        per_text = np.repeat(np.arange(len(texts)), [len(row) for row in cut])
        return self.flat[spans_index(self.starts[at], lengths)], np.bincount(per_text, weights=lengths, minlength=len(texts)).astype(np.int64)


class Decoder:
    """Bytes of token ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.lengths = np.array([len(t) for t in vocabulary.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(vocabulary.tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """One text per count; bytes that are no UTF-8 become replacement characters."""
        lengths = self.lengths[ids]
        raw = self.pool[spans_index(self.starts[ids], lengths)].tobytes()
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode(docs: DataFrame, vocabulary_file: str, text: str = "text", ids: str | None = "ids", decoded: str | None = None, digests: bool = False,
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` array<int>, the tokens of its text, and on demand ``decoded``, the text made of them again,
    and with ``digests`` the columns of ``DIGESTS``: number, SHA-256 of the decimal ids joined by commas and SHA-256 of
    the decoded text.

    A null or empty text has no tokens. The columns ``keep`` (all by default) pass through; columns of the new names
    are replaced. One narrow pass: no shuffle. Special strings in a text become their tokens, as the file's library does by default.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*filter(None, (ids, decoded)), *(DIGESTS if digests else ()))
    kept = [c for c in docs.columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary_file))  # bounded by the vocabulary file
    schema = docs.select(*kept).schema
    for name, kind in ((ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType()), *(DIGESTS.items() if digests else ())):
        if name:
            schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in pieces(batches, text, BATCH_BYTES):
            flat, counts = encoder.encode(texts_of(batch, text))
            columns, names = list(batch.select(kept).columns), list(kept)
            if ids:
                columns, names = [*columns, list_array(flat, counts, pa.int32())], [*names, ids]
            back = decoder.decode(flat, counts) if decoded or digests else []
            if decoded:
                columns, names = [*columns, pa.array(back, pa.string())], [*names, decoded]
            if digests:
                cuts = np.append(0, np.cumsum(counts)).tolist()
                told = [sha256(",".join(map(str, flat[a:b].tolist())).encode()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                columns += [pa.array(counts, pa.int64()), pa.array(told, pa.string()), pa.array([sha256(x.encode()).hexdigest() for x in back], pa.string())]
                names += DIGESTS
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary_file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with ``text``, made of the token ids in ``ids``; null or empty ids give the empty text, a null id inside
    is skipped, an unknown id raises."""
    small_batches(rows.sparkSession)
    rows = rows.drop(text)
    shared = rows.sparkSession.sparkContext.broadcast(load(vocabulary_file))
    schema = rows.select("*").schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = [[i for i in x or () if i is not None] for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            texts = decoder.decode(np.array([i for x in lists for i in x], dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return encode(docs.select("doc_id", text_or_empty().alias("text")), vocabulary_file, ids=None, digests=True, keep=["doc_id"])


def tokenized(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """Every row without its text, with ``ids``, n_tokens and the digests of ids and decoded text."""
    return encode(docs.withColumn("text", text_or_empty()), vocabulary_file, digests=True, keep=[c for c in docs.columns if c != "text"])
