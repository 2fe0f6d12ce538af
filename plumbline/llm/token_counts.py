"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

The symbols of a word form a doubly linked list; a heap holds its adjacent pairs by rank. The lowest pair is popped
and merged until no pair of the vocabulary is left. The count is the number of initial symbols minus the merges; no
token identifiers come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import pieces, small_batches, text_or_empty, texts_of
from plumbline.llm.bytebpe import PRE_TOKEN, Vocabulary, cut_spaces, cut_special, load

#: Words whose counts a task remembers; beyond it, the memory starts over.
REMEMBERED = 600_000
#: A token limit of a training sequence, as the query reports it.
LIMIT = 512


class Counter(dict):
    """Piece of text -> number of its tokens, computed on first sight."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.first = vocabulary.first
        self.ranks = {a << 24 | b: i for i, (a, b, _) in enumerate(vocabulary.pairs)}
        self.made = [m for _, _, m in vocabulary.pairs]
        # Rank of two neighbouring bytes, -1 for none: most look-ups of a word are its first ones.
        self.starts = [self.ranks.get(a << 24 | b, -1) for a in self.first for b in self.first]

    def __missing__(self, piece: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):  # a space and letters are one word
            n = self.count(piece.encode())
        else:
            n = sum([self.count(word.encode()) for word in PRE_TOKEN.findall(piece)])
        self[piece] = n
        return n

    def count(self, word: bytes) -> int:
        """Initial symbols minus merges."""
        n = len(word)
        starts = self.starts
        live = [starts[a << 8 | b] for a, b in zip(word, word[1:], strict=False)]  # rank of the pair that begins at a symbol
        shift = n.bit_length()
        heap = [r << shift | i for i, r in enumerate(live) if r >= 0]
        if not heap:
            return n
        heapify(heap)
        live.append(-1)
        get, made, first = self.ranks.get, self.made, self.first
        symbols = [first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask, merges = (1 << shift) - 1, 0
        while heap:
            entry = heappop(heap)
            i = entry & mask
            rank = entry >> shift
            if live[i] != rank:  # stale: a symbol of the pair was merged meanwhile
                continue
            merges += 1
            symbols[i] = new = made[rank]
            j = after[i]
            live[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                live[i] = rank = get(new << 24 | symbols[k], -1)
                if rank >= 0:
                    heappush(heap, rank << shift | i)
            else:
                live[i] = -1
            h = before[i]
            if h >= 0:
                live[h] = rank = get(symbols[h] << 24 | new, -1)
                if rank >= 0:
                    heappush(heap, rank << shift | h)
        return n - merges

    def text(self, text: str, special: dict[str, int]) -> int:
        return sum(1 if isinstance(part, int) else sum(map(self.__getitem__, cut_spaces(part))) for part in cut_special(text, special))


def token_counts(docs: DataFrame, vocabulary_file: str, text: str = "text", name: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a long column ``name``: the number of tokens of its text.

    A null or empty text has 0 tokens; an empty table stays empty. The columns ``keep`` (all by default) pass through,
    a column called ``name`` is replaced. Strings of added special tokens inside a text count as one token each. One
    narrow pass: no shuffle, and a lost task is simply run again.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    kept = [c for c in docs.columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary_file))  # bounded by the vocabulary file
    schema = docs.select(*kept).schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in pieces(batches, text):
            counts = [counter.text(x, shared.value.special) for x in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(counts, pa.int64())], [*kept, name])

    return docs.mapInArrow(run, schema)


def token_report(docs: DataFrame, vocabulary_file: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``; a null text counts as empty."""
    slim = docs.select("doc_id", text_or_empty().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return (token_counts(slim, vocabulary_file, keep=["doc_id", "n_bytes"])
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
