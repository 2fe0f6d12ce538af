"""Language identification by word-first backoff.

Known words score by their log frequency in every language; an unseen word falls back to character n-grams, at each
place the longest known one of at most four characters. Counts cover every training document, and all of them score:
the most frequent words and n-grams go to every task, the others stay a table that the words of documents are joined to.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import pieces, small_batches, text_or_empty, texts_of
from plumbline.session import checkpointed, shuffles_removed

WORD = re.compile(r"[^\W\d_]+")
#: A word is cut to this many characters, so that a text without spaces is no single key.
WORD_CHARS = 64
GRAMS = (4, 3, 2, 1)
#: Size of what goes to every task: the most frequent words and n-grams. All others are looked up by joins.
MAX_WORDS, MAX_GRAMS, MAX_LANGUAGES = 150_000, 150_000, 500
#: Words a task counts, or scores, before it starts over.
TASK_WORDS = 250_000
#: Keys with more than this share of a join's rows are joined by broadcast.
OFTEN = 5_000
#: Most partitions, for each core, of what follows a shuffle and is written: tables that are kept, and the result.
FILES = 4
#: Scores that are summed in a shuffle are whole multiples of 1 / FIXED, so their order does not matter.
FIXED = 1 << 28


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, long ones in pieces."""
    words = WORD.findall(text.lower())
    if len(text) > WORD_CHARS and max(map(len, words), default=0) > WORD_CHARS:
        words = [w[i:i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


def few(df: DataFrame) -> DataFrame:
    """``df`` in a few partitions for each core. Each file written to a local folder costs the executor a process that sets its
    mode; until that runs ``chmod``, it seems to hold all the executor's memory once more."""
    return df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism)


def kept(df: DataFrame) -> DataFrame:
    return checkpointed(few(df))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, lang, n) over all of ``docs`` (text, lang), counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                words = list(c)
                for i in range(0, len(words), 50_000):
                    part = words[i:i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([lang] * len(part)), pa.array([c[w] for w in part], pa.int64())], ["word", "lang", "n"])
            counts.clear()

        for batch in pieces(batches):
            for text, lang in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > TASK_WORDS:
                yield from flush()
        yield from flush()

    parts = docs.select("text", "lang").mapInArrow(run, "word string, lang string, n long")
    return parts.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, key: str, most: int) -> tuple[DataFrame, int, bool]:
    """The rows (key, lang, n) of the keys whose total reaches the least threshold that keeps at most ``most`` of them; the
    number of all keys, and whether they are all kept. Equal totals stay or go together, so the choice does not depend on order."""
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    level = F.when(F.col("total") < 1_000, F.col("total")).otherwise(F.floor(F.log2("total") * 100) + 1_000)  # some thousands of levels
    sizes = totals.groupBy(level.alias("level")).count().collect()
    kept, least = 0, None
    for row in sorted(sizes, key=lambda r: -r["level"]):
        kept += row["count"]
        if kept > most:
            break
        least = row["level"]
    number = sum(row["count"] for row in sizes)
    return totals.filter(F.lit(False) if least is None else level >= least), number, kept == number <= most


def met(rows: DataFrame, table: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``rows`` joined to ``table`` by ``key``; a key that holds many of the rows is not shuffled. ``sizes`` (key, m) has
    the number of rows of every key."""
    least = max(1_000, (sizes.agg(F.sum("m")).first()[0] or 0) // OFTEN)
    often = sizes.filter(F.col("m") > least).select(key).collect()  # fewer than OFTEN
    if not often:
        return rows.join(table, key)
    table = kept(table)
    often = F.broadcast(rows.sparkSession.createDataFrame(often, rows.select(key).schema))
    return rows.join(often, key, "left_anti").join(table, key).unionByName(rows.join(F.broadcast(table.join(often, key, "left_semi")), key))


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    prior: np.ndarray
    #: Logs of the smoothed totals of words and n-grams.
    word_base: np.ndarray
    gram_base: np.ndarray
    #: Whether every word and n-gram of the training documents is in ``words`` and ``grams``.
    whole: bool
    #: All counts (word, lang, n) and (gram, lang, n); they stay tables.
    all_words: DataFrame | None = None
    all_grams: DataFrame | None = None

    def unseen(self, word: str, rare: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Mean score of the longest known n-grams along the word, ``rare`` ones included; nothing known says nothing."""
        text, rows, others = f"_{word}_", [], []
        for i in range(len(text)):
            for n in GRAMS:
                if i + n > len(text):
                    continue
                gram = text[i:i + n]
                if rare and gram in rare:
                    others.append(rare[gram])
                    break
                if (row := self.grams.get(gram)) is not None:
                    rows.append(row)
                    break
        if others:
            return np.concatenate([self.gram_scores[rows], np.array(others)]).mean(axis=0)
        return self.gram_scores[rows].mean(axis=0) if rows else np.zeros(len(self.languages), np.float32)

    def open_grams(self, word: str) -> list[str]:
        """The n-grams of an unseen word that may be known and longer than the longest of ``grams`` at their place."""
        text, out = f"_{word}_", []
        for i in range(len(text)):
            for n in GRAMS:
                if i + n <= len(text):
                    if text[i:i + n] in self.grams:
                        break
                    out.append(text[i:i + n])
        return list(dict.fromkeys(out))


def relative(table: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Log frequencies per language of counts, smoothed by one, relative to their mean."""
    logs = np.log(table + 0.5) - base
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def scores(rows: list, key: str, languages: list[str], base: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    table = np.array([[r["by"].get(lang, 0) for lang in languages] for r in rows], dtype=np.float64).reshape(len(rows), len(languages))
    return {r[key]: i for i, r in enumerate(rows)}, relative(table, base)


def learn(docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model | None:
    """A model of ``docs`` (text, lang); rows without a language teach nothing. None when no row has one and a word."""
    small_batches(docs.sparkSession)
    counts = kept(word_counts(docs.filter("lang is not null")))
    totals = {r["lang"]: float(r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not totals:
        return None
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(totals)
    marked = F.concat(F.lit("_"), "word", F.lit("_"))

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - (n - 1))), lambda i: F.substr(marked, i, F.lit(n)))

    gram_counts = counts.select("lang", "n", F.explode(F.concat(*[grams(n) for n in GRAMS])).alias("gram")).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    gram_counts = kept(gram_counts)
    gram_totals = {r["lang"]: float(r["n"]) for r in gram_counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    top_words, n_words, every_word = most_frequent(counts, "word", max_words)
    top_grams, n_grams, every_gram = most_frequent(gram_counts, "gram", max_grams)
    word_base = np.log(np.array([totals[x] for x in languages]) + 0.5 * max(1, n_words))
    gram_base = np.log(np.array([gram_totals[x] for x in languages]) + 0.5 * max(1, n_grams))
    words, word_scores = scores(top_words.collect(), "word", languages, word_base)
    known, gram_scores = scores(top_grams.collect(), "gram", languages, gram_base)
    share = np.array([totals[x] for x in languages]) / sum(totals.values())
    return Model(languages, words, word_scores, known, gram_scores, np.log(share).astype(np.float32), word_base, gram_base, every_word and every_gram, counts, gram_counts)


class Scorer(dict):
    """Word -> its row in ``table``; unseen words are added, up to a bound."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model = model
        self.table = np.concatenate([model.word_scores, np.zeros((TASK_WORDS, len(model.languages)), np.float32)])

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.table[row] = self.model.unseen(word)
        return row

    def total(self, words: list[str]) -> np.ndarray:
        total = self.model.prior.astype(np.float64)
        for i in range(0, len(words), TASK_WORDS // 4):
            if len(self) > len(self.model.words) + TASK_WORDS // 2:
                self.clear()
                self.update(self.model.words)
            total = total + self.table[list(map(self.__getitem__, words[i:i + TASK_WORDS // 4]))].sum(axis=0, dtype=np.float64)
        return total

    def total_of(self, places: list[int]) -> np.ndarray:
        total = self.model.prior.astype(np.float64)
        for i in range(0, len(places), TASK_WORDS):
            total = total + self.table[places[i:i + TASK_WORDS]].sum(axis=0, dtype=np.float64)
        return total

    def best(self, total: np.ndarray) -> tuple[str, float]:
        best = int(total.argmax())
        return self.model.languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum())

    def predict(self, text: str) -> tuple[str, float]:
        """The most likely language and its share of the likelihood; ``und`` and 0 for a text without a letter."""
        words = words_of(text)
        return self.best(self.total(words)) if has_letter(words) else ("und", 0.0)


def has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row of ``docs``, from its whole text alone.

    ``und`` with score 0 for a null text, one without a letter, and for all when there is no model. Of languages with
    equal scores the first by name wins. One narrow pass when all that was learned fits the model that is broadcast;
    else the words that are not in it are looked up in all counts.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(docs[key].alias(key), text_or_empty(text).alias("text"))
    local = replace(model, all_words=None, all_grams=None) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(local)
    if model and not model.whole:
        return identify_rare(slim, model, shared, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in pieces(batches):
            found = [scorer.predict(x) if scorer else ("und", 0.0) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], [key, "lang_pred", "score"])

    return slim.mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, lang_pred string, score double")


def identify_rare(slim: DataFrame, model: Model, shared, key: str) -> DataFrame:
    """``identify`` by a join of the words that the broadcast model does not have."""
    kind = slim.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row per document with the score of its words in the model, and its other words with their number; the words
        # of a long text go on in rows without a score.
        scorer, known, task, n = Scorer(shared.value), shared.value.words.get, TaskContext.get().partitionId() << 33, 0
        for batch in pieces(batches):
            ids, at, parts, letters, rest, numbers = [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                words = words_of(text)
                places = list(map(known, words))
                rare = Counter([w for w, p in zip(words, places, strict=True) if p is None])
                total = scorer.total_of([p for p in places if p is not None] if rare else places)
                others = list(rare)
                for j in range(0, max(1, len(others)), TASK_WORDS):
                    ids.append(task + n)
                    at.append(None if j else i)
                    parts.append(None if j else total.tolist())
                    letters.append(has_letter(words))
                    rest.append(" ".join(others[j:j + TASK_WORDS]) or None)
                    numbers.append([rare[w] for w in others[j:j + TASK_WORDS]])
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(parts, pa.list_(pa.float64())), pa.array(letters),
                                              pa.array(rest, pa.string()), pa.array(numbers, pa.list_(pa.int64()))], ["id", "key", "part", "letters", "rest", "numbers"])

    # Ids go by the task, so its partitions must not be put together here.
    heads = checkpointed(slim.mapInArrow(run, f"id long, key {kind}, part array<double>, letters boolean, rest string, numbers array<long>"))
    rare = (heads.filter("rest is not null").select("id", F.explode(F.arrays_zip(F.split("rest", " ").alias("word"), F.col("numbers").alias("n"))).alias("x")).select("id", "x.word", "x.n"))
    sizes = kept(rare.groupBy("word").agg(F.count(F.lit(1)).alias("m")))
    sums = met(rare, rare_scores(sizes.select("word"), model, shared), "word", sizes)
    sums = sums.groupBy("id").agg(F.array(*[F.sum(F.element_at("vec", i + 1) * F.col("n")) for i in range(len(model.languages))]).alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(1, 4)], strict=True)
            found = [scorer.best(np.array(part) + (np.array(more) / FIXED if more else 0.0)) if letters else ("und", 0.0) for part, letters, more in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], [key, "lang_pred", "score"])

    out = heads.filter("part is not null").join(sums, "id", "left").select("key", "part", "letters", "more")
    return few(out).mapInArrow(finish, f"`{key}` {kind}, lang_pred string, score double")


def rare_scores(words: DataFrame, model: Model, shared) -> DataFrame:
    """(word, vec) of different words that the broadcast model does not have: by all word counts, and for words without
    any by all n-gram counts. ``vec`` are scores times ``FIXED``."""
    words = kept(words.join(model.all_words, "word", "left").groupBy("word").agg(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "n"))).alias("by")))

    def open_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, g) for w in batch.column(0).to_pylist() for g in shared.value.open_grams(w)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([g for _, g in pairs], pa.string())], ["word", "gram"])

    unseen = words.filter(F.size("by") == 0).select("word")
    asked = kept(unseen.mapInArrow(open_grams, "word string, gram string"))
    sizes = kept(asked.groupBy("gram").agg(F.count(F.lit(1)).alias("m")))
    by_gram = model.all_grams.join(sizes.select("gram"), "gram", "left_semi").groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
    grams = met(asked, by_gram, "gram", sizes).groupBy("word").agg(F.collect_list(F.struct("gram", "by")).alias("grams"))  # a word has few n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = {lang: i for i, lang in enumerate(own.languages)}

        def table(lists: list[list[dict]]) -> np.ndarray:
            out = np.zeros((len(lists), len(place)))
            for i, by in enumerate(lists):
                for x in by:
                    out[i, place[x["lang"]]] = x["n"]
            return out

        for batch in batches:
            texts, by, found = (batch.column(i).to_pylist() for i in range(3))
            out = relative(table(by), own.word_base).astype(np.float64)
            for i in [i for i, x in enumerate(by) if not x]:
                rows = relative(table([x["by"] for x in found[i]]), own.gram_base) if found[i] else []
                out[i] = own.unseen(texts[i], {x["gram"]: r for x, r in zip(found[i] or [], rows, strict=True)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.rint(out * FIXED).astype(np.int64).tolist(), pa.list_(pa.int64()))], ["word", "vec"])

    return words.join(grams, "word", "left").mapInArrow(run, "word string, vec array<long>")


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learned from rows that are not held out and have a language."""
    train = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select(text_or_empty().alias("text"), "lang")
    with shuffles_removed(docs.sparkSession):
        out = identify(docs, learn(train))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
