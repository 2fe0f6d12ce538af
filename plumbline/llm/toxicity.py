"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; each later model also sees the probabilities of the
earlier ones. So that it learns how far to trust them, it is trained with out-of-fold probabilities: those that a model
gives to rows it was not fitted on, with features chosen without them.

Features are the words of a whole text, their beginnings, and the shares of capitals, marks and digits, as presence.
Candidates come from the training sample, drawn class by class; which of them matter is told by counts over every labelled
row and by an effect size, which does not grow with the rows. A link whose out-of-fold probabilities do not part the sides, or
without rows on both sides, rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.base import list_array, pieces, release, small_batches
from plumbline.llm.bitmaps import maybe, within, without
from plumbline.session import checkpointed

#: The chain: columns of the labels table, in order, and the value that means "in the category".
CHAIN = (("quality", 0), ("toxic", 1))
#: A document is rejected when this category reaches the link's threshold, which lies between these.
REJECT, THRESHOLDS = "toxic", (0.2, 0.5)
#: Bytes of a word's beginnings that are features.
PREFIXES = (4, 5, 6)
#: Features that a model has at most, at least, and per training row between them; candidates that are counted for each category; rows
#: a feature must be in.
MAX_FEATURES, MIN_FEATURES, ROWS_PER_FEATURE, CANDIDATES, PRESENT = 2_048, 16, 8, 4_096, 3
#: Training bound: about so many labelled documents fit the linear models, as many of each combination of marks as there is room
#: for, chosen by a hash of their id. Each stands for the rows it was drawn from.
TRAIN_ROWS = 20_000
FOLDS, SKETCH_WORDS = 3, 5
#: A threshold that no probability reaches, and what a real one must show: the share of hits among the rejected.
NEVER, PRECISION = 2.0, 0.8
ITERATIONS, DECAY = 60, 2e-4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the different features of all texts, by text and hash."""
    w = W.split(texts)
    found, owner = [w.hash], [w.text]
    length = w.end - w.start
    low = w.data + (W.CAPITAL[w.data] * 32).astype(np.uint8)
    for n in PREFIXES:
        rows = np.flatnonzero(length > n)
        total = np.zeros(len(rows), np.uint64)
        for k in range(n):
            total = total * W.MULTIPLIER + low[w.start[rows] + k].astype(np.uint64) + np.uint64(1)
        found.append(W.mix(total + np.uint64(n)))
        owner.append(w.text[rows])
    # Shares of capitals, marks and digits among the bytes of a text, on a scale of doublings.
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64)) + 1
    starts = np.append(1, ends[:-1])
    size = np.maximum(ends - starts - 1, 1)
    for n, marks in enumerate((W.CAPITAL, np.arange(256) == 33, np.arange(256) == 124, W.DIGIT)):
        total = np.append(0, np.cumsum(marks[w.data]))
        share = (total[np.minimum(ends, len(w.data))] - total[starts]) / size
        level = np.floor(np.log2(share + 2.0 ** -9) + 9).astype(np.uint64)
        found.append(W.mix(level + np.uint64(1000 + 100 * n)))
        owner.append(np.arange(len(texts)))
    h, o = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], o[new]


def folds(texts: list[bytes]) -> np.ndarray:
    """A fold for every text, by the least hash of its runs of words, so that near copies mostly share a fold."""
    w = W.split(texts)
    at, run = W.windows(w.hash, w.text, SKETCH_WORDS)
    least = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, w.text, W.mix(w.hash ^ np.uint64(1)))
    if len(at):
        long = w.counts >= SKETCH_WORDS
        least[long] = np.iinfo(np.uint64).max
        np.minimum.at(least, w.text[at], run)
    return (W.mix(least) % np.uint64(FOLDS)).astype(np.int32)


def effect(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> np.ndarray:
    """The size of the correlation of presence and category, less half a row on either side: ``a`` of ``n_a`` rows in the
    category and ``b`` of ``n_b`` others have the feature."""
    n, present = n_a + n_b, a + b
    below = present * (n - present) * float(n_a) * float(n_b)
    return np.where(below > 0, np.maximum(0.0, abs(a * (n_b - b) - b * (n_a - a)) - n / 2) / np.sqrt(np.maximum(below, 1e-300)), 0.0)


@dataclass
class Link:
    """One model of the chain: feature hashes (ascending) with weights, weights of the earlier categories, intercept,
    and the probability from which on a text counts as in the category."""

    name: str
    hashes: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float
    threshold: float = THRESHOLDS[1]


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(row: np.ndarray, col: np.ndarray, width: int, extra: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on presence features (row, col) and dense ``extra`` columns, rows weighted, by L-BFGS with halved steps."""
    weight = weight / max(1e-300, weight.sum())
    ridge = np.append(np.full(width + extra.shape[1], DECAY), 0.0)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        z = score(row, col, len(y), extra, theta, width)
        error = (sigmoid(z) - y) * weight
        g = np.concatenate([np.bincount(col, weights=error[row], minlength=width), extra.T @ error, [error.sum()]])
        return float(weight @ (np.logaddexp(0, z) - y * z)) + 0.5 * float(ridge @ theta ** 2), g + ridge * theta

    theta = np.zeros(width + extra.shape[1] + 1)
    f, g = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ITERATIONS):
        q, weights = g.copy(), []
        for s, t in reversed(past):
            weights.append((s @ q) / (s @ t))
            q -= weights[-1] * t
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, t), w in zip(past, reversed(weights), strict=True):
            q += (w - (t @ q) / (s @ t)) * s
        step = 1.0
        while (new := loss(theta - step * q))[0] > f - 1e-4 * step * float(g @ q) and step > 1e-6:
            step /= 2
        s, t = -step * q, new[1] - g
        if f - new[0] < 1e-9:
            break
        theta, f, g = theta + s, *new
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t)]
    return theta[:width], theta[width:-1], float(theta[-1])


def score(row, col, n, extra, theta, width) -> np.ndarray:
    return np.bincount(row, weights=theta[col], minlength=n) + extra @ theta[width:-1] + theta[-1]


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, precision: float = 0.0) -> float:
    """The cut of out-of-fold probabilities with the best F1 among those of at least that precision, midway in log odds between
    the two it parts; ``NEVER`` if there is none."""
    weight = np.ones(len(p)) if weight is None else weight
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    hits = np.cumsum(y * weight)
    f1 = 2 * hits / (np.cumsum(weight) + hits[-1])
    f1[:-1][p[:-1] == p[1:]] = 0  # equal probabilities are not parted
    f1[hits < precision * np.cumsum(weight)] = 0
    if not f1.any():
        return NEVER
    at = len(f1) - 1 - int(f1[::-1].argmax())
    below = p[at + 1] if at + 1 < len(p) else p[at] / 2
    return float(np.clip(sigmoid((logit(p[at]) + logit(below)) / 2), *THRESHOLDS))


def safe_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """``best_threshold`` if what it rejects is mostly in the category, and surely (by two deviations) more often than all rows; else ``NEVER``."""
    cut = best_threshold(p, y, weight, PRECISION)
    over = p >= cut
    if not over.any():
        return NEVER
    share, found, n = float(weight @ y / weight.sum()), float(weight[over] @ y[over] / weight[over].sum()), int(over.sum())
    low = (found + 2 / n - 2 * (found * (1 - found) / n + 1 / n ** 2) ** 0.5) / (1 + 4 / n)
    return cut if low > share else NEVER


def marked(labels: DataFrame, chain=CHAIN) -> DataFrame:
    """(doc_id, y0, y1, ...): 1 and 0 tell whether the document is in a category, null is unknown. Labels that contradict each
    other count as in the category."""
    marks = labels.groupBy("doc_id").agg(*[F.max((F.col(c) == v).cast("int")).alias(f"y{i}") for i, (c, v) in enumerate(chain)])
    return checkpointed(marks.filter(F.col("doc_id").isNotNull() & F.coalesce(*[F.col(f"y{i}") for i in range(len(chain))]).isNotNull()))


def drawn(docs: DataFrame, marks: DataFrame, categories: int, train_rows: int) -> DataFrame:
    """(doc_id, text, y0, ..., weight): the training sample. Every combination of marks has room for the same number of rows."""
    names = [f"y{i}" for i in range(categories)]
    sizes = marks.groupBy(*names).count().collect()  # a row per combination of marks
    room = train_rows / max(1, len(sizes))
    share = F.lit(1.0)
    for r in sizes:
        same = [F.col(c).eqNullSafe(F.lit(r[c])) for c in names]
        share = F.when(reduce(lambda a, b: a & b, same), min(1.0, room / r["count"])).otherwise(share)
    some = marks.withColumn("weight", 1 / share).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return checkpointed(within(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), some.select("doc_id")).join(some, "doc_id"))


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in batch.column(batch.schema.get_field_index("text"))]


def marks_of(batch: pa.RecordBatch, categories: int) -> np.ndarray:
    return np.stack([pa.compute.fill_null(batch.column(batch.schema.get_field_index(f"y{i}")), -1).to_numpy() for i in range(categories)])


def candidates(sample: DataFrame, categories: int) -> np.ndarray:
    """Hashes, ascending, of the features of greatest effect within the sample: at most ``CANDIDATES`` per category."""
    sides = sample.agg(*[F.sum(F.when(F.col(f"y{i}") == v, F.col("weight"))).alias(f"n{i}{v}") for i in range(categories) for v in (1, 0)]).first()
    names = [f"c{k}" for k in range(2 * categories)]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            different, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            every = np.concatenate([c for _, c in held], axis=1)
            return different, np.stack([np.bincount(at, weights=c, minlength=len(different)) for c in every])

        for batch in pieces(batches, limit=W.BLOCK_BYTES):
            h, o = features(texts_of(batch))
            y, weight = marks_of(batch, categories), batch.column(batch.schema.get_field_index("weight")).to_numpy()
            held.append((h, np.stack([np.ones(len(h)), *[(y[i][o] == v) * weight[o] for i in range(categories) for v in (1, 0)]])))
            if sum(len(h) for h, _ in held[1:]) > 150_000:
                held = [added()]
        if held:
            h, total = added()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, total)], ["h", "n", *names])

    sums = sample.select("text", "weight", *[f"y{i}" for i in range(categories)]).mapInArrow(counts, f"h long, n double, {', '.join(f'{c} double' for c in names)}")
    sums = sums.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).filter(F.col("n") >= PRESENT)
    found = []
    for i in range(categories):
        n_a, n_b = (float(sides[f"n{i}{v}"] or 0) for v in (1, 0))
        if n_a and n_b:
            a, b = F.col(f"c{2 * i}"), F.col(f"c{2 * i + 1}")
            below = (a + b) * (F.lit(n_a + n_b) - a - b)
            size = F.when(below > 0, F.abs(a * (F.lit(n_b) - b) - b * (F.lit(n_a) - a)) / F.sqrt(below)).otherwise(0.0)
            found.append(sums.withColumn("x", size).filter("x > 0").orderBy(F.desc("x"), "h").limit(CANDIDATES).select("h"))
    rows = reduce(DataFrame.union, found).distinct().collect() if found else []  # at most CANDIDATES per category
    return np.sort(np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64))


def counted(docs: DataFrame, marks: DataFrame, wanted: np.ndarray, categories: int) -> np.ndarray:
    """Rows by [category, side (in, out), fold, feature] over all labelled documents; the last feature stands for every document.
    Documents travel as lists of the candidates they hold."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # bounded by CANDIDATES
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    kept = maybe(slim, F.xxhash64("doc_id"), marks.select(F.xxhash64("doc_id").alias("h")), "h", "__maybe").filter("__maybe").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=W.BLOCK_BYTES):
            texts = texts_of(batch)
            row, col = presence(texts, shared.value)
            row, col = np.append(row, np.arange(len(texts))), np.append(col, np.full(len(texts), len(shared.value)))
            order = np.argsort(row, kind="stable")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folds(texts)), list_array(col[order], np.bincount(row, minlength=len(texts)), pa.int32())], ["doc_id", "fold", "x"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    lists = kept.mapInArrow(run, f"doc_id {kind}, fold int, x array<int>").join(marks, "doc_id")
    names = [(i, v) for i in range(categories) for v in (1, 0)]
    sums = lists.select("fold", F.explode("x").alias("x"), *[(F.col(f"y{i}") == v).cast("long").alias(f"c{i}{v}") for i, v in names]).groupBy("fold", "x").agg(*[F.sum(f"c{i}{v}").alias(f"c{i}{v}") for i, v in names])
    out = np.zeros((categories, 2, FOLDS, len(wanted) + 1))
    for r in sums.collect():  # at most FOLDS rows per candidate
        for i, v in names:
            out[i, 1 - v, r["fold"], r["x"]] = r[f"c{i}{v}"] or 0
    return out


def strongest(counts: np.ndarray, rows: int) -> np.ndarray:
    """Which features a model of so many training rows uses; ``counts`` by [side, feature], the last one for all rows."""
    a, b = counts[0, :-1], counts[1, :-1]
    size = np.where(a + b >= PRESENT, effect(a, b, counts[0, -1], counts[1, -1]), 0.0)
    best = np.argsort(-size, kind="stable")[:min(MAX_FEATURES, max(MIN_FEATURES, rows // ROWS_PER_FEATURE))]
    out = np.zeros(len(a), bool)
    out[best[size[best] > 0]] = True
    return out


def presence(texts: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) where one of ``hashes`` is a feature of the text."""
    h, o = features(texts)
    at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
    hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
    return o[hit], at[hit]


def learn(docs: DataFrame, labels: DataFrame, chain=CHAIN, train_rows: int = TRAIN_ROWS) -> list[Link]:
    """The chain, from labelled documents. A category without rows on both sides gets a constant model that rejects nothing."""
    small_batches(docs.sparkSession)
    categories = len(chain)
    marks = marked(labels, chain)
    sample = drawn(docs, marks, categories, train_rows)
    wanted = candidates(sample, categories)
    counts = counted(docs, marks, wanted, categories)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    given = ["doc_id", "weight", *[f"y{i}" for i in range(categories)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=W.BLOCK_BYTES):
            texts = texts_of(batch)
            row, col = presence(texts, shared.value)
            order = np.argsort(row, kind="stable")
            columns = [batch.column(batch.schema.get_field_index(c)) for c in given]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(folds(texts)), list_array(col[order], np.bincount(row, minlength=len(texts)), pa.int32())], [*given, "fold", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, weight double, {', '.join(f'y{i} int' for i in range(categories))}, fold int, x array<int>")
    got = got.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id", "fold", "x").toArrow()  # bounded by train_rows and CANDIDATES
    values = {c: got.column(c).to_pandas().to_numpy(dtype=float, na_value=np.nan) for c in got.column_names if c not in ("doc_id", "x")}
    lists = got.column("x").combine_chunks()
    row = np.repeat(np.arange(len(got)), np.diff(lists.offsets.to_numpy())).astype(np.int32)
    col = lists.flatten().to_numpy()
    del lists
    n, fold, weight = len(got), values["fold"], values["weight"]
    links, earlier = [], np.zeros((n, 0))
    for i, (name, _) in enumerate(chain):
        y = values[f"y{i}"]
        known = ~np.isnan(y)

        def model(train: np.ndarray, use: np.ndarray) -> np.ndarray:
            """Coefficients by candidate, 0 where it is not used, of the earlier links, and the intercept, fitted on the rows marked in ``train``."""
            number, place = np.cumsum(train) - 1, np.cumsum(use) - 1
            inside = train[row] & use[col]
            w, e, b = fit(number[row[inside]], place[col[inside]], int(use.sum()), earlier[train], y[train], weight[train])
            full = np.zeros(len(wanted))
            full[use] = w
            return np.concatenate([full, e, [b]])

        parts = [known & (fold != k) for k in range(FOLDS)]
        if not all(0 < y[part].sum() < part.sum() for part in (known, *parts)):
            total = counts[i, :, :, -1].sum(axis=1)
            level = logit(np.array([total[0] / max(1, total.sum())]))[0]
            links.append(Link(name, np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), float(level), NEVER))
            earlier = np.column_stack([earlier, np.full(n, level)])
            continue
        use = strongest(counts[i].sum(axis=1), int(known.sum()))
        theta = model(known, use)
        links.append(Link(name, wanted[use], theta[:len(wanted)][use], theta[len(wanted):-1], float(theta[-1])))
        out = np.zeros(n)
        for k, part in enumerate(parts):
            others = strongest(np.delete(counts[i], k, axis=1).sum(axis=1), int(part.sum()))
            out[fold == k] = sigmoid(score(row, col, n, earlier, model(part, others), len(wanted)))[fold == k]
        links[-1].threshold = safe_threshold(out[known], y[known], weight[known])
        earlier = np.column_stack([earlier, logit(out)])
    return links


def predict(docs: DataFrame, links: list[Link], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, p_<category>...) of every row, from its whole text; a null text is empty. One narrow pass."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(links)  # bounded by MAX_FEATURES per category
    slim = docs.select(F.col(key).alias(key), F.coalesce(text, F.lit("")).alias("text"))
    names = [f"p_{link.name}" for link in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.unique(np.concatenate([link.hashes for link in shared.value]))
        weights = []
        for link in shared.value:
            w = np.zeros(len(every))
            w[np.searchsorted(every, link.hashes)] = link.weights
            weights.append(w)
        for batch in pieces(batches, limit=W.BLOCK_BYTES):
            texts = texts_of(batch)
            row, col = presence(texts, every)
            earlier = np.zeros((len(texts), 0))
            out = []
            for link, w in zip(shared.value, weights, strict=True):
                p = sigmoid(np.bincount(row, weights=w[col], minlength=len(texts)) + earlier @ link.earlier + link.intercept)
                out.append(p)
                earlier = np.column_stack([earlier, logit(p)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], [key, *names])

    return slim.mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, {', '.join(f'{n} double' for n in names)}")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_quality, p_toxic, kept) of every row of ``docs``; p_quality is the probability of low quality.

    Without labels on both sides, or where they cannot be told apart, nothing is rejected. Rows that share an id share its label.
    """
    links = learn(docs, labels)
    release()  # the training rows
    limit = next(link.threshold for link in links if link.name == REJECT)
    return predict(docs, links).withColumn("kept", F.col(f"p_{REJECT}") < limit)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without its toxic rows. Rows without an id cannot be named and stay; rows that share one go together."""
    return without(docs, checkpointed(report(docs, labels).filter("not kept and doc_id is not null").select("doc_id").distinct()))


