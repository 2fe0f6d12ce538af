"""Personal data by a skip-chain conditional random field over whole documents.

Base patterns find emails, ip addresses, card and phone numbers; those stay, each is one observed node of the field. So
is every run of numbers joined by blanks, dots, hyphens and brackets, and every other token that carries a digit or an at
sign. The field has a kind of its own, secrets, and learns it and further phone numbers from weak sources: forms and key words in front, which
are labels of the sample only and never of the documents judged. Neighbouring nodes share chain potentials, and equal or similar tokens anywhere in
the document share skip potentials, so that a value recognised once is recognised where its form alone says too
little. Loopy message passing over all documents of a batch at once gives the marginals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.base import pieces, small_batches, text_or_empty, texts_of

# The kinds of base spans in their order, and their patterns as the contract states them (with possessive
# repeats, which match the same).
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
RUN = re.compile(r"\+?\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++")
GROUP = re.compile(r"[0-9]+")
MARK = re.compile(r"[0-9@]\S*")
EDGE = ".,;:!?\"'()[]{}<>|#$%&*"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d > "4") for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from their at signs, so that long runs of letters cost no more than others."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        head = text[last:at]
        start = last + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind in the order of ``KINDS``; matches that fail a check are dropped without retry."""
    out = emails(text)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = NOT_DIGITS.sub("", m.group()) if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
                    out.append(("phone", *m.span()))
        out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


# ---- the field -------------------------------------------------------------------------------------------------------

#: Kinds that only the field adds, after the base kinds in every order.
ADDED = ("secret",)
LABELS = ("none", *KINDS, *ADDED)
#: Weak sources: key words that stand in front of a secret, and a phone number's usual form with a prefix.
KEY = re.compile(r"(?:token|secret|key|passwd|password|pwd|auth|bearer|credentials?)[\"']?\s*[:=]\s*[\"']?$", re.IGNORECASE)
SECRET = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
NATIONAL = re.compile(r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])")
#: Bits a character of a secret carries at least.
ENTROPY = 2.8
#: Hashed unary features.
FEATURES = 1 << 12
#: Training bound: so many documents, chosen by a hash of their text, and so many nodes of them.
TRAIN_DOCUMENTS, TRAIN_NODES = 4_000, 40_000
EPOCHS, RATE, DECAY = 200, 0.5, 1e-4
#: Prior means of the agreement of equal and of similar tokens; repeats are rare, so a small sample says little of them.
AGREE = (0.0, 2.5, 0.8)
ROUNDS, DAMP = 8, 0.3
#: A span is added when its marginal probability reaches this.
SURE = 0.9
#: Nodes of a document that one message-passing block holds; a longer document continues in the next block, whose first
#: nodes keep their skip neighbours within it.
BLOCK_NODES = 50_000


@dataclass
class Field:
    """Weights: unary (feature x label), chain (label x label), and how strongly equal and similar tokens agree."""

    unary: np.ndarray
    chain: np.ndarray
    same: float
    similar: float


def shape(token: str) -> str:
    """9 for digits, a for letters, other characters as they are; repeats of a class collapse to its length class."""
    out = re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", token))
    return re.sub(r"(.)\1+", lambda m: m.group(1) + ("+" if len(m.group()) < 4 else "#" if len(m.group()) < 14 else "*"), out)[:24]


def entropy(token: str) -> float:
    """Bits a character, by the frequencies within the token."""
    counts = np.unique(np.frombuffer(token.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def weak_label(text: str, start: int, end: int) -> int:
    """What form and key words in front say of a token that is no base span."""
    token = text[start:end]
    if NATIONAL.fullmatch(token):
        return LABELS.index("phone")
    if SECRET.fullmatch(token) and KEY.search(text[max(0, start - 24):start]) and entropy(token) >= ENTROPY:
        return LABELS.index("secret")
    return 0


def features(text: str, start: int, end: int) -> list[int]:
    """Hashed form and context features of a token."""
    token = text[start:end]
    digits = sum(c.isdigit() for c in token)
    before = text[max(0, start - 24):start].split()
    after = text[end:end + 24].split()
    names = (f"s={shape(token)}", f"d={min(digits, 20)}", f"n={min(len(token), 30)}", f"@={'@' in token}", f".={min(token.count('.'), 5)}", f"+={token[0] == '+'}",
             f"-={min(token.count('-'), 4)}", f"b={before[-1][-12:].lower() if before else ''}", f"B={shape(before[-1]) if before else ''}", f"A={shape(after[0]) if after else ''}",
             f"k={bool(KEY.search(text[max(0, start - 24):start]))}", f"e={min(int(entropy(token) * 2), 12) if len(token) >= 16 and SECRET.fullmatch(token) else -1}",
             f"N={bool(NATIONAL.fullmatch(token))}", "1")
    return [crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]


def keys(token: str) -> tuple[str, str]:
    """What equal and similar tokens have in common: the digits, or the lower-case text; and its leading part."""
    digits = NOT_DIGITS.sub("", token)
    if "@" in token:
        local, _, domain = token.lower().partition("@")
        return token.lower(), "@" + domain
    if "." in token and token.count(".") >= 3:
        return token, token.rpartition(".")[0]
    return (digits, digits[:8]) if len(digits) >= 8 else (token.lower(), "")


@dataclass
class Graph:
    """Nodes of many documents and the edges (i < j) between them, with their type: 0 chain, 1 equal, 2 similar."""

    doc: list[int]
    start: list[int]
    end: list[int]
    feats: list[list[int]]
    label: list[int]
    edges: list[tuple[int, int, int]]


def values(token: str) -> list[str]:
    """All that an equal token may have in common with this one: a number also without its country prefix, which has one
    to three digits after a plus, or without leading zeros."""
    equal = keys(token)[0]
    digits = NOT_DIGITS.sub("", token)
    if "@" in token or token.count(".") >= 3 or len(digits) < 8:
        return [equal]
    shorter = [digits[k:] for k in (1, 2, 3)] if token.startswith("+") else [digits.lstrip("0")]
    return list(dict.fromkeys([equal, *[x for x in shorter if len(x) >= 8]]))


def number_runs(text: str, known: set[str]) -> Iterator[tuple[int, int]]:
    """Runs of at least six digits in two or more groups. Groups that together are a ``known`` value are a run of their own."""
    for m in RUN.finditer(text):
        groups = [g.span() for g in GROUP.finditer(text, m.start(), m.end())]
        cuts, i, begin = [], 0, 0
        if text[m.start()] == "+" and (whole := NATIONAL.match(text, m.start())):  # what follows is another number
            i = begin = sum(s < whole.end() for s, _ in groups)
            yield whole.span()
        while i < len(groups):
            digits, found = "", None
            for j in range(i, len(groups) if known else i):
                digits += text[groups[j][0]:groups[j][1]]
                if len(digits) > 22:
                    break
                if digits in known or digits.lstrip("0") in known:
                    found = j + 1
            if found:
                cuts += [(begin, i), (i, found)]
                begin = i = found
            else:
                i += 1
        for i, j in [*cuts, (begin, len(groups))]:
            if i < j and sum(e - s for s, e in groups[i:j]) >= 6 and j - i > 1:
                start, least = groups[i][0], groups[i - 1][1] if i else m.start()
                while start > least and text[start - 1] in "+(":
                    start -= 1
                yield start, groups[j - 1][1]


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """(start, end, label) of the nodes of a text in order, without overlaps: base spans, number runs, other tokens."""
    out: list[tuple[int, int, int]] = []
    for kind, start, end in base:
        if not out or start >= out[-1][1]:
            out.append((start, end, LABELS.index(kind)))
    known = {v for a, b, label in out if label > 2 for v in values(text[a:b])}
    taken = out

    def free(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int, int]]:
        b, fresh = 0, []
        for start, end in spans:
            while b < len(taken) and taken[b][1] <= start:
                b += 1
            if b == len(taken) or taken[b][0] >= end:
                fresh.append((start, end, 0))
        return sorted(taken + fresh)

    def tokens() -> Iterator[tuple[int, int]]:
        done = 0
        for m in MARK.finditer(text):
            head = m.start()
            while head > done and not text[head - 1].isspace():
                head -= 1
            done = m.end()
            raw = text[head:done]
            token = raw.strip(EDGE)
            if token and (len(token) >= 6 or "@" in token):
                yield head + raw.index(token), head + raw.index(token) + len(token)

    taken = free(number_runs(text, known))
    return free(tokens())


def graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    """Nodes and edges. A repeated value links each occurrence with the one before, so edges grow with the nodes."""
    g = Graph([], [], [], [], [], [])
    for d, text in enumerate(texts):
        last_key: dict[str, int] = {}
        for start, end, label in candidates(text, spans[d]):
            token = text[start:end]
            i = len(g.doc)
            if i and g.doc[-1] == d and not text[g.end[-1]:start].strip():
                g.edges.append((i - 1, i, 0))
            equal, like = values(token), keys(token)[1]
            linked = {h for x in equal if (h := last_key.get("=" + x)) is not None}
            g.edges += [(h, i, 1) for h in sorted(linked)]
            if like and (h := last_key.get("~" + like)) is not None and h not in linked and keys(text[g.start[h]:g.end[h]])[0] != equal[0]:
                g.edges.append((h, i, 2))
            last_key |= {"=" + x: i for x in equal}
            if like:
                last_key["~" + like] = i
            g.doc.append(d)
            g.start.append(start)
            g.end.append(end)
            g.feats.append(features(text, start, end))
            g.label.append(label)
    return g


def train(rows: list[tuple[list[int], int, list[tuple[int, int]]]]) -> Field:
    """Pseudo-likelihood: each label given its form and the labels of its neighbours, by gradient descent.

    ``rows``: features, label, and (edge type, neighbour's label). Without any row the field adds nothing.
    """
    k = len(LABELS)
    unary, chain, agree = np.zeros((FEATURES, k)), np.zeros((k, k)), np.array(AGREE)
    if not rows:
        unary[:, 0] = 5.0
        return Field(unary, chain, 0.0, 0.0)
    width = len(rows[0][0])
    x = np.array([r[0] for r in rows]).reshape(len(rows), width)
    y = np.array([r[1] for r in rows])
    near = np.array([(i, t, lab) for i, r in enumerate(rows) for t, lab in r[2]], dtype=np.int64).reshape(-1, 3)
    target = np.eye(k)[y]
    # A rare label weighs as much as a common one up to a factor, as most nodes are none.
    counts = np.bincount(y, minlength=k)
    weight = np.minimum(20.0, np.sqrt(counts.max() / np.maximum(counts, 1)))[y][:, None]
    links = near[near[:, 1] == 0]
    skips = near[near[:, 1] > 0]
    for _ in range(EPOCHS):
        score = unary[x].sum(axis=1)
        np.add.at(score, links[:, 0], chain[links[:, 2]])
        np.add.at(score, (skips[:, 0], skips[:, 2]), agree[skips[:, 1]])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (target - p) * weight / weight.sum()
        step = np.zeros_like(unary)
        np.add.at(step, x.ravel(), np.repeat(error, width, axis=0))
        unary += RATE * (10 * step - DECAY * unary)
        move = np.zeros_like(chain)
        np.add.at(move, links[:, 2], error[links[:, 0]])
        chain += RATE * (10 * (move + move.T) / 2 - DECAY * chain)
        agree += RATE * (10 * np.bincount(skips[:, 1], weights=error[skips[:, 0], skips[:, 2]], minlength=3) - DECAY * (agree - np.array(AGREE)))
    # Agreement can only help; a negative weight comes from chance in the sample.
    return Field(unary, chain, float(max(0.0, agree[1])), float(max(0.0, agree[2])))


def neighbours(g: Graph) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in g.doc]
    for i, j, t in g.edges:
        out[i].append((t, g.label[j]))
        out[j].append((t, g.label[i]))
    return out


def marginals(g: Graph, field: Field) -> np.ndarray:
    """Node marginals by damped sum-product messages; nodes with a base label are observed."""
    n, k = len(g.doc), len(field.chain)
    label = np.array(g.label)
    score = field.unary[np.array(g.feats)].sum(axis=1)
    score[label > 0] = -50.0
    score[label > 0, label[label > 0]] = 0.0
    score -= score.max(axis=1, keepdims=True)
    if g.edges:
        e = np.array(g.edges)
        potential = np.stack([field.chain, np.eye(k) * field.same, np.eye(k) * field.similar])[e[:, 2]]
        a, b = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])  # messages a -> b
        potential = np.exp(np.concatenate([potential, potential.transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
        message = np.zeros((len(a), k))
        for _ in range(ROUNDS):
            belief = score.copy()
            np.add.at(belief, b, message)
            out = belief[a] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", out, potential) + 1e-300)
            new -= new.max(axis=1, keepdims=True)
            message = DAMP * message + (1 - DAMP) * new
        np.add.at(score, b, message)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return (p / p.sum(axis=1, keepdims=True)).reshape(n, k)


def all_spans(texts: list[str], field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and base and added spans, of every text; added spans never overlap base ones."""
    base = [base_spans(t) for t in texts]
    full = [list(b) for b in base]
    start = 0
    while start < len(texts):  # blocks of whole documents
        stop, load = start, 0
        while stop < len(texts) and (stop == start or load < BLOCK_NODES):
            load += texts[stop].count("@") + len(texts[stop]) // 400
            stop += 1
        g = graph(texts[start:stop], base[start:stop])
        if g.doc:
            p = marginals(g, field)
            best = p[:, 1:].argmax(axis=1) + 1
            for i in np.flatnonzero((np.array(g.label) == 0) & (p[np.arange(len(best)), best] >= SURE)).tolist():
                token = texts[start + g.doc[i]][g.start[i]:g.end[i]]
                if LABELS[best[i]] != "card" or luhn(NOT_DIGITS.sub("", token)):
                    full[start + g.doc[i]].append((LABELS[best[i]], g.start[i], g.end[i]))
        start = stop
    for f in full:
        f.sort(key=lambda s: (s[1], LABELS.index(s[0]), s[2]))
    return base, full


def learn(docs: DataFrame, text: str = "text", documents: int = TRAIN_DOCUMENTS, nodes: int = TRAIN_NODES) -> Field:
    """The field, fitted on a bounded sample: about ``documents`` different texts, chosen by hash, among those with an at sign, or
    six digits, a number in groups or a long run of letters and digits, and at most ``nodes`` of their nodes. Base spans and weak
    sources are its labels."""
    small_batches(docs.sparkSession)
    sample = (docs.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9]{6}|@|[0-9]{3}[ -][0-9]{4}|[0-9A-Fa-f]{20}")).withColumn("h", F.xxhash64("text")))
    # The cut is a hash value, found from counts, so no text is sorted or sent before it is chosen.
    # Copies of a text count once, in the cut and in the sample.
    n = sample.select("h").distinct().count()
    if n > documents:
        sample = sample.filter(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * documents / n))
    sample = sample.dropDuplicates(["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = texts_of(batch)
            g = graph(texts, [base_spans(t) for t in texts])
            g.label = [y or weak_label(texts[d], a, b) for y, d, a, b in zip(g.label, g.doc, g.start, g.end, strict=True)]
            equal = [(i, j) for i, j, t in g.edges if t == 1]
            for i, j in [*equal, *reversed(equal)]:  # a value told once is told wherever it stands in the document
                g.label[i], g.label[j] = g.label[i] or g.label[j], g.label[j] or g.label[i]
            near = neighbours(g)
            yield pa.RecordBatch.from_arrays([pa.array(g.feats, pa.list_(pa.int32())), pa.array(g.label, pa.int32()), pa.array([[t for t, _ in x] for x in near], pa.list_(pa.int32())),
                                              pa.array([[y for _, y in x] for x in near], pa.list_(pa.int32()))], ["x", "y", "t", "l"])

    rows = sample.select("text").mapInArrow(run, "x array<int>, y int, t array<int>, l array<int>")
    got = rows.orderBy(F.xxhash64("x", "y", "t", "l"), "y").limit(nodes).collect()
    return train([(r["x"], r["y"], list(zip(r["t"], r["l"], strict=True))) for r in got])


def find(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``base`` and ``spans``, arrays of (kind, start, end) in code points, end
    exclusive. A null or empty text has none. One narrow pass; the field is broadcast and has a fixed size."""
    small_batches(docs.sparkSession)
    docs = docs.drop("base", "spans")
    kept = [c for c in docs.columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            columns = [pa.array([[{"kind": a, "start": b, "stop": c} for a, b, c in row] for row in found], kind) for found in all_spans(texts_of(batch, text), shared.value)]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *columns], [*kept, "base", "spans"])

    return docs.mapInArrow(run, docs.select(*kept).schema.add("base", span).add("spans", span))


def joined(column: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row; the counts of kinds are those of base
    spans, ``n_spans`` counts all, those that the field adds included."""
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    found = find(slim, learn(slim), keep=["doc_id"])
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of its text replaced by ``[KIND]`` and ``n_chars``, if there, as the new length.

    A null text stays null. Overlapping spans are replaced together, under the kind of the first.
    """
    small_batches(docs.sparkSession)
    shared, schema = docs.sparkSession.sparkContext.broadcast(field), docs.schema

    def clean(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for kind, start, stop in spans:
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, stop)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = texts_of(batch)
            _, spans = all_spans(texts, shared.value)
            new = [clean(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            i = batch.schema.get_field_index("text")
            valid = batch.column(i).is_valid().to_pylist()
            columns = list(batch.columns)
            columns[i] = pa.array([x if v else None for x, v in zip(new, valid, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(schema["n_chars"].dataType))
    return out
