import re

import numpy as np
import pytest

from plumbline.llm import dartminhash

WORD = re.compile(r"\w+")


def brute(rows):
    """id -> class by all pairs of shingle sets."""
    sets, root = {}, {}
    for i, text in rows:
        words = WORD.findall((text or "").lower())
        sets[i] = ({tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()), text
        root[i] = i

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            (x, s), (y, t) = sets[a], sets[b]
            if s is not None and t is not None and (s == t or x and y and len(x & y) >= 0.8 * len(x | y)):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("weighted", [False, True])
def test_shared_coordinates_estimate_similarity(weighted):
    rng = np.random.default_rng(0)
    off = []
    for _ in range(40):
        a = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
        b = a.copy()
        b[:60] = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
        w = rng.integers(1, 9, 200).astype(float) if weighted else None
        true = 140 / 260 if w is None else w[60:].sum() / (w[60:].sum() + 2 * w[:60].sum())
        s = dartminhash.throw(np.concatenate([a, b]), np.repeat([0, 1], 200), None if w is None else np.concatenate([w, w]), 2, 240)
        off.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(off)) < 0.015
    empty = dartminhash.throw(np.zeros(0, np.uint64), np.zeros(0, np.int64), None, 2, 8)
    assert (empty == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def corpus():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(800)]
    passage = " ".join(rng.choice(vocabulary, 60))
    rows = []
    for i in range(260):
        words = list(rng.choice(vocabulary, int(rng.integers(6, 120))))
        if i % 4 == 1:
            words = WORD.findall(rows[int(rng.integers(0, i))][1])
            for k in rng.integers(0, len(words), max(1, len(words) // 60)):
                words[k] = "changed"
        text = " ".join(words)
        rows.append((i, text + " " + passage if i % 5 == 0 else text))
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, ""), (303, ""), (304, None), (305, None), (306, "one two"), (307, "One, two!"), (308, "...")]
    return rows


@pytest.mark.parametrize("chunk", [1_000, 3])
def test_classes_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(dartminhash, "CHUNK", chunk)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id long, h long")
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_odd_rows_and_one_of_each_class(odd):
    rows = dartminhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and all(r.kept for r in rows)
    kept = dartminhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted({str(r.doc_id) for r in odd.collect()})
    assert dartminhash.keep_one(odd.limit(0)).collect() == []


def test_counted_shingles(spark):
    a, b = "a b c d e f", " ".join(["a b c d e f"] * 6)
    df = spark.createDataFrame([(1, b), (2, b + " g"), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in dartminhash.near_duplicates(df, weighted=True).collect()} == {1: 1, 2: 1, 3: 3}
