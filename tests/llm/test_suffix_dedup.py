import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import suffix_dedup


def brute(rows, length):
    """Sorted (id, bytes, removed, spans, digest) from a table of all strings."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in raw:
        for k in range(len(b) - length + 1):
            count[b[k:k + length]] = count.get(b[k:k + length], 0) + 1
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k + 1:k + 1 + length] = True
        kept = bytes(c for c, g in zip(b, gone[1:], strict=False) if not g)
        out.append((str(i), len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(length):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(length // 2)
    rows = []
    for i in range(120):
        t = text(rng.randint(0, length))
        if i % 3 == 0:
            t = t + " " + passage[:rng.randint(length // 2, len(passage))] + " " + text(10)
        if i % 7 == 0 and rows:
            other = rng.choice(rows)[1]
            cut = rng.randint(0, max(1, len(other)))
            t = other[:cut] + "X" + other[cut:]
        rows.append((i, t))
    rows += [(200, rows[5][1]), (201, None), (202, ""), (203, "a" * (3 * length)), (204, "a" * (length - 1)), (205, "ab" * length), (206, "\x00" * (2 * length)), (None, rows[6][1]), (207, rows[9][1] * 3)]
    return rows


@pytest.mark.parametrize(("hot", "segment"), [(50_000, 1_500_000), (1, 1_500_000), (50_000, 300)])
def test_against_brute_force(spark, monkeypatch, hot, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    monkeypatch.setattr(suffix_dedup, "SORTED", 40)
    rows = corpus(200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.removed(df, suffix_dedup.spans(df, hot=hot))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect())
    assert got == brute(rows, 200)


def test_repeated_rows_and_ids(spark, odd):
    rows = [(1, "x1 " * 90), (1, "x1 " * 90), (2, "y" * 199), (2, "other text"), (None, "z")]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, g long, rid long")
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(df).collect()) == brute(rows, 200)
    assert suffix_dedup.report(df.limit(0)).collect() == []
    assert suffix_dedup.report(odd).count() == odd.count()


def test_multikey_sort():
    rng = np.random.default_rng(1)
    strings = rng.integers(0, 2, (500, 30)).astype(np.uint8)
    strings[:100] = strings[100:200]
    order = suffix_dedup.multikey_sort(strings)
    assert [s.tobytes() for s in strings[order]] == sorted(s.tobytes() for s in strings)
    assert suffix_dedup.ranked(strings[:1])[1].tolist() == [-1]


def test_strings_of_their_own_only():
    none = suffix_dedup.repeated([b"a" * 200], [b""], np.array([0]), np.array([0]), 200, 32)
    apart = suffix_dedup.repeated([b"a" * 200, b"a" * 190], [b"", b"b" * 10], np.array([0, 10]), np.array([0, 10]), 200, 32)
    assert none[0].tolist() == [] and apart[0].tolist() == []
