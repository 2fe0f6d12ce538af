from collections import Counter
from hashlib import sha256
from math import floor, isfinite

import numpy as np
import pytest

from plumbline.llm import vector_codes as vc

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract's columns with plain Python numbers; rows are (vec_id, vector, label) of one length."""
    kept = [(i, [floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    d = len(kept[0][1]) // 4
    cut = [[v[p * d:(p + 1) * d] for _, v, _ in kept] for p in range(4)]
    ids = sorted((i, n) for n, (i, _, _) in enumerate(kept) if i is not None)[:256]
    books = [[cut[p][n] for _, n in ids] for p in range(4)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            held = {}
            for v in cut[p]:
                held.setdefault(nearest(v, books[p])[1], []).append(v)
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    found = [[nearest(cut[p][n], books[p]) for p in range(4)] for n in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in found]
    per = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        per[lab] += e
    told = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, per[lab], told) for (i, _, lab), f, e in zip(kept, found, errors, strict=True))


def got(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.report(df).collect())


def vectors(n=420, d=8, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d)) * 0.3
    rows = [(int(i), (centres[i % 12] + rng.standard_normal(d) * (0.01 if i % 3 else 0.3)).astype(np.float32).tolist(), int(i % 4) if i % 5 else None)
            for i in rng.permutation(n) * 3 - 100]
    return rows + [(9000 + k, rows[7][1], 1) for k in range(40)]


def test_codes_against_brute_force(spark):
    odd = [(-500, None, 1), (-501, [float("nan")] + [0.0] * 7, 1), (-502, [None] + [1.0] * 7, 2), (-503, [float("inf")] * 8, 2), (None, [0.1] * 8, 3), (None, [0.2] * 8, None)]
    rows = vectors() + odd
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], KIND + ", code string, error int").repartition(5)
    assert got(df) == brute(rows)


def test_given_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_few_repeated_and_large(spark):
    rows = [(3, [1.0, 2.0, 3.0, 4.0], None), (3, [1.0, 2.0, 3.0, 4.0], None), (4, [-1.0, 0.5, 9.0, 4.0], None)]
    small = [r for r in vc.report(spark.createDataFrame(rows, KIND)).collect()]
    assert [(r.vec_id, r.error, r.label_error) for r in sorted(small, key=lambda r: r.vec_id)] == [(3, 0, 0), (3, 0, 0), (4, 0, 0)]
    far = [(1, [3e38, 0.0, 1e30, -3e38], 0), (2, [0.0] * 4, 0), (3, [1e9, -1e9, 5.0, 5.0], 1), (4, [], 1), (5, [1.0], 1)]
    large = {r.vec_id: r for r in vc.report(spark.createDataFrame(far, KIND)).collect()}
    assert large[4].code is None and large[5].error is None and large[1].error == 0 and large[3].label_error == 0
    assert vc.report(spark.createDataFrame([], KIND)).collect() == []
    assert [r.code for r in vc.report(spark.createDataFrame([(None, [1.0] * 4, 1)], KIND)).collect()] == [None]


@pytest.mark.parametrize("bits,cells", [(0, 10), (4, 100_000), (9, 3)])
def test_cells_keep_every_nearest_entry(bits, cells):
    rng = np.random.default_rng(bits)
    book = np.concatenate([rng.integers(-400, 400, (60, 4)), np.zeros((3, 4), int)])
    x = np.concatenate([rng.integers(-500, 500, (3000, 4)), book, book + 1])
    near = vc.Nearest(book, bits, cells)
    far = np.square(x[:, None] - book[None]).sum(2)
    for _ in range(2):
        index, distance = near(x)
        assert (index == far.argmin(1)).all() and (distance == far.min(1)).all() and len(near.memo) <= cells


def test_another_cell_of_the_same_hash_is_told(monkeypatch):
    book = np.arange(40).reshape(20, 2) * 50
    near = vc.Nearest(book, 3)
    near.factors = np.zeros(2, np.uint64)
    x = np.random.default_rng(1).integers(-100, 2100, (500, 2))
    assert (near(x)[0] == np.square(x[:, None] - book[None]).sum(2).argmin(1)).all()


def test_decoded_vectors_are_near(spark):
    df = spark.createDataFrame(vectors(), KIND)
    books = vc.learn(df)
    back = vc.decode(vc.encode(df, books), books).collect()
    for r in back:
        assert abs(sum((1024 * a - 1024 * b) ** 2 for a, b in zip(r.embedding, r.decoded, strict=True)) - r.error) <= 16 * (r.error ** 0.5 + 2)
