import numpy as np
import pytest

from plumbline.llm import embeddings


def brute(rows):
    """vec_id -> (links, component) by all pairs."""
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in good}
    for n, (i, v, a) in enumerate(good):
        for j, w, b in good[n + 1:]:
            if a == b and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen), min(seen) == i)
    return out


def vectors():
    rng = np.random.default_rng(4)
    rows, near = [], rng.standard_normal(16)
    for i in range(300):
        v = rng.standard_normal(16)
        if i % 3 == 0:
            v = near + rng.standard_normal(16) * 0.13
        if i % 10 == 1:
            v = np.array(rows[i // 2][1])
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1), (404, rows[0][1], None), (405, [1.0], 1), (406, [2.0], 1), (407, [-1.0], 1), (408, [], 1),
             (409, [float("inf")] * 16, 0), (410, [1e30] * 16, 0), (411, [1e-30] * 16, 0)]
    return rows


@pytest.mark.parametrize("chunk", [2_000, 5])
def test_links_against_brute_force(spark, chunk):
    rows = vectors()
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, id long, copies long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, chunk=chunk).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)], kind)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(rows).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("None", 0, None, False)]
    assert embeddings.near_duplicates(spark.createDataFrame([], kind)).collect() == []


def test_rotation_keeps_lengths():
    q = embeddings.rotation(8)
    assert np.allclose(q @ q.T, np.eye(8)) and embeddings.blocks_of(3, 8) == [slice(0, 1), slice(1, 2), slice(2, 3)]


def test_null_and_shared_ids(spark):
    """Rows without an id link, and different vectors of one id keep their own links."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near_a, near_b = [1.0, 0.05, 0.0], [0.0, 1.0, 0.05]
    rows = [(1, a, 0), (2, near_a, 0), (None, [1.0, 0.0, 0.05], 0), (7, b, 0), (7, near_a, 0), (8, near_b, 0), (None, [0.0, 0.0, 1.0], 0), (9, b, 1)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == sorted([("1", 3, "1", True), ("2", 3, "1", False), ("None", 3, "1", False), ("7", 3, "1", False), ("7", 1, "1", False), ("8", 1, "1", False),
                          ("None", 0, "None", False), ("9", 0, "9", True)])
