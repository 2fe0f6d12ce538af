import random

import numpy as np

from plumbline.llm import toxicity


def corpus(spark, n=600):
    rng = random.Random(9)
    words = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        toxic = i % 5 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["vilewort", "VILEWORT", "vilewortish", "nastybit"])
        junk = not toxic and i % 7 == 0
        rows.append((i, (" ".join(text).upper() + "!!!") if junk else " ".join(text), 1, 2))
        if i % 2:
            labels.append((i, 0 if junk else 1, int(toxic), "x"))
        elif i % 10 == 0:
            labels.append((i, 1, 1, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, y0 int, p_toxic int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_planted_words_are_found_and_clean_documents_stay(spark):
    docs, labels = corpus(spark)
    rows = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert {i for i, r in rows.items() if not r.kept} == {i for i in range(600) if i % 5 == 0}
    assert np.mean([rows[i].p_quality for i in range(600) if i % 5 and i % 7 == 0]) > 0.5 > np.mean([rows[i].p_quality for i in range(600) if i % 5 and i % 7])
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 480


def test_chain_uses_the_earlier_probability(spark):
    docs, labels = corpus(spark)
    links = toxicity.learn(docs, labels)
    assert [x.name for x in links] == ["quality", "toxic"] and [len(x.earlier) for x in links] == [0, 1] and links[1].earlier[0] != 0


def test_threshold_parts_the_sides():
    p, y = np.array([0.9, 0.3, 0.2, 0.05, 0.04]), np.array([1, 1, 0, 0, 0])
    assert 0.2 < toxicity.best_threshold(p, y) < 0.3 and toxicity.best_threshold(p, 1 - y) >= toxicity.THRESHOLDS[0]


def test_effect_does_not_grow_with_the_rows():
    few, many = (toxicity.effect(np.array([10, 0, 5]) * k, np.array([0, 0, 5]) * k, 10 * k, 10 * k) for k in (1, 1000))
    assert few[1] == many[1] == few[2] == many[2] == 0 and 0.85 < few[0] < many[0] <= 1


def test_a_cut_that_does_not_part_rejects_nothing():
    y, ones = np.array([1.0] * 5 + [0.0] * 45), np.ones(50)
    assert toxicity.safe_threshold(np.full(50, 0.1), y, ones) == toxicity.NEVER
    assert toxicity.safe_threshold(np.where(y == 1, 0.9, 0.01), y, ones) <= toxicity.THRESHOLDS[1]


def test_near_copies_share_a_fold():
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(300))
    texts = [(f"head{k} " + text).encode() for k in range(30)]
    assert np.bincount(toxicity.folds(texts), minlength=3).max() >= 27
    assert (np.bincount(toxicity.folds([f"one{k}".encode() for k in range(300)]), minlength=3) > 60).all()


def test_counts_against_brute_force(spark):
    docs, labels = corpus(spark, 200)
    marks = toxicity.marked(labels)
    sample = toxicity.drawn(docs, marks, 2, 1_000)
    assert {r.weight for r in sample.collect()} == {1.0}
    wanted = toxicity.candidates(sample, 2)
    got = toxicity.counted(docs, marks, wanted, 2)
    want = np.zeros_like(got)
    by_id = {r.doc_id: r for r in marks.collect()}
    for r in docs.collect():
        if r.doc_id in by_id:
            held, fold = set(toxicity.features([r.text.encode()])[0].tolist()), toxicity.folds([r.text.encode()])[0]
            for i, y in enumerate((by_id[r.doc_id].y0, by_id[r.doc_id].y1)):
                want[i, 1 - y, fold, -1] += 1
                for k, h in enumerate(wanted.tolist()):
                    want[i, 1 - y, fold, k] += h in held
    assert (got == want).all() and len(wanted) > 100


def test_sample_has_room_for_every_class(spark):
    docs, labels = corpus(spark)
    marks = toxicity.marked(labels)
    sample = toxicity.drawn(docs, marks, 2, 90).collect()
    sizes = {(r.y0, r.y1): r["count"] for r in marks.groupBy("y0", "y1").count().collect()}
    for key, n in sizes.items():
        mine = [r for r in sample if (r.y0, r.y1) == key]
        assert min(n, 5) <= len(mine) and abs(sum(r.weight for r in mine) - n) <= 0.8 * n


def test_prediction_against_plain_python(spark):
    docs, labels = corpus(spark, 300)
    links = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.predict(docs, links).collect()}
    for r in docs.collect()[::7]:
        held, before = set(toxicity.features([r.text.encode()])[0].tolist()), []
        for link in links:
            z = link.intercept + sum(w for h, w in zip(link.hashes.tolist(), link.weights, strict=True) if h in held) + sum(a * b for a, b in zip(link.earlier, before, strict=True))
            p = 1 / (1 + np.exp(-z))
            assert abs(got[r.doc_id][f"p_{link.name}"] - p) < 1e-9
            before.append(float(toxicity.logit(np.array([p]))[0]))


def test_few_labels_keep_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.clean(docs, labels).count() >= 0.8 * docs.count()
    assert toxicity.clean(docs, labels.limit(50)).count() >= 0.8 * docs.count()


def test_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.report(docs, labels).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.toxic == 0]
    # A fifth of the rows marked toxic here holds none of the words that the others share.
    assert sum(r.kept for r in clean) >= 0.99 * len(clean) and sum(not r.kept for r in rows if r.toxic) >= 0.8 * sum(r.toxic for r in rows)


def test_odd_rows_and_no_labels(spark, odd):
    _, labels = corpus(spark)
    some = labels.limit(0)
    for marks in (some, spark.createDataFrame([(1, 1, 0), (5, None, None), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")):
        rows = toxicity.report(odd, marks).collect()
        assert len(rows) == odd.count() and all(r.kept for r in rows if r.p_toxic < toxicity.THRESHOLDS[0]) and not any(r.kept for r in rows if r.p_toxic >= toxicity.THRESHOLDS[1])
    assert toxicity.report(odd.limit(0), some).collect() == []
    assert toxicity.clean(odd, some).count() == odd.count()
