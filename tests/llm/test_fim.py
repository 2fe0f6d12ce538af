from collections import Counter
from hashlib import sha256

import pytest

from plumbline.llm import fim


def brute(i, text):
    """The contract's columns in plain Python, without pieces."""
    text = text or ""
    n, drawn = len(text), sha256(("1:" + ("" if i is None else str(i))).encode()).hexdigest()
    h = [int(drawn[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        form, out = "plain", text
    elif h[3] % 100 < 20:
        form, out = "spm", "<S>" + s + "<P>" + p + "<M>" + m
    else:
        form, out = "psm", "<P>" + p + "<S>" + s + "<M>" + m
    hexed = [sha256(x.encode()).hexdigest() for x in (out, text)]
    return i, n, form, *((None, None) if form == "plain" else (a, b - a)), *hexed, out


def rows(df):
    return Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in df.collect())


@pytest.mark.parametrize("size", [fim.CHUNK, 7])
def test_report_against_brute_force(spark, small, odd, size):
    docs = small.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(
        [(5000 + k, t) for k, t in enumerate(["a <P> b", "<M>", "<P", "P>x<S", "\U0001f600é<", "<<P", "\0", "<S"] * 6)], "doc_id long, text string"))
    assert rows(fim.report(docs, size=size)) == Counter(brute(r.doc_id, r.text)[:-1] for r in docs.collect())


def test_whole_texts_and_restoration(spark, odd):
    want = Counter((i, form, out) for i, _, form, _, _, _, _, out in (brute(r.doc_id, r.text) for r in odd.collect()))
    got = fim.fim_texts(odd, size=1000).collect()
    assert Counter(tuple(r) for r in got) == want
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert Counter((r.id, fim.restore(r.output, r.form)) for r in got) == texts


def test_copies_over_partitions_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text that comes often " * 50)] * 700 + [(None, "x")] * 3 + [(1, "another")], "doc_id long, text string").repartition(5)
    assert rows(fim.report(docs, size=100)) == Counter(brute(r.doc_id, r.text)[:-1] for r in docs.collect())
    assert fim.report(docs.limit(0)).collect() == []


def test_restoration_sorts_without_a_second_exchange(spark, small):
    plan = fim.report(small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def test_all_forms_occur(small):
    assert {r.form for r in fim.report(small).select("form").distinct().collect()} == {"plain", "psm", "spm"}
