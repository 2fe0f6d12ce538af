import re

from pyspark.sql import functions as F

from plumbline.llm import decontaminate
from plumbline.llm.decontaminate import templates

ITEM = "A train leaves Boston at 60 km per hour while the other leaves Chicago at 45 km per hour so when do both trains from Boston meet"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, h long, key string")


def bench(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "item_id long, text string, pos int")


def test_placeholders():
    w, plain, named, slot = templates([b"Alice met Bob for 5 kg of 3.50 and 20 men"])
    words = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    assert [x for x, s in zip(words, slot, strict=True) if s] == [b"Bob", b"5", b"kg", b"3.50", b"20"]
    assert plain[0] != decontaminate.NAME and named[0] == decontaminate.NAME and plain[2] == decontaminate.NAME


def test_exact_reparameterised_and_inconsistent(spark):
    renamed = ITEM.replace("Boston", "Denver").replace("Chicago", "Austin").replace("60", "72").replace("45", "51").replace("km", "miles")
    mixed = ITEM.replace("at 60 km", "at 45 miles").replace("from Boston", "from Paris").replace("leaves Chicago", "leaves Rome").replace("leaves Boston", "leaves Rome").replace("at 45 km", "at 45 hours")
    half = " ".join(ITEM.split()[:12])
    docs = [(1, f"Some text before. {ITEM}. And after it."), (2, f"intro words\n{renamed}\nmore"), (3, f"intro words\n{mixed}\nmore"), (4, half + " and goes elsewhere from here on without a question"),
            (5, "nothing of this kind at all in these plain words"), (6, None), (7, ""), (8, ITEM.upper()), (9, "pad " * 5_000 + ITEM + " pad" * 5_000)]
    got = {r.doc_id: r for r in decontaminate.report(frame(spark, docs), bench(spark, [(11, ITEM), (12, "too short"), (13, None), (14, ""), (15, "1 2 3 4 5 6 7 8")])).collect()}
    assert {i: r.item_ids for i, r in got.items() if not r.kept} == {1: [11], 2: [11], 8: [11], 9: [11]}
    assert got[1].consistency == 1.0 and got[2].consistency == 1.0 and got[4].kept and got[3].kept and len(got) == 9
    found = {r.doc_id: r for r in decontaminate.matches(frame(spark, docs), bench(spark, [(11, ITEM)])).collect()}
    assert found[1].literal and not found[2].literal and found[3].consistency < decontaminate.CONSISTENT


def test_no_plan_repeats_its_steps(spark, monkeypatch):
    """The driver holds and tells every plan as text, again after every shuffle; a step that many others read must not stand in each."""
    sizes = []

    def noted(df):
        sizes.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return df

    monkeypatch.setattr(decontaminate, "checkpointed", lambda df, f=decontaminate.checkpointed: f(noted(df)))
    docs = frame(spark, [(1, f"Some text before. {ITEM}. And after it."), (2, "nothing of this kind")])
    assert [r.doc_id for r in noted(decontaminate.clean(docs, bench(spark, [(11, ITEM)]))).collect()] == [2]
    assert max(sizes) <= 20


def test_given_tables_against_windows(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")

    def windows(text):
        words = re.findall(r"\w+", text.lower())
        return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}

    wanted = {r.item_id: windows(r.text) for r in items.collect()}
    every = set().union(*wanted.values())
    want = set()
    for r in docs.collect():
        common = windows(r.text) & every
        want |= {(r.doc_id, i) for i, w in wanted.items() if w and len(common & w) >= 0.8 * len(w)}
    got = {(r.doc_id, i) for r in decontaminate.report(docs, items).collect() for i in r.item_ids}
    assert got == want and want
    kept = {r.doc_id for r in decontaminate.clean(docs, items).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - {i for i, _ in want}


def test_odd_rows_and_empty_tables(spark, odd):
    items = bench(spark, [(1, "same words here and there again"), (None, "one two three four five six")])
    rows = decontaminate.report(odd, items).collect()
    assert len(rows) == odd.count() + 2 - 2 and {r.doc_id for r in rows if not r.kept} == {9}
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.report(odd.limit(0), items).collect() == []
    assert all(r.kept for r in decontaminate.report(odd, items.limit(0)).collect())


def test_match_far_into_a_long_document(spark, monkeypatch):
    """Places behind word 2,147,483 are judged where they are."""
    real = decontaminate.window_table
    monkeypatch.setattr(decontaminate, "window_table", lambda rows, key, text="text", filled=None: real(rows, key, text, filled).withColumn("pos", (F.col("pos") + (0 if filled is None else 2_200_000)).cast("int")))
    rows = decontaminate.report(frame(spark, [(1, f"Some text before. {ITEM}."), (2, "nothing of this kind")]), bench(spark, [(11, ITEM)])).collect()
    assert {r.doc_id: r.item_ids for r in rows} == {1: [11], 2: []}


def test_copies_in_any_letter_case_and_items_of_slots(spark):
    """Word for word copies match without regard to case, to the share of slots and to the length of the item."""
    items = [(11, ITEM), (12, "too short"), (13, "12 7 30 45 8 19 22 51"), (14, "Alice Bob Carol Dave Erin Frank Grace")]
    docs = [(1, "Before. " + ITEM.upper() + " after"), (2, "before " + ITEM.lower() + " after"), (3, "before " + ITEM.title()), (4, "list 12 7 30 45 8 19 22 51 end"),
            (5, "with Alice Bob Carol Dave Erin Frank Grace there"), (6, "Too short!"), (7, "one line\nTOO SHORT\nother"), (8, "this is too short for it"), (9, "list 12 9 30 44 8 18 22 50 end")]
    got = {r.doc_id: r.item_ids for r in decontaminate.report(frame(spark, docs), bench(spark, items)).collect()}
    assert got == {1: [11], 2: [11], 3: [11], 4: [13], 5: [14], 6: [12], 7: [12], 8: [], 9: []}


def test_edited_longer_slots_and_long_parts(spark):
    """An inner edit, slots of another length and a long part of an item do not hide it."""
    long = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    items = [(11, ITEM), (12, " ".join(long)), (13, "say what is the capital of it")]
    renamed = ITEM.replace("Boston", "New York").replace("Chicago", "Los Angeles").replace("60", "seventy five")
    docs = [(1, "intro " + ITEM.replace("other", "second")), (2, "intro " + ITEM.replace("while the", "while") + " tail"), (3, "intro words\n" + renamed + "\nmore"),
            (4, "before " + " ".join(long[15:45]) + " after"), (5, "before " + " ".join(long[15:27]) + " after"), (6, "and what is the capital of"), (7, " ".join(reversed(long))),
            (8, "intro " + " ".join(["changed" if i in (20, 40) else x for i, x in enumerate(long)]))]
    got = {r.doc_id: r.item_ids for r in decontaminate.report(frame(spark, docs), bench(spark, items)).collect()}
    assert got == {1: [11], 2: [11], 3: [11], 4: [12], 5: [], 6: [], 7: [], 8: [12]}
