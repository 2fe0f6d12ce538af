from zlib import crc32

from pyspark.sql import functions as F

from plumbline.llm import language
from plumbline.session import CLEANUP, checkpointed


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd):
    got = language.language_report(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count()
    for i in (2, 3, 4):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[8].lang_pred in {"en", "de", "fr"}
    assert language.language_report(odd.limit(0)).collect() == []


def test_no_language_to_learn(odd):
    rows = language.language_report(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in rows} == {"und"}


def test_backoff_and_bounds(spark):
    docs = spark.createDataFrame([("the cat the dog", "en"), ("der hund der kater", "de"), ("1234", "xx"), (None, "en")], "text string, lang string")
    model = language.learn(docs)
    assert model.languages == ["de", "en"]
    scorer = language.Scorer(model)
    assert scorer.predict("the")[0] == "en" and scorer.predict("hunde")[0] == "de" and scorer.predict("²")[0] == "und"
    # Keys of one total stay or go together, and never more than allowed.
    assert len(language.learn(docs, max_words=2).words) == 2 and language.learn(docs, max_words=0).words == {}


def test_long_words_are_cut():
    assert list(map(len, language.words_of("a" * 150))) == [64, 64, 22]


def test_scores_do_not_depend_on_what_is_broadcast(spark):
    """Rare words and n-grams count as well, whatever part of them goes to every task."""
    train = spark.createDataFrame([("the cat the dog the end", "en")] * 3 + [("der hund der kater", "de")] * 3 + [("katu txakur zaldi", "eu"), ("中文字 天地人", "zh")], "text string, lang string")
    texts = ["txakur", "zaldi the", "txakurra zaldia", "天地人", "天地", "hunde", "the", "²", "", None, "qqq", *["zaldi qqqq"] * 50, "the zaldi " * 1_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in language.identify(docs, language.learn(train)).collect()}
    assert want[0][0] == want[2][0] == "eu"
    for words, grams in ((2, 5), (0, 0), (1_000, 5), (2, 10_000)):
        got = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in language.identify(docs, language.learn(train, words, grams)).collect()}
        assert got == want


def test_tables_are_kept_in_few_files(spark, monkeypatch):
    """However many partitions a shuffle has; each file of a local folder costs an executor a process."""
    train = spark.createDataFrame([("the cat the dog the end", "en")] * 3 + [("der hund der kater", "de")] * 3 + [("katu txakur zaldi", "eu")], "text string, lang string")
    texts = ["txakur zaldi", "zaldi the", "txakurra zaldia", "hunde", *["zaldi qqqq"] * 1_100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cores = spark.sparkContext.defaultParallelism
    settings = {"spark.sql.shuffle.partitions": str(language.FILES * cores + 8), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    tables, before = [], {k: spark.conf.get(k) for k in settings}
    monkeypatch.setattr(language, "checkpointed", lambda df: tables.append(checkpointed(df)) or tables[-1])
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = language.identify(docs, language.learn(train, 2, 5))
        rows, parts = out.collect(), out.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == len(texts) and len({r.doc_id for r in rows}) == len(texts)
    assert len(tables) > 7 and max(parts, *(t.rdd.getNumPartitions() for t in tables)) <= language.FILES * cores


def test_shuffle_files_go_with_their_query(spark, odd, monkeypatch):
    """Not when the driver happens to collect garbage; the setting is as before afterwards."""
    seen, identify = [], language.identify
    monkeypatch.setattr(language, "identify", lambda *a: seen.append(spark.conf.get(CLEANUP, None)) or identify(*a))
    before = spark.conf.get(CLEANUP, None)
    assert language.language_report(odd).count() == odd.count()
    assert seen == ["true"] and spark.conf.get(CLEANUP, None) == before
