import hashlib
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's result on the smallest tables, as the pipeline makes them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_keep_columns_and_take_effect(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for frame in stages[:-1]:
        assert frame.columns == docs.columns
    counts = [docs.count(), *[s.count() for s in stages]]
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] == counts[5] > 0
    assert not any(pii.base_spans(r.text) for r in stages[3].collect())


def test_tokens_of_the_last_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_rows_of_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[-1].columns
    assert {(r.doc_id, r.ids_sha256) for r in got.collect()} == {(r.doc_id, r.ids_sha256) for r in stages[-1].collect()}


def test_odd_rows_pass_every_stage(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert set(ids) == {r.doc_id for r in odd.collect()} and before.columns == odd.columns
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []


def test_all_eleven_queries_are_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_shuffle_files_go_with_their_query(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files, name = lambda: manager.getAllFiles().size(), corpus_pipeline.CLEANUP
    assert spark.conf.get(name, None) is None
    before = files()
    with corpus_pipeline.shuffles_removed(spark):
        df = spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).count()
        assert len(df.collect()) == len(df.collect()) == 7
        until = time.time() + 20
        while files() > before and time.time() < until:
            time.sleep(0.1)
        assert files() <= before
    assert spark.conf.get(name, None) is None
