"""From raw documents to training tokens: toxicity, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of the documents they get; the last adds the tokens and returns one row per remaining document.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, dartminhash, decontaminate, pii, toxicity
from plumbline.llm.base import read
from plumbline.session import CLEANUP, checkpoint_folder, shuffles_removed  # noqa: F401


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, learned from the labelled ones of this input, does not reject."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id."""
    return dartminhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, re-parameterised ones included."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.mask(docs, pii.learn(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and the other columns but the text, with the token ids."""
    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_benchmark), ("personal_data", mask_personal_data), ("tokens", tokenize)]
# A classifier, a field and signatures are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    with shuffles_removed(spark):
        for k, (name, stage) in enumerate(STAGES):
            out = os.path.join(folder, f"{k}-{name}")
            stage(spark, docs, sf_dir).write.parquet(out)
            docs = spark.read.parquet(out)
    return docs
