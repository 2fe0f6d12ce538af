"""Queries of the text operators and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers

from plumbline.llm import bpe, chat, dartminhash, decontaminate, embeddings, fim, language, licenses, pii, suffix_dedup, token_counts, toxicity, vector_codes
from plumbline.llm.base import read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_bpe")
def op4(spark, sf):
    return bpe.digests(read(spark, sf, "documents"), vocabulary())


@query("op9_token_counts")
def op9(spark, sf):
    return token_counts.token_report(read(spark, sf, "documents"), vocabulary())


@query("op1_license_scan")
def op1(spark, sf):
    return licenses.license_scan(read(spark, sf, "documents"))


@query("op5_language")
def op5(spark, sf):
    return language.language_report(read(spark, sf, "documents"))


@query("op8_pii")
def op8(spark, sf):
    return pii.pii_report(read(spark, sf, "documents"))


@query("op7_embedding_near_dup")
def op7(spark, sf):
    return embeddings.near_duplicates(read(spark, sf, "embeddings"))


@query("op3_decontaminate")
def op3(spark, sf):
    return decontaminate.report(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op10_minhash_near_dup")
def op10(spark, sf):
    return dartminhash.near_duplicates(read(spark, sf, "documents"))


@query("op2_toxicity")
def op2(spark, sf):
    return toxicity.report(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op6_suffix_dedup")
def op6(spark, sf):
    return suffix_dedup.report(read(spark, sf, "documents"))


@query("op11_fill_in_middle")
def op11(spark, sf):
    return fim.report(read(spark, sf, "documents"))


@query("op12_vector_codes")
def op12(spark, sf):
    return vector_codes.report(read(spark, sf, "embeddings"))


@query("op13_chat_format")
def op13(spark, sf):
    return chat.report(read(spark, sf, "conversations"))
