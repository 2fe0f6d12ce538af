import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import bpe, token_counts
from plumbline.llm.bytebpe import load

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def texts():
    rng = random.Random(3)
    letters = [*" \n\t\r'sdtrevml0123a1éß中文²½٣\x1c\x85\xa0　​!?.,aabb <|endoftext|>", "<|endoftext|>", "  ", " \n", "'ll", "\U0001f600"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4_000)] + ["a" * 5_000, " " * 100, "\n" * 50 + " x", ""]


def test_counts_and_ids_equal_the_library(library):
    vocabulary, xs = load(FILE), texts()
    want = [e.ids for e in library.encode_batch(xs, add_special_tokens=False)]
    counter = token_counts.Counter(vocabulary)
    assert [counter.text(x, vocabulary.special) for x in xs] == [len(w) for w in want]
    flat, n = bpe.Encoder(vocabulary).encode(xs)
    at = 0
    for w, k in zip(want, n.tolist(), strict=True):
        assert flat[at:at + k].tolist() == w
        at += k
    assert bpe.Decoder(vocabulary).decode(flat, n) == xs


def test_memory_starting_over_changes_nothing(monkeypatch):
    vocabulary, xs = load(FILE), texts()[:500]
    full = token_counts.Counter(vocabulary)
    want = [full.text(x, vocabulary.special) for x in xs]
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    counter, encoder = token_counts.Counter(vocabulary), bpe.Encoder(vocabulary)
    assert [counter.text(x, vocabulary.special) for x in xs] == want
    assert [int(encoder.encode([x])[1][0]) for x in xs] == want


def test_merger_without_pairs_and_words():
    vocabulary = load(FILE)
    vocabulary.pairs = []
    assert bpe.Merger(vocabulary).encode([b"ab", b"", b"c"])[1].tolist() == [2, 0, 1]
    assert bpe.Merger(load(FILE)).encode([])[1].tolist() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        load(public_tokenizers.path("word_bpe_49k.json"))


def test_queries_on_odd_rows(odd, library):
    rows = odd.collect()
    texts_of = sorted((str(r.doc_id), r.text or "") for r in rows)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_report(odd, FILE).collect())
    want = sorted((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts_of)
    assert got == want
    coded = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, FILE).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert coded == sorted((i, len(e := library.encode(t, add_special_tokens=False).ids), sha(",".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))) for i, t in texts_of)


def test_columns_pass_through_and_new_names_replace(odd):
    assert set(token_counts.token_counts(odd, FILE).columns) == set(odd.columns)
    out = bpe.encode(odd, FILE)
    assert set(out.columns) == set(odd.columns) and dict(out.dtypes)["ids"] == "array<int>"
    assert bpe.encode(odd.limit(0), FILE).collect() == []
    assert token_counts.token_report(odd.limit(0), FILE).collect() == []


def test_decode_round_trip(odd):
    back = bpe.decode(bpe.encode(odd.select("doc_id", "text"), FILE).withColumnRenamed("text", "was"), FILE)
    assert all(r.text == (r.was or "") for r in back.collect())


def test_very_long_words_are_merged_alike(library):
    """Words beyond ``LONG_WORD`` give the library's ids, in a time that grows with their length."""
    encoder, rng = bpe.Encoder(load(FILE)), random.Random(1)
    texts = ["a" * 3_001, "ab" * 2_000, "the" * 1_500, "".join(rng.choice("etaoinshrdlu") for _ in range(5_000)), "".join(rng.choice("aab") for _ in range(4_000)),
             "\u00e9\u4e2d" * 900, " short words " + "x" * 1_001 + " more"]
    ids, counts = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    start = time.time()
    encoder.encode(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))])
    assert time.time() - start < 30
