import random
import re

from plumbline.llm import licenses
from plumbline.llm.licenses import BASE, automaton, evaluate, postfix, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    hits = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i:i + p.count(" ") + 1] == p.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_base_places_against_brute_force():
    rng, machine = random.Random(2), automaton()
    parts = ["mit", "MIT", "License", "license", " ", "-", "Apache", "general", "public", "é", "K", "\x00", "\n", "GENERAL PUBLIC LICENSE", "lesser", "or", "中"]
    for _ in range(5_000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 15)))
        r = scan(text.encode(), machine)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text), text


def test_expressions():
    assert postfix("MIT OR Apache-2.0 AND BSD-3-Clause".split()) == ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]
    assert postfix("( MIT OR Apache-2.0 ) AND X".split()) == ["MIT", "Apache-2.0", "or", "X", "and"]
    assert postfix("GPL-2.0 WITH Classpath AND MIT".split()) == ["GPL-2.0", "Classpath", "with", "MIT", "and"]
    for broken, kept in (("MIT OR", ["MIT"]), ("( ( MIT", ["MIT"]), (") x", []), ("MIT ( x", ["MIT"]), ("", []), ("or", []), ("( MIT AND ( GPL OR", ["MIT", "GPL", "and"])):
        assert postfix(broken.split()) == kept, broken
    assert evaluate(postfix("MIT OR GPL-3.0-only".split())) == (1.0, ["mit", "gpl"])
    assert evaluate(postfix("MIT AND GPL-3.0-only".split()))[0] == 0.4
    assert evaluate(postfix("GPL-2.0-only WITH Classpath-exception-2.0".split())) == (0.6, ["gpl"])
    assert evaluate([]) == (0.0, [])


def test_tags_and_notices():
    machine = automaton()
    r = scan(b"// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND LGPL-2.1+\nint x;", machine)
    assert r["expressions"] == ["MIT GPL-3.0-only or LGPL-2.1+ and"] and r["labels"] == "gpl,lgpl,mit" and r["n_base"] == 0 and r["score"] == 0.6
    r = scan(b"Under the MIT License or the Apache License.", machine)
    assert r["expressions"] == ["mit apache or"] and r["score"] == 1.0
    r = scan(b"GNU Lesser General Public License", machine)
    assert r["base_labels"] == "gpl" and r["labels"] == "gpl,lgpl"


def test_odd_rows(odd):
    rows = {r.doc_id: r for r in licenses.license_scan(odd).collect()}
    for r in odd.collect():
        got = rows[r.doc_id]
        assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == brute(r.text or "")
    assert licenses.license_scan(odd).count() == odd.count() and licenses.license_scan(odd.limit(0)).collect() == []
