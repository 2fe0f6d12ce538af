"""License scans: phrases and identifier tags found by Aho-Corasick, expressions evaluated by a shunting-yard parser.

A text is read as its words: A-Z become a-z, every other ASCII character that is no digit or letter parts words. One
automaton finds all phrases at once. Where a text carries an identifier tag, the expression after it (identifiers with
and / or / with and brackets) is parsed; notices joined by "or" or "and" form expressions as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm.base import pieces, small_batches, text_or_empty

# The base phrases and their labels, as the contract of the scan states them.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notice phrases of common licenses, with the labels that the scan adds.
NOTICES = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc", "the unlicense": "unlicense",
    "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc", "creative commons zero": "cc0", "cc0 1 0": "cc0",
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "proprietary", "public domain": "public-domain",
}
# Fixed value: words of the identifier tag.
TAG = "spdx license identifier"
# How freely a text under a license may be used, from 0 to 1. Labels that are not listed count as 0.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7,
    "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.05, "proprietary": 0.0,
}
#: Freedom of a license with an exception (a linking exception, say) is at least this.
WITH_EXCEPTION = 0.6
BIND = {"or": 1, "and": 2, "with": 3}
EXPRESSION = regex.compile(rb"(?i)SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)")
SYMBOL = regex.compile(rb"\(|\)|[A-Za-z0-9.+-]+")
#: Everything but digits, letters and bytes of non-ASCII characters becomes a space.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def label_of(identifier: str) -> str:
    """The label of a license identifier: the longest label that is its beginning, else the identifier itself."""
    name = identifier.lower().removesuffix("+")
    known = [x for x in FREEDOM if name == x or name.startswith(x + "-")]
    return max(known, key=len, default=name)


def postfix(symbols: list[str]) -> list[str]:
    """Shunting-yard: identifiers, operators and brackets in postfix order. ``with`` binds closest, then ``and``, then
    ``or``, all to the left. Reading ends before the first symbol that cannot go on; what is open is closed there. An
    operator without its right side is dropped."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # an operand comes next
    for s in symbols:
        low = s.lower()
        if operand:
            if s == "(":
                stack.append(s)
                continue
            if s == ")" or low in BIND:
                break
            out.append(s)
            operand = False
        elif low in BIND:
            while stack and stack[-1] != "(" and BIND[stack[-1]] >= BIND[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif s == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            break
    if operand and stack:  # the last operator lacks its right side
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    return out + [s for s in reversed(stack) if s != "("]


def evaluate(items: list[str]) -> tuple[float, list[str]]:
    """Freedom (or: the better side, and: the worse side, with: the exception lifts its license) and labels of an
    expression in postfix order. No items: 0 and no labels."""
    values: list[float] = []
    names: list[list[str]] = []
    for s in items:
        if s in BIND:
            b, nb = values.pop(), names.pop()
            a, na = values.pop(), names.pop()
            values.append(max(a, b) if s == "or" else min(a, b) if s == "and" else max(a, WITH_EXCEPTION))
            names.append(na if s == "with" else na + nb)
        else:
            values.append(FREEDOM.get(label_of(s), 0.0))
            names.append([label_of(s)])
    return (values[-1], names[-1]) if values else (0.0, [])


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        out.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    out.make_automaton()
    return out


def scan(raw: bytes, machine: ahocorasick.Automaton) -> dict:
    """All results of one text, given as UTF-8."""
    words = raw.lower().translate(WORDS).split()
    line = b" " + b" ".join(words) + b" "
    hits, at, passed = [], 0, 0  # (first word, words, phrase), by their ends
    for end, (phrase, n) in machine.iter(line.decode("latin-1")):
        passed += line.count(b" ", at, end)
        at = end
        hits.append((passed - n, n, phrase))
    base = [(w, BASE[p]) for w, _, p in hits if p in BASE]
    out = {"n_words": len(words), "n_base": len(base), "first_word": min((w for w, _ in base), default=None), "last_word": max((w for w, _ in base), default=None),
           "base_labels": ",".join(sorted({x for _, x in base})), "expressions": [], "labels": "", "score": 0.0}
    if not hits:
        return out
    labels, values = {x for _, x in base}, []
    if any(p == TAG for _, _, p in hits):
        for m in EXPRESSION.finditer(raw):
            symbols = postfix([s.decode() for s in SYMBOL.findall(m.group(1))])
            if symbols:
                value, names = evaluate(symbols)
                out["expressions"].append(" ".join(symbols))
                labels |= set(names)
                values.append(value)
    # Notices: of overlapping phrases the longest counts. Those with one "or", "and" or "with" between them form an expression.
    notices: list[tuple[int, int, str]] = []
    for w, n, p in sorted((h for h in hits if h[2] != TAG), key=lambda h: (h[0], -h[1])):
        if notices and w < notices[-1][0] + notices[-1][1]:
            if w + n > notices[-1][0] + notices[-1][1] and n > notices[-1][1]:
                notices[-1] = (w, n, p)
            continue
        notices.append((w, n, p))
    chain: list[str] = []
    for k, (w, n, p) in enumerate(notices):
        chain.append(BASE.get(p) or NOTICES[p])
        after = notices[k + 1][0] if k + 1 < len(notices) else None
        between = [x for x in words[w + n:after] if x not in (b"the", b"either")] if after is not None and after - w - n <= 3 else []
        if len(between) == 1 and between[0].decode("latin-1") in BIND:
            chain.append(between[0].decode())
            continue
        symbols = postfix(chain)
        value, names = evaluate(symbols)
        labels |= set(names)
        values.append(value)
        if len(symbols) > 1:
            out["expressions"].append(" ".join(symbols))
        chain = []
    out["labels"] = ",".join(sorted(labels))
    out["score"] = float(min(values, default=0.0))
    return out


FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expressions": pa.list_(pa.string())}
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, the number of words, base phrase places (all, and the words at which the
    first and the last begin; null without any), labels, expressions in postfix order, and the score: how freely the
    text may be used when all its notices hold (the least of its expressions; 0 without any).

    A null text is empty. Other columns do not matter. One narrow pass over whole texts: no shuffle.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(docs[key].alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in pieces(batches):
            rows = [scan(x.as_buffer().to_pybytes() if x.is_valid else b"", machine) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[f] for r in rows], kind) for f, kind in FIELDS.items()]], ["doc_id", *FIELDS])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
