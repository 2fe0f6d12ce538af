"""Byte-level BPE vocabularies: the file, the pre-token rule and the cuts at which a text can be cached piecewise."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import regex

# The bytes that stand for themselves in byte-level vocabularies; all others are shifted up by rule.
PLAIN_BYTES = (range(33, 127), range(161, 173), range(174, 256))
# Fixed value: the published pre-token pattern of byte-level BPE.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space as the tokenizers library understands it (the Unicode property, without the separators 1C to 1F).
SPACE = r"[\t-\r \x85\xa0  -     　]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
PRE_TOKEN = regex.compile(WORD_PATTERN.replace(r"(?!\S)", f"(?!{NOT_SPACE})").replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r \x85\xa0  -     　\p{L}\p{N}]").replace(r"\s+", f"{SPACE}+"))
# A space with white space on both sides (or the end after it) may be inside a token; before any other space a token ends.
UNSAFE_CUT = regex.compile(f"{SPACE} (?:{SPACE}|$)")


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte."""
    plain = [b for r in PLAIN_BYTES for b in r]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


@dataclass
class Vocabulary:
    """``tokens[id]`` are bytes, ``first[byte]`` the id of a single byte, ``pairs`` (left id, right id, merged id) by
    rank, ``special`` the added strings with their ids."""

    tokens: list[bytes]
    first: list[int]
    pairs: list[tuple[int, int, int]]
    special: dict[str, int] = field(default_factory=dict)


def load(path: str) -> Vocabulary:
    """Read a tokenizers JSON file of a byte-level BPE without normalizer; others are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    ids, letters = spec["model"]["vocab"], byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        tokens[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    first = [0] * 256
    for letter, byte in letters.items():
        first[byte] = ids[letter]
    return Vocabulary(tokens, first, [(ids[a], ids[b], ids[a + b]) for a, b in merges], special)


def cut_special(text: str, special: dict[str, int]) -> list[str | int]:
    """The text cut at its special strings, which become their ids; the leftmost comes first, then the longest."""
    if not any(s in text for s in special):
        return [text]
    out: list[str | int] = []
    at = 0
    for m in regex.finditer("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)), text):
        out += [text[at:m.start()], special[m.group()]]
        at = m.end()
    return [*out, text[at:]]


def cut_spaces(text: str) -> list[str]:
    """The text cut before its spaces wherever no token can cross, so that equal cuts have equal tokens."""
    if UNSAFE_CUT.search(text):
        return PRE_TOKEN.findall(text)
    head, *rest = text.split(" ")
    return ([head] if head else []) + [" " + x for x in rest]
