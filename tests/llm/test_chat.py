import json
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chat

T = chat.Template()
TRICKY = st.text(alphabet=st.sampled_from(list("<s>/[]INSTn\\\n|im_endé\U0001f600 ")), max_size=40) | st.sampled_from(list(T.control)) | st.text(max_size=20)


def brute(rows):
    """The contract's columns without a template, from (conv_id, turn, role, text) rows."""
    out = {}
    for i, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(i, []).append((role or "", text or ""))
    told = {}
    for i, turns in out.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        told[i] = (len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest())
    return told


PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
KIND = "conv_id long, turn long, role string, text string"


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.report(df).collect()}


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert got(df) == brute(rows + PROBE)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, None, None, "before all"), (2, 5, "assistant", "é\U0001f600\\<s>"), (2, 5, "assistant", "é\U0001f600\\<s>"), (2, 5, "assistant", "a"),
            (None, 0, "user", "no id"), (None, 1, "assistant", "still <\\/s> no id"), (3, 0, "to\nol\\", "x" * 300_000), (4, 2, "assistant", "b"), (4, 1, "human", "role as it is"), (5, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND + ", piece int, key string").repartition(4)
    assert got(df) == brute(rows + PROBE)
    assert got(spark.createDataFrame([], KIND)) == brute(PROBE)


def test_long_conversation_streams(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, id, 7) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('text <s> ', id) text")
    assert got(df) == brute([tuple(r) for r in df.collect()] + PROBE)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5))
def test_formatting_is_reversible(turns):
    whole = "".join(T.turn(r, t) for r, t in turns)
    assert chat.read_back(whole) == turns
    assert [T.plain(whole[a:b]) for a, b in chat.loss_spans(whole)] == [t for r, t in turns if r == "assistant"]
    assert sum(whole.count(c) for c in T.control) == 2 * len(turns)


def test_unsafe_templates_are_refused():
    for bad in ({"close": "<a<b"}, {"open": "a\n"}, {"more": ("\\x",)}, {"more": ("<n>",)}, {"open": "<"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "messages", [("system", "s"), ("user", "u")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}], "id": 4}, "parts", [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "top"}, "from_value", [("system", "top"), ("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c", "score": 0.5}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "r", "history": [["a", "b"], ["c", "d"]]}, "history", [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "p"), ("assistant", "r")]),
    ({"data": {"prompt": "p", "response": "r"}}, "nested", [("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": {"z": 1, "a": None}}, None, []),
    ({"question": "q", "answer": 42}, "question_answer", [("user", "q"), ("assistant", "42")]),
    ({"other": 1}, None, []), ([1, 2], None, []), (None, None, []),
]


def test_layouts_are_chosen_by_fingerprint(spark):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(90, "{broken"), (91, None)], "id long, raw string")
    found = {}
    for r in chat.canonical_turns(df, "raw", ["id"]).collect():
        found.setdefault(r.id, []).append((r.item, r.layout, r.role, r.text))
    assert found == {k: [(n, name, *t) for n, t in enumerate(turns)] for k, (_, name, turns) in enumerate(RECORDS) if turns}
    seen = {r.paths: (r.layout, r.n, r.fingerprint) for r in chat.layouts_seen(df, "raw").collect()}
    assert sum(n for _, n, _ in seen.values()) == len(RECORDS) + 2 and seen["other"][0] is None
    assert seen["completion, prompt, score"] == ("prompt_completion", 1, chat.fingerprint(["prompt", "completion", "score"]))


def test_nested_columns_and_named_fingerprints(spark):
    df = spark.createDataFrame([(1, (None, None, [("user", "hi"), ("assistant", None)])), (2, ("p", "q", None))],
                               "id long, rec struct<ask: string, prompt: string, messages: array<struct<role: string, content: string>>>")
    own = chat.Layout("own", ("ask",), (chat.Said("user", "ask"), chat.Said("assistant", "prompt")))
    turns = chat.canonical_turns(df, "rec", ["id"], [*chat.LAYOUTS, own], {chat.fingerprint(["ask", "prompt"]): "own"})
    assert Counter((r.id, r.layout, r.role, r.text) for r in turns.collect()) == Counter(
        [(1, "messages", "user", "hi"), (1, "messages", "assistant", ""), (2, "own", "user", "p"), (2, "own", "assistant", "q")])
    whole = {r.id: r for r in chat.conversations(turns, "id", []).collect()}
    assert [t for _, t in chat.read_back(whole[2].formatted)] == ["p", "q"]
    assert [whole[2].formatted[s.start:s.end] for s in whole[2].loss] == ["q"]
