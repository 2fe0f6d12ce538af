import hashlib
import random
import re

import numpy as np

from plumbline.llm import pii
from plumbline.llm.pii import KINDS, base_spans

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if (kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and sum(doubled) % 10 == 0)
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_spans_against_brute_force():
    rng = random.Random(5)
    parts = [*"01234567890123456789.. --+()@@ab %_é\n", "4041894974608795", "+49 170 1234567", "1.2.3.4", "a@b.co"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    assert base_spans("a" * 300_000 + "@") == [] and base_spans("1" * 300_000) == [] and base_spans("+1" * 100_000) == brute("+1" * 100) * 0
    assert base_spans("a" * 100_000 + "@b.co") == [("email", 0, 100_005)]


def test_skip_edges_carry_a_label():
    """A number that says too little by itself follows an equal one that base patterns know."""
    text = "card 4041 8949 7460 8795 then " + "word " * 200 + "again 4041894974608795 end"
    field = pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), 0.0, 0.0)
    g = pii.graph([text], [[s for s in base_spans(text) if s[2] < 40]])
    assert any(t == 1 for _, _, t in pii.graph(["4041894974608795 x 4041894974608795"], [[]]).edges)
    alone = pii.marginals(g, field)
    field.same = 3.0
    field.unary[:, 3] = 0.0
    both = pii.graph(["4041894974608795 x 4041894974608795"], [[("card", 0, 16)]])
    assert pii.marginals(both, field)[1, 3] > 0.8 and alone[-1, 3] < 0.5


def test_odd_rows(odd):
    rows = pii.pii_report(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        base = brute(texts[r.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in KINDS]
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))
    assert pii.pii_report(odd.limit(0)).collect() == []


def test_masking(odd):
    field = pii.learn(odd)
    rows = {r.doc_id: r for r in pii.mask(odd, field).collect()}
    assert rows[1].text == "The mit license applies. Mail [EMAIL] or [IP] now." and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[3].text == "" and rows[10].text.startswith("card [CARD] [PHONE]")
    assert pii.mask(odd, field).columns == odd.columns and not any(brute(r.text or "") for r in rows.values())


def test_numbers_written_with_blanks_are_whole_nodes():
    """A card in groups and a phone number in brackets are one node each, tied to their recognised form alone."""
    field = pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), 5.0, 0.0)
    for text, kind, again in (("+1 (743) 555-3824 call or (743) 555-3824 now", "phone", "(743) 555-3824"), ("+49 170 1234567 or 0170 1234567", "phone", "0170 1234567"),
                              ("4041894974608795 x 4041 8949 7460 8795 12", "card", "4041 8949 7460 8795"), ("+1 (743) 555-3824 then 12 743-555-3824", "phone", "743-555-3824")):
        base = base_spans(text)[:1]
        g = pii.graph([text], [base])
        i = [text[a:b] for a, b in zip(g.start, g.end, strict=True)].index(again)
        assert g.label[0] == pii.LABELS.index(kind) and (0, i, 1) in g.edges, text
        assert pii.marginals(g, field)[i, g.label[0]] >= pii.SURE
    text = "+1 (743) 555-3824 call or (743) 555-3824 now"
    assert ("phone", text.index("(743) 555-3824 now"), text.index(" now")) in pii.all_spans([text], field)[1][0]
    apart = pii.graph([t := "+1 (743) 555-3824 and (212) 555-3824"], [base_spans(t)])
    assert not any(kind for _, _, kind in apart.edges)
    assert len(list(pii.number_runs("1 " * 100_000, {"4041894974608795"}))) == 1


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    """A text with many copies teaches as one."""
    seen = []
    monkeypatch.setattr(pii, "train", lambda rows: seen.append(sorted(map(repr, rows))) or pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), 0.0, 0.0))
    texts = [f"mail a{i}@example.com or 10.0.0.{i}" for i in range(20)]
    for rows in (texts, texts + texts[:1] * 300):
        pii.learn(spark.createDataFrame([(x,) for x in rows], "text string"), documents=50, nodes=1_000)
    assert seen[0] == seen[1] and len(seen[0]) == 40


def test_marginals_of_small_graphs_are_exact():
    """On graphs without a cycle, message passing gives the marginals that all labellings add up to."""
    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    for edges in ([], [(0, 1, 0)], [(0, 1, 0), (1, 2, 1), (1, 3, 2)], [(0, 2, 1), (1, 2, 0), (2, 3, 0)]):
        field = pii.Field(rng.normal(size=(pii.FEATURES, k)), rng.normal(size=(k, k)), 1.5, 0.7)
        feats = rng.integers(0, pii.FEATURES, (4, 3)).tolist()
        g = pii.Graph([0] * 4, [0] * 4, [0] * 4, feats, [0, 0, 2, 0], edges)
        total = np.zeros((4, k))
        for labels in np.ndindex(*[k] * 4):
            if labels[2] != 2:
                continue
            w = sum(field.unary[f].sum(0)[y] for i, (f, y) in enumerate(zip(feats, labels, strict=True)) if i != 2)
            w += sum(field.chain[labels[i], labels[j]] if t == 0 else (labels[i] == labels[j]) * (field.same, field.similar)[t - 1] for i, j, t in edges)
            for i, y in enumerate(labels):
                total[i, y] += np.exp(w)
        assert np.abs(pii.marginals(g, field) - total / total.sum(1, keepdims=True)).max() < 1e-3


def test_secrets_come_through_the_field(spark):
    """Key words teach a kind of its own; a repeat without key words follows, and other long words stay."""
    rng = random.Random(2)
    secrets = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(120)]
    rows = [(i, f'plain words here token = "{s}" and mail a{i}@example.com or {rng.randrange(10 ** 7)} things') for i, s in enumerate(secrets)]
    rows += [(1000, f'token = "{secrets[0]}" then ' + "word " * 30 + secrets[0] + " end"), (1001, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 and 1234567 alone"), (1002, "+1 (826) 555-4081 190.137.223.204 here")]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("secret:" in got[i].spans for i in range(120)) >= 118 and got[1000].spans.count("secret:") == 2
    assert "secret" not in got[1001].spans and got[0].n_spans == 2 and (got[1002].n_phone, got[1002].n_ip) == (0, 1)
