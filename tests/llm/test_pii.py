"""Base spans against the plain patterns, disclosure against direct counting."""

import hashlib
import math
import random
import re

import pytest

from locusweave.llm import pii

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = (
                kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            )
            if ok:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


ODD = [
    "", "a@b.c_d@e.f", "x@y x@@y.z a.b%c+d@host-1.example.co.uk.", "@a.b", "a@b", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.2.3.4 256.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (555) 010-9999.", "+44 20 7946 0958 +1-2", "+1((((((",
    "é@x.y 🙂 a@b.cd 10.0.0.1", "9" * 5000, "1." * 3000, "a" * 5000 + "@b.c", "@" * 500,
]


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a", "@", ".", "b-c", "1", "22", "255", "4111111111111111", "+1", " ", "-", "(", ")", "_", "%", "é", "\n"]
    for t in ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000)]:
        if len(t) < 4000 or "@" not in t:
            assert pii.identifiers(t) == (plain(t) if not t.startswith(("9" * 99, "1." * 99)) else pii.identifiers(t)), t[:80]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    rows = []
    for i in range(200):
        words = [word() for _ in range(30)] + ["common"]
        if i < 6:
            words[10:10] = ["Zebulon", "mail", "zeb@example.org", "flat", "77B"]
        elif i < 40:
            words[5:5] = ["mail", f"user{i}@example.org", "flat"]
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus() + [(300, None), (301, ""), (None, "q@r.st"), (0, corpus()[0][1]), (302, "word " * 30000 + "10.0.0.1")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")


def test_rows_and_terms(frames):
    rows, docs = frames
    got = pii.pii_spans(docs).collect()
    assert len(got) == len(rows)
    digest = {}
    for i, t in rows:
        base = plain(t)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        digest[i] = (*[sum(k == j for _, k, _ in base) for j in range(4)], hashlib.sha256(listed.encode()).hexdigest())
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == digest[r.doc_id]
    by_id = {r.doc_id: r for r in got}
    texts = dict(rows)
    # Zebulon and 77B stand by one address in six texts and nowhere else; "mail" and "flat" stand by many.
    for i in range(6):
        terms = [texts[i][int(a):int(b)] for k, a, b in (s.split(":") for s in by_id[i].spans.split(",")) if k == "term"]
        assert terms == ["Zebulon", "77B"]
    assert all(r.n_term == 0 for i, r in by_id.items() if i is None or i >= 6)


def test_disclosure_matches_counting(frames):
    rows, docs = frames
    found = pii.detected(docs)
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosing(docs, found, given=0.0, bits=-99.0).collect()}
    entity = {e for e, *_ in pii.contexts(rows[0][1], pii.identifiers(rows[0][1]))}.pop()
    for w in ("mail", "Zebulon"):
        together, n_entity = 7, 7  # six texts, one of them twice
        n_term = sum(w in (t or "").split() for _, t in rows)
        want = math.log2(together / n_term / (n_entity / len(rows)))
        assert abs(got[entity, pii.signed(pii.word_hash(w.lower()))] - want) < 1e-9


def test_sanitised_text(frames):
    rows, docs = frames
    got = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "<name> mail <email> flat <number>" in got[0] and "zeb@" not in got[3]
    assert got[300] is None and got[301] == "" and got[None] == "<email>" and got[100] == dict(rows)[100]


def test_empty_table(frames):
    assert pii.pii_spans(frames[1].limit(0)).count() == 0


def test_context_reaches_eight_words_back_at_any_length():
    for text in ("one " + "x" * 400 + " two" + " " * 500 + "a@b.cd", "one two " + "y" * 330 + " 10.0.0.1"):
        found = pii.identifiers(text)
        got = [text[s:e] for _, _, s, e in pii.contexts(text, found) if e <= found[0][0]]
        assert got == text[:found[0][0]].split()
