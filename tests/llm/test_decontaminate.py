"""Planted leaks, and alignment and seeds against brute force."""

import random

import numpy as np
import pytest

from locusweave.llm import decontaminate as dc


def vocabulary(rng, n=4000):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def edited(rng, words, share, vocab):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(rng.choice(vocab) if x < share else w)
        if x > 1 - share / 3:
            out.append(rng.choice(vocab))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(7)
    vocab = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(20, 50))) for i in range(40)]
    items[5] = (5, "Ábc dé, fgh! IJK lmn opq rst uvw xyz")
    rows, want = [], set()
    for i in range(300):
        words, k = text(rng.randint(20, 300)).split(), rng.randrange(40)
        if i % 4 == 0:
            words[10:10] = edited(rng, items[k][1].split(), 0.0 if i % 8 else 0.2, vocab)
            want.add((i, k))
        rows.append((i, " ".join(words), "x"))
    rows += [(400 + i, items[3][1].upper() + " tail", "x") for i in range(200)]
    want |= {(400 + i, 3) for i in range(200)}
    rows += [(900, None, "x"), (901, "", "x"), (None, items[4][1], "x"), (902, "ábc DÉ fgh ijk lmn opq rst uvw xyz", "x"), (903, text(90000) + " " + items[6][1], "x")]
    want |= {(None, 4), (902, 5), (903, 6)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "one two")], "item_id long, text string")
    return docs, bench, want


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 300])
def test_planted_leaks(frames, block_words):
    docs, bench, want = frames
    got = {(r.doc_id, r.item_id): r for r in dc.leaks(docs, bench, block_words=block_words).collect()}
    assert want - set(got) == set()
    assert set(got) <= want
    exact = got[400, 3]
    assert exact.similarity == 1.0 and exact.first_word == 0
    assert got[903, 6].first_word == 90000


def test_clean_rows_stay(frames):
    docs, bench, want = frames
    clean = dc.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {r.doc_id for r in dc.leaks(docs, bench).collect()}


def plain_align(doc, item):
    h = np.zeros((len(item) + 1, len(doc) + 1), int)
    for a in range(1, len(item) + 1):
        for b in range(1, len(doc) + 1):
            s = dc.MATCH if item[a - 1] == doc[b - 1] else dc.MISMATCH
            h[a, b] = max(0, h[a - 1, b - 1] + s, h[a - 1, b] + dc.GAP, h[a, b - 1] + dc.GAP)
    return h.max()


def test_alignment_matches_the_plain_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        doc, item = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(1, 20))
        assert dc.align(doc, item)[0] == plain_align(doc, item)


def test_empty_tables(frames):
    docs, bench, _ = frames
    assert dc.leaks(docs.limit(0), bench).count() == 0
    assert dc.leaks(docs, bench.limit(0)).count() == 0
    assert dc.decontaminated(docs, bench.limit(0)).count() == docs.count()
