"""Accuracy on planted toxic texts, and the defined results of odd rows."""

import random
import zlib

import pytest

from locusweave.llm import toxicity

INSULTS = ["vermin", "blockhead", "nitwit", "scoundrel"]


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    parts = ["an", "der", "ing", "tha", "ou", "re", "ti", "sh", "ble", "er"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(30, 200))], int(rng.random() < 0.25)
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus()
    odd = [(1000, None), (1001, ""), (1002, " \n "), (None, "you nitwit"), (0, rows[0][1]), (1003, "nitwit vermin " + "an der ing " * 20000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(i, t, "x") for i, t in odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    return rows, docs, labels


def test_held_out_accuracy(frames):
    rows, docs, labels = frames
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by_id[i].held_out for i, _ in held) and sum(r.held_out for r in got if r.doc_id is not None and r.doc_id < 400) in (len(held), len(held) + 1)
    assert sum(by_id[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert by_id[1000].score == by_id[1001].score == by_id[1002].score < 0.5 and by_id[None].predicted == 1


def test_without_both_classes(spark, frames):
    _, docs, labels = frames
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_words_known_by_their_beginning_only(spark):
    rng = random.Random(9)
    parts = ["an", "der", "ing", "tha", "ou", "re", "ti", "sh", "ble", "er", "gor", "bash"]
    word = lambda n: "".join(rng.choice(parts) for _ in range(n))
    rows = []
    for i in range(400):
        words, toxic = [word(rng.randint(1, 4)) for _ in range(rng.randint(40, 200))], int(rng.random() < 0.25)
        # The toxic beginning stands inside ordinary words, too, and each toxic word has another end.
        for _ in range(max(3, len(words) // 25)):
            words.insert(rng.randrange(len(words)), ("" if toxic else "re") + "gorbash" + word(rng.randint(1, 3)))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect() if r.held_out}
    truth = {i: y for i, _, y in rows}
    for y in (0, 1):
        same = [predicted[i] == y for i in predicted if truth[i] == y]
        assert len(same) > 5 and sum(same) >= 0.9 * len(same)


def test_coded_words_share_bytes_as_far_as_they_begin_alike():
    a, b, c = (toxicity.coded(f" {w} ".encode()) for w in ("gorbashing", "gorbasher", "regorbashing"))
    assert a[:8] == b[:8] and a[8:9] != b[8:9] and len(a) == 12
    assert not any(a[1:][i:i + 3] in c for i in range(8))
