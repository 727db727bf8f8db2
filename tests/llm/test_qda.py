"""The discriminant against numpy on planted classes, and the defined results of odd rows."""

import random
import zlib

import numpy as np
import pytest

from locusweave.llm import qda


@pytest.fixture(scope="module")
def frames(spark):
    rng, rows = random.Random(1), []
    for i in range(400):
        good = int(rng.random() < 0.7)
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(w if good else w + rng.choice(["###", "$$$"]) for w in words) + ".", good))
    odd = [(1000, None), (1001, ""), (1002, "\n"), (None, rows[0][1]), (0, rows[0][1]), (1003, "abc de " * 50000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(i, t, "x") for i, t in odd], "doc_id long, text string, x string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, y int")
    return rows, docs, labels


def test_held_out_accuracy(frames):
    rows, docs, labels = frames
    got = qda.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by_id[i].held_out for i, _ in held)
    assert sum(by_id[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert by_id[1000].score == by_id[1001].score == by_id[1002].score
    assert by_id[None].score == by_id[0].score and not by_id[None].held_out


def test_density_ratio_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (200, 3))])
    y = [0] * 300 + [1] * 200
    df = spark.createDataFrame([(v.tolist(), k) for v, k in zip(x, y)], "x array<double>, y int")
    model = qda.fit(df, width=3, shrinkage=0.0, floor=0.0)
    logs = []
    for k, n in ((0, 300), (1, 200)):
        part = x[np.array(y) == k]
        m, c = part.mean(axis=0), np.cov(part.T, bias=True)
        far = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        logs.append(np.log(n) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * far)
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_without_both_classes(frames):
    _, docs, labels = frames
    assert {r.score for r in qda.quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in qda.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert qda.quality_scores(docs.limit(0), labels).count() == 0
