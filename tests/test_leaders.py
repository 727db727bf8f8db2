"""Greedy selection by rounds against walking the rows in order."""

import random

import pytest

from locusweave.operators.folds import drop_covered
from locusweave.operators.leaders import dropped_by_order, keep_apart, leaders


def greedy(n, pairs):
    """Kept nodes and everyone's first kept partner."""
    near = {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    kept, lead = [], {}
    for v in range(n):
        first = [k for k in kept if k in near.get(v, ())]
        if first:
            lead[v] = first[0]
        else:
            kept.append(v)
            lead[v] = v
    return lead


@pytest.mark.parametrize(("n", "edges", "rounds"), [(60, 90, 6), (60, 400, 1), (40, 60, 0), (50, None, 2)])
def test_leaders_are_those_of_the_walk(spark, n, edges, rounds):
    r = random.Random(n + rounds)
    if edges is None:  # one chain, the worst case for rounds
        pairs = [(i, i + 1) for i in range(n - 1)]
    else:
        pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(edges)})
    name = [f"n{r.random()}" for _ in range(n)]
    p = spark.createDataFrame([(name[a], name[b], b) for a, b in pairs], "first string, second string, at int")
    want = greedy(n, pairs)
    gone = {x["node"] for x in dropped_by_order(p, rounds).collect()}
    assert gone == {name[v] for v, k in want.items() if k != v}
    if rounds == 6:
        nodes = spark.createDataFrame([(name[i], i) for i in range(n)], "node string, at int")
        assert {(x["node"], x["leader"]) for x in leaders(nodes, p).collect()} == {(name[v], name[k]) for v, k in want.items()}


def test_without_conflicts(spark):
    p = spark.createDataFrame([], "first string, second string, at int")
    assert dropped_by_order(p).count() == 0
    assert [tuple(x) for x in leaders(spark.createDataFrame([("a", 0)], "node string, at int"), p).collect()] == [("a", "a")]


@pytest.mark.parametrize(("span", "rounds"), [(40_000, 6), (3_000, 6), (3_000, 1), (900, 0)])
def test_keep_apart(spark, span, rounds):
    r = random.Random(span + rounds)
    rows = [(i, f"c{r.randrange(2)}", s := r.randrange(span), s + r.randrange(5, 500)) for i in range(150)]
    rows += [(200 + i, *rows[i][1:]) for i in range(20)] + [(300 + i, "c9", 55 * i, 55 * i + 7) for i in range(90)]
    r.shuffle(rows)
    kept = []
    for row in sorted(rows):
        if not any(k[1] == row[1] and (abs(k[2] - row[2]) < 60 or abs(k[3] - row[3]) < 60) for k in kept):
            kept.append(row)
    df = spark.createDataFrame(rows, "ord long, chrom string, start long, end long")
    assert sorted(map(tuple, keep_apart(df, ["ord"], 60, rounds=rounds).collect())) == kept


def test_drop_covered(spark):
    r = random.Random(4)
    rows = [(f"c{r.randrange(2)}", s := r.randrange(900), s + r.randrange(5, 200)) for _ in range(150)]
    rows += rows[:10]
    kept = []
    for c, s, e in sorted(rows, key=lambda x: (x[1] - x[2], x)):
        shared = [(min(e, k[2]) - max(s, k[1]), min(e - s, k[2] - k[1])) for k in kept if k[0] == c]
        if not any(o > 0 and o >= 0.8 * m for o, m in shared):
            kept.append((c, s, e))
    got = drop_covered(spark.createDataFrame(rows, "chrom string, start long, end long"))
    # Of equally long ones the smaller start comes first, then the smaller chromosome, which is no conflict.
    assert sorted(map(tuple, got.collect())) == sorted(kept)


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_splice_clusters_are_those_of_the_walk(spark, least):
    from locusweave.operators.transcripts import splice_clusters

    r = random.Random(int(least * 10))
    rows = []
    for i in range(160):
        chain = [(s := 100 * k + r.choice([0, 6, 14, 30]), s + 40 + r.choice([0, 9])) for k in sorted(r.sample(range(5), r.randrange(1, 4)))]
        rows.append((f"l{r.randrange(2)}", "c", i, r.randrange(60), 900, chain))
    near = lambda a, b: abs(a[0] - b[0]) <= 10 and abs(a[1] - b[1]) <= 10
    found, want = {}, {}
    for row in sorted(rows, key=lambda x: (x[0], x[3], x[2])):
        heads = found.setdefault(row[0], [])
        best, at = 0.0, None
        for i, lead in enumerate(heads):
            hit = sum(any(near(x, y) for y in lead) for x in row[5])
            s = hit / (len(row[5]) + len(lead) - hit)
            if s >= least and s > best:
                best, at = s, i
        if at is None:
            heads.append(row[5])
            at = len(heads) - 1
        want[row[2]] = at
    df = spark.createDataFrame(rows, "locus_id string, chrom string, read_id long, start long, end long, junctions array<struct<start:long,end:long>>")
    assert {x["read_id"]: x["cluster"] for x in splice_clusters(df, least).collect()} == want
