"""Set similarity, graph traversal and seed statistics against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from locusweave.functions.statistics import PUBLISHED_TERMS, erf, hypergeometric_upper_tail, ln_binomial
from locusweave.operators.graph import adaptive_edge_threshold, connected_components, hop_distances
from locusweave.operators.readsets import jaccard_edges, jaccard_to_reference
from locusweave.plans.seeds import core_reads, merge_seeds, novel_regions, select_connected_seeds


def random_sets(seed, n=40, universe=60):
    r = random.Random(seed)
    # Reads 0-2 are in most sets.
    return {
        i: {x for x in range(3) if r.random() < 0.8} | set(r.sample(range(universe), r.randrange(1, 12))) for i in range(n)
    }


@pytest.mark.parametrize("t", [0.01, 0.1, 0.3, 0.6])
@pytest.mark.parametrize("hot", [1, 4, 256])
def test_jaccard_edges(spark, t, hot):
    sets = random_sets(int(t * 100) + hot)
    df = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "locus_id long, read_id long")
    got = {(r["src"], r["dst"]): (r["shared"], round(r["jaccard"], 9)) for r in jaccard_edges(df, t, hot=hot).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= t:
            want[a, b] = (len(sets[a] & sets[b]), round(j, 9))
    assert got == want


def test_jaccard_edges_per_key_and_true_value(spark):
    rows = [(0, "a", x) for x in range(4)] + [(0, "b", x) for x in range(2, 6)] + [(1, "a", 1), (1, "c", 1)]
    got = jaccard_edges(spark.createDataFrame(rows, "k int, locus_id string, read_id long"), 0.2, ("k",)).collect()
    assert {(r["k"], r["src"], r["dst"]): r["jaccard"] for r in got} == {(0, "a", "b"): pytest.approx(1 / 3), (1, "a", "c"): 1.0}
    with pytest.raises(ValueError):
        jaccard_edges(spark.createDataFrame(rows, "k int, locus_id string, read_id long"), 0.0)


def test_jaccard_to_reference(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9)], "locus_id string, read_id long")
    ref = spark.createDataFrame([(1,), (3,)], "read_id long")
    got = {r["locus_id"]: (r["n_reads"], r["shared"], r["jaccard"]) for r in jaccard_to_reference(m, ref).collect()}
    assert got == {"a": (2, 1, pytest.approx(1 / 3)), "b": (1, 0, 0.0)}


def random_graph(seed, n=40, m=45):
    r = random.Random(seed)
    return {tuple(sorted(r.sample(range(n), 2))): round(r.random(), 3) for _ in range(m)}


def test_hop_distances_keep_the_best_bottleneck(spark):
    g = random_graph(3)
    df = spark.createDataFrame([(a, b, j) for (a, b), j in g.items()], "src long, dst long, jaccard double")
    got = {r["node"]: (r["distance"], r["bottleneck"]) for r in
           hop_distances(df, spark.createDataFrame([(0,)], "node long")).collect()}
    best, frontier, d = {0: (0, 1.0)}, {0: 1.0}, 0
    while frontier:
        d += 1
        nxt = {}
        for (a, b), j in g.items():
            for u, v in ((a, b), (b, a)):
                if u in frontier and v not in best:
                    nxt[v] = max(nxt.get(v, 0), min(frontier[u], j))
        best.update({v: (d, x) for v, x in nxt.items()})
        frontier = nxt
    assert got == best


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    g = random_graph(seed, 60, 40)
    chain = [(100 + i, 101 + i) for i in range(30)]
    hub = [(200, 201 + i) for i in range(20)]
    edges = [*g, *chain, *hub]
    nodes = [(i,) for i in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(nodes, "node long")).collect()}
    label = {i: i for i in {x for e in edges for x in e} | set(range(60))}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert got == label


def test_hypergeometric(spark):
    cases = [(10, 50, 30, 200), (2, 100, 100, 10000), (40, 50, 50, 100), (0, 3, 3, 9), (5, 3, 9, 20), (1, 7, 9, 20)]

    def exact(k, K, n, N):
        top = min(K, n)
        return sum(math.comb(K, i) * math.comb(N - K, n - i) for i in range(k, top + 1) if n - i <= N - K) / math.comb(N, n)

    df = spark.createDataFrame(cases, "k long, pop long, draw long, total long")
    for r in hypergeometric_upper_tail(df, "k", "pop", "draw", "total").collect():
        assert r["p_value"] == pytest.approx(exact(r["k"], r["pop"], r["draw"], r["total"]), abs=1e-9)
    big = spark.createDataFrame([(10**12, 10), (500, 250), (20, 0)], "n long, k long")
    for r in big.withColumn("v", ln_binomial(F.col("n"), F.col("k"))).collect():
        want = math.lgamma(r["n"] + 1) - math.lgamma(r["k"] + 1) - math.lgamma(r["n"] - r["k"] + 1) if r["n"] < 10**6 else (
            sum(math.log((r["n"] - i) / (i + 1)) for i in range(r["k"])))
        assert r["v"] == pytest.approx(want, rel=1e-10, abs=1e-10)


def test_many_terms_are_summed_exactly(spark):
    cases = [(1000, 20_000, 10_000, 200_000), (1200, 20_000, 10_000, 200_000), (5000, 20_000, 10_000, 200_000), (10, 20_000, 10_000, 200_000), (9000, 9000, 9000, 10**7)]
    df = spark.createDataFrame(cases, "k long, p long, d long, n long")
    ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    for r in hypergeometric_upper_tail(df, "k", "p", "d", "n").collect():
        logs = [ln(r.p, i) + ln(r.n - r.p, r.d - i) - ln(r.n, r.d) for i in range(r.k, min(r.p, r.d) + 1)]
        top = max(logs)
        assert r.p_value == pytest.approx(min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs)), rel=1e-6, abs=1e-300)


def test_published_switch_to_the_normal_tail(spark):
    r = hypergeometric_upper_tail(
        spark.createDataFrame([(1000, 20_000, 10_000, 200_000)], "k long, p long, d long, n long"), "k", "p", "d", "n", PUBLISHED_TERMS).first()
    sd = math.sqrt(1000 * 0.9 * 190_000 / 199_999)
    assert r["p_value"] == pytest.approx(0.5 * math.erfc(-0.5 / sd / math.sqrt(2)), abs=1e-6)
    x = spark.createDataFrame([(0.5,), (-1.2,), (3.0,)], "x double").withColumn("e", erf(F.col("x"))).collect()
    assert all(abs(r["e"] - math.erf(r["x"])) < 2e-7 for r in x)


def test_adaptive_threshold(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3), (1, 0.0), (1, 0.4)], "shared long, jaccard double")
    assert adaptive_edge_threshold(df, 0.5, 1, 0.001).first()[0] == pytest.approx(0.3)
    assert adaptive_edge_threshold(df, 0.5, 3, 0.001).first()[0] == pytest.approx(0.001)


def test_core_reads(spark):
    rows = [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "z"), (3, "q"), (4, "m"), (4, "n"), (5, "n"), (5, "o"), (6, "o")]
    got = {(r["component"], r["read_id"]) for r in core_reads(spark.createDataFrame(rows, "seed_ord long, read_id string")).collect()}
    # Seeds 4, 5 and 6 hang together by different reads: no read is in all three.
    assert got == {(1, "x"), (1, "y"), (3, "q")}


SEED = "seed_ord long, chrom string, start long, end long, name string"


def test_merge_seeds(spark):
    a = spark.createDataFrame([(0, "c", 1000, 2000, "a")], SEED)
    b = spark.createDataFrame([(0, "c", 1050, 2050, "near"), (1, "c", 1050, 2100, "far end"), (2, "d", 1000, 2000, "other")], SEED)
    assert sorted(r["name"] for r in merge_seeds(a, b).collect()) == ["a", "far end", "other"]


def test_novel_regions(spark):
    known = spark.createDataFrame([("c", 1000, 2000)], "chrom string, start long, end long")
    cand = spark.createDataFrame([("c", 2100, 2200), ("c", 2099, 2200), ("c", 0, 900), ("d", 1500, 1600)], "chrom string, start long, end long")
    got = {(r["chrom"], r["start"]) for r in novel_regions(cand, known, 100).collect()}
    assert got == {("c", 2100), ("c", 0), ("d", 1500)}


def test_connected_seeds_take_the_last_of_equals(spark):
    aln = [(r, "c", s, s + 50, 0) for s in (100, 1000) for r in (1, 2)] + [(9, "c", 5000, 5050, 0)]
    seeds = spark.createDataFrame([(0, "c", 90, 200, None), (1, "c", 990, 1100, None), (2, "c", 4990, 5100, None)], SEED)
    got = select_connected_seeds(spark.createDataFrame(aln, "read_id long, chrom string, start long, end long, flag int"), seeds).collect()
    assert {(r["component"], r["seed_ord"], r["component_size"], r["n_reads"]) for r in got} == {(0, 1, 2, 2), (2, 2, 1, 1)}
