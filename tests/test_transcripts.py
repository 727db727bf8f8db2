"""CIGAR goldens, splice patterns, boundary clusters, trims and clouds."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from locusweave.config import ClipTail, ExonTrim, Refine
from locusweave.functions.cigar import (
    acceptor_sites,
    exon_blocks,
    exon_shell,
    junction_positions,
    signature_similarity,
    soft_clip_lengths,
    splice_junctions,
    three_prime_clip,
)
from locusweave.operators.clouds import cloud_reads, emission_points, find_clouds
from locusweave.operators.evaluate import assign, evaluate_optimal, evaluation_totals, greedy_match, optimal_match
from locusweave.operators.features import (
    advanced_features,
    advanced_filter,
    advanced_similarity,
    evidence_class,
    evidence_score,
    intron_histogram,
    locus_evidence,
    segment_confidence,
    validation,
)
from locusweave.operators.refine import exon_trim, jaccard_trim, prominent_valleys, refine_loci, split_at_strand_valleys
from locusweave.operators.transcripts import (
    anchored_clusters,
    end_clusters,
    merge_split_points,
    site_support,
    splice_clusters,
    split_clouds,
    summary_similarity,
)
from locusweave.operators.trims import clip_tail_trim

CIGAR = "array<struct<op:string,len:int>>"


def ops(text):
    out, n = [], ""
    for ch in text:
        if ch.isdigit():
            n += ch
        else:
            out.append((ch, int(n)))
            n = ""
    return out


def cigars(spark, *texts, reverse=None):
    rows = [(i, 100, ops(t), bool(reverse and reverse[i])) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"i int, start long, cigar {CIGAR}, rev boolean")


def column(df, c):
    return [r["x"] for r in df.select("i", c.alias("x")).orderBy("i").collect()]


def test_three_prime_clip_goldens(spark):
    df = cigars(spark, "5S100M", "100M5S", "100M50S10N20M", "5S100M3S", "12S80M", "80M12S", "10M", reverse=[0, 0, 0, 0, 1, 1, 0])
    got = column(df, three_prime_clip("cigar", F.col("rev")))
    assert [tuple(x) if x else None for x in got] == [None, (100, 105), (100, 150), (105, 108), (0, 12), None, None]
    lens = column(df, soft_clip_lengths("cigar", F.col("rev")))
    assert [tuple(x) for x in lens] == [(5, 0), (0, 5), (0, 50), (5, 3), (0, 12), (12, 0), (0, 0)]


def test_blocks_and_junctions(spark):
    df = cigars(spark, "5S10M20N5M2D3I5M10N7M4S", "30M", "5N")
    pairs = lambda xs: [[(b["start"], b["end"]) for b in x] for x in xs]
    assert pairs(column(df, exon_blocks("start", "cigar"))) == [[(100, 110), (130, 142), (152, 159)], [(100, 130)], []]
    assert [tuple(x) if x else None for x in column(df, exon_shell("start", "cigar"))] == [(100, 159), (100, 130), None]
    assert pairs(column(df, splice_junctions("start", "cigar"))) == [[(110, 130), (142, 152)], [], [(100, 105)]]
    assert column(df, acceptor_sites("start", "cigar")) == [[130, 152], [], [105]]
    assert column(df, junction_positions("start", "cigar"))[0] == [110, 130, 122, 132]
    assert column(df, junction_positions("start", "cigar", advance=True))[0] == [110, 130, 142, 152]


def test_signature_similarity(spark):
    j = "array<struct<start:long,end:long>>"
    df = spark.createDataFrame([([(1, 50), (100, 200)], [(5, 55), (300, 400)]), ([], [(1, 2)])], f"a {j}, b {j}")
    assert [r["x"] for r in df.select(signature_similarity("a", "b").alias("x")).collect()] == [pytest.approx(1 / 3), 0.0]


def test_anchored_clusters_and_site_support(spark):
    pos = [0, 8, 12, 13, 25, 26]
    df = spark.createDataFrame([("k", p, f"r{i % 2}") for i, p in enumerate(pos)], "k string, pos long, read_id string")
    incl = {r["pos"]: r["anchor"] for r in anchored_clusters(df, ["k"], 12, True).collect()}
    assert incl == {0: 0, 8: 0, 12: 0, 13: 13, 25: 13, 26: 26}
    excl = {r["pos"]: r["anchor"] for r in anchored_clusters(df, ["k"], 12, False).collect()}
    assert excl == {0: 0, 8: 0, 12: 12, 13: 12, 25: 25, 26: 25}
    got = {(r["center"], r["n_reads"]) for r in site_support(df, ["k"], 12).collect()}
    assert got == {(6, 2), (19, 2), (26, 1)}


def test_end_clusters_walk_from_the_outer_side(spark):
    t = spark.createDataFrame(
        [("a", "c", s, e, st) for s, e, st in [(0, 50, "+"), (9, 60, "+"), (10, 70, "+"), (0, 100, "-"), (3, 91, "-"), (5, 90, "-")]],
        "locus_id string, chrom string, start long, end long, strand string")
    got = {(r["strand"], r["start"], r["end"], r["n_transcripts"]) for r in end_clusters(t, 10).collect()}
    assert got == {("+", 0, 60, 2), ("+", 10, 70, 1), ("-", 0, 100, 2), ("-", 5, 90, 1)}


def test_leaders_prefer_the_most_similar(spark):
    j = lambda *xs: [(x, x + 50) for x in xs]
    rows = [("a", "c", r, i, i + 9, js) for i, (r, js) in enumerate(
        [("p", j(0, 100)), ("q", j(500, 600)), ("r", j(0, 500, 600)), ("s", j(3, 104))])]
    sig = spark.createDataFrame(rows, "locus_id string, chrom string, read_id string, start long, end long, junctions array<struct<start:long,end:long>>")
    got = {r["read_id"]: r["cluster"] for r in splice_clusters(sig, 0.2).collect()}
    assert got == {"p": 0, "q": 1, "r": 1, "s": 0}


def test_split_points_merge_by_confidence(spark):
    pts = spark.createDataFrame([("a", 1000, 1.0, "x"), ("a", 5000, 0.5, "y"), ("a", 30_000, 0.2, "z")],
                                "locus_id string, position long, confidence double, evidence string")
    got = merge_split_points(pts).orderBy("position").collect()
    assert [(r["position"], r["confidence"], r["evidence"]) for r in got] == [(2333, 1.0, "x+y"), (30_000, 0.2, "z")]


def test_cloud_without_signals_stays_whole(spark):
    a = spark.createDataFrame([(1, "c", 0, 90_000, 0)], "read_id long, chrom string, start long, end long, flag int")
    cl = spark.createDataFrame([("a", "c", 0, 90_000)], "locus_id string, chrom string, start long, end long")
    assert [tuple(r) for r in split_clouds(a, cl).collect()] == [("a", "c", 0, 90_000, "no_clear_splits")]


def test_summary_similarity(spark):
    s = "struct<plus:long,minus:long,mean_length:double,length_cv:double,coverage_std:double>"
    df = spark.createDataFrame([((3, 1, 1000.0, 0.0, 5.0), (2, 1, 1000.0, 0.0, 60.0)), ((3, 1, 1000.0, 0.0, 5.0), (1, 1, 1000.0, 0.0, 60.0))],
                               f"a {s}, b {s}")
    assert [r["x"] for r in df.select(summary_similarity("a", "b").alias("x")).collect()] == [1.0, 0.0]


def brute_emissions(rows, need, lo, hi):
    out = {}
    for p in sorted({r[1] for r in rows}):
        act = sorted((r for r in rows if r[1] <= p < r[2]), key=lambda r: (r[1], r[2]))
        seen = {}
        for r in act:
            seen.setdefault(r[0], r[3])
        s, e = min(r[1] for r in act), max(r[2] for r in act)
        if sum(seen.values()) >= need * 10 and lo <= e - s <= hi:
            out[p] = (s, e, {r[0] for r in act})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_clouds_against_a_sweep(spark, seed, monkeypatch):
    import locusweave.operators.clouds as clouds

    monkeypatch.setattr(clouds, "TILE", 64)
    r = random.Random(seed)
    rows = [(r.randrange(12), s, s + r.randrange(1, 90), r.choice([10, 13, 32])) for s in (r.randrange(600) for _ in range(70))]
    a = spark.createDataFrame([(x[0], "c", "+", x[1], x[2], x[3], 1, 0, 0) for x in rows],
                              "read_id long, chrom string, strand string, start long, end long, w long, is_primary long, is_secondary long, is_supplementary long")
    want = brute_emissions(rows, 4, 60, 200)
    pts = emission_points(a, ["chrom"], 4, 60, 200)
    assert {x["pos"]: (x["start"], x["end"]) for x in pts.collect()} == {p: v[:2] for p, v in want.items()}
    found, reads = find_clouds(a, 4, 60, 200)
    merged = []
    for s, e, names in sorted(want.values(), key=lambda v: v[0]):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]), merged[-1][2] | names)
        else:
            merged.append((s, e, names))
    assert sorted((x["start"], x["end"], x["n_reads"]) for x in found.collect()) == [(s, e, len(n)) for s, e, n in merged]
    assert {(x["cloud_start"], x["read_id"]) for x in cloud_reads(a, pts, found, ["chrom"]).collect()} == {
        (s, n) for s, _, names in merged for n in names}
    assert reads.count() == sum(len(n) for _, _, n in merged)


ALN = f"read_id long, chrom string, start long, end long, flag int, cigar {CIGAR}, seq string"
LOCUS = "locus_id string, chrom string, start long, end long"


def test_exon_trim(spark):
    rows = [(i, "c", 200, 800, 0, ops("100M400N100M"), "") for i in range(5)]
    a = spark.createDataFrame(rows, ALN)
    loci = spark.createDataFrame([("a", "c", 0, 1000), ("z", "c", 5000, 6000)], LOCUS)
    m = spark.createDataFrame([("a", i) for i in range(5)], "locus_id string, read_id long")
    got = {r["locus_id"]: (r["new_start"], r["new_end"]) for r in exon_trim(a, loci, m, ExonTrim(min_span=100)).collect()}
    assert got == {"a": (200, 800), "z": (5000, 6000)}
    capped = exon_trim(a, loci, m, ExonTrim(min_span=100, max_trim_frac=0.1)).where("locus_id = 'a'").first()
    assert (capped["new_start"], capped["new_end"]) == (100, 900)


def test_clip_tail_trim(spark):
    rows = [(i, "c", 100, 3000 + i, 0, ops("100M20S"), "C" * 100 + "A" * 20) for i in range(6)]
    rows.append((9, "c", 100, 4000, 0, ops("100M20S"), "C" * 120))
    loci = spark.createDataFrame([("a", "c", 50, 5000)], LOCUS)
    m = spark.createDataFrame([("a", r[0]) for r in rows], "locus_id string, read_id long")
    got = clip_tail_trim(spark.createDataFrame(rows, ALN), loci, m).first()
    assert (got["start"], got["end"]) == (50, 3402)
    few = clip_tail_trim(spark.createDataFrame(rows, ALN), loci, m, ClipTail(min_reads=7)).first()
    assert few["end"] == 5000


def test_strand_valleys(spark):
    prof = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([4, 1, 8, 8, 2, 5])], "locus_id string, bin long, cov double")
    got = {(r["bin"], round(r["prominence"], 3)) for r in prominent_valleys(prof).collect()}
    assert got == {(1, 0.75), (4, 0.6)}


def test_wide_loci_are_cut_between_two_piles(spark):
    rows = [(i, "c", s, s + 40_000, 0, ops("40000M"), "") for i in range(4) for s in (0, 80_000)]
    a = spark.createDataFrame(rows, ALN)
    loci = spark.createDataFrame([("a", "c", 0, 120_000), ("b", "d", 0, 150_000)], LOCUS)
    got = {(r["locus_id"], r["start"], r["end"]) for r in split_at_strand_valleys(a, loci).collect()}
    # A flat gap has no strict minimum, so nothing is cut.
    assert got == {("a", 0, 120_000), ("b", 0, 150_000)}
    dip = spark.createDataFrame([*rows, (50, "c", 40_500, 60_000, 0, ops("19500M"), ""), (51, "c", 61_200, 79_999, 0, ops("18799M"), "")], ALN)
    cut = sorted((r["start"], r["end"]) for r in split_at_strand_valleys(dip, loci).where("locus_id = 'a'").collect())
    assert cut == [(0, 60_500), (60_500, 120_000)]


def test_jaccard_trim_and_refine(spark):
    # Reference reads cover the middle only; the flanks belong to others.
    rows = [(i, "c", 4000, 8000, 0, ops("4000M"), "") for i in range(20)] + [(100 + i, "c", 0, 3000, 0, ops("3000M"), "") for i in range(5)]
    a = spark.createDataFrame(rows, ALN)
    loci = spark.createDataFrame([("a", "c", 0, 12_000)], LOCUS)
    ref = spark.createDataFrame([(i,) for i in range(20)], "read_id long")
    p = Refine(min_region=1000, window=1000, step=500)
    t = jaccard_trim(a, loci, ref, p).first()
    assert (t["jac_start"], t["jac_end"]) == (0, 11_999)
    r = refine_loci(a, loci, ref, p).first()
    assert r["method"] == "IsoSeq" and (r["start"], r["end"]) == (4000, 8000) and r["jaccard"] == 1.0


def test_assignment_is_optimal():
    r = random.Random(5)
    for _ in range(60):
        n, m = r.randrange(1, 6), r.randrange(1, 6)
        edges = {g: {d: r.randrange(0, 1_000_000) for d in range(m) if r.random() < 0.7} for g in range(n)}
        got = assign(edges)
        assert len(set(got.values())) == len(got)
        cost = sum(edges[g][d] for g, d in got.items()) + 1_000_000 * (n - len(got))
        best = min(
            sum(edges[g].get(d, 1_000_000) if d is not None else 1_000_000 for g, d in zip(range(n), pick))
            for pick in itertools.permutations([*range(m), *[None] * n], n)
        )
        assert cost == best


GENE = "family_id string, gene_id string, gene_name string, chrom string, start long, end long"
DET = "family_id string, locus_id string, chrom string, start long, end long"


def test_matches(spark):
    genes = spark.createDataFrame([("f", "g1", "g1", "c", 0, 100), ("f", "g2", "g2", "c", 90, 200), ("f", "g3", "g3", "d", 0, 10)], GENE)
    det = spark.createDataFrame([("f", "x", "c", 0, 200), ("f", "y", "c", 95, 210), ("h", "z", "d", 0, 10)], DET)
    assert {(r["gene_id"], r["locus_id"]) for r in optimal_match(genes, det).collect()} == {("g1", "x"), ("g2", "y")}
    assert {(r["gene_id"], r["locus_id"]) for r in greedy_match(genes, det).collect()} == {("g2", "y"), ("g1", "x")}
    seeds = spark.createDataFrame([("f", 0, "d", 0, 10)], "family_id string, seed_ord long, chrom string, start long, end long")
    per = evaluate_optimal(genes, det, seeds)
    got = {r["gene_id"]: (r["found"], r["confirmed_by_seed"]) for r in per.collect()}
    assert got == {"g1": (True, False), "g2": (True, False), "g3": (True, True)}
    t = evaluation_totals(per, det.where("family_id = 'f'")).first()
    assert (t["genes_found"], t["extra_regions"], t["sensitivity"], t["precision"]) == (3, 0, 100.0, 100.0)
    none = evaluation_totals(evaluate_optimal(genes, det.where("false")), det.where("false")).first()
    assert (none["genes_found"], none["precision"]) == (0, 0.0)


def test_features_and_validation(spark):
    schema = ALN + ", de double, as_score int, rq double, np int, cm int"
    rows = [(i, "c", 0, 1000, 16 * (i == 3), ops("300M100N300M100N200M"), "", 0.01, 10, 0.9, 5, 790) for i in range(4)]
    rows.append((9, "c", 0, 1000, 256, ops("1000M"), "", None, None, None, None, None))
    a = spark.createDataFrame(rows, schema)
    loci = spark.createDataFrame([("a", "c", 0, 1000), ("z", "d", 0, 10)], LOCUS)
    f = {r["locus_id"]: r for r in advanced_features(a, loci).collect()}
    assert (f["a"]["total"], f["a"]["minus"], f["a"]["mean_introns"], f["a"]["n_full_length"]) == (4, 1, 2.0, 4)
    assert f["a"]["strand_consistency"] == 0.75 and f["a"]["secondary_ratio"] == pytest.approx(0.2) and f["z"]["total"] == 0
    assert [r["locus_id"] for r in advanced_filter(advanced_features(a, loci), 3).collect()] == ["a"]
    assert intron_histogram(a, loci).first()["introns"] == {2: 4, 0: 1}
    packed = advanced_features(a, loci).where("locus_id = 'a'").select(F.struct("*").alias("a"), F.struct("*").alias("b"))
    assert packed.select(advanced_similarity("a", "b").alias("x")).first()["x"] == pytest.approx(0.25 + 0.2 + 0.15 + 0.075 + 0.1 + 0.1 + 0.05)
    e = locus_evidence(a, loci).where("locus_id = 'a'")
    x = e.select("spliced", "unspliced", evidence_score(F.lit(True)).alias("s")).first()
    assert (x["spliced"], x["unspliced"], x["s"]) == (4, 1, pytest.approx(0.1 * 0.35 + 0.9 * 0.25 + 0.9 * 0.2 + 0.2))
    assert spark.range(1).select(evidence_class(F.lit(0.71)).alias("c")).first()["c"] == "true_gene"
    seg = spark.createDataFrame([(0, 10_000, 200), (0, 1000, 5)], "start long, end long, n_reads long")
    assert [(r["confidence"], r["is_valid"]) for r in segment_confidence(seg).collect()] == [(1.0, True), (pytest.approx(0.5 * 0.3 * 0.3), False)]
    v = spark.createDataFrame([(0.9, 0.1, 0.6, 0.6, 0.5, None, 3)], "score double, symmetry double, left_slope double, right_slope double, jaccard double, isoseq double, n_seeds int")
    out = validation(v).first()
    assert (out["coverage_confidence"], out["is_valid"]) == ("High", True) and out["normalized_score"] == pytest.approx((0.3 + 0.1 + 0.2) / 0.5)
