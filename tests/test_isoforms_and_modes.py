"""Isoform assembly and reseeding on small cases."""

from pyspark.sql import functions as F

from locusweave.config import Detect, Explore
from locusweave.operators.isoforms import (
    assemble_isoforms,
    chains_alike,
    exons_of_chain,
    isoform_confidence,
    read_genes,
    reverse_complement,
    snapped_chains,
    splice_site_class,
)
from locusweave.plans.adaptive import explore_pool, propose_hotspots
from locusweave.plans.fast import split_by_runs
from locusweave.config import Fast

J = "array<struct<start:long,end:long>>"


def test_assembly_snaps_and_counts_prefixes(spark):
    a, b = [(100, 200), (300, 400)], [(104, 203), (300, 400)]
    rows = [("r1", 10, 500, a), ("r2", 20, 520, b), ("r3", 30, 510, a), ("r4", 40, 260, [(101, 201)]), ("r5", 0, 90, []), ("r6", 9000, 9500, [(9100, 9200)])]
    reads = spark.createDataFrame([(i, "c", "+", s, e, j) for i, s, e, j in rows],
                                  f"read_id string, chrom string, strand string, start long, end long, junctions {J}")
    genes = read_genes(reads, 1000)
    assert genes.select("gene").distinct().count() == 2
    iso = assemble_isoforms(snapped_chains(genes)).collect()
    got = {(r["gene"], tuple((x["start"], x["end"]) for x in r["chain"])): (r["coverage"], r["start"], r["end"]) for r in iso}
    assert got == {(0, ((100, 200),)): (4, 25, 447), (0, ((100, 200), (300, 400))): (3, 20, 510)}


def test_small_expressions(spark):
    d = spark.createDataFrame([(0, 500, [(100, 200)], [(105, 195)], [(100, 200), (300, 400)])], f"s long, e long, a {J}, b {J}, c {J}")
    r = d.select(
        exons_of_chain("s", "e", "c").alias("x"), chains_alike(F.col("a"), F.col("b")).alias("y"),
        chains_alike(F.col("a"), F.col("c")).alias("z"), splice_site_class(F.lit("gt"), F.lit("AG")).alias("k"),
        reverse_complement(F.lit("AACG")).alias("rc"),
        isoform_confidence(F.lit(True), F.lit(1.0), F.lit(3.0), F.lit(100), 10).alias("conf"),
    ).first()
    assert [(x["start"], x["end"]) for x in r["x"]] == [(0, 100), (200, 300), (400, 500)]
    assert (r["y"], r["z"], r["k"], r["rc"]) == (True, False, "GT-AG", "CGTT") and abs(r["conf"] - 1.0) < 1e-12


ALN = "read_id long, chrom string, start long, end long, flag int"
SEED = "seed_ord long, chrom string, start long, end long, name string"


def world(spark):
    aln = [(r, c, s, s + 2000, 0) for r in range(30) for c, s in (("a", 1000), ("b", 50_000), ("c", 400_000))]
    aln += [(100 + r, "b", 50_000, 52_000, 0) for r in range(10)]
    a = spark.createDataFrame(aln, ALN)
    seeds = spark.createDataFrame([(0, "a", 900, 3100, "s")], SEED)
    found = spark.createDataFrame([("a:1", "a", 1000, 3000)], "locus_id string, chrom string, start long, end long")
    members = spark.createDataFrame([("a:1", r) for r in range(30)], "locus_id string, read_id long")
    return a, seeds, found, members


def test_exploration_takes_unknown_regions_of_the_pool(spark):
    a, seeds, found, members = world(spark)
    new = explore_pool(a, found, members, seeds, Detect(), Explore(max_new_seeds=5)).collect()
    assert {(r["chrom"], r["start"], r["end"], r["name"]) for r in new} == {
        ("b", 50_000, 52_000, "explore_seed_30"), ("c", 400_000, 402_000, "explore_seed_30")}
    one = explore_pool(a, found, members, seeds, Detect(), Explore(max_new_seeds=1, strict=True)).collect()
    assert [r["chrom"] for r in one] == ["b"]


def test_hotspots_need_support_of_several_seeds(spark):
    a, seeds, found, members = world(spark)
    x = Explore(max_new_seeds=5, hotspot_min_reads=30, hotspot_min_seeds=1, novel_distance=1000)
    near_b = spark.createDataFrame([(0, "b", 10_000, 20_000)], "seed_ord long, chrom string, start long, end long")
    got = propose_hotspots(a, found, members, seeds, near_b, x).collect()
    assert [(r["chrom"], r["start"], r["end"], r["name"]) for r in got] == [("b", 1, 50_000, "hotspot_seed_40_30_s1")]
    assert propose_hotspots(a, found, members, seeds, near_b, Explore(hotspot_min_reads=30)).count() == 0


def test_runs_split_a_locus(spark):
    a = spark.createDataFrame([(r, "c", s, s + 1000, 0) for r in range(4) for s in (0, 3000)], ALN)
    loci = spark.createDataFrame([("x", "c", 0, 4000, 4)], "locus_id string, chrom string, start long, end long, n_reads long")
    m = spark.createDataFrame([("x", r) for r in range(4)], "locus_id string, read_id long")
    out, members = split_by_runs(a, loci, m, Fast(min_segment=500, bin_size=100))
    assert sorted((r["start"], r["end"], r["n_reads"]) for r in out.collect()) == [(0, 2000, 4), (2000, 4000, 4)]
    assert members.count() == 8


def test_registered_modes_run_the_published_rounds(monkeypatch):
    from unittest.mock import MagicMock

    from locusweave.workload import modes

    seen = {}

    def fake(name, result):
        def call(*args, **kw):
            explore = [a for a in args if isinstance(a, Explore)]
            seen.setdefault(name, []).append(explore[0].max_rounds if explore else kw.get("max_rounds"))
            return result
        return call

    monkeypatch.setattr(modes, "tables", MagicMock())
    monkeypatch.setattr(modes, "F", MagicMock())
    monkeypatch.setattr(modes, "detect_adaptive", fake("adaptive", (MagicMock(), None, None)))
    monkeypatch.setattr(modes, "detect_iterative", fake("iterative", (MagicMock(), None)))
    monkeypatch.setattr(modes, "select_min_seeds", fake("min_seed", MagicMock()))
    for f in (modes._adaptive_mode, modes._adaptive_strict_mode, modes._iterative_mode, modes._min_seed_mode):
        f(None, "")
    assert all(r is None or r >= 5 for r in seen["adaptive"]) and len(seen["adaptive"]) == 2
    assert seen["iterative"] == [None] and seen["min_seed"] == [None]
