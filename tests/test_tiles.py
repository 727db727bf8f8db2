"""Coverage, peaks and valleys over loci of many tiles: the same rows as with one tile, and windows no longer than a tile."""

import random
import re

import pytest
from pyspark.sql import functions as F

from locusweave.operators import coverage, segments
from locusweave.session import materialize

LOCUS = "locus_id string, chrom string, start long, end long"


def world(spark):
    r = random.Random(8)
    loci = [("a", "c", 100, 5000), ("b", "c", 4000, 4310), ("d", "d", 0, 2400), ("e", "d", 7, 7)]
    rows = [(i, c := r.choice("cd"), s := r.randrange(0, 5200), s + r.choice([0, 3, 40, 200, 900, 4000]), r.choice("+-")) for i in range(300)]
    assert c in "cd" and s >= 0
    a = spark.createDataFrame(rows, "read_id long, chrom string, start long, end long, strand string")
    return a, spark.createDataFrame(loci, LOCUS), rows, loci


def set_tile(monkeypatch, n):
    monkeypatch.setattr(coverage, "TILE", n)
    monkeypatch.setattr(segments, "TILE", n)


@pytest.mark.parametrize("tile", [1, 7, 16])
def test_profiles_do_not_depend_on_tiles(spark, monkeypatch, tile):
    set_tile(monkeypatch, tile)
    a, loci, rows, places = world(spark)
    frac = {(r["locus_id"], r["strand"], r["bin"]): r["cov"] for r in coverage.coverage_fractional(a, loci, 30, by_strand=True).collect()}
    count = {(r["locus_id"], r["bin"]): r["cov"] for r in coverage.coverage_counts(a, loci, 30, mode="half_open").collect()}
    for name, chrom, s, e in places:
        for b in range((e - s) // 30 + 1):
            lo, hi = s + 30 * b, min(s + 30 * b + 30, e)
            for strand in "+-":
                bp = sum(max(0, min(y, hi) - max(x, lo)) for _, c, x, y, z in rows if c == chrom and z == strand)
                assert abs(frac[(name, strand, b)] - (bp / (hi - lo) if hi > lo else 0)) < 1e-9
            hits = [(max(x, s), min(y, e)) for _, c, x, y, _ in rows if c == chrom and x < e and y > s]
            assert count[(name, b)] == sum((x - s) // 30 <= b <= (y - s) // 30 for x, y in hits)
    assert len(frac) == 2 * len(count) == 2 * sum((e - s) // 30 + 1 for _, _, s, e in places)


def test_bins_without_events_are_filled_after_the_last_exchange(spark):
    a, loci, _, _ = world(spark)
    for df in (coverage.coverage_fractional(a, loci, 30), coverage.coverage_counts(a, loci, 30)):
        top = df._jdf.queryExecution().executedPlan().toString().partition("Generate explode(sequence(bin")
        assert top[1] and not re.search("Exchange|Window|Join|Aggregate", top[0])


def test_loci_that_share_a_key_share_the_longest_spine(spark):
    a = spark.createDataFrame([(1, "c", 35, 65), (2, "c", 990, 1000)], "read_id long, chrom string, start long, end long")
    loci = spark.createDataFrame([("a", "c", 0, 90), ("a", "c", 0, 150), (None, "c", 0, 30)], LOCUS)
    got = sorted((r["bin"], r["cov"]) for r in coverage.coverage_counts(a, loci, 30).collect())
    assert got == sorted([(b, 2.0 if b in (1, 2) else 0.0) for b in range(6)] * 2)


def test_peaks_and_valleys_do_not_depend_on_tiles(spark, monkeypatch):
    r = random.Random(5)
    values = [(k, b, 1000 + 10 * b, float(r.choice([0, 1, 2, 5, 9, 30, 200]))) for k in ("a", "b") for b in range(90 if k == "a" else 11)]
    prof = spark.createDataFrame(values, "locus_id string, bin long, bin_start long, cov double")
    params = segments.fixed_valley_params(prof.select("locus_id").distinct(), 0.02, 30, 20)

    def results():
        peaks = segments.find_peaks(prof, params, 10)
        return [sorted(map(tuple, df.collect())) for df in (
            peaks, segments.find_valleys(prof, peaks, 10), coverage.below_threshold_runs(prof, 0.1))]

    whole = results()
    assert all(whole)
    for tile in (5, 6, 13):
        set_tile(monkeypatch, tile)
        assert results() == whole


def test_a_long_locus_spreads_over_many_windows(spark):
    """One locus of 200 Mb: every window over its bins is partitioned by tile, of which there are hundreds."""
    a = spark.createDataFrame([(i, "c", 1_000_000 * i, 1_000_000 * i + 900, "+") for i in range(200)], "read_id long, chrom string, start long, end long, strand string")
    loci = spark.createDataFrame([("big", "c", 0, 200_000_000)], LOCUS)
    prof = coverage.coverage_fractional(a, loci, 100)
    tiles = prof.groupBy(coverage.tile_of(F.col("bin")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    got = tiles.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    assert got[0] > 400 and got[1] <= coverage.TILE and got[2] == 2_000_001
    params = segments.fixed_valley_params(loci)
    for df in (prof, segments.raw_peaks(prof, params)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = re.findall(r"\n[^\n]*Window \[[^\n]*", plan)
        assert windows and all("_tile" in w for w in windows)


@pytest.mark.parametrize(("window", "step", "tile"), [(200, 100, 4096), (100, 30, 5), (50, 70, 2)])
def test_window_jaccards_count_distinct_reads(spark, monkeypatch, window, step, tile):
    from locusweave.config import Refine
    from locusweave.operators import refine

    set_tile(monkeypatch, tile)
    monkeypatch.setattr(refine, "TILE", tile)
    r = random.Random(window)
    rows = [(r.randrange(25), r.choice("cd"), s := r.randrange(0, 2600), s + r.choice([0, 5, 90, 700]), 4 if i % 17 == 0 else 0) for i in range(160)]
    a = spark.createDataFrame(rows, "read_id long, chrom string, start long, end long, flag int")
    places = [("a|1", "c", 100, 2500), ("b|1", "d", 300, 701), ("e|1", "d", 0, 190), ("x|1", "z", 0, 900)]
    ref = set(range(0, 25, 2))
    p = Refine(window=window, step=step, min_region=100)
    want = {}
    for name, chrom, lo, hi in places:
        if hi - lo < 200:
            continue
        spots = [(5, q, q, min(q + window, hi)) for q in range(lo, hi, step)] + [(3, q, max(q - window, lo), q) for q in range(hi - 1, lo - 1, -step)]
        for side, q, x, y in spots:
            if y - x >= window // 2:
                reads = {i for i, c, s, e, f in rows if c == chrom and f == 0 and s <= y and e >= x}
                want[(name, side, q)] = len(reads & ref) / len(reads | ref) if reads else 0.0
    loci = spark.createDataFrame(places, LOCUS)
    for reference in (spark.createDataFrame([(i,) for i in sorted(ref)], "read_id long"),
                      spark.createDataFrame([(i, g) for i in sorted(ref) for g in "abex"], "read_id long, group string")):
        got = {(x["locus_id"], x["side"], x["pos"]): x["jaccard"] for x in refine.window_jaccards(a, loci, reference, p).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_registered_profiles_compute_their_loci_once(spark, sf_dir):
    from locusweave.workload import base

    loci, members = base.whole_loci(spark, sf_dir)
    assert not re.search("Exchange|Window", loci._jdf.queryExecution().executedPlan().toString())
    assert loci.count() and set(members.columns) == {"locus_id", "read_id"}


def test_steps_over_several_tiles_match_steps_in_one(spark, monkeypatch):
    spans = spark.createDataFrame([(0, 3), (2, 9), (5, 5), (4, 8), (7, 6)], "a long, b long")
    for tile in (2, 4, 1000):
        monkeypatch.setattr(coverage, "TILE", tile)
        ev = spans.select("a", "b", F.explode(coverage.active(F.col("a"), F.col("b"), F.lit(1))).alias("ev")).select("a", "b", "ev.*")
        events = [(r.a, r.b, r.bin, r.step) for r in ev.collect()]
        for a, b in [(0, 3), (2, 9), (5, 5), (4, 8), (7, 6)]:
            own = [(n, s) for x, y, n, s in events if (x, y) == (a, b)]
            level = [sum(s for n, s in own if k // tile * tile <= n <= k) for k in range(12)]
            assert level == [int(a <= k < b) for k in range(12)]


@pytest.mark.parametrize("tile", [1, 2, 3, 7, 16, 4096])
def test_neighbours_of_bins_come_with_the_profile(spark, monkeypatch, tile):
    """Values beside each bin, peaks and runs below a threshold are as from windows over all bins, at tile borders too."""
    set_tile(monkeypatch, tile)
    a, loci, _, _ = world(spark)
    plain = materialize(coverage.coverage_fractional(a, loci, 30))
    prof = materialize(coverage.coverage_fractional(a, loci, 30, neighbours=True))
    bins = {(r["locus_id"], r["bin"]): r["cov"] for r in plain.collect()}
    rows = coverage.with_borders(prof, ("locus_id",)).collect()
    assert {(r["locus_id"], r["bin"]): r["cov"] for r in rows} == bins and len(rows) == len(bins)
    for r in rows:
        assert (r["prev"], r["next"]) == (bins.get((r["locus_id"], r["bin"] - 1)), bins.get((r["locus_id"], r["bin"] + 1)))
    params = segments.fixed_valley_params(loci, 0.1, 30, 20)
    for of in (lambda p: segments.raw_peaks(p, params), lambda p: coverage.below_threshold_runs(p, 0.5)):
        want = sorted(map(tuple, of(plain).collect()))
        assert want and sorted(map(tuple, of(prof).collect())) == want


def test_only_peak_candidates_are_moved(spark):
    a, loci, _, _ = world(spark)
    prof = materialize(coverage.coverage_fractional(a, loci, 30, neighbours=True))
    plan = segments.raw_peaks(prof, segments.fixed_valley_params(loci))._jdf.queryExecution().optimizedPlan().toString()
    windows = plan.count("Window [")
    assert windows == 1  # the rows at tile borders, as the rest have their neighbours
    assert "explode" not in plan and "_own" not in plan


def test_bins_without_coverage_are_peaks_only_at_a_threshold_of_zero(spark):
    values = [("a", b, 10 * b, float(c)) for b, c in enumerate([0, 0, 0, 4, 1, 0, 0, 2, 2])] + [("b", b, 10 * b, 0.0) for b in range(5)]
    prof = spark.createDataFrame(values, "locus_id string, bin long, bin_start long, cov double")
    found = lambda frac: sorted(r["bin"] for r in segments.raw_peaks(
        prof, segments.fixed_valley_params(prof.select("locus_id").distinct(), frac, 30, 20)).collect())
    assert found(0.0) == [0, 1, 3, 7, 8] and found(0.1) == [3, 7, 8]
