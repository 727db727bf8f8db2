"""Coverage, peaks, valleys, splits and order-dependent folds against small worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from locusweave.config import Envelope, StdGate
from locusweave.functions.quantiles import floor_rank, middle_median, nearest_rank, upper_median
from locusweave.operators.coverage import below_threshold_runs, coverage_counts, coverage_fractional
from locusweave.operators.filters import (
    adaptive_std_threshold,
    core_filter,
    depth_scaled_min_std,
    jaccard_filter,
    similarity_validity,
    single_copy_seeds,
    std_gate_filter,
)
from locusweave.operators.folds import drop_covered, drop_near_duplicates, keep_larger, merge_adjacent
from locusweave.operators.quality import coverage_quality
from locusweave.operators.segments import (
    find_peaks,
    find_valleys,
    fixed_valley_params,
    merge_small_segments,
    peak_cuts,
    split_by_valleys,
)
from locusweave.operators.trims import envelope_trim

LOCUS = "locus_id string, chrom string, start long, end long"


def profile(spark, values, start=0, size=100, lid="a"):
    return spark.createDataFrame([(lid, i, start + i * size, float(v)) for i, v in enumerate(values)],
                                 "locus_id string, bin long, bin_start long, cov double")


def params(spark, frac, gap, seg, lids=("a",)):
    loci = spark.createDataFrame([(x,) for x in lids], "locus_id string")
    return fixed_valley_params(loci, frac, gap, seg)


def test_peaks_of_the_ten_bin_profile(spark):
    p = find_peaks(profile(spark, [1, 2, 5, 3, 1, 1, 4, 6, 3, 1]), params(spark, 0.15, 200, 500), 100)
    # Bins 4 and 5 form a trough, not a plateau above both sides.
    assert [(r["bin"], r["position"], r["cov"]) for r in p.orderBy("bin").collect()] == [(2, 250, 5.0), (7, 750, 6.0)]


def python_peaks(values, frac, gap, size):
    top = max(values)
    need = max(gap // size, 2)
    kept = []
    for i, v in enumerate(values):
        if (i and v < values[i - 1]) or (i + 1 < len(values) and v < values[i + 1]) or v < top * frac or top <= 0:
            continue
        if kept and i - kept[-1] < need:
            if v > values[kept[-1]]:
                kept[-1] = i
            continue
        kept.append(i)
    return kept if len(values) >= 3 else []


@pytest.mark.parametrize("seed", range(3))
def test_peaks_match_a_plain_walk(spark, seed):
    r = random.Random(seed)
    values = [r.randrange(8) for _ in range(80)]
    got = find_peaks(profile(spark, values), params(spark, 0.3, 400, 100), 100)
    assert [x["bin"] for x in got.orderBy("bin").collect()] == python_peaks(values, 0.3, 400, 100)


def test_valley_is_first_minimum_and_significant(spark):
    values = [1, 10, 2, 2, 9, 1]
    prof = profile(spark, values)
    v = find_valleys(prof, find_peaks(prof, params(spark, 0.5, 200, 100), 100), 100).collect()
    assert [(r["bin"], r["coverage"], r["is_significant"], r["depth_ratio"]) for r in v] == [(2, 2.0, True, 0.2)]
    flat = profile(spark, [10, 9, 10, 9, 10])
    v = find_valleys(flat, find_peaks(flat, params(spark, 0.5, 200, 100), 100), 100).collect()
    assert v and not any(r["is_significant"] for r in v)


def test_split_filter(spark):
    loci = spark.createDataFrame([("a", "c", 0, 20_000)], LOCUS)
    v = spark.createDataFrame([("a", 5050, False)], "locus_id string, position long, is_significant boolean")
    p = params(spark, 0.1, 2000, 1500)
    assert split_by_valleys(loci, v, p).count() == 1
    both = split_by_valleys(loci, v, p, significant_only=False).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in both] == [(0, 5050), (5050, 20_000)]
    near_end = v.withColumn("position", F.lit(19_000))
    assert split_by_valleys(loci, near_end, p, significant_only=False).count() == 1


def test_peak_cuts_remember_the_last_cut(spark):
    loci = spark.createDataFrame([("a", "c", 0, 10_000)], LOCUS)
    peaks = spark.createDataFrame([("a", p) for p in (500, 2500, 3500, 6000)], "locus_id string, position long")
    got = peak_cuts(loci, peaks, params(spark, 0.1, 1000, 1600)).orderBy("position").collect()
    # Midpoints 1500 (too near the start), 3000, 4750.
    assert [r["position"] for r in got] == [3000, 4750]


def python_merge(segs, min_size, max_gap):
    keep = []
    for i, (s, e) in enumerate(segs):
        gl = s - segs[i - 1][1] if i else None
        gr = segs[i + 1][0] - e if i + 1 < len(segs) else None
        ls = segs[i - 1][1] - segs[i - 1][0] if i else 0
        rs = segs[i + 1][1] - segs[i + 1][0] if i + 1 < len(segs) else 0
        drop = e - s < min_size and (
            (gl is not None and gl <= max_gap and (ls >= rs or gr is None or gr > max_gap))
            or (gr is not None and gr <= max_gap and rs > 0)
        )
        keep.append(not drop)
    out = []
    for k, seg in zip(keep, segs):
        if k:
            out.append(list(seg))
        elif out:
            out[-1][1] = seg[1]
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(3))
def test_merge_small_segments(spark, seed):
    r = random.Random(seed)
    segs, at = [], 0
    for _ in range(12):
        at += r.choice([0, 0, 50, 500])
        segs.append((at, at := at + r.choice([80, 120, 900])))
    df = spark.createDataFrame([("a", "c", s, e) for s, e in segs], LOCUS)
    got = merge_small_segments(df, 200, 100).orderBy("start").collect()
    assert [(x["start"], x["end"]) for x in got] == python_merge(segs, 200, 100)


def brute_coverage(alns, start, end, size):
    n = (end - start) // size + 1
    frac, count = [0.0] * n, [0] * n
    for s, e in alns:
        cs, ce = max(s, start), min(e, end)
        if ce <= cs:
            continue
        for b in range((cs - start) // size, min((ce - start) // size, n - 1) + 1):
            lo, hi = start + b * size, min(start + (b + 1) * size, end)
            count[b] += 1
            if hi > lo:
                frac[b] += (min(ce, hi) - max(cs, lo)) / (hi - lo)
    return frac, count


def test_coverage_against_bins(spark):
    r = random.Random(4)
    alns = [(s, s + r.randrange(1, 400)) for s in (r.randrange(1000) for _ in range(80))]
    a = spark.createDataFrame([("c", s, e) for s, e in alns], "chrom string, start long, end long")
    loci = spark.createDataFrame([("a", "c", 130, 955), ("b", "c", 200, 800), ("z", "d", 0, 50)], LOCUS)
    frac = coverage_fractional(a, loci, 100).collect()
    count = coverage_counts(a, loci, 100, mode="half_open").collect()
    for lid, s, e in (("a", 130, 955), ("b", 200, 800)):
        f, c = brute_coverage(alns, s, e, 100)
        got_f = [x["cov"] for x in sorted((x for x in frac if x["locus_id"] == lid), key=lambda x: x["bin"])]
        got_c = [x["cov"] for x in sorted((x for x in count if x["locus_id"] == lid), key=lambda x: x["bin"])]
        assert got_f == pytest.approx(f) and got_c == pytest.approx(c)
    assert [x["cov"] for x in frac if x["locus_id"] == "z"] == [0.0]


def test_runs_below_threshold(spark):
    got = below_threshold_runs(profile(spark, [0, 9, 1, 1, 1, 9, 0, 0]), 0.3).orderBy("valley_bin").collect()
    assert [r["valley_bin"] for r in got] == [0, 3]  # the run at the end stays open
    assert below_threshold_runs(profile(spark, [0, 1, 0, 1]), 0.5).count() == 0


def test_quality_of_an_uneven_profile(spark):
    q = coverage_quality(profile(spark, [1, 2, 4, 8, 10, 2, 1, 0, 0, 0, 0, 0, 0]), 100).first()
    assert q["symmetry"] == pytest.approx(12 / 18) and q["peak_height"] == 10 and q["peak_width"] == 300


def test_std_thresholds(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("x")).first()["x"]
    assert f(depth_scaled_min_std(50.0, F.lit(199.0), 200.0)) == pytest.approx(50.0)
    assert f(depth_scaled_min_std(50.0, F.lit(49.0), 200.0)) == pytest.approx(25.0)
    thr = lambda span, shared: f(
        adaptive_std_threshold(F.lit(50.0), F.lit(span), F.lit(shared), 8.0, 500.0, 150_000.0))
    assert thr(150_000, 500) == pytest.approx(50.0)
    assert thr(600_000, 2000) == pytest.approx(50.0)
    assert thr(150_000, 20) == pytest.approx(max(8.0, 50 * (20 / 500) ** 0.5 * 0.7))
    assert thr(10, 1) == 8.0


def test_std_gate_keeps_seed_loci(spark):
    a = spark.createDataFrame([(i, "c", 1, 1000, 0) for i in range(5)], "read_id long, chrom string, start long, end long, flag int")
    loci = spark.createDataFrame([("flat", "c", 0, 1000, 3, False), ("seed", "c", 0, 999, 3, True)], LOCUS + ", shared long, is_seed boolean")
    assert [r["locus_id"] for r in std_gate_filter(a, loci, StdGate()).collect()] == ["seed"]
    assert std_gate_filter(a, loci, StdGate(base=0)).count() == 2


def test_filters(spark):
    loci = spark.createDataFrame([("a", 0.5, False), ("b", 0.0, True), ("c", 0.0, False)], "locus_id string, jaccard double, is_seed boolean")
    assert {r["locus_id"] for r in jaccard_filter(loci, 0.1).collect()} == {"a", "b"}
    m = spark.createDataFrame([("a", 1), ("a", 2), ("c", 2)], "locus_id string, read_id long")
    core = spark.createDataFrame([(7, 1), (7, 2), (8, 2)], "component long, read_id long")
    assert {r["locus_id"] for r in core_filter(loci, m, core, 2).collect()} == {"a", "b"}
    assert core_filter(loci, m, core.where("false"), 2).count() == 3
    sim = spark.createDataFrame([(None,), (0.5,), (0.7,)], "isoseq_sim double")
    assert similarity_validity(sim, 0.6).count() == 2


def test_single_copy_seeds(spark):
    seeds = spark.createDataFrame([(0, "c", 0, 10, None), (1, "c", 50, 60, None)], "seed_ord long, chrom string, start long, end long, name string")
    loci = spark.createDataFrame([("self", "c", 0, 10), ("else", "d", 5, 9)], LOCUS)
    members = spark.createDataFrame([("self", 1), ("else", 2)], "locus_id string, read_id long")
    sr = spark.createDataFrame([(0, 1), (1, 2)], "seed_ord long, read_id long")
    assert {tuple(r) for r in single_copy_seeds(seeds, loci, members, sr).collect()} == {(0, False), (1, True)}


def python_keep_larger(rows):
    kept = []
    for c, s, e in rows:
        hit = next((k for k in kept if k[0] == c and k[1] < e and s < k[2]), None)
        if hit is None:
            kept.append((c, s, e))
        elif e - s > hit[2] - hit[1]:
            kept.remove(hit)
            kept.append((c, s, e))
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_keep_larger(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"c{r.randrange(2)}", s, s + r.randrange(10, 300)) for i, s in enumerate(r.sample(range(3000), 60))]
    got = keep_larger(spark.createDataFrame(rows, "ord long, chrom string, start long, end long"), ["ord"])
    assert sorted((x["chrom"], x["start"], x["end"]) for x in got.collect()) == python_keep_larger([x[1:] for x in rows])


@pytest.mark.parametrize("both", [False, True])
def test_near_duplicates(spark, both):
    r = random.Random(9)
    rows = [(i, "c", s, s + r.randrange(5, 500)) for i, s in enumerate(r.sample(range(4000), 80))]
    kept = []
    for _, _, s, e in rows:
        near = [(abs(s - a) < 60, abs(e - b) < 60) for a, b in kept]
        if not any(all(x) if both else any(x) for x in near):
            kept.append((s, e))
    got = drop_near_duplicates(spark.createDataFrame(rows, "ord long, chrom string, start long, end long"), ["ord"], 60, both)
    assert sorted((x["start"], x["end"]) for x in got.collect()) == sorted(kept)


def test_drop_covered_keeps_the_longest(spark):
    df = spark.createDataFrame([("c", 0, 100), ("c", 10, 90), ("c", 95, 200), ("c", 0, 20), ("d", 0, 100)], "chrom string, start long, end long")
    got = {(r["chrom"], r["start"], r["end"]) for r in drop_covered(df).collect()}
    assert got == {("c", 0, 100), ("c", 95, 200), ("d", 0, 100)}


def test_merge_adjacent_uses_the_running_maximum(spark):
    loci = spark.createDataFrame(
        [("a", "c", 0, 10, 0.9, 1), ("b", "c", 15, 20, 0.4, 2), ("e", "c", 22, 30, 0.4, 3), ("f", "c", 31, 40, 0.1, 4), ("g", "c", 35, 50, 0.9, 5)],
        LOCUS + ", jaccard double, component int")
    m = spark.createDataFrame([("a", 1), ("b", 1), ("e", 2), ("f", 3)], "locus_id string, read_id long")
    got, reads = merge_adjacent(loci, m, 10, 0.3)
    assert sorted((r["start"], r["end"], r["jaccard"], r["component"], r["n_merged"]) for r in got.collect()) == [
        (0, 30, 0.9, 1, 3), (31, 40, 0.1, 4, 1), (35, 50, 0.9, 5, 1)]
    assert {tuple(r) for r in reads.collect()} == {("a", 1), ("a", 2), ("f", 3)}


def test_quantiles(spark):
    v = [5, 1, 9, 9, 3, 7]
    df = spark.createDataFrame([("k", x) for x in v], "k string, v long")
    s = sorted(v)
    assert nearest_rank(df, ["k"], "v", 0.9).first()["value"] == s[int(5 * 0.9 + 0.5)]
    assert floor_rank(df, ["k"], "v", 0.9).first()["value"] == s[4]
    assert upper_median(df, ["k"], "v").first()["value"] == s[3]
    assert middle_median(df, ["k"], "v").first()["value"] == (s[2] + s[3]) // 2


def test_envelope_trim_only_shrinks(spark):
    a = spark.createDataFrame([(i, "c", 100 + i, 900 - i, 0) for i in range(20)], "read_id long, chrom string, start long, end long, flag int")
    loci = spark.createDataFrame([("a", "c", 0, 1000), ("b", "c", 200, 800), ("z", "d", 0, 9)], LOCUS)
    m = spark.createDataFrame([(x, i) for x in "ab" for i in range(20)], "locus_id string, read_id long")
    got = {r["locus_id"]: (r["start"], r["end"]) for r in envelope_trim(a, loci, m, Envelope(min_span=100)).collect()}
    assert got == {"a": (100, 899), "b": (200, 800), "z": (0, 9)}
