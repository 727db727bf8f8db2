"""Coverage profiles, peaks, valleys, splits and coverage-based filters."""

from pyspark.sql import functions as F

from locusweave.config import Detect, Split, StdGate, TightSplit
from locusweave.operators.coverage import (
    below_threshold_runs,
    coverage_counts,
    coverage_fractional,
    coverage_stats,
    genome_bins,
)
from locusweave.operators.filters import std_gate_scores
from locusweave.operators.interval_join import as_regions
from locusweave.operators.quality import coverage_quality
from locusweave.operators.readsets import pooled_reads
from locusweave.operators.segments import (
    find_peaks,
    find_valleys,
    fixed_valley_params,
    merge_small_segments,
    peak_cuts,
    raw_peaks,
    split_by_junctions,
    split_by_valleys,
)
from locusweave.plans.split import coverage_pieces, tight_resplit
from locusweave.plans.transitive import detect
from locusweave.session import materialize
from locusweave.sources import tables
from locusweave.workload import query
from locusweave.workload.base import kept_loci, whole_loci
from locusweave.workload.sql import ALN, LOCI, SEEDS

BW, BIN = 1024, 20

FRAC = f"""x AS (SELECT locus_id, ls, le, greatest(s, ls) AS cs, least(e, le) AS ce FROM a JOIN loci USING (chrom)
  WHERE s <= le AND e >= ls AND least(e, le) > greatest(s, ls)),
b AS (SELECT *, unnest(generate_series((cs - ls) // {BIN}, (ce - ls) // {BIN})) AS bin FROM x),
ov AS (SELECT locus_id, bin, CAST(sum(least(ce, ls + bin * {BIN} + {BIN}, le) - greatest(cs, ls + bin * {BIN})) AS BIGINT) AS bp
  FROM b GROUP BY 1, 2),
spine AS (SELECT locus_id, ls, le, unnest(generate_series(0, (le - ls) // {BIN})) AS bin FROM loci),
prof AS (SELECT locus_id, bin, ls + bin * {BIN} AS bin_start,
  CASE WHEN least({BIN}, le - ls - bin * {BIN}) > 0
    THEN coalesce(bp, 0)::DOUBLE / least({BIN}, le - ls - bin * {BIN}) ELSE 0 END AS cov
  FROM spine LEFT JOIN ov USING (locus_id, bin))"""

COUNTS = f"""x AS (SELECT locus_id, flag, ls, le, greatest(s, ls) AS cs, least(e, le) AS ce FROM a JOIN loci USING (chrom)
  WHERE s < le AND e > ls),
b AS (SELECT *, unnest(generate_series((cs - ls) // {BIN}, (ce - ls) // {BIN})) AS bin FROM x),
spine AS (SELECT locus_id, ls, le, unnest(generate_series(0, (le - ls) // {BIN})) AS bin FROM loci)"""


def _spans(loci):
    return loci.select("locus_id", "chrom", "start", "end")


@query(
    "coverage_fractional",
    f"WITH {ALN}, {LOCI}, {FRAC} SELECT locus_id, bin, bin_start, round(cov, 6) AS cov FROM prof",
)
def _coverage_fractional(spark, d):
    loci, _ = whole_loci(spark, d)
    return coverage_fractional(tables.alignments(spark, d), _spans(loci), BIN, bin_width=BW).select(
        "locus_id", "bin", "bin_start", F.round("cov", 6).alias("cov")
    )


@query(
    "coverage_bins",
    f"""WITH {ALN}, {LOCI}, {COUNTS}, k AS (SELECT locus_id, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT locus_id, bin, ls + bin * {BIN} AS bin_start, CAST(coalesce(n, 0) AS DOUBLE) AS cov
FROM spine LEFT JOIN k USING (locus_id, bin)""",
)
def _coverage_bins(spark, d):
    loci, _ = whole_loci(spark, d)
    return coverage_counts(tables.alignments(spark, d), _spans(loci), BIN, mode="half_open", bin_width=BW)


@query(
    "coverage_bins_by_strand",
    f"""WITH {ALN}, {LOCI}, {COUNTS}, k AS (SELECT locus_id, bin, flag & 16 AS rev, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT locus_id, st AS strand, spine.bin, ls + spine.bin * {BIN} AS bin_start, CAST(coalesce(n, 0) AS DOUBLE) AS cov
FROM (SELECT *, unnest(['+', '-']) AS st FROM spine) spine LEFT JOIN k
  ON k.locus_id = spine.locus_id AND k.bin = spine.bin AND k.rev = CASE WHEN st = '-' THEN 16 ELSE 0 END""".replace(
        "SELECT locus_id, st", "SELECT spine.locus_id, st"
    ),
)
def _coverage_bins_by_strand(spark, d):
    loci, _ = whole_loci(spark, d)
    return coverage_counts(
        tables.spliced_alignments(spark, d), _spans(loci), BIN, by_strand=True, mode="half_open", bin_width=BW
    )


@query(
    "coverage_stats",
    f"""WITH {ALN}, {LOCI}, {FRAC}
SELECT locus_id, round(avg(cov) + 1e-9, 4) AS mean_cov, round(stddev_pop(cov) + 1e-9, 4) AS std_cov, round(max(cov) + 1e-9, 4) AS max_cov,
  count(*) AS n_bins FROM prof GROUP BY locus_id""",
)
def _coverage_stats(spark, d):
    loci, _ = whole_loci(spark, d)
    prof = coverage_fractional(tables.alignments(spark, d), _spans(loci), BIN, bin_width=BW)
    r = lambda c: F.round(F.col(c) + 1e-9, 4).alias(c)
    return coverage_stats(prof).select("locus_id", r("mean_cov"), r("std_cov"), r("max_cov"), "n_bins")


@query(
    "coverage_std_gate",
    f"""WITH {ALN}, {LOCI},
x AS (SELECT locus_id, ls, greatest(s - 1, ls) AS cs, least(e, le) AS ce FROM a JOIN loci USING (chrom)
  WHERE s <= le AND e >= ls AND least(e, le) > greatest(s - 1, ls) AND flag & 2048 = 0),
b AS (SELECT locus_id, unnest(generate_series((cs - ls) // 100, (ce - ls) // 100)) AS bin FROM x),
k AS (SELECT locus_id, bin, count(*) AS n FROM b GROUP BY 1, 2),
spine AS (SELECT locus_id, ls, le, unnest(generate_series(0, (le - ls) // 100)) AS bin FROM loci),
st AS (SELECT locus_id, avg(coalesce(n, 0)) AS m, stddev_pop(coalesce(n, 0)) AS sd
  FROM spine LEFT JOIN k USING (locus_id, bin) GROUP BY 1),
t AS (SELECT locus_id, m, sd, nr, 5.0 * least(1.0, sqrt((m + 1) / 20.0))
    * least(1.0, sqrt(greatest(nr, 1) / 50.0) * sqrt(greatest(le - ls, 1000) / 2000.0))
    * (CASE WHEN nr <= 25 THEN 0.7 ELSE 1.0 END) AS raw
  FROM st JOIN loci USING (locus_id) JOIN sizes USING (locus_id))
SELECT locus_id, round(m + 1e-9, 4) AS mean_cov, round(sd + 1e-9, 4) AS std_cov, round(greatest(raw, 0.8) + 1e-9, 4) AS threshold,
  sd < greatest(raw, 0.8) AND NOT (m >= 1e9 AND sd / greatest(m, 1.0) >= 0.085) AS rejected FROM t""",
)
def _coverage_std_gate(spark, d):
    loci, members = kept_loci(spark, d)
    shared = members.groupBy("locus_id").agg(F.count(F.lit(1)).alias("shared"))
    gate = StdGate(base=5.0, mean_ref=20.0, min_floor=0.8, shared_ref=50.0, span_ref=2000.0)
    s = std_gate_scores(tables.alignments(spark, d), loci.join(shared, "locus_id"), gate, bin_width=BW)
    r = lambda c: F.round(F.col(c) + 1e-9, 4).alias(c)
    return s.select("locus_id", r("mean_cov"), r("std_cov"), r("threshold"), "rejected")


@query(
    "hotspot_bins",
    f"""WITH {ALN}, {SEEDS}, pool AS (SELECT DISTINCT read_id FROM a JOIN seeds USING (chrom) WHERE s <= se AND e >= ss)
SELECT chrom, (s - 1) // 50000 AS bin, count(*) AS n_total, count(pool.read_id) AS n_shared
FROM a LEFT JOIN pool USING (read_id) GROUP BY 1, 2""",
)
def _hotspot_bins(spark, d):
    a = tables.alignments(spark, d)
    return genome_bins(a, pooled_reads(a, as_regions(tables.seeds(spark, d)), bin_width=BW))


@query(
    "below_threshold_runs",
    f"""WITH {ALN}, {LOCI}, {FRAC},
t AS (SELECT *, cov < 0.3 * max(cov) OVER (PARTITION BY locus_id) AS low, max(cov) OVER (PARTITION BY locus_id) AS mx FROM prof),
f AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY locus_id ORDER BY bin), false) AS prev FROM t WHERE mx >= 2),
g AS (SELECT *, lead(bin) OVER (PARTITION BY locus_id ORDER BY bin) AS stop FROM f WHERE low <> prev)
SELECT locus_id, (bin + stop) // 2 AS valley_bin FROM g WHERE low AND stop IS NOT NULL""",
)
def _below_threshold_runs(spark, d):
    loci, _ = whole_loci(spark, d)
    prof = coverage_fractional(tables.alignments(spark, d), materialize(_spans(loci)), BIN, neighbours=True, bin_width=BW)
    return below_threshold_runs(prof, 0.3)


RAW = f"""{ALN}, {LOCI}, {FRAC},
n AS (SELECT *, lag(cov) OVER w AS lo, lead(cov) OVER w AS hi, max(cov) OVER (PARTITION BY locus_id) AS mx,
  count(*) OVER (PARTITION BY locus_id) AS nb FROM prof WINDOW w AS (PARTITION BY locus_id ORDER BY bin)),
pk AS (SELECT locus_id, bin, bin_start, cov, nb, mx,
  row_number() OVER (PARTITION BY locus_id ORDER BY bin) - 1 AS peak FROM n
  WHERE nb >= 3 AND mx > 0 AND (lo IS NULL OR cov >= lo) AND (hi IS NULL OR cov >= hi) AND cov >= 0.5 * mx)"""


def _profile(spark, d):
    loci = materialize(_spans(whole_loci(spark, d)[0]))
    prof = materialize(coverage_fractional(tables.alignments(spark, d), loci, BIN, neighbours=True, bin_width=BW))
    return loci, prof, fixed_valley_params(loci, 0.5, 200, 100)


@query("raw_peaks", f"WITH {RAW} SELECT locus_id, bin, round(cov, 6) AS cov FROM pk")
def _raw_peaks(spark, d):
    _, prof, params = _profile(spark, d)
    return raw_peaks(prof, params).select("locus_id", "bin", F.round("cov", 6).alias("cov"))


def _greedy(raw: str, min_bins: int, name: str = "kp") -> str:
    """Kept peaks: each candidate in turn is kept, replaces the last kept one, or is dropped."""
    raw = raw.replace("pk AS (SELECT", "pk AS MATERIALIZED (SELECT")
    far = f"p.bin - g.bin >= {min_bins}"
    pick = lambda c: f"CASE WHEN {far} OR p.cov > g.cov THEN p.{c} ELSE g.{c} END"
    return f"""{raw},
gr AS (SELECT locus_id, peak AS i, CAST(0 AS BIGINT) AS k, bin, bin_start, cov, nb, mx FROM pk WHERE peak = 0
  UNION ALL SELECT p.locus_id, p.peak, CASE WHEN {far} THEN g.k + 1 ELSE g.k END, {pick("bin")}, {pick("bin_start")}, {pick("cov")}, p.nb, p.mx
  FROM gr g JOIN pk p ON p.locus_id = g.locus_id AND p.peak = g.i + 1),
{name} AS (SELECT locus_id, k AS peak, arg_max(bin, i) AS bin, arg_max(bin_start, i) AS bin_start, arg_max(cov, i) AS cov,
  max(nb) AS nb, max(mx) AS mx FROM gr GROUP BY 1, 2)"""


GREEDY = _greedy(RAW, 10)


@query("greedy_peaks", f"WITH RECURSIVE {GREEDY} SELECT locus_id, peak, bin_start + 10 AS position, round(cov, 6) AS cov FROM kp")
def _greedy_peaks(spark, d):
    _, prof, params = _profile(spark, d)
    return find_peaks(prof, params, BIN).select("locus_id", "peak", "position", F.round("cov", 6).alias("cov"))


VALLEYS = f"""{RAW},
pp AS (SELECT locus_id, peak, bin AS lb, cov AS lc, nb, mx,
  lead(bin) OVER w AS rb, lead(cov) OVER w AS rc FROM pk WINDOW w AS (PARTITION BY locus_id ORDER BY bin)),
vb AS (SELECT pp.*, p.bin, p.cov, p.bin_start,
  row_number() OVER (PARTITION BY pp.locus_id, peak ORDER BY p.cov, p.bin) AS rn
  FROM pp JOIN prof p ON p.locus_id = pp.locus_id AND p.bin BETWEEN lb AND rb WHERE rb IS NOT NULL),
lm AS (SELECT pp.locus_id, peak, avg(p.cov) AS local_mean FROM pp JOIN prof p ON p.locus_id = pp.locus_id
  AND p.bin BETWEEN lb - 5 AND rb + 5 WHERE rb IS NOT NULL GROUP BY 1, 2),
m AS (SELECT vb.*, local_mean, greatest(lc, rc) AS hi, least(lc, rc) AS lw FROM vb JOIN lm USING (locus_id, peak) WHERE rn = 1),
th AS (SELECT *, lw - cov AS min_drop, (hi - cov) / hi AS prom, cov / hi AS ratio,
  CASE WHEN hi > 1000 THEN 0.15 WHEN hi > 500 THEN 0.20 WHEN hi > 100 THEN 0.25 WHEN hi > 50 THEN 0.30 ELSE 0.35 END AS tp,
  CASE WHEN (hi - lw) / hi > 0.5 THEN 0.6 WHEN (hi - lw) / hi > 0.3 THEN 0.5 ELSE 0.4 END AS tr FROM m),
v AS (SELECT locus_id, peak AS left_peak, peak + 1 AS right_peak, bin, bin_start + 10 AS position, cov AS coverage,
  (prom >= tp AND (cov < lw * (1 - tp))::INT + (prom >= tp)::INT + (cov < local_mean * 0.7)::INT
    + (ratio < tr)::INT + (min_drop > hi * 0.2)::INT >= 3) OR (min_drop > hi * 0.4 AND cov < local_mean * 0.7) AS is_significant,
  cov / mx AS depth_ratio FROM th)"""


@query(
    "valleys_between_peaks",
    f"""WITH {VALLEYS} SELECT locus_id, left_peak, right_peak, bin, position, round(coverage, 6) AS coverage,
  is_significant, round(depth_ratio, 6) AS depth_ratio FROM v""",
)
def _valleys_between_peaks(spark, d):
    from pyspark.sql import Window

    _, prof, params = _profile(spark, d)
    w = Window.partitionBy("locus_id").orderBy("bin")
    peaks = raw_peaks(prof, params).withColumn("peak", (F.row_number().over(w) - 1).cast("bigint"))
    v = find_valleys(prof, peaks, BIN)
    return v.withColumn("coverage", F.round("coverage", 6)).withColumn("depth_ratio", F.round("depth_ratio", 6))


@query(
    "split_at_valleys",
    f"""WITH {VALLEYS},
cut AS (SELECT DISTINCT locus_id, position AS p FROM v JOIN loci USING (locus_id)
  WHERE is_significant AND position - ls >= 100 AND le - position >= 100),
pt AS (SELECT locus_id, p FROM cut UNION SELECT locus_id, ls FROM loci),
sg AS (SELECT locus_id, p, lead(p) OVER (PARTITION BY locus_id ORDER BY p) AS nx FROM pt)
SELECT locus_id, p AS start, coalesce(nx, le) AS "end" FROM sg JOIN loci USING (locus_id)""",
)
def _split_at_valleys(spark, d):
    from pyspark.sql import Window

    loci, prof, params = _profile(spark, d)
    w = Window.partitionBy("locus_id").orderBy("bin")
    peaks = raw_peaks(prof, params).withColumn("peak", (F.row_number().over(w) - 1).cast("bigint"))
    segs = split_by_valleys(loci, find_valleys(prof, peaks, BIN), params)
    return segs.select("locus_id", "start", "end")


def _peak_cuts_sql(min_gap: int, min_segment: int) -> str:
    return f"""mids AS (SELECT locus_id, bin_start + 10 AS p0, lead(bin_start + 10) OVER (PARTITION BY locus_id ORDER BY bin) AS nxt FROM kp),
md AS MATERIALIZED (SELECT locus_id, ls, p0 + (nxt - p0) // 2 AS mid, row_number() OVER (PARTITION BY locus_id ORDER BY p0) AS rn
  FROM mids JOIN loci USING (locus_id) WHERE nxt - p0 >= {min_gap} AND le - (p0 + (nxt - p0) // 2) >= {min_segment}),
pc AS (SELECT locus_id, CAST(0 AS BIGINT) AS rn, ls AS last, CAST(NULL AS BIGINT) AS hit FROM md WHERE rn = 1
  UNION ALL SELECT md.locus_id, md.rn, CASE WHEN mid - last >= {min_segment} THEN mid ELSE last END, CASE WHEN mid - last >= {min_segment} THEN mid END
  FROM pc JOIN md ON md.locus_id = pc.locus_id AND md.rn = pc.rn + 1)"""


@query("split_by_peaks", f"WITH RECURSIVE {GREEDY}, {_peak_cuts_sql(200, 100)} SELECT locus_id, hit AS position FROM pc WHERE hit IS NOT NULL")
def _split_by_peaks(spark, d):
    loci, prof, params = _profile(spark, d)
    return peak_cuts(loci, find_peaks(prof, params, BIN), params)


def _greedy_valleys(greedy: str) -> str:
    """The valleys between kept peaks."""
    return VALLEYS.replace(RAW, greedy).replace("FROM pk WINDOW", "FROM kp WINDOW")


def _merged_sql(cuts: str, min_size: int, max_gap: int) -> str:
    """Segments between ``cuts`` (locus_id, p), and small ones absorbed."""
    return f"""pt AS (SELECT locus_id, p FROM ({cuts}) UNION SELECT locus_id, ls FROM loci),
sg AS (SELECT locus_id, chrom, p AS st, coalesce(lead(p) OVER (PARTITION BY locus_id ORDER BY p), le) AS en FROM pt JOIN loci USING (locus_id)),
nb2 AS (SELECT *, en - st AS size, st - lag(en) OVER w AS gl, lead(st) OVER w - en AS gr2, coalesce(lag(en - st) OVER w, 0) AS lsz,
  coalesce(lead(en - st) OVER w, 0) AS rsz FROM sg WINDOW w AS (PARTITION BY locus_id ORDER BY st)),
gw AS (SELECT *, size < {min_size} AND ((gl IS NOT NULL AND gl <= {max_gap} AND (lsz >= rsz OR gr2 IS NULL OR gr2 > {max_gap}))
  OR (gr2 IS NOT NULL AND gr2 <= {max_gap} AND rsz > 0)) AS gives FROM nb2),
kg AS (SELECT *, sum(CASE WHEN gives THEN 0 ELSE 1 END) OVER (PARTITION BY locus_id ORDER BY st ROWS UNBOUNDED PRECEDING) AS kept FROM gw),
mg AS (SELECT locus_id, chrom, min(st) AS st, arg_max(en, st) AS en FROM kg WHERE kept > 0 GROUP BY locus_id, chrom, kept)"""


_USABLE = "SELECT DISTINCT locus_id, position AS p FROM v JOIN loci USING (locus_id) WHERE is_significant AND position - ls >= 100 AND le - position >= 100"


@query(
    "merge_small_segments",
    f"""WITH RECURSIVE {_greedy_valleys(GREEDY)}, {_merged_sql(_USABLE, 250, 100)} SELECT locus_id, chrom, st AS start, en AS "end" FROM mg""",
)
def _merge_small_segments(spark, d):
    loci, prof, params = _profile(spark, d)
    segs = split_by_valleys(loci, find_valleys(prof, find_peaks(prof, params, BIN), BIN), params)
    return merge_small_segments(segs, 250, 100)


@query(
    "coverage_pieces",
    f"""WITH RECURSIVE {_greedy_valleys(_greedy(RAW.replace("0.5 * mx", "0.3 * mx"), 5))}, {_peak_cuts_sql(100, 100)},
bv AS ({_USABLE}),
{_merged_sql("SELECT locus_id, p FROM bv UNION ALL SELECT locus_id, hit FROM pc WHERE hit IS NOT NULL AND locus_id NOT IN (SELECT locus_id FROM bv)", 200, 100)}
SELECT locus_id, chrom, st AS start, en AS "end" FROM mg
UNION ALL SELECT locus_id, chrom, ls, le FROM loci WHERE locus_id NOT IN (SELECT locus_id FROM mg)""",
)
def _coverage_pieces(spark, d):
    loci = _spans(whole_loci(spark, d)[0])
    params = fixed_valley_params(loci, 0.3, 100, 100)
    return coverage_pieces(tables.alignments(spark, d), loci, params, BIN, 200, 100, bin_width=BW)


_WIDE = (
    RAW.replace("0.5 * mx", "0.12 * mx").replace("FROM loci)", "FROM loci WHERE le - ls >= 800)")
    .replace("FROM a JOIN loci USING (chrom)", "FROM a JOIN (SELECT * FROM loci WHERE le - ls >= 800) USING (chrom)")
)


@query(
    "tight_resplit",
    f"""WITH RECURSIVE {_greedy_valleys(_greedy(_WIDE, 5))}, {_peak_cuts_sql(100, 100)},
bv AS ({_USABLE}),
{_merged_sql("SELECT locus_id, p FROM bv UNION ALL SELECT locus_id, hit FROM pc WHERE hit IS NOT NULL AND locus_id NOT IN (SELECT locus_id FROM bv)", 200, 50)},
pcs AS (SELECT locus_id, chrom, st, en FROM mg JOIN loci USING (locus_id, chrom) WHERE le - ls >= 800
  UNION ALL SELECT locus_id, chrom, ls, le FROM loci WHERE le - ls >= 800 AND locus_id NOT IN (SELECT locus_id FROM mg))
SELECT chrom, st AS start, en AS "end" FROM pcs UNION ALL SELECT chrom, ls, le FROM loci WHERE le - ls < 800""",
)
def _tight_resplit(spark, d):
    loci, members = kept_loci(spark, d)
    cfg = TightSplit(bin_size=BIN, min_gap_bp=100, min_segment_bp=100, merge_min_segment_bp=200, merge_max_gap_bp=50, min_input_span_bp=800, max_segments=None)
    out, _ = tight_resplit(tables.alignments(spark, d), _spans(loci), members, cfg, bin_width=BW)
    return out.select("chrom", "start", "end")


@query(
    "split_by_junctions",
    f"""WITH {ALN.replace("l_linenumber AS line,", "l_linenumber AS line, CAST(l_quantity AS BIGINT) AS q,")}, {LOCI},
j AS (SELECT chrom, s, e, unnest(CASE WHEN line % 4 = 0 THEN [s + 5 * q, s + 7 * q, s + 10 * q, s + 13 * q]
    WHEN line % 2 = 0 THEN [s + 8 * q, s + 12 * q] ELSE [] END) AS pos FROM a),
jp AS (SELECT DISTINCT locus_id, pos FROM j JOIN loci USING (chrom) WHERE s <= le AND e >= ls),
g AS (SELECT locus_id, pos, lag(pos) OVER (PARTITION BY locus_id ORDER BY pos) AS prev FROM jp),
cut AS (SELECT g.locus_id, prev + (pos - prev) // 2 AS p FROM g JOIN loci USING (locus_id)
  WHERE pos - prev > 100 AND le - ls >= 1000),
pt AS (SELECT locus_id, p FROM cut UNION SELECT locus_id, ls FROM loci),
sg AS (SELECT locus_id, p, lead(p) OVER (PARTITION BY locus_id ORDER BY p) AS nx, count(*) OVER (PARTITION BY locus_id) AS k FROM pt)
SELECT locus_id, p AS start, coalesce(nx, le) AS "end" FROM sg JOIN loci USING (locus_id)
WHERE k = 1 OR coalesce(nx, le) - p > 150""",
)
def _split_by_junctions(spark, d):
    loci = _spans(whole_loci(spark, d)[0])
    segs = split_by_junctions(
        tables.spliced_alignments(spark, d), loci, 1000, 150, tolerance=50, min_gap=100, bin_width=BW
    )
    return segs.select("locus_id", "start", "end")


QUALITY = f"""{ALN}, {LOCI}, {FRAC},
top AS (SELECT locus_id, max(cov) AS h, count(*) AS n FROM prof GROUP BY 1),
pk AS (SELECT locus_id, h, n, least(3, n // 4) AS k, max(bin) AS pkbin FROM prof JOIN top USING (locus_id) WHERE cov = h GROUP BY ALL),
s AS (SELECT locus_id, h, n, k, pkbin,
  max(CASE WHEN cov < h / 2 AND bin < pkbin THEN bin END) AS lo, min(CASE WHEN cov < h / 2 AND bin >= pkbin THEN bin END) AS hi,
  sum(CASE WHEN bin < pkbin THEN cov ELSE 0 END) AS l, sum(CASE WHEN bin > pkbin THEN cov ELSE 0 END) AS r,
  sum(CASE WHEN bin < k THEN cov ELSE 0 END) AS head, sum(CASE WHEN bin >= n - k THEN cov ELSE 0 END) AS tail
  FROM prof JOIN pk USING (locus_id) GROUP BY ALL),
q AS (SELECT locus_id, h, (coalesce(hi, pkbin) - coalesce(lo, pkbin)) * {BIN} AS width,
  CASE WHEN l + r > 0 THEN abs(l - r) / (l + r) ELSE 1 END AS sym,
  CASE WHEN k > 0 AND pkbin > k THEN least(1, greatest(0, (h - head / k) / pkbin / 5)) ELSE 0 END AS lsl,
  CASE WHEN k > 0 AND pkbin + k < n THEN least(1, greatest(0, (h - tail / k) / (n - pkbin) / 5)) ELSE 0 END AS rsl FROM s)"""


@query(
    "coverage_quality",
    f"""WITH {QUALITY}
SELECT locus_id, CAST(width AS BIGINT) AS peak_width, round(sym + 1e-9, 5) AS symmetry,
  round(CASE WHEN h > 0 THEN least(1, h / 50) * 0.3 + (lsl + rsl) / 2 * 0.4 + (1 - sym) * 0.3 ELSE 0 END + 1e-9, 5) AS score FROM q""",
)
def _coverage_quality(spark, d):
    loci = _spans(whole_loci(spark, d)[0])
    prof = coverage_fractional(tables.alignments(spark, d), loci, BIN, bin_width=BW)
    return coverage_quality(prof, BIN).select(
        "locus_id", F.col("peak_width").cast("bigint").alias("peak_width"),
        F.round(F.col("symmetry") + 1e-9, 5).alias("symmetry"), F.round(F.col("score") + 1e-9, 5).alias("score"),
    )


@query("transitive_mode")
def _transitive_mode(spark, d):
    params = Detect(
        min_reads=2, bin_width=BW, std_gate=StdGate(base=0.5, min_floor=0.1),
        split=Split(dynamic=False, min_gap_bp=1000, junction_min_locus_bp=50_000, junction_min_span_bp=50_000),
    )
    loci, _ = detect(tables.spliced_alignments(spark, d), tables.seeds(spark, d), params)
    return loci.select("chrom", "start", "end", F.round("jaccard", 4).alias("jaccard"), "distance", "component", "n_reads")
