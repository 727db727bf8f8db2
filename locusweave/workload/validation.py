"""Composed validation of loci: evidence scores, advanced features, copy number of seeds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from locusweave.operators.coverage import coverage_fractional
from locusweave.operators.features import advanced_features, advanced_filter, validate_advanced, validate_loci, validation
from locusweave.operators.filters import single_copy_seeds
from locusweave.operators.quality import coverage_quality
from locusweave.operators.readsets import jaccard_to_reference, seed_reads
from locusweave.session import materialize
from locusweave.sources import tables
from locusweave.workload import query
from locusweave.workload.base import kept_loci, r6
from locusweave.workload.coverage import BIN, QUALITY
from locusweave.workload.sql import ALN, LOCI, SEEDS
from locusweave.workload.transcripts import FULL

BW = 1024

READS_OF_SEEDS = "sr AS (SELECT DISTINCT seed_ord, read_id FROM a JOIN seeds USING (chrom) WHERE s <= se AND e >= ss AND flag & 2048 = 0)"


@query(
    "seed_copy_number",
    f"""WITH {ALN}, {SEEDS}, {LOCI}, {READS_OF_SEEDS},
sh AS (SELECT DISTINCT seed_ord, locus_id FROM sr JOIN members USING (read_id))
SELECT s.seed_ord, count(l.locus_id) FILTER (NOT (l.chrom = s.chrom AND ls = ss AND le = se)) > 0 AS multi_copy
FROM seeds s LEFT JOIN sh USING (seed_ord) LEFT JOIN loci l USING (locus_id) GROUP BY 1""",
)
def _seed_copy_number(spark, d):
    loci, members = kept_loci(spark, d)
    seeds = tables.seeds(spark, d)
    reads = materialize(seed_reads(tables.alignments(spark, d), seeds, bin_width=BW))
    return single_copy_seeds(seeds, loci, members, reads)


@query(
    "locus_validation",
    f"""WITH {ALN}, {SEEDS}, {LOCI}, {FULL}, {READS_OF_SEEDS},
ms AS (SELECT locus_id FROM sr JOIN members USING (read_id) GROUP BY 1 HAVING count(DISTINCT seed_ord) >= 2),
h AS (SELECT locus_id, ls, le, s, e, line FROM (SELECT locus_id, chrom, ls, le FROM loci) x JOIN f USING (chrom) WHERE s <= le AND e >= ls),
k AS (SELECT locus_id, bin, count(*) AS n FROM (SELECT locus_id, unnest(range((greatest(s, ls) - ls) // 1000, (least(e, le) - ls) // 1000 + 1)) AS bin FROM h) GROUP BY 1, 2),
sp AS (SELECT locus_id, unnest(range(0, (le - ls) // 1000 + 1)) AS bin FROM loci),
sd AS (SELECT locus_id, stddev_pop(coalesce(n, 0)) AS coverage_std FROM sp LEFT JOIN k USING (locus_id, bin) GROUP BY 1),
ev AS (SELECT locus_id, count(*) FILTER (line % 2 = 0) AS spliced, count(*) FILTER (line % 2 = 1) AS unspliced, stddev_pop(e - s) / avg(e - s) AS cv FROM h GROUP BY 1),
v AS (SELECT *, locus_id IN (SELECT locus_id FROM ms) AS multi_seed, spliced::DOUBLE / (spliced + unspliced) AS ratio FROM ev JOIN sd USING (locus_id)),
w AS (SELECT *, (CASE WHEN coverage_std > 50 THEN 1.0 WHEN coverage_std > 20 THEN 0.7 WHEN coverage_std > 10 THEN 0.4 ELSE 0.1 END * 0.35
  + CASE WHEN ratio > 0.3 AND ratio < 0.95 THEN 0.9 WHEN ratio >= 0.95 THEN 0.6 ELSE 0.4 END * 0.25
  + CASE WHEN cv < 0.3 THEN 0.9 WHEN cv < 0.5 THEN 0.7 WHEN cv < 0.7 THEN 0.4 ELSE 0.2 END * 0.20 + CASE WHEN multi_seed THEN 1.0 ELSE 0.5 END * 0.20)::DOUBLE AS score FROM v)
SELECT locus_id, spliced, unspliced, round(coverage_std, 6) AS coverage_std, multi_seed, round(score, 6) AS score,
  CASE WHEN score > 0.7 THEN 'true_gene' WHEN score > 0.4 THEN 'uncertain' ELSE 'false_positive' END AS class FROM w""",
)
def _locus_validation(spark, d):
    loci, members = kept_loci(spark, d)
    reads = seed_reads(tables.alignments(spark, d), tables.seeds(spark, d), bin_width=BW)
    many = reads.join(members, "read_id").groupBy("locus_id").agg(F.count_distinct("seed_ord").alias("n")).where("n >= 2")
    v = validate_loci(tables.spliced_alignments(spark, d), loci, many, bin_width=BW)
    return v.select("locus_id", "spliced", "unspliced", r6("coverage_std"), "multi_seed", r6("score"), "class")


#: ``af`` (locus_id, ...): features of all loci from alignments at most 0.05 diverged.
FEATURES = f"""{ALN}, {LOCI}, {FULL.replace("l_suppkey % 11 * 3 AS tail,", "l_suppkey % 11 * 3 AS tail, l_discount::DOUBLE + (l_orderkey % 997) / 1e6::DOUBLE AS de,")},
g AS (SELECT locus_id, ls, le, line, rev, s, e, kind, de, CASE WHEN line % 4 = 0 THEN 2 WHEN line % 2 = 0 THEN 1 ELSE 0 END AS intr,
    16.9918::DOUBLE / CASE WHEN line % 4 = 0 THEN 15 WHEN line % 2 = 0 THEN 16 ELSE 20 END AS ident
  FROM (SELECT locus_id, chrom, ls, le FROM loci) loci JOIN f USING (chrom) WHERE s <= le AND e >= ls),
k AS (SELECT locus_id, bin, count(*) AS n FROM (SELECT locus_id, unnest(range((greatest(s, ls) - ls) // 1000, (least(e, le) - ls) // 1000 + 1)) AS bin
  FROM g WHERE de <= 0.05) GROUP BY 1, 2),
sp AS (SELECT locus_id, unnest(range(0, (le - ls) // 1000 + 1)) AS bin FROM loci),
sd AS (SELECT locus_id, stddev_pop(coalesce(n, 0)) AS coverage_std FROM sp LEFT JOIN k USING (locus_id, bin) GROUP BY 1),
af AS (SELECT locus_id, any_value(ls) AS ls, count(*) FILTER (de <= 0.05) AS total, count(*) FILTER (de <= 0.05 AND NOT rev) AS plus,
  count(*) FILTER (de <= 0.05 AND rev) AS minus, coalesce(avg(e - s) FILTER (de <= 0.05), 0) AS mean_length,
  coalesce(stddev_pop(e - s) FILTER (de <= 0.05), 0) AS length_std, coalesce(avg(de) FILTER (de <= 0.05), 1) AS mean_divergence,
  coalesce(avg(ident) FILTER (de <= 0.05), 0) AS mean_identity, coalesce(avg(intr) FILTER (de <= 0.05), 0) AS mean_introns,
  any_value(coverage_std) AS coverage_std FROM g JOIN sd USING (locus_id) GROUP BY 1)"""


def _tagged(spark, d):
    """The alignments with tags spread wider, so that identities lie on both sides of the limit and averages on none."""
    a = tables.spliced_alignments(spark, d)
    return a.withColumn("cm", F.col("cm") * 1.2137).withColumn("de", F.col("de").cast("double") + F.col("read_id") % 997 / 1e6)


@query(
    "advanced_filter",
    f"""WITH {FEATURES} SELECT locus_id, total, round(mean_divergence + 1e-9, 5) AS mean_divergence, round(mean_identity + 1e-9, 5) AS mean_identity FROM af
WHERE total >= 6 AND mean_divergence <= 0.05 AND greatest(plus, minus)::DOUBLE / total >= 0.55 AND NOT (mean_identity < 0.9 AND mean_identity > 0)""",
)
def _advanced_filter(spark, d):
    loci, _ = kept_loci(spark, d)
    kept = advanced_filter(advanced_features(_tagged(spark, d), loci, bin_width=BW), 6, 0.05, 0.55)
    return kept.select("locus_id", "total", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("mean_divergence", "mean_identity")])


@query(
    "advanced_validation",
    f"""WITH {FEATURES},
p AS (SELECT a.locus_id AS seed_id, b.locus_id AS target_id, a.plus > a.minus AS sa, b.plus > b.minus AS sb, b.mean_length / nullif(a.mean_length, 0) AS ratio,
  CASE WHEN b.mean_length > 0 THEN b.length_std / b.mean_length ELSE 0 END AS cv, b.coverage_std AS cs, abs(a.mean_introns - b.mean_introns) AS gi,
  abs(a.mean_divergence - b.mean_divergence) AS gd, abs(a.mean_identity - b.mean_identity) AS gm
  FROM (SELECT locus_id, lead(locus_id) OVER (PARTITION BY chrom ORDER BY ls) AS nxt FROM loci) x JOIN af a USING (locus_id) JOIN af b ON b.locus_id = x.nxt)
SELECT seed_id, target_id, round((CASE WHEN sa = sb THEN 1.0 ELSE 0 END * 0.25 + CASE WHEN ratio BETWEEN 0.7 AND 1.3 THEN 1.0 WHEN ratio BETWEEN 0.5 AND 2.0 THEN 0.5 ELSE 0 END * 0.20
  + CASE WHEN cv < 0.5 THEN 1.0 ELSE 0.5 END * 0.15 + CASE WHEN cs > 50 THEN 1.0 ELSE 0.5 END * 0.15
  + CASE WHEN gi <= 2 THEN 1.0 WHEN gi <= 5 THEN 0.5 ELSE 0 END * 0.10
  + CASE WHEN gd < 0.02 THEN 1.0 WHEN gd < 0.05 THEN 0.7 WHEN gd < 0.1 THEN 0.4 ELSE 0 END * 0.10
  + CASE WHEN gm < 0.02 THEN 1.0 WHEN gm < 0.05 THEN 0.7 WHEN gm < 0.1 THEN 0.4 ELSE 0 END * 0.05)::DOUBLE, 6) AS similarity FROM p""",
)
def _advanced_validation(spark, d):
    loci, _ = kept_loci(spark, d)
    nxt = F.lead("locus_id").over(Window.partitionBy("chrom").orderBy("start"))
    pairs = materialize(loci.select(F.col("locus_id").alias("seed_id"), nxt.alias("target_id")).where("target_id IS NOT NULL"))
    v = validate_advanced(_tagged(spark, d), pairs, loci, bin_width=BW)
    return v.select("seed_id", "target_id", r6("similarity"))


@query(
    "layered_validation",
    f"""WITH {QUALITY}, {SEEDS}, {READS_OF_SEEDS},
ns AS (SELECT locus_id, count(DISTINCT seed_ord) AS n_seeds, count(DISTINCT read_id) AS x FROM sr JOIN members USING (read_id) GROUP BY 1),
qv AS (SELECT q.locus_id, sym, lsl, rsl, CASE WHEN h > 0 THEN least(1, h / 50) * 0.3::DOUBLE + (lsl + rsl) / 2 * 0.4::DOUBLE + (1 - sym) * 0.3::DOUBLE ELSE 0 END AS score,
  coalesce(n_seeds, 0) AS n_seeds, coalesce(x, 0)::DOUBLE / (nr + (SELECT count(DISTINCT read_id) FROM sr) - coalesce(x, 0)) AS jaccard,
  CASE WHEN n_seeds > 0 THEN least(1.0, n_seeds / 5.0)::DOUBLE END AS isoseq FROM q JOIN sizes USING (locus_id) LEFT JOIN ns USING (locus_id)),
qc AS (SELECT *, CASE WHEN score >= 0.8 AND sym < 0.3 AND lsl > 0.5 AND rsl > 0.5 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS cls FROM qv),
qt AS (SELECT *, (CASE cls WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.6 ELSE 0.2 END * 0.3 + least(jaccard, 1.0) * 0.2 + coalesce(isoseq * 0.3, 0)
  + CASE WHEN n_seeds >= 2 THEN 0.2 ELSE 0 END)::DOUBLE / (0.5 + CASE WHEN isoseq IS NULL THEN 0 ELSE 0.3 END + CASE WHEN n_seeds >= 2 THEN 0 ELSE 0.2 END)::DOUBLE AS norm FROM qc)
SELECT locus_id, cls AS coverage_confidence, n_seeds >= 2 AS multi_seed, round(norm + 1e-9, 5) AS normalized_score,
  CASE WHEN norm >= 0.8 THEN 'High' WHEN norm >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence,
  score >= 0.4 AND jaccard >= 0.01 AND coalesce(isoseq >= 0.6, true) AS is_valid FROM qt""",
)
def _layered_validation(spark, d):
    loci, members = kept_loci(spark, d)
    spans = loci.select("locus_id", "chrom", "start", "end")
    prof = coverage_fractional(tables.alignments(spark, d), spans, BIN, bin_width=BW)
    reads = materialize(seed_reads(tables.alignments(spark, d), tables.seeds(spark, d), bin_width=BW))
    seeds = reads.join(members, "read_id").groupBy("locus_id").agg(F.count_distinct("seed_ord").alias("n_seeds"))
    sim = jaccard_to_reference(members, reads.select("read_id").distinct()).select("locus_id", "jaccard")
    scored = coverage_quality(prof, BIN).join(sim, "locus_id").join(seeds, "locus_id", "left").na.fill(0, ["n_seeds"])
    v = validation(scored.withColumn("isoseq", F.when(F.col("n_seeds") > 0, F.least(F.lit(1.0), F.col("n_seeds") / 5.0))))
    return v.select(
        "locus_id", "coverage_confidence", "multi_seed", F.round(F.col("normalized_score") + 1e-9, 5).alias("normalized_score"), "confidence", "is_valid"
    )
