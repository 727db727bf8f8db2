"""Scoring detected loci against annotated genes."""

from pyspark.sql import functions as F

from locusweave.operators.evaluate import (
    best_overlap,
    best_seed_support,
    evaluate_best_interval,
    evaluate_optimal,
    evaluation_totals,
    family_by_any_overlap,
    family_by_half_coverage,
    member_table,
    novel_ranking,
    optimal_match,
    overlapping_pairs,
)
from locusweave.operators.interval_join import as_regions, interval_join
from locusweave.operators.readsets import jaccard_to_reference, seed_reads
from locusweave.session import materialize
from locusweave.sources import tables
from locusweave.workload import query
from locusweave.workload.base import kept_loci
from locusweave.workload.sql import ALN, GENES, LOCI, SEEDS

#: Loci within 500 bp of a family's genes stand in for that family's detections.
DET = f"""{ALN}, {LOCI}, {GENES},
det AS (SELECT DISTINCT family_id, locus_id, l.chrom, ls, le FROM loci l JOIN genes g ON l.chrom = g.chrom
  AND ls <= ge + 500 AND le >= gs - 500),
pr AS (SELECT g.family_id, gene_id, gs, ge, locus_id, ls, le, least(ge, le) - greatest(gs, ls) AS ov,
    CAST(least(ge, le) - greatest(gs, ls) AS DOUBLE) / (ge - gs) AS ref_cov,
    CAST(least(ge, le) - greatest(gs, ls) AS DOUBLE) / (greatest(ge, le) - least(gs, ls)) AS iou,
    CAST(least(ge, le) - greatest(gs, ls) AS DOUBLE)
      / ((ge - gs) + (le - ls) - (least(ge, le) - greatest(gs, ls))) AS iou_u
  FROM genes g JOIN det d ON g.family_id = d.family_id AND g.chrom = d.chrom AND gs < le AND ge > ls)"""


def _detections(spark, d):
    loci, members = kept_loci(spark, d)
    genes = tables.genes(spark, d)
    sr = seed_reads(tables.alignments(spark, d), tables.seeds(spark, d), bin_width=1024)
    sim = jaccard_to_reference(members, sr).select("locus_id", "n_reads", "jaccard")
    near = interval_join(
        loci.select("locus_id", "chrom", "start", "end"), as_regions(genes, "family_id"), pad=500, bin_width=1024
    ).select("family_id", "locus_id", "chrom", "start", "end").distinct()
    det = near.join(sim, "locus_id").withColumn("distance", F.length("locus_id") % 3)
    return genes, materialize(det)


def _family_seeds(spark, d):
    """Seeds of a family: those touching one of its genes."""
    near = interval_join(tables.seeds(spark, d), as_regions(tables.genes(spark, d), "family_id"))
    return near.select("family_id", "seed_ord", "chrom", "start", "end").distinct()


BEST = f"""{DET},
b AS (SELECT *, row_number() OVER (PARTITION BY family_id, gene_id ORDER BY ov DESC, ls, locus_id) AS rn FROM pr)"""


@query(
    "best_overlap_match",
    f"""WITH {BEST} SELECT family_id, gene_id, locus_id, ov AS overlap, round(ref_cov, 6) AS ref_cov, round(iou, 6) AS iou
FROM b WHERE rn = 1""",
)
def _best_overlap_match(spark, d):
    genes, det = _detections(spark, d)
    return best_overlap(genes, det).select(
        "family_id", "gene_id", "locus_id", "overlap", F.round("ref_cov", 6).alias("ref_cov"), F.round("iou", 6).alias("iou")
    )


TOTALS = f"""{BEST},
pg AS (SELECT g.family_id, g.gene_id, coalesce(ref_cov, 0) * 100 AS pct, coalesce(ref_cov, 0) >= 0.5 AS found,
  CASE WHEN coalesce(ref_cov, 0) >= 0.5 THEN locus_id END AS locus_id, g.ge - g.gs AS span
  FROM genes g LEFT JOIN (SELECT * FROM b WHERE rn = 1) x ON x.family_id = g.family_id AND x.gene_id = g.gene_id),
dn AS (SELECT family_id, count(*) AS n_det, CAST(sum(le - ls) AS BIGINT) AS dspan FROM det GROUP BY 1),
tg AS (SELECT family_id, count(*) AS n, count(*) FILTER (found) AS f, count(DISTINCT locus_id) AS m,
  coalesce(avg(pct) FILTER (found), 0) AS ap, CAST(sum(span) AS BIGINT) AS gspan FROM pg GROUP BY 1)"""


@query(
    "evaluation_best_interval",
    f"""WITH {TOTALS}
SELECT family_id, n AS total_genes, f AS genes_found, n - f AS genes_missed, coalesce(n_det, 0) - m AS extra_regions,
  round(f * 100.0::DOUBLE / n, 6) AS sensitivity,
  round(CASE WHEN f + coalesce(n_det, 0) - m > 0 THEN f * 100.0::DOUBLE / (f + coalesce(n_det, 0) - m)
    WHEN coalesce(n_det, 0) = 0 THEN 0 ELSE 100 END, 6) AS precision,
  round(ap, 6) AS avg_overlap_pct, gspan AS total_gt_span, coalesce(dspan, 0) AS total_detected_span
FROM tg LEFT JOIN dn USING (family_id)""",
)
def _evaluation_best_interval(spark, d):
    genes, det = _detections(spark, d)
    t = evaluation_totals(evaluate_best_interval(genes, det), det)
    for c in ("sensitivity", "precision", "avg_overlap_pct"):
        t = t.withColumn(c, F.round(c, 6))
    return t


@query("evaluation_optimal")
def _evaluation_optimal(spark, d):
    genes, det = _detections(spark, d)
    t = evaluation_totals(evaluate_optimal(genes, det, _family_seeds(spark, d)), det)
    for c in ("sensitivity", "precision", "avg_overlap_pct"):
        t = t.withColumn(c, F.round(c, 6))
    return t


@query("optimal_match")
def _optimal_match(spark, d):
    genes, det = _detections(spark, d)
    return optimal_match(genes, det)


#: Least cost of each overlap island by trying, gene after gene, every locus that is still free; equal sets of used loci keep the cheapest.
LEAST_COST = f"""{DET},
iv AS (SELECT family_id, chrom, gs AS s, ge AS e FROM genes UNION ALL SELECT family_id, chrom, ls, le FROM det),
iw AS (SELECT *, max(e) OVER (PARTITION BY family_id, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
ii AS (SELECT family_id, chrom, s AS isl, coalesce(lead(s) OVER (PARTITION BY family_id, chrom ORDER BY s), 9000000000000) AS nxt
  FROM (SELECT DISTINCT family_id, chrom, s FROM iw WHERE pe IS NULL OR s >= pe)),
pi AS (SELECT pr.family_id, ii.chrom, isl, gene_id, list({{'l': locus_id, 'c': round((1 - iou) * 1000000)::BIGINT}}) AS picks
  FROM pr JOIN det USING (family_id, locus_id) JOIN ii ON ii.family_id = pr.family_id AND ii.chrom = det.chrom AND gs >= isl AND gs < nxt GROUP BY 1, 2, 3, 4),
go AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY family_id, chrom, isl ORDER BY gene_id) AS rn FROM pi),
op AS MATERIALIZED (SELECT family_id, chrom, isl, rn, p.l AS l, p.c AS c FROM (SELECT family_id, chrom, isl, rn, unnest(picks) AS p FROM go)
  UNION ALL SELECT family_id, chrom, isl, rn, NULL, 1000000 FROM go),
dp AS (SELECT DISTINCT family_id, chrom, isl, 0::BIGINT AS rn, []::VARCHAR[] AS used, 0::BIGINT AS cost FROM go
  UNION ALL SELECT family_id, chrom, isl, rn, used, min(cost) FROM (
    SELECT op.family_id, op.chrom, op.isl, op.rn, CASE WHEN l IS NULL THEN dp.used ELSE list_sort(list_append(dp.used, l)) END AS used, dp.cost + c AS cost
    FROM dp JOIN op ON op.family_id = dp.family_id AND op.chrom = dp.chrom AND op.isl = dp.isl AND op.rn = dp.rn + 1
    WHERE l IS NULL OR NOT list_contains(dp.used, l)) GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "optimal_match_cost",
    f"""WITH RECURSIVE {LEAST_COST}, be AS (SELECT family_id, chrom, isl, rn, min(cost) AS cost FROM dp GROUP BY 1, 2, 3, 4)
SELECT family_id, chrom, sum(cost)::BIGINT AS total_cost, true AS one_to_one
FROM be JOIN (SELECT family_id, chrom, isl, max(rn) AS rn FROM go GROUP BY 1, 2, 3) USING (family_id, chrom, isl, rn) GROUP BY 1, 2""",
)
def _optimal_match_cost(spark, d):
    genes, det = _detections(spark, d)
    pairs = materialize(overlapping_pairs(genes, det).withColumn("cost", F.round((1 - F.col("iou")) * 1_000_000).cast("bigint")))
    got = optimal_match(genes, det).join(pairs, ["family_id", "gene_id", "locus_id"]).groupBy("family_id", "chrom").agg(
        F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n"),
        ((F.count(F.lit(1)) == F.count_distinct("gene_id")) & (F.count(F.lit(1)) == F.count_distinct("locus_id"))).alias("one_to_one"),
    )
    wanted = pairs.groupBy("family_id", "chrom").agg(F.count_distinct("gene_id").alias("genes"))
    # A gene that overlaps detections but gets none costs as much as no match.
    return wanted.join(got, ["family_id", "chrom"], "left").select(
        "family_id", "chrom", (F.coalesce("cost", F.lit(0)) + (F.col("genes") - F.coalesce("n", F.lit(0))) * 1_000_000).alias("total_cost"),
        F.coalesce("one_to_one", F.lit(True)).alias("one_to_one"),
    )


@query(
    "seed_support_of_genes",
    f"""WITH {SEEDS}, {GENES},
p AS (SELECT family_id, gene_id, least(ge, se) - greatest(gs, ss) AS ov,
  CAST(least(ge, se) - greatest(gs, ss) AS DOUBLE) / (ge - gs) AS c,
  CAST(least(ge, se) - greatest(gs, ss) AS DOUBLE) / (greatest(ge, se) - least(gs, ss)) AS iou
  FROM genes JOIN seeds USING (chrom) WHERE gs < se AND ge > ss),
r AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY round(c, 9) DESC, iou DESC) AS rn FROM p)
SELECT family_id, gene_id, round(c, 6) AS seed_cov, round(iou, 6) AS seed_iou, ov AS seed_overlap FROM r WHERE rn = 1""",
)
def _seed_support_of_genes(spark, d):
    s = best_seed_support(tables.genes(spark, d), _family_seeds(spark, d))
    return s.withColumn("seed_cov", F.round("seed_cov", 6)).withColumn("seed_iou", F.round("seed_iou", 6))


@query(
    "family_any_overlap",
    f"""WITH {DET}, best AS (SELECT family_id, gene_id, max(ref_cov) AS c FROM pr GROUP BY 1, 2)
SELECT g.family_id, count(c) AS found, count(*) AS total, round(count(c) * 100.0::DOUBLE / count(*), 6) AS sensitivity,
  round(coalesce(avg(c), 0) * 100, 6) AS avg_overlap
FROM genes g LEFT JOIN best USING (family_id, gene_id) GROUP BY 1""",
)
def _family_any_overlap(spark, d):
    genes, det = _detections(spark, d)
    f = family_by_any_overlap(genes, det)
    return f.withColumn("sensitivity", F.round("sensitivity", 6)).withColumn("avg_overlap", F.round("avg_overlap", 6))


@query(
    "family_half_coverage",
    f"""WITH RECURSIVE {DET},
o AS MATERIALIZED (SELECT family_id, gene_id, locus_id, iou_u, row_number() OVER (PARTITION BY family_id ORDER BY iou_u DESC, gene_id DESC, locus_id DESC) AS rn FROM pr),
gm AS (SELECT family_id, rn, [gene_id] AS gn, [locus_id] AS lc, iou_u AS total FROM o WHERE rn = 1
  UNION ALL SELECT o.family_id, o.rn,
    CASE WHEN list_contains(gn, gene_id) OR list_contains(lc, locus_id) THEN gn ELSE list_append(gn, gene_id) END,
    CASE WHEN list_contains(gn, gene_id) OR list_contains(lc, locus_id) THEN lc ELSE list_append(lc, locus_id) END,
    CASE WHEN list_contains(gn, gene_id) OR list_contains(lc, locus_id) THEN total ELSE total + iou_u END
  FROM gm JOIN o ON o.family_id = gm.family_id AND o.rn = gm.rn + 1),
m AS (SELECT family_id, len(arg_max(gn, rn)) AS matched, arg_max(total, rn) AS total FROM gm GROUP BY 1),
ng AS (SELECT family_id, count(*) AS n_genes FROM genes GROUP BY 1),
tp AS (SELECT family_id, count(DISTINCT gene_id) AS tp FROM pr WHERE ov > (ge - gs) * 0.5 GROUP BY 1),
nd AS (SELECT family_id, count(*) AS n_det FROM det GROUP BY 1),
nt AS (SELECT family_id, count(DISTINCT locus_id) AS n_touch FROM pr GROUP BY 1),
z AS (SELECT family_id, n_genes, coalesce(tp, 0) AS tp, coalesce(n_det, 0) AS n_det, coalesce(n_touch, 0) AS n_touch, coalesce(matched, 0) AS matched, coalesce(total, 0) AS total
  FROM ng LEFT JOIN tp USING (family_id) LEFT JOIN nd USING (family_id) LEFT JOIN nt USING (family_id) LEFT JOIN m USING (family_id))
SELECT family_id, tp, n_genes - tp AS fn, n_det - n_touch AS fp, round(CAST(tp AS DOUBLE) / n_genes, 6) AS sensitivity,
  round(CASE WHEN n_det > 0 THEN 1 - CAST(n_det - n_touch AS DOUBLE) / n_det ELSE 1 END, 6) AS specificity,
  round(CASE WHEN matched > 0 THEN total / matched ELSE 0 END, 6) AS iou, matched FROM z""",
)
def _family_half_coverage(spark, d):
    genes, det = _detections(spark, d)
    f = family_by_half_coverage(genes, det)
    for c in ("sensitivity", "specificity", "iou"):
        f = f.withColumn(c, F.round(c, 6))
    return f


@query(
    "member_table",
    f"""WITH {BEST}, {SEEDS},
mx AS (SELECT family_id, gene_id, max(iou_u) AS iou FROM pr GROUP BY 1, 2),
pool AS (SELECT DISTINCT read_id FROM a JOIN seeds USING (chrom) WHERE s <= se AND e >= ss AND flag & 2048 = 0),
sim AS (SELECT locus_id, count(*) AS nr, CAST(count(pool.read_id) AS DOUBLE)
    / (count(*) + (SELECT count(*) FROM pool) - count(pool.read_id)) AS j
  FROM members LEFT JOIN pool USING (read_id) GROUP BY 1),
t AS (SELECT g.family_id, count(*) AS copies_available, count(mx.gene_id) AS copies_found,
  coalesce(max(nd), 0) AS nd FROM genes g LEFT JOIN mx USING (family_id, gene_id)
  LEFT JOIN (SELECT family_id, count(*) AS nd FROM det GROUP BY 1) n USING (family_id) GROUP BY 1),
mem AS (SELECT g.family_id, g.chrom || ':' || g.gs || '-' || g.ge AS location, gene_name AS member_name,
  coalesce(iou, 0) AS iou, x.locus_id, 1 AS is_seed FROM genes g LEFT JOIN mx USING (family_id, gene_id)
  LEFT JOIN (SELECT family_id, gene_id, locus_id FROM b WHERE rn = 1) x USING (family_id, gene_id)),
ex AS (SELECT family_id, chrom || ':' || ls || '-' || le AS location,
  'extra_' || row_number() OVER (PARTITION BY family_id ORDER BY chrom, ls, le) AS member_name,
  CAST(NULL AS DOUBLE) AS iou, locus_id, 0 AS is_seed FROM det
  WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.family_id = det.family_id AND pr.locus_id = det.locus_id))
SELECT family_id, location, member_name, round(u.iou, 6) AS iou, round(j, 6) AS pred_jaccard, nr AS pred_reads,
  le - ls AS pred_span_bp, CAST(is_seed AS BIGINT) AS is_seed, copies_available, copies_found, nd - copies_found AS copies_extra,
  round(CAST(copies_found AS DOUBLE) / copies_available, 6) AS sensitivity,
  round(CASE WHEN nd > 0 THEN CAST(copies_found AS DOUBLE) / nd ELSE 0 END, 6) AS precision
FROM (SELECT * FROM mem UNION ALL SELECT * FROM ex) u JOIN t USING (family_id)
LEFT JOIN sim USING (locus_id) LEFT JOIN loci USING (locus_id)""",
)
def _member_table(spark, d):
    genes, det = _detections(spark, d)
    t = member_table(genes, det).withColumn("is_seed", F.col("is_seed").cast("bigint"))
    for c in ("iou", "pred_jaccard", "sensitivity", "precision"):
        t = t.withColumn(c, F.round(c, 6))
    return t


@query(
    "novel_rank",
    f"""WITH {TOTALS}, {SEEDS},
pool AS (SELECT DISTINCT read_id FROM a JOIN seeds USING (chrom) WHERE s <= se AND e >= ss AND flag & 2048 = 0),
sim AS (SELECT locus_id, count(*) AS nr, CAST(count(pool.read_id) AS DOUBLE)
    / (count(*) + (SELECT count(*) FROM pool) - count(pool.read_id)) AS j
  FROM members LEFT JOIN pool USING (read_id) GROUP BY 1)
SELECT family_id, locus_id, nr AS n_reads, round(ln(nr + 1) * greatest(j, 1e-6) / (1 + length(locus_id) % 3), 6) AS rank_score
FROM det JOIN sim USING (locus_id) WHERE NOT EXISTS (
  SELECT 1 FROM pg WHERE pg.family_id = det.family_id AND pg.locus_id = det.locus_id)""",
)
def _novel_rank(spark, d):
    genes, det = _detections(spark, d)
    r = novel_ranking(evaluate_best_interval(genes, det), det)
    return r.select("family_id", "locus_id", "n_reads", F.round("rank_score", 6).alias("rank_score"))
