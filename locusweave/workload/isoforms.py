"""Isoform assembly, member assignment and feature scores."""

from pyspark.sql import functions as F

from locusweave.functions.cigar import splice_junctions
from locusweave.operators.features import advanced_features, locus_evidence, segment_confidence
from locusweave.operators.isoforms import (
    assemble_isoforms,
    assign_to_members,
    junction_conservation,
    read_genes,
    single_exon_groups,
    snapped_chains,
)
from locusweave.operators.readsets import set_sizes
from locusweave.session import materialize
from locusweave.sources import tables
from locusweave.workload import query
from locusweave.workload.base import whole_loci
from locusweave.workload.sql import ALN, GENES, LOCI, anchored
from locusweave.workload.transcripts import FULL

BW = 1024


def _spliced_reads(spark, d):
    a = tables.spliced_alignments(spark, d)
    rid = F.concat_ws("/", F.col("read_id").cast("string"), F.col("line").cast("string"))
    return a.select(
        rid.alias("read_id"), "chrom", "strand", "start", "end", splice_junctions("start", "cigar").alias("junctions")
    )


ASSEMBLED = f"""{FULL},
w AS (SELECT *, max(e) OVER (PARTITION BY chrom, rev ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM f),
g AS (SELECT *, CASE WHEN line % 4 = 0 THEN [[s + 5 * q, s + 7 * q], [s + 12 * q, s + 15 * q]] WHEN line % 2 = 0 THEN [[s + 8 * q, s + 12 * q]] ELSE [] END AS js,
  last_value(CASE WHEN pe IS NULL OR s - pe > 100 THEN s END IGNORE NULLS) OVER (PARTITION BY chrom, rev ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS gene FROM w),
rd AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM g WHERE len(js) > 0),
jn AS (SELECT id, chrom, rev, gene, i, js[i][1] AS d, js[i][2] AS a FROM rd, range(1, 3) AS r(i) WHERE i <= len(js)),
dp AS (SELECT chrom, rev, gene, d AS pos FROM jn), ap AS (SELECT chrom, rev, gene, a AS pos FROM jn),
{anchored("dp", "chrom, rev, gene", 10, True, "dn")},
{anchored("ap", "chrom, rev, gene", 10, True, "ac")},
ck AS (SELECT id, list([dn.anchor, ac.anchor] ORDER BY i) AS chain FROM jn
  JOIN dn ON dn.chrom = jn.chrom AND dn.rev = jn.rev AND dn.gene = jn.gene AND dn.pos = d
  JOIN ac ON ac.chrom = jn.chrom AND ac.rev = jn.rev AND ac.gene = jn.gene AND ac.pos = a GROUP BY 1),
ch AS MATERIALIZED (SELECT chrom, rev, gene, s, e, chain FROM rd JOIN ck USING (id)),
tot AS (SELECT chrom, rev, gene, count(*) AS n FROM ch GROUP BY 1, 2, 3),
sup AS (SELECT chrom, rev, gene, j, count(*) AS n FROM (SELECT chrom, rev, gene, unnest(chain) AS j FROM ch) GROUP BY 1, 2, 3, 4),
weak AS (SELECT sup.chrom, sup.rev, sup.gene, j FROM sup JOIN tot ON tot.chrom = sup.chrom AND tot.rev = sup.rev AND tot.gene = sup.gene
  WHERE sup.n < 2 OR sup.n < tot.n * 0.1::DOUBLE),
px AS (SELECT chrom, rev, gene, chain[1:k] AS path, count(*) AS coverage, sum(s) AS ss, sum(e) AS es FROM ch, range(1, 3) AS r(k)
  WHERE k <= len(chain) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
bad AS (SELECT DISTINCT p.chrom, p.rev, p.gene, path FROM (SELECT *, unnest(path) AS j FROM px) p
  JOIN weak ON weak.chrom = p.chrom AND weak.rev = p.rev AND weak.gene = p.gene AND weak.j = p.j)"""


@query(
    "isoform_assembly",
    f"""WITH RECURSIVE {ASSEMBLED} SELECT chrom, CASE WHEN rev THEN '-' ELSE '+' END AS strand, gene, len(path) AS n_junctions, coverage,
  (ss // coverage)::BIGINT AS start, (es // coverage)::BIGINT AS "end" FROM px ANTI JOIN bad USING (chrom, rev, gene, path)""",
)
def _isoform_assembly(spark, d):
    reads = materialize(read_genes(_spliced_reads(spark, d), 100))
    iso = assemble_isoforms(snapped_chains(reads, 10), min_coverage=2)
    return iso.select("chrom", "strand", "gene", F.size("chain").alias("n_junctions"), "coverage", "start", "end")


@query(
    "single_exon_groups",
    f"""WITH {FULL}, b AS (SELECT chrom, rev, s, e FROM f WHERE line % 2 = 1),
w AS (SELECT *, max(e) OVER (PARTITION BY chrom, rev ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
c AS (SELECT *, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, rev ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS cl FROM w)
SELECT chrom, CASE WHEN rev THEN '-' ELSE '+' END AS strand, min(s) AS start, max(e) AS "end", count(*) AS n_rows
FROM c GROUP BY chrom, rev, cl HAVING count(*) >= 3""",
)
def _single_exon_groups(spark, d):
    return single_exon_groups(_spliced_reads(spark, d))


MEMBERS = f"""{FULL}, {GENES},
m AS (SELECT gene_id, chrom, gs, ge, gene_id % 2 = 1 AS rev FROM genes),
h AS (SELECT f.read_id || '/' || f.line AS rid, f.*, gene_id, least(e, ge) - greatest(s, gs) AS ov, gs
  FROM f JOIN m USING (chrom, rev) WHERE s < ge AND e > gs),
asg AS (SELECT rid, gene_id FROM (SELECT rid, gene_id, row_number() OVER (PARTITION BY rid ORDER BY ov DESC, gs, gene_id) AS rn FROM h) WHERE rn = 1)"""


def _members(spark, d):
    g = tables.genes(spark, d)
    return g.select(
        F.col("gene_id").alias("member_id"), "chrom", F.when(F.col("gene_id") % 2 == 1, "-").otherwise("+").alias("strand"), "start", "end"
    )


@query("reads_to_members", f"WITH {MEMBERS} SELECT rid AS read_id, gene_id AS member_id FROM asg")
def _reads_to_members(spark, d):
    return assign_to_members(_spliced_reads(spark, d), _members(spark, d))


@query(
    "junction_conservation",
    f"""WITH {MEMBERS},
j AS (SELECT f.chrom, rid, gene_id, unnest(CASE WHEN line % 4 = 0 THEN [[s + 5 * q, s + 7 * q], [s + 12 * q, s + 15 * q]]
    WHEN line % 2 = 0 THEN [[s + 8 * q, s + 12 * q]] ELSE [] END) AS x FROM f JOIN asg ON rid = f.read_id || '/' || f.line)
SELECT chrom, x[1] AS j_start, x[2] AS j_end, count(DISTINCT rid) AS n_reads, count(DISTINCT gene_id) AS n_members,
  count(DISTINCT gene_id) >= 2 AS conserved FROM j GROUP BY 1, 2, 3""",
)
def _junction_conservation(spark, d):
    reads = _spliced_reads(spark, d)
    return junction_conservation(reads, assign_to_members(reads, _members(spark, d)))


@query(
    "advanced_features",
    f"""WITH {ALN}, {LOCI}, {FULL.replace("l_suppkey % 11 * 3 AS tail,", "l_suppkey % 11 * 3 AS tail, l_discount AS de, l_tax,")},
g AS (SELECT locus_id, line, rev, q, s, e, kind, de, l_tax, CASE WHEN line % 4 = 0 THEN 2 WHEN line % 2 = 0 THEN 1 ELSE 0 END AS intr,
    14.0 / CASE WHEN line % 4 = 0 THEN 15 WHEN line % 2 = 0 THEN 16 ELSE 20 END AS ident
  FROM (SELECT locus_id, chrom, ls, le FROM loci) loci JOIN f USING (chrom) WHERE s <= le AND e >= ls)
SELECT locus_id, count(*) FILTER (de <= 0.05) AS total, count(*) FILTER (de <= 0.05 AND NOT rev) AS plus,
  round(coalesce(avg(e - s) FILTER (de <= 0.05), 0) + 1e-9, 4) AS mean_length, round(coalesce(avg(intr) FILTER (de <= 0.05), 0) + 1e-9, 5) AS mean_introns,
  round(coalesce(avg(ident) FILTER (de <= 0.05), 0) + 1e-9, 5)::DOUBLE AS mean_identity,
  count(*) FILTER (kind & 256 <> 0) AS n_secondary, count(*) FILTER (kind & 2048 <> 0) AS n_supplementary
FROM g GROUP BY 1""",
)
def _advanced_features(spark, d):
    loci, _ = whole_loci(spark, d)
    f = advanced_features(tables.spliced_alignments(spark, d), materialize(loci), bin_width=BW)
    r = lambda c, n: F.round(F.col(c) + 1e-9, n).alias(c)
    return f.select(
        "locus_id", "total", "plus", r("mean_length", 4), r("mean_introns", 5), r("mean_identity", 5), "n_secondary", "n_supplementary"
    )


@query(
    "segment_confidence",
    f"""WITH {ALN}, {LOCI}, d AS (SELECT locus_id, nr, le - ls AS sp, nr / ((le - ls) / 1000.0::DOUBLE) AS dn FROM loci JOIN sizes USING (locus_id))
SELECT locus_id, round(dn, 6) AS read_density, round((CASE WHEN dn < 10 THEN 0.5 ELSE 1 END * CASE WHEN sp < 5000 THEN 0.3 ELSE 1 END
  * CASE WHEN sp > 500000 THEN 0.7 ELSE 1 END * CASE WHEN nr < 10 THEN 0.3 ELSE 1 END)::DOUBLE, 6) AS confidence,
  NOT (dn < 10 OR sp < 5000 OR nr < 10) AS is_valid FROM d""",
)
def _segment_confidence(spark, d):
    loci, members = whole_loci(spark, d)
    s = segment_confidence(loci.join(set_sizes(members), "locus_id"))
    return s.select("locus_id", F.round("read_density", 6).alias("read_density"), F.round("confidence", 6).alias("confidence"), "is_valid")


@query(
    "splicing_evidence",
    f"""WITH {ALN}, {LOCI}, {FULL}
SELECT locus_id, count(*) FILTER (line % 2 = 0) AS spliced, count(*) FILTER (line % 2 = 1) AS unspliced,
  round(avg(e - s) + 1e-9, 4) AS mean_length FROM (SELECT locus_id, chrom, ls, le FROM loci) loci JOIN f USING (chrom)
WHERE s <= le AND e >= ls GROUP BY 1""",
)
def _splicing_evidence(spark, d):
    loci, _ = whole_loci(spark, d)
    e = locus_evidence(tables.spliced_alignments(spark, d), materialize(loci), bin_width=BW)
    return e.select("locus_id", "spliced", "unspliced", F.round(F.col("mean_length") + 1e-9, 4).alias("mean_length"))
