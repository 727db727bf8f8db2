"""CIGAR functions, transcript evidence, boundary trims and read clouds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from locusweave.config import ClipTail, Envelope, ExonTrim, Integrated, Refine
from locusweave.functions.cigar import (
    aligned_length,
    end_position,
    exon_blocks,
    intron_count,
    junction_positions,
    query_length,
    signature_similarity,
    soft_clip_lengths,
    splice_junctions,
    three_prime_clip,
)
from locusweave.functions.intervals import is_reverse
from locusweave.operators.clouds import cloud_alignments, extend_by_clips, find_clouds
from locusweave.operators.readsets import jaccard_edges, pooled_reads
from locusweave.operators.refine import exon_trim, jaccard_trim, refine_loci, window_jaccards
from locusweave.operators.interval_join import as_regions
from locusweave.operators.transcripts import (
    adaptive_bin_profile,
    anchored_clusters,
    boundary_clusters,
    boundary_distribution,
    boundary_points,
    end_clusters,
    locus_similarity,
    percentile_bounds,
    site_support,
    splice_signatures,
    merge_subclouds,
    splice_clusters,
    splice_subclouds,
    split_by_transcripts,
    split_clouds,
    strand_counts,
    strand_exon_bounds,
    transcript_boundaries,
    transcript_geometry,
    transcript_summary,
)
from locusweave.operators.trims import clip_outcomes, clip_tail_trim, envelope_trim
from locusweave.plans.integrated import detect_integrated
from locusweave.session import materialize
from locusweave.sources import tables
from locusweave.workload import query
from locusweave.workload.base import kept_loci, whole_loci
from locusweave.workload.sql import ALN, EDGES, LOCI, SEEDS, anchored

BW = 1024

#: The alignments with the parts their CIGAR and tags are built from.
FULL = """f AS (SELECT l_orderkey AS read_id, 'chr' || CAST(l_suppkey % 5 AS VARCHAR) AS chrom, l_linenumber AS line,
  l_partkey * 1000 + l_orderkey % 97 AS s, l_partkey * 1000 + l_orderkey % 97 + CAST(l_quantity AS BIGINT) * 20 AS e,
  CAST(l_quantity AS BIGINT) AS q, l_linestatus = 'O' AS rev, l_partkey % 7 * 4 AS lead, l_suppkey % 11 * 3 AS tail,
  (CASE WHEN l_linenumber % 3 = 2 THEN 256 ELSE 0 END) + (CASE WHEN l_linenumber % 7 = 0 THEN 2048 ELSE 0 END) AS kind
  FROM lineitem)"""


def _full(spark, d):
    return tables.spliced_alignments(spark, d)


@query(
    "exon_blocks",
    f"""WITH {FULL},
b AS (SELECT read_id, CAST(line AS BIGINT) AS line, unnest(CASE
  WHEN line % 4 = 0 THEN [[s, s + 5 * q], [s + 7 * q, s + 12 * q], [s + 15 * q, s + 20 * q]]
  WHEN line % 2 = 0 THEN [[s, s + 8 * q], [s + 12 * q, s + 20 * q]] ELSE [[s, s + 20 * q]] END) AS x FROM f)
SELECT read_id, line, x[1] AS b_start, x[2] AS b_end FROM b""",
)
def _exon_blocks(spark, d):
    b = _full(spark, d).select("read_id", F.col("line").cast("bigint").alias("line"), F.explode(exon_blocks("start", "cigar")).alias("b"))
    return b.select("read_id", "line", F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"))


@query(
    "junction_positions",
    f"""WITH {FULL},
j AS (SELECT chrom, unnest(CASE WHEN line % 4 = 0 THEN [s + 5 * q, s + 7 * q, s + 10 * q, s + 13 * q]
    WHEN line % 2 = 0 THEN [s + 8 * q, s + 12 * q] ELSE [] END) AS pos FROM f)
SELECT chrom, pos, count(*) AS n FROM j GROUP BY 1, 2""",
)
def _junction_positions(spark, d):
    j = _full(spark, d).select("chrom", F.explode(junction_positions("start", "cigar")).alias("pos"))
    return j.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n"))


@query(
    "splice_junction_support",
    f"""WITH {FULL},
j AS (SELECT chrom, read_id, unnest(CASE WHEN line % 4 = 0 THEN [[s + 5 * q, s + 7 * q], [s + 12 * q, s + 15 * q]]
    WHEN line % 2 = 0 THEN [[s + 8 * q, s + 12 * q]] ELSE [] END) AS x FROM f)
SELECT chrom, x[1] AS j_start, x[2] AS j_end, count(DISTINCT read_id) AS n_reads FROM j GROUP BY 1, 2, 3""",
)
def _splice_junction_support(spark, d):
    j = _full(spark, d).select("chrom", "read_id", F.explode(splice_junctions("start", "cigar")).alias("j"))
    return j.groupBy("chrom", F.col("j.start").alias("j_start"), F.col("j.end").alias("j_end")).agg(
        F.count_distinct("read_id").alias("n_reads")
    )


@query(
    "cigar_measures",
    f"""WITH {FULL}
SELECT read_id, CAST(line AS BIGINT) AS line, e AS tx_end, CAST(CASE WHEN line % 4 = 0 THEN 2 WHEN line % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS introns,
  CASE WHEN line % 4 = 0 THEN 15 WHEN line % 2 = 0 THEN 16 ELSE 20 END * q AS aligned,
  lead + tail + CASE WHEN line % 4 = 0 THEN 15 WHEN line % 2 = 0 THEN 16 ELSE 20 END * q AS query_len,
  CASE WHEN rev THEN tail ELSE lead END AS clip5, CASE WHEN rev THEN lead ELSE tail END AS clip3,
  CASE WHEN rev THEN CASE WHEN lead > 0 THEN 0 END
    WHEN tail > 0 THEN lead + CASE WHEN line % 4 = 0 THEN 15 WHEN line % 2 = 0 THEN 16 ELSE 20 END * q END AS clip3_at
FROM f""",
)
def _cigar_measures(spark, d):
    clips = soft_clip_lengths("cigar", is_reverse())
    return _full(spark, d).select(
        "read_id",
        F.col("line").cast("bigint").alias("line"),
        end_position("start", "cigar").alias("tx_end"),
        intron_count("cigar").cast("bigint").alias("introns"),
        aligned_length("cigar").alias("aligned"),
        query_length("cigar").alias("query_len"),
        clips["five"].alias("clip5"),
        clips["three"].alias("clip3"),
        three_prime_clip("cigar", is_reverse())["start"].alias("clip3_at"),
    )


OUTCOME = """CASE WHEN rev THEN CASE WHEN lead = 0 THEN 'none' WHEN lead < 12 THEN 'too_short' ELSE 'ok_minus' END
  ELSE CASE WHEN tail = 0 THEN 'none' WHEN tail < 12 THEN 'too_short'
    WHEN CAST(floor(tail - tail * (read_id % 4) / 4.0) AS DOUBLE) / tail < 0.62 THEN 'low_a' ELSE 'ok_plus' END END"""


@query("clip_outcomes", f"WITH {FULL} SELECT read_id, CAST(line AS BIGINT) AS line, {OUTCOME} AS outcome FROM f")
def _clip_outcomes(spark, d):
    return clip_outcomes(_full(spark, d)).select("read_id", F.col("line").cast("bigint").alias("line"), "outcome")


FULL_LOCI = f"{ALN}, {LOCI}, {FULL}"
OWN = """own AS (SELECT f.*, locus_id, ls, le FROM f JOIN loci USING (chrom) WHERE s < le AND e > ls AND kind = 0
  AND EXISTS (SELECT 1 FROM members m WHERE m.locus_id = loci.locus_id AND m.read_id = f.read_id))"""


@query(
    "envelope_trim",
    f"""WITH {FULL_LOCI}, {OWN},
r AS (SELECT locus_id, s, e, row_number() OVER (PARTITION BY locus_id ORDER BY s) AS rs,
  row_number() OVER (PARTITION BY locus_id ORDER BY e) AS re, count(*) OVER (PARTITION BY locus_id) AS n FROM own),
b AS (SELECT locus_id, max(n) AS n, max(s) FILTER (rs = floor((n - 1) * 0.05) + 1) AS qs,
  max(e) FILTER (re = floor((n - 1) * 0.95) + 1) AS qe FROM r GROUP BY 1),
o AS (SELECT locus_id, ls, le, coalesce(n >= 5 AND qe > qs AND least(qe, le) > greatest(qs, ls, 1)
  AND least(qe, le) - greatest(qs, ls) >= 300, false) AS ok, qs, qe FROM loci LEFT JOIN (SELECT * FROM b) b USING (locus_id))
SELECT locus_id, CASE WHEN ok THEN greatest(qs, ls, 1) ELSE ls END AS start, CASE WHEN ok THEN least(qe, le) ELSE le END AS "end" FROM o""".replace(
        "o AS (SELECT locus_id, ls, le, coalesce(n >= 5", "o AS (SELECT locus_id, ls, le, coalesce(b.n >= 5"
    ),
)
def _envelope_trim(spark, d):
    loci, members = kept_loci(spark, d)
    out = envelope_trim(_full(spark, d), loci, members, Envelope(min_span=300, min_alignments=5), bin_width=BW)
    return out.select("locus_id", "start", "end")


@query(
    "clip_tail_trim",
    f"""WITH {FULL_LOCI}, {OWN}, k AS (SELECT *, {OUTCOME} AS oc FROM own),
q AS (SELECT locus_id, count(*) AS t, count(*) FILTER (oc = 'ok_plus') AS np, count(*) FILTER (oc = 'ok_minus') AS nm,
  list_sort(list(e) FILTER (oc = 'ok_plus')) AS pe, list_sort(list(s) FILTER (oc = 'ok_minus')) AS ms
  FROM k WHERE oc LIKE 'ok%' GROUP BY 1),
m AS (SELECT locus_id, t, np, nm, (pe[(np + 1) // 2] + pe[np // 2 + 1]) // 2 AS mp, (ms[(nm + 1) // 2] + ms[nm // 2 + 1]) // 2 AS mm FROM q),
o AS (SELECT loci.locus_id, ls, le, CAST(np AS DOUBLE) / t >= 0.65 AND np >= 3 AS plus, CAST(nm AS DOUBLE) / t >= 0.65 AND nm >= 3 AS minus,
  least(mp + 50, le) AS ne, greatest(mm - 50, 1, ls) AS ns FROM loci LEFT JOIN m USING (locus_id))
SELECT locus_id, CASE WHEN NOT coalesce(plus, false) AND minus AND ns > ls AND le - ns >= 300 THEN ns ELSE ls END AS start,
  CASE WHEN plus AND ne < le AND ne - ls >= 300 THEN ne ELSE le END AS "end" FROM o""",
)
def _clip_tail_trim(spark, d):
    loci, members = kept_loci(spark, d)
    p = ClipTail(min_reads=3, end_slack=50, start_slack=50, min_result_span=300)
    return clip_tail_trim(_full(spark, d), loci, members, p, bin_width=BW).select("locus_id", "start", "end")


@query(
    "strand_counts",
    f"""WITH {FULL_LOCI}
SELECT locus_id, count(*) AS total, count(*) FILTER (NOT rev) AS plus, count(*) FILTER (rev) AS minus,
  round(CASE WHEN count(*) FILTER (rev) > 0 THEN CAST(count(*) FILTER (NOT rev) AS DOUBLE) / count(*) FILTER (rev) ELSE 99 END, 6) AS strand_ratio
FROM loci JOIN f USING (chrom) WHERE s <= le AND e >= ls GROUP BY 1""",
)
def _strand_counts(spark, d):
    loci, _ = whole_loci(spark, d)
    c = strand_counts(tables.alignments(spark, d), loci, bin_width=BW)
    return c.select("locus_id", "total", "plus", "minus", F.round("strand_ratio", 6).alias("strand_ratio"))


SUMMARY = f"""{FULL_LOCI},
x AS (SELECT locus_id, ls, le, rev, greatest(s, ls) AS cs, least(s + 1000, le) AS ce FROM loci JOIN f USING (chrom) WHERE s <= le AND e >= ls),
tot AS (SELECT locus_id, count(*) AS total, count(*) FILTER (NOT rev) AS plus, count(*) FILTER (rev) AS minus FROM x GROUP BY 1),
b AS (SELECT locus_id, unnest(generate_series((cs - ls) // 1000, (ce - ls) // 1000)) AS bin FROM x WHERE cs < ce),
k AS (SELECT locus_id, bin, count(*) AS c FROM b GROUP BY 1, 2),
spine AS (SELECT locus_id, unnest(generate_series(0, (le - ls) // 1000)) AS bin FROM loci),
sd AS (SELECT locus_id, stddev_pop(coalesce(c, 0)) AS coverage_std FROM spine LEFT JOIN k USING (locus_id, bin) GROUP BY 1),
summ AS (SELECT * FROM tot JOIN sd USING (locus_id))"""


@query(
    "transcript_summary",
    f"WITH {SUMMARY} SELECT locus_id, total, plus, minus, round(coverage_std + 1e-9, 5) AS coverage_std FROM summ",
)
def _transcript_summary(spark, d):
    loci, _ = whole_loci(spark, d)
    s = transcript_summary(_full(spark, d), loci, bin_width=BW)
    return s.select("locus_id", "total", "plus", "minus", F.round(F.col("coverage_std") + 1e-9, 5).alias("coverage_std"))


@query(
    "locus_similarity",
    f"""WITH {SUMMARY}, {EDGES}
SELECT src AS seed_locus, dst AS target_locus, round(CASE WHEN (p.plus > p.minus) <> (t.plus > t.minus) THEN 0
  ELSE 0.5 + 0.5 * CASE WHEN t.coverage_std > 50 THEN 1 WHEN t.coverage_std > 20 THEN 0.7 WHEN t.coverage_std > 10 THEN 0.4 ELSE 0.1 END END, 6)::DOUBLE AS isoseq_sim
FROM edges JOIN summ p ON p.locus_id = src JOIN summ t ON t.locus_id = dst""",
)
def _locus_similarity(spark, d):
    loci, members = kept_loci(spark, d)
    pairs = jaccard_edges(members, 0.05).select(F.col("src").alias("seed_locus"), F.col("dst").alias("target_locus"))
    s = locus_similarity(_full(spark, d), pairs, loci, bin_width=BW)
    return s.select("seed_locus", "target_locus", F.round("isoseq_sim", 6).alias("isoseq_sim"))


@query(
    "transcript_envelopes",
    f"""WITH {FULL_LOCI},
g AS (SELECT locus_id, ls, le, rev, s, e FROM loci JOIN f USING (chrom) WHERE s <= le AND e >= ls),
dm AS (SELECT locus_id, count(*) FILTER (NOT rev) < count(*) FILTER (rev) AS rev FROM g GROUP BY 1),
p AS (SELECT locus_id, max(ls) AS ls, max(le) AS le, CAST(round(quantile_cont(s, 0.25)) AS BIGINT) AS a,
  CAST(round(quantile_cont(e, 0.75)) AS BIGINT) AS b FROM g JOIN dm USING (locus_id, rev) GROUP BY 1)
SELECT locus_id, least(greatest(a, ls), le) AS tx_start, least(greatest(b, ls), le) AS tx_end FROM p
WHERE least(greatest(b, ls), le) > least(greatest(a, ls), le)""",
)
def _transcript_envelopes(spark, d):
    loci, _ = whole_loci(spark, d)
    return strand_exon_bounds(transcript_geometry(_full(spark, d), loci, bin_width=BW), loci)


@query(
    "percentile_envelopes",
    f"""WITH {FULL_LOCI},
g AS (SELECT locus_id, s, e, row_number() OVER (PARTITION BY locus_id ORDER BY s) AS rs,
  row_number() OVER (PARTITION BY locus_id ORDER BY e) AS re, count(*) OVER (PARTITION BY locus_id) AS n
  FROM loci JOIN (SELECT chrom, s, e FROM f) f USING (chrom) WHERE s <= le AND e >= ls)
SELECT locus_id, max(s) FILTER (rs = least(n // 10, n - 1) + 1) AS tx_start, max(e) FILTER (re = least(n * 9 // 10, n - 1) + 1) AS tx_end
FROM g GROUP BY 1""".replace("count(*) OVER (PARTITION BY locus_id) AS n\n", "count(*) OVER (PARTITION BY locus_id) AS n\n").replace(
        "FROM loci JOIN (SELECT chrom, s, e FROM f) f", "FROM (SELECT locus_id, chrom, ls, le FROM loci) loci JOIN (SELECT chrom, s, e FROM f) f"
    ),
)
def _percentile_envelopes(spark, d):
    loci, _ = whole_loci(spark, d)
    return percentile_bounds(transcript_geometry(_full(spark, d), loci, bin_width=BW))


@query(
    "boundary_clusters",
    f"""WITH {FULL_LOCI},
g AS (SELECT locus_id, CASE WHEN rev THEN '-' ELSE '+' END AS strand, rev, s, e FROM loci JOIN f USING (chrom) WHERE s <= le AND e >= ls),
pt AS (SELECT locus_id, strand, true AS is_start, CASE WHEN rev THEN e ELSE s END AS pos FROM g
  UNION ALL SELECT locus_id, strand, false, CASE WHEN rev THEN s ELSE e END FROM g),
w AS (SELECT *, lag(pos) OVER (PARTITION BY locus_id, strand, is_start ORDER BY pos) AS prev FROM pt),
c AS (SELECT *, sum(CASE WHEN prev IS NULL OR pos - prev > 60 THEN 1 ELSE 0 END)
  OVER (PARTITION BY locus_id, strand, is_start ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cl FROM w)
SELECT locus_id, strand, is_start, CAST(sum(pos) // count(*) AS BIGINT) AS position, round(least(1.0, count(*) / 10.0), 6) AS confidence,
  CASE WHEN is_start THEN 'TSS' ELSE 'TES' END || CASE WHEN strand = '+' THEN '_plus' ELSE '_minus' END AS evidence
FROM c GROUP BY locus_id, strand, is_start, cl HAVING count(*) >= 3""".replace("{FULL_LOCI},\ng", "{FULL_LOCI},\ng").replace("\nc AS (SELECT *, sum", "\ncc AS (SELECT *, sum").replace("FROM c GROUP BY locus_id, strand", "FROM cc GROUP BY locus_id, strand").replace("\nw AS (SELECT *, lag(pos)", "\nww AS (SELECT *, lag(pos)").replace("AS cl FROM w)", "AS cl FROM ww)"),
)
def _boundary_clusters(spark, d):
    loci, _ = whole_loci(spark, d)
    c = boundary_clusters(boundary_points(tables.alignments(spark, d), loci, bin_width=BW), 60, 3)
    return c.withColumn("confidence", F.round("confidence", 6))


@query(
    "signature_similarity",
    f"""WITH {FULL_LOCI},
r AS (SELECT locus_id, read_id, s, e, line, q, row_number() OVER (PARTITION BY locus_id, read_id ORDER BY s, e) AS rn
  FROM (SELECT locus_id, chrom, ls, le FROM loci) loci JOIN f USING (chrom) WHERE s <= le AND e >= ls),
sg AS (SELECT locus_id, read_id, s, CASE WHEN line % 4 = 0 THEN [[s + 5 * q, s + 7 * q], [s + 12 * q, s + 15 * q]]
    WHEN line % 2 = 0 THEN [[s + 8 * q, s + 12 * q]] ELSE [] END AS j FROM r WHERE rn = 1),
nx AS (SELECT locus_id, read_id, j, lead(j) OVER (PARTITION BY locus_id ORDER BY s, read_id) AS k FROM sg WHERE len(j) > 0),
m AS (SELECT *, len(list_filter(j, lambda x: len(list_filter(k, lambda y: abs(x[1] - y[1]) <= 60 AND abs(x[2] - y[2]) <= 60)) > 0)) AS hit
  FROM nx WHERE k IS NOT NULL)
SELECT locus_id, read_id, round(CAST(hit AS DOUBLE) / (len(j) + len(k) - hit), 6) AS similarity FROM m""",
)
def _signature_similarity(spark, d):
    loci, _ = whole_loci(spark, d)
    sig = splice_signatures(_full(spark, d), loci, bin_width=BW)
    nxt = F.lead("junctions").over(Window.partitionBy("locus_id").orderBy("start", "read_id"))
    return sig.withColumn("nxt", nxt).where("nxt IS NOT NULL").select(
        "locus_id", "read_id", F.round(signature_similarity("junctions", "nxt", 60), 6).alias("similarity")
    )


def _subclouds_sql(tolerance: int, least: str) -> str:
    """``sc`` (locus_id, chrom, cluster, start, stop, n_spliced).

    The recursion walks the distinct patterns of a locus by their first read and keeps the founders as a list.
    """
    hit = f"len(list_filter({{a}}, lambda x: len(list_filter({{b}}, lambda y: abs(x[1] - y[1]) <= {tolerance} AND abs(x[2] - y[2]) <= {tolerance})) > 0))"
    of_lead = hit.format(a="o.j", b="k.j")
    alike = f"len(list_filter(w.kept, lambda k: ({of_lead})::DOUBLE / (len(o.j) + len(k.j) - {of_lead}) >= {least})) > 0"
    pair = hit.format(a="g.j", b="h.j")
    return f"""{FULL_LOCI},
r AS (SELECT locus_id, loci.chrom, read_id, s, e, line, q, row_number() OVER (PARTITION BY locus_id, read_id ORDER BY s, e) AS rn
  FROM (SELECT locus_id, chrom, ls, le FROM loci) loci JOIN f USING (chrom) WHERE s <= le AND e >= ls),
sg AS MATERIALIZED (SELECT locus_id, chrom, read_id, s, e, CASE WHEN line % 4 = 0 THEN [[s + 5 * q, s + 7 * q], [s + 12 * q, s + 15 * q]]
    ELSE [[s + 8 * q, s + 12 * q]] END AS j FROM r WHERE rn = 1 AND line % 2 = 0),
o AS MATERIALIZED (SELECT locus_id, j, min((s, read_id)) AS fst, row_number() OVER (PARTITION BY locus_id ORDER BY min((s, read_id))) AS rn FROM sg GROUP BY 1, 2),
w AS (SELECT locus_id, rn, [{{'j': j, 'fst': fst, 'c': 0}}] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.locus_id, o.rn, CASE WHEN {alike} THEN w.kept ELSE list_append(w.kept, {{'j': o.j, 'fst': o.fst, 'c': len(w.kept)::INT}}) END
  FROM w JOIN o ON o.locus_id = w.locus_id AND o.rn = w.rn + 1),
h AS MATERIALIZED (SELECT locus_id, k.j AS j, k.fst AS fst, k.c::BIGINT AS c FROM (SELECT locus_id, unnest(arg_max(kept, rn)) AS k FROM w GROUP BY 1)),
m AS (SELECT g.*, c, ({pair})::DOUBLE / (len(g.j) + len(h.j) - {pair}) AS sim FROM sg g JOIN h ON h.locus_id = g.locus_id AND h.fst <= (g.s, g.read_id)),
cl AS (SELECT *, row_number() OVER (PARTITION BY locus_id, read_id ORDER BY sim DESC, c) AS rn FROM m WHERE sim >= {least}),
sc AS (SELECT locus_id, any_value(chrom) AS chrom, c AS cluster, min(s) AS start, max(e) AS stop, count(*) AS n_spliced FROM cl WHERE rn = 1 GROUP BY locus_id, c)"""


@query(
    "splice_subclouds",
    f"""WITH RECURSIVE {_subclouds_sql(60, "0.3::DOUBLE")} SELECT locus_id, chrom, cluster, start, stop AS "end", n_spliced FROM sc WHERE n_spliced >= 2""",
)
def _splice_subclouds(spark, d):
    loci, _ = whole_loci(spark, d)
    sub, _ = splice_subclouds(materialize(splice_signatures(_full(spark, d), loci, bin_width=BW)), 0.3, 2, 60)
    return sub


@query(
    "merged_subclouds",
    f"""WITH RECURSIVE {_subclouds_sql(60, "0.3::DOUBLE")}, big AS (SELECT * FROM sc WHERE n_spliced >= 2),
mw AS (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM big),
mg AS (SELECT *, sum(CASE WHEN pe IS NULL OR start >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl FROM mw),
mr AS (SELECT mg.chrom, isl, count(DISTINCT read_id) AS n_reads FROM mg JOIN cl ON cl.locus_id = mg.locus_id AND cl.c = mg.cluster AND cl.rn = 1 GROUP BY 1, 2)
SELECT chrom, min(start) AS start, max(stop) AS "end", any_value(n_reads) AS n_reads, sum(n_spliced)::BIGINT AS n_spliced
FROM mg JOIN mr USING (chrom, isl) GROUP BY chrom, isl HAVING any_value(n_reads) >= 3""",
)
def _merged_subclouds(spark, d):
    loci, _ = whole_loci(spark, d)
    sig = materialize(splice_signatures(_full(spark, d), loci, bin_width=BW))
    sub, _ = splice_subclouds(sig, 0.3, 2, 60)
    return merge_subclouds(sub, splice_clusters(sig, 0.3, 60), 3)


def _ends_sql(which: str, name: str) -> str:
    """Clusters of transcript starts or ends per locus and strand, anchored at the outermost one."""
    plus, minus = ("s", "-e") if which == "tss" else ("e", "-s")
    return f"""{name}_t AS (SELECT locus_id, chrom, CASE WHEN rev THEN '-' ELSE '+' END AS strand, s, e, CASE WHEN rev THEN {minus} ELSE {plus} END AS pos
  FROM (SELECT locus_id, chrom, ls, le FROM loci) x JOIN f USING (chrom) WHERE s <= le AND e >= ls AND kind = 0 AND e - s <= 200000),
{anchored(f"{name}_t", "locus_id, strand", 100, False, f"{name}_c")},
{name} AS (SELECT t.locus_id, t.chrom, t.strand, c.anchor, min(s) AS start, max(e) AS stop, count(*) AS n_transcripts
  FROM {name}_t t JOIN {name}_c c ON t.locus_id = c.locus_id AND t.strand = c.strand AND t.pos = c.pos GROUP BY ALL)"""


@query(
    "transcript_start_clusters",
    f"""WITH RECURSIVE {FULL_LOCI}, {_ends_sql("tss", "tss")} SELECT locus_id, strand, start, stop AS "end", n_transcripts FROM tss""",
)
def _transcript_start_clusters(spark, d):
    loci, _ = whole_loci(spark, d)
    t = transcript_boundaries(_full(spark, d), loci, bin_width=BW)
    return end_clusters(t, 100, "tss").select("locus_id", "strand", "start", "end", "n_transcripts")


@query(
    "split_by_transcripts",
    f"""WITH RECURSIVE {FULL_LOCI}, {_ends_sql("tss", "tss")}, {_ends_sql("tes", "tes")},
n AS (SELECT locus_id, chrom, ls, le, (SELECT count(*) FROM tss_t t WHERE t.locus_id = loci.locus_id) AS n FROM loci),
a AS (SELECT locus_id, count(*) AS a FROM tss WHERE n_transcripts >= 3 GROUP BY 1),
b AS (SELECT locus_id, count(*) AS b FROM tes WHERE n_transcripts >= 3 GROUP BY 1),
ch AS (SELECT locus_id, abs(coalesce(b, 0) - 2) < abs(coalesce(a, 0) - 2) AS by_end FROM n LEFT JOIN a USING (locus_id) LEFT JOIN b USING (locus_id) WHERE n >= 3)
SELECT locus_id, chrom, ls AS start, le AS "end", '+' AS strand, n AS n_transcripts FROM n WHERE n < 3
UNION ALL SELECT locus_id, chrom, start, stop, strand, n_transcripts FROM tss JOIN ch USING (locus_id) WHERE NOT by_end AND n_transcripts >= 3
UNION ALL SELECT locus_id, chrom, start, stop, strand, n_transcripts FROM tes JOIN ch USING (locus_id) WHERE by_end AND n_transcripts >= 3""".replace("\na AS (SELECT locus_id, count", "\nna AS (SELECT locus_id, count").replace("\nb AS (SELECT locus_id, count", "\nnbb AS (SELECT locus_id, count").replace("LEFT JOIN a USING", "LEFT JOIN na USING").replace("LEFT JOIN b USING", "LEFT JOIN nbb USING"),
)
def _split_by_transcripts(spark, d):
    loci, _ = whole_loci(spark, d)
    loci = materialize(loci.select("locus_id", "chrom", "start", "end"))
    t = materialize(transcript_boundaries(_full(spark, d), loci, bin_width=BW))
    return split_by_transcripts(t, loci, 100, 3, expected=2)


#: ``pts`` (locus_id, position, confidence, evidence): window valleys and end clusters of all loci.
SPLIT_POINTS = f"""{FULL_LOCI},
lx AS (SELECT locus_id, chrom, ls, le, greatest((le - ls) // 100, 40) AS bs FROM loci),
g AS MATERIALIZED (SELECT lx.*, s, e, rev FROM lx JOIN (SELECT chrom, s, e, rev FROM f) f USING (chrom) WHERE s <= le AND e >= ls),
cb AS (SELECT locus_id, unnest(range(least(greatest(s - ls, 0) // bs, (le - ls) // bs), least(greatest(e - ls, 0) // bs, (le - ls) // bs) + 1)) AS bin FROM g),
cn AS (SELECT locus_id, bin, count(*) AS n FROM cb GROUP BY 1, 2),
pr AS (SELECT x.locus_id, x.bin, (2 * ls + (2 * x.bin + 1) * bs) // 2 AS mid, coalesce(n, 0)::DOUBLE AS cov, (le - ls) // bs + 1 AS nb
  FROM (SELECT *, unnest(range(0, (le - ls) // bs + 1)) AS bin FROM lx) x LEFT JOIN cn ON cn.locus_id = x.locus_id AND cn.bin = x.bin),
wv AS (SELECT *, avg(cov) OVER (PARTITION BY locus_id ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l,
  avg(cov) OVER (PARTITION BY locus_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r FROM pr),
vl AS (SELECT locus_id, mid AS position, 1.0::DOUBLE - cov / ((l + r) / 2.0::DOUBLE) AS confidence, 'coverage_valley' AS evidence FROM wv
  WHERE nb >= 7 AND bin >= 3 AND bin < nb - 3 AND l + r > 0 AND 1.0::DOUBLE - cov / ((l + r) / 2.0::DOUBLE) >= 0.5 AND cov < 5),
pt AS (SELECT locus_id, rev, true AS is_start, CASE WHEN rev THEN e ELSE s END AS pos FROM g
  UNION ALL SELECT locus_id, rev, false, CASE WHEN rev THEN s ELSE e END FROM g),
pw AS (SELECT *, lag(pos) OVER (PARTITION BY locus_id, rev, is_start ORDER BY pos) AS prev FROM pt),
pc AS (SELECT *, sum(CASE WHEN prev IS NULL OR pos - prev > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY locus_id, rev, is_start ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cl FROM pw),
ec AS (SELECT locus_id, (sum(pos) // count(*))::BIGINT AS position, least(1.0::DOUBLE, count(*) / 10.0::DOUBLE) AS confidence,
  CASE WHEN is_start THEN 'TSS' ELSE 'TES' END || CASE WHEN rev THEN '_minus' ELSE '_plus' END AS evidence
  FROM pc GROUP BY locus_id, rev, is_start, cl HAVING count(*) >= 3),
pts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY position, evidence) AS rn FROM (SELECT * FROM vl UNION ALL SELECT * FROM ec))"""


@query(
    "split_clouds",
    f"""WITH RECURSIVE {SPLIT_POINTS},
mg AS (SELECT locus_id, rn, 1 AS grp, position, confidence, evidence FROM pts WHERE rn = 1
  UNION ALL SELECT o.locus_id, o.rn, CASE WHEN abs(o.position - w.position) < 300 THEN w.grp ELSE w.grp + 1 END,
    CASE WHEN abs(o.position - w.position) < 300 THEN trunc((w.position * w.confidence + o.position * o.confidence) / (w.confidence + o.confidence))::BIGINT ELSE o.position END,
    CASE WHEN abs(o.position - w.position) < 300 THEN least(w.confidence + o.confidence, 1.0::DOUBLE) ELSE o.confidence END,
    CASE WHEN abs(o.position - w.position) < 300 THEN w.evidence || '+' || o.evidence ELSE o.evidence END
  FROM mg w JOIN pts o ON o.locus_id = w.locus_id AND o.rn = w.rn + 1),
mp AS (SELECT locus_id, grp, max(rn) AS rn FROM mg GROUP BY 1, 2),
pk AS (SELECT locus_id, position, confidence, evidence, count(*) OVER (PARTITION BY locus_id) AS n,
  row_number() OVER (PARTITION BY locus_id ORDER BY confidence DESC, position) AS rank FROM mg JOIN mp USING (locus_id, grp, rn)),
mk AS (SELECT locus_id, position AS pos, evidence FROM pk WHERE n < 2 OR rank <= 2 UNION ALL SELECT locus_id, le, NULL FROM lx),
fn AS (SELECT locus_id, pos, evidence, lag(pos) OVER w AS prev, row_number() OVER w AS i, count(*) OVER (PARTITION BY locus_id) AS n FROM mk
  WINDOW w AS (PARTITION BY locus_id ORDER BY pos))
SELECT locus_id, chrom, coalesce(prev, ls) AS start, pos AS "end",
  CASE WHEN n = 1 THEN 'no_clear_splits' WHEN evidence IS NULL THEN 'final_segment' ELSE 'split_' || i || ': ' || evidence END AS split_evidence
FROM fn JOIN lx USING (locus_id)""",
)
def _split_clouds(spark, d):
    loci, _ = whole_loci(spark, d)
    clouds = materialize(loci.select("locus_id", "chrom", "start", "end"))
    return split_clouds(_full(spark, d), clouds, expected=3, min_bin=40, distance=60, min_points=3, reach=300, bin_width=BW)


@query("adaptive_bin_profile", f"WITH {SPLIT_POINTS} SELECT locus_id, mid AS position, round(cov, 6) AS cov FROM pr")
def _adaptive_bin_profile(spark, d):
    loci, _ = whole_loci(spark, d)
    prof = adaptive_bin_profile(_full(spark, d), materialize(loci.select("locus_id", "chrom", "start", "end")), 40, bin_width=BW)
    return prof.select("locus_id", F.col("mid").alias("position"), F.round("cov", 6).alias("cov"))


@query(
    "acceptor_support",
    f"""WITH RECURSIVE {FULL},
hits AS (SELECT chrom, read_id, unnest(CASE WHEN line % 4 = 0 THEN [s + 7 * q, s + 15 * q] WHEN line % 2 = 0 THEN [s + 12 * q] ELSE [] END) AS pos FROM f),
{anchored("hits", "chrom", 12, True)}
SELECT h.chrom, CAST(sum(h.pos) // count(*) AS BIGINT) AS center, count(DISTINCT read_id) AS n_reads
FROM hits h JOIN an ON h.chrom = an.chrom AND h.pos = an.pos GROUP BY h.chrom, an.anchor""",
)
def _acceptor_support(spark, d):
    from locusweave.functions.cigar import acceptor_sites

    hits = _full(spark, d).select("chrom", "read_id", F.explode(acceptor_sites("start", "cigar")).alias("pos"))
    return site_support(hits, ["chrom"], 12, cut=True)


@query(
    "anchored_starts",
    f"""WITH RECURSIVE {ALN}, pts AS (SELECT chrom, s AS pos FROM a), {anchored("pts", "chrom", 50, True)} SELECT chrom, pos, anchor FROM an""",
)
def _anchored_starts(spark, d):
    points = tables.alignments(spark, d).select("chrom", F.col("start").alias("pos"))
    return anchored_clusters(points, ["chrom"], 50, inclusive=True, cut=True)


@query(
    "boundary_distribution",
    f"""WITH {FULL_LOCI},
g AS (SELECT locus_id, rev, s, e FROM loci JOIN f USING (chrom) WHERE s <= le AND e >= ls AND kind = 0),
t AS (SELECT locus_id, count(*) AS k, count(*) FILTER (NOT rev) AS pl, count(*) FILTER (rev) AS mi, count(DISTINCT CASE WHEN rev THEN e ELSE s END) AS a,
  count(DISTINCT CASE WHEN rev THEN s ELSE e END) AS b FROM g GROUP BY 1)
SELECT locus_id, coalesce(k, 0) AS n_transcripts, coalesce(pl, 0) AS plus, coalesce(mi, 0) AS minus, coalesce(a, 0) AS n_tss, coalesce(b, 0) AS n_tes,
  round(coalesce(k, 0) / ((le - ls) / 10000.0), 6) AS per_10kb FROM loci LEFT JOIN t USING (locus_id)""",
)
def _boundary_distribution(spark, d):
    loci, _ = whole_loci(spark, d)
    t = transcript_boundaries(_full(spark, d), loci, bin_width=BW)
    return boundary_distribution(t, loci).withColumn("per_10kb", F.round("per_10kb", 6))


CLOUD_SRC = """src AS (SELECT read_id, chrom, s, e, kind, (CASE WHEN line * 2 <= 2 THEN 10 WHEN line * 2 BETWEEN 3 AND 5 THEN 13
    WHEN line * 2 BETWEEN 6 AND 10 THEN 16 ELSE 20 END) * (CASE WHEN q % 20 >= 10 THEN 2 ELSE 1 END) AS w FROM f)"""
POINTS = f"""{FULL}, {CLOUD_SRC}, st AS (SELECT DISTINCT chrom, s AS p FROM src),
act AS (SELECT st.chrom, p, read_id, s, e, w, kind FROM st JOIN src ON st.chrom = src.chrom AND s <= p AND e > p),
lead AS (SELECT chrom, p, read_id, arg_min(w, (s, e, w)) AS w FROM act GROUP BY 1, 2, 3),
wt AS (SELECT chrom, p, sum(w) AS wsum FROM lead GROUP BY 1, 2),
pts AS (SELECT act.chrom, act.p, min(s) AS cs, max(e) AS ce, count(*) FILTER (kind = 0) AS n1,
  count(*) FILTER (kind & 256 <> 0) AS n2, count(*) FILTER (kind & 2048 <> 0) AS n3 FROM act GROUP BY 1, 2),
em AS (SELECT pts.* FROM pts JOIN wt USING (chrom, p) WHERE wsum >= 80 AND ce - cs BETWEEN 200 AND 5000),
cw AS (SELECT *, max(ce) OVER (PARTITION BY chrom ORDER BY cs, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM em),
cc AS (SELECT *, sum(CASE WHEN pe IS NULL OR cs >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY cs, p ROWS UNBOUNDED PRECEDING) AS cl FROM cw),
cl AS (SELECT chrom, cl, min(cs) AS start, max(ce) AS stop, CAST(sum(n1) AS BIGINT) AS n_primary,
  CAST(sum(n2) AS BIGINT) AS n_secondary, CAST(sum(n3) AS BIGINT) AS n_supplementary FROM cc GROUP BY 1, 2),
rd AS (SELECT cc.chrom, cc.cl, count(DISTINCT read_id) AS n_reads FROM cc JOIN act USING (chrom, p) GROUP BY 1, 2)"""


@query(
    "read_clouds",
    f"""WITH {POINTS}
SELECT chrom, start, stop AS "end", n_reads, round(n_reads / ((stop - start) / 1000.0), 6) AS density, n_primary, n_secondary, n_supplementary
FROM cl JOIN rd USING (chrom, cl)""",
)
def _read_clouds(spark, d):
    a = materialize(cloud_alignments(_full(spark, d)))
    clouds, _ = find_clouds(a, 8, 200, 5000)
    return clouds.withColumn("density", F.round("density", 6))


BY_STRAND = (
    POINTS.replace("SELECT read_id, chrom, s, e, kind,", "SELECT read_id, chrom, rev, lead, tail, s, e, kind,")
    .replace("SELECT DISTINCT chrom, s AS p FROM src", "SELECT DISTINCT chrom, rev, s AS p FROM src")
    .replace("SELECT st.chrom, p, read_id, s, e, w, kind FROM st JOIN src ON st.chrom = src.chrom", "SELECT st.chrom, st.rev, p, read_id, s, e, w, kind FROM st JOIN src ON st.chrom = src.chrom AND st.rev = src.rev")
    .replace("SELECT chrom, p, read_id, arg_min(w, (s, e, w)) AS w FROM act GROUP BY 1, 2, 3", "SELECT chrom, rev, p, read_id, arg_min(w, (s, e, w)) AS w FROM act GROUP BY 1, 2, 3, 4")
    .replace("SELECT chrom, p, sum(w) AS wsum FROM lead GROUP BY 1, 2", "SELECT chrom, rev, p, sum(w) AS wsum FROM lead GROUP BY 1, 2, 3")
    .replace("SELECT act.chrom, act.p,", "SELECT act.chrom, act.rev, act.p,")
    .replace("AS n3 FROM act GROUP BY 1, 2)", "AS n3 FROM act GROUP BY 1, 2, 3)")
    .replace("JOIN wt USING (chrom, p) WHERE wsum >= 80", "JOIN wt USING (chrom, rev, p) WHERE wsum >= 60")
    .replace("ORDER BY cs, p ROWS", "ORDER BY cs, p, rev ROWS")
    .replace("FROM cc JOIN act USING (chrom, p) GROUP BY 1, 2", "FROM cc JOIN act USING (chrom, rev, p) GROUP BY 1, 2")
)


@query(
    "read_clouds_by_strand",
    f"""WITH {BY_STRAND},
x5 AS (SELECT cl.chrom, cl.cl, least(max(CASE WHEN rev THEN tail ELSE lead END), 50) AS x FROM cl JOIN src ON src.chrom = cl.chrom AND abs(s - start) <= 99 GROUP BY 1, 2),
x3 AS (SELECT cl.chrom, cl.cl, least(max(CASE WHEN rev THEN lead ELSE tail END), 50) AS x FROM cl JOIN src ON src.chrom = cl.chrom AND abs(e - stop) <= 99 GROUP BY 1, 2)
SELECT chrom, start - coalesce(x5.x, 0) AS start, stop + coalesce(x3.x, 0) AS "end", n_reads
FROM cl JOIN rd USING (chrom, cl) LEFT JOIN x5 USING (chrom, cl) LEFT JOIN x3 USING (chrom, cl)""",
)
def _read_clouds_by_strand(spark, d):
    a = materialize(cloud_alignments(_full(spark, d)))
    clouds, _ = find_clouds(a, 6, 200, 5000, strand_aware=True)
    return extend_by_clips(clouds, a, 100, 50).select("chrom", "start", "end", "n_reads")


def _window_sql(least_span: int) -> str:
    return f"""{FULL_LOCI}, {SEEDS}, pool AS (SELECT DISTINCT read_id FROM a JOIN seeds USING (chrom) WHERE s <= se AND e >= ss),
big AS (SELECT * FROM loci WHERE le - ls >= {least_span}),
wn AS (SELECT locus_id, chrom, 5 AS side, pos, pos AS ws, least(pos + 200, le) AS we
    FROM (SELECT *, unnest(generate_series(ls, le - 1, 100)) AS pos FROM big)
  UNION ALL SELECT locus_id, chrom, 3, pos, greatest(pos - 200, ls), pos
    FROM (SELECT *, unnest(generate_series(le - 1, ls, -100)) AS pos FROM big)),
ok AS (SELECT * FROM wn WHERE we - ws >= 100),
g AS (SELECT DISTINCT locus_id, side, pos, read_id FROM ok JOIN f USING (chrom) WHERE s <= we AND e >= ws),
k AS (SELECT locus_id, side, pos, count(*) AS n, count(pool.read_id) AS x FROM g LEFT JOIN pool USING (read_id) GROUP BY 1, 2, 3),
wj AS (SELECT locus_id, CAST(side AS BIGINT) AS side, pos, CASE WHEN coalesce(n, 0) = 0 THEN 0
  ELSE CAST(x AS DOUBLE) / (n + (SELECT count(*) FROM pool) - x) END AS j FROM ok LEFT JOIN k USING (locus_id, side, pos))"""


@query("window_jaccards", f"WITH {_window_sql(1000)} SELECT locus_id, side, pos, round(j, 6) AS jaccard FROM wj")
def _window_jaccards(spark, d):
    loci, _ = whole_loci(spark, d)
    a = tables.alignments(spark, d)
    ref = materialize(pooled_reads(a, as_regions(tables.seeds(spark, d)), bin_width=BW))
    p = Refine(window=200, step=100, min_region=500)
    j = window_jaccards(a, loci, ref, p, bin_width=BW)
    return j.select("locus_id", F.col("side").cast("bigint").alias("side"), "pos", F.round("jaccard", 6).alias("jaccard"))


@query(
    "jaccard_trim",
    f"""WITH {_window_sql(600)},
pv AS (SELECT *, lag(j) OVER (PARTITION BY locus_id, side ORDER BY CASE WHEN side = 5 THEN pos ELSE -pos END) AS prev FROM wj),
dr AS (SELECT * FROM pv WHERE j < 0.01 AND (CASE WHEN prev IS NULL THEN 1.0 ELSE greatest(prev, 0.01) END) > j * 1.5),
at5 AS (SELECT locus_id, min(pos) FILTER (side = 5) AS s5, max(pos) FILTER (side = 3) AS s3 FROM dr GROUP BY 1),
b AS (SELECT locus_id, ls, le, least(coalesce(s5, ls), ls + CAST(floor((le - ls) * 0.95) AS BIGINT)) AS ns,
  greatest(coalesce(s3, le), le - CAST(floor((le - ls) * 0.95) AS BIGINT)) AS ne FROM loci LEFT JOIN at5 USING (locus_id))
SELECT locus_id, CASE WHEN le - ls < 600 THEN ls WHEN ne - ns < 300 THEN (ls + le) // 2 - 150 ELSE ns END AS jac_start,
  CASE WHEN le - ls < 600 THEN le WHEN ne - ns < 300 THEN (ls + le) // 2 + 150 ELSE ne END AS jac_end FROM b""",
)
def _jaccard_trim(spark, d):
    loci, _ = kept_loci(spark, d)
    a = tables.alignments(spark, d)
    ref = materialize(pooled_reads(a, as_regions(tables.seeds(spark, d)), bin_width=BW))
    return jaccard_trim(a, loci, ref, Refine(window=200, step=100, min_region=300), bin_width=BW)


@query("refine_loci")
def _refine_loci(spark, d):
    loci, _ = kept_loci(spark, d)
    a = _full(spark, d)
    ref = materialize(pooled_reads(a, as_regions(tables.seeds(spark, d)), bin_width=BW))
    r = refine_loci(a, loci, ref, Refine(window=200, step=100, min_region=300), bin_width=BW)
    return r.select("locus_id", "start", "end", "method", "n_transcripts", F.round("jaccard", 6).alias("jaccard"))


@query(
    "exon_trim",
    f"""WITH RECURSIVE {FULL_LOCI},
h AS (SELECT f.read_id, s, e, line, q, loci.locus_id, ls, le FROM f JOIN (SELECT locus_id, chrom, ls, le FROM loci) loci USING (chrom)
  WHERE s <= le AND e >= ls AND kind = 0 AND EXISTS (SELECT 1 FROM members m WHERE m.locus_id = loci.locus_id AND m.read_id = f.read_id)),
bl AS (SELECT locus_id, ls, le, unnest(CASE WHEN line % 4 = 0 THEN [[s, s + 5 * q], [s + 7 * q, s + 12 * q], [s + 15 * q, s + 20 * q]]
  WHEN line % 2 = 0 THEN [[s, s + 8 * q], [s + 12 * q, s + 20 * q]] ELSE [[s, s + 20 * q]] END) AS x FROM h),
un AS (SELECT locus_id, min(greatest(x[1], ls)) AS us, max(least(x[2], le)) AS ue FROM bl WHERE least(x[2], le) > greatest(x[1], ls) GROUP BY 1),
md AS (SELECT locus_id, list_sort(list(s))[count(*) // 2 + 1] AS ms, list_sort(list(e))[count(*) // 2 + 1] AS me FROM h GROUP BY 1),
st0 AS (SELECT locus_id, read_id, ls, le, unnest(CASE WHEN line % 4 = 0 THEN [s + 7 * q, s + 15 * q] WHEN line % 2 = 0 THEN [s + 12 * q] ELSE [] END) AS pos FROM h),
site AS (SELECT locus_id, read_id, pos FROM st0 WHERE pos BETWEEN ls AND le),
{anchored("site", "locus_id", 12, True)},
sup AS (SELECT t.locus_id, CAST(sum(t.pos) // count(*) AS BIGINT) AS center FROM site t JOIN an ON an.locus_id = t.locus_id AND an.pos = t.pos
  GROUP BY t.locus_id, anchor HAVING count(DISTINCT read_id) >= 3),
cap AS (SELECT locus_id, min(center) AS cap FROM sup JOIN un USING (locus_id) JOIN (SELECT locus_id, le FROM loci) x USING (locus_id)
  WHERE center BETWEEN us - 2500 AND us + 1200 AND center <= le AND center >= 0 GROUP BY 1),
d AS (SELECT x.locus_id, ls, le, us, ue, ms, me, cap, greatest(1, CAST(ceil((le - ls) * 0.35::DOUBLE) AS BIGINT)) AS most
  FROM (SELECT locus_id, ls, le FROM loci) x LEFT JOIN un ON un.locus_id = x.locus_id LEFT JOIN md ON md.locus_id = x.locus_id LEFT JOIN cap ON cap.locus_id = x.locus_id),
d0 AS (SELECT *, ls + least(greatest(us - ls, 0), most) AS s0, le - least(greatest(le - ue, 0), most) AS e0 FROM d),
d1 AS (SELECT *, least(s0, ms + 100, cap) AS s1, greatest(e0, me - 100) AS e1, us IS NOT NULL AND e0 - s0 >= 200 AS usable FROM d0)
SELECT locus_id, CASE WHEN NOT usable THEN ls WHEN e1 - s1 >= 200 THEN s1 ELSE s0 END AS new_start,
  CASE WHEN NOT usable THEN le WHEN e1 - s1 >= 200 THEN e1 ELSE e0 END AS new_end FROM d1""",
)
def _exon_trim(spark, d):
    loci, members = kept_loci(spark, d)
    return exon_trim(_full(spark, d), loci, members, ExonTrim(min_span=200, read_end_slack=100), bin_width=BW)


@query("integrated_mode")
def _integrated_mode(spark, d):
    params = Integrated(bin_size=20, min_gap_bp=200, min_segment_bp=150, cluster_distance=100, min_reads=2, strand_min_span=2000)
    cores = detect_integrated(_full(spark, d), tables.seeds(spark, d), params, bin_width=BW)
    return cores.select("chrom", "start", "end", F.round("jaccard", 4).alias("jaccard"), "confidence", "valleys", "splits", "isoseq_validated")
