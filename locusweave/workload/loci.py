"""Clustering, set similarity, graph traversal and the seeded pipelines."""

from pyspark.sql import functions as F

from locusweave.config import Detect, Fast
from locusweave.functions.intervals import usable
from locusweave.functions.statistics import hypergeometric_upper_tail
from locusweave.operators.cluster import adaptive_gaps, cluster_alignments, cluster_by_distinct_reads
from locusweave.operators.filters import core_filter, mark_seed_loci, min_seeds_filter, seed_support
from locusweave.operators.graph import (
    adaptive_edge_threshold,
    component_representatives,
    connected_components,
    hop_distances,
)
from locusweave.operators.readsets import jaccard_edges, jaccard_to_reference, seed_reads, set_sizes
from locusweave.plans import detect as plan
from locusweave.plans.fast import fast_detect
from locusweave.plans.seeds import connectivity_edges, core_reads, select_connected_seeds
from locusweave.session import materialize
from locusweave.sources import tables
from locusweave.workload import query
from locusweave.workload.base import big, kept_loci, whole_loci
from locusweave.workload.sql import ALN, EDGES, LOCI, SEEDS, clusters, kept_larger

SMALL = Detect(min_reads=2, bin_width=1024)


@query("cluster_loci", f'WITH {ALN}, {LOCI} SELECT chrom, ls AS start, le AS "end", n AS n_rows FROM loci')
def _cluster_loci(spark, d):
    return cluster_alignments(tables.alignments(spark, d), 100, 5)


@query(
    "cluster_loci_distinct",
    f"""WITH {ALN}, {clusters('a', 100)}
SELECT chrom, min(s) AS start, max(e) AS "end", count(DISTINCT read_id) AS n_reads FROM c
GROUP BY chrom, cl HAVING count(DISTINCT read_id) >= 5 AND max(e) - min(s) BETWEEN 500 AND 3000""",
)
def _cluster_loci_distinct(spark, d):
    loci, _ = cluster_by_distinct_reads(tables.alignments(spark, d), 100, 5, 500, 3000)
    return loci.select("chrom", "start", "end", "n_reads")


ADAPTIVE = f"""{ALN},
g0 AS (SELECT chrom, s - lag(e) OVER (PARTITION BY chrom, read_id ORDER BY s, e) AS g FROM a),
g AS (SELECT chrom, g, row_number() OVER (PARTITION BY chrom ORDER BY g) AS rn,
        count(*) OVER (PARTITION BY chrom) AS n FROM g0 WHERE g > 0),
gap AS (SELECT chrom, CASE WHEN n >= 3 THEN greatest(least(g, 60000), 500) ELSE 60000 END AS gap FROM g
        WHERE rn = CAST(floor((n - 1) * 0.9 + 0.5) AS BIGINT) + 1)"""


@query("adaptive_gap", f"WITH {ADAPTIVE} SELECT chrom, gap FROM gap")
def _adaptive_gap(spark, d):
    return adaptive_gaps(tables.alignments(spark, d), 60_000)


@query("read_set_sizes", f"WITH {ALN}, {LOCI} SELECT locus_id, nr AS n_reads FROM sizes")
def _read_set_sizes(spark, d):
    _, members = whole_loci(spark, d)
    return set_sizes(members)


@query(
    "locus_jaccard_edges",
    f"WITH {ALN}, {LOCI}, {EDGES} SELECT src, dst, shared, round(j, 6) AS jaccard FROM edges",
)
def _locus_jaccard_edges(spark, d):
    _, members = kept_loci(spark, d)
    return jaccard_edges(members, 0.05).select("src", "dst", "shared", F.round("jaccard", 6).alias("jaccard"))


COMPONENTS = f"""{ALN}, {LOCI}, {EDGES},
bidir AS (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges),
lab AS (SELECT DISTINCT u AS node, u AS label FROM bidir
  UNION SELECT b.v, l.label FROM lab l JOIN bidir b ON b.u = l.node WHERE l.label < b.v),
comp AS (SELECT node, min(label) AS component FROM lab GROUP BY node)"""


@query("component_labels", f"WITH RECURSIVE {COMPONENTS} SELECT node, component FROM comp")
def _component_labels(spark, d):
    _, members = kept_loci(spark, d)
    return connected_components(jaccard_edges(members, 0.05))


@query(
    "component_representatives",
    f"""WITH RECURSIVE {COMPONENTS},
r AS (SELECT component, locus_id, nr,
  row_number() OVER (PARTITION BY component ORDER BY nr DESC, locus_id DESC) AS rn,
  count(*) OVER (PARTITION BY component) AS k, sum(nr) OVER (PARTITION BY component) AS t
  FROM comp JOIN sizes ON sizes.locus_id = comp.node)
SELECT component, locus_id, nr AS n_reads, k AS component_size, CAST(t AS BIGINT) AS total_reads FROM r WHERE rn = 1""",
)
def _component_representatives(spark, d):
    loci, members = kept_loci(spark, d)
    labels = connected_components(jaccard_edges(members, 0.05))
    sized = loci.join(set_sizes(members), "locus_id")
    return component_representatives(labels, sized).select(
        "component", "locus_id", "n_reads", "component_size", "total_reads"
    )


@query(
    "hop_distance",
    f"""WITH RECURSIVE {ALN}, {LOCI}, {EDGES},
bidir AS (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges),
bfs AS (SELECT min(src) AS node, 0 AS dist FROM edges
  UNION SELECT b.v, bfs.dist + 1 FROM bfs JOIN bidir b ON b.u = bfs.node WHERE bfs.dist < 20)
SELECT node, CAST(min(dist) AS BIGINT) AS distance FROM bfs GROUP BY node""",
)
def _hop_distance(spark, d):
    _, members = kept_loci(spark, d)
    edges = materialize(jaccard_edges(members, 0.05))
    source = edges.agg(F.min("src").alias("node"))
    return hop_distances(edges, source).select("node", big("distance"))


#: Per-seed candidates, read sets, similarity graph and distances.
SEED_GRAPH = f"""{ALN}, {SEEDS},
pool0 AS (SELECT DISTINCT read_id FROM a JOIN seeds USING (chrom) WHERE s <= se AND e >= ss),
p AS (SELECT * FROM a SEMI JOIN pool0 USING (read_id)),
own AS (SELECT DISTINCT seed_ord, read_id FROM p JOIN seeds USING (chrom) WHERE s < se AND e > ss),
sa AS (SELECT seed_ord, p.* FROM p JOIN own USING (read_id)),
{clusters('sa', 10000, 'k', 'seed_ord, chrom')},
cand0 AS (SELECT seed_ord, chrom, min(s) AS ls, max(e) AS le FROM k GROUP BY seed_ord, chrom, cl HAVING count(*) >= 2),
snode AS (SELECT seed_ord, min(ls) AS nls FROM cand0 JOIN seeds USING (seed_ord, chrom)
          WHERE ls <= se AND le >= ss GROUP BY seed_ord),
cand AS (SELECT seed_ord, chrom, ls, le FROM cand0 UNION ALL
  SELECT seed_ord, chrom, ss, se FROM seeds
  WHERE seed_ord NOT IN (SELECT seed_ord FROM snode) AND seed_ord IN (SELECT seed_ord FROM cand0)),
l AS (SELECT *, chrom || ':' || CAST(ls AS VARCHAR) || '-' || CAST(le AS VARCHAR) AS locus_id FROM cand),
m AS (SELECT DISTINCT seed_ord, locus_id, read_id FROM p JOIN l USING (chrom) WHERE s < le AND e > ls),
sz AS (SELECT seed_ord, locus_id, count(*) AS nr FROM m GROUP BY ALL),
pr AS (SELECT x.seed_ord, x.locus_id AS u, y.locus_id AS v, count(*) AS sh FROM m x JOIN m y
  ON x.seed_ord = y.seed_ord AND x.read_id = y.read_id AND x.locus_id <> y.locus_id GROUP BY ALL),
ed AS (SELECT pr.seed_ord, u, v FROM pr JOIN sz q1 ON q1.seed_ord = pr.seed_ord AND q1.locus_id = u
  JOIN sz q2 ON q2.seed_ord = pr.seed_ord AND q2.locus_id = v
  WHERE CAST(sh AS DOUBLE) / (q1.nr + q2.nr - sh) >= 0.001),
start AS (SELECT l.seed_ord, locus_id AS node FROM l JOIN seeds USING (seed_ord, chrom)
  LEFT JOIN snode USING (seed_ord) WHERE (nls IS NOT NULL AND ls = nls) OR (nls IS NULL AND ls = ss AND le = se)),
bfs AS (SELECT seed_ord, node, 0 AS dist FROM start
  UNION SELECT bfs.seed_ord, v, dist + 1 FROM bfs JOIN ed ON ed.seed_ord = bfs.seed_ord AND u = node WHERE dist < 6),
hops AS (SELECT seed_ord, node AS locus_id, min(dist) AS distance FROM bfs GROUP BY ALL),
own_n AS (SELECT seed_ord, count(*) AS n_ref FROM own GROUP BY ALL),
sim AS (SELECT m.seed_ord, locus_id, count(*) AS nr, count(own.read_id) AS sh
  FROM m LEFT JOIN own ON own.seed_ord = m.seed_ord AND own.read_id = m.read_id GROUP BY ALL)"""


@query(
    "seed_loci",
    f"""WITH RECURSIVE {SEED_GRAPH}
SELECT seed_ord, chrom, ls AS start, le AS "end", nr AS n_reads, sh AS shared,
  round(CAST(sh AS DOUBLE) / (nr + n_ref - sh), 6) AS jaccard, CAST(distance AS BIGINT) AS distance
FROM l JOIN hops USING (seed_ord, locus_id) JOIN sim USING (seed_ord, locus_id) JOIN own_n USING (seed_ord)""",
)
def _seed_loci(spark, d):
    seeds = tables.seeds(spark, d)
    pool = materialize(plan.seed_pool(tables.alignments(spark, d), seeds, SMALL))
    loci = plan.reachable_loci(plan.seed_graph(pool, seeds, SMALL))
    return loci.select(
        "seed_ord", "chrom", "start", "end", "n_reads", "shared", F.round("jaccard", 6).alias("jaccard"), big("distance")
    )


@query(
    "detect_multi_seed",
    f"""WITH RECURSIVE {SEED_GRAPH},
rch AS (SELECT row_number() OVER (ORDER BY seed_ord, locus_id) AS id, seed_ord, chrom, ls, le, nr, sh, n_ref, distance
  FROM l JOIN hops USING (seed_ord, locus_id) LEFT JOIN sim USING (seed_ord, locus_id) JOIN own_n USING (seed_ord)),
{kept_larger("rch", "seed_ord, distance, ls")}
SELECT chrom, ls AS start, le AS "end", round(coalesce(CAST(sh AS DOUBLE) / (nr + n_ref - sh), 0), 4) AS jaccard,
  CAST(distance AS BIGINT) AS distance, CAST(distance + 1 AS BIGINT) AS component, coalesce(nr, 0) AS n_reads
FROM rch JOIN kl USING (id)""",
)
def _detect_multi_seed(spark, d):
    loci, _ = plan.detect_multi_seed(tables.alignments(spark, d), tables.seeds(spark, d), SMALL)
    return loci.select(
        "chrom", "start", "end", F.round("jaccard", 4).alias("jaccard"), big("distance"), big("component"), "n_reads"
    )


@query(
    "component_seed_candidates",
    f"""WITH RECURSIVE {SEED_GRAPH.replace(">= 0.001", ">= 0.2")},
lab AS (SELECT seed_ord, locus_id AS node, locus_id AS label FROM l
  UNION SELECT lab.seed_ord, v, label FROM lab JOIN ed ON ed.seed_ord = lab.seed_ord AND u = node WHERE label < v),
comp AS (SELECT seed_ord, node, min(label) AS component FROM lab GROUP BY ALL),
mine AS (SELECT comp.seed_ord, component FROM comp JOIN start ON start.seed_ord = comp.seed_ord AND start.node = comp.node),
z AS (SELECT comp.seed_ord, component, chrom, ls, le, coalesce(nr, 0) AS nr, count(*) OVER w AS size,
    CAST(sum(coalesce(nr, 0)) OVER w AS BIGINT) AS total,
    row_number() OVER (PARTITION BY comp.seed_ord, component ORDER BY coalesce(nr, 0) DESC, ls) AS rn
  FROM comp JOIN l ON l.seed_ord = comp.seed_ord AND l.locus_id = node
  LEFT JOIN sz ON sz.seed_ord = comp.seed_ord AND sz.locus_id = node
  WHERE NOT EXISTS (SELECT 1 FROM mine WHERE mine.seed_ord = comp.seed_ord AND mine.component = comp.component)
  WINDOW w AS (PARTITION BY comp.seed_ord, component))
SELECT seed_ord, chrom, ls AS start, le AS "end", nr AS n_reads, size AS component_size, total AS total_reads FROM z WHERE rn = 1""",
)
def _component_seed_candidates(spark, d):
    params = Detect(min_reads=2, min_jaccard=0.2, bin_width=1024)
    seeds = tables.seeds(spark, d)
    pool = materialize(plan.seed_pool(tables.alignments(spark, d), seeds, params))
    return plan.component_candidates(plan.seed_graph(pool, seeds, params)).select(
        "seed_ord", "chrom", "start", "end", "n_reads", "component_size", "total_reads"
    )


SR = """sr AS (SELECT DISTINCT seed_ord, read_id FROM a JOIN seeds USING (chrom)
       WHERE s <= se AND e >= ss AND flag & 2048 = 0)"""


@query(
    "min_seed_support",
    f"""WITH {ALN}, {LOCI}, {SEEDS}, {SR}
SELECT locus_id, count(DISTINCT seed_ord) AS n_seeds FROM members JOIN sr USING (read_id) GROUP BY locus_id""",
)
def _min_seed_support(spark, d):
    _, members = whole_loci(spark, d)
    sr = seed_reads(tables.alignments(spark, d), tables.seeds(spark, d), bin_width=1024)
    return seed_support(members, sr)


@query(
    "min_seeds_filter",
    f"""WITH {ALN}, {LOCI}, {SEEDS}, {SR},
sup AS (SELECT locus_id, count(DISTINCT seed_ord) AS k FROM members JOIN sr USING (read_id) GROUP BY locus_id)
SELECT locus_id FROM loci LEFT JOIN sup USING (locus_id)
WHERE coalesce(k, 0) >= 3 OR EXISTS (SELECT 1 FROM seeds x WHERE x.chrom = loci.chrom AND ls < se AND le > ss)""",
)
def _min_seeds_filter(spark, d):
    loci, members = whole_loci(spark, d)
    seeds = tables.seeds(spark, d)
    sr = seed_reads(tables.alignments(spark, d), seeds, bin_width=1024)
    return min_seeds_filter(mark_seed_loci(loci, seeds), members, sr, 3).select("locus_id")


#: One wide seed per region row; reads with alignments in all of them are the core.
WIDE_CORE = f"""{ALN}, wide AS (SELECT CAST(r_regionkey AS BIGINT) AS seed_ord, 'chr' || CAST(r_regionkey AS VARCHAR) AS chrom, 0 AS ss, 1000000 AS se FROM region),
wr AS (SELECT DISTINCT seed_ord, read_id FROM a JOIN wide USING (chrom) WHERE s <= se AND e >= ss AND flag & 2048 = 0),
lk AS (SELECT DISTINCT x.seed_ord AS u, y.seed_ord AS v FROM wr x JOIN wr y USING (read_id)),
lab AS (SELECT DISTINCT u AS node, u AS label FROM lk UNION SELECT lk.v, label FROM lab JOIN lk ON lk.u = node WHERE label < lk.v),
cmp AS (SELECT node AS seed_ord, min(label) AS component FROM lab GROUP BY 1),
csz AS (SELECT component, count(*) AS k FROM cmp GROUP BY 1),
core AS (SELECT component, read_id FROM wr JOIN cmp USING (seed_ord) JOIN csz USING (component) GROUP BY component, read_id, k HAVING count(*) = k)"""


def _wide_seeds(spark, d):
    return tables.regions(spark, d).select(
        F.col("r_regionkey").cast("bigint").alias("seed_ord"), F.concat(F.lit("chr"), F.col("r_regionkey").cast("string")).alias("chrom"),
        F.lit(0).cast("bigint").alias("start"), F.lit(1_000_000).cast("bigint").alias("end"),
    )


@query("core_reads_of_wide_seeds", f"WITH RECURSIVE {WIDE_CORE} SELECT component, read_id FROM core")
def _core_reads_of_wide_seeds(spark, d):
    sr = materialize(seed_reads(tables.alignments(spark, d), _wide_seeds(spark, d), bin_width=1024))
    return core_reads(sr)


@query(
    "core_read_filter",
    f"""WITH RECURSIVE {WIDE_CORE}, {LOCI}, {SEEDS},
oc AS (SELECT DISTINCT locus_id FROM (SELECT locus_id FROM members JOIN core USING (read_id) GROUP BY locus_id, component HAVING count(*) >= 1))
SELECT locus_id FROM loci WHERE EXISTS (SELECT 1 FROM seeds WHERE seeds.chrom = loci.chrom AND ls < se AND le > ss)
  OR locus_id IN (SELECT locus_id FROM oc) OR NOT EXISTS (SELECT 1 FROM core)""",
)
def _core_read_filter(spark, d):
    loci, members = kept_loci(spark, d)
    sr = materialize(seed_reads(tables.alignments(spark, d), _wide_seeds(spark, d), bin_width=1024))
    return core_filter(mark_seed_loci(loci, tables.seeds(spark, d)), members, core_reads(sr), 1).select("locus_id")


@query(
    "jaccard_to_pool",
    f"""WITH {ALN}, {LOCI}, {SEEDS}, pool AS (SELECT DISTINCT read_id FROM a JOIN seeds USING (chrom)
  WHERE s <= se AND e >= ss AND flag & 2048 = 0),
x AS (SELECT locus_id, count(*) AS nr, count(pool.read_id) AS sh FROM members LEFT JOIN pool USING (read_id) GROUP BY 1)
SELECT locus_id, sh AS shared, round(CAST(sh AS DOUBLE) / (nr + (SELECT count(*) FROM pool) - sh), 6) AS jaccard FROM x""",
)
def _jaccard_to_pool(spark, d):
    _, members = whole_loci(spark, d)
    sr = seed_reads(tables.alignments(spark, d), tables.seeds(spark, d), bin_width=1024)
    return jaccard_to_reference(members, sr).select("locus_id", "shared", F.round("jaccard", 6).alias("jaccard"))


HYPER = f"""{ALN}, {SEEDS},
sr AS (SELECT DISTINCT seed_ord, read_id FROM a JOIN seeds USING (chrom) WHERE s <= se AND e >= ss),
n AS (SELECT seed_ord, count(*) AS k FROM sr GROUP BY 1),
u AS (SELECT count(DISTINCT read_id) AS big_n FROM sr),
p AS (SELECT x.seed_ord AS src, y.seed_ord AS dst, count(*) AS shared FROM sr x JOIN sr y
  ON x.read_id = y.read_id AND x.seed_ord < y.seed_ord GROUP BY 1, 2),
t AS (SELECT src, dst, shared, na.k AS a1, nb.k AS b1, big_n,
   unnest(generate_series(shared, least(na.k, nb.k))) AS i
  FROM p JOIN n na ON na.seed_ord = src JOIN n nb ON nb.seed_ord = dst, u),
lt AS (SELECT *, (lgamma(b1 + 1) - lgamma(i + 1) - lgamma(b1 - i + 1))
  + (lgamma(big_n - b1 + 1) - lgamma(a1 - i + 1) - lgamma(big_n - b1 - a1 + i + 1))
  - (lgamma(big_n + 1) - lgamma(a1 + 1) - lgamma(big_n - a1 + 1)) AS lp FROM t WHERE big_n - b1 >= a1 - i),
pv AS (SELECT src, dst, shared, CAST(shared AS DOUBLE) / (max(a1) + max(b1) - shared) AS j,
  least(1.0, sum(CASE WHEN lp > -745 THEN exp(lp) ELSE 0 END)) AS p FROM lt GROUP BY src, dst, shared)"""


@query("seed_hypergeom", f"WITH {HYPER} SELECT src, dst, shared, round(p, 6) AS p_value FROM pv")
def _seed_hypergeom(spark, d):
    sr = seed_reads(tables.alignments(spark, d), tables.seeds(spark, d), include_supplementary=True, bin_width=1024)
    pairs = connectivity_edges(sr)
    return hypergeometric_upper_tail(pairs, "shared", "nb", "na", "n_universe").select(
        "src", "dst", "shared", F.round("p_value", 6).alias("p_value")
    )


@query(
    "adaptive_edge_threshold",
    f"""WITH {ALN}, {LOCI}, {EDGES},
v AS (SELECT j, row_number() OVER (ORDER BY j) AS rn, count(*) OVER () AS n FROM edges WHERE shared >= 2)
SELECT round(greatest(0.001, coalesce(max(j), 0.001)), 6) AS threshold FROM v
WHERE n >= 3 AND rn = CAST(floor((n - 1) * 0.15 + 0.5) AS BIGINT) + 1""",
)
def _adaptive_edge_threshold(spark, d):
    _, members = kept_loci(spark, d)
    t = adaptive_edge_threshold(jaccard_edges(members, 0.05), 0.15, 2, 0.001)
    return t.select(F.round("threshold", 6).alias("threshold"))


@query(
    "connectivity_seeds",
    f"""WITH RECURSIVE {HYPER},
rk AS (SELECT j, row_number() OVER (ORDER BY j) AS rn, count(*) OVER () AS c FROM pv WHERE shared >= 1 AND j > 0),
cut AS (SELECT greatest(0.001, coalesce(max(j), 0.001)) AS th FROM rk WHERE c >= 3 AND rn = CAST(floor((c - 1) * 0.15 + 0.5) AS BIGINT) + 1),
ok AS (SELECT src, dst FROM pv, cut WHERE shared >= 1 AND j >= th AND p <= 0.5),
bidir AS (SELECT src AS x, dst AS y FROM ok UNION ALL SELECT dst, src FROM ok),
lab AS (SELECT seed_ord AS node, seed_ord AS label FROM seeds
  UNION SELECT y, label FROM lab JOIN bidir ON x = node WHERE label < y),
comp AS (SELECT node, min(label) AS component FROM lab GROUP BY 1),
z AS (SELECT component, node, coalesce(k, 0) AS k, count(*) OVER (PARTITION BY component) AS size,
  row_number() OVER (PARTITION BY component ORDER BY coalesce(k, 0) DESC, node DESC) AS rn FROM comp LEFT JOIN n ON n.seed_ord = node)
SELECT node AS seed_ord, component, size AS component_size, k AS n_reads FROM z WHERE rn = 1""",
)
def _connectivity_seeds(spark, d):
    a, seeds = tables.alignments(spark, d), tables.seeds(spark, d)
    chosen = select_connected_seeds(a, seeds, min_jaccard=0.001, quantile=0.15, min_shared=1, p_max=0.5, bin_width=1024)
    return chosen.select("seed_ord", "component", "component_size", "n_reads")


@query(
    "connectivity_seeds_strict",
    f"""WITH RECURSIVE {HYPER},
rk AS (SELECT j, row_number() OVER (ORDER BY j) AS rn, count(*) OVER () AS c FROM pv WHERE shared >= 1 AND j > 0),
cut AS (SELECT greatest(0.001, coalesce(max(j), 0.001)) AS th FROM rk WHERE c >= 3 AND rn = CAST(floor((c - 1) * 0.9 + 0.5) AS BIGINT) + 1),
ok AS (SELECT src, dst FROM pv, cut WHERE shared >= 1 AND j >= th AND p <= 1.0),
bidir AS (SELECT src AS x, dst AS y FROM ok UNION ALL SELECT dst, src FROM ok),
lab AS (SELECT seed_ord AS node, seed_ord AS label FROM seeds
  UNION SELECT y, label FROM lab JOIN bidir ON x = node WHERE label < y),
comp AS (SELECT node, min(label) AS component FROM lab GROUP BY 1),
z AS (SELECT component, node, coalesce(k, 0) AS k, count(*) OVER (PARTITION BY component) AS size,
  row_number() OVER (PARTITION BY component ORDER BY coalesce(k, 0) DESC, node DESC) AS rn FROM comp LEFT JOIN n ON n.seed_ord = node)
SELECT node AS seed_ord, component, size AS component_size, k AS n_reads FROM z WHERE rn = 1""",
)
def _connectivity_seeds_strict(spark, d):
    a, seeds = tables.alignments(spark, d), tables.seeds(spark, d)
    chosen = select_connected_seeds(a, seeds, min_jaccard=0.001, quantile=0.9, min_shared=1, p_max=1.0, bin_width=1024)
    return chosen.select("seed_ord", "component", "component_size", "n_reads")


@query("fast_detect")
def _fast_detect(spark, d):
    params = Fast(min_size=300, cluster_distance=100)
    a = tables.alignments(spark, d).where(usable())
    loci, _ = fast_detect(a, tables.seeds(spark, d), params)
    return loci.select("chrom", "start", "end", "n_reads")
