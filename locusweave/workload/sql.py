"""Common table expressions shared by the checking SQL."""

ALN = """a AS (
  SELECT l_orderkey AS read_id, 'chr' || CAST(l_suppkey % 5 AS VARCHAR) AS chrom,
         l_partkey * 1000 + l_orderkey % 97 AS s,
         l_partkey * 1000 + l_orderkey % 97 + CAST(l_quantity AS BIGINT) * 20 AS e,
         l_linenumber AS line,
         (CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END)
         + (CASE WHEN l_linenumber % 3 = 2 THEN 256 ELSE 0 END)
         + (CASE WHEN l_linenumber % 7 = 0 THEN 2048 ELSE 0 END) AS flag
  FROM lineitem)"""

SEEDS = """seeds AS (
  SELECT CAST(n_nationkey AS BIGINT) AS seed_ord, 'chr' || CAST(n_nationkey % 5 AS VARCHAR) AS chrom,
         CAST((n_nationkey * 7 + 3) * 1000 AS BIGINT) AS ss,
         CAST((n_nationkey * 7 + 3) * 1000 + 10000 AS BIGINT) AS se, n_name AS name
  FROM nation)"""

GENES = """genes AS (
  SELECT p_partkey AS gene_id, p_brand AS family_id, p_name AS gene_name,
         'chr' || CAST(p_size % 5 AS VARCHAR) AS chrom, p_partkey * 1000 AS gs,
         CAST(p_partkey * 1000 + 400 + p_size * 10 AS BIGINT) AS ge
  FROM part)"""


def clusters(src: str, gap: int, name: str = "c", keys: str = "chrom", order: str = "s, read_id, line") -> str:
    """Rows of ``src`` with their cluster number ``cl`` within ``keys``."""
    return f"""{name}_w AS (
  SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
  FROM {src}),
{name} AS (
  SELECT *, CAST(sum(CASE WHEN pe IS NULL OR s - pe > {gap} THEN 1 ELSE 0 END)
    OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cl
  FROM {name}_w)"""


LOCI = (
    clusters("a", 100)
    + """,
loci AS (
  SELECT chrom, cl, min(s) AS ls, max(e) AS le, count(*) AS n,
         chrom || ':' || CAST(min(s) AS VARCHAR) || '-' || CAST(max(e) AS VARCHAR) AS locus_id
  FROM c GROUP BY chrom, cl HAVING count(*) >= 5),
members AS (
  SELECT DISTINCT locus_id, read_id FROM c JOIN loci USING (chrom, cl)),
sizes AS (SELECT locus_id, count(*) AS nr FROM members GROUP BY locus_id)"""
)

EDGES = """pairs AS (
  SELECT x.locus_id AS a, y.locus_id AS b, count(*) AS shared
  FROM members x JOIN members y ON x.read_id = y.read_id AND x.locus_id < y.locus_id GROUP BY 1, 2),
edges AS (
  SELECT a AS src, b AS dst, shared, CAST(shared AS DOUBLE) / (sa.nr + sb.nr - shared) AS j
  FROM pairs JOIN sizes sa ON sa.locus_id = a JOIN sizes sb ON sb.locus_id = b
  WHERE CAST(shared AS DOUBLE) / (sa.nr + sb.nr - shared) >= 0.05)"""


def anchored(src: str, keys: str, width: int, inclusive: bool, name: str = "an") -> str:
    """``{name}`` (keys, pos, anchor): clusters of the distinct positions of ``src``, reaching ``width`` from their first one.

    Positions further than ``width`` from the one before always begin a cluster, so the recursion runs in those islands.
    """
    on = " AND ".join(f"i.{k.strip()} = a.{k.strip()}" for k in (*keys.split(","), "isl"))
    cols = lambda t: ", ".join(f"{t}.{k.strip()}" for k in (*keys.split(","), "isl"))
    beyond = ">" if inclusive else ">="
    return f"""{name}_p AS (SELECT DISTINCT {keys}, pos FROM {src}),
{name}_g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY {keys} ORDER BY pos) AS gap FROM {name}_p),
{name}_i AS MATERIALIZED (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {width} THEN 1 ELSE 0 END)
  OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_g),
{name}_a AS (SELECT {keys}, isl, min(pos) AS anchor FROM {name}_i GROUP BY ALL
  UNION ALL SELECT {cols("i")}, min(i.pos) FROM {name}_a a JOIN {name}_i i ON {on} AND i.pos - a.anchor {beyond} {width} GROUP BY {cols("i")}),
{name} AS (SELECT {cols("i")}, i.pos, max(a.anchor) AS anchor FROM {name}_i i JOIN {name}_a a ON {on} AND a.anchor <= i.pos GROUP BY ALL)"""


def kept_larger(src: str, order: str, name: str = "kl") -> str:
    """``{name}`` (id): rows of ``src`` (id, chrom, ls, le, ...) that stay when a longer one replaces the first kept one it overlaps."""
    return f"""{name}_w AS (SELECT *, max(le) OVER (PARTITION BY chrom ORDER BY ls, le, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {src}),
{name}_i AS (SELECT *, sum(CASE WHEN pe IS NULL OR ls >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY ls, le, id ROWS UNBOUNDED PRECEDING) AS isl
  FROM {name}_w),
{name}_o AS MATERIALIZED (SELECT chrom, isl, row_number() OVER (PARTITION BY chrom, isl ORDER BY {order}) AS rn,
  {{'id': id, 's': ls, 'e': le}} AS r FROM {name}_i),
{name}_r AS (SELECT chrom, isl, rn, [r] AS kept FROM {name}_o WHERE rn = 1
  UNION ALL SELECT o.chrom, o.isl, o.rn, CASE
    WHEN len(list_filter(f.kept, lambda k: k.s < o.r.e AND o.r.s < k.e)) = 0 THEN list_append(f.kept, o.r)
    WHEN o.r.e - o.r.s > list_filter(f.kept, lambda k: k.s < o.r.e AND o.r.s < k.e)[1].e - list_filter(f.kept, lambda k: k.s < o.r.e AND o.r.s < k.e)[1].s
      THEN list_append(list_filter(f.kept, lambda k: k.id <> list_filter(f.kept, lambda j: j.s < o.r.e AND o.r.s < j.e)[1].id), o.r)
    ELSE f.kept END
  FROM {name}_r f JOIN {name}_o o ON o.chrom = f.chrom AND o.isl = f.isl AND o.rn = f.rn + 1),
{name} AS (SELECT unnest(arg_max(kept, rn)).id AS id FROM {name}_r GROUP BY chrom, isl)"""
