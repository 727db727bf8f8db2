"""URL filters as a temporal list join: dated list edits become validity intervals, captures meet those active at fetch time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.session import materialize

TILE = 30 * 86_400
FOREVER = 1 << 62


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and final dot; '' if the text is no absolute URL."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(found, r"\.$", "")


def path_parts(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def entry_keys(url: Column) -> Column:
    """All entries that could list a URL: its host, every parent domain, and host plus every leading path."""
    host, labels, parts = host_of(url), F.split(host_of(url), r"\."), path_parts(url)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    counted = F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0)
    paths = F.transform(counted, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def tile_of(at: Column, tile: int) -> Column:
    return F.floor(at / F.lit(tile)).cast("bigint")


def validity(edits: DataFrame, tile: int = TILE) -> DataFrame:
    """(list_id, entry, since, until) from edits (list_id, entry, action ``add`` or ``remove``, at).

    An entry is active from an ``add`` to the next edit.  Of edits at one time the ``remove`` counts.  Edits
    meet their next one inside a time tile, and tiles hand on their first time, so no window holds all
    edits of a much-edited entry.
    """
    clean = (
        edits.where(F.col("entry").isNotNull() & F.col("at").isNotNull() & F.col("list_id").isNotNull())
        .groupBy("list_id", "entry", F.col("at").cast("bigint").alias("at"))
        .agg(F.max("action").alias("action"))
        .withColumn("tile", tile_of(F.col("at"), tile))
    )
    of_entry = Window.partitionBy("list_id", "entry").orderBy("tile")
    heads = clean.groupBy("list_id", "entry", "tile").agg(F.min("at").alias("first")).select(
        "list_id", "entry", "tile", F.lead("first").over(of_entry).alias("after")
    )
    in_tile = Window.partitionBy("list_id", "entry", "tile").orderBy("at")
    return (
        clean.withColumn("next", F.lead("at").over(in_tile))
        .join(heads, ["list_id", "entry", "tile"])
        .where("action = 'add'")
        .select("list_id", "entry", F.col("at").alias("since"), F.coalesce("next", "after", F.lit(FOREVER)).alias("until"))
    )


def active_entries(captures: DataFrame, intervals: DataFrame, tile: int = TILE) -> DataFrame:
    """(url, at, list_id, entry): the as-of join of distinct captures with the entries active then.

    Both sides are keyed by entry and time tile, so a host that holds most captures is spread over the tiles and
    split further by the adaptive skew join.  An interval is stored once per tile it touches up to the last capture.
    """
    seen = captures.select("url", "at").where(F.col("url").isNotNull() & F.col("at").isNotNull()).distinct()
    span = seen.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    keyed = seen.select("url", "at", tile_of(F.col("at"), tile).alias("tile"), F.explode(F.array_distinct(entry_keys(F.col("url")))).alias("entry"))
    clipped = intervals.join(F.broadcast(span)).where("since <= hi AND until > lo").select(
        "list_id", "entry", "since", "until",
        F.explode(F.sequence(tile_of(F.greatest("since", "lo"), tile), tile_of(F.least("until", "hi"), tile))).alias("tile"),
    )
    return (
        keyed.join(clipped, ["entry", "tile"]).where("since <= at AND at < until")
        .select("url", "at", "list_id", "entry")
    )


def url_verdicts(captures: DataFrame, edits: DataFrame, block: str = "block", allow: str = "allow", tile: int = TILE) -> DataFrame:
    """One row per capture (page_id, url, at): page_id, at, n_block, n_allow, block_entry, blocked.

    n_block and n_allow count the active entries of the two lists that cover the URL; block_entry is the longest
    active entry of the block list (ties: the first in order).  A capture is blocked if an entry blocks it and no
    longer or equally long entry allows it.  Captures without url or time, or whose url has no host, meet no
    entry and are not blocked.  Repeated captures give repeated rows; other columns are ignored.
    """
    source = captures.select("page_id", F.col("url").cast("string").alias("url"), F.col("at").cast("bigint").alias("at"))
    best = lambda which: F.min(F.when(F.col("list_id") == which, F.struct(-F.length("entry"), F.col("entry").alias("entry"))))
    met = materialize(
        active_entries(source, validity(edits, tile), tile).groupBy("url", "at").agg(
            F.count_if(F.col("list_id") == block).alias("n_block"), F.count_if(F.col("list_id") == allow).alias("n_allow"),
            best(block)["entry"].alias("block_entry"), best(allow)["entry"].alias("allow_entry"),
        )
    )
    blocked = F.col("block_entry").isNotNull() & (
        F.col("allow_entry").isNull() | (F.length("block_entry") > F.length("allow_entry"))
    )
    return source.join(met, ["url", "at"], "left").select(
        "page_id", "at", F.coalesce("n_block", F.lit(0)).alias("n_block"), F.coalesce("n_allow", F.lit(0)).alias("n_allow"),
        "block_entry", blocked.alias("blocked"),
    )


DAY, START = 86_400, 1_704_067_200


def digest_number(text: Column, first: int) -> Column:
    """Eight hex digits of the MD5 digest as a number; DuckDB can compute the same."""
    return F.conv(F.substring(F.md5(text), first, 8), 16, 10).cast("bigint")


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of the ``pages`` table, which has no fetch times: they are derived from page_id."""
    at = F.lit(START) + digest_number(F.col("page_id").cast("string"), 1) % (365 * DAY)
    return pages.select("page_id", "url", at.alias("at"))


def edits_of(pages: DataFrame) -> DataFrame:
    """Dated edits for every host and every first path of the ``pages`` table.

    Hosts are blocked on some day, unblocked 1 to 120 days later and blocked for good 200 days after the first
    time; first paths are allowed for 1 to 30 days.
    """
    hosts = pages.select(host_of(F.col("url")).alias("entry")).where("entry != ''").distinct()
    parts = path_parts(F.col("url"))
    paths = pages.where(F.size(parts) > 0).select(
        F.concat(host_of(F.col("url")), F.lit("/"), F.element_at(parts, 1)).alias("entry")
    ).where("entry NOT LIKE '/%'").distinct()
    day = F.lit(START) + digest_number(F.col("entry"), 1) % 365 * DAY
    length = digest_number(F.col("entry"), 9)
    edit = lambda which, action, at: F.struct(F.lit(which).alias("list_id"), F.lit(action).alias("action"), at.alias("at"))
    block = F.array(
        edit("block", "add", day), edit("block", "remove", day + (length % 120 + 1) * DAY), edit("block", "add", day + 200 * DAY)
    )
    allow = F.array(edit("allow", "add", day), edit("allow", "remove", day + (length % 30 + 1) * DAY))
    return hosts.select("entry", F.inline(block)).unionByName(paths.select("entry", F.inline(allow)))


SQL = r"""
WITH u AS (
  SELECT page_id, url, 1704067200 + ('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8))::BIGINT % (365 * 86400) AS "at",
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\\.$', '') AS host,
    list_filter(string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts
  FROM pages),
hosts AS (SELECT DISTINCT host AS entry FROM u WHERE host <> ''),
paths AS (SELECT DISTINCT host || '/' || parts[1] AS entry FROM u WHERE len(parts) > 0 AND host <> ''),
dated AS (
  SELECT entry, kind, 1704067200 + ('0x' || substr(md5(entry), 1, 8))::BIGINT % 365 * 86400 AS day,
    ('0x' || substr(md5(entry), 9, 8))::BIGINT AS length
  FROM (SELECT entry, 'block' AS kind FROM hosts UNION ALL SELECT entry, 'allow' FROM paths)),
edits AS (
  SELECT kind, entry, 'add' AS action, day AS "at" FROM dated
  UNION ALL SELECT kind, entry, 'remove', day + (length % (CASE kind WHEN 'block' THEN 120 ELSE 30 END) + 1) * 86400 FROM dated
  UNION ALL SELECT kind, entry, 'add', day + 200 * 86400 FROM dated WHERE kind = 'block'),
intervals AS (
  SELECT * FROM (SELECT kind, entry, action, "at" AS since, lead("at") OVER (PARTITION BY kind, entry ORDER BY "at") AS until FROM edits)
  WHERE action = 'add'),
keys AS (
  SELECT DISTINCT url, "at", unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS entry
  FROM u WHERE host <> ''),
met AS (
  SELECT k.url, k."at", count(*) FILTER (WHERE kind = 'block') AS n_block, count(*) FILTER (WHERE kind = 'allow') AS n_allow,
    min({'n': -length(k.entry), 'e': k.entry}) FILTER (WHERE kind = 'block') AS b,
    min({'n': -length(k.entry), 'e': k.entry}) FILTER (WHERE kind = 'allow') AS a
  FROM keys k JOIN intervals i ON k.entry = i.entry AND i.since <= k."at" AND (i.until IS NULL OR k."at" < i.until)
  GROUP BY k.url, k."at")
SELECT page_id, u."at", coalesce(n_block, 0) AS n_block, coalesce(n_allow, 0) AS n_allow, b.e AS block_entry,
  coalesce(b IS NOT NULL AND (a IS NULL OR length(b.e) > length(a.e)), false) AS blocked
FROM u LEFT JOIN met ON u.url = met.url AND u."at" = met."at"
"""
