"""Candidate loci from alignments: clustering by position with fixed or adaptive gaps."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.quantiles import nearest_rank
from locusweave.operators.islands import island_members, islands

MIN_GAP = 500
MIN_GAPS_FOR_STATS = 3


def adaptive_gaps(alignments: DataFrame, cap: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """(keys, gap): 90 % nearest-rank quantile of positive gaps between consecutive alignments of a read.

    Needs 3 gaps, else the cap; clamped first to the cap, then to at least 500.  Equal gaps are counted
    before they are ranked.  The per-read window is cut into tiles of the axis, so a read with very
    many alignments is spread over tasks; only the gap across a tile edge needs the next tile's first start.
    """
    keys = list(keys)
    tile = 1 << 20
    src = alignments.select(*keys, "read_id", "start", "end").withColumn("_t", F.floor(F.col("start") / F.lit(tile)))
    w = Window.partitionBy(*keys, "read_id", "_t").orderBy("start", "end")
    local = src.withColumn("nxt", F.lead("start").over(w))
    edge_last = local.where("nxt IS NULL").select(*keys, "read_id", "_t", "end")
    firsts = src.groupBy(*keys, "read_id", "_t").agg(F.min("start").alias("first"))
    over = Window.partitionBy(*keys, "read_id").orderBy("_t")
    edges = edge_last.join(
        firsts.withColumn("nxt", F.lead("first").over(over)).where("nxt IS NOT NULL").drop("first"),
        [*keys, "read_id", "_t"],
    ).select(*keys, (F.col("nxt") - F.col("end")).alias("g"))
    gaps = (
        local.where("nxt IS NOT NULL").select(*keys, (F.col("nxt") - F.col("end")).alias("g"))
        .unionByName(edges)
        .where("g > 0")
    )
    picked = nearest_rank(gaps, keys, "g", 0.90)
    clamped = F.greatest(F.least("value", F.lit(cap)), F.lit(MIN_GAP))
    known = src.select(*keys).distinct()
    return known.join(picked, keys, "left").select(
        *keys,
        F.when(F.col("n") >= MIN_GAPS_FOR_STATS, clamped).otherwise(F.lit(cap)).cast("bigint").alias("gap"),
    )


def cluster_alignments(
    alignments: DataFrame, gap: int, min_reads: int, keys: tuple[str, ...] = ("chrom",), adaptive: bool = False
) -> DataFrame:
    """Loci (keys, start, end, n_rows) with at least ``min_reads`` alignments."""
    if adaptive:
        gaps = adaptive_gaps(alignments, gap, keys)
        src = alignments.join(gaps, list(keys))
        found = islands(src, gap, keys=keys, gap_col="gap")
    else:
        found = islands(alignments, gap, keys=keys)
    return found.where(F.col("n_rows") >= min_reads)


def cluster_by_distinct_reads(
    alignments: DataFrame, gap: int, min_reads: int, min_size: int, max_size: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Loci with enough distinct reads and a span in range, and their (chrom, start, read_id) members."""
    span = F.col("end") - F.col("start")
    found = islands(alignments, gap).where(span >= min_size)
    if max_size is not None:
        found = found.where(span <= max_size)
    members = island_members(alignments, found)
    n = members.groupBy("chrom", F.col("island").alias("start")).agg(F.count(F.lit(1)).alias("n_reads"))
    loci = found.join(n, ["chrom", "start"]).where(F.col("n_reads") >= min_reads)
    keep = loci.select("chrom", F.col("start").alias("island"))
    return loci, members.join(keep, ["chrom", "island"], "left_semi").withColumnRenamed("island", "start")


def locus_id(chrom="chrom", start="start", end="end"):
    """A locus id that does not depend on partitioning or row order."""
    return F.concat(F.col(chrom), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))
