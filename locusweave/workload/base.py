"""Relations many queries start from."""

from pyspark.sql import functions as F

from locusweave.operators.cluster import locus_id
from locusweave.operators.islands import island_members, islands
from locusweave.sources import tables
from locusweave.session import materialize

GAP, MIN_ROWS = 100, 5


def whole_loci(spark, d):
    """All clustered loci (locus_id, chrom, start, end, n_rows), written once, and their read sets."""
    a = tables.alignments(spark, d)
    found = materialize(
        islands(a, GAP).where(F.col("n_rows") >= MIN_ROWS).withColumn("locus_id", locus_id())
    )
    members = island_members(a, found, cols=("locus_id",)).select("locus_id", "read_id")
    return found, members


def kept_loci(spark, d):
    found, members = whole_loci(spark, d)
    return found, materialize(members)


def big(col: str):
    return F.col(col).cast("bigint").alias(col)


def r6(col, name: str | None = None):
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c, 6)
    return out.alias(name or col)
