"""The alignment table: Parquet by chromosome, sorted by start, one folder per flag choice."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.functions.intervals import is_mapped, is_secondary, is_supplementary


def index_path(root: str, include_secondary: bool = False, include_supplementary: bool = False) -> str:
    """Folders differ by the kept record kinds, so a table is never reused with other flags."""
    return f"{root}/secondary={int(include_secondary)}_supplementary={int(include_supplementary)}"


def kept_records(alignments: DataFrame, include_secondary: bool = False, include_supplementary: bool = False) -> DataFrame:
    keep = is_mapped()
    if not include_secondary:
        keep = keep & ~is_secondary()
    if not include_supplementary:
        keep = keep & ~is_supplementary()
    return alignments.where(keep)


def build_index(
    alignments: DataFrame, root: str, include_secondary: bool = False, include_supplementary: bool = False
) -> str:
    """Write the table.  Range partitioning splits a chromosome holding most rows over many files.

    Sorted starts give row groups narrow min/max ranges, so region filters skip most of them.
    """
    path = index_path(root, include_secondary, include_supplementary)
    rows = kept_records(alignments, include_secondary, include_supplementary)
    (
        rows.repartitionByRange("chrom", "start", F.xxhash64("read_id"))
        .sortWithinPartitions("chrom", "start")
        .write.partitionBy("chrom")
        .mode("overwrite")
        .parquet(path)
    )
    return path


def load_index(
    spark: SparkSession, root: str, include_secondary: bool = False, include_supplementary: bool = False, chroms=None
) -> DataFrame:
    d = spark.read.parquet(index_path(root, include_secondary, include_supplementary))
    return d if chroms is None else d.where(F.col("chrom").isin(list(chroms)))


def load_or_build(
    spark: SparkSession, alignments: DataFrame, root: str, include_secondary: bool = False,
    include_supplementary: bool = False, rebuild: bool = False,
) -> DataFrame:
    """Reuse the table of these flags if it was completely written, else build it."""
    path = index_path(root, include_secondary, include_supplementary)
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    exists = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if rebuild or not exists:
        build_index(alignments, root, include_secondary, include_supplementary)
    return load_index(spark, root, include_secondary, include_supplementary)
