"""Seed lists and annotated genes from BED text and interval strings."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INTERVAL = r"^(.+):(\d+)-(\d+)$"


def _bed_fields(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated fields of data lines with at least three of them."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)


def _cell(i: int):
    return F.get(F.col("f"), i)


def read_seeds_bed(spark: SparkSession, path: str, default_names: bool = False) -> DataFrame:
    """Seeds (seed_ord, chrom, start, end, name) in file order; ``default_names`` fills ``seed_<n>``.

    A seed list is a small file, one row per seed, so it may be numbered in one task.
    """
    d = _bed_fields(spark, path).withColumn("_pos", F.monotonically_increasing_id())
    n = F.row_number().over(Window.orderBy("_pos")) - 1
    name = F.when(F.size("f") >= 4, _cell(3))
    if default_names:
        name = F.coalesce(name, F.concat(F.lit("seed_"), n.cast("string")))
    return d.select(
        n.cast("bigint").alias("seed_ord"), _cell(0).alias("chrom"), _cell(1).cast("bigint").alias("start"),
        _cell(2).cast("bigint").alias("end"), name.alias("name"),
    )


def seeds_from_list(spark: SparkSession, text: str) -> DataFrame:
    """Seeds from ``chrom:start-end,chrom:start-end``."""
    items = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("seed_ord", "item"))
    item = F.trim("item")
    part = lambda i: F.regexp_extract(item, INTERVAL, i)
    return items.where(item.rlike(INTERVAL)).select(
        F.col("seed_ord").cast("bigint"), part(1).alias("chrom"), part(2).cast("bigint").alias("start"),
        part(3).cast("bigint").alias("end"), F.lit(None).cast("string").alias("name"),
    )


def single_seed(spark: SparkSession, chrom: str, start: int, end: int) -> DataFrame:
    return spark.createDataFrame([(0, chrom, start, end, "seed")], "seed_ord long, chrom string, start long, end long, name string")


def read_genes_bed(spark: SparkSession, path: str, family: str | None = None) -> DataFrame:
    """Annotated genes (family_id, gene_id, gene_name, chrom, start, end) from names like ``GENE|FAMILY``.

    With ``family`` only that family: an exact match of one of the ``|`` parts or the whole name.
    """
    d = _bed_fields(spark, path).where(F.size("f") >= 4)
    name = _cell(3)
    parts = F.split(name, r"\|")
    base = d.select(
        F.element_at(parts, -1).alias("family_id") if family is None else F.lit(family).alias("family_id"),
        parts.alias("_parts"),
        name.alias("_name"),
        name.alias("gene_name"),
        _cell(0).alias("chrom"), _cell(1).cast("bigint").alias("start"), _cell(2).cast("bigint").alias("end"),
    )
    if family is not None:
        tail = F.slice("_parts", 2, F.size("_parts"))
        base = base.where((F.col("_name") == family) | F.array_contains(tail, family))
    gid = F.concat_ws(":", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "_name")
    return base.withColumn("gene_id", gid).select("family_id", "gene_id", "gene_name", "chrom", "start", "end")


def read_genes_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Gene features of a GTF as (family_id, gene_id, gene_name, chrom, start, end), starts back to 0-based."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    d = lines.select(F.split("value", "\t").alias("f")).where((F.size("f") >= 9) & (_cell(2) == "gene"))
    attr = lambda k: F.regexp_extract(_cell(8), k + r' "([^"]*)"', 1)
    return d.select(
        attr("family_id").alias("family_id"), attr("gene_id").alias("gene_id"), attr("gene_id").alias("gene_name"),
        _cell(0).alias("chrom"), (_cell(3).cast("bigint") - 1).alias("start"), _cell(4).cast("bigint").alias("end"),
    )
