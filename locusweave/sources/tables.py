"""Alignment, seed and gene relations derived from star-schema tables.

An order spanning several parts plays the multi-mapping read; parts are positions on five
chromosomes named after the supplier.  Every derived column is a plain expression of one row.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, chrom, start, end, line, flag): intervals and SAM flags only."""
    li = _table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 1000 + F.col("l_orderkey") % 97
    return li.select(
        F.col("l_orderkey").alias("read_id"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("bigint") * 20).alias("end"),
        F.col("l_linenumber").alias("line"),
        (
            F.when(F.col("l_linestatus") == "O", 16).otherwise(0)
            + F.when(F.col("l_linenumber") % 3 == 2, 256).otherwise(0)
            + F.when(F.col("l_linenumber") % 7 == 0, 2048).otherwise(0)
        ).alias("flag"),
    )


def spliced_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alignments with strand, CIGAR, sequence and tags.

    Lines divisible by 4 have two introns, other even lines one, odd lines none; leading and
    trailing soft clips follow part and supplier keys.
    """
    li = _table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    lead = (F.col("l_partkey") % 7 * 4).cast("int")
    tail = (F.col("l_suppkey") % 11 * 3).cast("int")
    line = F.col("l_linenumber")
    core = (
        F.when(line % 4 == 0, F.array(op("M", q * 5), op("N", q * 2), op("M", q * 5), op("N", q * 3), op("M", q * 5)))
        .when(line % 2 == 0, F.array(op("M", q * 8), op("N", q * 4), op("M", q * 8)))
        .otherwise(F.array(op("M", q * 20)))
    )
    clip = lambda n: F.filter(F.array(op("S", n)), lambda x: x["len"] > 0)
    body = F.when(line % 4 == 0, q * 15).when(line % 2 == 0, q * 16).otherwise(q * 20)
    n_a = (tail - tail * (F.col("l_orderkey") % 4) / 4).cast("int")
    start = F.col("l_partkey") * 1000 + F.col("l_orderkey") % 97
    return li.select(
        F.col("l_orderkey").alias("read_id"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("bigint") * 20).alias("end"),
        line.alias("line"),
        (
            F.when(F.col("l_linestatus") == "O", 16).otherwise(0)
            + F.when(line % 3 == 2, 256).otherwise(0)
            + F.when(line % 7 == 0, 2048).otherwise(0)
        ).alias("flag"),
        F.when(F.col("l_linestatus") == "O", "-").otherwise("+").alias("strand"),
        F.concat(clip(lead), core, clip(tail)).alias("cigar"),
        F.concat(
            F.repeat(F.lit("A"), lead), F.repeat(F.lit("C"), body), F.repeat(F.lit("A"), n_a), F.repeat(F.lit("G"), tail - n_a)
        ).alias("seq"),
        (q % 20).alias("np"),
        (line * 2).alias("nm"),
        (F.lit(1.0) - F.col("l_tax")).alias("rq"),
        (q * 14).alias("cm"),
        F.col("l_discount").alias("de"),
        (q * 10).alias("as_score"),
        (lead + body + tail).alias("rl"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seed interval per nation: (seed_ord, chrom, start, end, name)."""
    n = _table(spark, sf_dir, "nation")
    start = ((F.col("n_nationkey") * 7 + 3) * 1000).cast("bigint")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("seed_ord"),
        F.concat(F.lit("chr"), (F.col("n_nationkey") % 5).cast("string")).alias("chrom"),
        start.alias("start"),
        (start + 10_000).alias("end"),
        F.col("n_name").alias("name"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotated gene per part: (gene_id, family_id, gene_name, chrom, start, end)."""
    p = _table(spark, sf_dir, "part")
    start = F.col("p_partkey") * 1000
    return p.select(
        F.col("p_partkey").alias("gene_id"),
        F.col("p_brand").alias("family_id"),
        F.col("p_name").alias("gene_name"),
        F.concat(F.lit("chr"), (F.col("p_size") % 5).cast("string")).alias("chrom"),
        start.alias("start"),
        (start + 400 + F.col("p_size") * 10).cast("bigint").alias("end"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region table as it is: (r_regionkey, r_name)."""
    return _table(spark, sf_dir, "region")
