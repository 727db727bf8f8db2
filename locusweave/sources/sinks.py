"""Result files.  Rows are range-sorted by Spark and written as one folder of part files per result."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Column order of the result files (fixed values).
TRANSITIVE = ("chrom", "start", "end", "jaccard", "distance", "component", "reads")
INTEGRATED = ("chrom", "start", "end", "jaccard", "confidence", "valleys", "splits", "isoseq_validated")
LEGACY = ("chrom", "start", "end", "name", "jaccard_seed", "component", "shared_with_seed", "total_reads", "span")
REFINED = (
    "chrom", "start", "end", "name", "jaccard", "transcripts", "tx_density", "trim_5p", "trim_3p", "method", "original_span",
)
FAST = ("chrom", "start", "end", "name", "shared_reads", "span_bp")
MEMBER = (
    "location", "member_name", "family_name", "family_id", "copies_available", "copies_found", "copies_extra", "sensitivity",
    "precision", "iou", "pred_jaccard", "pred_reads", "pred_span_bp", "n_peaks", "frac_high_bins", "is_seed",
)


def _fixed(col: str, digits: int):
    return F.format_string(f"%.{digits}f", F.col(col).cast("double")).alias(col)


def numbered(df: DataFrame, prefix: str, order: list[str], group: str = "chrom") -> DataFrame:
    """``df`` with ``name`` = prefix and the row's rank in global order.

    Ranks are counted per group in parallel; group offsets come from the few group totals.
    """
    w = Window.partitionBy(group).orderBy(*order)
    totals = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = totals.select(group, before.alias("_off"))
    return df.withColumn("_rn", F.row_number().over(w)).join(offsets, group).withColumn(
        "name", F.concat(F.lit(prefix), (F.col("_rn") + F.col("_off")).cast("string"))
    ).drop("_rn", "_off")


def transitive_rows(loci: DataFrame) -> DataFrame:
    return loci.withColumnRenamed("n_reads", "reads").select(
        *["chrom", "start", "end"], _fixed("jaccard", 4), "distance", "component", "reads"
    ).orderBy("chrom", "start")


def integrated_rows(cores: DataFrame) -> DataFrame:
    return cores.select(
        "chrom", "start", "end", _fixed("jaccard", 4), "confidence", "valleys", "splits", "isoseq_validated"
    ).orderBy("chrom", "start")


def legacy_rows(loci: DataFrame, with_similarity: bool = False) -> DataFrame:
    """``loci`` has jaccard, component, shared, n_reads and, for the tenth column, isoseq_sim."""
    d = numbered(loci, "locus_", ["start", "end"]).select(
        "chrom", "start", "end", "name", F.col("jaccard").alias("jaccard_seed"), "component",
        F.col("shared").alias("shared_with_seed"), F.col("n_reads").alias("total_reads"),
        (F.col("end") - F.col("start")).alias("span"), *(["isoseq_sim"] if with_similarity else []),
    )
    d = d.withColumn("jaccard_seed", F.format_string("%.6f", "jaccard_seed"))
    if with_similarity:
        d = d.withColumn("isoseq_sim", F.coalesce(F.format_string("%.3f", "isoseq_sim"), F.lit("NA")))
    return d.orderBy("chrom", "start")


def refined_rows(loci: DataFrame) -> DataFrame:
    d = numbered(loci, "refined_locus_", ["start", "end"])
    return d.select(
        "chrom", "start", "end", "name", _fixed("jaccard", 4), F.col("n_transcripts").alias("transcripts"),
        _fixed("tx_density", 2), "trim_5p", "trim_3p", "method",
        (F.col("original_end") - F.col("original_start")).alias("original_span"),
    ).orderBy("chrom", "start")


def fast_rows(loci: DataFrame) -> DataFrame:
    return numbered(loci, "locus_", ["start", "end"]).select(
        "chrom", "start", "end", "name", F.col("n_reads").alias("shared_reads"), (F.col("end") - F.col("start")).alias("span_bp")
    ).orderBy("chrom", "start")


def member_rows(table: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return table.withColumns({"family_name": F.col("family_id"), "n_peaks": none, "frac_high_bins": none}).select(*MEMBER)


def evaluation_metrics(totals: DataFrame) -> DataFrame:
    """Totals as (family_id, metric, value) rows."""
    metrics = [c for c in totals.columns if c != "family_id"]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return totals.select("family_id", F.explode(pairs).alias("x")).select("family_id", "x.*")


def evaluation_genes(per_gene: DataFrame) -> DataFrame:
    return per_gene.select(
        "family_id", "gene_name", "found", "confirmed_by_seed", "overlap_bp", _fixed("overlap_pct", 2), "match_iou"
    )


def novel_rows(ranking: DataFrame) -> DataFrame:
    """Novel candidates with their rank within the family."""
    w = Window.partitionBy("family_id").orderBy(F.desc("rank_score"), "chrom", "start")
    return ranking.select(
        "family_id", F.row_number().over(w).alias("rank"), "chrom", "start", "end",
        (F.col("end") - F.col("start")).alias("span_bp"), "n_reads", "jaccard",
        F.col("distance").alias("distance_from_seed"), "rank_score",
    )


def write_table(rows: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    rows.write.option("sep", sep).option("header", str(header).lower()).mode("overwrite").csv(path)


def show_evaluation(totals: DataFrame, novel: DataFrame, top: int = 25) -> None:
    """Console report: totals and the best novel candidates."""
    totals.show(truncate=False)
    novel.orderBy(F.desc("rank_score")).limit(top).show(top, truncate=False)
