"""Shape scores of coverage profiles and combined validation scores."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.operators.coverage import coverage_fractional
from locusweave.session import materialize

KEY = "locus_id"


def coverage_quality(profile: DataFrame, bin_size: int) -> DataFrame:
    """(locus_id, peak_height, peak_width, symmetry, left_slope, right_slope, score) per profile.

    The peak is the last maximum.  All parts are plain aggregates once every bin knows the peak, so no task holds a locus.
    """
    profile = materialize(profile.select(KEY, "bin", "cov"))
    top = profile.groupBy(KEY).agg(F.max(F.struct("cov", "bin")).alias("p"), F.count(F.lit(1)).alias("n"))
    d = profile.join(top, KEY)
    h, at = F.col("p.cov"), F.col("p.bin")
    k = F.least(F.lit(3), F.floor(F.col("n") / 4))
    low = F.col("cov") < h / 2
    s = d.groupBy(KEY).agg(
        F.max("p.cov").alias("h"),
        F.max("p.bin").alias("at"),
        F.max("n").alias("n"),
        F.max(k).alias("k"),
        F.max(F.when(low & (F.col("bin") < at), F.col("bin"))).alias("lo"),
        F.min(F.when(low & (F.col("bin") >= at), F.col("bin"))).alias("hi"),
        F.sum(F.when(F.col("bin") < at, F.col("cov")).otherwise(0.0)).alias("left"),
        F.sum(F.when(F.col("bin") > at, F.col("cov")).otherwise(0.0)).alias("right"),
        F.sum(F.when(F.col("bin") < k, F.col("cov")).otherwise(0.0)).alias("head"),
        F.sum(F.when(F.col("bin") >= F.col("n") - k, F.col("cov")).otherwise(0.0)).alias("tail"),
    )
    both = F.col("left") + F.col("right")
    sym = F.when(both > 0, F.abs(F.col("left") - F.col("right")) / both).otherwise(1.0)
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / 5.0))
    ls = F.when(
        (F.col("k") > 0) & (F.col("at") > F.col("k")), (F.col("h") - F.col("head") / F.col("k")) / F.col("at")
    ).otherwise(0.0)
    rs = F.when(
        (F.col("k") > 0) & (F.col("at") + F.col("k") < F.col("n")),
        (F.col("h") - F.col("tail") / F.col("k")) / (F.col("n") - F.col("at")),
    ).otherwise(0.0)
    out = s.select(
        KEY,
        F.col("h").alias("peak_height"),
        ((F.coalesce("hi", "at") - F.coalesce("lo", "at")) * bin_size).alias("peak_width"),
        sym.alias("symmetry"),
        unit(ls).alias("left_slope"),
        unit(rs).alias("right_slope"),
    )
    score = (
        F.least(F.lit(1.0), F.col("peak_height") / 50.0) * 0.3
        + (F.col("left_slope") + F.col("right_slope")) / 2.0 * 0.4
        + (1.0 - F.col("symmetry")) * 0.3
    )
    return out.withColumn("score", F.when(F.col("peak_height") > 0, score).otherwise(0.0))


def is_gene_like(score: Column, min_score: float) -> Column:
    return score >= min_score


def quality_filter(alignments: DataFrame, loci: DataFrame, min_score: float, bin_size: int, **kw) -> DataFrame:
    """Keep seed loci and those whose total coverage scores at least ``min_score``."""
    if min_score <= 0:
        return loci
    profile = coverage_fractional(alignments, loci.select(KEY, "chrom", "start", "end"), bin_size, **kw)
    scores = coverage_quality(profile, bin_size).select(KEY, "score")
    return loci.join(scores, KEY).where(F.col("is_seed") | (F.col("score") >= min_score)).drop("score")
