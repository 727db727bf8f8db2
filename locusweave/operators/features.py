"""Advanced transcript features, multi-layer validation and evidence scores of loci."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.functions.cigar import aligned_length, intron_count
from locusweave.functions.intervals import is_mapped, is_reverse, is_secondary, is_supplementary
from locusweave.operators.coverage import coverage_counts, coverage_stats
from locusweave.operators.interval_join import interval_join

KEY = "locus_id"
BIN = 1000


def identity(cm="cm", cigar="cigar") -> Column:
    """Matching bases over reference-consuming length; null without the tag or any such length."""
    n = aligned_length(cigar)
    return F.when(n > 0, F.col(cm) / n)


def advanced_features(alignments: DataFrame, loci: DataFrame, max_divergence: float = 0.05, **kw) -> DataFrame:
    """One row of features per locus, from alignments at most ``max_divergence`` diverged (1 if unknown)."""
    src = alignments.where(is_mapped()).select(
        "chrom", "start", "end",
        is_reverse().alias("rev"), is_secondary().alias("sec"), is_supplementary().alias("sup"),
        F.coalesce("de", F.lit(1.0)).alias("div"), "as_score", "rq", "np",
        identity().alias("ident"), intron_count("cigar").alias("introns"),
    )
    regions = loci.select(KEY, "chrom", F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    hits = interval_join(src, regions, **kw).withColumn("ok", F.col("div") <= max_divergence)
    ok = lambda c: F.when(F.col("ok"), c)
    length = ok(F.col("end") - F.col("start"))
    whole = (F.col("introns") >= 2) & (F.col("div") < 0.02) & F.coalesce(F.col("ident") > 0.95, F.lit(True))
    z = lambda c, v=0.0: F.coalesce(c, F.lit(v))
    per = hits.groupBy(KEY).agg(
        F.count_if("ok").alias("total"),
        F.count_if(F.col("ok") & ~F.col("rev")).alias("plus"),
        F.count_if(F.col("ok") & F.col("rev")).alias("minus"),
        z(F.avg(length)).alias("mean_length"),
        z(F.stddev_pop(length)).alias("length_std"),
        z(F.avg(ok(F.col("div"))), 1.0).alias("mean_divergence"),
        z(F.avg(ok(F.col("as_score")))).alias("mean_score"),
        z(F.avg(ok(F.col("ident")))).alias("mean_identity"),
        z(F.avg(ok(F.col("rq")))).alias("mean_quality"),
        z(F.avg(ok(F.col("np")))).alias("mean_passes"),
        z(F.avg(ok(F.col("introns")))).alias("mean_introns"),
        F.count_if(F.col("ok") & whole).alias("n_full_length"),
        F.count_if("sec").alias("n_secondary"),
        F.count_if("sup").alias("n_supplementary"),
    )
    kept = src.where(F.col("div") <= max_divergence)
    std = coverage_stats(coverage_counts(kept, loci.select(KEY, "chrom", "start", "end"), BIN, **kw)).select(
        KEY, F.col("std_cov").alias("coverage_std")
    )
    d = loci.select(KEY).join(per, KEY, "left").join(std, KEY).na.fill(0)
    seen = F.col("total") + F.col("n_secondary") + F.col("n_supplementary")
    return d.select(
        "*",
        F.when(F.col("mean_length") > 0, F.col("length_std") / F.col("mean_length")).otherwise(0.0).alias("length_cv"),
        (F.col("total") - F.col("n_full_length")).alias("n_partial"),
        F.when(F.col("total") > 0, F.greatest("plus", "minus") / F.col("total")).otherwise(0.0).alias("strand_consistency"),
        F.when(seen > 0, F.col("n_supplementary") / seen).otherwise(0.0).alias("chimeric_ratio"),
        F.when(seen > 0, F.col("n_secondary") / seen).otherwise(0.0).alias("secondary_ratio"),
    )


def intron_histogram(alignments: DataFrame, loci: DataFrame, **kw) -> DataFrame:
    """(locus_id, introns MAP<intron count, alignments>): one entry per distinct count."""
    regions = loci.select(KEY, "chrom", F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    src = alignments.where(is_mapped()).select("chrom", "start", "end", intron_count("cigar").alias("introns"))
    counts = interval_join(src, regions, **kw).groupBy(KEY, "introns").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("introns", "n"))).alias("introns"))


def _ladder(value: Column, steps, last: float, strict: bool = True) -> Column:
    out = None
    for limit, score in steps:
        test = value < limit if strict else value <= limit
        out = F.when(test, score) if out is None else out.when(test, score)
    return out.otherwise(last)


def advanced_similarity(a: str, b: str) -> Column:
    """Weighted similarity of two feature structs."""
    f = lambda s, c: F.col(f"{s}.{c}")
    strand = F.when((f(a, "plus") > f(a, "minus")) == (f(b, "plus") > f(b, "minus")), 1.0).otherwise(0.0)
    ratio = f(b, "mean_length") / F.nullif(f(a, "mean_length"), F.lit(0.0))
    length = F.when(ratio.between(0.7, 1.3), 1.0).when(ratio.between(0.5, 2.0), 0.5).otherwise(0.0)
    cv = F.when(f(b, "length_cv") < 0.5, 1.0).otherwise(0.5)
    cov = F.when(f(b, "coverage_std") > 50, 1.0).otherwise(0.5)
    gap = lambda c: F.abs(f(a, c) - f(b, c))
    introns = _ladder(gap("mean_introns"), ((2.0, 1.0), (5.0, 0.5)), 0.0, strict=False)
    near = ((0.02, 1.0), (0.05, 0.7), (0.10, 0.4))
    div, ident = _ladder(gap("mean_divergence"), near, 0.0), _ladder(gap("mean_identity"), near, 0.0)
    # Fixed weights of the seven terms.
    return strand * 0.25 + length * 0.20 + cv * 0.15 + cov * 0.15 + introns * 0.10 + div * 0.10 + ident * 0.05


def advanced_filter(
    features: DataFrame, min_transcripts: int = 10, max_divergence: float = 0.05, min_strand_consistency: float = 0.7
) -> DataFrame:
    """Enough transcripts, low divergence, one strand, and an identity of at least 0.9 where known."""
    ident = F.col("mean_identity")
    return features.where(
        (F.col("total") >= min_transcripts) & (F.col("mean_divergence") <= max_divergence)
        & (F.col("strand_consistency") >= min_strand_consistency) & ~((ident < 0.90) & (ident > 0))
    )


def quality_class(score="score", symmetry="symmetry", left="left_slope", right="right_slope") -> Column:
    c = F.col
    high = (c(score) >= 0.8) & (c(symmetry) < 0.3) & (c(left) > 0.5) & (c(right) > 0.5)
    return F.when(high, "High").when(c(score) >= 0.5, "Medium").otherwise("Low")


def validation(
    scored: DataFrame, min_coverage: float = 0.4, min_jaccard: float = 0.01, min_isoseq: float = 0.6, min_seeds: int = 2
) -> DataFrame:
    """Add normalized_score, confidence, multi_seed and is_valid.

    ``scored`` has the columns of a coverage quality row plus jaccard, isoseq (nullable) and n_seeds.
    """
    cls = quality_class()
    multi = F.col("n_seeds") >= min_seeds
    base = F.when(cls == "High", 1.0).when(cls == "Medium", 0.6).otherwise(0.2) * 0.3
    total = base + F.least(F.col("jaccard"), F.lit(1.0)) * 0.2 + F.coalesce(F.col("isoseq") * 0.3, F.lit(0.0))
    total = total + F.when(multi, 0.2).otherwise(0.0)
    weight = F.lit(0.5) + F.when(F.col("isoseq").isNotNull(), 0.3).otherwise(0.0) + F.when(multi, 0.0).otherwise(0.2)
    norm = total / weight
    valid = (F.col("score") >= min_coverage) & (F.col("jaccard") >= min_jaccard) & F.coalesce(
        F.col("isoseq") >= min_isoseq, F.lit(True)
    )
    return scored.withColumns(
        {
            "coverage_confidence": cls,
            "multi_seed": multi,
            "normalized_score": norm,
            "confidence": F.when(norm >= 0.8, "High").when(norm >= 0.5, "Medium").otherwise("Low"),
            "is_valid": valid,
        }
    )


def segment_confidence(segments: DataFrame, min_density: float = 10.0) -> DataFrame:
    """Add read_density, confidence and is_valid from span and n_reads; penalties multiply."""
    span = F.col("end") - F.col("start")
    density = F.when(span > 0, F.col("n_reads") / (span / 1000.0)).otherwise(0.0)
    thin, short, few = density < min_density, span < 5000, F.col("n_reads") < 10
    part = lambda c, v: F.when(c, v).otherwise(1.0)
    return segments.withColumns(
        {
            "read_density": density,
            "confidence": part(thin, 0.5) * part(short, 0.3) * part(span > 500_000, 0.7) * part(few, 0.3),
            "is_valid": ~(thin | short | few),
        }
    )


def locus_evidence(alignments: DataFrame, loci: DataFrame, **kw) -> DataFrame:
    """(locus_id, spliced, unspliced, mean_length, length_cv, coverage_std) of mapped alignments."""
    src = alignments.where(is_mapped()).select("chrom", "start", "end", (intron_count("cigar") > 0).alias("spliced"))
    regions = loci.select(KEY, "chrom", F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    length = F.col("end") - F.col("start")
    per = interval_join(src, regions, **kw).groupBy(KEY).agg(
        F.count_if("spliced").alias("spliced"), F.count_if(~F.col("spliced")).alias("unspliced"),
        F.avg(length).alias("mean_length"), F.stddev_pop(length).alias("sd"),
    )
    std = coverage_stats(coverage_counts(src, loci.select(KEY, "chrom", "start", "end"), BIN, **kw)).select(
        KEY, F.col("std_cov").alias("coverage_std")
    )
    d = loci.select(KEY).join(per, KEY, "left").join(std, KEY).na.fill(0)
    return d.withColumn(
        "length_cv", F.when(F.col("mean_length") > 0, F.col("sd") / F.col("mean_length")).otherwise(0.0)
    ).drop("sd")


def evidence_score(multi_seed: Column) -> Column:
    """Confidence of a locus from coverage spread, splicing balance, length spread and seed support."""
    std, n = F.col("coverage_std"), F.col("spliced") + F.col("unspliced")
    cov = F.when(std > 50, 1.0).when(std > 20, 0.7).when(std > 10, 0.4).otherwise(0.1)
    ratio = F.col("spliced") / F.nullif(n, F.lit(0))
    splicing = (
        F.when(n == 0, 0.0).when((ratio > 0.3) & (ratio < 0.95), 0.9).when(ratio >= 0.95, 0.6).otherwise(0.4)
    )
    length = _ladder(F.col("length_cv"), ((0.3, 0.9), (0.5, 0.7), (0.7, 0.4)), 0.2)
    seed = F.when(multi_seed, 1.0).otherwise(0.5)
    return cov * 0.35 + splicing * 0.25 + length * 0.20 + seed * 0.20


def evidence_class(score: Column) -> Column:
    return F.when(score > 0.7, "true_gene").when(score > 0.4, "uncertain").otherwise("false_positive")


def validate_loci(alignments: DataFrame, loci: DataFrame, supported: DataFrame, **kw) -> DataFrame:
    """All loci at once: evidence of each, multi_seed (its locus_id is in ``supported``), score and class."""
    known = supported.select(KEY).distinct().withColumn("multi_seed", F.lit(True))
    d = locus_evidence(alignments, loci, **kw).join(known, KEY, "left").na.fill(False, ["multi_seed"])
    d = d.withColumn("score", evidence_score(F.col("multi_seed")))
    return d.withColumn("class", evidence_class(F.col("score")))


def validate_advanced(alignments: DataFrame, pairs: DataFrame, loci: DataFrame, max_divergence: float = 0.05, **kw) -> DataFrame:
    """``pairs`` (seed_id, target_id) of loci with their advanced similarity and both feature rows as structs.

    The features of each locus are computed once, however many pairs it is in.
    """
    rows = advanced_features(alignments, loci, max_divergence, **kw)
    of = lambda role: rows.select(F.col(KEY).alias(f"{role}_id"), F.struct(*rows.columns).alias(role))
    both = pairs.join(of("seed"), "seed_id").join(of("target"), "target_id")
    return both.withColumn("similarity", advanced_similarity("seed", "target"))
