"""Integrated mode: per seed, candidate loci are cut at valleys that depth or transcripts justify."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.config import ExonTrim, Integrated, StdGate
from locusweave.functions.intervals import is_mapped, is_reverse
from locusweave.operators.cluster import cluster_alignments
from locusweave.operators.coverage import coverage_fractional
from locusweave.operators.filters import std_gate_filter
from locusweave.operators.folds import drop_covered, ordered_fold
from locusweave.operators.interval_join import interval_join
from locusweave.operators.readsets import jaccard_to_reference, seed_reads
from locusweave.operators.refine import exon_trim
from locusweave.operators.segments import find_peaks, find_valleys, fixed_valley_params, split_by_valleys
from locusweave.operators.transcripts import transcript_summary
from locusweave.session import materialize

KEY = "locus_id"


def decide_splits(alignments: DataFrame, valleys: DataFrame, p: Integrated, **kw) -> DataFrame:
    """``valleys`` (locus_id, chrom, position, depth_ratio, ...) with ``split`` and ``validated``.

    Deep valleys split at once.  Doubtful ones are looked at in a window: reads spanning it (even
    coverage) or introns (very uneven coverage) keep the locus together.  Shallow ones never split.
    """
    doubtful = valleys.where((F.col("depth_ratio") >= p.auto_split) & (F.col("depth_ratio") < p.validate))
    windows = doubtful.select(
        F.concat_ws(":", "chrom", F.col("position").cast("string")).alias(KEY), "chrom",
        F.greatest(F.col("position") - p.validate_window, F.lit(1)).alias("start"),
        (F.col("position") + p.validate_window).alias("end"),
    ).distinct()
    s = transcript_summary(alignments, windows, **kw).select(
        F.col(KEY).alias("_w"),
        (((F.col("total") > 0) & (F.col("coverage_std") < 20)) | (F.col("coverage_std") > 30)).alias("_hold"),
    )
    d = valleys.withColumn("_w", F.concat_ws(":", "chrom", F.col("position").cast("string"))).join(s, "_w", "left")
    deep = F.col("depth_ratio") < p.auto_split
    unsure = ~deep & (F.col("depth_ratio") < p.validate)
    return d.withColumn("split", deep | (unsure & ~F.coalesce("_hold", F.lit(False)))).withColumn("validated", unsure).drop("_w", "_hold")


def _add_if_far(reach):
    def fold(rows):
        taken = []
        for r in rows:
            near = any(abs(t - r["position"]) < reach for t in taken)
            if r["rank"] == 0:
                if r["split"]:
                    taken.append(r["position"])
                    yield {k: r[k] for k in ("position", "split", "validated")}
                elif r["validated"]:
                    yield {k: r[k] for k in ("position", "split", "validated")}
            elif not near:
                if r["split"]:
                    taken.append(r["position"])
                if r["split"] or r["validated"]:
                    yield {k: r[k] for k in ("position", "split", "validated")}

    return fold


def accepted_valleys(alignments: DataFrame, own: DataFrame, loci: DataFrame, members: DataFrame, p: Integrated, **kw):
    """Decided valleys (locus_id, position, split, validated) and per-locus counts of combined valleys."""
    params = fixed_valley_params(loci, p.peak_frac, p.min_gap_bp, p.min_segment_bp)
    spans = loci.select(KEY, "chrom", "start", "end")
    chrom = spans.select(KEY, "chrom")
    prof = materialize(coverage_fractional(own, spans, p.bin_size, members=members, **kw))
    v = materialize(find_valleys(prof, find_peaks(prof, params, p.bin_size), p.bin_size).join(chrom, KEY))
    counts = v.groupBy(KEY).agg(F.count(F.lit(1)).alias("valleys"), F.count_if("is_significant").alias("significant"))
    combined = materialize(decide_splits(alignments, v, p, **kw))
    if not p.strand_split:
        return combined.where("split OR validated").select(KEY, "position", "split", "validated"), counts
    any_split = combined.groupBy(KEY).agg(F.max("split").alias("any_split"))
    run = spans.join(any_split, KEY, "left").where(
        (F.col("end") - F.col("start") >= p.strand_min_span) | (F.col("any_split") == F.lit(False))
    ).select(KEY, "chrom", "start", "end")
    sprof = materialize(coverage_fractional(own, run, p.bin_size, members=members, by_strand=True, **kw))
    # Each strand's profile is a locus of its own for the peak and valley search.
    skey = F.concat(KEY, F.lit("#"), "strand")
    both = run.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-")))).withColumn("parent", F.col(KEY)).withColumn(KEY, skey)
    sp = sprof.withColumn(KEY, skey).drop("strand")
    sparams = fixed_valley_params(both, p.peak_frac, p.min_gap_bp, p.min_segment_bp)
    sv = find_valleys(sp, find_peaks(sp, sparams, p.bin_size), p.bin_size).join(both.select(KEY, "chrom", "strand", "parent"), KEY)
    extra = decide_splits(alignments, sv, p, **kw).select(
        F.col("parent").alias(KEY), F.when(F.col("strand") == "+", 1).otherwise(2).alias("rank"), "position", "split", "validated"
    )
    every = combined.select(KEY, F.lit(0).alias("rank"), "position", "split", "validated").unionByName(extra)
    schema = every.select(KEY, "position", "split", "validated").schema
    reach = max(p.bin_size, 100) * 2
    return ordered_fold(every, [KEY], ["rank", "position"], _add_if_far(reach), schema), counts


def detect_integrated(
    alignments: DataFrame, seeds: DataFrame, p: Integrated = Integrated(), chroms: list[str] | None = None,
    gate: StdGate | None = None, trim: ExonTrim = ExonTrim(), **kw
) -> DataFrame:
    """Cores (chrom, start, end, jaccard, confidence, valleys, splits, isoseq_validated) of all seeds.

    Cores found from several seeds are reported once, the longest first.
    """
    mapped = alignments.where(is_mapped())
    if chroms is not None:
        mapped = mapped.where(F.col("chrom").isin(list(chroms)))
    mapped = mapped.withColumn("strand", F.when(is_reverse(), "-").otherwise("+"))
    sr = materialize(seed_reads(alignments, seeds, **kw))
    own = materialize(mapped.join(sr.select("read_id").distinct(), "read_id", "left_semi"))
    tied = materialize(own.select("read_id", "chrom", "start", "end").join(sr, "read_id"))
    found = cluster_alignments(tied, p.cluster_distance, p.min_reads, ("seed_ord", "chrom"))
    lid = F.concat_ws("|", F.col("seed_ord").cast("string"), "chrom", F.col("start").cast("string"))
    loci = materialize(found.select("seed_ord", "chrom", "start", "end").withColumn(KEY, lid))
    inside = interval_join(
        tied, loci.select("seed_ord", "chrom", KEY, F.col("start").alias("q_start"), F.col("end").alias("q_end")),
        keys=("seed_ord", "chrom"), **kw,
    )
    members = materialize(inside.select(KEY, "read_id").distinct())
    decided, counts = accepted_valleys(mapped, own, loci, members, p, **kw)
    decided = materialize(decided)
    cuts = decided.where("split").withColumn("is_significant", F.lit(True))
    params = fixed_valley_params(loci, p.peak_frac, p.min_gap_bp, p.min_segment_bp)
    segs = split_by_valleys(loci.select(KEY, "chrom", "start", "end"), cuts, params)
    segs = segs.withColumnRenamed(KEY, "parent").withColumn(KEY, F.concat_ws("/", "parent", F.col("piece").cast("string")))
    segs = materialize(segs.join(loci.select(F.col(KEY).alias("parent"), "seed_ord"), "parent"))

    def reads_of(s):
        reg = s.select("seed_ord", "chrom", KEY, "parent", F.col("start").alias("q_start"), F.col("end").alias("q_end"))
        hit = interval_join(tied, reg, keys=("seed_ord", "chrom"), **kw)
        pm = members.withColumnRenamed(KEY, "parent")
        return hit.join(pm, ["parent", "read_id"], "left_semi").select("seed_ord", KEY, "read_id").distinct()

    reads = reads_of(segs)
    if p.exon_trim:
        moved = exon_trim(mapped, segs, reads.select(KEY, "read_id"), trim, **kw)
        segs = materialize(segs.join(moved, KEY).withColumn("start", F.col("new_start")).withColumn("end", F.col("new_end")).drop("new_start", "new_end"))
        reads = reads_of(segs)
    sim = jaccard_to_reference(reads, sr, ("seed_ord",)).select(KEY, "jaccard", "n_reads", "shared")
    per = decided.groupBy(F.col(KEY).alias("parent")).agg(
        F.count_if("split").alias("splits"), F.count_if("validated").alias("n_val")
    )
    d = (
        segs.join(sim, KEY, "left")
        .join(per, "parent", "left")
        .join(counts.withColumnRenamed(KEY, "parent"), "parent", "left")
        .na.fill(0, ["splits", "n_val", "valleys", "significant", "n_reads", "shared"])
        .na.fill(0.0, ["jaccard"])
    )
    whole = F.col("splits") == 0
    cores = materialize(d.select(
        KEY, "chrom", "start", "end", "jaccard", "n_reads", "shared",
        F.when(whole | (F.col("splits") == F.col("significant")) | (F.col("n_val") == 0), "HIGH").otherwise("MEDIUM").alias("confidence"),
        "valleys", "splits", (~whole & (F.col("n_val") > 0)).alias("isoseq_validated"),
    ))
    # Longest first, then the first seed; one total order so that reruns agree.
    cores = materialize(drop_covered(cores))
    if gate is not None:
        cores = std_gate_filter(mapped, cores.withColumn("is_seed", F.lit(False)), gate, **kw).drop("is_seed")
    return cores

