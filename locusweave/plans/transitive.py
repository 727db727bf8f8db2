"""The default mode end to end: detection, split, filters, optional trims."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.config import ClipTail, Detect, Envelope, TightSplit
from locusweave.functions.intervals import is_mapped
from locusweave.operators.filters import (
    core_filter,
    jaccard_filter,
    mark_seed_loci,
    min_seeds_filter,
    std_gate_filter,
)
from locusweave.operators.interval_join import as_regions
from locusweave.operators.quality import quality_filter
from locusweave.operators.readsets import region_reads, seed_reads
from locusweave.operators.trims import clip_tail_trim, envelope_trim
from locusweave.plans.detect import detect_multi_seed, seed_pool
from locusweave.plans.seeds import core_reads
from locusweave.plans.split import CARRIED, preserve_seeds, split_loci, tight_resplit
from locusweave.session import materialize

COLS = ("locus_id", "chrom", "start", "end", *CARRIED)


def detect(
    alignments: DataFrame,
    seeds: DataFrame,
    params: Detect = Detect(),
    envelope: Envelope | None = None,
    tight: TightSplit | None = None,
    clip_tail: ClipTail | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Final loci (locus_id, chrom, start, end, jaccard, distance, component, n_reads) and members.

    The stages do not commute: the second seed-support filter refreshes read sets the core filter uses.
    """
    kw = {"bin_width": params.bin_width}
    mapped = alignments.where(is_mapped())
    pool = materialize(seed_pool(alignments, seeds, params))
    loci, members = detect_multi_seed(alignments, seeds, params, pool)
    by_seed = materialize(seed_reads(alignments, seeds, params.include_supplementary, **kw))
    core = materialize(core_reads(by_seed))
    many = params.min_seeds > 1 and seeds.limit(2).count() > 1

    loci = mark_seed_loci(loci.select(*COLS), seeds, **kw)
    if many:
        loci = min_seeds_filter(loci, members, by_seed, params.min_seeds)
    loci, members = split_loci(pool, loci, members, params.split, **kw)
    loci, members = preserve_seeds(mapped, loci, members, seeds, **kw)
    loci, members = materialize(loci), materialize(members)

    shared = members.join(pool.select("read_id").distinct(), "read_id", "left_semi").groupBy("locus_id").agg(
        F.count(F.lit(1)).alias("shared")
    )
    loci = mark_seed_loci(loci, seeds, **kw).join(shared, "locus_id", "left").withColumn(
        "shared", F.coalesce("shared", F.lit(0))
    )
    loci = std_gate_filter(alignments, loci, params.std_gate, params.include_supplementary, **kw).drop("shared")
    if many:
        members = materialize(region_reads(mapped, as_regions(loci, "locus_id"), id_cols=("locus_id",), **kw))
        loci = min_seeds_filter(loci, members, by_seed, params.min_seeds)
    loci = core_filter(loci, members, core, params.min_core_reads)
    loci = materialize(jaccard_filter(loci, params.min_jaccard_locus))

    if params.min_coverage_quality > 0:
        loci = quality_filter(mapped, loci, params.min_coverage_quality, params.std_gate.bin_size, **kw)
    if envelope is not None:
        loci = envelope_trim(mapped, loci, members, envelope)
    if tight is not None:
        loci, members = tight_resplit(pool, loci, members, tight, **kw)
    if clip_tail is not None:
        loci = clip_tail_trim(mapped, loci, members, clip_tail)
    n = members.groupBy("locus_id").agg(F.count(F.lit(1)).alias("n_reads"))
    out = loci.select(*COLS).join(n, "locus_id", "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0)))
    return out, members.join(out.select("locus_id"), "locus_id", "left_semi")
