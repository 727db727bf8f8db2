"""Adaptive reseeding: detect from one seed, then add seeds from disconnected or promising regions."""

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.config import Detect, Explore
from locusweave.functions.intervals import is_mapped, jaccard, usable
from locusweave.operators.cluster import cluster_alignments, locus_id
from locusweave.operators.coverage import genome_bins
from locusweave.operators.folds import drop_near_duplicates, first_per
from locusweave.operators.interval_join import as_regions, interval_join
from locusweave.operators.islands import island_members
from locusweave.operators.readsets import alignments_of_reads, outside_regions
from locusweave.operators.transcripts import transcript_summary
from locusweave.plans.detect import component_candidates, detect_single_seed, reachable_loci
from locusweave.plans.seeds import novel_regions
from locusweave.session import materialize

KEY = "locus_id"
FEATURES = ("f_reads", "f_span", "f_density", "f_tx", "f_std")


def locus_features(alignments: DataFrame, loci: DataFrame, **kw) -> DataFrame:
    """Five log features per locus (locus_id, chrom, start, end, n_reads)."""
    s = transcript_summary(alignments, loci, **kw).select(KEY, "total", "coverage_std")
    span = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    density = F.col("n_reads") / F.greatest(span / 1000.0, F.lit(1.0))
    return loci.join(s, KEY).select(
        KEY,
        F.log1p("n_reads").alias("f_reads"),
        F.log1p(span).alias("f_span"),
        F.log1p(density).alias("f_density"),
        F.log1p("total").alias("f_tx"),
        F.log1p("coverage_std").alias("f_std"),
    )


def skeleton_model(features: DataFrame) -> DataFrame:
    """One row of means and spreads (at least 0.2) per feature; no row from fewer than two loci."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in FEATURES:
        aggs += [F.avg(f).alias(f"m_{f}"), F.greatest(F.stddev_pop(f), F.lit(0.20)).alias(f"s_{f}")]
    return features.agg(*aggs).where("n >= 2").drop("n")


def skeleton_scores(features: DataFrame, model: DataFrame) -> DataFrame:
    """(locus_id, skeleton): 1 / (1 + mean absolute z)."""
    z = sum((F.abs(F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}") for f in FEATURES), F.lit(0.0)) / len(FEATURES)
    # The model is a single row.
    return features.join(F.broadcast(model)).select(KEY, (1.0 / (1.0 + z)).alias("skeleton"))


def _near_seed_ids(loci: DataFrame, seeds: DataFrame, reach: int = 20_000) -> DataFrame:
    """Ids of loci closer than ``reach`` to a seed at both ends."""
    spots = loci.select(KEY, "chrom", "start", "end", F.col("start").alias("p"))
    at = seeds.select("chrom", F.col("start").alias("q_start"), F.col("start").alias("q_end"), F.col("end").alias("seed_end"))
    near = interval_join(spots, at, item_cols=("p", "p"), pad=reach - 1)
    return near.where(F.abs(F.col("end") - F.col("seed_end")) < reach).select(KEY).distinct()


def explore_pool(
    alignments: DataFrame, discovered: DataFrame, members: DataFrame, seeds: DataFrame, params: Detect, x: Explore,
    model: DataFrame | None = None, **kw
) -> DataFrame:
    """New seeds (chrom, start, end, name) from regions the discovered reads also map to.

    Ranked by reads, then span.  Strict mode adds gates on span, similarity, score, skeleton fit and
    distance, and takes one seed per chromosome.
    """
    pool = materialize(members.select("read_id").distinct())
    known = discovered.select("chrom", "start", "end").unionByName(seeds.select("chrom", "start", "end"))
    aln = materialize(
        outside_regions(
            alignments_of_reads(alignments.where(usable(params.include_supplementary)), pool).select("read_id", "chrom", "start", "end"),
            as_regions(known),
        )
    )
    found = cluster_alignments(aln, params.cluster_distance, params.min_reads)
    reads = island_members(aln, found)
    n = reads.groupBy("chrom", F.col("island").alias("start")).agg(F.count(F.lit(1)).alias("n_reads"))
    n_pool = pool.agg(F.count(F.lit(1)).alias("n_pool"))
    c = materialize(
        found.join(n, ["chrom", "start"]).withColumn(KEY, locus_id()).join(F.broadcast(n_pool))
        .where(F.col("n_reads") >= x.min_component_reads)
    )
    span = F.col("end") - F.col("start")
    order = [F.desc("n_reads"), F.desc(span), "chrom", "start"]
    if x.strict:
        # Every read of these loci is a pool read, so the shared fraction is 1.
        sim = jaccard("n_reads", "n_reads", "n_pool")
        density = F.col("n_reads") / F.greatest(span / 1000.0, F.lit(1.0))
        score = 0.50 * sim + F.lit(0.35) + 0.15 * F.least(density / 20.0, F.lit(1.0))
        c = c.where(
            (span <= x.max_span) & (span >= 1000) & (sim >= x.min_jaccard) & F.lit(x.min_shared_frac <= 1.0) & (score >= x.min_score)
        )
        if model is not None:
            top = materialize(c if x.skeleton_top_k is None else c.orderBy(*order).limit(x.skeleton_top_k))
            fit = skeleton_scores(locus_features(alignments, top, **kw), model).where(F.col("skeleton") >= x.skeleton_min_score)
            c = top.join(fit.select(KEY), KEY, "left_semi")
    c = c.join(_near_seed_ids(c, seeds), KEY, "left_anti")
    if x.strict:
        c = first_per(novel_regions(c, known, x.novel_distance), ["chrom"], order)
    best = c.orderBy(*order).limit(x.max_new_seeds)
    return best.select("chrom", "start", "end", F.concat(F.lit("explore_seed_"), F.col("n_reads").cast("string")).alias("name"))


def propose_hotspots(
    alignments: DataFrame, discovered: DataFrame, members: DataFrame, seeds: DataFrame, per_seed: DataFrame, x: Explore,
    chrom_lengths: DataFrame | None = None,
) -> DataFrame:
    """New seeds from genome bins with many reads, many of them already discovered.

    ``per_seed`` holds (seed_ord, chrom, start, end): a bin needs loci of several seeds nearby.
    """
    size = max(x.hotspot_bin, 1000)
    bins = genome_bins(alignments.where(is_mapped()), members.select("read_id").distinct(), size)
    h = bins.where(
        (F.col("n_total") >= x.hotspot_min_reads) & (F.col("n_shared") / F.col("n_total") >= x.hotspot_min_shared_frac)
    ).withColumn("start", F.col("bin") * size + 1).withColumn("end", (F.col("bin") + 1) * size)
    if chrom_lengths is not None:
        h = h.join(chrom_lengths, "chrom").withColumn("end", F.least("end", "length")).drop("length")
    span = F.col("end") - F.col("start")
    known = discovered.select("chrom", "start", "end").unionByName(seeds.select("chrom", "start", "end"))
    h = materialize(novel_regions(h.where((span <= x.max_span) & (span >= 1000)), known, x.novel_distance))
    near = interval_join(h, as_regions(per_seed, "seed_ord"), pad=x.hotspot_gap)
    support = near.groupBy("chrom", "start").agg(F.count_distinct("seed_ord").alias("n_support"))
    order = [F.desc("n_shared"), F.desc("n_total"), "chrom", "start"]
    ok = h.join(support, ["chrom", "start"]).where(F.col("n_support") >= x.hotspot_min_seeds)
    best = first_per(ok, ["chrom"], order).orderBy(*order).limit(min(x.hotspot_top_k or x.max_new_seeds, x.max_new_seeds))
    name = F.concat_ws("_", F.lit("hotspot_seed"), "n_total", "n_shared", F.concat(F.lit("s"), F.col("n_support").cast("string")))
    return best.select("chrom", "start", "end", name.alias("name"))


def detect_adaptive(
    alignments: DataFrame, seeds: DataFrame, params: Detect = Detect(), x: Explore = Explore(), chroms: list[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rounds of detection and reseeding from the first seed.  Returns (loci, members, seeds used).

    A round runs all seeds in one plan.  Only seed rows, at most ``max_new_seeds`` per round, and a
    count of loci steer the loop.
    """
    first = seeds.select(F.min("seed_ord").alias("seed_ord"))
    current = materialize(seeds.join(first, "seed_ord", "left_semi").select("seed_ord", "chrom", "start", "end", "name"))
    kw = {"bin_width": params.bin_width}
    previous = 0
    last_chrom = None
    for round_ in count(1):
        g = detect_single_seed(alignments, current, params, chroms)
        per_seed = materialize(reachable_loci(g))
        loci = materialize(drop_near_duplicates(per_seed, ["seed_ord", "distance", "start"], 5000))
        members = g.members.join(loci.select("seed_ord", KEY), ["seed_ord", KEY], "left_semi").select(KEY, "read_id")
        n = loci.count()
        if x.strict and x.max_growth is not None and previous and n / previous > x.max_growth:
            break
        previous = n
        if round_ == x.max_rounds:
            break
        cand = component_candidates(g).where(F.col("total_reads") >= x.min_component_reads)
        cand = cand.join(_near_seed_ids(cand, current), KEY, "left_anti")
        cand = interval_join(cand, as_regions(loci), how="left_anti")
        span = F.col("end") - F.col("start")
        if x.strict:
            cand = cand.where((span <= x.max_span) & (span >= 1000))
            if last_chrom is not None:
                cand = cand.where(F.col("chrom") != last_chrom)
        new = cand.orderBy(F.desc("total_reads"), F.desc("component_size"), F.desc("n_reads"), "chrom", "start").limit(
            x.max_new_seeds
        ).select("chrom", "start", "end", F.concat_ws("_", F.lit("cc_seed"), "component_size", "total_reads").alias("name"))
        new = materialize(new)
        if new.isEmpty():
            model = None
            if x.strict and x.skeleton:
                model = materialize(skeleton_model(locus_features(alignments, loci.where("distance <= 1"), **kw)))
                model = None if model.isEmpty() else model
            new = materialize(explore_pool(alignments, loci, members, current, params, x, model, **kw))
            if new.isEmpty() and x.strict and x.hotspots:
                new = materialize(propose_hotspots(alignments, loci, members, current, per_seed, x))
        if new.isEmpty():
            break
        if x.strict:
            last_chrom = new.orderBy(F.desc("chrom")).first()["chrom"]
        top = current.agg(F.max("seed_ord").alias("top"))
        rank = F.row_number().over(Window.orderBy("chrom", "start"))  # at most max_new_seeds rows
        current = materialize(
            current.unionByName(
                new.join(F.broadcast(top)).withColumn("seed_ord", (F.col("top") + rank).cast("bigint")).drop("top")
            )
        )
    return loci, members, current
