"""Transcript evidence per locus: summaries, similarity, boundary envelopes, boundary clusters."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.cigar import end_position, exon_shell, signature_similarity, splice_junctions
from locusweave.functions.intervals import is_mapped, is_primary, is_reverse
from locusweave.functions.quantiles import interpolated, two_sided
from locusweave.operators.folds import ordered_fold
from locusweave.operators.interval_join import interval_join
from locusweave.operators.islands import islands, with_island
from locusweave.session import materialize

KEY = "locus_id"
SUMMARY_BIN = 1000
READ_LENGTH = 1000  # the summary counts every read as this long


def _regions(loci: DataFrame) -> DataFrame:
    return loci.select(KEY, "chrom", F.col("start").alias("q_start"), F.col("end").alias("q_end"))


def strand_counts(alignments: DataFrame, loci: DataFrame, **kw) -> DataFrame:
    """(locus_id, total, plus, minus, strand_ratio) of mapped alignments; ratio 99 without any minus."""
    src = alignments.where(is_mapped()).select("chrom", "start", "end", is_reverse().alias("rev"))
    hits = interval_join(src, _regions(loci), **kw)
    c = hits.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("rev")).alias("plus"), F.count_if("rev").alias("minus")
    )
    d = loci.select(KEY).join(c, KEY, "left").na.fill(0, ["total", "plus", "minus"])
    return d.withColumn("strand_ratio", F.when(F.col("minus") > 0, F.col("plus") / F.col("minus")).otherwise(99.0))


def transcript_summary(alignments: DataFrame, loci: DataFrame, **kw) -> DataFrame:
    """(locus_id, total, plus, minus, mean_length, length_cv, coverage_std).

    Coverage takes every read as 1 kb from its start, so mean length is 1000 and its variation 0
    wherever there is a read.
    """
    mapped = alignments.where(is_mapped())
    counts = strand_counts(alignments, loci, **kw)
    # Look-up by true extent, coverage by the fixed extent.
    hits = interval_join(mapped.select("chrom", "start", "end"), _regions(loci), **kw)
    fixed = hits.select(KEY, "chrom", "start", (F.col("start") + READ_LENGTH).alias("end"))
    prof = _own_counts(fixed, loci, SUMMARY_BIN)
    std = prof.groupBy(KEY).agg(F.stddev_pop("cov").alias("coverage_std"))
    some = F.col("total") > 0
    return counts.join(std, KEY).select(
        KEY, "total", "plus", "minus",
        F.when(some, float(READ_LENGTH)).otherwise(0.0).alias("mean_length"),
        F.lit(0.0).alias("length_cv"),
        "coverage_std",
    )


def _own_counts(items: DataFrame, loci: DataFrame, bin_size: int) -> DataFrame:
    """Count profile of items already tied to a locus: (locus_id, bin, cov)."""
    d = items.join(loci.select(KEY, F.col("start").alias("ls"), F.col("end").alias("le")), KEY)
    rs, re = F.greatest("start", "ls"), F.least("end", "le")
    d = d.withColumn("rs", rs).withColumn("re", re).where("rs < re")
    s, e = F.expr(f"(rs - ls) div {bin_size}"), F.expr(f"(re - ls) div {bin_size}")
    steps = d.select(
        KEY,
        F.explode(F.array(F.struct(s.alias("bin"), F.lit(1).alias("v")), F.struct((e + 1).alias("bin"), F.lit(-1).alias("v")))).alias("x"),
    ).select(KEY, "x.bin", "x.v")
    n = F.expr(f"(end - start) div {bin_size}")
    spine = loci.select(KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("bin"), F.lit(0).alias("v"))
    last = loci.select(KEY, n.alias("last"))
    w = Window.partitionBy(KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    per = steps.unionByName(spine).groupBy(KEY, "bin").agg(F.sum("v").alias("v"))
    return per.withColumn("cov", F.sum("v").over(w)).join(last, KEY).where("bin <= last").select(KEY, "bin", "cov")


def summary_similarity(a: str, b: str) -> Column:
    """Similarity of a seed summary ``a`` and a target summary ``b`` (struct columns)."""
    sa = F.when(F.col(f"{a}.plus") > F.col(f"{a}.minus"), "+").otherwise("-")
    sb = F.when(F.col(f"{b}.plus") > F.col(f"{b}.minus"), "+").otherwise("-")
    la, lb = F.col(f"{a}.mean_length"), F.col(f"{b}.mean_length")
    ratio = la / F.nullif(lb, F.lit(0.0))
    length = F.when(
        (la > 0) & (lb > 0), F.when(ratio.between(0.7, 1.43), 1.0 - F.abs(ratio - 1.0)).otherwise(0.0)
    ).otherwise(0.5)
    ca, cb = F.col(f"{a}.length_cv"), F.col(f"{b}.length_cv")
    cv = F.when((ca < 0.5) & (cb < 0.5), 1.0).when((ca < 0.7) & (cb < 0.7), 0.7).otherwise(0.4)
    std = F.col(f"{b}.coverage_std")
    cov = F.when(std > 50, 1.0).when(std > 20, 0.7).when(std > 10, 0.4).otherwise(0.1)
    return F.when(sa != sb, 0.0).otherwise(length * 0.3 + cv * 0.2 + cov * 0.5)


def locus_similarity(alignments: DataFrame, pairs: DataFrame, loci: DataFrame, **kw) -> DataFrame:
    """``pairs`` (seed_locus, target_locus) with ``isoseq_sim``; both sides are summarised once."""
    s = materialize(transcript_summary(alignments, loci, **kw))
    packed = s.select(KEY, F.struct(*[c for c in s.columns if c != KEY]).alias("s"))
    a = packed.select(F.col(KEY).alias("seed_locus"), F.col("s").alias("sa"))
    b = packed.select(F.col(KEY).alias("target_locus"), F.col("s").alias("sb"))
    return pairs.join(a, "seed_locus").join(b, "target_locus").withColumn(
        "isoseq_sim", summary_similarity("sa", "sb")
    ).drop("sa", "sb")


def transcript_geometry(alignments: DataFrame, loci: DataFrame, **kw) -> DataFrame:
    """Mapped alignments of each locus: (locus_id, strand, lo, hi, exon_lo, exon_hi)."""
    src = alignments.where(is_mapped()).select(
        "chrom", "start", "end",
        F.when(is_reverse(), "-").otherwise("+").alias("strand"),
        exon_shell("start", "cigar").alias("shell"),
    )
    hits = interval_join(src, _regions(loci), **kw)
    return hits.select(
        KEY, "strand", F.col("start").alias("lo"), F.col("end").alias("hi"),
        F.coalesce("shell.start", "start").alias("exon_lo"), F.coalesce("shell.end", "end").alias("exon_hi"),
    )


def strand_exon_bounds(geometry: DataFrame, loci: DataFrame) -> DataFrame:
    """(locus_id, tx_start, tx_end): p25/p75 of the dominant strand's ends inside its exon shell; no row if empty."""
    # Both strands are summarised in one pass; the larger one, + of equals, is picked afterwards.
    per = geometry.groupBy(KEY, "strand").agg(
        F.count(F.lit(1)).alias("n"),
        interpolated("lo", 0.25).alias("a"), interpolated("hi", 0.75).alias("b"),
        interpolated("exon_lo", 0.25).alias("c"), interpolated("exon_hi", 0.75).alias("d"),
    )
    box = per.groupBy(KEY).agg(
        F.max_by(F.struct("a", "b", "c", "d"), F.struct("n", F.col("strand") == "+")).alias("x")
    ).select(KEY, "x.*")
    d = box.join(loci.select(KEY, "start", "end"), KEY)
    clamp = lambda x: F.least(F.greatest(x, F.col("start")), F.col("end"))
    return d.select(
        KEY, clamp(F.greatest("a", "c")).alias("tx_start"), clamp(F.least("b", "d")).alias("tx_end")
    ).where("tx_end > tx_start")


def percentile_bounds(geometry: DataFrame) -> DataFrame:
    """(locus_id, tx_start, tx_end): element n div 10 of the starts and 9n div 10 of the ends."""
    at = lambda n: F.floor(F.when(F.col("side") == "lo", n).otherwise(n * 9) / F.lit(10))
    return two_sided(geometry, KEY, "lo", "hi", lambda n: F.least(at(n), n - 1)).select(
        KEY, F.col("lo").alias("tx_start"), F.col("hi").alias("tx_end")
    )


def _anchors(width, inclusive):
    def fold(rows):
        anchor = None
        for r in rows:
            far = None if anchor is None else r["pos"] - anchor
            if far is None or (far > width if inclusive else far >= width):
                anchor = r["pos"]
            yield {"pos": r["pos"], "anchor": anchor}

    return fold


def anchored_clusters(points: DataFrame, keys: list[str], width: int, inclusive: bool, cut: bool = False) -> DataFrame:
    """(keys, pos, anchor) for distinct positions: a cluster reaches ``width`` from its first position.

    A gap over ``width`` always ends a cluster.  With ``cut``, for keys that span whole chromosomes, positions are first
    cut there, and each piece is walked on its own.
    """
    distinct = points.select(*keys, "pos").distinct()
    by = keys
    if cut:
        distinct = materialize(distinct)
        dots = distinct.withColumn("_pe", F.col("pos"))
        distinct = with_island(distinct, islands(dots, width, keys=tuple(keys), start="pos", end="_pe"), keys=tuple(keys), start="pos")
        by = [*keys, "island"]
    schema = distinct.select(*by, "pos").withColumn("anchor", F.col("pos")).schema
    return ordered_fold(distinct.select(*by, "pos"), by, ["pos"], _anchors(width, inclusive), schema).select(*keys, "pos", "anchor")


def site_support(hits: DataFrame, keys: list[str], slack: int, cut: bool = False) -> DataFrame:
    """(keys, center, n_reads) of sites (keys, pos, read_id): integer mean position, distinct reads."""
    a = anchored_clusters(hits, keys, slack, inclusive=True, cut=cut)
    tied = hits.join(a, [*keys, "pos"])
    center = tied.groupBy(*keys, "anchor").agg(F.sum("pos").alias("s"), F.count(F.lit(1)).alias("c"))
    reads = tied.select(*keys, "anchor", "read_id").distinct().groupBy(*keys, "anchor").agg(F.count(F.lit(1)).alias("n_reads"))
    return center.join(reads, [*keys, "anchor"]).select(*keys, F.expr("s div c").alias("center"), "n_reads")


def transcript_boundaries(alignments: DataFrame, loci: DataFrame, max_length: int = 200_000, **kw) -> DataFrame:
    """Primary transcripts of a locus up to ``max_length``: (locus_id, chrom, read_id, strand, start, end)."""
    src = alignments.where(is_mapped() & is_primary()).select(
        "read_id", "chrom", "start", "end", F.when(is_reverse(), "-").otherwise("+").alias("strand"),
        end_position("start", "cigar").alias("tx_end"),
    )
    hits = interval_join(src, _regions(loci), **kw)
    return hits.where(F.col("tx_end") - F.col("start") <= max_length).select(
        KEY, "chrom", "read_id", "strand", "start", F.col("tx_end").alias("end")
    )


def end_clusters(transcripts: DataFrame, distance: int, which: str = "tss") -> DataFrame:
    """Clusters of transcript starts (``tss``) or ends (``tes``) per strand, anchored at the outermost one.

    (locus_id, chrom, strand, anchor, start, end, n_transcripts)
    """
    at_start = F.col("strand") == ("+" if which == "tss" else "-")
    site = F.when(at_start, F.col("start")).otherwise(F.col("end"))
    # Sorted from the outer side: ascending on +, descending on -.
    t = transcripts.withColumn("pos", F.when(F.col("strand") == "+", site).otherwise(-site))
    per = t.groupBy(KEY, "chrom", "strand", "pos").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")
    )
    a = anchored_clusters(per, [KEY, "strand"], distance, inclusive=False)
    return per.join(a, [KEY, "strand", "pos"]).groupBy(KEY, "chrom", "strand", "anchor").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_transcripts")
    )


def split_by_transcripts(
    transcripts: DataFrame, loci: DataFrame, distance: int = 5000, min_transcripts: int = 10, expected: int | None = None
) -> DataFrame:
    """Gene loci (locus_id, chrom, start, end, strand, n_transcripts) from clusters of transcript starts.

    A locus with too few transcripts stays whole.  With ``expected`` genes, end clusters are used
    where their number is closer to it.
    """
    n = loci.select(KEY).join(transcripts.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")), KEY, "left").na.fill(0, ["n"])
    few = loci.join(n.where(F.col("n") < min_transcripts), KEY).select(
        KEY, "chrom", "start", "end", F.lit("+").alias("strand"), F.col("n").alias("n_transcripts")
    )
    rich = transcripts.join(n.where(F.col("n") >= min_transcripts).select(KEY), KEY, "left_semi")
    pick = lambda w: end_clusters(rich, distance, w).where(F.col("n_transcripts") >= min_transcripts)
    tss = pick("tss")
    chosen = tss
    if expected is not None:
        tes = pick("tes")
        off = lambda df, c: df.groupBy(KEY).agg(F.count(F.lit(1)).alias(c))
        both = rich.select(KEY).distinct().join(off(tss, "a"), KEY, "left").join(off(tes, "b"), KEY, "left").na.fill(0)
        ends = both.where(F.abs(F.col("b") - expected) < F.abs(F.col("a") - expected)).select(KEY)
        chosen = tss.join(ends, KEY, "left_anti").unionByName(tes.join(ends, KEY, "left_semi"))
    return few.unionByName(chosen.select(KEY, "chrom", "start", "end", "strand", "n_transcripts"))


def boundary_points(alignments: DataFrame, loci: DataFrame, **kw) -> DataFrame:
    """Both ends of every mapped alignment of a locus: (locus_id, strand, is_start, pos)."""
    src = alignments.where(is_mapped()).select("chrom", "start", "end", F.when(is_reverse(), "-").otherwise("+").alias("strand"))
    hits = interval_join(src, _regions(loci), **kw)
    plus = F.col("strand") == "+"
    return hits.select(
        KEY, "strand",
        F.explode(F.array(
            F.struct(F.lit(True).alias("is_start"), F.when(plus, F.col("start")).otherwise(F.col("end")).alias("pos")),
            F.struct(F.lit(False).alias("is_start"), F.when(plus, F.col("end")).otherwise(F.col("start")).alias("pos")),
        )).alias("x"),
    ).select(KEY, "strand", "x.is_start", "x.pos")


def boundary_clusters(points: DataFrame, distance: int = 5000, min_points: int = 20) -> DataFrame:
    """Chains of boundaries per strand and end: (locus_id, strand, is_start, position, confidence, evidence)."""
    keys = (KEY, "strand", "is_start")
    counted = points.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("c")).withColumn("pe", F.col("pos"))
    found = islands(counted, distance, keys=keys, start="pos", end="pe")
    tied = with_island(counted, found, keys=keys, start="pos")
    d = tied.groupBy(*keys, "island").agg(F.sum(F.col("pos") * F.col("c")).alias("s"), F.sum("c").alias("n"))
    label = F.concat(
        F.when(F.col("is_start"), "TSS").otherwise("TES"), F.when(F.col("strand") == "+", "_plus").otherwise("_minus")
    )
    return d.where(F.col("n") >= min_points).select(
        *keys, F.expr("s div n").alias("position"), F.least(F.lit(1.0), F.col("n") / 10.0).alias("confidence"), label.alias("evidence")
    )


def window_valleys(profile: DataFrame, window: int = 3, min_depth: float = 0.5, max_count: float = 5.0) -> DataFrame:
    """Bins at least ``min_depth`` below the mean of both neighbouring windows: (locus_id, bin, confidence)."""
    per = Window.partitionBy(KEY)
    w = per.orderBy("bin")
    d = (
        profile.withColumn("n", F.count(F.lit(1)).over(per))
        .withColumn("l", F.avg("cov").over(w.rowsBetween(-window, -1)))
        .withColumn("r", F.avg("cov").over(w.rowsBetween(1, window)))
        .where((F.col("n") >= 2 * window + 1) & (F.col("bin") >= window) & (F.col("bin") < F.col("n") - window))
        .withColumn("around", (F.col("l") + F.col("r")) / 2.0)
        .where("around > 0")
        .withColumn("confidence", 1.0 - F.col("cov") / F.col("around"))
    )
    return d.where((F.col("confidence") >= min_depth) & (F.col("cov") < max_count)).select(KEY, "bin", "confidence")


def adaptive_bin_profile(alignments: DataFrame, loci: DataFrame, min_bin: int = 1000, **kw) -> DataFrame:
    """(locus_id, bin, mid, cov) with about 100 bins per locus, ``min_bin`` long at least; parts outside count in the edge bins."""
    sized = loci.withColumn("bs", F.greatest(F.expr("(end - start) div 100"), F.lit(min_bin)))
    hits = interval_join(alignments.where(is_mapped()).select("chrom", "start", "end"), _regions(loci), **kw).join(
        sized.select(KEY, "bs"), KEY
    )
    last = F.expr("(q_end - q_start) div bs")
    bin_of = lambda c: F.least(F.expr(f"greatest({c} - q_start, 0) div bs"), last)
    steps = hits.select(
        KEY,
        F.explode(F.array(
            F.struct(bin_of("start").alias("bin"), F.lit(1).alias("v")),
            F.struct((bin_of("end") + 1).alias("bin"), F.lit(-1).alias("v")),
        )).alias("x"),
    ).select(KEY, "x.bin", "x.v")
    spine = sized.select(KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(end - start) div bs"))).alias("bin"), F.lit(0).alias("v"))
    w = Window.partitionBy(KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    per = steps.unionByName(spine).groupBy(KEY, "bin").agg(F.sum("v").alias("v"))
    return (
        per.withColumn("cov", F.sum("v").over(w))
        .join(sized.select(KEY, "start", "end", "bs"), KEY)
        .where("bin <= (end - start) div bs")
        .select(KEY, "bin", F.expr("(2 * start + (2 * bin + 1) * bs) div 2").alias("mid"), F.col("cov").cast("double").alias("cov"))
    )


def _merge_points(reach):
    def fold(rows):
        cur = None
        for r in rows:
            if cur is not None and abs(r["position"] - cur["position"]) < reach:
                total = cur["confidence"] + r["confidence"]
                mid = (cur["position"] * cur["confidence"] + r["position"] * r["confidence"]) / total
                cur = {
                    "position": int(mid),
                    "confidence": min(total, 1.0),
                    "evidence": f"{cur['evidence']}+{r['evidence']}",
                }
            else:
                if cur is not None:
                    yield cur
                cur = {k: r[k] for k in ("position", "confidence", "evidence")}
        if cur is not None:
            yield cur

    return fold


def merge_split_points(points: DataFrame, reach: int = 10_000) -> DataFrame:
    """Pull split points closer than ``reach`` together, weighted by confidence, walking left to right."""
    src = points.select(KEY, "position", "confidence", "evidence")
    return ordered_fold(src, [KEY], ["position", "evidence"], _merge_points(reach), src.schema)


def split_clouds(
    alignments: DataFrame, clouds: DataFrame, expected: int | None = None, seed_col: bool = False,
    min_bin: int = 1000, distance: int = 5000, min_points: int = 20, reach: int = 10_000, **kw
) -> DataFrame:
    """Sub-loci (locus_id, chrom, start, end, split_evidence) of clouds cut at valleys and transcript ends.

    Ends are clustered within ``distance`` and count with ``min_points``; points closer than ``reach`` become one.

    With ``expected`` genes only the most confident ``expected - 1`` points are kept, where there are
    that many.  With ``seed_col`` the clouds carry ``seed_start``/``seed_end`` (null without a seed
    inside) and the best point on either side of the seed goes first.
    """
    prof = materialize(adaptive_bin_profile(alignments, clouds, min_bin, **kw))
    valleys = window_valleys(prof).join(prof.select(KEY, "bin", "mid"), [KEY, "bin"]).select(
        KEY, F.col("mid").alias("position"), "confidence", F.lit("coverage_valley").alias("evidence")
    )
    ends = boundary_clusters(boundary_points(alignments, clouds, **kw), distance, min_points).select(KEY, "position", "confidence", "evidence")
    points = merge_split_points(valleys.unionByName(ends), reach)
    if expected is not None and expected > 1:
        w = Window.partitionBy(KEY)
        points = points.withColumn("n", F.count(F.lit(1)).over(w))
        first = F.lit(0)
        if seed_col:
            points = points.join(clouds.select(KEY, "seed_start", "seed_end"), KEY)
            side = F.when(F.col("position") < F.col("seed_start"), "up").when(F.col("position") > F.col("seed_end"), "down")
            points = points.withColumn("side", F.coalesce(side, F.lit("in")))
            best = F.row_number().over(Window.partitionBy(KEY, "side").orderBy(F.desc("confidence"), F.desc("position")))
            points = points.withColumn("lead_", (F.col("side") != "in") & F.col("seed_start").isNotNull() & (best == 1))
            first = F.when(F.col("lead_"), 0).otherwise(1)
        rank = F.row_number().over(w.orderBy(first, F.desc("confidence"), "position"))
        must = F.col("lead_") if seed_col else F.lit(False)
        points = points.withColumn("rank", rank).where(
            (F.col("n") < expected - 1) | (F.col("rank") <= expected - 1) | must
        )
    cuts = points.select(KEY, "position", "evidence")
    w = Window.partitionBy(KEY).orderBy("at")
    marks = cuts.select(KEY, F.col("position").alias("at"), "evidence").unionByName(
        clouds.select(KEY, F.col("end").alias("at"), F.lit(None).cast("string").alias("evidence"))
    )
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    d = marks.withColumn("prev", F.lag("at").over(w)).withColumn("i", F.row_number().over(w)).withColumn("n", n)
    text = (
        F.when(F.col("n") == 1, "no_clear_splits")
        .when(F.col("evidence").isNull(), "final_segment")
        .otherwise(F.concat(F.lit("split_"), F.col("i").cast("string"), F.lit(": "), F.col("evidence")))
    )
    return d.join(clouds.select(KEY, "chrom", "start"), KEY).select(
        KEY, "chrom", F.coalesce("prev", "start").alias("start"), F.col("at").alias("end"), text.alias("split_evidence")
    )


def splice_signatures(alignments: DataFrame, loci: DataFrame, **kw) -> DataFrame:
    """Junction lists of the first record of each read in a locus, spliced ones only.

    (locus_id, chrom, read_id, start, end, junctions)
    """
    src = alignments.where(is_mapped()).select("read_id", "chrom", "start", "end", "cigar")
    hits = interval_join(src, _regions(loci), **kw)
    first = hits.groupBy(KEY, "read_id").agg(
        F.min_by(F.struct("chrom", "start", "end", "cigar"), F.struct("start", "end")).alias("r")
    ).select(KEY, "read_id", "r.*")
    sig = first.withColumn("junctions", splice_junctions("start", "cigar")).where(F.size("junctions") > 0)
    return sig.select(KEY, "chrom", "read_id", "start", "end", "junctions")


def _leaders(min_similarity, tolerance):
    """Fold that keeps the patterns no kept one before is alike with; kept ones are found by the buckets of their junctions."""
    width = tolerance + 1

    def fold(rows):
        leaders, spots = [], {}
        for r in rows:
            own = [(x["start"], x["end"]) for x in r["junctions"]]
            shared: dict[int, int] = {}
            for a, b in own:
                near = {
                    i for u in (-1, 0, 1) for v in (-1, 0, 1) for i, (c, d) in spots.get((a // width + u, b // width + v), ())
                    if abs(a - c) <= tolerance and abs(b - d) <= tolerance
                }
                for i in near:
                    shared[i] = shared.get(i, 0) + 1
            if any(hit / (len(own) + leaders[i] - hit) >= min_similarity for i, hit in shared.items()):
                continue
            for a, b in own:
                spots.setdefault((a // width, b // width), []).append((len(leaders), (a, b)))
            leaders.append(len(own))
            yield r

    return fold


def splice_clusters(signatures: DataFrame, min_similarity: float = 0.3, tolerance: int = 10) -> DataFrame:
    """(locus_id, chrom, read_id, start, end, cluster): each read joins the most similar earlier pattern.

    Reads go by (start, read_id).  Only the first read of each distinct pattern can found a cluster, so these alone are
    walked.  Patterns then meet the founders they share a junction with in a join, and a read takes the best of those
    that existed at its place, the earlier founded one of equals.
    """
    src = materialize(signatures.select(KEY, "chrom", "read_id", "start", "end", "junctions"))
    group = [KEY, "chrom"]
    patterns = materialize(src.groupBy(*group, "junctions").agg(F.min(F.struct("start", "read_id")).alias("at")))
    heads = ordered_fold(patterns, group, ["at"], _leaders(min_similarity, tolerance), patterns.select(*group, "junctions", "at").schema)
    number = (F.row_number().over(Window.partitionBy(*group).orderBy("at")) - 1).cast("bigint")
    heads = materialize(heads.withColumn("cluster", number))
    width = tolerance + 1
    slot = lambda c: F.floor(F.col(f"j.{c}") / F.lit(width))
    around = F.array(*[F.struct((slot("start") + u).alias("u"), (slot("end") + v).alias("v")) for u in (-1, 0, 1) for v in (-1, 0, 1)])
    left = patterns.select(*group, "junctions", F.explode("junctions").alias("j")).select(
        *group, "junctions", slot("start").alias("u"), slot("end").alias("v"))
    right = heads.select(*group, "cluster", F.col("junctions").alias("lead"), F.col("at").alias("since"), F.explode("junctions").alias("j"))
    right = right.withColumn("k", F.explode(around)).select(*group, "cluster", "lead", "since", "k.u", "k.v")
    met = left.join(right, [*group, "u", "v"]).select(*group, "junctions", "cluster", "lead", "since").distinct()
    scored = met.withColumn("s", signature_similarity("junctions", "lead", tolerance)).where(F.col("s") >= min_similarity)
    choices = scored.groupBy(*group, "junctions").agg(F.collect_list(F.struct("s", (-F.col("cluster")).alias("less"), "since")).alias("all"))
    place = F.struct("start", "read_id")
    best = F.array_max(F.filter("all", lambda c: c["since"] <= place))
    return src.join(choices, [*group, "junctions"]).select(*group, "read_id", "start", "end", (-best["less"]).alias("cluster"))


def splice_subclouds(
    signatures: DataFrame, min_similarity: float = 0.3, min_size: int = 5, tolerance: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Sub-clouds (locus_id, chrom, cluster, start, end, n_spliced) and their common junctions.

    A junction is representative when at least half (rounded down) of the cluster's reads have it.
    """
    c = materialize(splice_clusters(signatures, min_similarity, tolerance))
    sub = c.groupBy(KEY, "chrom", "cluster").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_spliced")
    ).where(F.col("n_spliced") >= min_size)
    j = (
        c.select(KEY, "read_id", "cluster")
        .join(signatures.select(KEY, "read_id", F.explode("junctions").alias("j")), [KEY, "read_id"])
        .groupBy(KEY, "cluster", "j")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(sub.select(KEY, "cluster", "n_spliced"), [KEY, "cluster"])
        .where(F.col("n") >= F.floor(F.col("n_spliced") / F.lit(2)))
        .select(KEY, "cluster", F.col("j.start").alias("j_start"), F.col("j.end").alias("j_end"), "n")
    )
    return sub, j


def merge_subclouds(sub: DataFrame, cluster_reads: DataFrame, min_reads: int) -> DataFrame:
    """Merge overlapping sub-clouds of a chromosome; keep those with enough distinct reads."""
    sub = materialize(sub)
    found = materialize(islands(sub, 0, strict=True))
    reads = cluster_reads.join(sub.select(KEY, "cluster"), [KEY, "cluster"], "left_semi")
    n = with_island(reads.select("chrom", "start", "read_id"), found, strict=True).select("chrom", "island", "read_id").distinct()
    sizes = n.groupBy("chrom", F.col("island").alias("start")).agg(F.count(F.lit(1)).alias("n_reads"))
    spliced = with_island(sub.select("chrom", "start", "n_spliced"), found, strict=True).groupBy("chrom", F.col("island").alias("start")).agg(
        F.sum("n_spliced").alias("n_spliced")
    )
    return found.drop("n_rows").join(sizes, ["chrom", "start"]).join(spliced, ["chrom", "start"]).where(
        F.col("n_reads") >= min_reads
    )


def boundary_distribution(transcripts: DataFrame, loci: DataFrame) -> DataFrame:
    """Per locus: transcripts, by strand, distinct start and end sites, and starts per 10 kb."""
    plus = F.col("strand") == "+"
    tss = F.when(plus, F.col("start")).otherwise(F.col("end"))
    tes = F.when(plus, F.col("end")).otherwise(F.col("start"))
    t = transcripts.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_transcripts"), F.count_if(plus).alias("plus"), F.count_if(~plus).alias("minus"),
        F.count_distinct(tss).alias("n_tss"), F.count_distinct(tes).alias("n_tes"),
    )
    d = loci.select(KEY, "start", "end").join(t, KEY, "left").na.fill(0)
    span = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    return d.select(
        KEY, "n_transcripts", "plus", "minus", "n_tss", "n_tes", (F.col("n_transcripts") / span * 10_000.0).alias("per_10kb")
    )
