"""Binned coverage of many loci at once.

The bins of a locus are cut into tiles.  An alignment adds a few change events, and one more for every further tile it
reaches into, so the running sum of a tile needs nothing from other tiles: a window holds one tile at most, however
long the locus.  Events are combined map-side per (locus, bin), so depth does not count either.  All sums are
integers; the one division per bin comes last.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators.interval_join import interval_join
from locusweave.session import materialize

#: Bins of a tile.  An alignment rarely reaches beyond two tiles.
TILE = 4096


def tile_of(bin_) -> Column:
    return F.floor(bin_ / F.lit(TILE))


def with_halo(profile: DataFrame, reach: int) -> DataFrame:
    """``profile`` with ``_tile``; rows at most ``reach`` bins from another tile are there once more, with ``_own`` false.

    ``reach`` must not exceed a tile.
    """
    b = F.col("bin")
    own, low, high = tile_of(b), tile_of(b - reach), tile_of(b + reach)
    spots = F.when(low == high, F.array(own)).otherwise(F.array_distinct(F.array(own, low, high)))
    return profile.withColumn("_tile", F.explode(spots)).withColumn("_own", F.col("_tile") == tile_of(b))


def active(first: Column, stop: Column, height: Column) -> Column:
    """Change events of a step that holds from bin ``first`` to before bin ``stop``, begun anew in each tile."""
    zero = F.lit(0).cast("bigint")
    event = lambda b, h: F.struct(b.cast("bigint").alias("bin"), zero.alias("part"), h.cast("bigint").alias("step"))
    tiles = F.sequence(tile_of(first), tile_of(stop - 1))
    # Nearly all steps lie in one tile and need no function per element, which Spark does not compile.
    ups = F.when(tile_of(first) == tile_of(stop - 1), F.array(event(first, height))).otherwise(
        F.transform(tiles, lambda t: event(F.greatest(first, t * TILE), height))
    )
    downs = F.when(stop % TILE != 0, F.array(event(stop, -height))).otherwise(F.array().cast("array<struct<bin:bigint,part:bigint,step:bigint>>"))
    return F.when(stop > first, F.concat(ups, downs)).otherwise(F.array().cast("array<struct<bin:bigint,part:bigint,step:bigint>>"))


def _clipped(
    alignments: DataFrame, loci: DataFrame, keys: list[str], cols: list[str], members: DataFrame | None = None, **kw
) -> DataFrame:
    """Overlapping parts; ``members`` (keys, read_id) limits each locus to its own reads."""
    regions = loci.select(*keys, "chrom", F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    if members is not None:
        cols = [*cols, "read_id"]
    hits = interval_join(alignments.select("chrom", "start", "end", *cols), regions, **kw)
    if members is not None:
        hits = hits.join(members, [*keys, "read_id"], "left_semi")
    return hits.withColumn("cs", F.greatest("start", "q_start")).withColumn("ce", F.least("end", "q_end"))


def _profile(
    events: DataFrame, loci: DataFrame, keys: list[str], by: list[str], bin_size: int, neighbours: bool = False
) -> DataFrame:
    """Running sums over ``events`` (keys, by, bin, part, step) on the full bin spine, with start and end of the locus.

    Only bins with an event and the first bin of each tile are moved; a bin's value holds until the next of them,
    and the bins between are filled in last, after the join with the loci.  ``neighbours`` adds the sums of the bins
    before and after (``bp_prev``, ``bp_next``) while the runs are still sorted; beyond a tile they are null.
    """
    n_bins = F.expr(f"(end - start) div {bin_size}")
    zero = F.lit(0).cast("bigint")
    heads = loci.select(*keys, n_bins.alias("_last"), F.explode(F.sequence(zero, tile_of(n_bins))).alias("_tile")).select(
        *keys, (F.col("_tile") * TILE).alias("bin"), zero.alias("part"), zero.alias("step"),
        F.least("_last", (F.col("_tile") + 1) * TILE - 1).alias("_last"),
    )
    if by:
        heads = heads.withColumn(by[0], F.explode(F.array(F.lit("+"), F.lit("-"))))
    cols = [*keys, *by, "bin", "part", "step", "_last"]
    all_events = events.withColumn("_last", F.lit(None).cast("bigint")).select(*cols).unionByName(heads.select(*cols))
    per_bin = all_events.groupBy(*keys, *by, tile_of(F.col("bin")).alias("_tile"), "bin").agg(
        F.sum("part").alias("part"), F.sum("step").alias("step"), F.max("_last").alias("_last")
    )
    tile = Window.partitionBy(*keys, *by, "_tile").orderBy("bin")
    w = tile.rowsBetween(Window.unboundedPreceding, 0)
    # The tile's last bin comes with its first; the next bin with an event ends a run before it.
    runs = per_bin.select(
        *keys, *by, "_tile", "bin", "part", F.sum("step").over(w).alias("_level"),
        F.coalesce(F.lead("bin").over(tile) - 1, F.max("_last").over(w), "bin").alias("_to"),
        F.max("_last").over(w).alias("_last"),
    )
    if neighbours:
        adjacent = F.col("bin") - F.lag("bin").over(tile) == 1
        runs = runs.withColumn("_before", F.lag("_level").over(tile) + F.when(adjacent, F.lag("part").over(tile)).otherwise(zero))
        runs = runs.withColumn("_after", F.lead(F.col("_level") + F.col("part")).over(tile))
    runs = runs.drop("_tile").join(loci.select(*keys, "start", "end"), keys)
    to = F.greatest("bin", F.least("_to", F.coalesce("_last", "bin")))
    filled = runs.withColumn("_first", F.col("bin")).withColumn("_end", to).withColumn("bin", F.explode(F.sequence("bin", "_end")))
    peak = F.col("_level") + F.col("part")
    value = F.when(F.col("bin") == F.col("_first"), peak).otherwise(F.col("_level"))
    beside = []
    if neighbours:
        before = F.when(F.col("bin") == F.col("_first"), F.col("_before")).when(F.col("bin") == F.col("_first") + 1, peak)
        beside = [
            before.otherwise(F.col("_level")).alias("bp_prev"),
            F.when(F.col("bin") < F.col("_end"), F.col("_level")).otherwise(F.col("_after")).alias("bp_next"),
        ]
    return filled.select(*keys, *by, "bin", value.alias("bp"), *beside, "start", "end")


def at_border(bin_) -> Column:
    """Whether the bin before or after is in another tile."""
    return (tile_of(bin_) != tile_of(F.greatest(bin_ - 1, F.lit(0)))) | (tile_of(bin_) != tile_of(bin_ + 1))


def with_borders(profile: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``profile`` (a written one) with ``prev`` and ``next`` right at the borders of tiles too, where two rows a side decide."""
    b, near = F.col("bin"), Window.partitionBy(*keys).orderBy("bin")
    beside = {name: F.coalesce(name, at("cov").over(near)) for name, at in (("prev", F.lag), ("next", F.lead)) if name in profile.columns}
    few = profile.where(tile_of(F.greatest(b - 2, F.lit(0))) != tile_of(b + 2)).withColumns(beside)
    return profile.where(~at_border(b)).unionByName(few.where(at_border(b)))


def coverage_fractional(
    alignments: DataFrame,
    loci: DataFrame,
    bin_size: int = 100,
    keys: tuple[str, ...] = ("locus_id",),
    by_strand: bool = False,
    neighbours: bool = False,
    **kw,
) -> DataFrame:
    """Covered fraction per bin summed over alignments: (keys, [strand], bin, bin_start, cov).

    Pass only the alignments of the query reads.  ``loci`` has (keys, chrom, start, end).  ``neighbours`` adds the values
    ``prev`` and ``next`` of the bins beside, null at the ends of a locus and at tile borders (see ``with_borders``).
    """
    keys, by = list(keys), (["strand"] if by_strand else [])
    c = _clipped(alignments, loci, keys, by, **kw).where("ce > cs")
    s, e = F.expr(f"(cs - q_start) div {bin_size}"), F.expr(f"(ce - q_start) div {bin_size}")
    c = c.withColumn("s", s).withColumn("e", e)
    zero, size = F.lit(0).cast("bigint"), F.lit(bin_size).cast("bigint")
    part = lambda b, n: F.struct(b.alias("bin"), n.alias("part"), zero.alias("step"))
    same = F.array(part(F.col("s"), F.col("ce") - F.col("cs")))
    first = part(F.col("s"), F.col("q_start") + (F.col("s") + 1) * size - F.col("cs"))
    last = part(F.col("e"), F.col("ce") - F.col("q_start") - F.col("e") * size)
    whole = active(F.col("s") + 1, F.col("e"), size)
    events = c.withColumn(
        "ev", F.explode(F.when(F.col("s") == F.col("e"), same).otherwise(F.concat(F.array(first, last), whole)))
    ).select(*keys, *by, "ev.*")
    prof = _profile(events, loci, keys, by, bin_size, neighbours)

    def fraction(bp: str, bin_: Column) -> Column:
        span = F.least(F.lit(bin_size).cast("bigint"), F.col("end") - F.col("start") - bin_ * bin_size)
        return F.when(span > 0, F.col(bp) / span).otherwise(F.when(F.col(bp).isNotNull(), F.lit(0.0)))

    beside = [fraction("bp_prev", F.col("bin") - 1).alias("prev"), fraction("bp_next", F.col("bin") + 1).alias("next")]
    return prof.select(
        *keys,
        *by,
        "bin",
        (F.col("start") + F.col("bin") * bin_size).alias("bin_start"),
        fraction("bp", F.col("bin")).alias("cov"),
        *(beside if neighbours else []),
    )


def coverage_counts(
    alignments: DataFrame,
    loci: DataFrame,
    bin_size: int = 100,
    keys: tuple[str, ...] = ("locus_id",),
    by_strand: bool = False,
    **kw,
) -> DataFrame:
    """Alignments touching each bin, end bin included: (keys, [strand], bin, bin_start, cov)."""
    keys, by = list(keys), (["strand"] if by_strand else [])
    c = _clipped(alignments, loci, keys, by, **kw)
    s, e = F.expr(f"(cs - q_start) div {bin_size}"), F.expr(f"(ce - q_start) div {bin_size}")
    c = c.withColumn("s", s).withColumn("e", e)
    last = F.expr(f"(q_end - q_start) div {bin_size}")
    c = c.withColumn("last", last).withColumn("ev", F.explode(active(F.col("s"), F.col("e") + 1, F.lit(1))))
    # An alignment up to the last bin of its locus falls in a bin that is not there.
    events = c.where("ev.bin <= last").select(*keys, *by, "ev.*")
    prof = _profile(events, loci, keys, by, bin_size)
    return prof.select(
        *keys,
        *by,
        "bin",
        (F.col("start") + F.col("bin") * bin_size).alias("bin_start"),
        F.col("bp").cast("double").alias("cov"),
    )


def coverage_stats(profile: DataFrame, keys: tuple[str, ...] = ("locus_id",)) -> DataFrame:
    """Mean, population standard deviation and maximum over all bins of a profile."""
    return profile.groupBy(*keys).agg(
        F.avg("cov").alias("mean_cov"),
        F.stddev_pop("cov").alias("std_cov"),
        F.max("cov").alias("max_cov"),
        F.sum("cov").alias("total_cov"),
        F.count(F.lit(1)).alias("n_bins"),
    )


def genome_bins(
    alignments: DataFrame, pool: DataFrame, bin_size: int = 50_000
) -> DataFrame:
    """Alignments per genome bin of their 1-based start, in total and from pooled reads."""
    marked = alignments.join(pool.select("read_id").withColumn("_hit", F.lit(1)), "read_id", "left")
    return marked.groupBy("chrom", F.expr(f"greatest(start - 1, 0) div {bin_size}").alias("bin")).agg(
        F.count(F.lit(1)).alias("n_total"), F.count("_hit").alias("n_shared")
    )


def below_threshold_runs(profile: DataFrame, frac: float, keys: tuple[str, ...] = ("locus_id",)) -> DataFrame:
    """Midpoint bins of runs below ``frac * max``; needs max >= 2, a run open at the end is dropped."""
    keys = list(keys)
    limit = F.col("mx") * F.lit(frac)
    low = F.col("cov") < limit
    tops = lambda rows: rows.groupBy(*keys).agg(F.max("cov").alias("mx")).where("mx >= 2.0")
    if "prev" in profile.columns:
        # The state flips only where the value changes; the bins that repeat the one before are left out at once.
        changed = F.col("prev").isNull() | (F.col("cov") != F.col("prev")) | at_border(F.col("bin"))
        steps = materialize(profile.where(changed).select(*keys, "bin", "cov", "prev"))
        marked = with_borders(steps, tuple(keys)).join(tops(steps), keys).select(*keys, "bin", low.alias("low"), (F.col("prev") < limit).alias("prev"))
    else:
        profile = materialize(profile.select(*keys, "bin", "cov"))
        near = Window.partitionBy(*keys, "_tile").orderBy("bin")
        marked = with_halo(profile.join(tops(profile), keys).select(*keys, "bin", low.alias("low")), 1)
        marked = marked.withColumn("prev", F.lag("low").over(near)).where("_own")
    # Rows where the state flips; a run is a flip to low followed by a flip back.
    w = Window.partitionBy(*keys).orderBy("bin")
    flips = marked.where(F.col("low") != F.coalesce("prev", F.lit(False)))
    runs = flips.withColumn("stop", F.lead("bin").over(w)).where(F.col("low") & F.col("stop").isNotNull())
    return runs.select(*keys, F.expr("(bin + stop) div 2").alias("valley_bin"))
