"""Interval joins as hash joins on a hierarchical position key.

An alignment is never duplicated: it gets one key ``(level, bin)``, where the level is the
narrowest bin width its span fits in.  Only the regions are exploded, to every bin of every level
that could hold a partner.  Each (alignment, region) pair therefore meets under exactly one key,
so inner, semi and anti joins all work without a dedup step.  A hot bin is split by the adaptive
skew join, as the alignment side carries no later requirement on that key.  The join is always a sort-merge join: sizes
the planner knows are those of the regions before they are exploded.

The levels widen by 4 until one bin spans the whole axis, so every length has a level of its own and no bin collects
all long alignments.  Regions are exploded only over the levels that hold an alignment, of all 12 or so: one aggregate
over the spans tells which.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.functions.intervals import overlaps_half_open, overlaps_inclusive

DEFAULT_BIN = 8192
_STEP = 4
#: No coordinate lies beyond this.
AXIS = 1 << 32
_LVL, _BIN = "_lvl", "_bin"


def _widths(bin_width: int) -> list[int]:
    """Bin widths of all levels, the last one at least the axis."""
    widths = [bin_width]
    while widths[-1] < AXIS:
        widths.append(widths[-1] * _STEP)
    return widths


def _with_point_key(df: DataFrame, start: str, end: str, bin_width: int) -> DataFrame:
    """One (level, bin) per interval: the narrowest level its span fits in, and the bin of its start."""
    span, widths = F.col(end) - F.col(start), _widths(bin_width)
    level = F.lit(len(widths) - 1)
    bin_ = F.floor(F.col(start) / F.lit(widths[-1]))
    for i in reversed(range(len(widths) - 1)):
        level = F.when(span <= widths[i], F.lit(i)).otherwise(level)
        bin_ = F.when(span <= widths[i], F.floor(F.col(start) / F.lit(widths[i]))).otherwise(bin_)
    return df.withColumn(_LVL, level).withColumn(_BIN, bin_)


def _at_level(bins: Column, level: int) -> Column:
    return F.transform(bins, lambda b: F.struct(F.lit(level).alias("l"), b.alias("b")))


def _used_levels(df: DataFrame) -> Column:
    """A number with bit i set if level i holds a row of ``df``, which has its point keys."""
    return df.agg(F.coalesce(F.bit_or(F.expr(f"shiftleft(1, {_LVL})")), F.lit(0))).scalar()


def _with_cover_keys(df: DataFrame, start: str, end: str, bin_width: int, used: Column) -> DataFrame:
    """All (level, bin) keys under which a partner of this region can be stored, on the ``used`` levels."""
    keys = []
    for i, w in enumerate(_widths(bin_width)):
        lo = F.floor(F.col(start) / F.lit(w)) - 1
        hi = F.greatest(F.floor(F.col(end) / F.lit(w)), lo)
        bins = F.when(F.col("_used").bitwiseAND(1 << i) != 0, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        keys.append(_at_level(bins, i))
    return (
        df.withColumn("_used", used)
        .withColumn("_k", F.explode(F.concat(*keys)))
        .withColumn(_LVL, F.col("_k.l"))
        .withColumn(_BIN, F.col("_k.b"))
        .drop("_k", "_used")
    )


def interval_join(
    items: DataFrame,
    regions: DataFrame,
    how: str = "inner",
    mode: str = "inclusive",
    keys: tuple[str, ...] = ("chrom",),
    item_cols: tuple[str, str] = ("start", "end"),
    region_cols: tuple[str, str] = ("q_start", "q_end"),
    bin_width: int = DEFAULT_BIN,
    pad: int = 0,
) -> DataFrame:
    """Join ``items`` to the ``regions`` they overlap; ``how`` is inner, left_semi, left_anti or left.

    ``pad`` widens the regions, which turns the join into a neighbour-within-distance join.
    Both sides share the ``keys`` columns; all other column names must differ.
    """
    rs, re = region_cols
    reg = regions
    if pad:
        reg = reg.withColumn(rs, F.col(rs) - pad).withColumn(re, F.col(re) + pad)
    keyed = _with_point_key(items, *item_cols, bin_width)
    left = keyed.alias("_items")
    right = _with_cover_keys(reg, rs, re, bin_width, _used_levels(keyed)).alias("_regions")
    cond = _same_keys((*keys, _LVL, _BIN))
    pred = {"inclusive": overlaps_inclusive, "half_open": overlaps_half_open}[mode]
    cond = cond & pred(
        F.col(f"_items.{item_cols[0]}"), F.col(f"_items.{item_cols[1]}"), F.col(f"_regions.{rs}"), F.col(f"_regions.{re}")
    )
    # The planner takes the exploded regions for as small as the regions; a broadcast of them would not fit the driver.
    joined = left.join(right.hint("merge"), cond, how)
    keep = [F.col(f"_items.{c}") for c in items.columns]
    if how in ("inner", "left"):
        extra = [c for c in regions.columns if c not in keys]
        for c in extra:
            if pad and c == rs:
                keep.append((F.col(f"_regions.{c}") + pad).alias(c))
            elif pad and c == re:
                keep.append((F.col(f"_regions.{c}") - pad).alias(c))
            else:
                keep.append(F.col(f"_regions.{c}"))
    return joined.select(*keep)


def _same_keys(cols) -> Column:
    cond = None
    for c in cols:
        eq = F.col(f"_items.{c}") == F.col(f"_regions.{c}")
        cond = eq if cond is None else cond & eq
    return cond


def as_regions(df: DataFrame, *cols: str) -> DataFrame:
    """Rename ``start``/``end`` to the region column names and keep ``cols``."""
    return df.select(
        *cols, "chrom", F.col("start").alias("q_start"), F.col("end").alias("q_end")
    )


def bin_lookup(items: DataFrame, regions: DataFrame, bin_size: int = 10_000) -> DataFrame:
    """Distinct reads stored in any bin a region touches: a superset lookup without exact re-check.

    A read is stored in all bins from its start to its end, so it shares a bin with a region exactly if it overlaps the
    region widened to whole bins.
    """
    whole = regions.select(
        "chrom", F.expr(f"q_start div {bin_size} * {bin_size}").alias("q_start"),
        F.expr(f"q_end div {bin_size} * {bin_size} + {bin_size - 1}").alias("q_end"),
    ).distinct()
    src = items.select("read_id", "chrom", "start", "end")
    return interval_join(src, whole, how="left_semi", mode="inclusive").select("read_id").distinct()
