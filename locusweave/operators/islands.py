"""Gaps-and-islands clustering that never sorts a whole chromosome's rows in one task.

Rows are first collapsed to one row per distinct start (a combinable aggregate), so a pile-up on
one position costs one row.  The coordinate axis is cut into tiles and the row-level window sees
one tile, i.e. at most ``tile`` rows.  The running maximum end of all earlier tiles enters a tile as
one extra row; it comes from a window over tiles, of which a chromosome has axis / tile.  What is
left are island pieces; pieces continuing an island of an earlier tile are tied to it by a window
over pieces, at most axis / gap per chromosome.  No window grows with the number of alignments.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 20
POINT_BIN = 8192


def islands(
    df: DataFrame,
    gap: int,
    keys: tuple[str, ...] = ("chrom",),
    start: str = "start",
    end: str = "end",
    strict: bool = False,
    gap_col: str | None = None,
    tile: int = TILE,
) -> DataFrame:
    """Islands as (keys, start, end, n_rows).

    A row opens a new island when ``start - running_max_end > gap`` (``>= gap`` if ``strict``).
    ``gap_col`` names a column, constant per key, that replaces ``gap``.
    """
    keys = list(keys)
    src = df.select(
        *keys, F.col(start).alias("_s"), F.col(end).alias("_e"),
        F.floor(F.col(start) / F.lit(tile)).alias("_tile"),
        *([F.col(gap_col).alias("_gap")] if gap_col else []),
    )
    limit = [F.first("_gap").alias("_gap")] if gap_col else []
    points = src.groupBy(*keys, "_tile", "_s").agg(F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"), *limit)
    over_tiles = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        src.groupBy(*keys, "_tile")
        .agg(F.max("_e").alias("_e"))
        .withColumn("_e", F.max("_e").over(over_tiles))
        .where("_e IS NOT NULL")
        .select(*keys, "_tile", F.lit(None).cast("bigint").alias("_s"), "_e", F.lit(0).cast("bigint").alias("_n"),
                *([F.lit(None).cast("bigint").alias("_gap")] if gap_col else []))
    )
    in_tile = Window.partitionBy(*keys, "_tile").orderBy(F.col("_s").asc_nulls_first())
    dist = F.col("_s") - F.col("_running")
    bound = F.col("_gap") if gap_col else F.lit(gap)
    opens = F.col("_running").isNull() | ((dist >= bound) if strict else (dist > bound))
    pieces = (
        points.unionByName(carried)
        .withColumn("_running", F.max("_e").over(in_tile.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_open", F.when(F.col("_s").isNotNull() & opens, F.col("_s")))
        .withColumn("_piece", F.last("_open", ignorenulls=True).over(in_tile.rowsBetween(Window.unboundedPreceding, 0)))
        .where("_s IS NOT NULL")
        .groupBy(*keys, "_tile", "_piece")
        .agg(F.max("_e").alias("_e"), F.sum("_n").alias("_n"))
    )
    over_pieces = Window.partitionBy(*keys).orderBy("_tile", F.col("_piece").asc_nulls_first())
    tied = pieces.withColumn(
        "island", F.last("_piece", ignorenulls=True).over(over_pieces.rowsBetween(Window.unboundedPreceding, 0))
    )
    return tied.groupBy(*keys, F.col("island").alias("start")).agg(
        F.max("_e").alias("end"), F.sum("_n").alias("n_rows")
    )


def with_island(
    df: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("chrom",), start: str = "start",
    cols: tuple[str, ...] = (), bin_width: int = POINT_BIN, strict: bool = False,
) -> DataFrame:
    """``df`` with the ``island`` (its start) each row's start lies in, plus ``cols`` of the island.

    Islands are disjoint, so a row meets exactly one; only islands are exploded over bins.  ``strict``
    islands may touch: there a row at an island's end belongs to the next one.
    """
    keys = list(keys)
    inside = F.col(start) <= F.col("_iend")
    if strict:
        inside = (F.col(start) < F.col("_iend")) | (F.col(start) == F.col("island"))
    cover = found.select(
        *keys, F.col("start").alias("island"), F.col("end").alias("_iend"), *cols,
        F.explode(F.sequence(F.floor(F.col("start") / F.lit(bin_width)), F.floor(F.col("end") / F.lit(bin_width)))).alias("_pb"),
    )
    # The planner takes the exploded islands for as small as the islands; a broadcast of them may not fit the driver.
    return (
        df.withColumn("_pb", F.floor(F.col(start) / F.lit(bin_width)))
        .join(cover.hint("merge"), [*keys, "_pb"])
        .where((F.col(start) >= F.col("island")) & inside)
        .drop("_pb", "_iend")
    )


def island_members(
    df: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("chrom",), member: str = "read_id",
    cols: tuple[str, ...] = (), **kw,
) -> DataFrame:
    """Distinct (keys, island, cols, member) of the rows inside each island."""
    slim = df.select(*keys, kw.get("start", "start"), member)
    return with_island(slim, found, keys, cols=cols, **kw).select(*keys, "island", *cols, member).distinct()
