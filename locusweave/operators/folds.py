"""Order-dependent folds: a sorted stream per group, with only the fold's own state in memory.

Groups are hash-partitioned and sorted by Spark; the Python side walks the sorted stream batch by
batch and never holds a group.  Callers choose groups outside which rows cannot influence each other
(overlap islands, strands, loci), which keeps them small and the work spread out.
"""

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from locusweave.operators.interval_join import interval_join
from locusweave.operators.islands import islands, with_island
from locusweave.operators.leaders import dropped_by_order, keep_apart
from locusweave.session import materialize

BATCH = 4096


def ordered_fold(
    df: DataFrame,
    by: list[str],
    order: list,
    fn: Callable[[Iterator[dict]], Iterable[dict]],
    schema: StructType,
) -> DataFrame:
    """Run ``fn`` over the rows of each group in ``order``; it yields dicts holding the non-key output."""
    out_schema = to_arrow_schema(schema)
    keys = tuple(by)

    def run(batches):
        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        pending = []
        for key, group in groupby(rows(), key=lambda r: tuple(r[k] for k in keys)):
            head = dict(zip(keys, key))
            for out in fn(group):
                pending.append({**head, **out})
                if len(pending) >= BATCH:
                    yield pa.RecordBatch.from_pylist(pending, schema=out_schema)
                    pending = []
        if pending:
            yield pa.RecordBatch.from_pylist(pending, schema=out_schema)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def overlap_groups(df: DataFrame, keys: tuple[str, ...] = ("chrom",), gap: int = 0, strict: bool = True) -> DataFrame:
    """``df`` with ``grp``: the start of the island of overlapping intervals a row belongs to."""
    df = materialize(df)
    found = islands(df, gap, keys=keys, strict=strict)
    return with_island(df, found, keys=keys, strict=strict).withColumnRenamed("island", "grp")


def _keep_larger(rows):
    kept = []
    for r in rows:
        at = next(
            (i for i, k in enumerate(kept) if k["start"] < r["end"] and r["start"] < k["end"]), None
        )
        if at is None:
            kept.append(r)
        elif r["end"] - r["start"] > kept[at]["end"] - kept[at]["start"]:
            kept.pop(at)
            kept.append(r)
    return kept


def keep_larger(loci: DataFrame, order: list) -> DataFrame:
    """Overlap dedup in ``order``: a longer locus replaces the first kept one it overlaps, a shorter is dropped."""
    cols = loci.columns
    grouped = overlap_groups(loci)
    schema = grouped.select("chrom", "grp", *[c for c in cols if c != "chrom"]).schema
    return ordered_fold(grouped, ["chrom", "grp"], order, _keep_larger, schema).select(*cols)


def _near(value, spots, tolerance):
    """Whether a kept value lies closer than ``tolerance``; ``spots`` holds kept values by bucket."""
    b = value // tolerance
    return any(abs(v - value) < tolerance for k in (b - 1, b, b + 1) for v in spots.get(k, ()))


def drop_near_either(tolerance):
    """Fold that keeps a row unless a kept one is closer than ``tolerance`` at either end."""

    def fold(rows):
        starts, ends = {}, {}
        for r in rows:
            if not (_near(r["start"], starts, tolerance) or _near(r["end"], ends, tolerance)):
                starts.setdefault(r["start"] // tolerance, []).append(r["start"])
                ends.setdefault(r["end"] // tolerance, []).append(r["end"])
                yield r

    return fold


def _drop_near_both(tolerance):
    def fold(rows):
        kept = {}
        for r in rows:
            a, b = r["start"] // tolerance, r["end"] // tolerance
            near = (k for i in (a - 1, a, a + 1) for j in (b - 1, b, b + 1) for k in kept.get((i, j), ()))
            if not any(abs(s - r["start"]) < tolerance and abs(e - r["end"]) < tolerance for s, e in near):
                kept.setdefault((a, b), []).append((r["start"], r["end"]))
                yield r

    return fold


def drop_near_duplicates(loci: DataFrame, order: list[str], tolerance: int, both: bool = False) -> DataFrame:
    """Keep a row unless a kept one of its chromosome is closer than ``tolerance`` at either (or both) ends.

    With ``both``, rows influence each other only through chains of near starts, which are the
    groups of a fold.  The either-end rule is settled by rounds (``keep_apart``).
    """
    if not both:
        return keep_apart(loci, order, tolerance)
    cols = loci.columns
    loci = materialize(loci)
    points = loci.withColumn("_pe", F.col("start"))
    found = islands(points, tolerance - 1, end="_pe")
    grouped = with_island(loci, found).withColumnRenamed("island", "grp")
    schema = grouped.select("chrom", "grp", *[c for c in cols if c != "chrom"]).schema
    return ordered_fold(grouped, ["chrom", "grp"], order, _drop_near_both(tolerance), schema).select(*cols)


def drop_covered(cores: DataFrame, frac: float = 0.8) -> DataFrame:
    """Longest first, then by start, drop a core that shares >= ``frac`` of the smaller span with a kept one.

    Equal intervals conflict only with each other's partners and each other, so the first stands for all.
    """
    cols = cores.columns
    span = F.col("end") - F.col("start")
    place = F.struct((-span).alias("span"), *[F.col(c) for c in ("start", *(c for c in cols if c != "start"))])
    first = cores.groupBy("chrom", "start", "end").agg(F.min(place).alias("_at"))
    first = materialize(first.select(*[F.col(f"_at.{c}").alias(c) for c in cols], "_at", F.concat_ws(":", "chrom", "start", "end").alias("_id")))
    slim = first.select("chrom", "start", "end", F.col("_id").alias("second"), F.col("_at").alias("at"))
    earlier = first.select("chrom", F.col("start").alias("q_start"), F.col("end").alias("q_end"), F.col("_id").alias("first"), F.col("_at").alias("before"))
    shared = F.least("end", "q_end") - F.greatest("start", "q_start")
    # The later one of a pair is the shorter, or as long, so its span is the smaller one.
    pairs = interval_join(slim, earlier, mode="half_open").where((F.col("before") < F.col("at")) & (shared > 0) & (shared >= frac * span))
    gone = dropped_by_order(pairs)
    return first.join(gone.withColumnRenamed("node", "_id"), "_id", "left_anti").select(*cols)


def _runs_of_adjacent(max_gap, min_jaccard):
    def fold(rows):
        head, end, best = None, 0, 0.0
        for r in rows:
            joins = (
                head is not None
                and 0 <= r["start"] - end <= max_gap
                and best >= min_jaccard
                and r["jaccard"] >= min_jaccard
            )
            if joins:
                end, best = max(end, r["end"]), max(best, r["jaccard"])
            else:
                head, end, best = r["locus_id"], r["end"], r["jaccard"]
            yield {"locus_id": r["locus_id"], "merged_id": head}

    return fold


def adjacent_runs(loci: DataFrame, max_gap: int, min_jaccard: float) -> DataFrame:
    """(locus_id, merged_id): runs of loci at most ``max_gap`` apart whose Jaccards reach ``min_jaccard``.

    The running Jaccard of a run is its maximum.  ``merged_id`` is the first locus of the run.
    """
    loci = materialize(loci)
    grouped = with_island(loci, islands(loci, max_gap)).withColumnRenamed("island", "grp")
    schema = grouped.select("chrom", "grp", "locus_id", F.col("locus_id").alias("merged_id")).schema
    runs = ordered_fold(
        grouped.select("chrom", "grp", "locus_id", "start", "end", "jaccard"),
        ["chrom", "grp"], ["start", "end"], _runs_of_adjacent(max_gap, min_jaccard), schema,
    )
    return runs.select("locus_id", "merged_id")


def merge_adjacent(
    loci: DataFrame, members: DataFrame, max_gap: int, min_jaccard: float
) -> tuple[DataFrame, DataFrame]:
    """Merge adjacent similar loci (locus_id, chrom, start, end, jaccard, component) and their read sets."""
    runs = adjacent_runs(loci, max_gap, min_jaccard)
    merged = loci.join(runs, "locus_id").groupBy(F.col("merged_id").alias("locus_id"), "chrom").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max("jaccard").alias("jaccard"),
        F.min_by("component", "start").alias("component"),
        F.count(F.lit(1)).alias("n_merged"),
    )
    reads = members.join(runs, "locus_id").select(F.col("merged_id").alias("locus_id"), "read_id").distinct()
    return merged, reads


def first_per(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in ``order``; a combinable aggregate when ``order`` is ascending columns."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
