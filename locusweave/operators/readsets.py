"""Read-set relations: sizes, memberships, and the exact set-similarity self-join."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.intervals import jaccard, usable
from locusweave.operators.interval_join import interval_join

#: Reads found in more loci than this take the prefix-filtered tier of :func:`shared_counts`.
HOT_READ = 256


def region_reads(
    alignments: DataFrame,
    regions: DataFrame,
    mode: str = "inclusive",
    id_cols: tuple[str, ...] = ("region_id",),
    where: Column | None = None,
    **kw,
) -> DataFrame:
    """Distinct (id_cols, read_id) of the alignments overlapping each region."""
    src = alignments if where is None else alignments.where(where)
    hits = interval_join(src.select("read_id", "chrom", "start", "end"), regions, mode=mode, **kw)
    return hits.select(*id_cols, "read_id").distinct()


def pooled_reads(
    alignments: DataFrame, regions: DataFrame, mode: str = "inclusive", where: Column | None = None, **kw
) -> DataFrame:
    """Distinct reads overlapping any region."""
    src = alignments if where is None else alignments.where(where)
    hits = interval_join(
        src.select("read_id", "chrom", "start", "end"), regions, how="left_semi", mode=mode, **kw
    )
    return hits.select("read_id").distinct()


def seed_reads(alignments: DataFrame, seeds: DataFrame, include_supplementary: bool = False, **kw) -> DataFrame:
    """Reads of each seed: inclusive region query, secondary records kept."""
    regions = seeds.select(
        "seed_ord", "chrom", F.col("start").alias("q_start"), F.col("end").alias("q_end")
    )
    return region_reads(
        alignments, regions, id_cols=("seed_ord",), where=usable(include_supplementary), **kw
    )


def alignments_of_reads(alignments: DataFrame, reads: DataFrame, chroms=None) -> DataFrame:
    """All alignments of a read set; a chromosome list prunes partitions."""
    src = alignments if chroms is None else alignments.where(F.col("chrom").isin(list(chroms)))
    return src.join(reads.select("read_id"), "read_id", "left_semi")


def outside_regions(alignments: DataFrame, regions: DataFrame, mode: str = "half_open", **kw) -> DataFrame:
    """Alignments that overlap none of the regions."""
    return interval_join(alignments, regions, how="left_anti", mode=mode, **kw)


def set_sizes(members: DataFrame, keys: tuple[str, ...] = ("locus_id",)) -> DataFrame:
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reads"))


def required_overlap(n: Column, threshold: float) -> Column:
    """Fewest shared reads a set of size n needs for Jaccard >= threshold with any partner."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(threshold) - F.lit(1e-9)))


def _sided(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """``df`` keyed by one end of a pair; its value columns get the end as suffix."""
    values = [c for c in df.columns if c not in (*keys, "locus_id")]
    return df.select(*keys, F.col("locus_id").alias(side), *[F.col(c).alias(c + side) for c in values])


def _sizes_fit(threshold: float) -> Column:
    """A pair can only reach the threshold if the smaller set is at least that share of the larger one."""
    return F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - F.lit(1e-9)


def _pairs_of_light_reads(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    a = rows.select(*keys, "read_id", F.col("locus_id").alias("a"), F.col("n").alias("na"))
    b = rows.select(*keys, "read_id", F.col("locus_id").alias("b"), F.col("n").alias("nb"))
    return (
        a.join(b, [*keys, "read_id"])
        .where((F.col("a") < F.col("b")) & _sizes_fit(threshold))
        .groupBy(*keys, "a", "b", "na", "nb")
        .agg(F.count(F.lit(1)).alias("light"))
    )


def _blocked_pairs(rows: DataFrame, keys: list[str], threshold: float, hot: int) -> DataFrame:
    """Candidate pairs of hot reads; a read's loci are cut into blocks that meet pairwise."""
    blocks = F.ceil(F.col("freq") / F.lit(hot)).cast("int")
    base = rows.withColumn("blocks", blocks).withColumn(
        "blk", F.pmod(F.xxhash64("locus_id"), F.col("blocks")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = base.select(*keys, "read_id", F.col("locus_id").alias("a"), F.col("n").alias("na"),
                       F.col("blk").alias("bi"), every.alias("bj"))
    right = base.select(*keys, "read_id", F.col("locus_id").alias("b"), F.col("n").alias("nb"),
                        every.alias("bi"), F.col("blk").alias("bj"))
    return (
        left.join(right, [*keys, "read_id", "bi", "bj"])
        .where((F.col("a") < F.col("b")) & _sizes_fit(threshold))
        .select(*keys, "a", "b")
        .distinct()
    )


def shared_counts(
    members: DataFrame, threshold: float, keys: tuple[str, ...] = (), hot: int = HOT_READ
) -> DataFrame:
    """(keys, a, b, shared, na, nb) for locus pairs a < b that can reach Jaccard >= ``threshold``.

    Exact in two tiers.  Reads in at most ``hot`` loci emit the pairs whose set sizes can reach the threshold, with
    those sizes, and are counted.  For reads in more loci, pairs come only from the prefix filter: with reads ordered rare first, two sets
    reach the threshold only if they share a read among the first ``n - required + 1`` of each, so
    a hot read is expanded only for loci that cannot do without it, and block against block.
    The hot part of the overlap is then counted by probing the smaller set.  Whether any hot read
    exists is one small aggregate, run up front; without one the second tier is left out of the plan.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 links every pair of loci; use a positive one")
    keys = list(keys)
    members = members.select(*keys, "locus_id", "read_id")
    sizes = members.groupBy(*keys, "locus_id").agg(F.count(F.lit(1)).alias("n"))
    freq = members.groupBy(*keys, "read_id").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    rows = members.join(sizes, [*keys, "locus_id"]).join(freq, [*keys, "read_id"])

    light = _pairs_of_light_reads(rows.where(F.col("freq") <= hot), keys, threshold)
    needed = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    if freq.where(F.col("freq") > hot).isEmpty():
        return light.where(F.col("light") >= needed).select(*keys, "a", "b", F.col("light").alias("shared"), "na", "nb")

    hot_rows = rows.where(F.col("freq") > hot)
    by_freq = hot_rows.groupBy(*keys, "locus_id", "n", "freq").agg(F.count(F.lit(1)).alias("c"))
    per_locus = Window.partitionBy(*keys, "locus_id")
    in_prefix = (
        by_freq.withColumn("h", F.sum("c").over(per_locus))
        .withColumn(
            "rarer",
            F.coalesce(
                F.sum("c").over(per_locus.orderBy("freq").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .where(F.col("rarer") <= F.col("h") - required_overlap(F.col("n"), threshold))
        .select(*keys, "locus_id", "freq")
    )
    prefix = hot_rows.join(in_prefix, [*keys, "locus_id", "freq"])
    candidates = _blocked_pairs(prefix, keys, threshold, hot)

    n_hot = hot_rows.groupBy(*keys, "locus_id").agg(F.count(F.lit(1)).alias("h"))
    pairs = (
        light.select(*keys, "a", "b", "light")
        .unionByName(candidates.withColumn("light", F.lit(0).cast("bigint")))
        .groupBy(*keys, "a", "b")
        .agg(F.max("light").alias("light"))
    )
    info = sizes.join(n_hot, [*keys, "locus_id"], "left").withColumn("h", F.coalesce("h", F.lit(0)))
    pairs = pairs.join(_sided(info, keys, "a"), [*keys, "a"]).join(_sided(info, keys, "b"), [*keys, "b"])
    pairs = pairs.where(F.col("light") + F.least("ha", "hb") >= needed)
    to_probe = pairs.where((F.col("ha") > 0) & (F.col("hb") > 0)).select(
        *keys,
        "a",
        "b",
        F.when(F.col("ha") <= F.col("hb"), F.col("a")).otherwise(F.col("b")).alias("probe"),
        F.when(F.col("ha") <= F.col("hb"), F.col("b")).otherwise(F.col("a")).alias("other"),
    )
    slim = hot_rows.select(*keys, "locus_id", "read_id")
    hot_shared = (
        to_probe.join(slim.withColumnRenamed("locus_id", "probe"), [*keys, "probe"])
        .join(slim.withColumnRenamed("locus_id", "other"), [*keys, "other", "read_id"], "left_semi")
        .groupBy(*keys, "a", "b")
        .agg(F.count(F.lit(1)).alias("heavy"))
    )
    return (
        pairs.join(hot_shared, [*keys, "a", "b"], "left")
        .withColumn("shared", F.col("light") + F.coalesce("heavy", F.lit(0)))
        .select(*keys, "a", "b", "shared", "na", "nb")
    )


def jaccard_edges(
    members: DataFrame, threshold: float, keys: tuple[str, ...] = (), hot: int = HOT_READ
) -> DataFrame:
    """Locus pairs with Jaccard >= threshold as (keys, src, dst, shared, jaccard), src < dst."""
    return (
        shared_counts(members, threshold, keys, hot)
        .withColumn("jaccard", jaccard("shared", "na", "nb"))
        .where(F.col("jaccard") >= threshold)
        .select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"), "shared", "jaccard")
    )


def both_directions(edges: DataFrame) -> DataFrame:
    swapped = edges.select(
        *[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns]
    )
    return edges.unionByName(swapped)


def jaccard_to_reference(
    members: DataFrame, reference: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Per locus (keys, locus_id): set size, reads shared with the reference set of ``keys``, Jaccard."""
    keys = list(keys)
    ref = reference.select(*keys, "read_id").distinct()
    ref_n = ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ref"))
    marked = members.join(ref.withColumn("_hit", F.lit(1)), [*keys, "read_id"], "left")
    per = marked.groupBy(*keys, "locus_id").agg(
        F.count(F.lit(1)).alias("n_reads"), F.count("_hit").alias("shared")
    )
    # Without keys the reference size is one row.
    per = per.join(ref_n, keys) if keys else per.join(F.broadcast(ref_n))
    return per.withColumn("jaccard", jaccard("shared", "n_reads", "n_ref"))
