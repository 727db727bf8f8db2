"""Graph traversal over edge tables: hop distance, connected components, representatives."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators.readsets import both_directions
from locusweave.session import materialize


def hop_distances(
    edges: DataFrame, sources: DataFrame, keys: tuple[str, ...] = (), max_hops: int | None = None
) -> DataFrame:
    """Breadth-first distances (keys, node, distance, bottleneck) from ``sources`` (keys, node).

    ``edges`` are undirected (keys, src, dst, jaccard), one row per pair.  Among paths of equal
    length the largest bottleneck Jaccard is kept.  One pass per hop; the visited set is the union
    of the checkpointed frontiers, so a hop never re-reads the lineage of earlier ones.
    """
    keys = list(keys)
    links = materialize(both_directions(edges.select(*keys, "src", "dst", "jaccard")))
    frontier = materialize(
        sources.select(*keys, "node").distinct()
        .withColumn("distance", F.lit(0))
        .withColumn("bottleneck", F.lit(1.0))
    )
    visited = frontier
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = (
            frontier.withColumnRenamed("node", "src")
            .join(links, [*keys, "src"])
            .groupBy(*keys, F.col("dst").alias("node"))
            .agg(F.max(F.least("bottleneck", "jaccard")).alias("bottleneck"))
            .join(visited.select(*keys, "node"), [*keys, "node"], "left_anti")
            .select(*keys, "node", F.lit(hop).alias("distance"), "bottleneck")
        )
        frontier = materialize(reached)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) with component = smallest node of each component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014).  Both only need a
    minimum per node, a combinable aggregate, so a hub costs no more than its edges.  The rounds, about the
    logarithm of the nodes in number, go on until nothing changes.  ``nodes`` adds isolated nodes.
    """
    pairs = materialize(
        edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u != v").distinct()
    )
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
        mins = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(mins, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(mins.select("u", F.col("m").alias("v")))
        )
        pairs = materialize(small.distinct())
        new_state = tuple(
            pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        )
        if new_state == state:
            break
        state = new_state
    # Settled: every non-root points straight at its root.
    labels = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = labels.unionByName(roots.join(labels, "node", "left_anti"))
    if nodes is not None:
        rest = nodes.select("node").join(out, "node", "left_anti").withColumn("component", F.col("node"))
        out = out.unionByName(rest)
    return out


def component_representatives(labels: DataFrame, loci: DataFrame, ties: str = "last") -> DataFrame:
    """Per component: the locus with most reads, component size and total reads.

    ``ties`` decides between equal read counts by locus id: ``first`` or ``last``.
    ``loci`` has (locus_id, chrom, start, end, n_reads).
    """
    best = F.struct("locus_id", "chrom", "start", "end", "n_reads")
    if ties == "last":
        pick = F.max_by(best, F.struct("n_reads", "locus_id"))
    else:
        pick = F.min_by(best, F.struct(-F.col("n_reads"), "locus_id"))
    return (
        labels.join(loci, labels["node"] == loci["locus_id"])
        .groupBy("component")
        .agg(pick.alias("best"), F.count(F.lit(1)).alias("component_size"), F.sum("n_reads").alias("total_reads"))
        .select("component", "best.*", "component_size", "total_reads")
    )


def adaptive_edge_threshold(
    pairs: DataFrame, quantile: float, min_shared: int, floor: float
) -> DataFrame:
    """One row ``threshold``: nearest-rank quantile of positive Jaccards, never below ``floor``.

    Needs at least 3 qualifying pairs.  Pairs are counted in a million fixed buckets first; only the values
    of the bucket the rank falls into are then ranked, so neither window grows with the pairs.
    """
    q = min(max(quantile, 0.0), 1.0)
    slot = F.floor(F.col("jaccard") * 1_000_000)
    ok = pairs.where((F.col("shared") >= min_shared) & (F.col("jaccard") > 0)).withColumn("slot", slot)
    counts = ok.groupBy("slot").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(Window.partitionBy())
    upto = F.sum("c").over(Window.orderBy("slot"))
    at = F.floor((F.col("n") - 1) * F.lit(q) + F.lit(0.5)) + 1
    hit = (
        counts.withColumns({"n": n, "upto": upto})
        .withColumn("rank", at - (F.col("upto") - F.col("c")))
        .where((F.col("n") >= 3) & (F.col("rank") > 0) & (F.col("rank") <= F.col("c")))
        .select("slot", "rank")
    )
    values = ok.join(F.broadcast(hit), "slot").groupBy("jaccard", "rank").agg(F.count(F.lit(1)).alias("c"))
    seen = F.sum("c").over(Window.partitionBy("rank").orderBy("jaccard"))
    picked = values.withColumn("seen", seen).where(F.col("seen") >= F.col("rank")).agg(F.min("jaccard").alias("j"))
    return picked.select(F.greatest(F.lit(floor), F.coalesce("j", F.lit(floor))).alias("threshold"))
