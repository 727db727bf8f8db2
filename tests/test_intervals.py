"""Joins and clustering against brute force on random intervals."""

import random

import pytest
from pyspark.sql import functions as F

from locusweave.functions.intervals import interval_gap, iou_bounding, iou_union
from locusweave.operators.cluster import adaptive_gaps, cluster_alignments, cluster_by_distinct_reads
from locusweave.operators.interval_join import interval_join
from locusweave.operators.islands import island_members, islands, with_island
from locusweave.workload.reads import reads_and_longest

ALN = "rid long, read_id long, chrom string, start long, end long"


def random_alignments(seed, n=300, reach=3000, widest=200, hot=False):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = 777 if hot and i % 3 == 0 else r.randrange(reach)
        w = r.randrange(widest) if r.random() < 0.95 else r.randrange(widest * 20)
        rows.append((i, r.randrange(40), f"c{r.randrange(2)}", s, s + w))
    return rows


@pytest.mark.parametrize("mode", ["inclusive", "half_open"])
@pytest.mark.parametrize("pad", [0, 25])
def test_interval_join(spark, mode, pad):
    items = random_alignments(1)
    regions = [(i, c, s, e) for i, _, c, s, e in random_alignments(2, 60)]
    regions += [(100, "c0", 0, 10**6), (101, "c1", 500, 500)]
    got = interval_join(
        spark.createDataFrame(items, ALN),
        spark.createDataFrame(regions, "gid long, chrom string, q_start long, q_end long"),
        mode=mode, bin_width=64, pad=pad,
    )
    hit = (lambda s, e, a, b: s <= b and e >= a) if mode == "inclusive" else (lambda s, e, a, b: s < b and e > a)
    want = sorted((i[0], g[0]) for i in items for g in regions if i[2] == g[1] and hit(i[3], i[4], g[2] - pad, g[3] + pad))
    rows = got.collect()
    assert sorted((r["rid"], r["gid"]) for r in rows) == want
    assert all((r["q_start"], r["q_end"]) in {(g[2], g[3]) for g in regions} for r in rows)


def test_semi_and_anti_split_the_items(spark):
    items, regions = random_alignments(3), random_alignments(4, 10)
    df = spark.createDataFrame(items, ALN)
    reg = spark.createDataFrame([(c, s, e) for _, _, c, s, e in regions], "chrom string, q_start long, q_end long")
    hit = {i[0] for i in items for g in regions if i[2] == g[2] and i[3] < g[4] and i[4] > g[3]}
    semi = interval_join(df, reg, "left_semi", "half_open", bin_width=64).collect()
    anti = interval_join(df, reg, "left_anti", "half_open", bin_width=64).collect()
    assert sorted(r["rid"] for r in semi) == sorted(hit)
    assert sorted(r["rid"] for r in anti) == sorted({i[0] for i in items} - hit)


def brute_islands(rows, gap, strict=False):
    out = []
    for chrom in sorted({r[2] for r in rows}):
        cur = None
        for r in sorted((x for x in rows if x[2] == chrom), key=lambda x: x[3]):
            d = None if cur is None else r[3] - cur[2]
            if d is None or (d >= gap if strict else d > gap):
                cur = [chrom, r[3], r[4], 0, set()]
                out.append(cur)
            cur[2] = max(cur[2], r[4])
            cur[3] += 1
            cur[4].add(r[1])
    return out


@pytest.mark.parametrize("gap,strict", [(0, False), (0, True), (5, False), (200, False)])
@pytest.mark.parametrize("tile", [50, 1 << 20])
@pytest.mark.parametrize("hot", [False, True])
def test_islands(spark, gap, strict, tile, hot):
    rows = random_alignments(5, 120, 20_000, 60, hot)
    got = islands(spark.createDataFrame(rows, ALN), gap, strict=strict, tile=tile)
    want = sorted(tuple(x[:4]) for x in brute_islands(rows, gap, strict))
    assert sorted((r["chrom"], r["start"], r["end"], r["n_rows"]) for r in got.collect()) == want


def test_island_members_and_touching_islands(spark):
    rows = random_alignments(6, 150, 20_000, 60)
    df = spark.createDataFrame(rows, ALN)
    found = islands(df, 5)
    got = {(r["chrom"], r["island"], r["read_id"]) for r in island_members(df, found, bin_width=100).collect()}
    assert got == {(x[0], x[1], read) for x in brute_islands(rows, 5) for read in x[4]}
    touching = spark.createDataFrame([(0, 0, "c", 0, 10), (1, 0, "c", 10, 20)], ALN)
    tied = with_island(touching, islands(touching, 0, strict=True), strict=True)
    assert sorted((r["rid"], r["island"]) for r in tied.collect()) == [(0, 0), (1, 10)]


def test_clusters_and_distinct_reads(spark):
    rows = random_alignments(7, 200, 20_000, 80)
    df = spark.createDataFrame(rows, ALN)
    want = sorted(tuple(x[:4]) for x in brute_islands(rows, 20) if x[3] >= 4)
    got = cluster_alignments(df, 20, 4).collect()
    assert sorted((r["chrom"], r["start"], r["end"], r["n_rows"]) for r in got) == want
    loci, members = cluster_by_distinct_reads(df, 20, 3, 50, 5000)
    want = {(x[0], x[1]): len(x[4]) for x in brute_islands(rows, 20) if len(x[4]) >= 3 and 50 <= x[2] - x[1] <= 5000}
    assert {(r["chrom"], r["start"]): r["n_reads"] for r in loci.collect()} == want
    assert members.groupBy("chrom", "start").count().count() == len(want)


def test_adaptive_gap_across_tiles(spark):
    far = 1 << 20
    rows = [(i, 1, "c", s, s + 10) for i, s in enumerate([0, 700, 2000, far + 5, far + 3000])]
    rows += [(9, 2, "d", 0, 5)]
    got = {r["chrom"]: r["gap"] for r in adaptive_gaps(spark.createDataFrame(rows, ALN), 10_000).collect()}
    gaps = sorted([690, 1290, far + 5 - 2010, 2985])
    want = gaps[int((len(gaps) - 1) * 0.9 + 0.5)]
    assert got == {"c": max(500, min(want, 10_000)), "d": 10_000}


def test_partitioning_does_not_matter(spark):
    rows = random_alignments(8, 200, 5000, 60)
    a = islands(spark.createDataFrame(rows, ALN).repartition(7), 3).collect()
    random.Random(1).shuffle(rows)
    b = islands(spark.createDataFrame(rows, ALN).coalesce(1), 3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_measures(spark):
    d = spark.createDataFrame([(0, 10, 5, 25), (0, 10, 20, 30)], "a long, b long, c long, d long")
    got = d.select(interval_gap("a", "b", "c", "d").alias("g"), iou_bounding("a", "b", "c", "d").alias("h"),
                   iou_union("a", "b", "c", "d").alias("u")).collect()
    assert [(r.g, r.h, r.u) for r in got] == [(0, 0.2, 0.2), (10, 0.0, 0.0)]
    assert d.where(F.col("a") < F.col("b")).count() == 2


def test_long_alignments_spread_over_levels(spark):
    from locusweave.operators import interval_join as ij

    rows = [("c", i * 1_000_000, i * 1_000_000 + span) for i in range(200) for span in (500, 70_000, 900_000, 20_000_000)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long")
    keyed = ij._with_point_key(df, "start", "end", 1024)
    largest = keyed.groupBy("_lvl", "_bin").count().agg({"count": "max"}).first()[0]
    # Starts are 1 Mb apart and a bin is less than 4 spans wide, so none holds more than 80 of a length's 200.
    assert largest <= 80 and keyed.select("_lvl").distinct().count() == 4
    regions = spark.createDataFrame([("c", 5_500_000, 5_500_100), ("c", 0, 150_000_000), ("c", 199_950_000, 230_000_000)], "chrom string, q_start long, q_end long")
    got = sorted(tuple(r) for r in ij.interval_join(df, regions, bin_width=1024).collect())
    want = sorted((*a, b.q_start, b.q_end) for a in rows for b in regions.collect() if a[1] <= b.q_end and a[2] >= b.q_start)
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_exploded_regions_are_never_broadcast(spark, tmp_path, how):
    spark.createDataFrame(random_alignments(3), ALN).write.parquet(f"{tmp_path}/a")
    regions = spark.createDataFrame([(c, s, e) for _, _, c, s, e in random_alignments(4, 10)], "chrom string, q_start long, q_end long")
    regions.write.parquet(f"{tmp_path}/r")
    joined = interval_join(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/r"), how, bin_width=64)
    plan = joined._jdf.queryExecution()
    joined.collect()
    assert "Broadcast" not in plan.executedPlan().toString() and "SortMergeJoin" in plan.executedPlan().toString()


ALN_SHORT = "read_id long, chrom string, start long, end long"


def test_regions_are_exploded_over_used_levels_only(spark):
    from locusweave.operators import interval_join as ij

    ln = [(i, "c", 500 * i, 500 * i + 900) for i in range(40)]
    long = [(90, "c", 1000, 9000), (91, "c", 3000, 700_000), (92, "d", 5, 6), (None, "c", None, None)]
    region = spark.createDataFrame([("c", 2048, 4000), ("c", 9001, 9500), ("c", 650_000, 650_000), (None, 1, 2)], "chrom string, q_start long, q_end long")

    def rows_of(items):
        keyed = ij._with_point_key(spark.createDataFrame(items, ALN_SHORT), "start", "end", 1024)
        return ij._with_cover_keys(region.where("q_start = 2048"), "q_start", "q_end", 1024, ij._used_levels(keyed)).count()

    assert rows_of(ln) == 3 and rows_of([]) == 0 and rows_of(ln + [(90, "c", 1000, 9000)]) == 5
    for items in (ln, ln + long, long, []):
        df = spark.createDataFrame(items, ALN_SHORT)
        want = {(r, c, s, q.q_start) for r, c, s, e in items for q in region.collect() if c == q.chrom and s is not None and s <= q.q_end and e >= q.q_start}
        got = ij.interval_join(df, region, bin_width=1024)
        assert sorted((r.read_id, r.chrom, r.start, r.q_start) for r in got.collect()) == sorted(want)
        lost = ij.interval_join(df, region, "left_anti", bin_width=1024)
        assert lost.count() == len(items) - len({x[:3] for x in want})


def test_exploded_islands_are_not_broadcast(spark):
    """A few wide islands are many bins, whatever the planner takes their size for."""
    df = spark.createDataFrame([("c", 5_000_000 * i, f"r{i}") for i in range(40)], "chrom string, start long, read_id string")
    found = spark.createDataFrame([("c", 0, 99_999_999), ("c", 100_000_000, 180_000_000)], "chrom string, start long, end long")
    tied = with_island(df, found)
    assert {(r["island"], r["read_id"]) for r in tied.collect()} == {(100_000_000 * (i // 20), f"r{i}") for i in range(37)}
    assert "Broadcast" not in tied._jdf.queryExecution().executedPlan().toString()


def test_reads_over_genes_move_no_pairs(spark):
    wide = [(r, c, 10 * r, 10 * r + 5000) for r in range(300) for c in ("c0", "c1")] + [(None, "c0", 0, 9000)]
    genes = [(g, "c0", 10 * g, 10 * g + 50) for g in range(100)]
    genes += [(7, "c1", 70, 120), (8, "c0", 80, 130), (9, "c0", 4000, 4100), (None, "c1", 0, 10)]
    got = reads_and_longest(
        spark.createDataFrame(wide, "read_id long, chrom string, start long, end long"),
        spark.createDataFrame(genes, "gene_id long, chrom string, q_start long, q_end long"),
    )
    want = {}
    for g, c, a, b in genes:
        reads, longest = want.setdefault(g, (set(), []))
        for r, chrom, s, e in wide:
            if c == chrom and s <= b and e >= a:
                reads |= {r} - {None}
                longest.append(e - s)
    assert {r["gene_id"]: (r["n_reads"], r["longest"]) for r in got.collect()} == {g: (len(r), max(n)) for g, (r, n) in want.items()}
    # Only pairs of the genes with several regions may be told apart by read.
    once = reads_and_longest(
        spark.createDataFrame(wide, "read_id long, chrom string, start long, end long"),
        spark.createDataFrame(genes[10:100], "gene_id long, chrom string, q_start long, q_end long"),
    )
    keys = shuffled_rows(once)
    assert max(keys) < 5000


def shuffled_rows(df):
    """Rows written by each exchange of the executed plan of ``df``."""
    df.collect()
    plan = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()]
    out = []
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleQueryStageExec":
            node = node.plan()
            name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        kids = node.children()
        plan += [kids.apply(i) for i in range(kids.size())]
    return out
