"""Files in and out."""

import struct

import bamfile
from pyspark.sql import functions as F

from locusweave.session import materialize, release
from locusweave.sources import bam, index, seeds, sinks, tables
from locusweave.streaming.ingest import refresh_index


def test_bam(spark, tmp_path):
    tags = b"NMC" + bytes([3]) + b"npi" + struct.pack("<i", 12) + b"rqf" + struct.pack("<f", 0.5) + b"XXZabc\0"
    recs = [
        bamfile.record(b"r%d" % i, i % 2, 100 * i, 16 if i % 3 == 0 else 0, [("S", 2), ("M", 5), ("N", 100), ("D", 1), ("M", 3)],
                       "ACGTACGTAC", tags if i % 2 else b"")
        for i in range(20)
    ]
    recs.insert(4, bamfile.record(b"bad\xff", 0, 5, 0, [("M", 3)], "ACG"))
    recs.append(bamfile.record(b"un", -1, -1, 4, [], "ACG"))
    path = str(tmp_path / "x.bam")
    bamfile.write(path, [("c0", 5000), ("c1", 6000)], recs)
    df = bam.read_bam(spark, path, splitBytes="1")
    assert df.rdd.getNumPartitions() > 3
    rows = {r["read_id"]: r for r in df.collect()}
    assert set(rows) == {f"r{i}" for i in range(20)} | {"un"}
    r = rows["r3"]
    assert (r["chrom"], r["start"], r["end"], r["flag"], r["seq"]) == ("c1", 301, 409, 16, "ACGTACGTAC")
    assert [(c["op"], c["len"]) for c in r["cigar"]] == [("S", 2), ("M", 5), ("N", 100), ("D", 1), ("M", 3)]
    assert (r["nm"], r["np"], r["rq"], r["de"]) == (3, 12, 0.5, None)
    assert rows["r2"]["nm"] is None and rows["un"]["chrom"] is None
    assert bam.read_bam(spark, path).count() == 21
    assert {tuple(x) for x in bam.chrom_lengths(spark, path).collect()} == {("c0", 5000), ("c1", 6000)}


def test_seed_files(spark, tmp_path):
    p = tmp_path / "s.bed"
    p.write_text("#h\nc\t1\t5\tone\n\nc\t7\t9\nbad line\n")
    rows = seeds.read_seeds_bed(spark, str(p), default_names=True).orderBy("seed_ord").collect()
    assert [tuple(r) for r in rows] == [(0, "c", 1, 5, "one"), (1, "c", 7, 9, "seed_1")]
    assert [r["name"] for r in seeds.read_seeds_bed(spark, str(p)).orderBy("seed_ord").collect()] == ["one", None]
    got = seeds.seeds_from_list(spark, "c:1-5, d:e:7-9,broken").orderBy("seed_ord").collect()
    assert [tuple(r)[1:4] for r in got] == [("c", 1, 5), ("d:e", 7, 9)]


def test_gene_files(spark, tmp_path):
    p = tmp_path / "g.bed"
    p.write_text("c\t10\t90\tA|ID_1\t0\t.\nc\t100\t190\tB|ID_12\t0\t.\nd\t5\t9\tC|ID_1|x\t0\t.\ne\t1\t2\tID_1\t0\t.\n")
    got = seeds.read_genes_bed(spark, str(p), "ID_1")
    assert {r["gene_name"] for r in got.collect()} == {"A|ID_1", "C|ID_1|x", "ID_1"}
    assert {r["family_id"] for r in seeds.read_genes_bed(spark, str(p)).collect()} == {"ID_1", "ID_12", "x"}
    g = tmp_path / "g.gtf"
    g.write_text('#c\nc\tx\tgene\t11\t90\t.\t+\t.\tgene_id "A"; family_id "F";\nc\tx\texon\t11\t90\t.\t+\t.\tgene_id "A";\n')
    assert [tuple(r) for r in seeds.read_genes_gtf(spark, str(g)).collect()] == [("F", "A", "A", "c", 10, 90)]


def test_index_is_kept_per_flags(spark, sf_dir, tmp_path):
    a = tables.alignments(spark, sf_dir)
    root = str(tmp_path / "idx")
    n = index.load_or_build(spark, a, root).count()
    assert n == a.where("(flag & 2304) = 0").count()
    assert index.load_or_build(spark, a.limit(1), root).count() == n
    assert index.load_or_build(spark, a, root, True, True).count() == a.count()
    plan = index.load_index(spark, root, chroms=["chr1"]).where("start > 5000")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "GreaterThan(start" in plan


def test_stream_refresh_adds_only_new_files(spark, sf_dir, tmp_path):
    a = tables.alignments(spark, sf_dir)
    land, root, ckpt = (str(tmp_path / x) for x in ("land", "root", "ckpt"))
    for part in ("flag < 256", "flag >= 256"):
        a.where(part).write.mode("append").parquet(land)
        refresh_index(spark, land, root, ckpt, a.schema, True, True).awaitTermination()
    assert index.load_index(spark, root, True, True).count() == a.count()


def test_result_rows(spark, tmp_path):
    loci = spark.createDataFrame(
        [("b", 5, 9, 0.25, 1, 2, 7), ("a", 50, 90, 1 / 3, 0, 1, 3), ("a", 5, 9, 0.5, 0, 1, 4)],
        "chrom string, start long, end long, jaccard double, distance int, component int, n_reads long",
    )
    out = str(tmp_path / "t")
    sinks.write_table(sinks.transitive_rows(loci), out)
    text = [r["value"] for r in spark.read.text(out).collect()]
    assert "chrom\tstart\tend\tjaccard\tdistance\tcomponent\treads" in text and "a\t50\t90\t0.3333\t0\t1\t3" in text
    names = {(r["chrom"], r["start"]): r["name"] for r in sinks.fast_rows(loci).collect()}
    assert names == {("a", 5): "locus_1", ("a", 50): "locus_2", ("b", 5): "locus_3"}
    ranked = sinks.novel_rows(loci.withColumns({"family_id": F.lit("f"), "rank_score": F.col("jaccard")})).collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: -r["rank_score"])] == [1, 2, 3]
    metrics = sinks.evaluation_metrics(spark.createDataFrame([("f", 3, 66.5)], "family_id string, total_genes long, sensitivity double"))
    assert {(r["metric"], r["value"]) for r in metrics.collect()} == {("total_genes", 3.0), ("sensitivity", 66.5)}


def test_materialize_and_release(spark):
    d = materialize(spark.range(10))
    assert d.count() == 10 and "parquet" in d._jdf.queryExecution().executedPlan().toString().lower()
    release()
