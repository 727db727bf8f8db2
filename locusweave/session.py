"""Session settings and intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: SQL settings every plan in this package is written for.  All are runtime settings, so they
#: can be applied to a session somebody else made.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys (one read, one bin, one start position) are split by the adaptive skew join
    # even where that costs one more exchange further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "locusweave", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


#: Own key for sessions whose ``spark.checkpoint.dir`` is unset; that one cannot be set on a running session.
WORK_KEY = "spark.locusweave.workdir"


def work_folder(spark: SparkSession) -> str:
    """The shared folder intermediate tables go to: ``spark.checkpoint.dir`` of the session.

    Where that is unset, ``spark.locusweave.workdir`` is used; only a local master, where driver and tasks share one
    disk, may leave both unset and gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(WORK_KEY, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir (or {WORK_KEY}) to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-tables-")
        spark.conf.set(WORK_KEY, folder)
    return folder


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame once as a table in the work folder and go on from the table.

    Several branches of a plan, or the next round of a loop, then share one computation; the lineage ends
    at files every executor can read, so a lost executor costs only its running tasks; and the
    table's size is known when the next joins are planned.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/locusweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the intermediate tables written so far, once final results are stored."""
    while _written:
        spark, path = _written.pop()
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
