"""Keep the alignment table current as new alignment files land: the index refresh as a file stream."""

from pyspark.sql import SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from locusweave.sources.index import index_path, kept_records


def refresh_index(
    spark: SparkSession, landing: str, root: str, checkpoint: str, schema, include_secondary: bool = False,
    include_supplementary: bool = False,
) -> StreamingQuery:
    """Append all files not yet seen to the table of these flags, then stop."""
    fresh = spark.readStream.schema(schema).parquet(landing)
    rows = kept_records(fresh, include_secondary, include_supplementary)
    return (
        rows.writeStream.partitionBy("chrom")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(index_path(root, include_secondary, include_supplementary), format="parquet", outputMode="append")
    )
