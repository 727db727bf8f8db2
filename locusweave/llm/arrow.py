"""Small helpers for tasks that work on Arrow batches of texts."""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The six white-space characters that end a word.
SPACES = b" \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession, rows: int = 1000, most: int = 4 << 20) -> None:
    """Keep the Arrow batches that tasks and their Python workers exchange small, also where the texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about ``most`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers live on after the task


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators need; any other column, whatever its name, is left behind."""
    return docs.select("doc_id", docs["text"].cast("string").alias("text"))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def kept_by_worker(key: tuple, make):
    """What ``make()`` gave for ``key`` in this worker process; its last two results outlive the tasks.

    They are held by the interpreter, as functions sent to a task bring module globals of their own.
    """
    kept = sys.__dict__.setdefault("_locusweave_kept", {})
    if key not in kept:
        while len(kept) >= 2:
            kept.pop(next(iter(kept)))
        kept[key] = make()
    return kept[key]
