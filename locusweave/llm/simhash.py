"""SimHash near-duplicates: fingerprints over word shingles, linked by ball hashing."""

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.arrow import bounded_batches, id_and_text, slices, words_of
from locusweave.llm.balls import ball_links, component_of
from locusweave.session import materialize

_STEP = 1 << 15


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``k``-word shingle of the lower-cased (A-Z) text; fewer words: of all of them."""
    words = [w.lower() for w in words_of(text)]
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= k:
        return np.array([digest(joined, seed)], np.uint64)
    starts = [0, *ends]
    return np.array([digest(joined[a:b - 1], seed) for a, b in zip(starts, ends[k - 1:])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in more than half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i:i + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; a text without words, or a null one, has fingerprint 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [majority(shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    source = id_and_text(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, n_links.

    Fingerprints at most ``2 * radius`` bits apart link; component_id is the smallest doc_id reachable, itself
    included.  n_links is the number of other fingerprints that share a variant star with this one; equal
    fingerprints are one class.  Null and empty texts have fingerprint 0 and link like any other.  Repeated
    rows are returned as often as they come.  Rows without doc_id stay and take the component's smallest id
    (null if no member has one).  An empty table gives an empty result; other columns are ignored.
    """
    marked = materialize(fingerprints(docs, shingle))
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    links = materialize(ball_links(classes.select("fp"), radius).distinct())
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy(F.col("src").alias("fp")).agg(F.count_distinct("dst").alias("n_links"))
    labels = component_of(links).withColumnRenamed("node", "fp")
    linked = materialize(classes.join(labels, "fp").join(degree, "fp"))
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    known = linked.join(lows, "component").select("fp", "component_id", "n_links")
    of_class = classes.join(known, "fp", "left").select(
        "fp", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return marked.join(of_class, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )
