"""Token-id files: texts are tokenized, and their ids stored as rANS blocks in ascending doc_id order.

A file set is a folder with three tables.  ``table`` holds the shared frequencies, ``parts`` where each part's ids begin,
and ``blocks`` one self-contained rANS block per row with the doc_ids and id counts of the whole documents in
it.  Rows are written by Spark's committer, so a lost executor leaves no half block, and any block can be decoded alone.
"""

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.llm.arrow import bounded_batches, id_and_text, kept_by_worker, slices
from locusweave.llm.rans import Table, decode_block, encode_block
from locusweave.session import work_folder

#: Ids after which a block ends with the current document.
BLOCK_IDS = 1 << 20
#: Distinct pieces a worker remembers.
REMEMBERED = 600_000
#: A space before white space or a control character, or at the end: there a text is not cut into pieces.
_ODD_SPACE = r" (?:[\s\x0b\p{Z}\p{C}]|$)"
_CHUNK = 1000


class Pieces:
    """Token ids of texts by way of their distinct pieces.

    A piece is a space and what follows up to the next one.  A byte-level pattern never puts a space that is followed by
    a visible character anywhere but at the start of a match, so a text's ids are its pieces' ids in
    order, and each distinct piece is tokenized once.  Texts with any other space are tokenized whole.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.starts[i] = token.startswith("Ġ")  # how a byte-level vocabulary writes a space
        self.most = most
        self.known = pa.array([], pa.string())
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for pieces that follow a space; many are tokenized in one go and told apart by their spaces."""
        groups = [pieces[i:i + _CHUNK] for i in range(0, len(pieces), _CHUNK)]
        flats, sizes = [], []
        for group, ids in zip(groups, self.whole([" " + " ".join(g) for g in groups])):
            begins = np.flatnonzero(self.starts[ids])
            if len(begins) != len(group):
                one = self.whole([" " + p for p in group])
                ids, sizes = np.concatenate(one), [*sizes, np.array([len(i) for i in one])]
            else:
                sizes.append(np.diff(np.r_[begins, len(ids)]))
            flats.append(ids)
        return np.concatenate(flats), np.concatenate(sizes).astype(np.int64)

    def _coded(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each piece's place in a list of sizes and ids: the remembered ones, then those new here.

        New pieces are remembered until there are ``most``; frequent ones come early.
        """
        found = pc.index_in(distinct, value_set=self.known)
        missing = pc.is_null(found)
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        new = distinct.filter(missing)
        if not len(new):
            return at, self.sizes, self.flat
        flat, sizes = self._spaced(new.to_pylist())
        at[missing.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        sizes, flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        if len(sizes) <= self.most:
            self.known, self.sizes, self.flat = pa.concat_arrays([self.known, new]), sizes, flat
        return at, sizes, flat

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and their number in each text; null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~odd))
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, ids in zip(np.flatnonzero(odd), self.whole(texts.filter(pa.array(odd)).to_pylist())):
            parts[i] = ids
        if len(even):
            split = pc.split_pattern(even, " ")
            bounds = split.offsets.to_numpy()
            flat = split.values.slice(bounds[0], bounds[-1] - bounds[0])
            bounds = bounds - bounds[0]
            heads = self.whole(flat.take(pa.array(bounds[:-1])).to_pylist())
            later = np.ones(len(flat), bool)
            later[bounds[:-1]] = False
            coded = flat.filter(pa.array(later)).dictionary_encode()
            ids, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            if len(coded):
                at, of_piece, pool = self._coded(coded.dictionary)
                place = at[coded.indices.to_numpy()]
                sizes = of_piece[place]
                ends = np.cumsum(sizes)
                begin = (np.cumsum(of_piece) - of_piece)[place]
                ids = pool[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])]
            until = np.r_[0, np.cumsum(sizes)]
            pieces = np.cumsum(np.diff(bounds) - 1)
            cuts = until[np.r_[0, pieces]]
            for k, i in enumerate(np.flatnonzero(~odd)):
                parts[i] = np.concatenate([heads[k], ids[cuts[k]:cuts[k + 1]]])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array([len(p) for p in parts], np.int64)


def pieces_of(path: str) -> Pieces:
    return kept_by_worker(("pieces", path), lambda: Pieces(path))


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows (doc_id, n, packed) with the packed ids of each text, and rows (symbol, times) with each task's id counts."""
    source = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("packed", pa.binary()), ("symbol", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, pack, counts = pieces_of(path), zstandard.ZstdCompressor(level=3), np.zeros(0, np.int64)
        for batch in slices(batches, most=8 << 20):
            ids, sizes = pieces.encode(batch.column("text"))
            more = np.bincount(ids, minlength=end_id + 1)
            more[end_id] += len(sizes)
            if len(more) > len(counts):
                counts = np.pad(counts, (0, len(more) - len(counts)))
            counts[: len(more)] += more
            width = "<u2" if len(more) <= 1 << 16 else "<u4"
            ends = np.cumsum(sizes)
            rows = [width[-1].encode() + pack.compress(np.append(ids[b - n:b], end_id).astype(width).tobytes()) for n, b in zip(sizes, ends)]
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes + 1), pa.array(rows, pa.binary()), none, none], schema=schema)
        used = np.flatnonzero(counts)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(used), pa.binary()), pa.array(used), pa.array(counts[used])], schema=schema)

    return source.mapInArrow(run, "doc_id long, n long, packed binary, symbol long, times long")


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[:1].decode()}").astype(np.uint32)


def frequency_table(counts: DataFrame) -> Table:
    """The shared table; at most one row for each id of the vocabulary comes to the driver."""
    rows = counts.groupBy("symbol").agg(F.sum("times").alias("times")).orderBy("symbol").collect()
    return Table.of_counts(np.array([r.symbol for r in rows], np.int64), np.array([r.times for r in rows], np.int64))


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> str:
    """Tokenize ``docs`` and write a file set to ``folder``.

    Documents come in ascending doc_id, rows without one first, equal doc_ids by content; ``end_id`` follows each
    document, and a null or empty text is the end id alone.  Every row is written, repeated ones too.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 2500, 8 << 20)  # the piece memory is searched once for each batch
    tokenized(docs, path, end_id).write.parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")
    table = frequency_table(ids.where("symbol IS NOT NULL").select("symbol", "times"))
    spark.createDataFrame(
        list(zip(table.symbols.tolist(), table.frequencies.tolist())), "symbol long, frequency long"
    ).coalesce(1).write.parquet(f"{folder}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held, docs_held = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            symbols = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([start], pa.int64()), pa.array([len(symbols)], pa.int64()),
                 pa.array([docs_held], pa.list_(pa.int64())), pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                 pa.array([encode_block(symbols, table)], pa.binary())],
                schema=pa.schema([("part", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                                  ("sizes", pa.list_(pa.int64())), ("data", pa.binary())]),
            )

        size = 0
        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed")):
                held.append(unpacked(packed.as_py()))
                docs_held.append(doc_id)
                size += len(held[-1])
                if size >= block_ids:
                    yield block()
                    start, size, held, docs_held = start + size, 0, [], []
        if held:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        ids.where("symbol IS NULL").select("doc_id", "packed")
        .repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.xxhash64("packed"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("packed"))
        .mapInArrow(run, "part long, start long, n_ids long, doc_ids array<long>, sizes array<long>, data binary")
        .write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    )
    total, rows = 0, []
    # One row for each part, as many as there were shuffle partitions.
    for r in spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        rows.append((r.part, total))
        total += r.n
    spark.createDataFrame(rows, "part long, base long").coalesce(1).write.parquet(f"{folder}/parts")
    return folder


def stored_table(spark: SparkSession, folder: str) -> Table:
    rows = spark.read.parquet(f"{folder}/table").orderBy("symbol").collect()
    return Table(np.array([r.symbol for r in rows], np.int64), np.array([r.frequency for r in rows], np.int64))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from a file set's decoded blocks."""
    table = stored_table(spark, folder)
    names = ["doc_id", "part", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["data"], table).astype("<u4")
                ends = np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(crcs), pa.int64()), pa.array(starts + row["start"]),
                     pa.array(row["sizes"], pa.int64()), pa.array(crcs, pa.int64())], names
                )

    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "start", "doc_ids", "sizes", "data")
    found = blocks.mapInArrow(run, "doc_id long, part long, start long, n_tokens long, ids_crc32 long")
    base = spark.read.parquet(f"{folder}/parts")  # one row for each part
    return found.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )


def new_folder(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/token-files-{uuid.uuid4().hex}"
