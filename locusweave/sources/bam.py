"""Indexed BAM files as a Spark data source.

The ``.bai`` index next to the file gives record-aligned offsets; ranges between them become partitions,
so the file is decoded by all executors at once.  Paths may be local or any URI pyarrow can open.
Meant for the one-time load into the Parquet alignment table.
"""

import struct
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from locusweave.schema import ALIGNMENT_SCHEMA

#: CIGAR operations and base codes by number (fixed values of the BAM format).
CIGAR_OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_FORMATS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
TAG_COLUMNS = {"np": "np", "NM": "nm", "rq": "rq", "cm": "cm", "de": "de", "AS": "as_score", "rl": "rl"}
BATCH_ROWS = 4096
SPLIT_BYTES = 64 << 20


def _open(path: str):
    if "://" in path:
        where, inner = pafs.FileSystem.from_uri(path)
        return where.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(path)


class _Blocks:
    """Uncompressed bytes from a virtual offset on, block by block."""

    def __init__(self, file, voffset: int):
        self.file, self.next = file, voffset >> 16
        self.data, self.at, self.here = b"", 0, voffset >> 16
        self._load()
        self.at = voffset & 0xFFFF

    def _load(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(18)
        if len(head) < 18:
            self.data, self.at, self.here = b"", 0, self.next
            return False
        extra, = struct.unpack_from("<H", head, 10)
        fields = head[12:18] + self.file.read(extra - 6)
        size, p = None, 0
        while p + 4 <= extra:
            n, = struct.unpack_from("<H", fields, p + 2)
            if fields[p : p + 2] == b"BC":
                size = struct.unpack_from("<H", fields, p + 4)[0] + 1
            p += 4 + n
        body = self.file.read(size - 12 - extra - 8)
        self.here, self.next = self.next, self.next + size
        self.data, self.at = zlib.decompress(body, -15), 0
        return True

    def position(self) -> int:
        """Virtual offset of the next byte; the end of a block is the start of the following one."""
        if self.at >= len(self.data):
            return self.next << 16
        return (self.here << 16) | self.at

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at >= len(self.data) and not self._load():
                return out
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out += part
        return out


def read_header(path: str) -> tuple[list[tuple[str, int]], int]:
    """Reference names with lengths, and the virtual offset of the first record."""
    with _open(path) as f:
        b = _Blocks(f, 0)
        if b.take(4) != b"BAM\1":
            raise ValueError(f"not a BAM file: {path}")
        b.take(struct.unpack("<i", b.take(4))[0])
        refs = []
        for _ in range(struct.unpack("<i", b.take(4))[0]):
            name = b.take(struct.unpack("<i", b.take(4))[0])[:-1].decode()
            refs.append((name, struct.unpack("<i", b.take(4))[0]))
        return refs, b.position()


def index_offsets(path: str) -> list[int]:
    """All record-aligned virtual offsets the index names, sorted."""
    with _open(path) as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"not a BAM index: {path}")
    found, p = set(), 8
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        n_bin, = struct.unpack_from("<i", data, p)
        p += 4
        for _ in range(n_bin):
            number, n_chunk = struct.unpack_from("<Ii", data, p)
            p += 8
            # Bin 37450 holds counts, not chunks.
            if number != 37450:
                found.update(struct.unpack_from("<QQ", data, p + 16 * i)[0] for i in range(n_chunk))
            p += 16 * n_chunk
        n_intv, = struct.unpack_from("<i", data, p)
        found.update(struct.unpack_from(f"<{n_intv}Q", data, p + 4))
        p += 4 + 8 * n_intv
    return sorted(found - {0})


def _tags(raw: bytes) -> dict:
    out, p = {}, 0
    while p + 3 <= len(raw):
        name, kind = raw[p : p + 2].decode("ascii", "replace"), chr(raw[p + 2])
        p += 3
        if kind in ("Z", "H"):
            p = raw.index(b"\0", p) + 1
        elif kind == "B":
            n, = struct.unpack_from("<i", raw, p + 1)
            p += 5 + n * TAG_SIZES[chr(raw[p])]
        else:
            if name in TAG_COLUMNS and kind in TAG_FORMATS:
                out[TAG_COLUMNS[name]] = struct.unpack_from(TAG_FORMATS[kind], raw, p)[0]
            p += TAG_SIZES[kind]
    return out


def decode_record(raw: bytes, names: list[str], with_seq: bool) -> dict | None:
    """One alignment row; None for records without a readable name."""
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq = struct.unpack_from("<iiBBHHHi", raw, 0)
    p = 32
    try:
        name = raw[p : p + l_name - 1].decode("utf-8")
    except UnicodeDecodeError:
        return None
    if name in ("", "*"):
        return None
    p += l_name
    cigar = [{"op": CIGAR_OPS[v & 15], "len": v >> 4} for v in struct.unpack_from(f"<{n_ops}I", raw, p)]
    p += 4 * n_ops
    packed = raw[p : p + (l_seq + 1) // 2]
    p += len(packed) + l_seq
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq] if with_seq else None
    span = sum(c["len"] for c in cigar if c["op"] in "MDN=X")
    row = {
        "read_id": name, "chrom": names[ref] if ref >= 0 else None, "start": pos + 1, "end": pos + max(span, 1),
        "flag": flag, "mapq": mapq, "cigar": cigar, "seq": seq,
    }
    for k, v in _tags(raw[p:]).items():
        row[k] = float(v) if k in ("rq", "de") else int(v)
    return row


class BamRange(InputPartition):
    def __init__(self, begin: int, stop: int | None):
        self.begin, self.stop = begin, stop


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.index = options.get("index", self.path + ".bai")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.with_seq = options.get("sequences", "true").lower() == "true"

    def partitions(self):
        _, first = read_header(self.path)
        cuts = [first]
        for off in index_offsets(self.index):
            if (off >> 16) - (cuts[-1] >> 16) >= self.split:
                cuts.append(off)
        return [BamRange(a, b) for a, b in zip(cuts, [*cuts[1:], None])]

    def read(self, partition):
        names = [n for n, _ in read_header(self.path)[0]]
        schema = to_arrow_schema(ALIGNMENT_SCHEMA)
        rows = []
        with _open(self.path) as f:
            b = _Blocks(f, partition.begin)
            while partition.stop is None or b.position() < partition.stop:
                size = b.take(4)
                if len(size) < 4:
                    break
                row = decode_record(b.take(struct.unpack("<i", size)[0]), names, self.with_seq)
                if row is not None:
                    rows.append(row)
                if len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``; options index, splitBytes, sequences."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return ALIGNMENT_SCHEMA

    def reader(self, schema):
        return BamReader({k.lower(): v for k, v in self.options.items()})


def read_bam(spark: SparkSession, path: str, **options) -> DataFrame:
    """Alignments of an indexed BAM file, 1-based starts and inclusive ends."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").options(**options).load(path)


def chrom_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) from the header."""
    return spark.createDataFrame(read_header(path)[0], "chrom string, length long")
