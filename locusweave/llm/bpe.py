"""Byte-level BPE by monoid tree reduction.

A text is cut into matches of the pattern; each match is encoded by halves, recursively, and neighbours are
joined.  Joining re-encodes a window around the seam and widens it until the window's outer tokens are
compatible with what lies outside.  Two tokens are compatible if encoding their joined bytes gives them
back; a token sequence is the BPE encoding of its bytes exactly if all its neighbours are compatible, so
at that point no token outside the window can change.  Decoding is concatenation, up the same tree.
"""

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from locusweave.llm.arrow import bounded_batches, id_and_text, kept_by_worker, slices

LEAF = 48
#: Matches a worker remembers; frequent ones come early, and encoding the others again only costs time.
REMEMBERED = 100_000


class BytePairs:
    """Ranks of a tiktoken file, and encoding and decoding by tree reduction."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.leaf = leaf
        self.compatible = lru_cache(1 << 16)(self._compatible)

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: the adjacent pair of the lowest rank, the leftmost of equals, is merged until none is left."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        if len(data) > 2 * self.leaf:
            return self._merged_by_heap(data)
        parts = [data[i:i + 1] for i in range(len(data))]
        scores = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = at = None
            for i, s in enumerate(scores):
                if s is not None and (best is None or s < best):
                    best, at = s, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merged_by_heap(self, data: bytes) -> list[int]:
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # a part is data[i:end[i]]; end[i] == 0 once it is merged into its left neighbour
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of its parts has changed
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i:end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def _compatible(self, left: int, right: int) -> bool:
        return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both halves' bytes from the halves' encodings."""
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.merged(self.decode(left[a:] + right[:b]))
            if (not a or self.compatible(left[a - 1], window[0])) and (
                b == len(right) or self.compatible(window[-1], right[b])
            ):
                return left[:a] + window + right[b:]
            k *= 2

    def encode_match(self, data: bytes) -> list[int]:
        """One match of the pattern: leaves are merged plainly, then joined two by two."""
        if len(data) <= self.leaf:
            return self.merged(data)
        level = [self.merged(data[i:i + self.leaf]) for i in range(0, len(data), self.leaf)]
        while len(level) > 1:
            level = [self.joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, text: str | None) -> list[int]:
        return [i for m in self.find(text or "") for i in self.encode_match(m.encode("utf-8", "surrogatepass"))]


class Remembered(dict):
    """Results by key, computed when missing and kept until there are ``most``."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


def loaded(path: str, pattern: str, most: int = REMEMBERED) -> tuple[BytePairs, Remembered]:
    """The vocabulary, and the memory of matches with their ids and the bytes these decode to, once for each worker process."""
    return kept_by_worker(("bpe", path, pattern, most), lambda: _load(path, pattern, most))


def _load(path: str, pattern: str, most: int) -> tuple[BytePairs, Remembered]:
    pairs = BytePairs(path, pattern)

    def both(match: str) -> tuple[str, bytes]:
        ids = pairs.encode_match(match.encode("utf-8", "surrogatepass"))
        return ",".join(map(str, ids)), pairs.decode(ids)

    return pairs, Remembered(both, most)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for every row; a null text has no ids."""
    bounded_batches(docs.sparkSession)
    source = id_and_text(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, matches = loaded(path, pattern)
        for batch in slices(batches, most=1 << 20):
            rows = [[int(i) for m in pairs.find(t.as_py() or "") for i in matches[m][0].split(",")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data) from (doc_id, ids); null ids give empty bytes."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, _ = loaded(path, pattern)
        for batch in batches:
            rows = [pairs.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, most: int = REMEMBERED) -> DataFrame:
    """Encode, decode the ids again and keep digests: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    One row per row of ``docs``; a null or empty text has no tokens.  Matches that repeat are encoded once for each
    worker, up to ``most`` of them (about 330 bytes each).  Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    source = id_and_text(docs)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, matches = loaded(path, pattern, most)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in slices(batches, most=1 << 20):
            rows = []
            for t in batch.column("text"):
                found = [matches[m] for m in pairs.find(t.as_py() or "")]
                ids, data = ",".join([f[0] for f in found]), b"".join([f[1] for f in found])
                rows.append((ids.count(",") + 1 if ids else 0, digest(ids.encode()), digest(data), len(data)))
            n, a, b, size = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(size, pa.int64())], names
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
