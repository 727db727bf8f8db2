"""Hamming links between 64-bit fingerprints by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a common variant within r bits of both, and fingerprints with a
common variant are at most 2r bits apart.  Every fingerprint therefore emits all variants within r bits, the
variants are shuffled, and equal variants are collisions.  Variants that agree in their leading bits have the
same destination, so they travel as one row (leading bits, fingerprint) and are enumerated where they arrive:
with r = 2 and 16 leading bits 137 rows stand for 2,081 variants.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators.graph import connected_components

PREFIX = 16
#: Variants enumerated at a time; bounds the memory of a task.
CHUNK = 1 << 21
#: Rows of one destination beyond which it is divided by the next 16 bits.
HOT_ROWS = 200_000


def flips(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` bits set."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _masks(bits: int, radius: int) -> np.ndarray:
    return np.array(flips(bits, radius), dtype=np.uint64)


def star_labels(member: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduce links to (node, smallest node it reaches) for the nodes that are not the smallest themselves."""
    nodes, at = np.unique(np.concatenate([member, hub]), return_inverse=True)
    a, b = at[: len(member)], at[len(member):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class Collisions:
    """Finds equal variants among rows (leading bits, fingerprint)."""

    def __init__(self, radius: int, width: int = 64, chunk: int = CHUNK):
        self.radius, self.width, self.chunk = radius, width, chunk
        self._cache: dict[tuple[int, int], np.ndarray] = {}

    def masks(self, bits: int, radius: int) -> np.ndarray:
        if (bits, radius) not in self._cache:
            self._cache[bits, radius] = _masks(bits, radius)
        return self._cache[bits, radius]

    def left(self, lead: np.ndarray, bits: int, fp: np.ndarray) -> np.ndarray:
        """Flips that remain for the low bits."""
        used = np.bitwise_count((fp >> np.uint64(self.width - bits)) ^ lead)
        return self.radius - used.astype(np.int64)

    def cost(self, left: np.ndarray, bits: int) -> np.ndarray:
        return np.array([len(self.masks(self.width - bits, r)) for r in range(self.radius + 1)])[left]

    def find(self, lead: np.ndarray, bits: int, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Stars (fingerprint, smallest fingerprint with a common variant) among whole destinations."""
        left = self.left(lead, bits, fp)
        if int(self.cost(left, bits).sum()) > self.chunk and bits < self.width - 8 and len(fp) > 1:
            yield from self._divide(lead, bits, fp, left)
            return
        low = np.uint64(self.width - bits)
        base = (lead << low) | (fp & ((np.uint64(1) << low) - np.uint64(1)))
        variants, owners = [], []
        for r in range(self.radius + 1):
            at = np.flatnonzero(left == r)
            m = self.masks(self.width - bits, r)
            variants.append((base[at][:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(at, len(m)))
        v = np.concatenate(variants)
        s = np.sort(v)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            return
        spot = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = np.flatnonzero(twice[spot] == v)
        run, own = spot[hit], fp[np.concatenate(owners)[hit]]
        order = np.lexsort((own, run))
        run, own = run[order], own[order]
        first = np.r_[True, run[1:] != run[:-1]]
        hub = own[np.flatnonzero(first)[np.cumsum(first) - 1]]
        other = own != hub
        if other.any():
            yield star_labels(own[other], hub[other])

    def _divide(self, lead, bits, fp, left):
        """One destination at a time, and a large one by its next 8 bits."""
        order = np.argsort(lead, kind="stable")
        lead, fp, left = lead[order], fp[order], left[order]
        ends = np.r_[np.flatnonzero(lead[1:] != lead[:-1]) + 1, len(lead)]
        if len(ends) > 1:
            total, begin = np.cumsum(self.cost(left, bits)), 0
            for i, end in enumerate(ends):
                more = ends[i + 1] if i + 1 < len(ends) else None
                done = total[begin - 1] if begin else 0
                if more is None or total[more - 1] - done > self.chunk:
                    yield from self.find(lead[begin:end], bits, fp[begin:end])
                    begin = end
            return
        after = (fp >> np.uint64(self.width - bits - 8)) & np.uint64(255)
        for q in range(256):
            keep = np.bitwise_count(after ^ np.uint64(q)) <= left
            if keep.sum() > 1:
                deeper = np.full(int(keep.sum()), (int(lead[0]) << 8) | q, dtype=np.uint64)
                yield from self.find(deeper, bits + 8, fp[keep])


def _collide(radius: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Collisions(radius, chunk=chunk)
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def flush(keys, fps):
            for bits, part in ((PREFIX, keys >> 32 == 0), (2 * PREFIX, keys >> 32 == 1)):
                if part.any():
                    lead = (keys[part] & 0xFFFFFFFF).astype(np.uint64)
                    for a, b in finder.find(lead, bits, fps[part]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"]
                        )

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) > 20_000:  # the rows are sorted: all but the last destination are whole
                whole = int(np.searchsorted(keys, keys[-1]))
                if whole:
                    yield from flush(keys[:whole], fps[:whole])
                    keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield from flush(keys, fps)

    return run


def ball_links(fps: DataFrame, radius: int = 2, chunk: int = CHUNK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (src, dst) that connect all fingerprints at most ``2 * radius`` bits apart.

    ``fps`` has distinct fingerprints in the long column ``fp``.  The links of one common variant form a star
    around its smallest fingerprint; any two of its members are at most ``2 * radius`` bits apart, so the stars
    have the same components as all pairs, and no pair is enumerated.  A destination with more than ``hot_rows``
    rows is divided by 16 more bits; at most 65,536 destinations exist, which bounds the broadcast list.
    """
    top = F.shiftrightunsigned("fp", 64 - PREFIX)
    sent = fps.select("fp", F.explode(F.lit(flips(PREFIX, radius))).alias("m")).select(
        top.bitwiseXOR(F.col("m").cast("bigint")).alias("bucket"), F.bit_count("m").alias("used"), "fp"
    )
    hot = sent.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    marked = sent.join(F.broadcast(hot.select("bucket", F.lit(True).alias("hot"))), "bucket", "left")
    next_bits = F.shiftrightunsigned("fp", 64 - 2 * PREFIX).bitwiseAND(F.lit((1 << PREFIX) - 1))
    deeper = F.lit(flips(PREFIX, 0))
    for r in range(1, radius + 1):
        deeper = F.when(F.col("used") <= radius - r, F.lit(flips(PREFIX, r))).otherwise(deeper)
    plain = marked.where("hot is null").select("bucket", "fp")
    divided = marked.where("hot").select("bucket", "fp", F.explode(deeper).alias("m")).select(
        (F.lit(1 << 32) + F.shiftleft("bucket", PREFIX) + next_bits.bitwiseXOR(F.col("m").cast("bigint"))).alias("bucket"),
        "fp",
    )
    return (
        plain.unionByName(divided)
        .repartition(F.col("bucket"))
        .sortWithinPartitions("bucket")
        .mapInArrow(_collide(radius, chunk), "src long, dst long")
    )


def component_of(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes with a link."""
    return connected_components(edges)
