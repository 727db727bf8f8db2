"""Prefix trie of conversations from sorted matrices of turn ids.

A conversation becomes the string of its 16-byte turn ids, and conversations are dealt to shards by range of that
string and their id, so every node of the trie is a run of rows and copies of one conversation, however many, are
spread over as many shards as they fill.  A task holds one shard: padded matrices of turn ids are sorted with
``np.lexsort``, OR-accumulated change masks along the columns mark where nodes start, and ``reduceat`` aggregates
every depth.  Columns are taken in waves, each with the rows that reach so far, so one long conversation does not
widen the matrix of the short ones.

Only nodes on the path of a shard's first or last row can go on in another shard.  They are sent as partial rows
and added up.  What a shard counts once for a node was counted once too often for every seam between shards that
the node spans; a seam is settled by comparing the last row before it with the first one after it.  All else is
final where it was made.
"""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.session import materialize

#: Turns of a shard, a conversation counting as ``ROW`` more; and cells of a padded matrix.
TURNS, ROW, CELLS = 1_000_000, 8, 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
#: Rows of a batch that goes back to Spark.
OUT = 20_000


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id, len): 128-bit ids of (role, text), as hex, and the code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.length(text).alias("len"),
    )


def rebuilt(conversations: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, path, lens): every conversation with its first turns taken from the first one of its block."""
    own = materialize(turn_ids(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "len"))).alias("t")))
    base = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    # A base meets the conversations of its block only, so no key is hot.
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", h).join(base, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("t", 1, F.lit(0))).otherwise(F.slice("head", F.lit(1), F.col("h")))
    turns = F.concat(head, F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0))))
    return both.select("conv_id", turns.alias("t")).select(
        "conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["id"]), "")).alias("path"), F.transform("t", lambda x: x["len"]).alias("lens")
    )


@dataclass
class Trie:
    """Nodes of a shard by depth; ``level[d]`` is where depth ``d`` begins, ``end`` the node each row ends at."""

    level: list[int]
    parent: np.ndarray
    low: np.ndarray
    convs: np.ndarray
    last: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.parent)

    def depth(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.level) - 1), np.diff(self.level))

    def over_subtrees(self, own: np.ndarray) -> np.ndarray:
        total = own.astype(np.int64)
        for a, b in zip(self.level[-2:0:-1], self.level[:1:-1]):
            np.add.at(total, self.parent[a:b], total[a:b])
        return total

    def chains(self, ended: np.ndarray) -> tuple[list[int], list[int]]:
        """The nodes of the first and of the last row, from the root down; ``ended`` counts the rows that end at a node."""
        first, last = [0], [0]
        for d in range(1, len(self.level) - 1):
            a, b = self.level[d], self.level[d + 1] - 1
            # Rows that end at a node come before those that go on.
            if len(first) == d and not ended[first[-1]]:
                first.append(a)
            if len(last) == d and self.parent[b] == last[-1]:
                last.append(b)
        return first, last


def trie_of(conv: np.ndarray, ids: np.ndarray, lens: np.ndarray, turns: np.ndarray, cells: int = CELLS) -> Trie:
    """The trie of one shard: ``ids`` (turn, 2) and ``lens`` hold the turns of all rows, ``turns`` says how many each has."""
    begin = np.cumsum(turns) - turns
    parent, low, convs, last = [np.array([-1])], [np.array([conv.min()])], [np.array([len(conv)])], [np.array([0])]
    level, end = [0, 1], np.zeros(len(conv), np.int64)
    rows = np.flatnonzero(turns > 0)
    node, done = np.zeros(len(rows), np.int64), 0
    while len(rows):
        width = int(min(turns[rows].max() - done, max(1, cells // len(rows))))
        spot = done + np.arange(width)
        real = spot[None, :] < turns[rows, None]
        matrix = np.zeros((len(rows), width, 2), np.uint64)
        matrix[real] = ids[(begin[rows, None] + spot[None, :])[real]]
        order = np.lexsort((conv[rows], *(matrix[:, k, i] for k in range(width - 1, -1, -1) for i in (1, 0)), node))
        rows, node, real, matrix = rows[order], node[order], real[order], matrix[order]
        change = np.ones((len(rows), width), bool)
        change[1:] = (matrix[1:] != matrix[:-1]).any(axis=2)
        change[1:, 0] |= node[1:] != node[:-1]
        starts = np.logical_or.accumulate(change, axis=1)
        for k in range(width):
            here = np.flatnonzero(real[:, k])
            at = np.flatnonzero(starts[here, k])
            heads = here[at]
            parent.append(node[heads])
            low.append(np.minimum.reduceat(conv[rows[here]], at))
            convs.append(np.diff(np.append(at, len(here))))
            last.append(lens[begin[rows[heads]] + done + k])
            node[here] = level[-1] + np.cumsum(starts[here, k]) - 1
            level.append(level[-1] + len(at))
            over = here[turns[rows[here]] == done + k + 1]
            end[rows[over]] = node[over]
        done += width
        more = turns[rows] > done
        rows, node = rows[more], node[more]
    return Trie(level, *(np.concatenate(x).astype(np.int64) for x in (parent, low, convs, last)), end)


def _keys(path: bytes, depth: int) -> list[bytes]:
    """Names of the nodes on a path, from the root to ``depth``."""
    h = hashlib.md5(usedforsecurity=False)
    out = [h.digest()]
    for d in range(depth):
        h.update(path[16 * d:16 * d + 16])
        out.append(h.digest())
    return out


PARTS = (
    "shard int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, piece string, first_path binary, last_path binary, last_lens array<int>"
)
_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()),
    *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
    ("ends_sha256", pa.string()), ("piece", pa.string()), ("first_path", pa.binary()), ("last_path", pa.binary()), ("last_lens", pa.list_(pa.int32())),
])


def _batch(rows: int, **columns) -> pa.RecordBatch:
    full = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays(full, schema=_SCHEMA)


def shard_rows(shard: int, conv: np.ndarray, paths: list[bytes], lens: np.ndarray, cells: int = CELLS) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard, those on the paths of its first and last row as partial rows, and these two paths."""
    turns = np.array([len(p) // 16 for p in paths], np.int64)
    ids = np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2)
    trie = trie_of(conv, ids, lens, turns, cells)
    n, depth = len(trie), trie.depth()
    children = np.bincount(trie.parent[1:], minlength=n)
    leaves = trie.over_subtrees(children == 0)
    saved = trie.over_subtrees((trie.convs - 1) * trie.last)
    ended = np.bincount(trie.end, minlength=n)
    by_end = np.lexsort((conv, trie.end))
    names = [str(c) for c in conv[by_end].tolist()]
    stop = np.cumsum(ended)
    first, last = trie.chains(ended)
    first_path, last_path = (paths[by_end[stop[c[-1]] - 1]] for c in (first, last))
    key: list[bytes | None] = [None] * n
    for chain, path in ((first, first_path), (last, last_path)):
        for v, k in zip(chain, _keys(path, len(chain) - 1)):
            key[v] = k
    sha, piece = [NOTHING] * n, [None] * n
    for v in np.flatnonzero(ended).tolist():
        joined = ",".join(names[stop[v] - ended[v]:stop[v]])
        if key[v] is None:
            sha[v] = hashlib.sha256(joined.encode()).hexdigest()
        else:
            piece[v] = joined
    parent = trie.parent.tolist()
    parent_key = [None, *(key[p] for p in parent[1:])]
    parent_conv = [None, *(None if key[p] is not None else int(trie.low[p]) for p in parent[1:])]
    for a in range(0, n, OUT):
        b = min(n, a + OUT)
        yield _batch(
            b - a, shard=np.full(b - a, shard, np.int32), key=key[a:b], parent_key=parent_key[a:b], conv_id=trie.low[a:b], depth=depth[a:b],
            parent_conv_id=parent_conv[a:b], n_convs=trie.convs[a:b], n_children=children[a:b], n_leaves=leaves[a:b],
            saved_tokens=saved[a:b], ends_sha256=sha[a:b], piece=piece[a:b],
        )
    tail = int(by_end[stop[last[-1]] - 1])
    start = int(turns[:tail].sum())
    yield _batch(1, shard=[shard], first_path=[first_path], last_path=[last_path], last_lens=[lens[start:start + turns[tail]].tolist()])


def _over_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is not None:
        conv = table.column("conv_id").to_numpy().astype(np.int64)
        lens = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("lens").chunks]).astype(np.int64)
        yield from shard_rows(TaskContext.get().partitionId(), conv, table.column("path").to_pylist(), lens)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What nodes that span a seam were counted too often on its second side."""
    for batch in batches:
        for r in batch.to_pylist():
            before, after = (np.frombuffer(r[c], ">u8").reshape(-1, 2) for c in ("before", "first_path"))
            m = min(len(before), len(after))
            differ = np.flatnonzero((before[:m] != after[:m]).any(axis=1))
            common = int(differ[0]) if len(differ) else m
            lens = np.array([0, *r["before_lens"][:common]], np.int64)
            saved = np.cumsum(lens[::-1])[::-1]
            less = np.full(common + 1, -1)
            less[-1] = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keys(r["first_path"], common), pa.binary()), pa.array(less, pa.int64()),
                 pa.array(np.full(common + 1, -(len(before) == common)), pa.int64()), pa.array(saved, pa.int64())],
                ["key", "n_children", "n_leaves", "saved_tokens"],
            )


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order; only the state of one hash is held."""
    key, h, out = None, None, []
    for batch in batches:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
            if k != key:
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
    if h is not None:
        out.append((key, h.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out])], ["key", "ends_sha256"])


def trie_nodes(conversations: DataFrame, block: int = 100, heads: int = 6, turns: int = TURNS) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    ``conversations`` has conv_id, turn, role, text.  Turns go by turn, null first; ties by role and text, in the
    order of the MD5 of "<code points of role>:<role><text>", which also is the identity of a turn.  A
    conversation takes its first h turns (crc32 of its id modulo ``heads``) from the one of its block of ``block`` ids
    whose id ends it (all if that has fewer, none if there is none), then follow its own after its first h.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  Null roles and texts are empty; rows without conv_id belong to no conversation and are
    left out; repeated rows are turns of their own.  An empty table has no node.  Other columns are ignored.
    Long texts are not moved, but the ids of one conversation (16 bytes a turn) must fit a row.
    """
    spark = conversations.sparkSession
    rows = materialize(rebuilt(conversations, block, heads))
    weight = rows.agg(F.sum(F.size("lens") + ROW).alias("n")).first().n or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(weight / turns))
    parts = materialize(rows.repartitionByRange(shards, "path", "conv_id").mapInArrow(_over_shards, PARTS))
    nodes, edges = parts.where("first_path IS NULL"), parts.where("first_path IS NOT NULL")
    # One row per shard, so its single task grows with the shards only.
    over = Window.orderBy("shard")
    seams = edges.select(
        F.lag("last_path").over(over).alias("before"), F.lag("last_lens").over(over).alias("before_lens"), "first_path"
    ).where("before IS NOT NULL")
    extra = seams.mapInArrow(_seams, "key binary, n_children long, n_leaves long, saved_tokens long")
    chain = nodes.where("key IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spread = chain.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
    total = materialize(
        spread.unionByName(extra, allowMissingColumns=True).groupBy("key")
        .agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *sums)
    )
    pieces = chain.where("piece IS NOT NULL").select("key", "shard", "piece")
    ends = pieces.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_hashes, "key binary, ends_sha256 string")
    names = total.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = total.join(ends, "key", "left").join(names, "parent_key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))
    )
    inner = nodes.where("key IS NULL")
    # Children of one node (all first turns have the root) look it up in the rows of their own shard.
    known = materialize(chain.select("shard", F.col("key").alias("parent_key")).join(names, "parent_key"))
    waiting = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(known, ["shard", "parent_key"])
    return shared.select(*out).unionByName(inner.where("parent_key IS NULL").select(*out)).unionByName(waiting.select(*out))


_CRC = (
    "list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), "
    "lambda a, x: list_reduce(list_concat([xor(a, x)], range(0, 8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)))"
)
SQL = f"""WITH t AS (SELECT conv_id, md5(length(r) || ':' || r || x) AS id, length(x) AS len,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS b, xor({_CRC}, 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)),
r AS (SELECT conv_id, id, len, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d FROM (
  SELECT c.conv_id, id, len, 0 AS own, i FROM c JOIN t ON t.conv_id = b AND i <= h
  UNION ALL SELECT c.conv_id, id, len, 1, i FROM c JOIN t ON t.conv_id = c.conv_id AND i > h)),
p AS (SELECT conv_id, d, len, md5(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
f AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT d, key, any_value(up) AS up, any_value(len) AS len, min(conv_id) AS low, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM f GROUP BY d, key),
k AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, key)),
u AS (SELECT DISTINCT a.d, a.key, b.d AS bd, b.key AS bk FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d >= a.d),
s AS (SELECT u.d, u.key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * len) AS saved
  FROM u JOIN m ON m.d = u.bd AND m.key = u.bk GROUP BY 1, 2)
SELECT m.low AS conv_id, m.d::BIGINT AS depth, q.low AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (d, key) LEFT JOIN m q ON q.d = m.d - 1 AND q.key = m.up"""
