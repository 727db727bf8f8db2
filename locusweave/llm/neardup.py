"""Near-duplicate groups by similarity: SimHash keys of many tables, linked by ball hashing, verified on the shingles.

At a shingle similarity of 0.8 about 15 % of SimHash bits differ, too many for one 64-bit ball.  Every text therefore has
``tables`` independent short SimHash keys, and each key emits its variants within one bit, so two texts meet in
a table if their keys there differ in at most two bits: with 16 tables of 24 bits 99 % of pairs at 0.8, more above.
Texts that meet are compared by a 64-bit SimHash where they meet, and what passes by its shingles.

The first few tables run ahead with one link for each text and find the bulk of every large group.  All tables then
only link texts that are not in one group yet, each to the text in the middle of those it meets, so a group of many near
copies costs links in proportion to its size.  Last, all texts that meet, are in different groups and have not been
compared are compared, so that no link depends on which text led.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.arrow import bounded_batches, slices
from locusweave.llm.balls import CHUNK, component_of, flips
from locusweave.llm.simhash import majority, shingle_hashes
from locusweave.session import materialize

KEY_BITS, PREFIX = 24, 8


def mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th independent 64-bit hash made from a hash."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_simhash(hashes: np.ndarray, bits: int) -> int:
    """A SimHash of ``bits`` bits from independent 64-bit parts."""
    out = 0
    for j in range(-(-bits // 64)):
        out = (out << 64) | (majority(mixed(hashes, j)) & 0xFFFFFFFFFFFFFFFF)
    return out


def marked(docs: DataFrame, shingle: int, tables: int, key_bits: int) -> DataFrame:
    """(doc_id, digest, set, fp, keys) for every row; a null text counts as an empty one.

    ``set`` is a digest of the set of shingles.  Keys and fingerprint are those of the set, as is the similarity: how
    often a shingle is repeated is left out.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    source = docs.select("doc_id", text.alias("text"), F.md5(text).alias("digest"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, fps, keys = [], [], []
            for t in batch.column("text"):
                h = np.unique(shingle_hashes(t.as_py(), shingle))
                sets.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
                fps.append(majority(h))
                wide = long_simhash(h, tables * key_bits)
                keys.append([(wide >> (key_bits * k)) & ((1 << key_bits) - 1) for k in range(tables)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("digest"), pa.array(sets, pa.string()), pa.array(fps, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "set", "fp", "keys"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, digest string, set string, fp long, keys array<long>")


def middles(fp: np.ndarray, begins: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """For each run of fingerprints (``begins`` are the runs' first places) the place closest to the run's bitwise majority.

    Copies that were changed independently stand around their original, and its fingerprint is about their majority.
    """
    out = np.empty(len(begins), np.int64)
    ends = np.r_[begins[1:], len(fp)]
    a = 0
    while a < len(begins):
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + block, side="right")))
        first, last = begins[a], ends[b - 1]
        part, starts, sizes = fp[first:last], begins[a:b] - first, ends[a:b] - begins[a:b]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        major = np.packbits(ones * 2 >= sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
        far = np.bitwise_count(part ^ np.repeat(major, sizes)).astype(np.int64)
        out[a:b] = np.minimum.reduceat((far << 40) + np.arange(len(part)), starts) & ((1 << 40) - 1)
        out[a:b] += first
        a = b
    return out


def across(v: np.ndarray, group: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs with equal ``v`` and unequal ``group``, about ``most`` at a time; rows are sorted by both."""
    new_v = np.r_[True, v[1:] != v[:-1]]
    new_group = new_v | np.r_[True, group[1:] != group[:-1]]
    ends = lambda new: np.r_[np.flatnonzero(new)[1:], len(v)][np.cumsum(new) - 1]
    low, high = ends(new_group), ends(new_v)
    upto = np.cumsum(high - low)
    a = 0
    while a < len(v):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + most, side="right")))
        n = (high - low)[a:b]
        i = np.repeat(np.arange(a, b), n)
        yield i, low[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        a = b


def _meet(key_bits: int, close: int, everyone: bool = False, chunk: int = CHUNK):
    low_bits = key_bits - PREFIX
    one = np.array(flips(low_bits, 1), np.uint64)
    low_mask = np.uint64((1 << low_bits) - 1)

    def pairs(dest: np.ndarray, key: np.ndarray, node: np.ndarray, fp: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        lead = key >> np.uint64(low_bits)
        near = lead == (dest & np.uint64((1 << PREFIX) - 1))  # no bit was used on the way here
        base = (dest << np.uint64(low_bits)) | (key & low_mask)
        v = np.concatenate([(base[near][:, None] ^ one[None, :]).ravel(), base[~near]])
        at = np.arange(len(fp))
        own = np.concatenate([np.repeat(at[near], len(one)), at[~near]])
        if everyone:
            yield from all_pairs(v, own, (dest >> np.uint64(PREFIX) << np.uint64(key_bits)) | key, node, fp, group)
            return
        order = np.lexsort((node[own], fp[own], v))
        v, own = v[order], own[order]
        # The middle of a variant's texts leads: who is close to it is linked to it, the rest go on among themselves.
        found = []
        while len(v):
            first = np.r_[True, v[1:] != v[:-1]]
            run = np.cumsum(first) - 1
            some = (np.bincount(run) > 1)[run]
            v, own, first = v[some], own[some], first[some]
            if not len(v):
                break
            run = np.cumsum(first) - 1
            leads = middles(fp[own], np.flatnonzero(first))
            leader = own[leads[run]]
            leading = np.zeros(len(v), bool)
            leading[leads] = True
            bits = np.bitwise_count(fp[own] ^ fp[leader])
            close_by = bits <= close
            linked = close_by & ~leading & ((group[own] != group[leader]) | (group[own] == 0))
            toward = np.where(group[leader] == 0, node[leader], group[leader])
            found.append(np.stack([node[own[linked]], node[leader[linked]], bits[linked].astype(np.uint64), toward[linked]]))
            rest = ~leading & ~close_by
            v, own = v[rest], own[rest]
        both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((4, 0), np.uint64)
        if both.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in both], ["src", "dst", "bits", "toward"])

    def all_pairs(v, own, whole_key, node, fp, group) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((group[own], v))
        v, own = v[order], own[order]
        flip = v ^ whole_key[own]
        for i, j in across(v, group[own]):
            x, y, a, b = flip[i], flip[j], own[i], own[j]
            # Keys that meet have several common variants; the pair counts at one of them.
            here = np.where(x == y, x == 0, v[i] < v[i] ^ x ^ y)
            ok = here & (np.bitwise_count(fp[a] ^ fp[b]) <= close)
            a, b = node[a[ok]], node[b[ok]]
            if len(a):
                columns = [np.minimum(a, b), np.maximum(a, b), np.bitwise_count(fp[own[i[ok]]] ^ fp[own[j[ok]]]), group[own[j[ok]]]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["src", "dst", "bits", "toward"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(5)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if len(held[0]) * 3 > chunk // 8:
                whole = int(np.searchsorted(held[0], held[0][-1]))
                if whole:
                    yield from pairs(*[h[:whole].view(np.uint64) for h in held])
                    held = [h[whole:] for h in held]
        if len(held[0]):
            yield from pairs(*[h.view(np.uint64) for h in held])

    return run


def candidates(classes: DataFrame, key_bits: int, close: int, everyone: bool = False) -> DataFrame:
    """Links (src, dst, bits, toward) between nodes of different groups whose keys meet in a table and whose fingerprints differ in ``close`` bits at most.

    ``toward`` is the group of ``dst``, or ``dst`` itself while it has none.

    ``classes`` has one row (node, fp, keys, group) per set of shingles, with group 0 for none yet.  ``everyone``
    gives all such pairs (src < dst; each text has a group then), otherwise each text is linked to those that lead.  Rows travel to (table, leading key bits) and are sorted
    there by destination, so a task holds one destination at a time.
    """
    low = key_bits - PREFIX
    sent = classes.select("node", "fp", "group", F.posexplode("keys").alias("table", "key")).select(
        "node", "fp", "group", "key", "table", F.explode(F.lit(flips(PREFIX, 1))).alias("m")
    )
    dest = F.shiftleft(F.col("table").cast("bigint"), PREFIX) + F.shiftright("key", low).bitwiseXOR(F.col("m").cast("bigint"))
    return (
        sent.select(dest.alias("dest"), "key", "node", "fp", "group").repartition(F.col("dest")).sortWithinPartitions("dest")
        .mapInArrow(_meet(key_bits, close, everyone), "src long, dst long, bits long, toward long")
    )


def verified(links: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The links (src, dst, src_node, dst_node) between digests whose texts' shingle sets have a Jaccard similarity of ``least`` or more."""
    names = ["src", "dst", "src_node", "dst_node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "a", 1 << 20):
            good, last, left = [], None, set()
            for s, a, b in zip(batch.column("dst"), batch.column("a"), batch.column("b")):
                if s != last:
                    last, left = s, set(shingle_hashes(a.as_py(), shingle).tolist())
                right = set(shingle_hashes(b.as_py(), shingle).tolist())
                both = len(left & right)
                good.append(both >= least * (len(left) + len(right) - both))
            yield batch.select(names).filter(pa.array(good, pa.bool_()))

    a = texts.select(F.col("digest").alias("dst"), F.col("text").alias("a"))
    b = texts.select(F.col("digest").alias("src"), F.col("text").alias("b"))
    return links.join(b, "src").join(a, "dst").select(*names, "a", "b").mapInArrow(run, "src string, dst string, src_node long, dst_node long")


#: Bits of the tables that tell rows that matter for a join from those that do not.
SLOTS = 1 << 22


def in_slots(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` with ``_in``: false only for rows whose ``key`` is certainly not among those of ``wanted``.

    The wanted keys set bits in a table of SLOTS bits, at most 129 rows of 4 KB, which is what is broadcast.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)) + 1
    bits = wanted.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits")
    )
    marked = df.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot")).join(F.broadcast(bits), "_bucket", "left")
    hit = F.expr(
        "shiftright(cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_slot) div 8 as int) + 1, 1)), 16, 10) as int), "
        "cast(bitmap_bit_position(_slot) % 8 as int)) & 1 = 1"
    )
    return marked.withColumn("_in", F.coalesce(hit, F.lit(False))).drop("_slot", "_bucket", "_bits")


def groups(
    docs: DataFrame, shingle: int = 5, least: float = 0.8, tables: int = 16, key_bits: int = KEY_BITS, close: int = 18,
    far: float = 0.21, ahead: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """The marked rows and (set, component) of the linked sets of shingles.

    Texts with the same set are alike whatever else tells them apart, so the one with the smallest digest stands for
    them.  Candidates differ in at most ``close`` of 64 bits and in at most the share ``far`` of all their keys' bits.
    """
    rows = materialize(marked(docs, shingle, tables, key_bits))
    # Node numbers are exact names of the sets: the table is written once and read from then on.
    classes = materialize(
        rows.groupBy("set").agg(F.min("digest").alias("low"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id() + 1)
    )
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))

    def similar(edges: DataFrame) -> DataFrame:
        needed = edges.select(F.col("src").alias("digest")).unionByName(edges.select(F.col("dst").alias("digest"))).distinct()
        some = in_slots(docs.select(F.md5(text).alias("digest"), text.alias("text")), "digest", needed).where("_in")
        texts = materialize(some.select("digest", "text").join(needed, "digest", "left_semi").dropDuplicates(["digest"]))
        return materialize(verified(edges, texts, shingle, least))

    def of_texts(links: DataFrame) -> DataFrame:
        ends = links
        for end in ("src", "dst"):
            ends = ends.join(classes.select(F.col("node").alias(end), F.col("low").alias(f"{end}_low"), F.col("keys").alias(f"{end}_keys")), end)
        apart = F.aggregate(
            F.zip_with("src_keys", "dst_keys", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
        )
        return ends.where(apart <= far * tables * key_bits).select(
            F.col("src_low").alias("src"), F.col("dst_low").alias("dst"), F.col("src").alias("src_node"), F.col("dst").alias("dst_node")
        )

    none = F.lit(0).cast("bigint")
    first = candidates(classes.select("node", "fp", F.slice("keys", 1, ahead).alias("keys"), none.alias("group")), key_bits, close)
    ahead_of_all = materialize(of_texts(first.groupBy("src").agg(F.min_by("dst", F.struct("bits", "dst")).alias("dst"))))
    linked = similar(ahead_of_all)
    ends = lambda found: found.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    # A text's group so far is everything its link reaches; those of one group need no links among themselves.
    reached = component_of(ends(linked)).withColumnRenamed("component", "group")
    grouped = classes.join(reached, "node", "left").select("node", "fp", "keys", F.coalesce("group", none).alias("group"))
    # One link is enough to join a group, so each text is compared with the closest leader of each group first.
    nearest = candidates(grouped, key_bits, close).groupBy("src", "toward").agg(F.min_by("dst", F.struct("bits", "dst")).alias("dst"))
    to_leaders = materialize(of_texts(nearest.select("src", "dst").distinct()))
    links = linked.unionByName(similar(to_leaders))
    edges = lambda: ends(links)
    # Whoever met only leaders that are no copies of it is compared with all others it meets outside its group.
    grouped = classes.join(component_of(edges()).withColumnRenamed("component", "group"), "node", "left").select(
        "node", "fp", "keys", F.coalesce("group", "node").alias("group")
    )
    compared = ahead_of_all.unionByName(to_leaders).select(
        F.least("src_node", "dst_node").alias("src"), F.greatest("src_node", "dst_node").alias("dst")
    )
    met = candidates(grouped, key_bits, close, everyone=True).select("src", "dst").distinct()
    links = links.unionByName(similar(materialize(of_texts(met.join(compared, ["src", "dst"], "left_anti")))))
    return rows, classes.select("set", "node").join(component_of(edges()), "node").select("set", "component")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one with the smallest doc_id, with all columns.

    Texts link if their sets of ``shingle``-word shingles (A-Z in lower case) have a Jaccard similarity of ``least``
    or more; a group is everything that links reach.  Equal texts are one text, so null and empty ones are one group;
    texts of fewer words are one shingle.  Rows without doc_id stay only if no member of their group has one, and of
    repeated rows one stays.
    """
    rows, components = groups(docs, **options)
    row_key = lambda doc_id, digest: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), digest)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    keyed = materialize(
        rows.join(components, "set", "left").select(
            row_key(F.col("doc_id"), F.col("digest")).alias("_stays"), order.alias("o"),
            F.coalesce(F.col("component").cast("string"), "set").alias("g"),
        )
    )
    stay = materialize(keyed.groupBy("g").agg(F.min("o").alias("o")).select(row_key(F.col("o.doc_id"), F.col("o.digest")).alias("_stays")))
    repeated = keyed.groupBy("_stays").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_stays")
    in_question = materialize(keyed.select("_stays").join(stay, "_stays", "left_anti").unionByName(repeated))
    digest = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))
    # Only rows that may go or are repeated are shuffled; the bulk stays where it is.
    all_rows = in_slots(docs.withColumn("_stays", row_key(docs["doc_id"], digest)), "_stays", in_question)
    settled = all_rows.where("NOT _in").select(*docs.columns)
    asked = all_rows.where("_in").join(stay, "_stays", "left_semi").dropDuplicates(["_stays"]).select(*docs.columns)
    return settled.unionByName(asked)
