"""Benchmark decontamination: rare n-gram seeds find where a test item may sit in a text, Smith-Waterman alignment decides.

The benchmark is the stated query set; it is held against all documents in blocks of bounded size, so nothing that
grows with the documents is broadcast and no text is shuffled.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.arrow import bounded_batches, id_and_text, slices

GRAM = 3
#: Benchmark words in one block.
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """One hash for each GRAM successive word hashes."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, GRAM):
        h = (h ^ (h >> np.uint64(29))) * _MIX + words[k:k + n]
    return h ^ (h >> np.uint64(32))


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words begin and end; each distinct word is hashed once."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")
    split = pc.split_pattern(pc.utf8_trim(clean, " "), " ")
    bounds = split.offsets.to_numpy()
    flat = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    hashes = np.array([word_hash(w) for w in flat.dictionary.to_pylist()], np.uint64)
    return hashes[flat.indices.to_numpy()] if len(flat) else hashes, bounds - bounds[0]


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the doc place where it ends."""
    n = len(doc)
    row, ramp = np.zeros(n + 1, np.int64), np.arange(n + 1) * -GAP
    best, end = 0, 0
    for w in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(doc == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp) - ramp  # gaps along the document
        top = int(new.argmax())
        if new[top] > best:
            best, end = int(new[top]), top
        row = new
    return best, end


@dataclass
class Items:
    """One block of the benchmark: word hashes of each item, and its grams as a sorted table (gram, item, place)."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> "Items":
        words = [np.array([word_hash(w) for w in item_words(t)], np.uint64) for _, t in rows]
        grams = [gram_hashes(w) for w in words]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else owner
        order = np.argsort(flat, kind="stable")
        return cls([i for i, _ in rows], words, flat[order], owner[order], place[order])

    def only(self, keep: np.ndarray) -> "Items":
        return Items(self.ids, self.words, self.grams[keep], self.owner[keep], self.place[keep])


class Filter:
    """Membership of hashes in a sorted table, by a bit table before the exact search."""

    def __init__(self, table: np.ndarray):
        self.table = np.unique(table)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.table & np.uint64((1 << 20) - 1)] = True

    def places(self, grams: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[grams & np.uint64((1 << 20) - 1)])
        if not len(maybe) or not len(self.table):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.table, grams[maybe]), len(self.table) - 1)
        return maybe[self.table[at] == grams[maybe]]


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about ``block_words`` words."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        found = sorted({(r.item_id, r.text) for r in part.toLocalIterator()}, key=repr)
        if found:
            yield found


def word_frequencies(docs: DataFrame, items: Items) -> tuple[dict[int, int], int]:
    """Occurrences of the block's words in all documents, and of all words; one row for each of the block's words comes back."""
    wanted = Filter(np.concatenate([np.zeros(0, np.uint64), *items.words]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(wanted.table), np.int64), 0
        for batch in slices(batches):
            distinct, times = np.unique(text_words(batch.column("text"))[0], return_counts=True)
            at = wanted.places(distinct)
            counts[np.searchsorted(wanted.table, distinct[at])] += times[at]
            total += int(times.sum())
        used = np.flatnonzero(counts)
        words = pa.array([*wanted.table[used].view(np.int64).tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([words, pa.array([*counts[used].tolist(), total], pa.int64())], ["word", "n"])

    sums = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in sums.toLocalIterator()}
    return {w & 0xFFFFFFFFFFFFFFFF: n for w, n in found.items() if w is not None}, found.get(None, 0)


def rare_seeds(items: Items, frequency: dict[int, int], total: int, expected: float = 1.0) -> Items:
    """An item's seeds: the grams that chance would bring about ``expected`` times at most, and its rarer half anyway.

    Chance is the product of the words' corpus frequencies.  Counting the gram itself would be no measure: a passage
    that many documents copied is frequent, and must still be found.
    """
    chance = np.zeros(len(items.grams))
    per_word = [np.log(np.maximum([frequency.get(int(w), 0) for w in ws], 0.5) / max(total, 1)) for ws in items.words]
    for i in range(GRAM):
        chance += np.array([per_word[o][p + i] for o, p in zip(items.owner, items.place)])
    chance += np.log(max(total, 1))
    keep = chance <= np.log(expected)
    order = np.argsort(items.owner, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(items.owner[order])) + 1):
        if len(part):
            keep[part] |= chance[part] <= np.median(chance[part])
    return items.only(keep)


class Finder:
    """Aligned items of one text after another."""

    def __init__(self, seeds: Items, least: float, least_words: int):
        self.seeds, self.least, self.least_words = seeds, least, least_words
        self.wanted = Filter(seeds.grams)

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first and last word) of every aligned item."""
        words, bounds = text_words(texts)
        grams = gram_hashes(words)
        at = self.wanted.places(grams)
        doc = np.searchsorted(bounds, at, side="right") - 1
        inside = at + GRAM <= bounds[doc + 1]
        at, doc = at[inside], doc[inside]
        if not len(at):
            return
        low = np.searchsorted(self.seeds.grams, grams[at], side="left")
        times = np.searchsorted(self.seeds.grams, grams[at], side="right") - low
        row = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        at, doc, item = np.repeat(at, times), np.repeat(doc, times), self.seeds.owner[row]
        origin = at - self.seeds.place[row]
        order = np.lexsort((origin, item, doc))
        doc, item, origin = doc[order], item[order], origin[order]
        length = np.array([len(w) for w in self.seeds.words])[item]
        slack = length // 2 + 8
        new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (origin[1:] - origin[:-1] > slack[1:])]
        begins = np.flatnonzero(new)
        best: dict[tuple[int, int], tuple] = {}
        for a, b in zip(begins, [*begins[1:], len(doc)]):
            d, i, m = int(doc[a]), int(item[a]), int(length[a])
            first = max(int(bounds[d]), int(origin[a] - slack[a]))
            last = min(int(bounds[d + 1]), int(origin[b - 1] + m + slack[a]))
            score, end = align(words[first:last], self.seeds.words[i])
            similarity = score / (MATCH * m)
            if similarity >= self.least and score >= MATCH * min(self.least_words, m) and similarity > best.get((d, i), (0,))[0]:
                back, size = align(words[first:first + end][::-1], self.seeds.words[i][::-1])
                best[d, i] = (similarity, first + end - size - int(bounds[d]), first + end - int(bounds[d]))
        for (d, i), (similarity, first, last) in sorted(best.items()):
            yield d, i, similarity, first, last


def finders(docs: DataFrame, benchmark: DataFrame, least: float, least_words: int, block_words: int) -> list[Finder]:
    source = id_and_text(docs)
    out = []
    for rows in blocks(benchmark, block_words):
        items = Items.of(rows)
        out.append(Finder(rare_seeds(items, *word_frequencies(source, items)), least, least_words))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, least_words: int = 6, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, first_word, last_word (end exclusive).

    Similarity is the best alignment score (2 a matching word, -1 a changed, added or left-out one) over that of the
    whole item; pairs of ``least`` or more count that match ``least_words`` words at least (or the whole of a shorter
    item).  Case and punctuation do not matter.  Items under three words have no seeds and are not found.  Null and
    empty texts contain nothing; repeated rows repeat their pairs; rows without doc_id are reported with a null one.
    """
    bounded_batches(docs.sparkSession)
    source = id_and_text(docs)
    kinds = source.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word long, last_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for finder in finders(docs, benchmark, least, least_words, block_words):

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = list(finder.hits(batch.column("text")))
                if rows:
                    d, i, s, a, b = zip(*rows)
                    items = pa.array([finder.seeds.ids[k] for k in i])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(d)), items, pa.array(s), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                        ["doc_id", "item_id", "similarity", "first_word", "last_word"],
                    )

        found = found.unionByName(source.mapInArrow(run, schema))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, least_words: int = 6, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    bounded_batches(docs.sparkSession)
    for finder in finders(docs, benchmark, least, least_words, block_words):

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in finder.hits(batch.column("text").cast(pa.string()))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
