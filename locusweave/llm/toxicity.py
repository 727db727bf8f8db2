"""Toxicity by compression distance: windows are compressed with a toxic and an ordinary zstandard dictionary.

Words are coded so that two of them share bytes only as far as they begin alike.  Toxic words may be known by their
beginning only, and what such a beginning has in common with the middle of ordinary words then saves nothing.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.arrow import bounded_batches, id_and_text, slices
from locusweave.llm.qda import crc_remainder, label_of
from locusweave.session import materialize

_GAP = re.compile(rb"[^\w\x80-\xff]+")
#: Bytes of a window and from one window to the next; the overlap holds a long word with its spaces.
WINDOW, STEP = 40, 28
#: A shorter match saves little and is mostly chance.
MIN_MATCH = 6
#: Both dictionaries end with this and every window begins with it.  It always matches, so every window is stored
#: in compressed form (zstandard stores a block raw when it saves too little) and lengths compare byte by byte.
ANCHOR = bytes(range(1, 31))
#: Follows every window, as zstandard looks for no match that begins in the last bytes of a block.
TAIL = ANCHOR[:10]
#: Bytes a window must save to count as a hit.
HIT = 3
#: Beginnings of words, in characters, that may stand in a dictionary; whole words of any length may.
BEGINNING = range(4, 11)
#: Logarithm of how much more frequent a dictionary's pieces are in its class.
LEAST_RATE = 2.0
#: The weakest piece of the toxic dictionary has this part of the strongest one's weight.
FLOOR = 20
#: Best pieces that are looked at for each dictionary; many of them begin each other.
SHORTLIST = 4096

_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def plain(text: str | None) -> bytes:
    return _GAP.sub(b" ", b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" ")


def coded(data: bytes) -> bytes:
    """``data``, which begins with a space, with every byte of a word replaced by a hash of the word up to there."""
    c = np.frombuffer(data, np.uint8)
    at, gap = np.arange(len(c)), c == 32
    start = np.maximum.accumulate(np.where(gap, at, 0))
    upto = np.cumsum(c * _POWERS[(at - start) % len(_POWERS)], dtype=np.uint64)
    h = upto - upto[start]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.where(gap, 32, 33 + (h >> np.uint64(40)) % np.uint64(223)).astype(np.uint8).tobytes()


def windows(text: str | None) -> list[bytes]:
    data = coded(plain(text))
    return [ANCHOR + data[i:i + WINDOW] + TAIL for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


def dictionary(pieces: list[str]) -> zstandard.ZstdCompressionDict:
    """A content dictionary; the most telling pieces come last, where matches are cheapest."""
    content = b"".join(coded(f" {p}".encode("utf-8", "surrogatepass")) for p in reversed(pieces))
    return zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@dataclass
class Distance:
    """The two dictionaries, by their pieces, and the calibration of the window differences."""

    toxic: list[str]
    ordinary: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        parameters = zstandard.ZstdCompressionParameters(
            min_match=MIN_MATCH, strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=14, chain_log=14, search_log=5,
            write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        return [zstandard.ZstdCompressor(dict_data=dictionary(w), compression_params=parameters) for w in (self.ordinary, self.toxic)]

    def features(self, text: str | None, compressors) -> list[float]:
        """How much shorter the windows get with the toxic dictionary: hits, their share, the best and the three best."""
        by_ordinary, by_toxic = (c.compress for c in compressors)
        gains = np.array([len(by_ordinary(w)) - len(by_toxic(w)) for w in windows(text)])
        hits = int((gains >= HIT).sum())
        top = np.sort(gains)[-3:]
        return [1.0, np.log1p(hits), np.sqrt(hits / len(gains)), float(top[-1]) / 8, float(top.mean()) / 8]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, mod: int, held: int, most: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled rows outside the held-out fold: of each class about ``most``, picked by a hash of doc_id."""
    y = label_of(labels, "toxic").where(crc_remainder("doc_id", mod) != held)
    counts = {r.y: r.n for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, most / n) for k, n in counts.items()}
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    picked = y.where(spot < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * 1_000_000)
    # About 2 * most rows of two numbers, whatever the corpus: no text is shuffled.
    return id_and_text(docs).join(F.broadcast(picked), "doc_id").select("text", "y"), counts


def contrasts(rows: DataFrame) -> DataFrame:
    """(piece, gain): positive where a piece is typical of toxic text, negative where of ordinary text.

    A piece is a word with a space after it or a word's beginning.  A word counts once for each different word before
    it, so a passage that many documents copy counts once; a beginning counts as often as the words that have it.  The
    gain is the contrast times the bytes a match of the piece covers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: list[set] = [set(), set()]
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                words = plain(t.as_py()).decode("utf-8", "replace").split()
                seen[y].update(zip(words[1:], words))
            for y in (0, 1):
                if seen[y]:
                    word, before = zip(*seen[y])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([y] * len(word), pa.int32()), pa.array(word), pa.array(before)], ["y", "word", "before"]
                    )

    pairs = rows.mapInArrow(run, "y int, word string, before string").groupBy(
        "y", "word", F.xxhash64("before").alias("before")
    ).agg(F.lit(1).alias("one"))
    words = pairs.groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o"))
    totals = words.agg((F.sum("t") + 1).alias("nt"), (F.sum("o") + 1).alias("no"))
    lengths = F.filter(F.lit(list(BEGINNING)), lambda n: n < F.length("word"))
    beginnings = F.transform(lengths, lambda n: F.substring(F.col("word"), F.lit(1), n))
    pieces = words.select(F.explode(F.concat(F.array(F.concat("word", F.lit(" "))), beginnings)).alias("piece"), "t", "o")
    counts = pieces.groupBy("piece").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    rate = F.log((F.col("t") + 0.5) / F.col("nt")) - F.log((F.col("o") + 0.5) / F.col("no"))
    times = F.when(rate > 0, F.col("t")).otherwise(F.col("o"))
    long_enough = F.octet_length("piece") >= BEGINNING[0]
    return counts.where((F.col("t") + F.col("o") >= 3) & long_enough).join(F.broadcast(totals)).where(F.abs(rate) >= LEAST_RATE).select(
        "piece", (times * rate * F.octet_length("piece")).alias("gain")
    )


def apart(pieces: list[str], most: int) -> list[str]:
    """The first ``most`` pieces of which none begins an earlier one or is begun by it."""
    kept: list[str] = []
    for p in pieces:
        if len(kept) < most and not any(p.startswith(k) or k.startswith(p) for k in kept):
            kept.append(p)
    return kept


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, most: int = 5_000, most_words: int = 256) -> Distance | float:
    """Both dictionaries and the calibration; without rows of both classes the share of toxic ones.

    The toxic dictionary holds the pieces whose gain is at least a twentieth of the strongest one's, the ordinary
    dictionary the pieces most typical of ordinary text, to the same size.  ``most`` bounds the labelled documents of
    each class that are learnt from, ``most_words`` the pieces of a dictionary.
    """
    rows, counts = training_rows(docs, labels, mod, held, most)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if min(n0, n1) < 2:
        return float(n1 / (n0 + n1)) if n0 + n1 else 0.0
    rows = materialize(rows)
    gains = materialize(contrasts(rows))
    top = gains.where("gain > 0").orderBy(F.desc("gain"), "piece").limit(SHORTLIST).collect()
    low = gains.where("gain < 0").orderBy("gain", "piece").limit(SHORTLIST).collect()
    toxic = apart([r.piece for r in top if r.gain * FLOOR >= top[0].gain], most_words)
    model = Distance(toxic, apart([r.piece for r in low], len(toxic)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in slices(batches):
            x = [model.features(t.as_py(), compressors) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    # At most 2 * most rows of five numbers come to the driver.
    found = rows.mapInArrow(run, "y int, x array<double>").collect()
    x, y = np.array([r.x for r in found]).reshape(-1, 5), np.array([r.y for r in found])
    if len(set(y.tolist())) < 2:
        return float(n1 / (n0 + n1))
    weight = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))
    model.weights = logistic(x, y, weight / weight.mean())
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    damp = ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + damp @ w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + damp, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, cut: float = 0.5, most: int = 5_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (higher: toxic likelier) and predicted (score >= ``cut``).

    Labels are learnt only from rows whose crc32(doc_id) modulo ``mod`` is not ``held``; language, source and doc_id are
    never inputs.  Every window of the whole text counts.  Null and empty texts are scored as one empty window.  Rows
    without doc_id are scored and not held out.  Repeated rows get equal scores; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    model = train(docs, labels, mod, held, most)
    source = id_and_text(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = None if isinstance(model, float) else model.compressors()
        for batch in slices(batches):
            if compressors is None:
                s = np.full(batch.num_rows, model)
            else:
                s = model.scores(np.array([model.features(t.as_py(), compressors) for t in batch.column("text")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    held_out = F.coalesce(crc_remainder("doc_id", mod) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
