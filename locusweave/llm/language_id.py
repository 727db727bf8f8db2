"""Language identification by compression: each language has a zstandard raw-content dictionary of its own text.

A text is cut into windows, every window is compressed with each dictionary, and the language that needs the fewest
bytes in all is the answer.  The byte counts become probabilities by one calibrated factor; where the best and the
next are too close the answer is rejected.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.arrow import bounded_batches, id_and_text, slices
from locusweave.llm.qda import crc_remainder
from locusweave.session import materialize

_GAP = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: Bytes of a window, of a dictionary and of a piece of text that goes into one.
WINDOW, CONTENT, PIECE = 4096, 1 << 16, 512
#: Every dictionary ends with this and every window begins with it.  It always matches, so that also short windows are
#: stored in compressed form and their lengths compare byte by byte.
ANCHOR = bytes(range(1, 31))
#: Follows every window, as zstandard looks for no match that begins in the last bytes of a block.
TAIL = ANCHOR[:10]
#: Factors tried for the calibration, and the share of wrong labels it allows for.
FACTORS = [2.0 ** k for k in range(-7, 2)]
WRONG = 0.01
UNKNOWN = "und"


def plain(text: str | None) -> bytes:
    """Lower case, one space for whatever is no letter; empty if there is no letter."""
    if not text or not _LETTER.search(text):
        return b""
    return _GAP.sub(" ", f" {text.lower()} ").encode("utf-8", "surrogatepass")


def pieces(text: str | None, count: int) -> list[bytes]:
    """``count`` pieces spread evenly over the text, or all of it where that is shorter."""
    data = plain(text)
    if len(data) <= count * PIECE:
        return [data] if data else []
    return [data[i:i + PIECE] for i in np.linspace(0, len(data) - PIECE, count + 2)[1:-1].astype(int).tolist()]


@dataclass
class Languages:
    """Learnt languages, commonest first, with their dictionaries and the calibrated factor."""

    names: list[str]
    contents: list[bytes]
    factor: float = 0.25

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        how = zstandard.ZstdCompressionParameters(
            min_match=4, strategy=zstandard.STRATEGY_GREEDY, window_log=18, hash_log=16, chain_log=16, search_log=3,
            write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        raw = zstandard.DICT_TYPE_RAWCONTENT
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c + ANCHOR, dict_type=raw), compression_params=how) for c in self.contents]

    def lengths(self, data: bytes, compressors) -> np.ndarray:
        """Compressed bytes under each dictionary."""
        total = np.zeros(len(compressors), np.int64)
        for i in range(0, len(data), WINDOW):
            window = ANCHOR + data[i:i + WINDOW] + TAIL
            total += [len(c.compress(window)) for c in compressors]
        return total

    def chances(self, lengths: np.ndarray, factor: float | None = None) -> np.ndarray:
        p = np.exp(-(self.factor if factor is None else factor) * (lengths - lengths.min()))
        return p / p.sum()


def learn(docs: DataFrame, mod: int = 3, held: int = 1, most: int = 512) -> Languages | None:
    """Dictionaries and calibration from the rows outside the held-out fold; about ``most`` documents of each language.

    Half of a language's picked documents give pieces of text for its dictionary, the other half is for the
    calibration; where fewer than 20 were picked all go into the dictionary.
    """
    rows = docs.where((crc_remainder("doc_id", mod) != held) & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("spot")
    )
    # One row a language.
    counts = rows.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    n = {r.lang: r.n for r in sorted(counts, key=lambda r: (-r.n, r.lang))}
    per = {k: min(v, most) // (1 if min(v, most) < 20 else 2) for k, v in n.items()}
    each = {k: max(1, -(-CONTENT // (PIECE * max(1, v)))) for k, v in per.items()}
    share = F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, min(1.0, most / v))))[F.col("lang")]
    picked = materialize(rows.where(F.pmod("spot", F.lit(1 << 20)) < share * (1 << 20)).where(F.col("text").rlike(r"\p{L}")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for lang, text, spot in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("spot").to_pylist()):
                if n[lang] < 20 or spot >> 20 & 1:
                    found = pieces(text.as_py(), each[lang])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([spot] * len(found), pa.int64()), pa.array(found, pa.binary())], ["lang", "spot", "piece"])

    # About ``most`` documents of a language give twice its dictionary at most, whatever the corpus holds.
    content: dict[str, list[bytes]] = {k: [] for k in n}
    for r in picked.mapInArrow(cut, "lang string, spot long, piece binary").distinct().orderBy("lang", "spot", "piece").collect():
        content[r.lang].append(bytes(r.piece))
    model = Languages(list(n), [b"".join(dict.fromkeys(content[k]))[-CONTENT:] for k in n])

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors, at = model.compressors(), {k: i for i, k in enumerate(model.names)}
        total = np.zeros(len(FACTORS))
        for batch in slices(batches):
            for lang, text, spot in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("spot").to_pylist()):
                if n[lang] >= 20 and not spot >> 20 & 1:
                    lengths = model.lengths(plain(text.as_py()), compressors)
                    p = np.array([model.chances(lengths, f)[at[lang]] for f in FACTORS])
                    total -= np.log((1 - WRONG) * p + WRONG / len(at))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(FACTORS)), pa.int32()), pa.array(total)], ["i", "loss"])

    if len(n) > 1:
        loss = {r.i: r.loss for r in picked.mapInArrow(losses, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()}
        if any(loss.values()):
            model.factor = FACTORS[min(loss, key=lambda i: (round(loss[i], 9), i))]
    return model


def languages(docs: DataFrame, mod: int = 3, held: int = 1, most: int = 512, sure: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, n_letter_bytes, margin, rejected.

    Only text and non-null lang of rows whose crc32(doc_id) modulo ``mod`` is not ``held`` are learnt from; lang,
    source and doc_id are never inputs of a prediction.  Every window of the whole text counts.  lang_pred is a
    learnt language, the commoner one if bytes are equal; it is ``und`` with score 0 where the text is null or has no
    letter, or nothing could be learnt.  score is the calibrated chance of lang_pred, margin the bytes by which the
    next language is longer, and rejected says that score is under ``sure``: a narrow margin.  Rows without doc_id are
    neither learnt from nor held out.  Repeated rows get equal answers; an empty table gives an empty
    result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    model = learn(docs, mod, held, most)
    source = id_and_text(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model else []
        for batch in slices(batches):
            names, scores, margins, sizes = [], [], [], []
            for text in batch.column("text"):
                data = plain(text.as_py())
                sizes.append(len(data))
                if not data or not compressors:
                    names.append(UNKNOWN), scores.append(0.0), margins.append(0)
                    continue
                lengths = model.lengths(data, compressors)
                best = int(lengths.argmin())
                names.append(model.names[best])
                scores.append(float(model.chances(lengths)[best]))
                margins.append(int(np.partition(lengths, 1)[1] - lengths[best]) if len(lengths) > 1 else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(margins, pa.int64())],
                ["doc_id", "lang_pred", "score", "n_letter_bytes", "margin"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_letter_bytes long, margin long")
    return scored.select(
        "doc_id", F.coalesce(crc_remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "lang_pred", "score",
        "n_letter_bytes", "margin", (F.col("score") < sure).alias("rejected"),
    )
