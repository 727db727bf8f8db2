"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.arrow import bounded_batches, id_and_text, slices
from locusweave.session import materialize

FEATURES = (
    "length", "word_length", "symbols", "bars", "exclamations", "upper_case", "digits", "stutter", "variety",
    "same_lines", "punctuation", "word_spread",
)
_SYMBOL, _UPPER, _DIGIT = re.compile(r"[#*$%&<>]"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]")
_PUNCTUATION = re.compile(r"[.,;:?]")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; a null or empty text has the values of a text without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    n, chars = len(words), float(lengths.sum())
    lines = [x for x in text.split("\n") if x.strip()]
    stutter = sum(a == b for a, b in zip(words, words[1:])) / n
    rate = lambda pattern: sqrt(len(pattern.findall(text)) / chars)
    return [
        log1p(n), log1p(chars / n), rate(_SYMBOL), sqrt(text.count("|") / n), sqrt(text.count("!") / n), rate(_UPPER),
        rate(_DIGIT), sqrt(stutter), log1p(len(set(words))) / log1p(n), sqrt(1 - len(set(lines)) / len(lines)),
        rate(_PUNCTUATION), log1p(float(lengths.std())),
    ]


def featured(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    source = id_and_text(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Quadratic:
    """Means, cached inverse Cholesky factors and log determinants of both classes."""

    means: np.ndarray
    inverse_factors: np.ndarray
    offset: float
    scale: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: squared Mahalanobis distances are lengths under the inverse factors."""
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.inverse_factors)]
        z = (0.5 * (far[0] - far[1]) + self.offset) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def moments(rows: DataFrame, width: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: count, sums and cross products.  Tasks send sums, so the driver gets two rows of fixed width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                of = x[y == k]
                total[k] += np.concatenate([[len(of)], of.sum(axis=0), (of.T @ of).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["y", "m"])

    parts = rows.select("x", "y").mapInArrow(run, "y int, m array<double>").select("y", F.posexplode("m").alias("i", "v"))
    sums = np.zeros((2, 1 + width + width * width))
    for r in parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        sums[r.y, r.i] = r.v
    return {k: (s[0], s[1:1 + width], s[1 + width:].reshape(width, width)) for k, s in enumerate(sums)}


def fit(rows: DataFrame, width: int = len(FEATURES), shrinkage: float = 0.1, floor: float = 1e-4, scale: float = 1.0) -> Quadratic | float:
    """The discriminant of labelled ``rows`` (x, y); with fewer than two rows in a class the share of class 1.

    Each class covariance is shrunk towards the diagonal of the pooled one, and ``floor`` is added to every
    variance, so a constant statistic does not make it singular.
    """
    found = moments(rows, width)
    n0, n1 = found[0][0], found[1][0]
    if min(n0, n1) < 2:
        return n1 / (n0 + n1) if n0 + n1 else 0.5
    means, covariances = [], []
    for n, s, ss in found.values():
        m = s / n
        means.append(m)
        covariances.append(ss / n - np.outer(m, m))
    pooled = np.diag(np.diag((n0 * covariances[0] + n1 * covariances[1]) / (n0 + n1)))
    factors, logs = [], []
    for c in covariances:
        factor = np.linalg.cholesky((1 - shrinkage) * c + shrinkage * pooled + floor * np.eye(width))
        factors.append(np.linalg.inv(factor))
        logs.append(np.log(np.diag(factor)).sum())
    return Quadratic(np.array(means), np.array(factors), float(logs[0] - logs[1] + np.log(n1 / n0)), scale)


def scored(features: DataFrame, model: Quadratic | float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            s = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")


def crc_remainder(column: str, mod: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def label_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one label for an id; contradicting repeats go by their mean, a tie to 1."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("y"))
    )


def quality_scores(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (higher: quality 1 likelier) and predicted (score >= ``cut``).

    Labels are learnt from all labelled rows whose crc32(doc_id) modulo ``mod`` is not ``held``; language, source
    and doc_id are never inputs.  Null and empty texts are scored as texts without words.  Rows without
    doc_id are scored, not learnt from, and not held out.  Repeated rows get equal scores; other columns are ignored.
    """
    features = materialize(featured(docs))
    train = features.where(crc_remainder("doc_id", mod) != held).join(label_of(labels, "quality"), "doc_id")
    model = fit(train)
    held_out = F.coalesce(crc_remainder("doc_id", mod) == held, F.lit(False))
    return scored(features, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier of ``quality_scores`` gives ``cut`` or more, with all their columns."""
    train = featured(docs).where(crc_remainder("doc_id", mod) != held).join(label_of(labels, "quality"), "doc_id")
    model = fit(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t.as_py()) for t in batch.column("text")])
            s = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
            yield batch.filter(pa.array(s >= cut))

    return docs.mapInArrow(run, docs.schema)
