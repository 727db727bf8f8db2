"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.llm.arrow import bounded_batches, slices, words_of
from locusweave.session import materialize

_SYMBOLS = re.compile(r"[#*$%&|<>]+")
_LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")
_NOT_WORD = re.compile(r"[\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rates that are judged: name, numerator, denominator, smallest upper distance of a fence from the
#: quartile, and whether low values are suspect too.
RATES = (
    ("symbol_rate", "n_symbols", "word_chars", 0.02, False),
    ("dup_line_rate", "n_dup_lines", "n_lines", 0.35, False),
    ("repeat_rate", "n_repeat_words", "n_words", 0.15, False),
    ("word_length", "word_chars", "n_words", 1.5, True),
)
#: Relative width of a sketch bucket: quantiles are right to about 1 %.
GAMMA = 1.02
_LOG = 0.01980262729617973  # ln(GAMMA)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside a window of ``width`` words that occurs twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(width))))
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    if not twice:
        return 0
    n = until = 0
    for i, w in enumerate(windows):
        if w in twice:
            n += i + width - max(i, until)
            until = i + width
    return n


def text_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if _LINE_WORD.search(x)]
    symbols = sum(map(len, _SYMBOLS.findall(text)))
    return len(words), len(_NOT_WORD.sub("", text)), symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts) for every row; a null text counts as none."""
    bounded_batches(docs.sparkSession)
    source = docs.select("doc_id", docs["lang"].cast("string"), docs["source"].cast("string"), docs["text"].cast("string"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [text_counts(t.as_py()) for t in batch.column("text")]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "source")] + columns, ["doc_id", "lang", "source", *COUNTS]
            )

    return source.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def bucket(rate: Column) -> Column:
    """Sketch bucket of a rate: 0 for zero, else buckets whose bounds grow by GAMMA."""
    return F.when(rate > 0, F.ceil(F.log(rate) / F.lit(_LOG)) + 10_000).otherwise(F.lit(0)).cast("bigint")


def bucket_value(b: Column) -> Column:
    """The middle of a bucket."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), b - 10_000) * (2 / (1 + GAMMA)))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): one mergeable sketch per group and rate.

    A sketch is a table of bucket counts, so merging is adding, the partial sums of tasks merge before the shuffle,
    and a group that holds most rows sends no more than its buckets.
    """
    rates = [
        F.struct(F.lit(i).alias("rate"), bucket(F.col(up) / F.col(down)).alias("bucket"))
        for i, (_, up, down, _, _) in enumerate(RATES)
    ]
    return (
        counts.where("n_words > 0").select("lang", "source", F.explode(F.array(*rates)).alias("r"))
        .groupBy("lang", "source", "r.rate", "r.bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, q25, q75, total) read off merged sketches; the windows hold one sketch's buckets."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rate")
    seen = F.sum("n").over(group.orderBy("bucket"))
    ranked = merged.withColumns({"seen": seen, "total": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("seen") * 4 >= F.col("total") * q, F.col("bucket")))
    return ranked.groupBy(*keys, "rate").agg(
        bucket_value(at(1)).alias("q25"), bucket_value(at(3)).alias("q75"), F.max("total").alias("total")
    )


def fences(sketch: DataFrame, reach: float = 4.0, enough: int = 100) -> DataFrame:
    """(lang, source, rate, low, high) per group; groups of fewer than ``enough`` texts use the merged sketch of their language."""
    floor, two_sided = F.lit(0.0), F.lit(False)
    for i, (_, _, _, least, both) in enumerate(RATES):
        floor = F.when(F.col("rate") == i, F.lit(float(least))).otherwise(floor)
        two_sided = F.when(F.col("rate") == i, F.lit(both)).otherwise(two_sided)
    own = quartiles(sketch, ["lang", "source"]).alias("own")
    wide = quartiles(sketch, ["lang"]).alias("wide")
    pick = lambda c: F.when(F.col("own.total") >= enough, F.col(f"own.{c}")).otherwise(F.col(f"wide.{c}"))
    both = own.join(wide, F.col("own.lang").eqNullSafe(F.col("wide.lang")) & (F.col("own.rate") == F.col("wide.rate"))).select(
        "own.lang", "own.source", "own.rate", pick("q25").alias("q25"), pick("q75").alias("q75")
    )
    step = F.greatest(floor, F.lit(reach) * (F.col("q75") - F.col("q25")))
    return both.select(
        "lang", "source", "rate", F.when(two_sided, F.col("q25") - step).otherwise(F.lit(-1.0)).alias("low"),
        (F.col("q75") + step).alias("high"),
    )


def quality_rules(docs: DataFrame, reach: float = 4.0, enough: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, base_failed, kept and the rates that were out of bounds.

    Each language and source has fences around its own quartiles, ``reach`` interquartile distances (and at
    least a rate's smallest distance) away; texts beyond a fence are rejected.  All texts with a word feed the
    sketches.  Base failures (under 10 words, or over 20 % repeated words) are rejected whatever the fences say.
    Null languages and sources form groups of their own; a null or empty text fails the base rules.  Repeated
    rows count as often as they come; other columns are ignored; an empty table gives an empty result.
    """
    counts = materialize(measured(docs))
    bounds = fences(sketches(counts), reach, enough)
    per_group = bounds.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rate") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(RATES)) for c in ("low", "high")]
    )
    # Language and source pairs are looked up by a digest that tells null from empty.
    key = F.xxhash64(F.col("lang"), F.col("lang").isNull(), F.col("source"), F.col("source").isNull())
    looked = counts.withColumn("_group", key).alias("c").join(
        per_group.withColumn("_group", key).alias("g"),
        (F.col("c._group") == F.col("g._group")) & F.col("c.lang").eqNullSafe(F.col("g.lang"))
        & F.col("c.source").eqNullSafe(F.col("g.source")), "left",
    )
    out_of = []
    for i, (name, up, down, _, _) in enumerate(RATES):
        rate = F.when(F.col(f"c.{down}") > 0, F.col(f"c.{up}") / F.col(f"c.{down}")).otherwise(F.lit(0.0))
        out_of.append(F.when((rate > F.col(f"g.high{i}")) | (rate < F.col(f"g.low{i}")), F.lit(name)))
    failed = (F.col("c.n_words") < 10) | (100 * F.col("c.n_repeat_words") > 20 * F.col("c.n_words"))
    return looked.select(
        "c.doc_id", *[f"c.{c}" for c in COUNTS[:5]], failed.alias("base_failed"), F.concat_ws(",", *out_of).alias("outside")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("outside") == ""))
