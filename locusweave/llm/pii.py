"""Personal data: patterns find direct identifiers, corpus co-occurrence the terms that reveal them."""

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.arrow import bounded_batches, id_and_text, slices
from locusweave.llm.decontaminate import text_words, word_hash
from locusweave.llm.spans import listing
from locusweave.session import materialize

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of an identifier that are its context.
CONTEXT = 8
#: Slots of the bit table that keeps uninteresting words out of the second pass.
SLOTS = 1 << 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The same matches as the plain patterns; possessive runs and the look-behind only keep long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _NOT_DIGIT = re.compile(r"[0-9]"), re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\W_]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: each @ has the local part that runs up to it."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, stop) of all base matches that hold."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def contexts(text: str, found: list[tuple[int, int, int]], reach: int = CONTEXT) -> list[tuple[int, int, int, int]]:
    """(entity, term, start, stop) for the words around each identifier that belong to none."""
    out = []
    inside = [(a, b) for a, _, b in found]
    words = [m.span() for m in _WORD.finditer(text)] if found else []
    ends = [e for _, e in words]
    for a, rank, b in found:
        entity = signed(xxhash.xxh64_intdigest(f"{rank}:{text[a:b].lower()}".encode("utf-8", "surrogatepass")))
        # Words that end before the identifier, however far back; one that runs into it is no whole word.
        upto = bisect_right(ends, a)
        near = words[max(0, upto - reach):upto]
        for n, m in enumerate(_WORD.finditer(text, b)):
            if n == reach:
                break
            near.append((m.start(), m.end()))
        for s, e in near:
            if not any(s < y and x < e for x, y in inside if x < e and s < y):
                out.append((entity, signed(word_hash(text[s:e].lower())), s, e))
    return out


def detected(docs: DataFrame, reach: int = CONTEXT) -> DataFrame:
    """Per row: doc_id, a digest of the text, base spans, and the identifiers' context words with their places."""
    bounded_batches(docs.sparkSession)
    source = id_and_text(docs)
    span = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32())]))
    near = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, bases, context = [], [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                found = identifiers(text)
                digests.append(xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass")))
                bases.append([{"start": a, "rank": k, "stop": b} for a, k, b in found])
                context.append([{"entity": e, "term": w, "start": a, "stop": b} for e, w, a, b in contexts(text, found, reach)] if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests), pa.array(bases, span), pa.array(context, near)], ["doc_id", "digest", "base", "near"]
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"doc_id {kind}, digest string, base array<struct<start:int,rank:int,stop:int>>, "
        "near array<struct<entity:long,term:long,start:int,stop:int>>"
    )


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_docs): the documents each of ``terms`` occurs in.

    Words outside the terms' slots of a bit table of fixed size are left out at once; chance hits drop out in the join.
    """
    slot = F.pmod("term", F.lit(SLOTS))
    marked = terms.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    wanted = np.zeros(SLOTS, bool)
    for r in marked.collect():  # at most SLOTS / 32768 + 1 rows
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        places = (r.bucket - 1) * 32768 + 1 + np.flatnonzero(bits) if r.bucket > 0 else np.flatnonzero(bits)
        wanted[places[places < SLOTS]] = True
        if r.bucket == 0 and bits[0]:
            wanted[0] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, bounds = text_words(batch.column("text"))
            at = np.flatnonzero(wanted[words & np.uint64(SLOTS - 1)])
            doc = np.searchsorted(bounds, at, side="right") - 1
            term, code = np.unique(words[at], return_inverse=True)
            pairs = np.unique(doc * max(1, len(term)) + code)
            n = np.bincount(pairs % max(1, len(term)), minlength=len(term))
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    counted = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_docs")).join(terms.select("term").distinct(), "term", "left_semi")


def disclosing(docs: DataFrame, found: DataFrame, support: int = 3, given: float = 0.5, bits: float = 3.0) -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal an identifier.

    Disclosure is the pointwise mutual information log2(P(entity | term) / P(entity)) over all documents.  A term counts
    if it has at least ``bits``, if P(entity | term) is ``given`` or more, and if it stands by the identifier in ``support``
    different texts; copies of one text are one text there, but count as documents in the probabilities.
    """
    texts = found.where(F.size("base") > 0).groupBy("digest").agg(F.first("near").alias("near"), F.count(F.lit(1)).alias("copies"))
    pairs = texts.select("copies", F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("p"))
    both = materialize(
        pairs.groupBy("p.entity", "p.term").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("together")).where(F.col("texts") >= support)
    )
    entities = texts.select("copies", F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
    per_entity = entities.groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    n = found.agg(F.count(F.lit(1)).alias("n_all"))
    rated = (
        both.join(term_frequencies(docs, both), "term").join(per_entity, "entity").join(F.broadcast(n))
        .withColumn("chance", F.col("together") / F.greatest("n_docs", "together"))
        .withColumn("disclosure", F.log2(F.col("chance") / (F.col("n_entity") / F.col("n_all"))))
    )
    return rated.where((F.col("chance") >= given) & (F.col("disclosure") >= bits)).select("entity", "term", "disclosure")


def pii_spans(docs: DataFrame, support: int = 3, given: float = 0.5, bits: float = 3.0, reach: int = CONTEXT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, term_spans, digest.

    Base spans are the direct identifiers.  Kind ``term`` adds context words of an identifier whose disclosure
    passes the thresholds (see ``disclosing``); texts without identifiers get none.  Null and empty texts have no
    spans.  Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """
    found = materialize(detected(docs, reach))
    revealing = materialize(disclosing(docs, found, support, given, bits))
    near = (
        found.where(F.size("near") > 0).groupBy("digest").agg(F.first("near").alias("near"))
        .select("digest", F.explode("near").alias("x"))
        .select("digest", F.col("x.entity").alias("entity"), F.col("x.term").alias("term"), "x.start", "x.stop")
    )
    span = F.struct("start", F.lit(KINDS.index("term")).alias("rank"), "stop")
    terms = near.join(revealing, ["entity", "term"], "left_semi").groupBy("digest").agg(F.array_sort(F.collect_set(span)).alias("terms"))
    none = F.array().cast("array<struct<start:int,rank:int,stop:int>>")
    joined = found.join(terms, "digest", "left").withColumn("terms", F.coalesce("terms", none))
    of_kind = lambda k: F.filter("base", lambda s: s["rank"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(4)]
    return joined.select(
        "doc_id", *counts, F.sha2(listing(F.col("base"), KINDS), 256).alias("base_sha256"),
        listing(F.concat("base", "terms"), KINDS).alias("spans"), F.size("terms").cast("bigint").alias("n_term"),
        F.array_sort(F.concat("base", "terms")).alias("all_spans"), "digest",
    )


def generalised(word: str) -> str:
    """What a revealing term becomes: numbers and names keep their class, other words are removed."""
    if any(c.isdigit() for c in word):
        return "<number>"
    return "<name>" if word[:1].isupper() else ""


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in sorted(spans):
        if b > at:
            # Of overlapping spans the later one only covers what is left.
            out += [text[at:max(at, a)], generalised(text[a:b]) if KINDS[k] == "term" else f"<{KINDS[k]}>" if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) with identifiers replaced by their kind and revealing terms generalised or removed; null texts stay."""
    bounded_batches(docs.sparkSession)
    per_text = pii_spans(docs, **options).where(F.size("all_spans") > 0).groupBy("digest").agg(F.first("all_spans").alias("all_spans"))
    source = id_and_text(docs)
    kind = source.schema["doc_id"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests = [xxhash.xxh3_128_hexdigest((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests)], ["doc_id", "text", "digest"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [
                t if not s else replaced(t, [(x["start"], x["rank"], x["stop"]) for x in s])
                for t, s in zip(batch.column("text").to_pylist(), batch.column("all_spans").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    marked = source.mapInArrow(mark, f"doc_id {kind}, text string, digest string").join(per_text, "digest", "left")
    return marked.select("doc_id", "text", "all_spans").mapInArrow(put, f"doc_id {kind}, text string")
