"""CIGAR functions as higher-order column expressions over ARRAY<STRUCT<op, len>>."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that move along the reference without an intron (fixed values of the SAM format).
REF_OPS = ("M", "=", "X", "D")
#: Operations that move along the query (fixed values of the SAM format).
QUERY_OPS = ("M", "I", "S", "=", "X")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _in(op: Column, ops) -> Column:
    return op.isin(list(ops))


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _empty(kind: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<{kind}>") if kind.startswith("struct") else F.array().cast(f"array<{kind}>")


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once; higher-order functions are not shared otherwise."""
    return F.transform(F.array(value), fn)[0]


def reference_length(cigar) -> Column:
    """Reference bases spanned, introns included."""
    return F.aggregate(
        _c(cigar),
        _long(0),
        lambda acc, x: acc + F.when(_in(x["op"], (*REF_OPS, "N")), x["len"]).otherwise(0).cast("bigint"),
    )


def aligned_length(cigar) -> Column:
    """Reference-consuming length without introns."""
    return F.aggregate(
        _c(cigar),
        _long(0),
        lambda acc, x: acc + F.when(_in(x["op"], REF_OPS), x["len"]).otherwise(0).cast("bigint"),
    )


def query_length(cigar) -> Column:
    return F.aggregate(
        _c(cigar),
        _long(0),
        lambda acc, x: acc + F.when(_in(x["op"], QUERY_OPS), x["len"]).otherwise(0).cast("bigint"),
    )


def matched_bases(cigar) -> Column:
    return F.aggregate(
        _c(cigar),
        _long(0),
        lambda acc, x: acc + F.when(_in(x["op"], ("M", "=", "X")), x["len"]).otherwise(0).cast("bigint"),
    )


def end_position(start, cigar) -> Column:
    """Start plus spanned reference bases."""
    return _c(start) + reference_length(cigar)


def intron_count(cigar) -> Column:
    return F.size(F.filter(_c(cigar), lambda x: x["op"] == "N"))


def splice_junctions(start, cigar) -> Column:
    """Introns as ARRAY<STRUCT<start, end>> in reference order."""
    state = F.struct(_c(start).cast("bigint").alias("pos"), _empty("struct<start:bigint,end:bigint>").alias("out"))

    def step(acc, x):
        stop = acc["pos"] + x["len"]
        return F.when(
            x["op"] == "N",
            F.struct(
                stop.alias("pos"),
                F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("start"), stop.alias("end")))).alias("out"),
            ),
        ).otherwise(
            F.struct(
                F.when(_in(x["op"], REF_OPS), stop).otherwise(acc["pos"]).alias("pos"), acc["out"].alias("out")
            )
        )

    return F.aggregate(_c(cigar), state, step, lambda acc: acc["out"])


def junction_positions(start, cigar, advance: bool = False) -> Column:
    """Both ends of every intron as a flat array.

    With ``advance=False`` the position does not move past an intron, so the ends of later introns
    are shifted left by the lengths of earlier ones; this is the convention of the junction split.
    ``advance=True`` gives true reference positions.
    """
    state = F.struct(_c(start).cast("bigint").alias("pos"), _empty("bigint").alias("out"))

    def step(acc, x):
        stop = acc["pos"] + x["len"]
        return F.when(
            x["op"] == "N",
            F.struct(
                (stop if advance else acc["pos"]).alias("pos"),
                F.concat(acc["out"], F.array(acc["pos"], stop)).alias("out"),
            ),
        ).otherwise(
            F.struct(
                F.when(_in(x["op"], REF_OPS), stop).otherwise(acc["pos"]).alias("pos"), acc["out"].alias("out")
            )
        )

    return F.aggregate(_c(cigar), state, step, lambda acc: acc["out"])


def exon_blocks(start, cigar) -> Column:
    """Exon blocks ARRAY<STRUCT<start, end>>: reference operations grow a block, an intron closes it."""
    state = F.struct(
        _c(start).cast("bigint").alias("open"),
        _c(start).cast("bigint").alias("pos"),
        _empty("struct<start:bigint,end:bigint>").alias("out"),
    )

    def closed(acc):
        block = F.array(F.struct(acc["open"].alias("start"), acc["pos"].alias("end")))
        return F.when(acc["pos"] > acc["open"], F.concat(acc["out"], block)).otherwise(acc["out"])

    def step(acc, x):
        stop = acc["pos"] + x["len"]
        return F.when(
            x["op"] == "N", F.struct(stop.alias("open"), stop.alias("pos"), closed(acc).alias("out"))
        ).otherwise(
            F.struct(
                acc["open"].alias("open"),
                F.when(_in(x["op"], REF_OPS), stop).otherwise(acc["pos"]).alias("pos"),
                acc["out"].alias("out"),
            )
        )

    return F.aggregate(_c(cigar), state, step, closed)


def exon_shell(start, cigar) -> Column:
    """STRUCT<start, end> from the first exon's start to the last exon's end; null without exons."""
    return _let(
        exon_blocks(start, cigar),
        lambda b: F.when(
            F.size(b) > 0,
            F.struct(F.element_at(b, 1)["start"].alias("start"), F.element_at(b, -1)["end"].alias("end")),
        ),
    )


def acceptor_sites(start, cigar) -> Column:
    """Reference positions right after each intron."""
    return F.transform(splice_junctions(start, cigar), lambda j: j["end"])


def three_prime_clip(cigar, reverse) -> Column:
    """Query interval STRUCT<start, end> of the 3' soft clip, null when there is none.

    Reverse strand: only a leading clip counts.  Forward strand: a trailing clip, else the last clip
    of the read unless the only clip is a leading one.
    """
    ops = _c(cigar)
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    first, last = F.try_element_at(ops, F.lit(1)), F.try_element_at(ops, F.lit(-1))
    state = F.struct(
        _long(0).alias("q"), _long(0).alias("n"), _long(-1).alias("s"), _long(-1).alias("e")
    )

    def step(acc, x):
        clip = x["op"] == "S"
        used = F.when(_in(x["op"], QUERY_OPS), x["len"]).otherwise(0).cast("bigint")
        return F.struct(
            (acc["q"] + used).alias("q"),
            (acc["n"] + clip.cast("bigint")).alias("n"),
            F.when(clip, acc["q"]).otherwise(acc["s"]).alias("s"),
            F.when(clip, acc["q"] + x["len"]).otherwise(acc["e"]).alias("e"),
        )

    def interval(found):
        inner = (found["n"] > 0) & ~((found["n"] == 1) & (found["s"] == 0))
        return F.when(
            (last["op"] == "S") | inner, F.struct(found["s"].alias("start"), found["e"].alias("end"))
        ).otherwise(none)

    lead = F.when(
        first["op"] == "S", F.struct(_long(0).alias("start"), first["len"].cast("bigint").alias("end"))
    ).otherwise(none)
    return F.when(_c(reverse), lead).otherwise(_let(F.aggregate(ops, state, step), interval))


def soft_clip_lengths(cigar, reverse) -> Column:
    """STRUCT<five, three>: soft-clip lengths at the transcript's 5' and 3' end."""
    ops = _c(cigar)
    first, last = F.try_element_at(ops, F.lit(1)), F.try_element_at(ops, F.lit(-1))
    lead = F.coalesce(F.when(first["op"] == "S", first["len"].cast("bigint")), _long(0))
    tail = F.coalesce(F.when(last["op"] == "S", last["len"].cast("bigint")), _long(0))
    # Only a forward read without a trailing clip needs the walk over all operations.
    inner = _let(three_prime_clip(ops, F.lit(False)), lambda c: F.coalesce(c["end"] - c["start"], _long(0)))
    three = F.when(_c(reverse), lead).when(last["op"] == "S", tail).otherwise(inner)
    return F.struct(F.when(_c(reverse), tail).otherwise(lead).alias("five"), three.alias("three"))


def a_fraction(bases) -> Column:
    """Share of A among the bases of a string, 0 when empty."""
    n = F.length(_c(bases))
    a = n - F.length(F.regexp_replace(_c(bases), "[Aa]", ""))
    return F.when(n > 0, a / n).otherwise(F.lit(0.0))


def signature_similarity(a, b, tolerance: int = 10) -> Column:
    """Jaccard of two junction lists where a junction of ``a`` matches within ``tolerance`` at both ends."""
    matched = F.size(
        F.filter(
            _c(a),
            lambda x: F.exists(
                _c(b),
                lambda y: (F.abs(x["start"] - y["start"]) <= tolerance) & (F.abs(x["end"] - y["end"]) <= tolerance),
            ),
        )
    )
    na, nb = F.size(_c(a)), F.size(_c(b))
    return F.when((na > 0) & (nb > 0), _let(matched, lambda m: m / (na + nb - m))).otherwise(F.lit(0.0))
