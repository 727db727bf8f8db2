"""Vector codes by product quantisation, assigned with Drake-Hamerly adaptive bounds.

Vectors become integers and are cut into parts; each part position has a codebook.  The first assignment measures
every part against every entry and persists, for each part, the entry it got, the ``b`` next closest entries with
ordered lower bounds on their distances, and one lower bound for all others.  When the entries have moved, the
bounds are lowered by the moves; a part whose distance to its own entry lies below its first bound keeps it
unmeasured, others measure as many of the ``b`` as their bounds demand, and only where the outer bound fails too
are all entries measured.  Bounds are floats rounded to the safe side; whatever they do not prove is settled by
integer distances, so the codes are those of the plain method.

State is a written table, so a lost executor repeats its own tasks; codebooks (entries x vector length integers,
whatever the data) are all that passes through the driver.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.session import materialize

#: Integer components are held within this; squared distances of whole vectors of up to 64 components then fit 64 bits.
MOST = 1 << 27
#: Rows of a state batch; state rows are about 1 kB.
ROWS = 2048


@dataclass
class Codebooks:
    """``entries[p]`` holds the entries of part ``p`` as integers (entry, position)."""

    entries: list[np.ndarray]

    @property
    def parts(self) -> int:
        return len(self.entries)

    @property
    def size(self) -> int:
        return len(self.entries[0])

    def moves(self, older: "Codebooks") -> np.ndarray:
        """(part, entry): how far each entry has moved, rounded up."""
        gone = np.array([((a - b) ** 2).sum(axis=1) for a, b in zip(self.entries, older.entries)], np.float64)
        return np.nextafter(np.sqrt(gone), np.inf).reshape(self.parts, self.size) * (gone.reshape(self.parts, self.size) > 0)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def cuts_of(length: int, parts: int) -> list[int]:
    """Where the parts begin and end; equal parts where ``parts`` divides ``length``."""
    return [length * p // parts for p in range(parts + 1)]


def down(x: np.ndarray) -> np.ndarray:
    """As 16-bit floats that are not greater."""
    half = np.minimum(x, 65504.0).astype(np.float16)
    return np.where(half.astype(np.float64) > x, np.nextafter(half, np.float16(-np.inf)), half)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(row, entry): squared distances as integers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        step = x[:, i, None] - entries[None, :, i]
        out += step * step
    return out


def measured(x: np.ndarray, entries: np.ndarray, keep: int):
    """All entries measured: (code, nearest others, their bounds and the outer bound, squared distance)."""
    far = squares(x, entries)
    order = np.argsort(far, axis=1, kind="stable")
    code, near = order[:, 0], order[:, 1:keep + 1]
    root = np.sqrt(np.take_along_axis(far, order, axis=1).astype(np.float64)) * (1 - 1e-12)
    bounds = np.full((len(x), keep + 1), np.inf)
    have = root[:, 1:keep + 2]
    bounds[:, : have.shape[1]] = have
    return code, near, bounds, np.take_along_axis(far, code[:, None], axis=1)[:, 0]


def reassigned(x: np.ndarray, entries: np.ndarray, moves: np.ndarray, code: np.ndarray, near: np.ndarray, bounds: np.ndarray):
    """As ``measured``, from the state before ``entries`` moved; and how many bounds each row needed.

    That number is 0 where the old entry was proved nearest, ``near.shape[1] + 1`` where all were measured.
    """
    keep = near.shape[1]
    bounds = bounds - np.concatenate([moves[near], np.full((len(x), 1), moves.max(initial=0.0))], axis=1)
    # Lower bounds stay lower bounds when each takes the least of those behind it; then they are ordered.
    bounds = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1].copy()
    own = ((x - entries[code]) ** 2).sum(axis=1)
    reach = np.sqrt(own.astype(np.float64)) * (1 + 1e-12)
    # A bound proves its entry and all behind it farther only if it is truly greater: equal ones may tie.
    needed = (bounds <= reach[:, None]).sum(axis=1)
    code, near = code.copy(), near.copy()
    some = np.flatnonzero((needed > 0) & (needed <= keep))
    if len(some):
        m = int(needed[some].max())
        asked = np.arange(m)[None, :] < needed[some, None]
        ids = np.concatenate([code[some, None], near[some, :m]], axis=1)
        far = ((x[some, None, :] - entries[ids]) ** 2).sum(axis=2)
        asked = np.concatenate([np.ones((len(some), 1), bool), asked], axis=1)
        # Measured ones by distance, then index; the others keep their places behind them.
        place = np.broadcast_to(np.arange(m + 1), ids.shape)
        order = np.lexsort((np.where(asked, ids, place), np.where(asked, far, 0), ~asked), axis=1)
        ids, far, asked = (np.take_along_axis(v, order, axis=1) for v in (ids, far, asked))
        code[some], own[some], near[some, :m] = ids[:, 0], far[:, 0], ids[:, 1:]
        root = np.sqrt(far[:, 1:].astype(np.float64)) * (1 - 1e-12)
        bounds[some, :m] = np.where(asked[:, 1:], root, bounds[some, :m])
        bounds[some] = np.minimum.accumulate(bounds[some][:, ::-1], axis=1)[:, ::-1]
    every = np.flatnonzero(needed > keep)
    if len(every):
        code[every], near[every], bounds[every], own[every] = measured(x[every], entries, keep)
    return code, near, bounds, own, needed


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): kept rows with their components as integers ``floor(scale * x)``.

    Rows whose vector is null or holds a null or non-finite component are left out, and so are those of another
    length than most kept rows have (ties: the shorter).  Integers beyond 2^27 are set to that bound.
    """
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int")
    kept = vectors.where(F.col("embedding").isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    kept = materialize(kept.select("vec_id", "label", F.transform(x, whole).alias("v")))
    sizes = kept.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return kept.where(F.size("v") == (sizes[0].n if sizes else 0))


def first_codebooks(rows: DataFrame, parts: int, size: int) -> Codebooks | None:
    """The parts of the ``size`` rows with the smallest vec_id (equal ones by vector; rows without come last)."""
    # ``size`` rows, whatever the data.
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(size).collect()
    if not first:
        return None
    v = np.array([r.v for r in first], np.int64).reshape(len(first), -1)
    cuts = cuts_of(v.shape[1], parts)
    return Codebooks([v[:, a:b] for a, b in zip(cuts, cuts[1:])])


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _binary(a: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(a).reshape(len(a), -1).view(np.uint8)
    return pa.array([r.tobytes() for r in data], pa.binary())


def _array(column: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


STATE = "v array<int>, codes binary, errors long, near binary, bounds binary, needed binary"


def assign(rows: DataFrame, books: Codebooks, keep: int, older: Codebooks | None = None, kept: int = 0) -> DataFrame:
    """Every row with its codes under ``books`` and the bounds for the next time.

    ``older`` are the codebooks that the state in ``rows`` was made with, which holds ``kept`` bounds a part; only
    the first ``keep`` of them are used and handed on.  Without ``older`` all entries are measured.
    """
    parts, size = books.parts, books.size
    keep = min(keep, size - 1)
    moves = books.moves(older) if older else None
    ids = [(c, rows.schema[c].dataType.simpleString()) for c in ("vec_id", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                n = batch.num_rows
                v = _matrix(batch.column("v"), n)
                cuts = cuts_of(v.shape[1], parts)
                codes, errors = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                near, needed = np.zeros((n, parts, keep), np.uint8), np.full((n, parts), keep + 1, np.uint8)
                bounds = np.zeros((n, parts, keep + 1), np.float16)
                if older:
                    was = _array(batch.column("codes"), np.uint8, parts)
                    was_near = _array(batch.column("near"), np.uint8, parts, kept)
                    was_bounds = _array(batch.column("bounds"), np.float16, parts, kept + 1)
                for p in range(parts):
                    x, entries = v[:, cuts[p]:cuts[p + 1]], books.entries[p]
                    if older:
                        # The first bound that is cut off holds for all behind it, so it is the new outer bound.
                        found = reassigned(x, entries, moves[p], was[:, p], was_near[:, p, :keep], was_bounds[:, p, :keep + 1].astype(np.float64))
                        codes[:, p], near[:, p], low, own, needed[:, p] = found
                    else:
                        codes[:, p], near[:, p], low, own = measured(x, entries, keep)
                    bounds[:, p] = down(low)
                    errors += own
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c, _ in ids), batch.column("v"), _binary(codes), pa.array(errors), _binary(near), _binary(bounds), _binary(needed)],
                    [*(c for c, _ in ids), "v", "codes", "errors", "near", "bounds", "needed"],
                )

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in ids) + ", " + STATE)


def totals(state: DataFrame, books: Codebooks, keep: int) -> tuple[Codebooks, np.ndarray]:
    """The entries as means of the parts they got, and how many parts needed 0, 1, ... bounds.

    Every task sends one row for each entry it has parts of, and the driver gets one for each entry.
    """
    parts, size = books.parts, books.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, seen = {}, np.zeros((parts, size), np.int64), np.zeros(keep + 2, np.int64)
        for batch in batches:
            n = batch.num_rows
            v, codes = _matrix(batch.column("v"), n), _array(batch.column("codes"), np.uint8, parts)
            seen += np.bincount(_array(batch.column("needed"), np.uint8, parts).ravel(), minlength=keep + 2)
            cuts = cuts_of(v.shape[1], parts)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=size)
                np.add.at(sums.setdefault(p, np.zeros((size, cuts[p + 1] - cuts[p]), np.int64)), codes[:, p], v[:, cuts[p]:cuts[p + 1]])
        out = [(p, e, int(counts[p, e]), sums[p][e].tolist()) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]
        out += [(-1, m, int(seen[m]), []) for m in np.flatnonzero(seen).tolist()]
        if out:
            kind = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kind)], ["part", "entry", "n", "sums"])

    sent = state.select("v", "codes", "needed").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    most = max(e.shape[1] for e in books.entries)
    found = sent.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(most))
    ).collect()
    new, seen = [e.copy() for e in books.entries], np.zeros(keep + 2, np.int64)
    for r in found:
        if r.part < 0:
            seen[r.entry] = r.n
        else:
            new[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(new[r.part].shape[1])]
    return Codebooks(new), seen


def adapted(keep: int, size: int, seen: np.ndarray, share: float) -> int:
    """Bounds to keep: as many as settle ``share`` of the parts that were not measured in full, an eighth of the entries at least."""
    within = np.cumsum(seen[: keep + 1])
    need = int(np.searchsorted(within, share * within[-1])) if within[-1] else keep
    return min(keep, max(need, -(-size // 8)))


def _nearest(step: int) -> str:
    return f"""a{step} AS MATERIALIZED (SELECT rid, part, arg_min(e, (far, e)) AS e, min(far) AS far FROM (
  SELECT rid, p.part, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS far
  FROM p JOIN c{step} AS c ON p.part = c.part) GROUP BY 1, 2)"""


def _moved(step: int) -> str:
    return f"""m{step} AS (SELECT part, e, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS c FROM (
  SELECT p.part, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{step} JOIN p USING (rid, part), range(1, 1 + (SELECT max(len(x)) FROM p)) AS r(i)
  GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{step + 1} AS (SELECT part, e, coalesce(m.c, c.c) AS c FROM c{step} AS c LEFT JOIN m{step} AS m USING (part, e))"""


#: For vectors of one length that 16 divides.
SQL = f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x FROM k, range(16) AS r(part)),
c0 AS (SELECT part, rid AS e, x AS c FROM p WHERE rid < 64),
{_nearest(0)}, {_moved(0)}, {_nearest(1)}, {_moved(1)}, {_nearest(2)},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a2 GROUP BY 1),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN coded USING (rid), books"""


def vector_codes(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256, share: float = 0.99) -> DataFrame:
    """One row per kept row of ``vectors`` (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Components x become ``floor(scale * x)``; rows are left out as ``integers`` says.  Codebooks start as the parts
    of the ``size`` smallest vec_ids (fewer rows: as many entries) and are moved to the means of their parts
    ``rounds`` times; unused entries stay.  Codes have two hex digits a part (``size`` is 256 at most).  Ties go to
    the lower index.  error is the squared distance over all parts; label_error its sum over equal labels, null
    being one of them.  Where ``parts`` does not divide the length, parts differ by one component.  Repeated rows
    are coded as often as they come, rows without vec_id too; they come last among the starting entries.  An
    empty table, or one without usable vectors, gives an empty result; other columns are ignored.
    """
    if size > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    rows = integers(vectors, scale)
    books = first_codebooks(rows, parts, size)
    if books is None:
        return rows.limit(0).select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
            F.lit("").alias("codebooks_sha256"),
        )
    keep = kept = min(-(-books.size // 4), books.size - 1)
    state, older = rows, None
    for _ in range(rounds):
        state = materialize(assign(state, books, keep, older, kept))
        new, seen = totals(state, books, keep)
        books, older, kept = new, books, keep
        if seen[: keep + 1].sum():
            keep = adapted(keep, books.size, seen, share)
    last = assign(state, books, keep, older, kept)
    codes = materialize(last.select("vec_id", "label", "errors", F.lower(F.hex("codes")).alias("code")))
    by_label = materialize(codes.groupBy("label").agg(F.sum("errors").alias("label_error")))
    return codes.join(by_label.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", F.col("errors").alias("error"), "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
