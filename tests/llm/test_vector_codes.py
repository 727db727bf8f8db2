"""Vector codes against the plain method, and the bounds against full measurement."""

import hashlib
import math

import numpy as np
import pytest

from locusweave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long"


def plain(rows, parts, size, rounds):
    """[(vec_id, code, error, label_error, sha256)] with Python integers."""
    kept = [(i, [math.floor(256 * c) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [len(kept[0][1]) * p // parts for p in range(parts + 1)]
    split = [[v[a:b] for a, b in zip(cut, cut[1:])] for _, v, _ in kept]
    books = [[list(s[p]) for s in split[:size]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for step in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(s[p], books[p][e]), e)) for p in range(parts)] for s in split]
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [s[p] for s, c in zip(split, codes) if c[p] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    errors = [sum(far(s[p], books[p][c[p]]) for p in range(parts)) for s, c in zip(split, codes)]
    of = {}
    for (_, _, y), e in zip(kept, errors):
        of[y] = of.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in c), e, of[y], sha) for (i, _, y), c, e in zip(kept, codes, errors)), key=repr)


def vectors(n=120, length=12, seed=1, grid=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (9, length))
    x = centres[rng.integers(0, 9, n)] + rng.normal(0, 0.05, (n, length))
    if grid:
        x = np.round(x * grid) / grid
    return [(int(i) * 3 - 20, [float(np.float32(c)) for c in v], int(rng.integers(0, 3)) if i % 7 else None) for i, v in enumerate(x)]


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, y, "mine", 1) for i, v, y in rows], SCHEMA).repartition(3)
    out = vc.vector_codes(df, **kw)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("grid", "parts", "size", "rounds"), [(None, 4, 16, 2), (4, 4, 16, 4), (2, 3, 8, 3), (4, 5, 2, 2), (None, 16, 1, 2)])
def test_codes_of_the_plain_method(spark, grid, parts, size, rounds):
    rows = vectors(grid=grid)
    assert got(spark, rows, parts=parts, size=size, rounds=rounds) == plain(rows, parts, size, rounds)


def test_odd_rows(spark):
    rows = vectors(40)
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (None, rows[6][1], None)]
    odd = [(900, None, 1), (901, [0.1] * 11 + [None], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] + [0.0] * 11, None), (904, [], 1), (905, [1.0], 1)]
    assert got(spark, rows + odd, parts=4, size=16) == plain(rows, 4, 16, 2)
    huge = rows + [(906, [3e38] * 6 + [-3e38] * 6, 1)]
    clipped = rows + [(906, [float(1 << 19)] * 6 + [-float(1 << 19)] * 6, 1)]
    assert got(spark, huge, parts=4, size=16) == plain(clipped, 4, 16, 2)
    assert got(spark, odd[:4], parts=4) == [] and got(spark, [], parts=4) == []


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(7)
    x = rng.integers(-60, 60, (3000, 4)).astype(np.int64)
    old = vc.Codebooks([x[:64].copy()])
    keep = 16
    code, near, bounds, _ = vc.measured(x, old.entries[0], keep)
    for spread in (0, 1, 3, 40):
        new = vc.Codebooks([old.entries[0] + rng.integers(-spread, spread + 1, (64, 4))])
        for used in (keep, 8, 1):
            found = vc.reassigned(x, new.entries[0], new.moves(old)[0], code, near[:, :used], vc.down(bounds)[:, :used + 1].astype(np.float64))
            far = vc.squares(x, new.entries[0])
            assert (found[0] == far.argmin(axis=1)).all() and (found[3] == far.min(axis=1)).all()
            # Every bound lies under the distances it stands for.
            root = np.sqrt(far)
            assert (found[2][:, :used] <= np.take_along_axis(root, found[1], axis=1)).all()
            rest = root.copy()
            np.put_along_axis(rest, np.concatenate([found[0][:, None], found[1]], axis=1), np.inf, axis=1)
            assert (found[2][:, -1] <= rest.min(axis=1)).all()
            assert (np.diff(found[2], axis=1) >= 0).all()
            if spread == 1 and used == keep:
                assert (found[4] == 0).mean() > 0.2 and (found[4] <= keep).mean() > 0.95


def test_kept_bounds_adapt():
    assert vc.adapted(16, 64, np.array([500, 300, 150, 45, 4, 1] + [0] * 11 + [900]), 0.99) == 8
    assert vc.adapted(16, 64, np.array([10] * 17 + [0]), 0.99) == 16
    assert vc.adapted(16, 64, np.array([0] * 17 + [5]), 0.99) == 16
