"""The trie against a plain one, over many shards, and the defined results of odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from locusweave.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, key string, shard int"


def turn_key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, turn_key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def plain(rows):
    convs = rebuild(rows)
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for v in members:
        if v:
            children.setdefault(v[:-1], []).append(v)
    memo = {}

    def below(v):
        kids = [below(k) for k in children.get(v, [])]
        own = (len(members[v]) - 1) * len(v[-1][1]) if v else 0
        memo[v] = (sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids))
        return memo[v]

    if members:
        below(())
    out = []
    for v, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(v)))
        out.append((min(cs), len(v), min(members[v[:-1]]) if v else None, len(cs), len(children.get(v, [])), *memo[v], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(n, seed, longest=9, copies=0, base=0):
    rng = random.Random(seed)
    rows = []
    for c in range(base, base + n):
        hot = rng.random() < copies
        for t in range(3 if hot else rng.randint(1, longest)):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", f"hot {t}" if hot else "ü" * rng.randint(0, 2) + rng.choice("ab")))
    return rows


def got(spark, rows, n=3, **kw):
    df = spark.createDataFrame([(*r, "mine", 7) for r in rows], SCHEMA).repartition(n)
    out = pt.trie_nodes(df, **kw)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("seed", "copies", "turns"), [(1, 0.0, 10_000), (2, 0.5, 80), (3, 0.9, 150)])
def test_nodes_of_the_plain_trie(spark, seed, copies, turns):
    rows = talks(150, seed, copies=copies)
    assert got(spark, rows, turns=turns) == plain(rows)


def test_odd_rows(spark):
    rows = talks(40, 5, base=180)  # 180..219: the block of 180 has no base, that of 200 has one
    rows += [(200, None, None, "b"), (200, None, "user", None), (201, 0, "user", "a"), (201, 0, "user", "a"), (201, 0, "bot", "a")]
    rows += [(-7, 0, "user", "a"), (-105, 1, "x", "long " * 20_000), (-100, 3, "", ""), (305, 0, "user", "only")]
    rows += [(777, t, "user", "a" if t < 300 else "b") for t in range(400)] + [(778, t, "user", "a") for t in range(350)]
    assert any(not ts for ts in rebuild(rows).values())
    assert got(spark, rows + [(None, 0, "user", "a")], turns=500) == plain(rows)
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "a")]) == []


@pytest.mark.parametrize("cells", [1, 7, 50, 1 << 20])
def test_waves_give_one_trie(cells):
    rng = np.random.default_rng(cells)
    turns = rng.integers(0, 12, 60)
    ids = rng.integers(1, 3, (int(turns.sum()), 2)).astype(np.uint64)
    conv, lens = rng.permutation(60).astype(np.int64), rng.integers(0, 9, len(ids))
    trie = pt.trie_of(conv, ids, lens, turns, cells)
    begin, seen = np.cumsum(turns) - turns, {}
    for r in range(60):
        for d in range(turns[r] + 1):
            seen.setdefault(tuple(map(tuple, ids[begin[r]:begin[r] + d].tolist())), []).append(r)
    assert len(trie) == len(seen)
    want = sorted((len(k), min(conv[v]), len(v)) for k, v in seen.items())
    assert sorted(zip(trie.depth().tolist(), trie.low.tolist(), trie.convs.tolist())) == want
    assert (trie.depth()[trie.end] == turns).all()
