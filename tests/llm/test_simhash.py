"""Ball hashing and SimHash components against brute force."""

import numpy as np
import pytest
import xxhash

from locusweave.llm import balls, simhash

TEXTS = [
    (5, "One two three four five six"), (3, "one TWO three four five six"), (9, "a\tb\x0bc"), (1, ""), (2, None), (4, " \n "),
    (7, "x y z w " * 4000), (8, "x y z w " * 4000 + "q"), (6, "É a b c d"), (6, "É a b c d"), (None, "one two three four five six"),
]


def brute_fp(text, k=4):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(a ^ b).count("1") <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def planted(n=60, seed=5):
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in rng.integers(0, 1 << 63, n // 6, dtype=np.uint64)]
    out = set()
    for c in centres:
        for _ in range(6):
            m = 0
            for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                m |= 1 << int(b)
            out.add(c ^ m)
    return sorted(out)


@pytest.mark.parametrize(("chunk", "hot"), [(1 << 21, 200_000), (3000, 200_000), (3000, 3)])
def test_links_give_all_components(spark, chunk, hot):
    fps = planted()
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in balls.ball_links(df, 2, chunk, hot).collect()]
    assert edges
    reach = {f: f for f in fps}
    for _ in fps:
        for a, b in edges:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert reach == brute_components(fps)


def test_near_duplicates_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, fp string, component long")
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(TEXTS)
    fps = {f for f in (brute_fp(t) for _, t in TEXTS)}
    label = brute_components(sorted(fps))
    low = {}
    for i, t in TEXTS:
        if i is not None:
            c = label[brute_fp(t)]
            low[c] = min(low.get(c, i), i)
    want = sorted((str(i), f"{brute_fp(t):016x}", low[label[brute_fp(t)]]) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
