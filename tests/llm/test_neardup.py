"""Groups against all pairs of a small corpus."""

import random

import pytest

from locusweave.llm import neardup


def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows, i = [], 0
    for _ in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 250))]
        for k in range(rng.choice([1, 1, 2, 5])):
            copy = list(words)
            for _ in range(k if rng.random() < 0.8 else 12):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((i, " ".join(copy)))
            i += 1
    base = [rng.choice(vocab) for _ in range(200)]
    for k in range(150):  # one large group of near copies
        copy = list(base)
        copy[k] = rng.choice(vocab)
        rows.append((1000 + k, " ".join(copy)))
    return rows


def shingles(t):
    w = [x for x in (t or "").lower().split()]
    return {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def brute_keep(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    sets = {t: shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    keys = list(texts)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            n = len(x & y)
            if x and y and n >= 0.8 * (len(x) + len(y) - n):
                root[find(keys[a])] = find(keys[b])
    low = {}
    for t, ids in texts.items():
        for i in ids:
            low.setdefault(find(t), []).append((i is None, i or 0))
    return sorted(str(None if n else i) for n, i in (min(v) for v in low.values()))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows += [(2000, None), (2001, ""), (2002, " "), (None, "a b c"), (None, "only this one has no id at all"), (2003, "A b C"), (2003, "A b C"), (2004, "a b d")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, keys int")


def test_one_of_each_group(docs):
    rows, df = docs
    kept = neardup.one_of_each_group(df)
    assert kept.columns == df.columns
    got, want = sorted(str(r.doc_id) for r in kept.collect()), brute_keep(rows)
    # Texts without words have no shingles, so " " and "" are told apart only by their bytes.
    assert set(want) ^ set(got) <= {"2002"} and len(got) == len(set(got)) + got.count("None") - (1 if "None" in got else 0)


def test_empty_table(docs):
    assert neardup.one_of_each_group(docs[1].limit(0)).count() == 0


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in neardup.one_of_each_group(df).collect())


def test_repeat_counts_do_not_matter(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    texts = []
    for _ in range(20):
        body, line = [word() for _ in range(300)], [word() for _ in range(12)]
        texts += [" ".join(body + line * 2), " ".join(body + line * 30)]
    assert kept(spark, texts) == list(range(0, 40, 2))


def test_copies_beside_a_text_of_the_same_fingerprint(spark, monkeypatch):
    """Copies that differ from the smallest text of their fingerprint are still compared with each other and with the rest."""
    real, mixed = neardup.majority, neardup.mixed

    def wide(hashes, bits):
        return sum((real(mixed(hashes, j)) & 0xFFFFFFFFFFFFFFFF) << 64 * j for j in range(-(-bits // 64)))

    monkeypatch.setattr(neardup, "long_simhash", wide)
    monkeypatch.setattr(neardup, "majority", lambda hashes: 0)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    texts, want = [], []
    for _ in range(12):
        body = [word() for _ in range(100)]
        want.append(len(texts))
        for k in range(2):
            copy = list(body)
            copy[50 * k] = word()
            texts.append(" ".join(copy))
    assert kept(spark, texts) == want


def test_twins_in_a_family_of_looser_relatives(spark):
    """Texts of one template (similarity about 0.57) that come in pairs of about 0.85: no leader is similar to both twins' pairs."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    template, texts = [word() for _ in range(295)], []
    for _ in range(120):
        own = [word() for _ in range(109)]
        texts += [" ".join(template + own), " ".join(template + own[:-32] + [word() for _ in range(32)])]
    assert kept(spark, texts) == sorted(int(i) for i in brute_keep(list(enumerate(texts)))) == list(range(0, 240, 2))


def test_texts_whose_leader_is_no_copy_are_compared_with_the_rest(spark, monkeypatch):
    """All texts meet everywhere with equal fingerprints, so one text leads all the others."""
    monkeypatch.setattr(neardup, "long_simhash", lambda hashes, bits: 0)
    monkeypatch.setattr(neardup, "majority", lambda hashes: 0)
    texts = []
    for k in range(12):
        body = [f"w{k}x{i}" for i in range(100)]
        texts += [" ".join(body), " ".join(["new", *body[1:]])]
    assert kept(spark, texts) == list(range(0, 24, 2))


def test_links_of_a_large_group_grow_with_its_texts(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(240):
        words = list(base)
        for _ in range(rng.randint(1, 9) if i else 0):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    counts, real = [], neardup.component_of

    def counted(edges):
        counts.append(edges.select("src", "dst").distinct().count())
        return real(edges)

    monkeypatch.setattr(neardup, "component_of", counted)
    marked, components = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    linked = {0}
    while grown := {j for j in range(len(rows)) if j not in linked and any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in linked)}:
        linked |= grown
    got = marked.join(components, "set").groupBy("component").count().orderBy("count", ascending=False).first()
    assert got["count"] == len(linked) > 120
    assert counts[-1] <= 3 * len(rows)
