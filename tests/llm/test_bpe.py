"""Tree reduction against tiktoken, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from locusweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a", "\n\n  x", "don't  WE'LL 've", "é" * 500, "ab" * 3000, "a" * 5000, "🙂🙃" * 300, "=-" * 999, "1234567890" * 400, " " * 700 + "z", "漢字かな交じり文" * 120]


@pytest.fixture(scope="module")
def theirs():
    pairs = bpe.BytePairs(PATH, public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 3, 48])
def test_same_ids_as_tiktoken(theirs, leaf):
    pairs = bpe.BytePairs(PATH, public_tokenizers.PATTERN, leaf)
    rng = random.Random(leaf)
    texts = ODD + ["".join(rng.choice(["th", "e", "ing", "ion", "é", "ß", "qx", "aaa", "zz"]) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    for t in texts:
        assert pairs.encode(t) == theirs.encode_ordinary(t), t[:40]


def test_heap_and_plain_merges_agree():
    pairs = bpe.BytePairs(PATH, public_tokenizers.PATTERN)
    rng = random.Random(9)
    for _ in range(100):
        data = "".join(rng.choice(["an", "er", "aa", "a", "tion", "ü"]) for _ in range(rng.randint(2, 20))).encode()
        assert pairs._merged_by_heap(data) == pairs.merged(data)


def test_round_trip_of_a_table(spark, theirs):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "x y", "x"), (99, None, None), (0, "", "x"), (7, "word " * 40000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(tuple(map(str, r)) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for i, t, _ in rows:
        ids = theirs.encode_ordinary(t or "")
        raw = (t or "").encode()
        want.append((str(i), str(len(ids)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), str(len(raw))))
    assert got == sorted(want)
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    back = {(r.doc_id, bytes(r.data)) for r in bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {(i, (t or "").encode()) for i, t, _ in rows}
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
