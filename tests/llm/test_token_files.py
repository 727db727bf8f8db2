"""Ids against the tokenizers library, and exact reading of written files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from locusweave.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  two  spaces ", " lead", "trail ", "a \nb", "a\n b", "a\n \nb", "x  y  z", "tab\t t", "it's we'll  DON'T 'S", "a 　b", "<|endoftext|> x",
    "é́ ü", "1 22 333", "word," * 3 + " a.b c", "  x  ", "a \x1c b", "🙂 🙂🙂", "a\r\n b", " \n", "x ​ y",
]


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts(n=300, seed=4):
    rng = random.Random(seed)
    parts = ["the", " ", " ", "\n", "an", "ing", ",", ".", "é", "'s", "12", " q", " ", "Ab", "-", "\t", "🙂", "  "]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_pieces_give_the_librarys_ids(theirs, most):
    pieces = token_files.Pieces(PATH, most)
    all_texts = [*texts(), None]
    for part in (all_texts[:7], all_texts[7:200], all_texts[200:]):
        ids, sizes = pieces.encode(pa.array(part, pa.string()))
        ends = np.cumsum(sizes)
        for t, n, b in zip(part, sizes, ends):
            assert ids[b - n:b].tolist() == theirs(t), repr(t)


@pytest.mark.parametrize("block_ids", [1 << 20, 40])
def test_files_hold_every_document(spark, theirs, block_ids):
    rows = [(i * 7 % 331, t, "x") for i, t in enumerate(texts())] + [(None, "no id", "x"), (None, None, "x"), (5, "tie b", "x"), (5, "tie a", "x"), (5, "tie a", "x")]
    rows.append((1 << 40, "long text " * 30000, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    folder = token_files.write(docs, token_files.new_folder(spark), PATH, 0, block_ids)
    got = token_files.read(spark, folder).orderBy("start").collect()
    assert len(got) == len(rows)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    total = 0
    for r in got:
        assert r.start == total
        total += r.n_tokens
    want = sorted((str(i), len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for i, t, _ in rows for ids in [theirs(t)])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(spark, token_files.write(docs, token_files.new_folder(spark), PATH)).count() == 0
