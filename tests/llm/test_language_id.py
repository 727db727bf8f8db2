"""Held-out accuracy on invented languages that share syllables, and the defined results of odd rows."""

import random
import zlib

import numpy as np
import pytest

from locusweave.llm import language_id as li

PARTS = {
    "aa": ["the", "ing", "er", "on", "an", "tion", "re", "ou"], "bb": ["der", "er", "en", "sch", "an", "ung", "re", "lich"],
    "cc": ["que", "eau", "re", "on", "en", "ment", "les", "ou"], "zz": ["при", "ов", "ста", "на", "ени"],
}
SCHEMA = "doc_id long, text string, lang string, source string, score double, margin int"


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choices(list(PARTS), [6, 2, 2, 1])[0]
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(15, 300))]
        rows.append((i, rng.choice([" ", ", ", " | "]).join(words), lang))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    rows = corpus()
    odd = [(2000, None, "aa"), (2001, "", "bb"), (2002, " 12 +-! \n", None), (2003, "der ungen schlich " * 30_000, None), (None, rows[0][1], "cc"),
           (0, rows[0][1], rows[0][2]), (2004, "ü", None), (2005, "\U0001f600", "aa")]
    docs = spark.createDataFrame([(i, t, y, "src", 0.5, 1) for i, t, y in rows + odd], SCHEMA)
    return rows, docs


def test_held_out_accuracy(frame):
    rows, docs = frame
    got = li.languages(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by_id[i].held_out for i, _ in held) and not by_id[None].held_out
    assert sum(by_id[i].lang_pred == y for i, y in held) >= 0.99 * len(held)
    for i in (2000, 2001, 2002, 2005):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[2003].lang_pred == "bb" and by_id[2003].score > 0.99 and not by_id[2003].rejected
    assert by_id[2004].lang_pred in PARTS and by_id[2004].rejected
    assert by_id[None].lang_pred == by_id[0].lang_pred == rows[0][2] and sum(r.doc_id == 0 for r in got) == 2


def test_lang_is_no_input_and_held_rows_teach_nothing(spark, frame):
    rows, docs = frame
    changed = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'xx' else lang end as lang")
    assert sorted(map(tuple, li.languages(docs).collect()), key=repr) == sorted(map(tuple, li.languages(changed).collect()), key=repr)


def test_without_labels_or_rows(spark, frame):
    _, docs = frame
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in li.languages(bare).collect()} == {("und", 0.0)}
    assert li.languages(docs.limit(0)).count() == 0
    one = li.languages(docs.where("lang = 'aa'")).where("n_letter_bytes > 0").collect()
    assert {(r.lang_pred, r.score, r.margin) for r in one} == {("aa", 1.0, 0)}
    # A language of three documents is learnt too.
    few = docs.where("lang = 'aa' or (lang = 'zz' and doc_id < 120)")
    assert "zz" in {r.lang_pred for r in li.languages(few).collect()}


def test_lengths_count_every_window():
    model = li.Languages(["a", "b"], [b" der ungen schlich" * 50, b" the inger tion" * 50])
    compressors = model.compressors()
    one, two = (li.plain(w * 600) for w in ("der ungen schlich ", "the inger tion "))
    both = model.lengths(one + two, compressors)
    assert both.sum() > model.lengths(one, compressors).sum()
    assert model.lengths(one, compressors).argmin() == 0 and model.lengths(two, compressors).argmin() == 1
    assert np.isclose(model.chances(both).sum(), 1)
    assert b"".join(li.pieces("ab cd " * 10, 9)) == li.plain("ab cd " * 10) and len(li.pieces("ab " * 9000, 3)) == 3
