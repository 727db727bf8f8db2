"""Base counts against a plain reading of the rules; fences on a small corpus."""

import re

import pytest

from locusweave.llm import quality_rules

TEXTS = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "a a a a a a a", "é ü ##|| <b> \n é ü ##|| <b> \nx\n x\nx",
    "w " * 9 + "w", "x\x0by\x0cz\r\nq r s", ("lorem ipsum dolor sit amet " * 5000) + "end", "p q r s t u p q r s t v",
    "🙂 $$$ 100% & more\n🙂 $$$ 100% & more",
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for w in wins:
        counts[w] = counts.get(w, 0) + 1
    covered = {j for i, w in enumerate(wins) if counts[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_match_plain_reading():
    for t in TEXTS:
        assert quality_rules.text_counts(t)[:5] == plain(t), t


@pytest.fixture(scope="module")
def docs(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(i, clean + f" x{i}", "en", "s1", 0) for i in range(150)]
    rows += [(1000, " ".join(f"word{i}###" for i in range(40)), "en", "s1", 0), (1001, clean, None, None, 0)]
    rows += [(2000 + i, t, "en" if i % 2 else None, None, 0) for i, t in enumerate(TEXTS)]
    rows += [(0, clean + " x0", "en", "s1", 0), (None, clean, "de", "s9", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")


def test_verdicts(docs):
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].kept for i in range(150)) and by_id[1001].kept and by_id[None].kept
    assert not by_id[1000].kept and "symbol_rate" in by_id[1000].outside and not by_id[1000].base_failed
    for i, t in enumerate(TEXTS):
        n, chars, symbols, dup, rep = plain(t)
        r = by_id[2000 + i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)


def test_sketch_quartiles_are_close(spark):
    n = 2000
    df = spark.createDataFrame([("en", "s", 1000, i, 0, 0, 0, 1) for i in range(1, n + 1)], "lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    df = df.withColumns({"n_symbols": df.word_chars, "word_chars": df.n_words})
    row = quality_rules.quartiles(quality_rules.sketches(df), ["lang"]).where("rate = 0").first()
    assert abs(row.q25 - n / 4000) < 0.01 * n / 4000 * 1.1 and abs(row.q75 - 3 * n / 4000) < 0.01 * 3 * n / 4000 * 1.1


def test_empty_table(docs):
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
