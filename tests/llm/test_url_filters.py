"""Active entries against a direct reading of the edits."""

import pytest

from locusweave.llm import url_filters as uf

EDITS = [
    ("block", "bad.com", "add", 100), ("block", "bad.com", "remove", 5_000_000), ("block", "bad.com", "add", 5_000_000),
    ("block", "bad.com", "add", 9_000_000), ("block", "bad.com", "add", 9_000_000), ("block", "sub.bad.com/x", "add", 50),
    ("allow", "sub.bad.com", "add", 200), ("allow", "sub.bad.com", "remove", 300), (None, "bad.com", "add", 1),
    ("block", None, "add", 1), ("block", "com", "add", None), ("other", "bad.com", "add", 0),
]
PAGES = [
    (1, "http://www.BAD.com:80/a?b", 150), (2, "https://sub.bad.com/x/y#z", 250), (3, "https://sub.bad.com/q", 250),
    (4, "https://u:p@sub.bad.com./q", 350), (5, "http://bad.com", 6_000_000), (6, "http://bad.com", 9_000_001), (7, "not a url", 100),
    (8, None, 100), (9, "http://bad.com", None), (None, "http://bad.com", 99), (1, "http://www.BAD.com:80/a?b", 150), (10, "", 5),
    (11, "http://bad.com", 5_000_000), (12, "http://com/" + "p/" * 300, 100),
]


def active(url, at):
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("@")[-1].split(":")[0].rstrip(".").lower()
    parts = [p for p in rest.split("#")[0].split("?")[0].split("/")[1:] if p]
    labels = host.split(".")
    keys = {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(parts[:i + 1]) for i in range(len(parts))}
    out = []
    for which in ("block", "allow"):
        for key in keys:
            state = {}
            for name, entry, action, when in EDITS:
                if name == which and entry == key and when is not None and when <= at:
                    state.setdefault(when, set()).add(action)
            if state and state[max(state)] == {"add"}:
                out.append((which, key))
    return out


@pytest.mark.parametrize("tile", [uf.TILE, 100_000_000])
def test_verdicts(spark, tile):
    edits = spark.createDataFrame(EDITS, "list_id string, entry string, action string, at long")
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, at long, entry string")
    rows = sorted((str(r.page_id), str(r.at), r.n_block, r.n_allow, r.block_entry, r.blocked) for r in uf.url_verdicts(pages, edits, tile=tile).collect())
    want = []
    for i, url, at in PAGES:
        met = active(url, at) if url and "://" in url and at is not None else []
        blocks, allows = [[k for w, k in met if w == x] for x in ("block", "allow")]
        best = min(blocks, key=lambda k: (-len(k), k)) if blocks else None
        blocked = bool(blocks) and len(best) > max(map(len, allows), default=0)
        want.append((str(i), str(at), len(blocks), len(allows), best, blocked))
    assert rows == sorted(want, key=lambda r: r[:2]) or sorted(rows, key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    edits = spark.createDataFrame([], "list_id string, entry string, action string, at long")
    pages = spark.createDataFrame([], "page_id long, url string, at long")
    assert uf.url_verdicts(pages, edits).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/", 5)], "page_id long, url string, at long")
    assert [tuple(r) for r in uf.url_verdicts(one, edits).collect()] == [(1, 5, 0, 0, None, False)]
