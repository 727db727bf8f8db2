"""Compare a registered query with its SQL, run by DuckDB on the same files."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("f", round(v, 6) + 0.0)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def difference(df, con, sql):
    """None when equal, else a short description."""
    c1, r1 = rows_of_spark(df)
    c2, r2 = rows_of_sql(con, sql)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if r1 != r2:
        s1, s2 = set(r1), set(r2)
        return f"rows {len(r1)} != {len(r2)}; only spark {sorted(s1 - s2, key=repr)[:3]}; only sql {sorted(s2 - s1, key=repr)[:3]}"
    return None
