"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v if isinstance(v, (int, bool, str)) or v is None else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(norm(r[k]) for k in order) for r in data), key=repr)


def differences(spark, con, query, sql, sf_dir, show: int = 3) -> str:
    df = query(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    found = con.sql(sql)
    theirs = rows(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} and {sorted(found.columns)}"
    if ours == theirs:
        return ""
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(a - b)[:show]}; only theirs {sorted(b - a)[:show]}"
