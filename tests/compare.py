"""Rows of a Spark query beside those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    return str(v).removesuffix("+00:00")


def rows_of(rows, columns):
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


def both(spark, c, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = rows_of([r.asDict() for r in df.collect()], columns)
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    return ours, rows_of([dict(zip(names, r, strict=True)) for r in cursor.fetchall()], columns)
