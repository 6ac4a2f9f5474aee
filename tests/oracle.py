"""Rows of a Spark query and of its SQL in DuckDB, in a form that can be compared."""

from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def of_spark(df):
    return table(df.columns, df.collect())


def of_duckdb(sql, sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    r = con.execute(sql)
    return table([c[0] for c in r.description], r.fetchall())
