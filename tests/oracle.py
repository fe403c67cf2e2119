"""Compares a query with its SQL on the same tables, in DuckDB."""

from pathlib import Path

import duckdb


def _key(row):
    return tuple("~" if x is None or x != x else f"{x:.7g}" if isinstance(x, float) else str(x) for x in row)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(_key(r) for r in df.select(*cols).collect())


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t if t.is_file() else f'{t}/*.parquet'}'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(_key([row[i] for i in order]) for row in r.fetchall())


def same(df, sql, sf_dir):
    assert rows_of(df) == expected(sql, sf_dir)
