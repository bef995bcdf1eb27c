"""Runs a query and its SQL over the same small tables."""

import decimal
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, (list, tuple)):  # a Row is a tuple
        return tuple(map(plain, v))
    return v


def disagreement(spark, query, sql: str, folder: str = FOLDER) -> str:
    """What differs between the query's rows and the SQL's, columns taken by name; nothing if they agree."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{os.path.join(folder, f)}'")
    df = query(spark, folder)
    rows, got = df.collect(), con.execute(sql)
    names, found = [c[0] for c in got.description], got.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    one, two = (sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in rs), key=repr) for rs, cols in ((rows, df.columns), (found, names)))
    return "" if one == two else f"{len(one)} and {len(two)} rows, first difference {next(((a, b) for a, b in zip(one, two) if a != b), None)}"
