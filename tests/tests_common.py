"""What tests of queries share: DuckDB over a folder of tables, and rows in a comparable form."""

import functools
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@functools.cache
def duckdb_of(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(result):
    """The rows of a Spark or DuckDB result with their columns by name, sorted."""
    if hasattr(result, "description"):
        names = [d[0] for d in result.description]
        rows = result.fetchall()
    else:
        names, rows = result.columns, result.collect()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(plain(tuple(r[i] for i in order))) for r in rows)
