"""A query's rows against those of its SQL in DuckDB."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 9))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def connection(sf_dir, views=None):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def assert_same(df, sql, sf_dir):
    found = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(found.columns, found.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
