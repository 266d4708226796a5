"""A query's rows against those of its SQL in DuckDB."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql):
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
