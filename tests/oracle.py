"""Rows of a query against those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or str(value) == "<NA>" or value != value:
        return None
    if isinstance(value, bool) or str(type(value)).find("bool") >= 0:
        return bool(value)
    if hasattr(value, "__float__"):
        return round(float(value), 9)
    return value


def listed(frame):
    names = sorted(frame.columns)
    return names, sorted(repr([plain(v) for v in r]) for r in frame[names].astype(object).itertuples(index=False, name=None))


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert listed(df.toPandas()) == listed(con.sql(sql).df())
