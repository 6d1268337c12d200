"""Rows of a query and of its SQL, made comparable."""

import numbers

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or str(v) in ("nan", "<NA>", "NaT"):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, numbers.Integral):
        return int(v)
    if isinstance(v, numbers.Real):
        return int(v) if float(v).is_integer() else round(float(v), 6)
    return v


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)
