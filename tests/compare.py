"""Compare a Spark frame with the result of its SQL twin."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(x):
    if x is None:
        return (0, "")
    if isinstance(x, bool):
        return (1, x)
    if isinstance(x, float):
        return (2, "nan" if math.isnan(x) else repr(x))
    return (3, str(x)) if not isinstance(x, int) else (4, x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, con, sql):
    """None where both agree in names, rows and values; else a short text."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
    if len(ours) != len(theirs):
        extra = list(set(ours) - set(theirs))[:2], list(set(theirs) - set(ours))[:2]
        return f"{len(ours)} rows != {len(theirs)}; {extra}"
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
