"""Hold a query's rows against its SQL on DuckDB, as multisets with columns in order of their names."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
        return int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def difference(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows, else what differs."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    exp = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    if got == exp:
        return ""
    return f"{sum(got.values())} rows against {sum(exp.values())}; only here {list((got - exp).items())[:2]}; only there {list((exp - got).items())[:2]}"
