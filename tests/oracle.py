"""Compare queries with their oracles on one scale: python tests/oracle.py SF_DIR [module or query ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differs(df, con, sql: str) -> str:
    """Empty if a DataFrame and a query give the same columns and rows."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    odd = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(odd)} rows differ: {odd[:2]}" if odd else ""


if __name__ == "__main__":
    from palimpsest import registry
    from palimpsest.session import local_session

    sf, only = sys.argv[1], set(sys.argv[2:])
    registry.MODULES = tuple(x for x in registry.MODULES if not only or x in only or not only & set(registry.MODULES))
    queries, oracles = registry.load()
    spark, con = local_session(), connect(sf)
    bad = 0
    for name, f in queries.items():
        if only and name not in only and not only & set(registry.MODULES):
            continue
        began = time.time()
        try:
            why = differs(f(spark, sf), con, oracles[name]) if name in oracles else f"no oracle, {f(spark, sf).count()} rows"
        except Exception as error:
            why = f"ERROR {str(error)[:700]}"
        bad += bool(why) and not why.startswith("no oracle")
        print(f"{name:32s} {time.time() - began:5.1f}s {why or 'ok'}", flush=True)
    print("bad:", bad)
