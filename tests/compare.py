"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (decimal.Decimal,)):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def close(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    if isinstance(a, float) or isinstance(b, float):
        if isinstance(a, (int, float)) and isinstance(b, (int, float)):
            return abs(a - b) <= 1e-9 * max(1, abs(a), abs(b))
        return a == b
    return a == b


DUCK: dict[str, float] = {}


def compare(name, df, sql, con):
    """None when equal, else a message; the second value counts rows."""
    rows = df.collect()
    cols = sorted(df.columns)
    mine = [tuple(norm(r[c]) for c in cols) for r in rows]
    t = time.time()
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(dcols) != cols:
        return f"columns {cols} vs {sorted(dcols)}", len(mine)
    at = [dcols.index(c) for c in cols]
    theirs = [tuple(norm(r[i]) for i in at) for r in rel.fetchall()]
    DUCK[name] = time.time() - t
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    odd = []
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    for c in cols:
        if same.get(kinds[c]) and same[kinds[c]] != types[c]:
            odd.append(f"{c}:{kinds[c]}/{types[c]}")
    note = (" types " + ",".join(odd)) if odd else ""
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}{note}", len(mine)
    key = lambda r: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "", x if not isinstance(x, (tuple, bool)) and x is not None else str(x)) for x in r)
    mine.sort(key=key)
    theirs.sort(key=key)
    exact = mine == theirs
    for a, b in zip(mine, theirs):
        if not all(close(x, y) for x, y in zip(a, b)):
            return f"first difference {cols}\n   spark {a}\n   duck  {b}{note}", len(mine)
    if note:
        return note, len(mine)
    return (None if exact else "close only"), len(mine)


def main():
    from floodgrid.runtime import build_session

    import __spark_entry__ as e

    sf = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.01")
    want = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if want and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in os_:
                msg, n = compare(name, df, os_[name], con)
            else:
                msg, n = None, df.count()
        except Exception as ex:  # noqa: BLE001
            msg, n = "ERROR " + str(ex)[:700], -1
        if msg:
            bad += 1
        tag = "ok " if not msg else "BAD"
        print(f"{tag} {name} rows={n} {time.time() - t - DUCK.get(name, 0):.1f}s+{DUCK.get(name, 0):.1f}s {'' if name in os_ else '(no sql)'} {msg or ''}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
