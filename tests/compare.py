"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def duck(folder):
    con = duckdb.connect()
    for n in NAMES.split():
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    return con


def compare(df, con, sql):
    """Empty string when equal, else what differs."""
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} vs {names}"
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    odd = [
        f"{c}:{t}/{duck_types[c]}" for c, t in df.dtypes if kinds.get(t, t) != duck_types[c]
        and not ({t, duck_types[c].lower()} & {"bigint", "int", "integer"} and t in ("int", "bigint") and duck_types[c] in ("BIGINT", "INTEGER"))
    ]
    left = Counter(tuple(cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    right = Counter(tuple(cell(v) for v in r) for r in rel.select(*[f'"{c}"' for c in names]).fetchall())
    msg = ""
    if left != right:
        msg = f"spark {sum(left.values())} rows, sql {sum(right.values())}; only spark {list((left - right).items())[:3]}; only sql {list((right - left).items())[:3]}"
    if odd:
        msg += f" types {odd}"
    return msg


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lexmill.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    con = duck(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            note = compare(df, con, oracle[name]) if name in oracle else f"rows only: {df.count()}"
            state = "ok  " if not note or note.startswith("rows only") else "DIFF"
        except Exception as e:  # noqa: BLE001
            state, note = "FAIL", f"{type(e).__name__}: {str(e)[:600]}"
        bad += state != "ok  "
        print(f"{state} {name} {time.time() - t:.1f}s {note[:900]}", flush=True)
    print("bad:", bad)
