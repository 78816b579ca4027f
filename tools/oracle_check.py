"""Local twin of the driver's correctness gate: run each registered query on
Spark and its SQL on DuckDB, compare row count, column names, types and an
order-insensitive hash of the values.

usage: python tools/oracle_check.py [sf_dir] [key-regex]
"""

from __future__ import annotations

import math
import os
import re
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from closebook.plans import catalog  # noqa: E402
from closebook.session import local_session  # noqa: E402
from closebook.sources.testdata import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:
            pass
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return float(v)
    except Exception:
        pass
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    out.sort(key=lambda r: tuple((x is None, repr(type(x)), repr(x)) for x in r))
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pat = re.compile(sys.argv[2]) if len(sys.argv) > 2 else None
    reg = catalog.load()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok = bad = 0
    for name, fn in reg.QUERIES.items():
        if pat and not pat.search(name):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            s_cols = sdf.columns
            s_types = [f.dataType.simpleString() for f in sdf.schema.fields]
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            traceback.print_exc(limit=3)
            bad += 1
            continue
        ts = time.time() - t0
        sql = reg.ORACLE.get(name)
        if sql is None:
            print(f"ROWS {name}: {len(s_rows)} rows (no oracle) {ts:.1f}s")
            ok += 1
            continue
        try:
            cur = con.execute(sql)
            d_cols = [d[0] for d in cur.description]
            d_types = [str(d[1]) for d in cur.description]
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        st = dict(zip(s_cols, s_types))
        dt = dict(zip(d_cols, d_types))
        tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
                "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}
        tdiff = [f"{c}:{st[c]}/{dt.get(c)}" for c in s_cols
                 if c in dt and tmap.get(st[c], st[c].upper().replace(" ", "")) != dt[c].replace(" ", "")]
        if tdiff:
            problems.append("types " + ", ".join(tdiff))
        if not problems or all(p.startswith("types") for p in problems):
            a = rows_of(s_cols, s_rows)
            b = rows_of(d_cols, d_rows)
            if a != b:
                diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
                problems.append(f"values differ, e.g. {diffs}")
        if problems:
            bad += 1
            print(f"FAIL {name}: " + " | ".join(problems) + f" {ts:.1f}s")
        else:
            ok += 1
            print(f"OK   {name}: {len(s_rows)} rows {ts:.1f}s")
    print(f"== {ok} ok, {bad} failing")


if __name__ == "__main__":
    main()
