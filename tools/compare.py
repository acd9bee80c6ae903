"""Run registered queries against their SQL twins in DuckDB and report differences.

Usage: python tools/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows) -> list[tuple]:
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
        return "NULL" if v is None else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    ours_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ours = canonical(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if sql is None:
        return bool(ours), f"rows only: {len(ours)}"
    rel = con.sql(sql)
    theirs_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if sorted(rel.columns) != cols:
        return False, f"columns {cols} vs {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in cols]
    theirs = canonical(tuple(r[i] for i in order) for r in rel.fetchall())
    notes = [f"{c}: {ours_types[c]} vs {theirs_types[c]}" for c in cols if TYPES.get(ours_types[c]) != theirs_types[c]]
    if ours != theirs:
        in_ours, in_theirs = set(ours), set(theirs)
        a = [r for r in ours if r not in in_theirs][:3]
        b = [r for r in theirs if r not in in_ours][:3]
        return False, f"{len(ours)} vs {len(theirs)} rows {cols}\n   ours {a}\n   sql  {b}"
    return not notes and bool(ours), f"{len(ours)} rows" + (f" TYPES {notes}" if notes else "")


def main() -> None:
    from wellspark.plans import load_all
    from wellspark.plans.registry import ORACLES, QUERIES
    from wellspark.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    load_all()
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name, fn in sorted(QUERIES.items()):
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            ok, text = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as e:  # the report must go on to the next query
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {text}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failing: {' '.join(bad)}")


if __name__ == "__main__":
    main()
