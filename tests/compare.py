"""Run a query and its SQL twin and compare them as unordered sets of rows.

From a shell: python tests/compare.py FOLDER [name or prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


LOOSE = {"HUGEINT": "int", "BIGINT": "int", "INTEGER": "int", "bigint": "int", "int": "int",
         "DOUBLE": "double", "double": "double", "VARCHAR": "str", "string": "str",
         "BOOLEAN": "bool", "boolean": "bool"}


def differences(df, con, sql) -> list[str]:
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = normal(names, cur.fetchall())
    out = []
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for name, kind, *_ in con.execute(f"DESCRIBE {sql}").fetchall():
        if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(
            types[name]
        ) != kind:
            out.append(f"type of {name}: {types[name]} != {kind}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        gs, ws = set(got), set(want)
        out.append(f"only spark: {sorted(gs - ws)[:4]}\n   only sql: {sorted(ws - gs)[:4]}")
    if not want:
        out.append("no rows at all")
    return out


def main(folder: str, wanted: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tablegauge.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                found = differences(df, con, sqls[name])
            else:
                found = [] if df.count() > 0 else ["no rows"]
        except Exception as e:
            found = [str(e)[:700]]
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += bool(found)
        note = "ok " if not found else "BAD"
        print(f"{note} {name} {time.time() - t0:.1f}s{'' if name in sqls else ' (rows only)'}", flush=True)
        for f in found:
            print("   ", f, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "-v"]
    sys.exit(1 if main(args[0], args[1:]) else 0)
