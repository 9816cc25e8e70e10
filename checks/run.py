"""Runs registered queries and their SQL side by side: python -m checks.run [--sf 0.01] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "isoformat"):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(args: list[str]) -> int:
    from gridframe.session import local_session

    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        args = args[:at] + args[at + 2:]
    queries, oracles = all_queries()
    names = [n for n in queries if not args or any(a in n for a in args)]
    spark = local_session(8)
    sf_dir = f"/root/testdata/sf{sf}"
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            columns = df.columns
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            result = db.execute(oracles[name])
            expected_columns = [d[0] for d in result.description]
            expected = result.fetchall()
        except Exception as error:  # noqa: BLE001
            print(f"SQL  {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        sql_took = time.time() - start
        if sorted(columns) != sorted(expected_columns):
            print(f"COLS {name}: {sorted(columns)} / {sorted(expected_columns)}", flush=True)
            bad += 1
            continue
        a, b = rows_of(columns, got), rows_of(expected_columns, expected)
        if a == b:
            print(f"ok   {name}: {len(a)} rows {took:.1f}s (sql {sql_took:.1f}s)", flush=True)
        else:
            bad += 1
            only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
            print(f"DIFF {name}: {len(a)} / {len(b)} rows, {sorted(columns)}", flush=True)
            print("   spark", only_a[:3], len(only_a), "\n   sql  ", only_b[:3], len(only_b), flush=True)
    print(f"{len(names)} queries, {bad} not right", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
