"""Run the registered queries and compare them with their SQL in DuckDB.

usage: python -m workload.check SF_DIR [name or prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from docweave.session import local_session
from workload import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE"}


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in cursor.description]
    return columns, cursor.fetchall()


def canonical(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def compare(spark, sf_dir: str, name: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    spent = time.time() - start
    if name not in ORACLES:
        return f"rows-only {len(got)} [{spent:.1f}s]"
    start = time.time()
    columns, want = oracle_rows(sf_dir, ORACLES[name])
    oracle_spent = time.time() - start
    if sorted(df.columns) != sorted(c for c, _ in columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(c for c, _ in columns)}"
    kinds = dict(columns)
    off = [f"{f.name}: {f.dataType.simpleString()} vs {kinds[f.name]}" for f in df.schema
           if SAME.get(f.dataType.simpleString()) != kinds[f.name]]
    a, b = canonical(df.columns, got), canonical([c for c, _ in columns], want)
    note = f" types {off}" if off else ""
    if a != b:
        only_a = sorted(set(a) - set(b))[:2]
        only_b = sorted(set(b) - set(a))[:2]
        return f"FAIL {len(a)} vs {len(b)} rows{note}\n    spark {[x[:600] for x in only_a]}\n    sql   {[x[:600] for x in only_b]}"
    return f"ok {len(a)} rows [{spent:.1f}s, sql {oracle_spent:.1f}s]{note}"


def main() -> None:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("8", 8, "12g")
    failed = []
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            result = compare(spark, sf_dir, name)
        except Exception as problem:
            result = f"FAIL {type(problem).__name__}: {str(problem)[:900]}"
        if result.startswith("FAIL"):
            failed.append(name)
        print(f"{name}: {result}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
