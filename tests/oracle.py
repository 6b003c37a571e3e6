"""Compare registered queries with their SQL counterpart in DuckDB.

    python -m tests.oracle [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def kind(dtype: str) -> str:
    d = dtype.lower()
    if d in ("bigint", "long"):
        return "bigint"
    if d in ("string", "varchar"):
        return "string"
    return "integer" if d == "int" else d


def compare(spark, sf_dir: str, fn, sql: str, con) -> list[str]:
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} != {sorted(rel.columns)}"]
    ours = {n: kind(t) for n, t in df.dtypes}
    theirs = {n: kind(str(t)) for n, t in zip(rel.columns, rel.dtypes)}
    problems += [f"type {n}: {ours[n]} vs {theirs[n]}" for n in ours if ours[n] != theirs[n]]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        problems.append(f"values {sorted(df.columns)}: spark {str(a)[:700]} sql {str(b)[:700]}")
    return problems or ([] if got else ["both empty"])


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from docweave.session import build_session

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        del argv[at:at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = build_session("oracle"), connect(sf_dir), 0
    oracles = oracle_sql()
    for name, fn in queries().items():
        if argv and not any(a in name for a in argv):
            continue
        started = time.time()
        try:
            if name in oracles:
                problems = compare(spark, sf_dir, fn, oracles[name], con)
            else:
                n = fn(spark, sf_dir).count()
                problems = [] if n else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
