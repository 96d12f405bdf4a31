"""Compare registered queries with their SQL counterparts in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "integer": "int",
         "hugeint": "hugeint", "double": "double", "float": "float", "string": "string",
         "varchar": "string", "boolean": "boolean", "date": "date"}


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def compare(df, con, sql: str) -> str:
    """Empty text when names, kinds and rows agree, else what differs."""
    rel = con.sql(sql)
    names, types = list(rel.columns), [str(t).lower() for t in rel.types]
    expected = rows_of(names, rel.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for name, kind in zip(names, types):
        mine = spark_types[name]
        if KINDS.get(mine, mine) != KINDS.get(kind, kind) and "[" not in kind:
            return f"type of {name}: {mine} against {kind}"
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]} (columns {sorted(names)})"
    return ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from pairsieve.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(a in n for a in argv)]
    if os.environ.get("ONLY_SQL"):
        names = [n for n in names if n in sqls]
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = "" if df.count() > 0 else "no rows"
        except Exception as error:  # keep going through the list
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok ' if not problem else 'BAD'} {name} [{kind}] {time.time() - start:.2f}s {problem[:1800]}",
              flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
