"""Compare registered queries with their SQL in DuckDB.

python -m tests.oracle /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canon(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (float, Decimal)):
        value = float(value)
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value != int(value) or abs(value) > 1e15 else f"{int(value)}.0"
    if isinstance(value, int):
        return str(value)
    return str(value)


KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int",
         "string": "text", "varchar": "text", "double": "double", "float": "double", "boolean": "bool",
         "timestamp": "ts", "date": "date"}


def kind(name: str) -> str:
    name = name.lower()
    return "decimal" if name.startswith("decimal") else KINDS.get(name, name)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, folder, name, query, statement):
    """None when equal, else what differs."""
    df = query(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return "the plan pairs every row with every row"
    mine = sorted((f.name, kind(f.dataType.simpleString())) for f in df.schema)
    rows = [tuple(r) for r in df.collect()]
    if not rows:
        return "no rows"
    if statement is None:
        return None
    cur = con.execute(statement)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    types = con.execute(f"DESCRIBE {statement}").fetchall()
    expected = sorted((t[0], kind(t[1])) for t in types)
    if mine != expected:
        return f"schema {set(mine) ^ set(expected)}"
    if len(rows) != len(theirs):
        return f"rows {len(rows)} != {len(theirs)}"
    a, la = digest(df.columns, rows)
    b, lb = digest(names, theirs)
    if a != b:
        only = sorted(set(la) - set(lb))[:2], sorted(set(lb) - set(la))[:2]
        return f"values differ: {sorted(df.columns)} {str(only)[:1500]}"
    return None


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tidemark.session import local_session

    spark = local_session("oracle", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, statements = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        at = time.time()
        try:
            problem = compare(spark, con, folder, name, query, statements.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        print(f"{mark:4}{name:28}{time.time() - at:7.2f}s {'' if name in statements else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad of {len(names) or len(queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
