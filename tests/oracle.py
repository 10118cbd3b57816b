"""Compare catalog queries with their SQL on DuckDB. Also a script: python tests/oracle.py SF [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "FLOAT": "float",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp",
    "DATE": "date",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    return value


def compare(query, sql: str, spark, sf_dir: str) -> list[str]:
    """Differences between the Spark rows and the SQL rows; empty when they are the same."""
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    relation = connect(sf_dir).sql(sql)
    problems = []
    if sorted(relation.columns) != names:
        return [f"columns {sorted(relation.columns)} expected, {names} found"]
    kinds = dict(zip(relation.columns, (str(t) for t in relation.types)))
    for field in frame.dtypes:
        wanted = TYPES.get(kinds[field[0]], kinds[field[0]])
        if wanted != field[1]:
            problems.append(f"{field[0]}: {field[1]} but SQL has {kinds[field[0]]}")
    started = time.time()
    mine = sorted((repr(tuple(_plain(r[n]) for n in names)) for r in frame.select(*names).collect()))
    if os.environ.get("ORACLE_TIMES"):
        print(f"    spark rows in {time.time() - started:.1f}s")
    order = [relation.columns.index(n) for n in names]
    theirs = sorted(repr(tuple(_plain(r[i]) for i in order)) for r in relation.fetchall())
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} rows but SQL has {len(theirs)}")
    if mine != theirs:
        only_mine = sorted(set(mine) - set(theirs))[:3]
        only_theirs = sorted(set(theirs) - set(mine))[:3]
        problems.append(f"values differ ({names}):\n   spark {only_mine}\n   sql   {only_theirs}"[:3000])
    if not mine:
        problems.append("no rows")
    return problems


def main() -> None:
    from marginalia.plans import catalog
    from marginalia.session import local_session

    catalog.load()
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session("oracle")
    names = [n for n in catalog.QUERIES if not sys.argv[2:] or any(n.startswith(a) for a in sys.argv[2:])]
    bad = 0
    for name in names:
        started = time.time()
        try:
            if name in catalog.ORACLE:
                problems = compare(catalog.QUERIES[name], catalog.ORACLE[name], spark, sf_dir)
                status = "ok"
            else:
                rows = len(catalog.QUERIES[name](spark, sf_dir).collect())
                problems, status = ([] if rows else ["no rows"]), f"rows only: {rows}"
        except Exception as error:  # keep going, show what broke
            problems, status = [f"{type(error).__name__}: {str(error)[:1500]}"], "failed"
        bad += bool(problems)
        print(f"{name} {status if not problems else 'DIFFERS'} {time.time() - started:.1f}s", flush=True)
        for problem in problems:
            print("   ", problem, flush=True)
    print(f"{len(names)} queries, {bad} with problems")


if __name__ == "__main__":
    main()
