"""Compare every registered query with its SQL.

    python -m tests.check_oracle [folder] [query ...]
"""

from __future__ import annotations

import collections
import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder, query, sql) -> str | None:
    """None when both agree, else what differs."""
    got = query(spark, folder)
    rows = [tuple(row) for row in got.collect()]
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    wanted = answer.fetchall()
    if sorted(got.columns) != sorted(columns):
        return f"columns {sorted(got.columns)} vs {sorted(columns)}"
    mine, theirs = bag(got.columns, rows), bag(columns, wanted)
    if mine != theirs:
        return f"{len(rows)} vs {len(wanted)} rows; only here {list((mine - theirs).items())[:2]}; only there {list((theirs - mine).items())[:2]}"
    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    types = {d[0]: str(d[1]).lower() for d in answer.description}
    same = {"int": "integer", "bigint": "bigint", "string": "varchar", "timestamp_ntz": "timestamp"}
    for name, kind in kinds.items():
        if same.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} vs {types[name]}"
    return None


def main() -> int:
    from cohortry.session import session

    import __spark_entry__ as contract

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session(
        spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, folder, queries[name], sql[name])
            else:
                problem = f"no SQL; {queries[name](spark, folder).count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(queries)} queries, {len(sql)} with SQL, {bad} differ; without: {sorted(set(queries) - set(sql))}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
