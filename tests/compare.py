"""Run registered queries and their DuckDB SQL side by side: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, float) and (math.isnan(v) or v == 0):
        return None if math.isnan(v) else 0.0
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, sql: str, sf: str) -> str:
    """Empty if the query and the SQL agree."""
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, the SQL has {len(want)}"
    odd = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(odd)} of {len(got)} rows differ, e.g. {odd[0]}" if odd else ""


def session():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "3g"}
    spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    spark, con, queries, sql, bad = session(), connect(sf), entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            said = difference(spark, con, queries[name], sql[name], sf) if name in sql else f"no SQL; {queries[name](spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001  reported, and the next one runs
            said = f"failed: {str(e)[:600]}"
        wrong = bool(said) and not said.startswith("no SQL")
        bad += wrong
        print(f"{'BAD ' if wrong else 'ok  '} {name} {time.time() - began:.1f} s {said}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
