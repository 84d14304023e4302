"""Run every query in Spark and in DuckDB and compare: names, types, rows, values.

    python -m checks.compare [sf_dir] [name ...]
"""

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks import registry

VIEWS = ["orders", "customer", "nation", "region"]
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{sf_dir}/{v}.parquet')")
    return con


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both results agree, else what differs first."""
    answer = con.sql(sql)
    spark_types = {c: SAME_TYPE.get(t, t) for c, t in df.dtypes}
    duck_types = {c: str(t) for c, t in zip(answer.columns, answer.types, strict=True)}
    if spark_types != duck_types:
        odd = {
            c: (spark_types.get(c), duck_types.get(c))
            for c in spark_types.keys() | duck_types.keys()
            if spark_types.get(c) != duck_types.get(c)
        }
        return f"schema differs (Spark, DuckDB): {odd}"
    names = sorted(spark_types)
    mine = sorted((repr([r[c] for c in names]) for r in df.collect()))
    at = [answer.columns.index(c) for c in names]
    theirs = sorted(repr([row[i] for i in at]) for row in answer.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows in Spark, {len(theirs)} in DuckDB"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"values differ: Spark {a} / DuckDB {b}"
    return None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(registry.QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = registry.QUERIES[name](spark, sf_dir)
            wrong = difference(df, con, registry.ORACLES[name])
        except Exception as e:
            wrong = f"{type(e).__name__}: {str(e)[:600]}"
        rows = "" if wrong else f"{len(df.take(1)) and 'rows' or 'EMPTY'}"
        print(f"{'FAIL' if wrong else 'ok  '} {name} {time.time() - start:.2f}s {rows}", flush=True)
        if wrong:
            failed += 1
            print("     ", wrong, flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
