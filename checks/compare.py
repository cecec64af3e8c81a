"""Run registered queries beside their SQL and report differences.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

SPARK_TO_DUCK = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _duck_type(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return spark_type.upper().replace(" ", "")
    return SPARK_TO_DUCK[spark_type]


def difference(df, con, sql: str) -> str | None:
    """None when rows, column names and column types agree, else a short description."""
    result = con.execute(sql)
    sql_types = {c[0]: str(c[1]).replace(" ", "") for c in result.description}
    df_types = {name: _duck_type(kind) for name, kind in df.dtypes}
    if set(sql_types) != set(df_types):
        return f"columns: {sorted(df_types)} vs {sorted(sql_types)}"
    if sql_types != df_types:
        odd = {c: (df_types[c], sql_types[c]) for c in df_types if df_types[c] != sql_types[c]}
        return f"types: {odd}"
    names = sorted(df_types)
    order = [list(sql_types).index(n) for n in names]
    want = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    got = Counter(tuple(row) for row in df.select(*names).collect())
    if got == want:
        return None
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    counts = f"rows: {sum(got.values())} vs {sum(want.values())}"
    return f"{counts}\n  {names}\n  only Spark {extra}\n  only SQL {missing}"


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from checks.catalog import QUERIES
    from checks.oracle import ORACLE

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            found = difference(df, con, ORACLE[name]) if name in ORACLE else f"no SQL, {df.count()}"
        except Exception as error:  # noqa: BLE001  one broken query must not hide the others
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        verdict = "ok " if found is None else "BAD"
        print(f"{verdict} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
