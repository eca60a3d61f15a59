"""Run queries next to their SQL and compare columns, types and rows.

    python -m checks.compare [folder] [query ...]
"""

import math
import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def session(cores: int = 8, partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lineloom")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return getattr(value, "replace", lambda **_: value)(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, sf: str, name: str) -> str:
    started = time.time()
    df = QUERIES[name](spark, sf)
    mine = rows_of(df.columns, df.collect())
    spent = time.time() - started
    if name not in ORACLE:
        return f"ROWS   {name}: {sum(mine.values())} rows, {spent:.1f}s"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    started = time.time()
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = rows_of(columns, result.fetchall())
    sql_spent = time.time() - started
    problems = []
    wanted = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if wanted != types:
        problems.append(f"schema {wanted} != {types}")
    if mine != theirs:
        extra, lost = mine - theirs, theirs - mine
        problems.append(f"extra {sum(extra.values())} {list(extra)[:2]} lost {sum(lost.values())} {list(lost)[:2]}")
    state = "OK    " if not problems else "WRONG "
    return f"{state} {name}: {sum(mine.values())} rows, {spent:.1f}s, sql {sql_spent:.1f}s {' '.join(problems)[:1200]}"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = session()
    bad = 0
    for name in names:
        try:
            line = compare(spark, sf, name)
        except Exception as problem:
            line = f"FAILED {name}: {str(problem)[:600]}"
            if len(names) == 1:
                traceback.print_exc()
        bad += not line.startswith(("OK", "ROWS"))
        print(line, flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
