"""Compare registered queries with their SQL: `python -m tests.compare [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "\0null" if value is None else str(value)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def difference(spark, db, query, sql: str, sf_dir: str) -> str | None:
    """None if rows, column names and types agree, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = db.sql(sql)
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    if kinds != theirs:
        return f"types {kinds} / {theirs}"
    expected = rows_of(relation.columns, relation.fetchall())
    if len(mine) != len(expected):
        return f"{len(mine)} / {len(expected)} rows"
    for a, b in zip(mine, expected):
        if a != b:
            return f"{a} / {b}"[:2000]
    return None if mine else "no rows"


def main() -> None:
    from forecourt.queries import QUERIES, SQL
    from forecourt.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            if name in SQL:
                found = difference(spark, db, QUERIES[name], SQL[name], sf_dir) or "equal"
            else:
                found = f"no SQL, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as fault:
            found = f"FAULT {type(fault).__name__}: {str(fault)[:1500]}"
        print(f"{name}: {found} ({time.time() - start:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
