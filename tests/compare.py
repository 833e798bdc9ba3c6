"""Run registered queries against their SQL twins: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def make_session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wareloom-tests")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, Decimal):
        return (2, format(v.normalize(), "f"))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else format(Decimal(repr(v)).normalize(), "f"))
    if isinstance(v, int):
        return (2, str(v))
    return (3, str(v))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def check(spark, con, folder, name, query, sql) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, folder)
    got_cols, got = canonical(df.columns, df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want_cols, want = canonical(names, res.fetchall())
    problems = []
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        expect = KINDS.get(t, t.upper())
        if expect != kinds[f.name]:
            problems.append(f"type of {f.name}: {t} vs {kinds[f.name]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        problems.append(f"values differ, e.g. {diff}")
    return "; ".join(problems)


def main(argv):
    import __spark_entry__ as entry

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con = make_session(), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, q in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sql:
                out = check(spark, con, folder, name, q, sql[name])
            else:
                out = "" if q(spark, folder).count() >= 0 else "no rows"
        except Exception as e:  # report and go on with the next query
            out = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(out)
        print(f"{'FAIL' if out else 'ok  '} {name} {time.time() - t:.2f}s {out[:1200]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
