"""Runs registered queries next to their SQL and compares the results value by value."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, otherwise what differs first."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return f"columns {names} != {sorted(columns)}"
    at = [columns.index(n) for n in names]
    rows = cur.fetchall()
    want = sorted(tuple(_plain(r[i]) for i in at) for r in rows)
    if len(got) != len(want):
        extra = [x for x in got if x not in set(want)][:2]
        lost = [x for x in want if x not in set(got)][:2]
        return f"{len(got)} rows != {len(want)}; only spark {extra}; only sql {lost}"
    for g, w in zip(got, want):
        if g != w:
            diff = [(n, x[:300], y[:300]) for n, x, y in zip(names, g, w) if x != y]
            return f"first difference {diff}"
    if not got:
        return "no rows"
    return None


def _tuned(build_session):
    return build_session(
        "oracle",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )


def main(argv: list[str]) -> int:
    from rolemesh.catalog import ORACLES, QUERIES
    from rolemesh.session import build_session

    sf_dir = f"/root/testdata/{argv[0]}" if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    if os.environ.get("PLAIN"):  # a session without any of the package's settings
        from pyspark.sql import SparkSession

        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
            "spark.driver.memory", "8g"
        ).config("spark.ui.enabled", "false").getOrCreate().conf.set("spark.sql.session.timeZone", "UTC")
        spark = SparkSession.active()
    else:
        spark = _tuned(build_session)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, fn, ORACLES[name], sf_dir)
            else:
                problem = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failed", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
