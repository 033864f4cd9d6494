"""Compare registered queries with their SQL on DuckDB: rows, column types and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a DuckDB result, empty when there are none."""
    con.execute(sql)
    names = [d[0] for d in con.description]
    expected = con.fetchall()
    got = [tuple(r) for r in df.collect()]
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    order = sorted(names)
    a = sorted(tuple(_cell(r[df.columns.index(n)]) for n in order) for r in got)
    b = sorted(tuple(_cell(r[names.index(n)]) for n in order) for r in expected)
    if len(a) != len(b):
        problems.append(f"{len(a)} rows instead of {len(b)}")
    if a != b:
        extra, missing = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        problems.append(f"values differ: spark only {str(extra)[:700]}, sql only {str(missing)[:700]}")
    return problems


def main(argv: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from findspan.session import builder

    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = (builder("check").master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start, spent = time.time(), 0.0
        try:
            sql = entry.oracle_sql().get(name)
            df = fn(spark, folder)
            problems = [f"no sql, {df.count()} rows"] if sql is None else compare(df, con, sql)
            spent, begun = time.time() - start, time.time()
            rows = con.execute(f"SELECT count(*) FROM ({sql})").fetchall()[0][0] if sql else -1
        except Exception as error:  # noqa: BLE001
            problems, rows = [f"{type(error).__name__}: {str(error)[:900]}"], -1
        ok = not problems or problems[0].startswith("no sql")
        bad += not ok
        took = time.time() - begun if spent else 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name} {rows} rows {spent:.1f}s (sql about {took:.1f}s) {'; '.join(problems)}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
