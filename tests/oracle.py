"""Runs a registered query in Spark and its oracle in DuckDB and compares the results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 6)
        return repr(0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return repr(v) if not isinstance(v, bool) else str(v)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    spark_rows, spark_cols = _rows([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    duck_rows, duck_cols = _rows(cur.fetchall(), names)
    if spark_cols != duck_cols:
        return f"columns {spark_cols} != {duck_cols}"
    if spark_rows != duck_rows:
        a, b = set(spark_rows), set(duck_rows)
        return (
            f"rows {len(spark_rows)} vs {len(duck_rows)}; cols {spark_cols}\n"
            f"  spark only {len(a - b)}: {sorted(a - b)[:4]}\n  oracle only {len(b - a)}: {sorted(b - a)[:4]}"
        )
    if not spark_rows:
        return "both empty"
    return None


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as registered
    from fieldscope.session import local_session

    sf = argv[0]
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = registered.queries(), registered.oracle_sql()
    wanted = [n for n in queries if not argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv[1:])]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                n = df.count()
                problem = None if n else "no rows"
                df.limit(3).show(3, 200)
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s{'' if name in oracles else ' (rows only)'}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print("failed:", bad, "of", len(wanted))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
