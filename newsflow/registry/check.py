"""Compare queries with their SQL on one scale: python -m newsflow.registry.check <folder> [name ...]"""

from __future__ import annotations

import math
import sys
import threading
import time

# Seconds a query or its SQL may take here, and those that train models.
LIMIT = 90
MODEL_LIMIT = 300
MODELS = ("q_train_score", "q_backfill", "q_regressor", "q_model_reports", "q_text_model")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return repr(0.0 if number == 0 else number)
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, query, sql, limit=None):
    """(matches, message) of one query, which is stopped after `limit` seconds."""
    limit = limit or (MODEL_LIMIT if name in MODELS else LIMIT)
    start = time.time()
    timer = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        df = query(spark, sf_dir)
        got = table_of(df.columns, [tuple(r) for r in df.collect()])
    finally:
        timer.cancel()
    spent = time.time() - start
    if sql is None:
        return True, f"{name}: {len(got[1])} rows, no SQL, {spent:.1f}s"
    start = time.time()
    timer = threading.Timer(limit, con.interrupt)
    timer.start()
    try:
        cursor = con.execute(sql)
        want = table_of([d[0] for d in cursor.description], cursor.fetchall())
    finally:
        timer.cancel()
    sql_spent = time.time() - start
    if got[0] != want[0]:
        return False, f"{name}: columns {got[0]} vs {want[0]}"
    if got[1] == want[1]:
        return True, f"{name}: {len(got[1])} rows equal, {spent:.1f}s (SQL {sql_spent:.1f}s)"
    ours, theirs = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return False, (f"{name}: {len(got[1])} vs {len(want[1])} rows, {len(ours)} and {len(theirs)} differ\n"
                   f"  {got[0]}\n  ours {sorted(ours)[:4]}\n  SQL  {sorted(theirs)[:4]}")


def main(sf_dir: str, *names: str) -> int:
    from newsflow.registry import load
    from newsflow.session import build_session

    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.ui.showConsoleProgress": "false",
                                                   "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    con = duck(sf_dir)
    bad = 0
    for name in names or queries:
        try:
            ok, message = compare(spark, con, name, sf_dir, queries[name], oracles.get(name))
        except Exception as error:
            ok, message = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        bad += not ok
        print("ok  " if ok else "BAD ", message, flush=True)
    print(f"{bad} of {len(names or queries)} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(*sys.argv[1:])))
