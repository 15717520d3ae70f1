"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of cores. Each query runs once to warm up and
then BENCH_RUNS times (1 by default); the median counts. Results are computed in full and discarded (noop sink).
A query whose first run takes longer than LONG seconds is not run again; one that takes longer than BENCH_LIMIT (240) seconds is
stopped and left out, as is one that fails. Each figure goes to standard error as it is known, and the line of all figures is
printed after BENCH_TOTAL (1500) seconds, or when the process is ended, with the queries done by then.
"""

from __future__ import annotations

import json
import os
import signal
import statistics
import sys
import tempfile
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsflow.registry import load  # noqa: E402
from newsflow.session import build_session  # noqa: E402

HEADLINE = [
    "q_lexicon_score", "q_scoring_job", "q_scorer_job", "q_question_bias", "q_category_share", "q_watchlist", "q_histogram",
    "q_indicator_table", "q_densify", "q_price_enrich", "q_context", "q_outcome_intraday", "q_outcome_daily",
    "q_outcome_ticker", "q_weekend_patch_global", "q_split", "q_impute_scale", "q_pr_f1", "q_class_report", "q_upsert",
    "q_news_rows", "q_ingest_job", "q_has_news", "q_status", "q_stream_score",
    "q_lexicon_score_grown", "q_outcome_job", "q_upsert_stored", "q_train_score", "q_backfill", "q_regressor", "q_text_model",
]

# Seconds from which on the first run of a query is its figure.
LONG = 30


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    limit, total = float(os.environ.get("BENCH_LIMIT", "240")), float(os.environ.get("BENCH_TOTAL", "1500"))
    spark = build_session("newsflow-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="newsflow-bench-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spent: dict[str, float] = {}
    begun = time.perf_counter()

    def line(*_) -> None:
        print(json.dumps({
            "metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
            "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "left_out": [n for n in names if n not in spent],
        }), flush=True)

    def ended(*_) -> None:
        line()
        os._exit(0)

    signal.signal(signal.SIGTERM, ended)
    for name in names:
        if time.perf_counter() - begun > total:
            break
        times: list[float] = []
        try:
            while len(times) <= runs and (not times or times[0] <= LONG):
                times.append(timed(spark, queries[name], folder, limit))
        except Exception as error:
            print(f"{name} left out: {type(error).__name__}", file=sys.stderr, flush=True)
            continue
        spent[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    line()
    spark.stop()


def timed(spark, query, folder: str, limit: float) -> float:
    """Seconds of one run; its jobs are cancelled after `limit` seconds."""
    timer = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
    timer.start()
    start = time.perf_counter()
    try:
        query(spark, folder).write.format("noop").mode("overwrite").save()
    finally:
        timer.cancel()
    return time.perf_counter() - start


if __name__ == "__main__":
    main()
