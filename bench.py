"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The load (reading the driver tables into works, payments and members) is timed as a query of
its own; the scoring job and the desks then read the loaded tables, as a nightly run would.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "score_works", "scored_view", "peer_baseline", "vendor_profile", "all_findings",
    "overview", "queue_page", "queue_filtered", "queue_summary", "queue_export", "search_works",
    "agency_ranking", "member_directory", "state_league", "risk_rollup", "forecast_summary",
    "monthly_trend", "gone_quiet", "compliance_book", "state_desk_districts",
    "district_desk_agencies", "current_verdicts", "unite_works", "rejected_works",
    "classify_sectors", "normalize_documents", "nearest_peer", "forest_anomaly",
    "work_similarity", "score_works_models", "document_near_copies", "match_one_to_one",
    "label_batches",
]


def main() -> None:
    from worklens.catalog import REGISTRY, callable_for
    from worklens.catalog.tables import Tables
    from worklens.session import get_session

    spark = get_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    times = {}
    started = time.time()
    tables = Tables(spark, SF_DIR)
    for name in ("works", "payments", "members", "similarity"):
        getattr(tables, name)
    times["load"] = round(time.time() - started, 3)
    # Tables that desks and queues read, each on a line of its own.
    for name in ("scores", "scored", "profile", "findings", "verdicts"):
        started = time.time()
        getattr(tables, name)
        times[f"table_{name}"] = round(time.time() - started, 3)
    for name in HEADLINE:
        started = time.time()
        callable_for(REGISTRY[name])(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(SF_DIR).name}))


if __name__ == "__main__":
    main()
