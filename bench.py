"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores; BENCH_QUERIES
may name other queries, separated by commas.  A query's time is the wall-clock
time of its full result written to Spark's no-op sink, after one untimed run of
the flagship query that starts the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.plans import QUERIES  # noqa: E402
from corpusloom.session import build_session  # noqa: E402

HEADLINES = (
    "search_bm25 search_boosted_fields msearch_topk match_index bool_scored doc_freq match_terms percolate snippet matrix_stats children_per_bucket "
    "page_items url_fingerprint same_site_links site_codes unseen_pages crawl_rounds upsert_last_write partial_update "
    "sinter sdiff zunion_weighted zinter_min zrank zrank_bucketed zrevrange_topk zrange_by_score list_range list_push hash_lookup "
    "bitcount_by_key bitop_and counters ttl_live glob_keys approx_users geo_radius geo_radius_by_member "
    "sort_orders_by_balance route_messages clean_style clean_style_fully crawl_items string_append_rows stream_ingest_plain stream_counters stream_dedupe"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINES
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("search_bm25")
    times = {}
    for name in names:
        times[name] = run(name)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
