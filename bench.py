"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.queries import REGISTRY  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "http_log_scan", "visitor_requests", "search_keywords", "visitor_peaks", "clean_requests", "gap_sessions",
    "referer_sessions", "combined_sessions", "session_statistics", "session_tree", "referer_click_through",
    "keyword_pairs", "query_filter_pairs", "user_terms_tfidf", "user_history_cosine", "keyword_combinations",
    "document_terms", "document_tfidf", "document_term_cosine", "embedding_cosine", "svd_term_cosine",
    "association_rules", "fused_terms", "document_search", "benchmark_search", "autocomplete", "metadata_terms",
)
BUDGET = float(os.environ.get("BENCH_BUDGET", "1500"))  # seconds after which no further query is started


def report(seconds: dict[str, float], sf_dir: str) -> None:
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "skipped": [q for q in HEADLINE if q not in seconds],
    }), flush=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    begin = time.time()
    seconds = {}

    def stopped(*_) -> None:  # what was measured is reported even then
        report(seconds, sf_dir)
        os._exit(1)

    signal.signal(signal.SIGTERM, stopped)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", os.environ.get("BENCH_MEMORY", "16g"))
    spark.range(1 << 20).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        if time.time() - begin > BUDGET:
            break
        start = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    report(seconds, sf_dir)
    spark.stop()


if __name__ == "__main__":
    main()
