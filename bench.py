"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the number of local cores, BENCH_QUERIES a comma list to
run instead of the headline queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from refloom.plans import derived
from refloom.plans import q_citations, q_context, q_rules, q_wikitext  # noqa: F401  (registers the queries)
from refloom.plans.registry import QUERIES
from refloom.session import local_session

HEADLINE = [
    "label_counts",
    "extracted_citations",
    "templates_per_page",
    "plain_text",
    "template_params",
    "normalized",
    "label_news",
    "neighbors_40",
    "join_features",
    "token_counts",
    "unk_words",
    "best_candidate",
    "similarity_ratio",
    "char_sequence",
    "links_from_html",
    "request_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "refloom-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}

    start = time.perf_counter()
    derived.citations(spark, sf_dir)
    derived.articles(spark, sf_dir)
    times["stage_tables"] = round(time.perf_counter() - start, 3)

    for name in names:
        start = time.perf_counter()
        # Every row and column is computed, nothing is brought to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
