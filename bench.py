"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR: table directory (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_RUNS: timed runs per query, the best counts (default 1, after one warm-up of the session).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marginalia.plans import catalog  # noqa: E402
from marginalia.session import local_session  # noqa: E402

HEADLINE = (
    "vector_topk",
    "vector_topk_batch",
    "matched_documents",
    "section_chunks",
    "document_chunks",
    "split_chunks",
    "token_counts",
    "checksums",
    "scanned_corpus",
    "target_state",
    "chunk_diff",
    "orphans",
    "next_store",
    "posting_counts",
    "keyword_single",
    "keyword_all_terms",
    "keyword_phrase",
    "hybrid_rank",
    "searched_pages",
    "page_export",
    "last_questions",
    "prompts",
    "embedded_documents",
    "document_contexts",
    "typescript_entities",
    "entity_chunks",
    "python_entities",
    "request_slots",
    "changed_repositories",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session("bench")
    catalog.load()
    # Start the JVM's code generation and the Python workers before the clock runs.
    spark.range(1000).mapInPandas(lambda batches: batches, "id long").selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(runs):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - started
            best = taken if best is None else min(best, taken)
        times[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
