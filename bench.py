"""Benchmark the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is fully evaluated with the ``noop`` sink (no driver collect),
once, after a warm-up pass of all headline queries on the sf0.01 tables.  Prints ONE JSON line:
``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_search", "hybrid_search", "semantic_search", "kb_search", "corpus_stats",
    "doc_chunks", "quality_features", "doc_metadata", "skip_processed", "version_delta",
    "sessions", "frequent_patterns",
    "eval_scores", "eval_recommend",
    "ttl_cache", "budget_admission", "route_log", "model_performance",
    "permission_audit", "validate_params", "tool_outcomes",
    "running_metrics", "request_rate",
    "processed_documents", "similar_inputs", "vector_clusters", "spending_report", "anomalies",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("TESSERA_MASTER", f"local[{cpus}]")
    os.environ.setdefault("TESSERA_SHUFFLE_PARTITIONS", str(max(4, int(cpus) * 2)))

    from tessera.plans.catalog import queries
    from tessera.session import get_spark

    spark = get_spark()
    qs = queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    # Warm-up: every headline query once on the small sf0.01 tables (JIT, codegen,
    # Python workers); no data of the measured scale is cached.  Then one timed run each.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm_dir) and warm_dir.rstrip("/") != sf_dir:
        for n in names:
            try:
                qs[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001 - a warm-up failure must not stop the bench
                print(f"warm-up {n} failed: {e}", file=sys.stderr)
    times, errors = {}, {}
    for n in names:
        try:
            times[n] = round(run(n), 3)
        except Exception as e:  # noqa: BLE001 - record and keep measuring the others
            errors[n] = str(e)[:300]
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
