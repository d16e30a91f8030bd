"""Benchmark of the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (HERE, os.environ.get("PYTHONPATH")) if p)

from docweave.session import local_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = (
    "shred_html", "clean_documents", "build_index", "extract_schemas", "parse_releases", "build_catalog",
    "search_top_k", "search_batch", "search_with_passages", "select_passages", "validate", "verdicts",
    "resolve_schema", "errors_for_endpoint", "resolve_fetch", "refresh_merge", "diff_snapshots",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def rates(spark, sf_dir: str, times: dict[str, float]) -> dict[str, int]:
    """Items per second where the number of items is known from the tables."""
    def rows(name: str) -> int:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").count()

    items = {
        "shred_html": ("web_pages", lambda: rows("pages")), "build_index": ("api_pages", lambda: rows("part")),
        "parse_releases": ("release_pages", lambda: rows("orders")), "validate": ("bodies", lambda: rows("orders")),
        "search_batch": ("query_document_pairs", lambda: rows("benchmark") * rows("documents")),
    }
    return {
        f"{label}_per_sec": round(count() / times[name]) for name, (label, count) in items.items() if times.get(name)
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, os.environ.get("BENCH_MEMORY", "16g"))
    # One small query starts the workers, so no query pays for it.
    run(spark, "page_deprecation", sf_dir.replace("sf0.1", "sf0.001"))
    wanted = sys.argv[1:] or HEADLINE
    times = {name: run(spark, name, sf_dir) for name in wanted}
    print(json.dumps({
        "rates": rates(spark, sf_dir, times),
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
