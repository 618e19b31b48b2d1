"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Results go to the no-op sink, so
every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from treeloom.plans.catalog import QUERIES  # noqa: E402
from treeloom.session import build_session  # noqa: E402

HEADLINE = [
    "extension_stats", "directory_rollup", "corpus_totals", "directory_states", "bulk_select", "priority_select",
    "search_topk", "search_many", "term_counts", "missing_suggestions", "file_imports", "import_edges", "missing_deps",
    "graph_metrics", "neighbour_labels", "reachability", "dependency_closure", "import_cycles", "js_functions",
    "css_components", "py_methods", "html_tags", "structure_summaries", "bundle_manifest", "bundle_parse",
    "content_hash_dedup", "archive_roundtrip", "bracket_balance", "absent_elements", "diagram_detailed_lint",
    "model_stats", "recent_scores", "running_mean", "model_routing", "stream_model_stats", "reply_parse",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the JVM before timing
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    sizes = QUERIES["semantic_metadata"](spark, sf_dir).selectExpr("sum(original_size) AS whole", "sum(compressed_size) AS part").first()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "semantic_size_percent": round(100 * sizes.part / sizes.whole, 2),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
