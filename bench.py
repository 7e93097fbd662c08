"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

``BENCH_QUERIES`` (comma-separated names, or ``all``) overrides the selection.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trialspark.bindings import QUERIES  # noqa: E402
from trialspark.session import local_session  # noqa: E402

HEADLINE = (
    "ingest_comma",
    "ingest_utf16",
    "ingest_multiline",
    "load_report",
    "expand_archives",
    "catalog_extract",
    "fetch_manifest",
    "sanitize_names",
    "page_rows",
    "adhoc_sql",
    "global_agg",
    "treatment_breakdown",
    "join_breakdown",
    "combined_trials",
    "individual_trials",
    "numeric_text_avg",
    "results_equal",
    "glucose_summary",
    "adverse_counts",
    "baseline_change",
    "demo_outcomes",
    "term_cohorts",
    "parse_pairs",
    "render_prompts",
    "extract_sql_api",
    "training_tables",
)


# Run untimed first, so that JVM start-up is not charged to whichever query comes first.
WARM_UP = ("ingest_pipe", "gmi")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
