"""Time the queries; prints one JSON line. ``value`` is the total of the headline queries."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stubble.queries import QUERIES  # noqa: E402
from stubble.session import local_session  # noqa: E402

HEADLINE = [
    "calc_yield_by_mode",
    "calc_by_regime",
    "mean_by_year_crop",
    "check_bounds",
    "check_observation",
    "qc_summary",
    "curate_levels",
    "qa_updates",
    "moisture_gapfill",
    "tiered_mean_gapfill",
    "regression_gapfill",
    "group_quantiles",
    "outlier_class",
    "quartile_class",
    "box_stats",
    "histogram_bins",
    "first_non_null_collapse",
    "priority_replicates",
    "two_source_reconcile",
    "georef_attach_full",
    "full_attach_masses",
    "grid_completion",
    "keyed_corrections",
    "text_number_split",
]


def timed(spark, name: str, sf_dir: str) -> float:
    """Seconds to plan and run a query in full, without writing its rows."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1)))
    names = sys.argv[1:] or [*HEADLINE, *sorted(set(QUERIES) - set(HEADLINE))]
    spark = local_session("stubble-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = [timed(spark, name, sf_dir)]
        if name in HEADLINE or runs[0] < 3:
            runs.append(timed(spark, name, sf_dir))
        seconds[name] = round(min(runs), 3)
    spark.stop()
    sf = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, best of two runs, total",
                "value": round(sum(s for n, s in seconds.items() if n in HEADLINE), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
