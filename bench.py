"""Wall time of the headline queries: one JSON line on stdout.

Each query is built and run from scratch every time (plan building included),
its rows going to a sink that discards them; one warm-up round, then medians.
BENCH_SF_DIR, BENCH_CPUS, BENCH_REPEATS, BENCH_QUERIES (comma list or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from anchorline.registry import queries  # noqa: E402
from anchorline.session import local_session  # noqa: E402

HEADLINE = [
    "base_admissions",
    "next_admission",
    "cohort",
    "targets",
    "attrition",
    "normalize_enums",
    "first_icu_intime",
    "first_height",
    "first_weight",
    "flag_vasopressor",
    "flag_sedation",
    "flag_antibiotic",
    "flag_ventilated",
    "flag_rrt",
    "flag_blood_culture",
    "labs_48h",
    "vitals_48h",
    "labs_48h_shuffled",
    "cohort_features",
    "result_row_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    available = queries()
    names = list(available) if chosen == "all" else chosen.split(",") if chosen else HEADLINE

    spark = local_session(cpus, "anchorline-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:  # one warm-up round over everything
        timed(name)
    seconds = {name: round(median(timed(name) for _ in range(repeats)), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
