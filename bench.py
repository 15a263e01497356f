"""Times the headline queries: one cold and three warm runs each, median of the warm ones.

The cold runs of all queries come first; the warm ones go through the list forwards, backwards
and forwards, so that no query gains or loses by its place.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Prints one JSON line.
"""

import json
import os
import statistics
import time

from checks.catalog import QUERIES
from leadloom.session import get_spark

HEADLINE = [
    "F01_clean",
    "F01_clean_documents",
    "E01_extract_cards",
    "E10_page_fields",
    "M01_extract_features",
    "A01_grade_summary",
    "A04_dedupe_leads",
    "A09_classification_report",
    "A10_width_profile",
    "J01_enrich",
    "J02_suppress",
    "J04_apply_feedback",
    "J06_attach_messages",
    "W02_collect",
    "W04_select_campaign",
    "W06_with_rank",
    "O01_rank_leads",
    "M03_split",
    "M07_score",
    "M09_retrain",
]
# Fitting 150 trees takes most of its time in job latency; one warm run shows it. M07 scores with
# a model that is fitted once, in its cold run.
ONE_WARM = {"M09_retrain"}


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    cold = {name: round(run(name), 3) for name in HEADLINE}
    times = {name: [] for name in HEADLINE}
    for order in (HEADLINE, HEADLINE[::-1], HEADLINE):
        for name in order:
            if not (name in ONE_WARM and times[name]):
                times[name].append(run(name))
    warm = {name: round(statistics.median(times[name]), 3) for name in HEADLINE}
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum of warm medians over headline queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
