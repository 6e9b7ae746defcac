"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "angle_confusion", "nearest_endmember", "hull_continuum", "dual_continuum", "class_medoids", "polygon_purity",
    "collapse_labels", "category_labels", "audit_spectra", "expert_rules", "cap_per_polygon", "precedence_dedupe",
    "assemble_corpus", "suppress_pixels", "point_in_polygon", "average_precision", "calibration_error", "pooled_percentiles",
    "otsu_tiers", "detection_by_decile", "window_mean", "median_filter", "connected_regions", "zonal_statistics",
    "distance_components", "leakage_pairs", "dust_negatives", "spatial_thinning", "review_sample", "stream_latest_decision",
]


def main() -> None:
    from bandweave.plans import catalog
    from bandweave.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["angle_confusion"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
