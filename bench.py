"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ringfield.registry import QUERIES  # noqa: E402
from ringfield.session import local_session  # noqa: E402

HEADLINE = [
    "ring_area", "edges", "edge_attributes", "simplify", "clean_polygons", "image_to_world", "polygons_touching_patches",
    "keep_patches_with_vertices", "overlapping_pairs", "intersecting_any", "largest_per_cluster", "apply_field_plus",
    "threshold_accuracy", "curve_bands", "mask_iou_curve", "building_heights", "cyclic_distance", "rasterize",
    "batches_padded", "align_two_levels", "evaluate_alignment", "gaussian_field", "wide_csv", "feature_wkt",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    # One untimed query, so that starting the JVM's code paths is not charged to the first.
    QUERIES["ring_area"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    line = {
        "metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else sf_dir,
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
