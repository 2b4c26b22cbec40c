"""Times the headline queries once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pixelmill.plans import queries as pixels  # noqa: E402

HEADLINE = [
    "px_lineitem", "boost", "gamut_v_gamut", "log_vlog", "bt709_to_srgb", "lut1d", "lut3d_tetra", "quantize_u16", "meter_average", "meter_hybrid", "meter_matrix", "auto_expose_hybrid",
    "histogram", "progress_running", "debounce_events", "vignetting", "remap_bilinear", "develop_v_log", "develop_vlog_lut",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = pixels.queries(), {}
    known[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.time()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
