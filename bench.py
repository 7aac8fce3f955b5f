"""Headline queries, timed: one JSON line.

Queries run at $BENCH_SF_DIR on local[$BENCH_CPUS]: a warm-up, then the median of three. File operations go
from raw float32 files to folders of strips, on a grid of $BENCH_SIDE squared cells (4096 unless given; the published figures are of 11264).
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

import numpy as np

HEADLINE = (
    "ter_slope_pct", "ter_slope_deg", "ter_aspect", "ter_hillshade", "ter_tri", "ter_tpi", "ter_roughness", "ter_curv_mean", "ter_features",
    "foc_mean", "foc_min", "foc_max", "foc_gauss", "foc_convolve", "alg_add", "alg_mul", "alg_min", "alg_max", "alg_clamp", "alg_normalize",
    "xfer_reclass", "xfer_lookup", "red_stats", "red_minmax", "rs_nearest", "rs_bilinear", "rs_cubic", "rs_lanczos", "rs_average", "rs_mosaic",
    "arr_sum_over", "arr_broadcast_add", "wf_stack",
)


def timed(f, runs: int = 3) -> float:
    f()
    took = []
    for _ in range(runs):
        t = time.perf_counter()
        f()
        took.append(time.perf_counter() - t)
    return round(median(took), 3)


def file_operations(spark, folder: str, side: int) -> dict[str, float]:
    """Seconds for operations from raw file to raw strips."""
    from gridloom.functions import kernels as k
    from gridloom.operators.focal import gaussian
    from gridloom.sources import raw

    y, x = np.ogrid[0:side, 0:side]
    a, b = f"{folder}/a.f32", f"{folder}/b.f32"
    z = (180 * np.sin(x / 130, dtype=np.float32) * np.cos(y / 90, dtype=np.float32) + 20 * np.sin(x / 7, dtype=np.float32) * np.cos(y / 5, dtype=np.float32) + 400).astype(np.float32)
    z.tofile(a)
    np.roll(z, 7, 0).tofile(b)
    s, g = k.Scale(10.0), gaussian(2, 1.0)
    conv = np.array([[(3 * j - 2 * c + 4) / 32 for c in range(5)] for j in range(5)], np.float32)
    ops = {
        "slope": (1, 1, lambda z: k.slope(*k.horn(z, s), "degrees")), "aspect": (1, 1, lambda z: k.aspect(*k.horn(z, s), False, -1.0)), "hillshade": (1, 1, lambda z: k.hillshade(*k.horn(z, s), 315.0, 45.0)),
        "tri": (1, 1, lambda z: k.ruggedness(z, 1, "tri_riley")), "tpi": (1, 1, lambda z: k.ruggedness(z, 1, "tpi")), "roughness": (1, 1, lambda z: k.ruggedness(z, 1, "roughness")),
        "mean3": (1, 1, lambda z: k.box_mean(z, 1)), "mean11": (1, 5, lambda z: k.box_mean(z, 5)), "min3": (1, 1, lambda z: k.box_min(z, 1)), "max3": (1, 1, lambda z: k.box_max(z, 1)),
        "gauss5": (1, 2, lambda z: k.separable(z, g, g)), "conv5": (1, 2, lambda z: k.correlate(z, conv)),
        "add": (2, 0, lambda a, b: a + b), "mul": (2, 0, lambda a, b: a * b), "min": (2, 0, np.minimum), "max": (2, 0, np.maximum), "clamp": (1, 0, lambda z: np.minimum(np.maximum(z, np.float32(100)), np.float32(400))),
    }
    out = {}
    for name, (n, radius, kernel) in ops.items():
        target = f"{folder}/out"
        out[f"file_{name}"] = timed(lambda n=n, radius=radius, kernel=kernel: raw.raw_map(spark, [a, b][:n], side, side, target, radius, kernel))
        shutil.rmtree(target)
    out["file_minmax"] = timed(lambda: raw.raw_min_max(spark, a, side, side).collect())
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    side = int(os.environ.get("BENCH_SIDE", "4096"))
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from gridloom import catalog

    queries, found = {}, catalog.queries()
    for name in HEADLINE:
        queries[name] = timed(lambda name=name: found[name](spark, sf).write.format("noop").mode("overwrite").save())
        print(name, queries[name], file=sys.stderr)
    with tempfile.TemporaryDirectory() as folder:
        files = file_operations(spark, folder, side)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(queries.values()) + sum(files.values()), 3), "unit": "sec", "queries": queries | files, "sf": sf, "file_cells": side * side}))
    spark.stop()


if __name__ == "__main__":
    main()
