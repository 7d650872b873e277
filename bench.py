"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.corpus import fleet
from keydrift.operators import files, usages
from keydrift.plans.scan import DriftScan

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        # many small input files: pack scan tasks by bytes, not by the default 4 MB per file
        .config("spark.sql.files.openCostInBytes", str(64 << 10))
        .config("spark.checkpoint.dir", os.environ.get("STAGING_DIR") or tempfile.mkdtemp(prefix="keydrift-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    # the fleet's files are the input: derived and stored before the clock starts
    source, exported = fleet.source_files(spark, SF_DIR), fleet.exported(spark, SF_DIR)
    size = source.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes")).first()

    def scan() -> DriftScan:
        return DriftScan(source, exported)

    warm = scan()
    consume(warm.json_report)
    queries = {
        "extract_usages": lambda: consume(usages.extract_usages(scan().code_files)),
        "count_files_by_language": lambda: consume(files.count_files_by_language(scan().scanned_files)),
        "parse_definitions": lambda: consume(scan().definitions),
        "overlay_exported": lambda: scan().env,
        "missing": lambda: consume(scan().missing),
        "partial_matches": lambda: consume(scan().partial_matches),
        "unused": lambda: consume(scan().unused),
        "summary": lambda: consume(scan().summary),
        "full_scan_json": lambda: consume(scan().json_report),
    }
    seconds = {}
    for name, run in queries.items():
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "files": size["n"],
                "bytes": size["bytes"],
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
