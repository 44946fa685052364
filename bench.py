"""Times the headline queries on whole tables and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["d7_check", "c1_cell_at", "c6_cell_text", "b3_rows", "b4_row_number", "e4_counts", "e7_all_problems", "e8_findings", "e9_wide", "f3_rollup", "h1_compare", "h3_tally", "i1_species"]


def main() -> None:
    session = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    from fieldleaf.queries import QUERIES

    def timed(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](session, SF_DIR).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    seconds = {name: timed(name) for name in HEADLINE}
    warm = {name: timed(name) for name in ("d7_check", "c1_cell_at", "e4_counts")}
    cells = QUERIES["d7_check"](session, SF_DIR).agg(F.sum("n")).first()[0]
    boxes = QUERIES["c1_cell_at"](session, SF_DIR).agg(F.sum("n")).first()[0]
    print(json.dumps({"metric": "seconds for the headline queries, cold", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "warm": warm, "cells_checked_per_second": round(cells / warm["d7_check"]), "boxes_placed_per_second": round(boxes / warm["c1_cell_at"]), "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
