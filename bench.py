"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose
data and cores.  Every query writes all its rows to the no-op sink.  Derived
inputs that several queries share are built once and timed as ``build_*``.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "clean_text", "dehyphenate_keep_reduplication", "column_profile", "top_values", "blank_bands", "split_at_header",
    "segment_entries", "carry_forward", "subgroup_on_change", "nest_orphans_attach", "nested_tree_text",
    "assemble_documents", "sheet_to_entries", "row_conservation", "top_matches", "family_centroids", "feature_row",
    "json_leaves", "validate_documents", "dq_scan", "nearest_entry", "split_entries", "scan_markers", "token_budget",
    "convert_levels", "unmapped_by_levels",
)


def main() -> None:
    from pyspark.sql import SparkSession

    import workload
    from workload import fixtures

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("sheetloom-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    workload.load_all()

    def timed(fn) -> float:
        start = time.perf_counter()
        fn()
        return round(time.perf_counter() - start, 3)

    times: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()   # start the JVM's pools outside the clock
    times["build_sheet"] = timed(lambda: fixtures.sheet(spark, sf_dir))
    times["build_typed_cells"] = timed(lambda: fixtures.typed_cells(spark, sf_dir))
    chosen = sys.argv[1:] or HEADLINE
    for name in chosen:
        times[name] = timed(lambda: workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
        print(f"{times[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
