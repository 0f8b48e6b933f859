"""Headline queries, timed one after the other; prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables and ``BENCH_CPUS`` the local cores. Each query is run once
on a warm session and its result is written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugework import analyze, analyze_catalog  # noqa: E402
from gaugework.session import shared_dir, tuned  # noqa: E402
from gaugework.sources import generators  # noqa: E402
from gaugework.sources.csv_files import load_csv  # noqa: E402
from gaugework.suite import fixtures, registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "column_counts_lineitem", "numeric_stats_lineitem", "row_duplicates_lineitem", "text_lengths_documents",
    "row_duplicates_documents", "duplicate_rows_flagged_messy", "quality_dimensions_messy", "governance_classes_messy",
    "recommendations_messy",
)


def session() -> SparkSession:
    builder = tuned(SparkSession.builder.master(f"local[{CPUS}]")).config("spark.sql.shuffle.partitions", CPUS)
    # Small files here are one row group each; a smaller split lets more than one core read them.
    builder = builder.config("spark.sql.files.maxPartitionBytes", "2m").config("spark.ui.enabled", "false")
    spark = builder.config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def finish(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def analyse(frame, name):
    """The complete pipeline of one table, up to its findings and recommendations."""
    result = analyze(frame, name)
    finish(result.findings)
    finish(result.recommendations)


def jobs(spark: SparkSession):
    for name in HEADLINE:
        yield name, lambda name=name: finish(registry.REGISTRY[name][0](spark, SF_DIR))
    for name in ("lineitem", "documents"):
        yield f"analyze_{name}", lambda name=name: analyse(fixtures.table(spark, SF_DIR, name), name)
    tables = {name: fixtures.table(spark, SF_DIR, name) for name in registry.SCHEMAS}
    yield "analyze_catalog", lambda: finish(analyze_catalog(spark, tables).quality_score)
    scenarios = {
        "scenario_small": (generators.standard_rows, 1_000, {"width": 10}),
        "scenario_medium": (generators.standard_rows, 10_000, {}),
        "scenario_large": (generators.standard_rows, 50_000, {}),
        "scenario_row_limit": (generators.compact_rows, 100_000, {}),
        "scenario_mixed": (generators.mixed_rows, 41_000, {}),
        "scenario_wide": (generators.compact_rows, 4_000, {"width": 250, "names": [f"c{i:03d}" for i in range(250)]}),
    }
    # The published figures hold reading the file as well; writing it is not timed.
    folder = f"{shared_dir(spark).rstrip('/')}/gaugework/bench-{uuid.uuid4().hex}"
    generators.standard_rows(spark.range(50_000)).write.option("header", True).csv(folder)
    yield "csv_large", lambda: analyse(load_csv(spark, folder), "csv_large")
    for name, (make, rows, options) in scenarios.items():
        yield name, lambda make=make, rows=rows, options=options, name=name: analyse(make(spark.range(rows), **options), name)


def main() -> None:
    spark = session()
    # Class loading and compilation of the first query are not what is measured.
    analyse(generators.standard_rows(spark.range(1_000)), "warm_up")
    seconds = {}
    for name, job in jobs(spark):
        started = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
