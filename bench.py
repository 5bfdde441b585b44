"""Times headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the threads.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import Dataset, Rule, evaluate, run_suite
from plumbline.operators import capture
from plumbline.operators import microsegments as seg
from plumbline.operators import profile as prof
from plumbline.operators import relationships as rel
from plumbline.operators.base import Context
from plumbline.operators.correlations import correlation_matrix
from plumbline.operators.percentiles import exact_percentiles
from plumbline.plans import fusion, reports
from verification import fixtures
from verification.runs import suite_rules


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("plumbline-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def finish(df: DataFrame) -> None:
    """Compute every row and column without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def benchmarks(spark: SparkSession, sf_dir: str) -> dict[str, object]:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dataset = Dataset("lineitem", lines, primary_key=("l_orderkey", "l_linenumber"))
    rules = suite_rules()
    results = fixtures.frame(spark, sf_dir, "rule_results")
    details = fixtures.frame(spark, sf_dir, "segment_details")
    anomalies = fixtures.frame(spark, sf_dir, "segment_anomalies")
    context = Context(dataset)
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    unique = "expect_column_values_to_be_unique"
    compound = "expect_compound_columns_to_be_unique"
    return {
        "suite_fused": lambda: finish(evaluate(dataset, rules)),
        "suite_one_job_per_rule": lambda: [finish(evaluate(dataset, [r])) for r in rules],
        "suite_run_with_summary": lambda: run_suite(dataset, rules, run_id=1),
        "uniqueness": lambda: finish(evaluate(dataset, [
            Rule(1, unique, "l_orderkey"), Rule(2, "expect_column_unique_value_count_to_be_between", "l_orderkey", {"min_value": 1}),
            Rule(3, compound, None, {"column_list": ["l_orderkey", "l_linenumber"]})])),
        "failed_rows": lambda: finish(fusion.failed_rows(fusion.plan_rules(context, rules))),
        "surplus_copies": lambda: finish(fusion.failed_rows(fusion.plan_rules(
            Context(dataset), [Rule(1, compound, None, {"column_list": ["l_orderkey", "l_linenumber"]})]))),
        "error_metrics": lambda: finish(capture.error_metrics(fusion.plan_rules(Context(dataset), rules))),
        "profile_sketched": lambda: finish(prof.profile_columns(lines)),
        "profile_exact": lambda: finish(prof.profile_columns(orders, prof.ProfileOptions(exact=True, extended=True))),
        "exact_percentiles": lambda: finish(exact_percentiles(lines, F.col("l_extendedprice"), [0.05, 0.5, 0.95])),
        "word_counts": lambda: finish(seg.word_counts(prof.column_values(documents, ["text"]))),
        "histograms": lambda: finish(seg.histograms(lines.select(*numbers))),
        "categorical_rules": lambda: finish(rel.mine_categorical_rules(
            lines, "lineitem", ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"])),
        "correlations": lambda: finish(correlation_matrix(lines, numbers)),
        "conformity": lambda: finish(reports.conformity_distribution(results)),
        "segment_analysis": lambda: finish(reports.final_analysis(details, anomalies)),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session(cpus)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    times: dict[str, float] = {}
    for name, run in benchmarks(spark, sf_dir).items():
        # The first run compiles code and warms file listings; the second counts.
        run()
        started = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
