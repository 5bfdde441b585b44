"""What is kept of failing rows: keys, whole rows, profiles and value counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.local import local_frame
from plumbline.model import Dataset, quoted
from plumbline.operators.base import GroupCheck, ScanCheck

AUDIT_COLUMNS = ("dataset_run_id", "dataset_id", "rule_config_id", "load_timestamp")


def failed_keys(failed: DataFrame, dataset: Dataset) -> DataFrame:
    """Key of every failing row as a JSON object; primary key before candidate key."""
    keys = [dataset.field(k).name for k in dataset.key_columns]
    if not keys:
        raise ValueError(f"dataset {dataset.name!r} has no key columns")
    return failed.select(
        "dataset_run_id", "rule_config_id",
        F.lit(dataset.name).alias("table_name"),
        F.to_json(F.struct(*[F.col(quoted(k)) for k in keys])).alias("failed_key"),
        "load_timestamp",
    )


def failed_records(failed: DataFrame) -> DataFrame:
    """Failing rows as one JSON document each."""
    source = [c for c in failed.columns if c not in AUDIT_COLUMNS]
    return failed.select(
        "dataset_run_id", "rule_config_id",
        F.to_json(F.struct(*[F.col(quoted(c)) for c in source])).alias("failed_row"),
        "load_timestamp",
    )


def failing_values(plan) -> DataFrame:
    """``(rule_config_id, text, number, n)``: failing values with their counts.

    One pass for all row checks with an error value.  Counting happens before
    the shuffle, so a value that fills a third of the table is one entry per task.
    """
    scans = [(r, c) for r, c in plan.of_kind(ScanCheck)
             if c.unexpected is not None and c.error_value is not None]
    frames = []
    if scans:
        # Error checks that honour increments see the increment only.
        for incremental in (False, True):
            members = [(r, c) for r, c in scans if c.incremental is incremental]
            if not members:
                continue
            entries = F.array(*[
                F.when(c.unexpected, _entry(r.rule_id, c.error_value)) for r, c in members
            ])
            broken = plan.context.source(incremental).where(
                reduce(lambda a, b: a | b, [c.unexpected for _, c in members])
            )
            frames.append(
                broken.select(F.explode(entries).alias("e")).where(F.col("e").isNotNull()).select("e.*")
            )
    for rule, check in plan.of_kind(GroupCheck):
        if check.failed_rows is not None and check.error_value is not None:
            rows = check.failed_rows(plan.context.source(check.incremental))
            frames.append(rows.select(_entry(rule.rule_id, check.error_value).alias("e")).select("e.*"))
    if not frames:
        return local_frame(
        plan.dataset.frame.sparkSession, [], "rule_config_id bigint, text string, number double, n bigint"
        )
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union.groupBy("rule_config_id", "text", "number").agg(F.count(F.lit(1)).alias("n"))


def _entry(rule_id: int, value: Column) -> Column:
    return F.struct(
        F.lit(rule_id).cast("bigint").alias("rule_config_id"),
        value.cast("string").alias("text"),
        value.try_cast("double").alias("number"),
    )


def error_profiles(values: DataFrame) -> DataFrame:
    """Per rule, the profile of the values that failed: extremes, distinct, missing."""
    blank = F.col("text").isNull() | (F.trim("text") == "")
    numeric = F.count(F.when(~blank & F.col("number").isNull(), 1)) == 0
    total = F.sum("n")
    distinct = F.count("text")
    return values.groupBy("rule_config_id").agg(
        F.when(numeric, F.min("number").cast("string")).otherwise(F.min("text")).alias("error_min_value"),
        F.when(numeric, F.max("number").cast("string")).otherwise(F.max("text")).alias("error_max_value"),
        total.alias("error_total_count"),
        distinct.alias("error_unique_count"),
        (F.try_divide(distinct.cast("double"), total) * 100).alias("error_unique_percent"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("error_missing_count"),
    )


def error_value_counts(values: DataFrame, top: int | None = None) -> DataFrame:
    """Per rule, how often each failing value occurs: all of them, or the ``top`` most frequent with their rank.

    Ties are broken by value.
    """
    trimmed = (
        values.withColumn("text", F.trim("text")).where(F.col("text") != "")
        .groupBy("rule_config_id", "text").agg(F.sum("n").alias("n"))
    )
    if top is None:
        return trimmed.select("rule_config_id", F.col("text").alias("value"), "n")
    order = Window.partitionBy("rule_config_id").orderBy(F.desc("n"), "text")
    # The rank filter is pushed below the shuffle, so a rule never moves more
    # than ``top`` rows per task.
    return (
        trimmed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("rule_config_id", F.col("text").alias("value"), "n", "rank")
    )


def error_metrics(plan, top: int = 1000) -> DataFrame:
    """Profile and value counts of failing values as JSON, one row per rule.

    The JSON quotes the ``top`` most frequent values; ``error_unique_count``
    says how many there are, and ``error_value_counts`` has them all.
    """
    values = failing_values(plan)
    profile = error_profiles(values)
    counts = error_value_counts(values, top).groupBy("rule_config_id").agg(
        F.to_json(F.map_from_entries(F.transform(
            # Bounded by ``top`` entries per rule.
            F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
            lambda e: F.struct(e["value"], e["n"]),
        ))).alias("partial_unexpected_counts")
    )
    columns = [c for c in profile.columns if c != "rule_config_id"]
    return profile.join(counts, "rule_config_id", "left").select(
        "rule_config_id",
        F.to_json(F.struct(*columns)).alias("unexpected_rows"),
        "partial_unexpected_counts",
    )
