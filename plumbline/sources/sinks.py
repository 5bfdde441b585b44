"""Appending results, keys, failed rows and profiles; exporting the failure pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.sources.reference_csv import export_csv

FAILED_ROW_PARTITIONS = ("dataset_run_id", "rule_config_id")


def append(df: DataFrame, target: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Append to a Parquet directory (a path) or to a catalog table (a name)."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in target:
        writer.parquet(target)
    else:
        writer.saveAsTable(target)


def committed(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of a table that runs wrote whose attempt the manifest names, without the attempt.

    A run that did not end is not in the manifest, and of a repeated run only
    the last attempt counts.
    """
    # One row per attempt of a run.
    valid = manifest.groupBy("dataset_id", "dataset_run_id").agg(F.max_by("attempt", F.struct("committed", "attempt")).alias("attempt"))
    return df.join(F.broadcast(valid.select("attempt")), "attempt", "left_semi").drop("attempt")


def append_failed_rows(df: DataFrame, target: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Failed rows, laid out so that one run and rule can be read back alone."""
    append(df, target, partition_by=(*partition_by, *FAILED_ROW_PARTITIONS))


def export_failure_pivot(pivot: DataFrame, directory: str, dataset: str, run_id: int,
                         *, single_file: bool = False) -> str:
    """Write the pass/fail pivot of a run as CSV and return where it went."""
    clean = "".join(ch if ch.isalnum() and ch.isascii() else "_" for ch in dataset)
    path = f"{directory.rstrip('/')}/FAILED_ROWS_{clean}_{run_id}"
    export_csv(pivot, path, single_file=single_file)
    return path
