"""A whole run from configuration tables: dataset, rules, evaluation, and everything that is kept."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.local import local_frame
from plumbline.model import Dataset
from plumbline.operators import capture
from plumbline.operators.base import Options
from plumbline.plans import pivot, suite
from plumbline.sources import datasets, sinks


# The tables a run writes to.
PARTS = {
    "results": "dq_rule_results", "failed_keys": "dq_failed_row_keys", "run_log": "dq_dataset_run_log", "audit": "dq_rule_audit_log",
}
MANIFEST = "dq_run_manifest"
MANIFEST_SCHEMA = "dataset_id bigint, dataset_run_id bigint, attempt string, committed timestamp"


@dataclass
class Execution:
    """A finished run and where its parts were written."""

    run: suite.SuiteRun
    folder: str
    failed_rows: str
    failure_file: str | None
    attempt: str

    def read(self, part: str) -> DataFrame:
        """What committed runs left in a table: ``results``, ``failed_rows``, ``failed_keys``, ``run_log`` or ``audit``."""
        spark = self.run.results.sparkSession
        path = self.failed_rows if part == "failed_rows" else f"{self.folder}/{PARTS[part]}"
        return sinks.committed(spark.read.option("mergeSchema", True).parquet(path), manifest(spark, self.folder))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(dataset_id, dataset_run_id, attempt, committed)``: the runs that ended, a row per attempt."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder.rstrip('/')}/{MANIFEST}")


def _names(text: str | None, key: str) -> tuple[str, ...]:
    """Column names from ``{"primary_key": ["a", "b"]}``, a JSON list, or names with commas."""
    if not (text or "").strip():
        return ()
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        return tuple(n.strip() for n in text.split(",") if n.strip())
    if isinstance(value, dict):
        value = value.get(key) or []
    return tuple(str(v) for v in ([value] if isinstance(value, str) else value))


def configured_dataset(
    spark: SparkSession, config: DataFrame, dataset_id: int,
    tables: Mapping[str, DataFrame] | None = None, run_log: DataFrame | None = None, run_id: int | None = None,
) -> Dataset:
    """The dataset of one row of the dataset table.

    A TABLE is looked up in ``tables`` by its name and else in the catalogue; a
    QUERY sees ``tables`` as views.  An incremental dataset continues after the
    latest ``max_validated_timestamp`` of its runs in ``run_log``, other than the
    run ``run_id`` itself, and ends at its newest timestamp, read here and now.
    """
    rows = config.where(F.col("dataset_id") == dataset_id).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} dataset has id {dataset_id}")
    row = rows[0].asDict()
    metadata: dict[str, object] = {
        "dataset_id": dataset_id,
        "primary_key": _names(row.get("primary_key_columns"), "primary_key"),
        "candidate_key": _names(row.get("candidate_key_columns"), "candidate_key"),
    }
    if row.get("is_incremental"):
        metadata["incremental_columns"] = (row.get("incr_date_column_1"), row.get("incr_date_column_2"))
        if run_log is not None and "max_validated_timestamp" in run_log.columns:
            earlier = run_log.where((F.col("dataset_id") == dataset_id) & ~F.col("dataset_run_id").eqNullSafe(F.lit(run_id)))
            metadata["last_validated"] = earlier.agg(F.max("max_validated_timestamp")).first()[0]
    name, kind = row["dataset_name"], str(row.get("dataset_type") or "TABLE").upper()
    if kind == "QUERY":
        return _bounded(datasets.query_dataset(spark, name, row["custom_sql"], tables, **metadata))
    if kind != "TABLE":
        raise ValueError(f"dataset {name!r} is of unknown type {kind!r}")
    table = row["table_name"]
    if tables and table in tables:
        return _bounded(Dataset(name=name, frame=tables[table], **metadata))
    path = ".".join(row[k] for k in ("schema_name", "table_name") if row.get(k))
    return _bounded(datasets.table_dataset(spark, name, path, **metadata))


def _bounded(dataset: Dataset) -> Dataset:
    """An incremental dataset up to its newest timestamp."""
    name = next((c for c in dataset.incremental_columns if c), None)
    if name is None:
        return dataset
    newest = dataset.frame.agg(F.max(dataset.column(name)[0])).first()[0]
    # Nothing new: the bound stays where the last run ended.
    return dataclasses.replace(dataset, validate_until=dataset.last_validated if newest is None else newest)


def execute_dataset(
    spark: SparkSession, config: DataFrame, rules: DataFrame, master: DataFrame, handlers: DataFrame, dataset_id: int,
    *, run_id: int, target: str, tables: Mapping[str, DataFrame] | None = None, run_log: DataFrame | None = None,
    options: Options | None = None,
) -> Execution:
    """Resolve, evaluate and keep one run of a dataset under the shared folder ``target``.

    Kept are results, failing rows, their keys, the run log with the exported
    failure pivot, and the audit trail.  Failing rows are evaluated once: keys
    and pivot read what was written.

    The newest timestamp of an incremental dataset is read before anything is
    evaluated; it bounds the increment and is what the next run continues from.
    Everything is written under the run's attempt, and the manifest names the
    attempt last.  So a run that fails half way leaves nothing that readers see,
    and a repeated run id replaces what the run left before.
    """
    dataset = configured_dataset(spark, config, dataset_id, tables, run_log, run_id)
    good, bad = suite.rules_from(suite.resolve_rules(rules, master, handlers, dataset_id))
    known = {dataset.name: dataset} | {n: Dataset(n, f) for n, f in (tables or {}).items() if n != dataset.name}
    run = suite.run_suite(dataset, good, run_id=run_id, datasets=known, options=options, unparsed=bad)
    folder, attempt = target.rstrip("/"), uuid.uuid4().hex
    out = Execution(run, folder, f"{folder}/{suite.failure_table_name(dataset.name)}", None, attempt)

    def keep(df: DataFrame, part: str) -> None:
        sinks.append(df.withColumn("attempt", F.lit(attempt)), f"{folder}/{PARTS[part]}", partition_by=("attempt",))

    keep(run.results, "results")
    failed = run.failed_rows()
    if failed is not None:
        sinks.append_failed_rows(failed.withColumn("attempt", F.lit(attempt)), out.failed_rows, partition_by=("attempt",))
        written = spark.read.schema(failed.schema.add("attempt", "string")).parquet(out.failed_rows)
        kept = written.where(F.col("attempt") == attempt).select(*failed.columns)
        if dataset.key_columns:
            keep(capture.failed_keys(kept, dataset), "failed_keys")
        headers = [h for h in pivot.rule_headers(run.results, rules, master) if h.check_level == "ROW"]
        table = pivot.failure_pivot(kept, headers, run_id=run_id, dataset_id=dataset_id, dataset_name=dataset.name)
        out.failure_file = sinks.export_failure_pivot(table, f"{folder}/attempt={attempt}", dataset.name, run_id)
    validated = F.lit(dataset.validate_until).cast("timestamp")
    keep(run.summary.withColumns({"failure_file": F.lit(out.failure_file).cast("string"), "max_validated_timestamp": validated}), "run_log")
    keep(run.audit, "audit")
    done = local_frame(spark, [(dataset_id, run_id, attempt, dt.datetime.now(dt.timezone.utc))], MANIFEST_SCHEMA)
    sinks.append(done.coalesce(1), f"{folder}/{MANIFEST}")
    return out
