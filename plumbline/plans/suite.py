"""Running the rules of a dataset: resolution, evaluation, summary and audit trail."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, functions as F, types as T

from plumbline.functions.local import local_frame
from plumbline.model import Dataset, Rule, RuleError, Status
from plumbline.operators import capture
from plumbline.operators.base import Context, Options
from plumbline.operators.registry import ALIASES, EXPECTATIONS
from plumbline.plans import fusion

# How failure tables are named.
FAILURE_TABLE_SUFFIX = "_DQ_FAILURE"
AUDIT_SCHEMA = (
    "dataset_run_id bigint, rule_config_id bigint, procedure_name string, step_name string, "
    "log_message string, start_timestamp timestamp, end_timestamp timestamp, status string, "
    "error_message string"
)


def context_for(
    dataset: Dataset,
    datasets: Mapping[str, Dataset] | None = None,
    as_of: dt.datetime | str | None = None,
    options: Options | None = None,
) -> Context:
    return Context(dataset, dict(datasets or {}), as_of, options or Options())


def evaluate(
    dataset: Dataset,
    rules: Sequence[Rule],
    *,
    run_id: int = 0,
    datasets: Mapping[str, Dataset] | None = None,
    as_of: dt.datetime | str | None = None,
    options: Options | None = None,
) -> DataFrame:
    """Result rows of the rules as a lazy DataFrame; nothing runs yet."""
    plan = fusion.plan_rules(context_for(dataset, datasets, as_of, options), rules, run_id)
    return fusion.result_frame(plan)


def resolve_rules(
    rules: DataFrame, master: DataFrame, handlers: DataFrame, dataset_id: int
) -> DataFrame:
    """Active rules of a dataset that have an active handler for their expectation."""
    return (
        rules.alias("r")
        .join(F.broadcast(master.alias("m")), F.col("r.expectation_id") == F.col("m.expectation_id"), "left")
        .join(
            F.broadcast(handlers.alias("h")),
            (F.upper("m.validation_name") == F.upper("h.expectation_type")) & F.col("h.is_active"),
            "left",
        )
        .where(
            (F.col("r.dataset_id") == dataset_id)
            & F.col("h.handler").isNotNull()
            & F.col("r.is_active")
            & (F.col("r.dq_engine").isNull() | (F.upper("r.dq_engine") == "SQL"))
        )
        .select(
            "r.rule_config_id",
            F.coalesce("r.column_name", F.lit("")).alias("column_name"),
            F.coalesce("r.expectation_id", F.lit(0)).alias("expectation_id"),
            "r.expectation_name", "r.kwargs", "r.dimension", "h.handler",
        )
    )


def with_parsed_kwargs(resolved: DataFrame) -> DataFrame:
    """Mark rules whose arguments are not a JSON object; they become errors, others go on."""
    parsed = F.try_parse_json("kwargs")
    bad = (
        F.col("kwargs").isNotNull() & (F.trim("kwargs") != "")
        & (parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"))
    )
    return resolved.withColumn("kwargs_ok", ~bad)


def rules_from(resolved: DataFrame) -> tuple[list[Rule], list[tuple[Rule, Exception]]]:
    """Rule objects from resolved rows, and the rules whose arguments do not parse.

    Rules are configuration: a list of them always fits the driver.
    """
    good: list[Rule] = []
    bad: list[tuple[Rule, Exception]] = []
    for row in resolved.orderBy("rule_config_id").collect():
        name = row["handler"] if _known(row["handler"]) else row["expectation_name"]
        base = dict(
            rule_id=row["rule_config_id"], expectation=name, column=row["column_name"] or None,
            dimension=row["dimension"], expectation_id=row["expectation_id"],
        )
        try:
            kwargs = json.loads(row["kwargs"]) if (row["kwargs"] or "").strip() else {}
            if not isinstance(kwargs, dict):
                raise RuleError("kwargs is not a JSON object")
            good.append(Rule(kwargs=kwargs, **base))
        except (json.JSONDecodeError, RuleError) as e:
            bad.append((Rule(**base), RuleError(f"JSON parsing failed: {e}")))
    return good, bad


def _known(name: str | None) -> bool:
    return bool(name) and ALIASES.get(name.lower(), name.lower()) in EXPECTATIONS


@dataclass
class SuiteRun:
    """Everything a run produced.  Results are materialised; rows and keys are lazy."""

    dataset: Dataset
    run_id: int
    plan: fusion.Plan
    results: DataFrame
    summary: DataFrame
    audit: DataFrame
    status: str
    started: dt.datetime
    failed_rule_ids: list[int] = field(default_factory=list)

    def failed_rows(self) -> DataFrame | None:
        return fusion.failed_rows(self.plan, self.failed_rule_ids) if self.failed_rule_ids else None

    def failed_keys(self) -> DataFrame | None:
        rows = self.failed_rows()
        return None if rows is None else capture.failed_keys(rows, self.dataset)

    def error_metrics(self) -> DataFrame:
        return capture.error_metrics(self.plan)


class AuditTrail:
    """Steps of a run, written once at the end."""

    def __init__(self, run_id: int, procedure: str):
        self.run_id, self.procedure = run_id, procedure
        self.rows: list[tuple] = []

    def log(self, step: str, message: str, start: dt.datetime, status: str,
            error: str | None = None, rule_id: int | None = None) -> None:
        end = dt.datetime.now(dt.timezone.utc)
        self.rows.append((self.run_id, rule_id, self.procedure, step, message, start, end, status, error))


def run_suite(
    dataset: Dataset,
    rules: Sequence[Rule],
    *,
    run_id: int,
    datasets: Mapping[str, Dataset] | None = None,
    as_of: dt.datetime | str | None = None,
    options: Options | None = None,
    unparsed: Sequence[tuple[Rule, Exception]] = (),
) -> SuiteRun:
    """Evaluate all rules once and return results, summary and audit trail.

    If the shared job fails, the rules run one by one to find the culprits, which
    become errors while the others keep their results.
    """
    spark = dataset.frame.sparkSession
    started = dt.datetime.now(dt.timezone.utc)
    trail = AuditTrail(run_id, "run_suite")
    trail.log("RULES_FETCHING", f"Captured {len(rules) + len(unparsed)} rules", started, "COMPLETED")
    for rule, error in unparsed:
        trail.log("KWARGS_PARSING", str(error), started, "FAILED", str(error), rule.rule_id)
    step = dt.datetime.now(dt.timezone.utc)
    plan = fusion.plan_rules(context_for(dataset, datasets, as_of, options), rules, run_id)
    plan.errors.extend(unparsed)
    try:
        frame = fusion.result_frame(plan)
        rows = frame.collect()
    except PySparkException:
        plan = fusion.isolate_errors(plan)
        frame = fusion.result_frame(plan)
        rows = frame.collect()
    schema = T.StructType([*frame.schema.fields, T.StructField("run_timestamp", T.TimestampType())])
    results = local_frame(spark, [_finished(r, dataset, started) for r in rows], schema)
    summary_row = summarise_counts([r["status"] for r in rows])
    for row in rows:
        trail.log("RULE", row["expectation_name"], step,
                  "FAILED" if row["status"] == Status.ERROR else "COMPLETED",
                  row["error_message"], row["rule_config_id"])
    trail.log("SQL_EXECUTION", f"{summary_row['successful']} succeeded, {summary_row['unsuccessful']} failed",
              step, summary_row["run_status"])
    summary = local_frame(
        spark, [(run_id, dataset.dataset_id, summary_row["evaluated"], summary_row["successful"],
          summary_row["unsuccessful"], summary_row["errors"], summary_row["run_status"],
          summary_row["success_percent"],
          (dt.datetime.now(dt.timezone.utc) - started).total_seconds(), started)],
        "dataset_run_id bigint, dataset_id bigint, evaluated_expectations bigint, "
        "successful_expectations bigint, unsuccessful_expectations bigint, "
        "error_expectations bigint, run_status string, success_percent double, "
        "run_time double, created_timestamp timestamp",
    )
    return SuiteRun(
        dataset, run_id, plan, results, summary,
        local_frame(spark, trail.rows, AUDIT_SCHEMA), summary_row["run_status"], started,
        [r["rule_config_id"] for r in rows if r["status"] == Status.FAILURE],
    )


def failure_table_name(dataset_name: str) -> str:
    clean = "".join(ch if ch.isalnum() and ch.isascii() else "_" for ch in dataset_name)
    return clean + FAILURE_TABLE_SUFFIX


def _finished(row: Row, dataset: Dataset, started: dt.datetime) -> tuple:
    """Result row with its time and, for a failure, the table its rows go to."""
    values = row.asDict()
    if values["status"] == Status.FAILURE:
        document = json.loads(values["results"]) if values["results"] else {}
        document["failed_records_table"] = failure_table_name(dataset.name)
        values["results"] = json.dumps(document, ensure_ascii=False)
    return (*values.values(), started)


def summarise_counts(statuses: Sequence[str]) -> dict[str, object]:
    good, bad, broken = (
        sum(s == kind for s in statuses) for kind in (Status.SUCCESS, Status.FAILURE, Status.ERROR)
    )
    return {
        "evaluated": len(statuses), "successful": good, "unsuccessful": bad, "errors": broken,
        "run_status": Status.ERROR if broken else Status.FAILURE if bad else Status.SUCCESS,
        "success_percent": 100.0 * good / len(statuses) if statuses else 0.0,
    }


def run_summary(results: DataFrame) -> DataFrame:
    """Counts, overall status and success rate per run, over a results table."""
    good, bad, broken = (
        F.count_if(F.col("status") == s) for s in (Status.SUCCESS, Status.FAILURE, Status.ERROR)
    )
    total = F.count(F.lit(1))
    return results.groupBy("dataset_run_id", "dataset_id").agg(
        total.alias("evaluated_expectations"),
        good.alias("successful_expectations"),
        bad.alias("unsuccessful_expectations"),
        broken.alias("error_expectations"),
        F.when(broken > 0, Status.ERROR).when(bad > 0, Status.FAILURE)
        .otherwise(Status.SUCCESS).alias("run_status"),
        (good * 100.0 / total).alias("success_percent"),
    )
