"""Failing rows as a table with one pass/fail column per rule."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.model import quoted
from plumbline.operators.capture import AUDIT_COLUMNS

# Expectations whose header shows their bounds or type.
BOUNDED_EXPECTATIONS = (10, 18)
TYPED_EXPECTATION = 7


@dataclass(frozen=True)
class RuleHeader:
    rule_config_id: int
    header: str
    check_level: str = "ROW"
    # The rule asked for a limited number of failing rows: a row that was not captured may fail it too.
    capped: bool = False

    @property
    def otherwise(self) -> str:
        return "NOT CAPTURED" if self.capped else "PASS"


def rule_headers(
    results: DataFrame, rules: DataFrame, master: DataFrame, *, failed_only: bool = True,
    run_ids: Sequence[int] | None = None, dataset_id: int | None = None,
) -> list[RuleHeader]:
    """Column headers of the rules in a results table: configuration, hence driver-sized."""
    picked = results
    if failed_only:
        picked = picked.where(~F.col("is_success"))
    if run_ids is not None:
        picked = picked.where(F.col("dataset_run_id").isin(list(run_ids)))
    if dataset_id is not None:
        picked = picked.where(F.col("dataset_id") == dataset_id)
    rows = (
        picked.select("rule_config_id").distinct().alias("r")
        .join(rules.alias("c"), "rule_config_id")
        .join(F.broadcast(master.alias("m")), F.col("c.expectation_id") == F.col("m.expectation_id"))
        .select(
            "rule_config_id", F.col("c.expectation_id").alias("expectation_id"), F.col("c.kwargs").alias("kwargs"),
            F.coalesce(F.upper(F.replace("c.column_name", F.lit(" "), F.lit("_"))), F.lit("TABLE")).alias("column_name"),
            F.coalesce("m.check_type", F.lit("UNCATEGORIZED")).alias("category"),
            F.coalesce("m.dimension", F.lit("UNCATEGORIZED")).alias("dimension"),
            F.coalesce("m.check_level", F.lit("ROW")).alias("check_level"),
        ).orderBy("rule_config_id").collect()
    )
    return [
        RuleHeader(
            r["rule_config_id"],
            f"{r['column_name']}_{r['dimension']}_"
            f"{_category(r['category'], r['expectation_id'], r['kwargs'])}_{r['rule_config_id']}",
            r["check_level"],
            _capped(r["kwargs"]),
        )
        for r in rows
    ]


def _capped(kwargs: str | None) -> bool:
    try:
        args = json.loads(kwargs) if kwargs else None
        return isinstance(args, dict) and int(float(args.get("failed_row_count") or 0)) > 0
    except ValueError:
        return False


def _category(category: str, expectation_id: int | None, kwargs: str | None) -> str:
    try:
        args = json.loads(kwargs) if kwargs else None
    except json.JSONDecodeError:
        return category
    if not isinstance(args, dict):
        return category
    if expectation_id in BOUNDED_EXPECTATIONS:
        return f"{category}({args.get('min_value', 'MIN')}_{args.get('max_value', 'MAX')})"
    if expectation_id == TYPED_EXPECTATION:
        return f"{category}({args.get('type_', 'UNKNOWN')})"
    return category


def _source_columns(failed: DataFrame) -> list[str]:
    return [c for c in failed.columns if c not in AUDIT_COLUMNS]


def _broke(rule_id: int) -> Column:
    return F.max(F.when(F.col("rule_config_id") == rule_id, 1).otherwise(0))


def failure_pivot(
    failed: DataFrame, headers: Sequence[RuleHeader], *, run_id: int, dataset_id: int, dataset_name: str
) -> DataFrame:
    """One row per distinct failing source row of a run, PASS or FAIL per failed rule.

    Rules that capture a limited number of rows show NOT CAPTURED instead of PASS.
    """
    source = _source_columns(failed)
    flags = [
        F.when(_broke(h.rule_config_id) == 1, "FAIL").otherwise(h.otherwise).alias(h.header)
        for h in headers
    ]
    return (
        failed.where(F.col("dataset_run_id") == run_id)
        .groupBy(*[quoted(c) for c in source]).agg(F.lit(1).alias("_one"), *flags)
        .select(
            F.lit(run_id).cast("bigint").alias("dataset_run_id"),
            F.lit(dataset_id).cast("bigint").alias("dataset_id"),
            F.lit(dataset_name).alias("dataset_name"),
            F.current_timestamp().alias("export_timestamp"),
            *[F.col(quoted(h.header)) for h in headers],
            *[F.col(quoted(c)) for c in source],
        )
    )


def recent_run_ids(run_log: DataFrame, dataset_id: int, current: int, limit: int | None = None) -> list[int]:
    """Runs of a dataset, the newest ``limit`` if given, and the current one."""
    found = (
        run_log.where(F.col("dataset_id") == dataset_id).select("dataset_run_id").distinct()
        .orderBy(F.desc("dataset_run_id"))
    )
    rows = (found if limit is None else found.limit(limit)).collect()
    return sorted({r["dataset_run_id"] for r in rows} | {current})


def failure_history(
    failed: DataFrame, results: DataFrame, headers: Sequence[RuleHeader], *, dataset_id: int, dataset_name: str
) -> DataFrame:
    """The pivot over all runs, telling rules that did not run from rules that passed.

    Results are pivoted to one row per run before they meet the failing rows, so
    the join adds columns and never multiplies rows.
    """
    source = _source_columns(failed)
    ids = [h.rule_config_id for h in headers]
    verdicts = (
        results.where(F.col("rule_config_id").isin(ids)).groupBy("dataset_run_id").agg(
            F.max("run_timestamp").alias("dq_timestamp"),
            *[F.max(F.when(F.col("rule_config_id") == i, F.col("is_success"))).alias(f"ok_{i}") for i in ids],
        )
    )
    rows = failed.groupBy("dataset_run_id", *[quoted(c) for c in source]).agg(
        F.lit(1).alias("_one"), *[_broke(i).alias(f"bad_{i}") for i in ids]
    )
    # One row per run; nearly all failing rows may be of one run, so they stay where they are.
    joined = rows.join(F.broadcast(verdicts), "dataset_run_id", "left")
    return joined.select(
        "dataset_run_id", F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        F.lit(dataset_name).alias("dataset_name"), "dq_timestamp",
        *[_cell(h).alias(h.header) for h in headers],
        *[F.col(quoted(c)) for c in source],
    )


def _cell(h: RuleHeader) -> Column:
    ok, bad = F.col(f"ok_{h.rule_config_id}"), F.col(f"bad_{h.rule_config_id}") == 1
    if h.check_level != "ROW":
        return (
            F.when(ok.isNull(), "NOT CONFIGURED")
            .when(~ok, f"FAIL - {h.check_level} CHECK").otherwise("PASS")
        )
    return F.when(bad, "FAIL").when(ok.isNull(), "NOT CONFIGURED").when(ok, "PASS").otherwise(h.otherwise)
