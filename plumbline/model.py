"""Datasets, rules and the one-row-per-rule result contract."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from plumbline.functions.local import local_frame
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


class RuleError(ValueError):
    """A rule that cannot be evaluated: missing argument, unknown column, bad pattern."""


class Status:
    SUCCESS = "SUCCESS"
    FAILURE = "FAILURE"
    ERROR = "ERROR"


@dataclass(frozen=True)
class Dataset:
    """A named DataFrame with the metadata the checks need.

    ``incremental_columns`` are candidates in order of preference; with a
    ``last_validated`` timestamp, checks that honour increments only see rows
    newer than it, and with ``validate_until`` none newer than that: what arrives
    while a run is on belongs to the next.
    """

    name: str
    frame: DataFrame
    dataset_id: int = 0
    primary_key: tuple[str, ...] = ()
    candidate_key: tuple[str, ...] = ()
    incremental_columns: tuple[str | None, ...] = ()
    last_validated: dt.datetime | str | None = None
    validate_until: dt.datetime | str | None = None

    @property
    def key_columns(self) -> tuple[str, ...]:
        return tuple(self.primary_key or self.candidate_key)

    def field(self, name: str | None) -> T.StructField:
        """Schema field by name: exact spelling first, then ignoring case."""
        if not name:
            raise RuleError("a column name is required")
        fields = self.frame.schema.fields
        for match in (lambda n: n == name, lambda n: n.lower() == name.lower()):
            found = [f for f in fields if match(f.name)]
            if len(found) == 1:
                return found[0]
            if found:
                raise RuleError(f"column {name!r} is ambiguous")
        raise RuleError(f"column {name!r} not found in dataset {self.name!r}")

    def column(self, name: str | None) -> tuple[Column, T.DataType]:
        f = self.field(name)
        return F.col(quoted(f.name)), f.dataType

    def increment(self) -> DataFrame:
        """Rows newer than the last validated timestamp and not newer than the upper bound; all rows when not incremental.

        A first run takes rows without a timestamp too.
        """
        name = next((c for c in self.incremental_columns if c), None)
        if name is None:
            return self.frame
        col, dtype = self.column(name)
        rows = self.frame
        if self.last_validated is not None:
            rows = rows.where(col > F.lit(self.last_validated).cast(dtype))
        if self.validate_until is not None:
            known = col <= F.lit(self.validate_until).cast(dtype)
            rows = rows.where(known | col.isNull() if self.last_validated is None else known)
        return rows

    def with_frame(self, frame: DataFrame) -> Dataset:
        return dataclasses.replace(self, frame=frame)


@dataclass(frozen=True)
class Rule:
    rule_id: int
    expectation: str
    column: str | None = None
    kwargs: Mapping[str, Any] = field(default_factory=dict)
    dimension: str | None = None
    expectation_id: int | None = None

    @property
    def target(self) -> str | None:
        return self.kwargs.get("column") or self.column

    def required(self, *names: str) -> Any:
        """First of the named arguments that is set."""
        for name in names:
            if self.kwargs.get(name) is not None:
                return self.kwargs[name]
        raise RuleError(f"missing argument: {' or '.join(names)}")

    def number(self, name: str) -> float | None:
        value = self.kwargs.get(name)
        if value is None or value == "":
            return None
        try:
            return float(value)
        except (TypeError, ValueError):
            raise RuleError(f"argument {name!r} is not a number: {value!r}") from None

    def flag(self, name: str, default: bool = False) -> bool:
        value = self.kwargs.get(name)
        if value is None:
            return default
        if isinstance(value, str):
            return value.strip().lower() in ("true", "t", "yes", "y", "1")
        return bool(value)

    def items(self, *names: str) -> list[Any]:
        """A list argument given as an array, as JSON text or as comma-separated text."""
        value = self.required(*names)
        if isinstance(value, str):
            text = value.strip()
            if text.startswith("["):
                for attempt in (text, text.replace("'", '"')):
                    try:
                        value = json.loads(attempt)
                        break
                    except json.JSONDecodeError:
                        continue
                else:
                    raise RuleError(f"argument {names[0]!r} is not a JSON array: {value!r}")
            else:
                value = [part.strip() for part in text.split(",") if part.strip()]
        if not isinstance(value, Sequence) or isinstance(value, (str, bytes)):
            raise RuleError(f"argument {names[0]!r} is not a list: {value!r}")
        return list(value)

    @property
    def mostly(self) -> float:
        value = self.number("mostly")
        return 1.0 if value is None else value


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# One row per evaluated rule.  Percentages run from 0 to 100.
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("dataset_run_id", T.LongType()),
        T.StructField("dataset_id", T.LongType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("rule_config_id", T.LongType()),
        T.StructField("expectation_id", T.LongType()),
        T.StructField("expectation_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("dimension", T.StringType()),
        T.StructField("kwargs", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("is_success", T.BooleanType()),
        T.StructField("element_count", T.LongType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("missing_percent", T.DoubleType()),
        T.StructField("unexpected_count", T.LongType()),
        T.StructField("unexpected_percent", T.DoubleType()),
        T.StructField("unexpected_percent_nonmissing", T.DoubleType()),
        T.StructField("unexpected_percent_total", T.DoubleType()),
        T.StructField("observed_value", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("results", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)

def rule_fields(rule: Rule, dataset: Dataset, run_id: int) -> dict[str, Any]:
    """The part of a result row known before any data is read."""
    return {
        "dataset_run_id": run_id,
        "dataset_id": dataset.dataset_id,
        "dataset_name": dataset.name,
        "rule_config_id": rule.rule_id,
        "expectation_id": rule.expectation_id,
        "expectation_name": rule.expectation,
        "column_name": rule.target,
        "dimension": rule.dimension,
        "kwargs": json.dumps(dict(rule.kwargs), ensure_ascii=False, default=str, sort_keys=True),
    }


def literal_results(
    spark: SparkSession, rows: Sequence[tuple[Rule, Dataset, int, Mapping[str, Any]]]
) -> DataFrame:
    """Result rows for rules that need no data: schema checks and errors."""
    records = []
    for rule, dataset, run_id, outcome in rows:
        record = {**rule_fields(rule, dataset, run_id), **outcome}
        if "status" not in record:
            record["status"] = Status.SUCCESS if record["is_success"] else Status.FAILURE
        records.append(tuple(record.get(f.name) for f in RESULT_SCHEMA.fields))
    return local_frame(spark, records, RESULT_SCHEMA)


def error_outcome(error: Exception) -> dict[str, Any]:
    return {
        "status": Status.ERROR,
        "is_success": False,
        "error_message": str(error).strip().splitlines()[0][:4000] if str(error) else repr(error),
    }
