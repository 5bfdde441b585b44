"""How a rule becomes Spark expressions.

A check never runs anything by itself.  It states which aggregates it needs and
how its result row follows from them; the planner in ``plumbline.plans.fusion``
decides which checks share a scan or a shuffle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.numerals import numeral_value
from plumbline.functions.text import is_text
from plumbline.functions.verdict import count_where
from plumbline.model import Dataset, Rule, RuleError, quoted

class Metrics(dict):
    """Metric columns of one check by short name, or their names for SQL."""

    def __init__(self, names: Mapping[str, str]):
        super().__init__(names)

    def __getitem__(self, key: str) -> Column:
        return F.col(super().__getitem__(key))

    def named(self, *keys: str) -> dict[str, str]:
        return {k: super(Metrics, self).__getitem__(k) for k in keys if k in self}


# What a check says about its data, as columns or names of metric columns: ``element``, ``missing`` and ``unexpected``
# counts, a ``success`` that does not follow from them, and the texts
# ``observed``, ``details`` and ``results``.
Outcome = Mapping[str, Column | str]


@dataclass(frozen=True)
class Judgement:
    """How percentages and verdict follow from the counts."""

    mostly: float = 1.0
    # ``1 - bad >= mostly`` instead of ``bad <= 1 - mostly``.
    by_success_rate: bool = False
    # The verdict looks at the non-missing rows only.
    of_nonmissing: bool = False
    # Missing rows are not among the evaluated ones.
    missing_outside: bool = False
    shows_nonmissing: bool = False
    # Right or wrong as a whole: 0 or 100 percent.
    whole: bool = False


@dataclass(frozen=True)
class Options:
    """Choices that trade a shared scan against bounded memory."""

    # Aggregates in one scan.  Spark compiles an aggregation only up to
    # spark.sql.codegen.maxFields (100) buffer fields; a second scan of the
    # columns is far cheaper than interpreting every row.
    aggregates_per_scan: int = 80
    # Values quoted inside a result row.  Complete lists are DataFrames.
    preview_size: int = 20


@dataclass(frozen=True)
class Context:
    dataset: Dataset
    datasets: Mapping[str, Dataset] = field(default_factory=dict)
    as_of: dt.datetime | str | None = None
    options: Options = field(default_factory=Options)
    # Columns that several expressions use, computed once per row, in order.
    derived: dict[str, Column] = field(default_factory=dict)

    def source(self, incremental: bool) -> DataFrame:
        rows = self.dataset.increment() if incremental else self.dataset.frame
        for name, column in self.derived.items():
            rows = rows.withColumn(name, column)
        return rows

    def derive(self, name: str, column: Column) -> Column:
        self.derived.setdefault(name, column)
        return F.col(quoted(name))

    def parsed_number(self, name: str, col: Column) -> Column:
        """Text read as a number: parsed once per row, whatever uses it."""
        return self.derive(f"_number_of_{name}", numeral_value(col.cast("string")))


@dataclass(frozen=True)
class ScanCheck:
    """Aggregates over the rows of the dataset: shares one scan with its peers."""

    aggregates: Mapping[str, Column]
    outcome: Callable[[Metrics], Outcome]
    judgement: Judgement = Judgement()
    unexpected: Column | None = None
    error_value: Column | None = None
    failed_row_limit: int | None = None
    incremental: bool = False


@dataclass(frozen=True)
class GroupCheck:
    """Aggregates over ``(keys, n)``, the distinct keys of the dataset with their counts.

    Checks with the same ``key_id`` share one shuffle, and counting happens
    before it, so a key that holds a third of the rows costs one entry per task.
    """

    keys: tuple[Column, ...]
    key_id: tuple[object, ...]
    aggregates: Callable[[list[Column], Column], Mapping[str, Column]]
    outcome: Callable[[Metrics], Outcome]
    judgement: Judgement = Judgement()
    preview: Callable[[DataFrame], Column] | None = None
    failed_rows: Callable[[DataFrame], DataFrame] | None = None
    error_value: Column | None = None
    failed_row_limit: int | None = None
    incremental: bool = False


@dataclass(frozen=True)
class SchemaCheck:
    """Decided by the schema alone: no job at all."""

    outcome: Mapping[str, object]


@dataclass(frozen=True)
class FrameCheck:
    """A one-row frame of its own metrics, with its own frame of failing rows."""

    metrics: DataFrame
    outcome: Callable[[Metrics], Outcome]
    judgement: Judgement = Judgement()
    failed: DataFrame | None = None


Check = ScanCheck | GroupCheck | SchemaCheck | FrameCheck


def failed_row_limit(rule: Rule, default: int | None = None) -> int | None:
    value = rule.number("failed_row_count")
    limit = default if value is None else int(value)
    return limit if limit and limit > 0 else None


def numeric(ctx: Context, name: str | None) -> Column:
    """Column as a double; text columns are read as digits or numerals."""
    col, dtype = ctx.dataset.column(name)
    if is_text(dtype):
        return ctx.parsed_number(ctx.dataset.field(name).name, col)
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    raise RuleError(f"column {name!r} of type {dtype.simpleString()} is not numeric")


def comparable(ctx: Context, name: str | None) -> Column:
    """Column for order comparisons: text becomes numeric, other types stay."""
    col, dtype = ctx.dataset.column(name)
    return ctx.parsed_number(ctx.dataset.field(name).name, col) if is_text(dtype) else col


def row_check(
    rule: Rule,
    unexpected: Column,
    *,
    evaluated: Column | None = None,
    missing: Column | None = None,
    missing_outside: bool = False,
    nonmissing: bool = True,
    of_nonmissing: bool = False,
    by_success_rate: bool = False,
    extra: Mapping[str, Column] | None = None,
    more: Callable[[Metrics], Outcome] | None = None,
    error_value: Column | None = None,
    default_limit: int | None = None,
    incremental: bool = False,
) -> ScanCheck:
    """A check that classifies each row on its own.

    ``evaluated`` selects the rows of ``element_count`` (all when None).  With
    ``missing_outside`` the missing rows are not among the evaluated ones and
    percentages are taken over both together.
    """
    aggregates = {
        "element": count_where(evaluated),
        "unexpected": count_where(unexpected),
        **({} if missing is None else {"missing": count_where(missing)}),
        **(extra or {}),
    }

    def outcome(m: Metrics) -> Outcome:
        counts = m.named("element", "unexpected", "missing")
        return {**counts, **(more(m) if more else {})}

    return ScanCheck(
        aggregates=aggregates,
        outcome=outcome,
        judgement=Judgement(
            rule.mostly, by_success_rate, of_nonmissing, missing_outside,
            nonmissing and missing is not None,
        ),
        unexpected=unexpected,
        error_value=error_value,
        failed_row_limit=failed_row_limit(rule, default_limit),
        incremental=incremental,
    )


def scalar_outcome(
    element: Column, value: Column, success: Column, missing: Column | None = None
) -> dict[str, Column]:
    """Result of a check on one number: wrong as a whole or right as a whole."""
    result = {
        "element": element,
        "observed": value.cast("string"),
        "unexpected": F.when(success, F.lit(0)).otherwise(F.lit(1)).cast("bigint"),
        "success": success,
    }
    if missing is not None:
        result["missing"] = missing
    return result


WHOLE = Judgement(whole=True)
