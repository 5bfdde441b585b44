"""Expectations on one number computed from a column or a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from plumbline.functions.text import exact_kind
from plumbline.functions.verdict import fraction, within_bounds
from plumbline.model import Rule, RuleError
from plumbline.operators.base import (
    WHOLE, Check, Context, Metrics, ScanCheck, numeric, scalar_outcome,
)
from plumbline.operators.percentiles import exact_percentiles


def bounds_of(rule: Rule) -> tuple[float | None, float | None, bool, bool]:
    return (
        rule.number("min_value"), rule.number("max_value"),
        rule.flag("strict_min"), rule.flag("strict_max"),
    )


def _own_kind(dtype: T.DataType) -> T.DataType:
    return dtype


def _sum_kind(dtype: T.DataType) -> T.DataType:
    """The type of a sum that loses nothing: whole numbers add up as decimals."""
    if isinstance(dtype, T.IntegralType):
        return T.DecimalType(38, 0)
    return T.DecimalType(min(38, dtype.precision + 10), dtype.scale)


def _statistic(
    function: Callable[[Column], Column], exact: Callable[[T.DataType], T.DataType] | None = None
) -> Callable[[Context, Rule], Check]:
    """A check on a number; ``exact`` names the type it takes over whole numbers and decimals, else it is a double."""

    def build(ctx: Context, rule: Rule) -> Check:
        value = numeric(ctx, rule.target)
        raw, dtype = ctx.dataset.column(rule.target)
        kind: T.DataType = T.DoubleType()
        bounds: tuple = bounds_of(rule)
        if exact is not None and exact_kind(dtype):
            kind = exact(dtype)
            value = raw.cast(kind) if isinstance(dtype, T.IntegralType) else raw
            given = (rule.kwargs.get(n) for n in ("min_value", "max_value"))
            bounds = (*[None if b is None else g for b, g in zip(bounds, given)], *bounds[2:])
        # A sum of more than 38 digits is NULL as a decimal; its double is then as good as it gets.
        rough = {"rough": F.sum(raw.cast("double"))} if function is F.try_sum and exact_kind(dtype) else {}

        def outcome(m: Metrics) -> dict[str, Column]:
            ok, shown = within_bounds(m["value"], *bounds, dtype=kind), m["value"].cast("string")
            if rough:
                large = m["value"].isNull()
                ok = F.when(large, within_bounds(m["rough"], *bounds_of(rule))).otherwise(ok)
                shown = F.coalesce(shown, m["rough"].cast("string"))
            return scalar_outcome(m["element"], shown, ok, m["missing"])

        return ScanCheck(
            aggregates={
                "element": F.count(F.lit(1)),
                "missing": F.count_if(raw.isNull()),
                "value": function(value),
                **rough,
            },
            outcome=outcome,
            judgement=WHOLE,
        )

    return build


minimum = _statistic(F.min, _own_kind)
maximum = _statistic(F.max, _own_kind)
total = _statistic(F.try_sum, _sum_kind)
mean = _statistic(F.avg)
deviation = _statistic(F.stddev_samp)


def median(ctx: Context, rule: Rule) -> Check:
    """Exact interpolated median, narrowed down scan by scan when the rule is planned.

    No buffer ever holds the distinct values.  ``approximate`` asks for a sketch
    inside the shared scan instead.
    """
    if rule.flag("approximate"):
        return _statistic(lambda v: F.percentile_approx(v, 0.5, 10_000))(ctx, rule)
    value = numeric(ctx, rule.target)
    raw, _ = ctx.dataset.column(rule.target)
    # One row, none for a column without values.
    found = exact_percentiles(ctx.source(False), value, [0.5]).collect()
    middle = F.lit(found[0]["value"] if found else None).cast("double")
    ok = within_bounds(middle, *bounds_of(rule))
    return ScanCheck(
        aggregates={"element": F.count(F.lit(1)), "missing": F.count_if(raw.isNull())},
        outcome=lambda m: scalar_outcome(m["element"], middle, ok, m["missing"]),
        judgement=WHOLE,
    )


def share_non_null(ctx: Context, rule: Rule) -> Check:
    col, _ = ctx.dataset.column(rule.target)

    def outcome(m: Metrics) -> dict[str, Column]:
        nulls = m["element"] - m["filled"]
        share = fraction(m["filled"], m["element"])
        return {
            "element": m["element"],
            "observed": share.cast("string"),
            "unexpected": nulls,
            "success": within_bounds(share, *bounds_of(rule)),
        }

    return ScanCheck({"element": F.count(F.lit(1)), "filled": F.count(col)}, outcome)


# Units a freshness threshold may be given in.
FRESHNESS_UNITS = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")


def freshness(ctx: Context, rule: Rule) -> Check:
    """Newest timestamp is younger than the threshold; all rows fail otherwise."""
    col, dtype = ctx.dataset.column(rule.target)
    amount = int(rule.required("freshness_threshold_value"))
    unit = str(rule.required("freshness_threshold_unit")).upper()
    unit = unit[:-1] if unit.endswith("S") else unit
    if unit not in FRESHNESS_UNITS:
        raise RuleError(f"unknown freshness unit {unit!r}")
    if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise RuleError(f"column {rule.target!r} is not a date or timestamp")
    zone = str(rule.kwargs.get("timezone") or "UTC")
    # ``as_of`` is UTC; columns without a zone hold wall-clock time in ``zone``.
    now_utc = (
        F.lit(str(ctx.as_of)).cast("timestamp_ntz") if ctx.as_of is not None
        else F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
    )
    local_now = F.convert_timezone(F.lit("UTC"), F.lit(zone), now_utc)
    threshold = F.timestamp_add(unit, F.lit(-amount), local_now)
    if isinstance(dtype, T.TimestampType):
        newest = F.convert_timezone(
            F.current_timezone(), F.lit(zone), F.max(col).cast("timestamp_ntz")
        )
    else:
        newest = F.max(col).cast("timestamp_ntz")

    def outcome(m: Metrics) -> dict[str, Column]:
        fresh = F.coalesce(m["newest"] > threshold, F.lit(False))
        stale = F.when(fresh, F.lit(0).cast("bigint")).otherwise(m["element"])
        return {
            "element": m["element"],
            "observed": m["newest"].cast("string"),
            "unexpected": stale,
            "success": fresh,
        }

    return ScanCheck({"element": F.count(F.lit(1)), "newest": newest}, outcome)


def row_count_between(ctx: Context, rule: Rule) -> Check:
    return ScanCheck(
        {"element": F.count(F.lit(1))},
        lambda m: scalar_outcome(
            m["element"], m["element"], within_bounds(m["element"], *bounds_of(rule))
        ),
        WHOLE,
    )


def row_count_equal(ctx: Context, rule: Rule) -> Check:
    expected = int(rule.required("value"))
    return ScanCheck(
        {"element": F.count(F.lit(1))},
        lambda m: scalar_outcome(m["element"], m["element"], m["element"] == expected),
        WHOLE,
    )


def row_count_equals_other(ctx: Context, rule: Rule) -> Check:
    other_name = str(rule.required("other_dataset_name"))
    by_name = {name.lower(): dataset for name, dataset in ctx.datasets.items()}
    if other_name.lower() not in by_name:
        raise RuleError(f"dataset {other_name!r} not found")
    other = by_name[other_name.lower()].frame.agg(F.count(F.lit(1))).scalar()
    return ScanCheck(
        {"element": F.count(F.lit(1))},
        lambda m: {
            **scalar_outcome(m["element"], m["element"], m["element"] == other),
            "details": F.to_json(F.struct(F.lit(other_name).alias("other_dataset_name"),
                                          other.alias("other_row_count"))),
        },
        WHOLE,
    )
