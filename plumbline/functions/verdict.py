"""From counts to a verdict: percentages, tolerance, bounds and row-ignore policies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from plumbline.functions.text import compared


def fraction(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    )


def within_bounds(
    value: Column,
    low: object,
    high: object,
    strict_low: bool = False,
    strict_high: bool = False,
    dtype: T.DataType = T.DoubleType(),
) -> Column:
    """Value inside the bounds; False for NULL.  Values of an exact ``dtype`` are not compared as doubles."""
    ok = value.isNotNull()
    if low is not None:
        ok = ok & compared(value, dtype, ">" if strict_low else ">=", low)
    if high is not None:
        ok = ok & compared(value, dtype, "<" if strict_high else "<=", high)
    return F.coalesce(ok, F.lit(False))


def ignored_rows(policy: str | None, columns: Sequence[Column], default: str) -> Column | None:
    """Rows a multi-column check leaves out; None when it leaves out none."""
    name = str(policy or default).lower()
    nulls = [c.isNull() for c in columns]
    if name in ("any_value_is_missing", "either_value_is_missing"):
        return reduce(lambda a, b: a | b, nulls)
    if name in ("all_values_are_missing", "both_values_are_missing"):
        return reduce(lambda a, b: a & b, nulls)
    return None


def count_where(condition: Column | None) -> Column:
    """Rows that satisfy ``condition``; every row when there is none."""
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)
