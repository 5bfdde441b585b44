"""Expectations that classify rows one by one."""

from __future__ import annotations

import math
from decimal import ROUND_FLOOR, Decimal, localcontext
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, functions as F, types as T

from plumbline.functions.numerals import plain_number
from plumbline.functions.text import (
    compared, exact_kind, exact_number, exact_value, full_match, is_blank, is_filled, is_text, literal_text, member_of, number_kind, whole,
)
from plumbline.functions.verdict import count_where, fraction, ignored_rows
from plumbline.model import Rule, RuleError
from plumbline.operators.base import (
    Check, Context, GroupCheck, Judgement, Metrics, comparable, failed_row_limit, numeric, row_check,
)


def not_null(ctx: Context, rule: Rule) -> Check:
    col, dtype = ctx.dataset.column(rule.target)
    return row_check(rule, is_blank(col, dtype), incremental=True)


def null_only(ctx: Context, rule: Rule) -> Check:
    col, dtype = ctx.dataset.column(rule.target)
    return row_check(rule, is_filled(col, dtype), incremental=True)


def between(ctx: Context, rule: Rule) -> Check:
    low, high = rule.number("min_value"), rule.number("max_value")
    if low is None or high is None:
        raise RuleError("min_value and max_value are both required")
    raw, dtype = ctx.dataset.column(rule.target)
    value = numeric(ctx, rule.target)
    # Not as doubles, which tell no two neighbours apart beyond 2**53.
    held = raw if exact_kind(dtype) else value
    below = compared(held, dtype, "<=" if rule.flag("strict_min") else "<", rule.kwargs["min_value"])
    above = compared(held, dtype, ">=" if rule.flag("strict_max") else ">", rule.kwargs["max_value"])
    unexpected = value.isNotNull() & is_filled(raw, dtype) & (below | above)
    return row_check(rule, unexpected, missing=is_blank(raw, dtype), error_value=value)


# A comment or a quotation that the pattern leaves open must not reach the brackets round it.
_CLOSINGS = ("", "\n", "\\E")


def _checked_pattern(ctx: Context, pattern: object) -> str:
    """The pattern, once it is known to compile alone, so closed that it can stand in brackets."""
    text = str(pattern)
    java = ctx.dataset.frame.sparkSession._jvm.java.util.regex.Pattern

    def compiles(regex: str) -> bool:
        try:
            java.compile(regex)
        except (Py4JError, PySparkException):
            return False
        return True

    if compiles(text):
        for closing in _CLOSINGS:
            if compiles(whole(text + closing)):
                return text + closing
    raise RuleError(f"invalid regular expression: {text!r}")


def match_regex(ctx: Context, rule: Rule) -> Check:
    pattern = _checked_pattern(ctx, rule.required("regex"))
    col, dtype = ctx.dataset.column(rule.target)
    blank = is_blank(col, dtype)
    unexpected = blank | ~full_match(F.trim(col.cast("string")), pattern)
    return row_check(rule, unexpected, missing=blank, error_value=F.trim(col.cast("string")),
                     incremental=True)


def not_match_regex(ctx: Context, rule: Rule) -> Check:
    pattern = _checked_pattern(ctx, rule.required("regex"))
    col, dtype = ctx.dataset.column(rule.target)
    unexpected = is_filled(col, dtype) & full_match(F.trim(col.cast("string")), pattern)
    return row_check(rule, unexpected, missing=is_blank(col, dtype),
                     error_value=F.trim(col.cast("string")), incremental=True)


def _matches_list(ctx: Context, rule: Rule) -> tuple[Column, Column]:
    patterns = [_checked_pattern(ctx, p) for p in rule.items("regex_list")]
    if not patterns:
        raise RuleError("regex_list is empty")
    mode = str(rule.kwargs.get("match_on") or "any").lower()
    if mode not in ("any", "all"):
        raise RuleError(f"match_on must be 'any' or 'all', not {mode!r}")
    col, _ = ctx.dataset.column(rule.target)
    tests = [full_match(col, p) for p in patterns]
    joined = reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), tests)
    return col, joined


def match_regex_list(ctx: Context, rule: Rule) -> Check:
    col, matched = _matches_list(ctx, rule)
    return row_check(rule, col.isNotNull() & ~matched, missing=col.isNull(),
                     nonmissing=False, incremental=True)


def not_match_regex_list(ctx: Context, rule: Rule) -> Check:
    col, matched = _matches_list(ctx, rule)
    return row_check(rule, col.isNotNull() & matched, missing=col.isNull(),
                     nonmissing=False, incremental=True)


def in_set(ctx: Context, rule: Rule) -> Check:
    """Value in set, with the count of every matched value.

    Small sets count each value inside the shared scan.  Larger ones group by
    the matched value, which has at most as many groups as the set has values.
    Both give the same result.
    """
    values = rule.items("value_set")
    col, dtype = ctx.dataset.column(rule.target)
    filled, blank = is_filled(col, dtype), is_blank(col, dtype)
    matched = filled & member_of(col, dtype, values)
    unexpected = filled & ~member_of(col, dtype, values)
    present = [v for v in values if v is not None]
    if isinstance(dtype, T.NumericType):
        # One entry for all spellings of a number, shown as the set spells it first.
        spelled: dict[object, str] = {}
        for x in present:
            if (own := exact_value(x, dtype)) is not None:
                spelled.setdefault(own, literal_text(x).strip(" "))
        distinct = list(spelled)
        keys_of = [F.lit(v) for v in spelled.values()]
    else:
        distinct = list(dict.fromkeys(literal_text(v) for v in present))
        keys_of = [F.lit(v.strip(" ")) for v in distinct]

    def kpis(m: Metrics, found: Column, counts: Column) -> dict[str, Column]:
        present = m["element"] - m["missing"]
        return {
            "observed": F.to_json(counts),
            "results": F.to_json(F.struct(
                m["element"].alias("element_count"),
                m["unexpected"].alias("unexpected_count"),
                (fraction(m["unexpected"], m["element"]) * 100).alias("unexpected_percent"),
                m["missing"].alias("missing_count"),
                present.alias("non_null_count"),
                (present - m["unexpected"]).alias("match_count"),
                found.alias("distinct_match_count"),
                F.lit(len(values)).alias("total_reference_values"),
            )),
        }

    if len(distinct) <= 32:
        extra = {
            f"value_{i}": count_where(filled & member_of(col, dtype, [v]))
            for i, v in enumerate(distinct)
        }

        def more(m: Metrics) -> dict[str, Column]:
            pairs = [
                F.when(m[f"value_{i}"] > 0,
                       F.struct(key.alias("key"), m[f"value_{i}"].alias("value")))
                for i, key in enumerate(keys_of)
            ]
            seen = F.array_compact(F.array(*pairs)) if pairs else F.array()
            counts = _summed_map(seen) if pairs else F.create_map()
            return kpis(m, F.size(seen), counts)

        return row_check(rule, unexpected, missing=blank, extra=extra, more=more,
                         error_value=F.trim(col.cast("string")), incremental=True)

    def shown(key: Column) -> Column:
        """The value as the set spells it."""
        if not isinstance(dtype, T.NumericType):
            return F.trim(key)
        pairs = [c for v, k in zip(distinct, keys_of) for c in (F.lit(v).cast(dtype).cast("string"), k)]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)

    kind = F.when(blank, F.lit("missing")).when(matched, F.lit("match")).otherwise(F.lit("other"))
    keys = (kind, F.when(matched, col.cast("string")))

    def aggregates(k: list[Column], n: Column) -> dict[str, Column]:
        return {
            "element": F.coalesce(F.sum(n), F.lit(0)),
            "missing": F.coalesce(F.sum(F.when(k[0] == "missing", n)), F.lit(0)),
            "unexpected": F.coalesce(F.sum(F.when(k[0] == "other", n)), F.lit(0)),
            # At most one entry per value of the set.
            "seen": F.collect_list(
                F.when(k[0] == "match",
                       F.struct(k[1].alias("key"), n.alias("value")))
            ),
        }

    def outcome(m: Metrics) -> dict[str, Column]:
        counts = m.named("element", "unexpected", "missing")
        seen = F.transform(m["seen"], lambda e: F.struct(shown(e["key"]).alias("key"), e["value"].alias("value")))
        return {**counts, **kpis(m, F.size(seen), _summed_map(seen))}

    return GroupCheck(
        keys=keys, key_id=("in_set", rule.rule_id), aggregates=aggregates, outcome=outcome,
        judgement=Judgement(rule.mostly, shows_nonmissing=True),
        failed_rows=lambda df: df.where(unexpected),
        error_value=F.trim(col.cast("string")),
        failed_row_limit=failed_row_limit(rule), incremental=True,
    )


def _summed_map(entries: Column) -> Column:
    """Entries to a map in key order, adding up counts whose trimmed keys coincide."""
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    return F.map_from_arrays(
        keys,
        F.transform(
            keys,
            lambda k: F.aggregate(
                F.filter(entries, lambda e: e["key"] == k),
                F.lit(0).cast("bigint"), lambda acc, e: acc + e["value"],
            ),
        ),
    )


def not_in_set(ctx: Context, rule: Rule) -> Check:
    col, dtype = ctx.dataset.column(rule.target)
    unexpected = col.isNotNull() & member_of(col, dtype, rule.items("value_set"))
    return row_check(rule, unexpected, missing=col.isNull(), nonmissing=False, incremental=True)


def length_between(ctx: Context, rule: Rule) -> Check:
    col, _ = ctx.dataset.column(rule.target)
    low, high = rule.number("min_value"), rule.number("max_value")
    length = F.length(col.cast("string"))
    bounds = ([] if low is None else [length < low]) + ([] if high is None else [length > high])
    unexpected = reduce(lambda a, b: a | b, bounds, F.lit(False))
    return row_check(rule, unexpected, by_success_rate=True, incremental=True)


def length_equal(ctx: Context, rule: Rule) -> Check:
    expected = int(rule.required("value"))
    col, _ = ctx.dataset.column(rule.target)
    unexpected = col.isNotNull() & (F.length(col.cast("string")) != expected)
    return row_check(rule, unexpected, missing=col.isNull(), incremental=True)


# Names a rule may use for a type, by family.
TYPE_NAMES = {
    "integer": ("NUMBER", "NUMERIC", "DECIMAL", "INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT"),
    "fraction": ("FLOAT", "DOUBLE", "REAL"),
    "text": ("VARCHAR", "STRING", "TEXT", "CHAR"),
    "date": ("DATE",),
    "timestamp": ("TIMESTAMP", "TIMESTAMP_NTZ", "TIMESTAMP_LTZ", "TIMESTAMP_TZ", "DATETIME", "TIME"),
    "boolean": ("BOOLEAN",),
}
# Texts read as a boolean.
BOOLEAN_TEXTS = ("true", "t", "yes", "y", "on", "1", "false", "f", "no", "n", "off", "0")


def _family_of_name(name: str) -> str:
    base = name.upper().split("(")[0].strip()
    for family, names in TYPE_NAMES.items():
        if base in names:
            return family
    raise RuleError(f"unknown type {name!r}")


def _family_of_type(dtype: T.DataType) -> str:
    if is_text(dtype):
        return "text"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.DecimalType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "fraction"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    raise RuleError(f"type {dtype.simpleString()} cannot be checked")


def _converted(col: Column, dtype: T.DataType, family: str) -> Column:
    """The value in the target family, NULL where it does not convert."""
    if family == "integer":
        # Fractional text is a valid number: it rounds.
        return col.try_cast("decimal(38,10)")
    if family == "fraction":
        return plain_number(col.cast("string")) if is_text(dtype) else col.try_cast("double")
    if family == "boolean":
        return F.when(F.lower(F.trim(col.cast("string"))).isin(*BOOLEAN_TEXTS), F.lit(True))
    return col.try_cast("date" if family == "date" else "timestamp_ntz")


def of_type(ctx: Context, rule: Rule) -> Check:
    wanted = _family_of_name(str(rule.required("type_")))
    col, dtype = ctx.dataset.column(rule.target)
    actual = _family_of_type(dtype)
    numbers, times = {"integer", "fraction"}, {"date", "timestamp"}
    blank = is_blank(col, dtype)
    if actual == wanted or wanted == "text":
        unexpected = F.lit(False)
    elif (
        (actual in numbers and wanted in times | {"boolean"})
        or (actual in times and wanted in numbers | {"boolean"})
        or (actual == "boolean" and wanted in numbers | times)
    ):
        return row_check(rule, F.lit(True), nonmissing=False)
    else:
        unexpected = is_filled(col, dtype) & _converted(col, dtype, wanted).isNull()
    return row_check(rule, unexpected, missing=blank, error_value=F.trim(col.cast("string")))


def z_score_below(ctx: Context, rule: Rule) -> Check:
    """Distance from the mean in standard deviations.

    Mean and deviation come from the whole table, as a scalar subquery Spark
    runs before the shared scan; the increment only decides which rows count.
    """
    threshold = float(rule.required("threshold"))
    value = numeric(ctx, rule.target)
    raw, _ = ctx.dataset.column(rule.target)
    stats = (
        ctx.source(False).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"))
        .select(F.struct("mean", "stddev"))
        .scalar()
    )
    name = ctx.dataset.field(rule.target).name
    stats = ctx.derive(f"_stats_of_{name}", stats)
    mean, stddev = stats["mean"], stats["stddev"]
    z = ctx.derive(f"_z_of_{name}", F.try_divide(value - mean, F.nullif(stddev, F.lit(0.0))))
    passes = (F.abs(z) < threshold) if rule.flag("double_sided") else (z < threshold)
    constant = F.coalesce(stddev == 0, F.lit(True))
    evaluated = raw.isNotNull()
    unexpected = evaluated & ~constant & ~passes
    return row_check(
        rule, unexpected,
        evaluated=evaluated,
        missing=evaluated & ~constant & z.isNull(),
        nonmissing=False,
        extra={"mean": F.max(mean), "stddev": F.max(stddev)},
        more=lambda m: {
            "observed": F.to_json(F.struct(m["mean"].alias("mean"), m["stddev"].alias("stddev")))
        },
        incremental=True,
    )


def pair_greater(ctx: Context, rule: Rule) -> Check:
    a, b = rule.required("column_A"), rule.required("column_B")
    raw_a, raw_b = ctx.dataset.column(a)[0], ctx.dataset.column(b)[0]
    left, right = comparable(ctx, a), comparable(ctx, b)
    holds = (left >= right) if rule.flag("or_equal") else (left > right)
    ignored = ignored_rows(rule.kwargs.get("ignore_row_if"), [raw_a, raw_b], "neither")
    either_null = raw_a.isNull() | raw_b.isNull()
    unexpected = raw_a.isNotNull() & raw_b.isNotNull() & ~holds
    missing = either_null
    if ignored is not None:
        unexpected, missing = unexpected & ~ignored, missing & ~ignored
    return row_check(rule, unexpected, evaluated=None if ignored is None else ~ignored,
                     missing=missing, of_nonmissing=True)


def pair_equal(ctx: Context, rule: Rule) -> Check:
    a = ctx.dataset.column(rule.required("column_A"))[0]
    b = ctx.dataset.column(rule.required("column_B"))[0]
    ignored = ignored_rows(rule.kwargs.get("ignore_row_if"), [a, b], "both_values_are_missing")
    unexpected = ~a.eqNullSafe(b)
    if ignored is not None:
        unexpected = unexpected & ~ignored
    return row_check(rule, unexpected, evaluated=None if ignored is None else ~ignored,
                     incremental=True)


def pair_in_set(ctx: Context, rule: Rule) -> Check:
    columns = rule.items("column_list") if rule.kwargs.get("column_list") else [None, None]
    name_a = rule.kwargs.get("column_A") or columns[0]
    name_b = rule.kwargs.get("column_B") or (columns[1] if len(columns) > 1 else None)
    (a, type_a), (b, type_b) = ctx.dataset.column(name_a), ctx.dataset.column(name_b)
    pairs = rule.items("value_pairs_set")
    if any(not isinstance(p, (list, tuple)) or len(p) != 2 for p in pairs):
        raise RuleError("value_pairs_set must hold pairs of values")
    literals = [(_comparable_literal(x, type_a), _comparable_literal(y, type_b)) for x, y in pairs]
    possible = [F.struct(x.alias("a"), y.alias("b")) for x, y in literals if x is not None and y is not None]
    # Structs compare field by field with NULL equal to NULL.
    known = F.struct(
        _comparable_value(a, type_a).alias("a"), _comparable_value(b, type_b).alias("b")
    ).isin(possible) if possible else F.lit(False)
    policy = str(rule.kwargs.get("ignore_row_if") or "both_values_are_missing").lower()
    if policy not in ("neither", "either_value_is_missing"):
        policy = "both_values_are_missing"
    ignored = ignored_rows(policy, [a, b], policy)
    unexpected = ~known
    if ignored is not None:
        unexpected = unexpected & ~ignored
    return row_check(rule, unexpected, evaluated=None if ignored is None else ~ignored,
                     missing=a.isNull() & b.isNull(), nonmissing=False, incremental=True)


def _comparable_value(col: Column, dtype: T.DataType) -> Column:
    return col.cast(number_kind(dtype) if isinstance(dtype, T.NumericType) else "string")


def _comparable_literal(value: object, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, T.NumericType):
        if value is None:
            return F.lit(None).cast(number_kind(dtype))
        # A value that the column cannot hold equals nothing in it.
        return exact_number(value, dtype)
    return F.lit(None if value is None else literal_text(value)).cast("string")


#: Digits behind the point that sums of decimals keep.
_SUM_SCALE = 28


def _gap_is_wide(columns: list[tuple[Column, T.DataType]], total: Decimal, tolerance: Decimal) -> Column:
    """Whether whole numbers and decimals add up to more or less than ``total``, exactly; NULL adds nothing.

    Whole parts and remainders are summed apart, so neither leaves 38 digits.
    """
    zero = F.lit(0).cast("decimal(38,0)")
    wholes, rests = [], []
    for col, dtype in columns:
        whole_part = col if isinstance(dtype, T.IntegralType) else F.when(col < 0, F.ceil(col)).otherwise(F.floor(col))
        wholes.append(F.coalesce(whole_part.cast("decimal(38,0)"), zero))
        if isinstance(dtype, T.DecimalType) and dtype.scale:
            rests.append(F.coalesce((col % 1).cast(f"decimal({_SUM_SCALE + 2},{_SUM_SCALE})"), F.lit(0)))
    with localcontext(prec=200):
        whole_total = total.to_integral_value(rounding=ROUND_FLOOR)
        rest = (whole_total - total).quantize(Decimal(1).scaleb(-_SUM_SCALE))
        if abs(whole_total) >= Decimal(10) ** 38:
            return F.lit(True)
    # A sum beyond 38 digits is NULL, and no total is near it.
    gap = F.try_subtract(reduce(F.try_add, wholes), F.lit(whole_total).cast("decimal(38,0)"))
    near = F.abs(gap) <= len(columns) + 1
    rest = reduce(lambda x, y: x + y, rests, F.lit(rest).cast(f"decimal({_SUM_SCALE + 2},{_SUM_SCALE})"))
    small = F.when(near, gap).cast("decimal(9,0)")
    return F.coalesce(F.when(near, F.abs(small + rest) > F.lit(tolerance)), F.lit(True))


def multicolumn_sum(ctx: Context, rule: Rule) -> Check:
    names = rule.items("column_list")
    total = float(rule.required("sum_total"))
    columns = [ctx.dataset.column(n) for n in names]
    raws = [c for c, _ in columns]
    ignored = ignored_rows(rule.kwargs.get("ignore_row_if"), raws, "neither")
    if all(exact_kind(dtype) for _, dtype in columns) and math.isfinite(total):
        unexpected = _gap_is_wide(columns, Decimal(str(rule.kwargs["sum_total"]).strip()), Decimal("0.0001"))
    else:
        values = [F.coalesce(numeric(ctx, n), F.lit(0.0)) for n in names]
        unexpected = F.abs(reduce(lambda x, y: x + y, values) - total) > 0.0001
    if ignored is not None:
        unexpected = unexpected & ~ignored
    return row_check(
        rule, unexpected,
        evaluated=None if ignored is None else ~ignored,
        missing=reduce(lambda x, y: x | y, [r.isNull() for r in raws]),
        nonmissing=False, by_success_rate=True,
    )


def unique_within_record(ctx: Context, rule: Rule) -> Check:
    names = rule.items("column_list")
    cols = [ctx.dataset.column(n)[0] for n in names]
    ignored = ignored_rows(rule.kwargs.get("ignore_row_if"), cols, "never")
    texts = F.array(*[c.cast("string") for c in cols])
    unexpected = F.size(F.array_distinct(texts)) < len(cols)
    if ignored is not None:
        unexpected = unexpected & ~ignored
    return row_check(
        rule, unexpected,
        evaluated=None if ignored is None else ~ignored,
        missing=F.lit(False) if ignored is None else ignored,
        missing_outside=True, incremental=True,
    )
