"""Expectations on the shape of a table, and user-written row queries."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.verdict import fraction
from plumbline.model import Rule, RuleError
from plumbline.operators.base import Check, Context, FrameCheck, Metrics, Outcome, SchemaCheck


def _whole(element: int, bad: int, percent: float, ok: bool, observed: object,
           details: object = None) -> SchemaCheck:
    return SchemaCheck({
        "is_success": ok,
        "element_count": element,
        "unexpected_count": bad,
        "unexpected_percent": percent,
        "unexpected_percent_total": percent,
        "observed_value": observed if isinstance(observed, str) else json.dumps(observed),
        "details": None if details is None else json.dumps(details, ensure_ascii=False),
    })


def column_count_between(ctx: Context, rule: Rule) -> Check:
    count = len(ctx.dataset.frame.columns)
    low, high = rule.number("min_value"), rule.number("max_value")
    ok = True
    if low is not None:
        ok = ok and (count > low if rule.flag("strict_min") else count >= low)
    if high is not None:
        ok = ok and (count < high if rule.flag("strict_max") else count <= high)
    return _whole(count, 0 if ok else 1, 0.0 if ok else 100.0, ok, count)


def column_count_equal(ctx: Context, rule: Rule) -> Check:
    count, expected = len(ctx.dataset.frame.columns), int(rule.required("value"))
    ok = count == expected
    return _whole(count, 0 if ok else 1, 0.0 if ok else 100.0, ok, count)


def column_exists(ctx: Context, rule: Rule) -> Check:
    """A column of that name, in any case, and at the zero-based index if one is given."""
    name = str(rule.target or rule.required("column"))
    wanted = rule.number("column_index")
    lowered = [c.lower() for c in ctx.dataset.frame.columns]
    found = lowered.index(name.lower()) if name.lower() in lowered else None
    ok = found is not None and (wanted is None or found == int(wanted))
    return _whole(1, 0 if ok else 1, 0.0 if ok else 100.0, ok,
                  {"column": name, "found_index": found})


def columns_match_list(ctx: Context, rule: Rule) -> Check:
    """Names match position by position; a missing or surplus position is a mismatch."""
    expected = [str(c) for c in rule.items("column_list")]
    actual = ctx.dataset.frame.columns
    mismatches = []
    for i in range(max(len(expected), len(actual))):
        want = expected[i] if i < len(expected) else None
        have = actual[i] if i < len(actual) else None
        if want != have:
            mismatches.append({"Expected Column Position": i + 1, "Expected": want, "Found": have})
    percent = 100.0 * len(mismatches) / len(expected) if expected else 0.0
    return _whole(len(expected), len(mismatches), percent, not mismatches, actual, mismatches)


def columns_match_set(ctx: Context, rule: Rule) -> Check:
    """Names match as a set; names marked ``CS:`` keep their case, others ignore it."""
    wanted = [str(c).strip() for c in rule.items("column_set")]
    exact_case = [c[3:] for c in wanted if c.startswith("CS:")]
    any_case = [c.upper() for c in wanted if not c.startswith("CS:")]
    actual = [c.strip() for c in ctx.dataset.frame.columns]
    upper = {c.upper() for c in actual}
    missing = [c for c in dict.fromkeys(exact_case) if c not in set(actual)]
    missing += [c for c in dict.fromkeys(any_case) if c not in upper]
    known = {c.upper() for c in exact_case} | set(any_case)
    extra = sorted(c for c in upper if c not in known)
    ok = not missing and (not rule.flag("exact_match", True) or not extra)
    bad = len(missing) + len(extra)
    percent = 100.0 * bad / len(wanted) if wanted else 0.0
    return _whole(len(wanted), bad, percent, ok, actual, {"missing": missing, "unexpected": extra})


def _queried(ctx: Context, query: str) -> DataFrame:
    """The query's rows, with the datasets under their names and the session's own views untouched.

    The names are those of common table expressions, which hide any view, over
    views of names that nobody else has and that go once the query is resolved.
    """
    spark = ctx.dataset.frame.sparkSession
    views = {}
    try:
        for name, dataset in {**ctx.datasets, ctx.dataset.name: ctx.dataset}.items():
            if not name.isidentifier():
                raise RuleError(f"dataset {name!r} cannot be named in a query")
            views[name] = f"{name}_{uuid.uuid4().hex}"
            dataset.frame.createOrReplaceTempView(views[name])
        named = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        return spark.sql(f"WITH {named} SELECT * FROM (\n{query.strip().rstrip(';')}\n)")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def unexpected_rows(ctx: Context, rule: Rule) -> Check:
    """Every row the query returns is unexpected; datasets are visible by name."""
    failing = _queried(ctx, str(rule.required("unexpected_rows_query")))
    # The dataset counted against: the rule's own unless it names another.
    primary = str(rule.kwargs.get("source_dataset") or ctx.dataset.name)
    source = {**ctx.datasets, ctx.dataset.name: ctx.dataset}[primary].frame
    metrics = failing.agg(F.count(F.lit(1)).alias("unexpected")).withColumn(
        "element", source.agg(F.count(F.lit(1))).scalar()
    )

    def outcome(m: Metrics) -> Outcome:
        percent = fraction(m["unexpected"], m["element"]) * 100
        return {
            "element": m["element"],
            "missing": F.lit(0).cast("bigint"),
            "unexpected": m["unexpected"],
            "observed": F.to_json(F.struct(
                percent.alias("observed_unexpected_percent"),
                m["element"].alias("element_count"),
                m["unexpected"].alias("unexpected_count"))),
            "success": m["unexpected"] == 0,
        }

    return FrameCheck(metrics, outcome, failed=failing)
