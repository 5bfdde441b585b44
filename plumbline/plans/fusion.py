"""All rules of a dataset in as few scans as possible.

* Row and scalar checks are plain aggregates: one ``agg`` for all of them.
* Checks on distinct values share one ``groupBy(key).count()`` per key.
* Schema checks need no job.
* Failing rows of all row checks come out of one filtered pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.local import local_frame
from plumbline.model import (
    RESULT_SCHEMA, Dataset, Rule, RuleError, Status, error_outcome, literal_results, quoted,
    rule_fields,
)
from plumbline.functions.verdict import fraction
from plumbline.operators.base import (
    Check, Context, FrameCheck, GroupCheck, Metrics, ScanCheck, SchemaCheck,
)
from plumbline.operators.registry import build_check


@dataclass
class Plan:
    """Rules of one dataset with their checks, in rule order."""

    context: Context
    run_id: int
    checks: list[tuple[Rule, Check]] = field(default_factory=list)
    errors: list[tuple[Rule, Exception]] = field(default_factory=list)

    @property
    def dataset(self) -> Dataset:
        return self.context.dataset

    def of_kind(self, kind: type) -> list[tuple[Rule, Check]]:
        return [(r, c) for r, c in self.checks if isinstance(c, kind)]

    def without(self, rules: Iterable[tuple[Rule, Exception]]) -> Plan:
        """The same plan with some rules turned into errors."""
        rules = list(rules)
        gone = {r.rule_id for r, _ in rules}
        return Plan(
            self.context, self.run_id,
            [(r, c) for r, c in self.checks if r.rule_id not in gone],
            [*self.errors, *rules],
        )


def plan_rules(context: Context, rules: Sequence[Rule], run_id: int = 0) -> Plan:
    """Build every check; a rule that cannot be built becomes an error, not an exception."""
    plan = Plan(context, run_id)
    for rule in rules:
        try:
            plan.checks.append((rule, build_check(context, rule)))
        except (RuleError, PySparkException, TypeError, ValueError, KeyError) as e:
            plan.errors.append((rule, e))
    return plan


def result_frame(plan: Plan) -> DataFrame:
    """One result row per rule, as a lazy DataFrame.

    The data yields a few counts and texts per rule.  What is known beforehand
    about a rule comes from a local table with one row per rule, joined last;
    percentages and verdicts are computed once for all.
    """
    spark = plan.dataset.frame.sparkSession
    frames: list[DataFrame] = []
    for incremental in (False, True):
        scans = [(r, c) for r, c in plan.of_kind(ScanCheck) if c.incremental is incremental]
        frames += _split_incremental(plan, scans, incremental)
        groups = [(r, c) for r, c in plan.of_kind(GroupCheck) if c.incremental is incremental]
        frames += _grouped(plan, groups, incremental)
    for rule, check in plan.of_kind(FrameCheck):
        metrics = Metrics({c: c for c in check.metrics.columns})
        frames.append(_rows(check.metrics, [_raw(rule, check.outcome(metrics))]))
    results = []
    if frames:
        results.append(_judged(plan, reduce(lambda a, b: a.unionAll(b), frames)))
    literal = [
        (rule, plan.dataset, plan.run_id, check.outcome)
        for rule, check in plan.of_kind(SchemaCheck)
    ] + [(rule, plan.dataset, plan.run_id, error_outcome(e)) for rule, e in plan.errors]
    if literal or not results:
        results.append(literal_results(spark, literal))
    return reduce(lambda a, b: a.unionByName(b), results)


# Outcome of one rule as the data yields it.
RAW_FIELDS = {
    "element": "bigint", "missing": "bigint", "unexpected": "bigint", "success": "boolean",
    "observed": "string", "details": "string", "results": "string",
}
JUDGEMENT_SCHEMA = (
    "rule_config_id bigint, dataset_run_id bigint, dataset_id bigint, dataset_name string, "
    "expectation_id bigint, expectation_name string, column_name string, dimension string, "
    "kwargs string, mostly double, by_success_rate boolean, of_nonmissing boolean, "
    "missing_outside boolean, shows_nonmissing boolean, whole boolean"
)


def _raw(rule: Rule, outcome: Mapping[str, Column]) -> Column:
    def text(name: str, dtype: str) -> str:
        return outcome[name] if name in outcome else f"CAST(NULL AS {dtype})"

    head = f"{rule.rule_id}L AS rule_config_id"
    if all(isinstance(v, str) for v in outcome.values()):
        # SQL text is one call to the driver JVM instead of dozens.
        return F.expr(f"struct({', '.join([head, *[f'{text(n, t)} AS {n}' for n, t in RAW_FIELDS.items()]])})")
    return F.struct(F.expr(head), *[
        outcome[n].alias(n) if isinstance(outcome.get(n), Column) else F.expr(f"{text(n, t)} AS {n}")
        for n, t in RAW_FIELDS.items()
    ])


def _judged(plan: Plan, raw: DataFrame) -> DataFrame:
    known = []
    for rule, check in plan.checks:
        if not isinstance(check, SchemaCheck):
            fields, j = rule_fields(rule, plan.dataset, plan.run_id), check.judgement
            known.append((
                *[fields[n] for n in (
                    "rule_config_id", "dataset_run_id", "dataset_id", "dataset_name",
                    "expectation_id", "expectation_name", "column_name", "dimension", "kwargs",
                )],
                j.mostly, j.by_success_rate, j.of_nonmissing, j.missing_outside,
                j.shows_nonmissing, j.whole,
            ))
    table = local_frame(plan.dataset.frame.sparkSession, known, JUDGEMENT_SCHEMA)
    element, missing, unexpected = F.col("element"), F.col("missing"), F.col("unexpected")
    outside = F.col("missing_outside")
    population = element + F.when(outside, F.coalesce(missing, F.lit(0))).otherwise(F.lit(0))
    total = F.when(F.col("whole"), unexpected.cast("double")).otherwise(fraction(unexpected, population))
    present = F.when(outside, element).otherwise(element - missing)
    nonmissing = fraction(unexpected, present)
    bad = F.when(F.col("of_nonmissing"), nonmissing).otherwise(total)
    tolerated = F.when(F.col("by_success_rate"), (F.lit(1.0) - bad) >= F.col("mostly")).otherwise(
        bad <= (F.lit(1.0) - F.col("mostly"))
    )
    columns = {
        "is_success": F.coalesce("success", tolerated, F.lit(False)),
        "missing_percent": F.when(missing.isNotNull(), fraction(missing, population) * 100),
        "unexpected_percent": bad * 100,
        "unexpected_percent_nonmissing": F.when(F.col("shows_nonmissing"), nonmissing * 100),
        "unexpected_percent_total": total * 100,
    }
    # One row per rule on either side.
    judged = raw.join(F.broadcast(table), "rule_config_id").withColumns(columns)
    renamed = {
        "element_count": element, "missing_count": missing, "unexpected_count": unexpected,
        "observed_value": F.col("observed"), "error_message": F.lit(None).cast("string"),
        "status": F.when(F.col("is_success"), Status.SUCCESS).otherwise(Status.FAILURE),
    }
    return judged.select(*[
        renamed[f.name].alias(f.name) if f.name in renamed else F.col(f.name)
        for f in RESULT_SCHEMA.fields
    ])


def _is_incremental(plan: Plan) -> bool:
    d = plan.dataset
    return (d.last_validated is not None or d.validate_until is not None) and any(d.incremental_columns)


def _split_incremental(
    plan: Plan, scans: list[tuple[Rule, ScanCheck]], incremental: bool
) -> list[DataFrame]:
    # Without an increment both kinds read the same rows, hence one scan.
    if not _is_incremental(plan):
        if incremental:
            return []
        scans = plan.of_kind(ScanCheck)
    source = plan.context.source(incremental)
    return [_scan(plan, source, batch) for batch in _batches(plan, scans)]


def _batches(plan: Plan, scans: list[tuple[Rule, ScanCheck]]) -> list[list[tuple[Rule, ScanCheck]]]:
    batches: list[list[tuple[Rule, ScanCheck]]] = []
    size = 0
    for rule, check in scans:
        count = len(check.aggregates)
        if not batches or size + count > plan.context.options.aggregates_per_scan:
            batches.append([])
            size = 0
        batches[-1].append((rule, check))
        size += count
    return batches


def _rows(one_row: DataFrame, outcomes: list[Column]) -> DataFrame:
    """A one-row frame of metrics to one row per rule."""
    return one_row.select(F.inline(F.array(*outcomes)))


def _scan(plan: Plan, source: DataFrame, batch: list[tuple[Rule, ScanCheck]]) -> DataFrame:
    named, results = {}, []
    for i, (rule, check) in enumerate(batch):
        names = {k: f"m{i}_{k}" for k in check.aggregates}
        named.update({names[k]: column for k, column in check.aggregates.items()})
        results.append(_raw(rule, check.outcome(Metrics(names))))
    wide = source.agg(*[column.alias(name) for name, column in named.items()])
    return _rows(wide, results)


def _grouped(
    plan: Plan, groups: list[tuple[Rule, GroupCheck]], incremental: bool
) -> list[DataFrame]:
    by_key: dict[tuple[object, ...], list[tuple[Rule, GroupCheck]]] = {}
    if not _is_incremental(plan):
        if incremental:
            return []
        groups = plan.of_kind(GroupCheck)
    for rule, check in groups:
        by_key.setdefault(check.key_id, []).append((rule, check))
    frames = []
    for members in by_key.values():
        keys = members[0][1].keys
        names = [f"k{i}" for i in range(len(keys))]
        counts = plan.context.source(incremental).groupBy(
            *[k.alias(n) for k, n in zip(keys, names)]
        ).agg(F.count(F.lit(1)).alias("n"))
        named, results = {}, []
        for i, (rule, check) in enumerate(members):
            aggregates = check.aggregates([F.col(n) for n in names], F.col("n"))
            own = {k: f"m{i}_{k}" for k in aggregates}
            named.update({own[k]: column for k, column in aggregates.items()})
            outcome = dict(check.outcome(Metrics(own)))
            if check.preview is not None:
                outcome["observed"] = check.preview(counts)
            results.append(_raw(rule, outcome))
        wide = counts.agg(*[column.alias(name) for name, column in named.items()])
        frames.append(_rows(wide, results))
    return frames


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def isolate_errors(plan: Plan) -> Plan:
    """Find the rules whose own evaluation fails, and turn them into errors."""
    bad = []
    for rule, check in plan.checks:
        if isinstance(check, SchemaCheck):
            continue
        alone = Plan(plan.context, plan.run_id, [(rule, check)])
        try:
            result_frame(alone).collect()
        except PySparkException as e:
            bad.append((rule, e))
    return plan.without(bad)


def failed_rows(plan: Plan, rule_ids: Iterable[int] | None = None) -> DataFrame | None:
    """Source columns of every failing row, once per rule it fails.

    Row checks share one pass: each row is tagged with the rules it breaks and
    kept only if there are any.  A rule with a row limit gets its own pass, since
    the limit is its own too.
    """
    wanted = None if rule_ids is None else set(rule_ids)

    def chosen(kind: type):
        return [(r, c) for r, c in plan.of_kind(kind) if wanted is None or r.rule_id in wanted]

    columns = plan.dataset.frame.columns
    frames: list[DataFrame] = []
    incremental_run = _is_incremental(plan)
    for incremental in (False, True) if incremental_run else (None,):
        source = plan.context.source(bool(incremental))

        def applies(check) -> bool:
            return incremental is None or check.incremental is incremental

        scans = [(r, c) for r, c in chosen(ScanCheck) if c.unexpected is not None and applies(c)]
        shared = [(r, c) for r, c in scans if c.failed_row_limit is None]
        if shared:
            tags = F.array(*[
                F.when(c.unexpected, F.lit(r.rule_id).cast("bigint")) for r, c in shared
            ])
            # Rows that break no rule leave before anything is built for them.
            broken = source.where(any_of([c.unexpected for _, c in shared]))
            tagged = broken.select(F.explode(tags).alias("rule_config_id"),
                                   *[F.col(quoted(c)) for c in columns])
            frames.append(tagged.where(F.col("rule_config_id").isNotNull()))
        single = [
            (r, source.where(c.unexpected), c.failed_row_limit)
            for r, c in scans if c.failed_row_limit is not None
        ] + [
            (r, c.failed_rows(source), c.failed_row_limit)
            for r, c in chosen(GroupCheck) if c.failed_rows is not None and applies(c)
        ]
        for rule, frame, limit in single:
            frame = frame if limit is None else frame.limit(limit)
            frames.append(frame.select(F.lit(rule.rule_id).cast("bigint").alias("rule_config_id"),
                                       *[F.col(quoted(c)) for c in columns]))
    for rule, check in chosen(FrameCheck):
        if check.failed is not None:
            frames.append(check.failed.select(
                F.lit(rule.rule_id).cast("bigint").alias("rule_config_id"), "*"
            ))
    if not frames:
        return None
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union.select(
        F.lit(plan.run_id).cast("bigint").alias("dataset_run_id"),
        F.lit(plan.dataset.dataset_id).cast("bigint").alias("dataset_id"),
        F.col("rule_config_id"),
        F.current_timestamp().alias("load_timestamp"),
        *[F.col(quoted(c)) for c in union.columns if c != "rule_config_id"],
    )
