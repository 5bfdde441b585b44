"""Expectations on distinct values: uniqueness, modes and value sets.

All of them read ``(key, n)``: the distinct keys of a column with their counts.
Lists of values are never gathered in one place; result rows quote a short
preview and the complete lists are DataFrames (``distinct_mismatches``,
``most_common_values``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.durable import kept
from plumbline.functions.local import local_frame
from plumbline.functions.rows import orderable
from plumbline.functions.text import exact_value, is_blank, is_filled, literal_text, member_of, number_kind
from plumbline.functions.verdict import fraction, ignored_rows, within_bounds
from plumbline.model import Dataset, Rule, RuleError, quoted
from plumbline.operators.aggregate_checks import bounds_of
from plumbline.operators.base import (
    WHOLE, Check, Context, GroupCheck, Judgement, Metrics, failed_row_limit, scalar_outcome,
)


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def unique(ctx: Context, rule: Rule) -> Check:
    """Every copy of a repeated value is unexpected."""
    col, dtype = ctx.dataset.column(rule.target)

    def aggregates(keys: list[Column], n: Column) -> dict[str, Column]:
        key = keys[0]
        filled, blank = is_filled(key, dtype), is_blank(key, dtype)
        return {
            "element": _sum(n),
            "missing": _sum(F.when(blank, n)),
            "distinct": F.count_if(filled),
            "unexpected": _sum(F.when(filled & (n > 1), n)),
        }

    def outcome(m: Metrics) -> dict[str, Column]:
        result = m.named("element", "unexpected", "missing")
        unique_percent = (1 - fraction(m["unexpected"], m["element"])) * 100
        result["observed"] = F.to_json(F.struct(
            unique_percent.alias("observed_uniqueness_percent"),
            m["distinct"].alias("unique_count"),
            m["element"].alias("element_count"),
            m["missing"].alias("missing_count"),
            m["unexpected"].alias("unexpected_count"),
        ))
        return result

    name = ctx.dataset.field(rule.target).name

    def failed_rows(df: DataFrame) -> DataFrame:
        filled = df.where(is_filled(col, dtype))
        counts = kept(filled.groupBy(col.alias("_key")).agg((F.count(F.lit(1)) > 1).alias("_repeats")))
        size = counts.agg(F.count(F.lit(1)).alias("all"), F.count_if("_repeats").alias("repeated")).first()
        # Most often nearly all values repeat or nearly none does; the fewer are
        # stored by themselves, so that their size is known and rows stay where they are.
        by_repeated = 2 * size["repeated"] <= size["all"]
        fewer = kept(counts.where(F.col("_repeats") == F.lit(by_repeated)).select("_key"))
        return filled.join(fewer, F.col(quoted(name)) == F.col("_key"), "left_semi" if by_repeated else "left_anti")

    return GroupCheck(
        keys=(col,), key_id=("column", name), aggregates=aggregates, outcome=outcome,
        judgement=Judgement(rule.mostly, by_success_rate=True, shows_nonmissing=True),
        failed_rows=failed_rows, error_value=F.trim(col.cast("string")),
        failed_row_limit=failed_row_limit(rule),
    )


def compound_unique(ctx: Context, rule: Rule) -> Check:
    """Of the rows with equal keys, all but one are unexpected; NULLs are equal."""
    names = [ctx.dataset.field(n).name for n in rule.items("column_list")]
    if len(names) < 2:
        raise RuleError("column_list needs at least two columns")
    policy = rule.kwargs.get("ignore_row_if")
    columns = [F.col(quoted(n)) for n in names]

    def aggregates(keys: list[Column], n: Column) -> dict[str, Column]:
        ignored = ignored_rows(policy, keys, "never")
        kept = F.lit(True) if ignored is None else ~ignored
        return {
            "element": _sum(F.when(kept, n)),
            "missing": _sum(F.when(~kept, n)),
            "unexpected": _sum(F.when(kept, n - 1)),
        }

    def failed_rows(df: DataFrame) -> DataFrame:
        ignored = ignored_rows(policy, columns, "never")
        return surplus_copies(df if ignored is None else df.where(~ignored), names,
                              ctx.dataset.key_columns)

    return GroupCheck(
        keys=tuple(columns), key_id=("columns", *names), aggregates=aggregates,
        outcome=lambda m: m.named("element", "unexpected", "missing"),
        judgement=Judgement(rule.mostly),
        failed_rows=failed_rows, failed_row_limit=failed_row_limit(rule), incremental=True,
    )


#: Keys are counted by so many hashes; a hash with more than this share of all rows is dealt over salts.
HASHES = 1 << 16
HOT_SHARE = 1e-4
SALTS = 64


class Repeated:
    """The rows dealt by key, no key's rows all in one task.

    Rows are counted by a hash of their key, before the shuffle.  The rows of a
    hot hash, one that holds a hot key, are dealt over salts from 0 on; all
    others have the salt -1, so that their key is in one place.
    """

    def __init__(self, df: DataFrame, names: list[str]):
        self.keys = [quoted(n) for n in names]
        hashed = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(HASHES))
        counts = kept(df.groupBy(hashed.alias("_hash")).agg(F.count(F.lit(1)).alias("_n")))
        total = counts.agg(F.sum("_n")).first()[0] or 0
        # Fewer than 1 / HOT_SHARE hashes.
        hot = counts.where(F.col("_n") > total * HOT_SHARE).select("_hash", F.lit(True).alias("_hot"))
        marked = df.withColumn("_hash", hashed).join(F.broadcast(hot), "_hash", "left").drop("_hash")
        salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(-1)).cast("int")
        self.rows = marked.withColumn("_salt", salt).drop("_hot").repartition(*[F.col(k) for k in self.keys], F.col("_salt"))


def surplus_copies(df: DataFrame, names: list[str], order_by: tuple[str, ...] = ()) -> DataFrame:
    """Rows beyond the first of each key, first by ``order_by`` and then all columns.

    Rows cross one shuffle and are numbered where they land.  A hot key has a
    first row for each of its salts; those are numbered once more.  Rows
    identical in every column are interchangeable.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    order = [orderable(n, fields[n]) for n in dict.fromkeys([*order_by, *fields])]
    dealt = Repeated(df, names)

    def place(*parts: str) -> Column:
        return F.row_number().over(Window.partitionBy(*dealt.keys, *parts).orderBy(*order))

    numbered = dealt.rows.withColumn("_place", place("_salt"))
    firsts = numbered.where((F.col("_salt") >= 0) & (F.col("_place") == 1)).withColumn("_place", place())
    surplus = numbered.unionByName(firsts).where(F.col("_place") > 1)
    return surplus.select(*[quoted(n) for n in fields])


def _count_check(ctx: Context, rule: Rule, value_of: object) -> Check:
    col, _ = ctx.dataset.column(rule.target)

    def aggregates(keys: list[Column], n: Column) -> dict[str, Column]:
        return {
            "element": _sum(n),
            "filled": _sum(F.when(keys[0].isNotNull(), n)),
            "distinct": F.count(keys[0]),
        }

    def outcome(m: Metrics) -> dict[str, Column]:
        value = value_of(m)
        return scalar_outcome(m["element"], value, within_bounds(value, *bounds_of(rule)),
                              m["element"] - m["filled"])

    return GroupCheck(
        keys=(col,), key_id=("column", ctx.dataset.field(rule.target).name),
        aggregates=aggregates, outcome=outcome, judgement=WHOLE, incremental=True,
    )


def share_unique(ctx: Context, rule: Rule) -> Check:
    return _count_check(ctx, rule, lambda m: fraction(m["distinct"], m["filled"]))


def distinct_count(ctx: Context, rule: Rule) -> Check:
    return _count_check(ctx, rule, lambda m: m["distinct"])


def _preview(keys: DataFrame, size: int) -> Column:
    """The first values in order, as JSON; bounded whatever the input."""
    return (
        keys.select(F.col("k0").alias("v")).orderBy("v").limit(size)
        .agg(F.to_json(F.array_sort(F.collect_list(F.col("v").cast("string")))))
        .scalar()
    )


def most_common_in_set(ctx: Context, rule: Rule) -> Check:
    """All values of the highest count are in the set, or any of them with ``ties_okay``.

    The verdict needs no list of modes: it follows from the highest count inside
    the set and the highest count outside it.
    """
    values = rule.items("value_set")
    col, dtype = ctx.dataset.column(rule.target)
    ties_okay = rule.flag("ties_okay")

    def aggregates(keys: list[Column], n: Column) -> dict[str, Column]:
        known = F.coalesce(member_of(keys[0], dtype, values), F.lit(False))
        present = keys[0].isNotNull()
        return {
            "element": _sum(n),
            "missing": _sum(F.when(~present, n)),
            "inside": F.coalesce(F.max(F.when(present & known, n)), F.lit(0)),
            "outside": F.coalesce(F.max(F.when(present & ~known, n)), F.lit(0)),
        }

    def outcome(m: Metrics) -> dict[str, Column]:
        some = m["inside"] > 0
        ok = some & ((m["inside"] >= m["outside"]) if ties_okay else (m["inside"] > m["outside"]))
        return {
            **scalar_outcome(m["element"], F.lit(None), ok, m["missing"]),
            "results": F.to_json(F.struct(
                F.greatest(m["inside"], m["outside"]).alias("most_common_count"))),
        }

    def preview(counts: DataFrame) -> Column:
        present = counts.where(F.col("k0").isNotNull())
        top = present.agg(F.max("n")).scalar()
        return _preview(present.where(F.col("n") == top), ctx.options.preview_size)

    return GroupCheck(
        keys=(col,), key_id=("column", ctx.dataset.field(rule.target).name),
        aggregates=aggregates, outcome=outcome, judgement=WHOLE, preview=preview,
        incremental=True,
    )


def most_common_values(dataset: Dataset, column: str) -> DataFrame:
    """Every value that shares the highest count, however many there are."""
    col, _ = dataset.column(column)
    counts = dataset.frame.where(col.isNotNull()).groupBy(col.alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.where(F.col("n") == counts.agg(F.max("n")).scalar())


def _distinct_set(needs_missing: bool, needs_extra: bool):
    def build(ctx: Context, rule: Rule) -> Check:
        col, dtype = ctx.dataset.column(rule.target)
        held, impossible = _distinct_literals(rule.items("value_set"), dtype)
        values, kind = [*held, *impossible], _key_type(dtype)
        # Doubles show as numbers; exact kinds as text, which keeps every digit.
        shown = kind if kind in ("double", "string") else "string"

        def aggregates(keys: list[Column], n: Column) -> dict[str, Column]:
            known = member_of(keys[0], dtype, held)
            return {
                "element": _sum(F.when(keys[0].isNotNull(), n)),
                "observed": F.count(keys[0]),
                "matched": F.count_if(known),
                # At most one entry per value of the set.
                "found": F.collect_set(F.when(known, keys[0].cast(kind).cast(shown))),
            }

        def outcome(m: Metrics) -> dict[str, Column]:
            missing = F.lit(len(values)) - m["matched"]
            extra = m["observed"] - m["matched"]
            ok = F.lit(True)
            if needs_missing:
                ok = ok & (missing == 0)
            if needs_extra:
                ok = ok & (extra == 0)
            wanted = F.array(*[F.lit(v).cast(kind) for v in held]).cast(f"array<{shown}>")
            wanted = F.concat(wanted, F.array(*[F.lit(v) for v in impossible]).cast(f"array<{shown}>"))
            return {
                **scalar_outcome(m["element"], F.lit(None), ok),
                "details": F.to_json(F.struct(
                    F.array_sort(F.array_except(wanted, m["found"])).alias("missing"),
                    missing.alias("missing_count"),
                    extra.alias("extra_count"),
                    m["observed"].alias("observed_count"),
                )),
            }

        return GroupCheck(
            keys=(col,), key_id=("column", ctx.dataset.field(rule.target).name),
            aggregates=aggregates, outcome=outcome, judgement=WHOLE,
            preview=lambda counts: _preview(
                counts.where(F.col("k0").isNotNull()), ctx.options.preview_size
            ),
        )

    return build


def _distinct_literals(values: list[object], dtype: T.DataType) -> tuple[list[object], list[object]]:
    """Set values without repeats: those the column can hold, in its own kind, and the others."""
    present = [v for v in values if v is not None]
    if isinstance(dtype, T.NumericType):
        try:
            held = [(exact_value(v, dtype), float(str(v))) for v in present]
        except ValueError:
            raise RuleError(f"value_set of a numeric column holds text: {values!r}") from None
        return (
            list(dict.fromkeys(own for own, _ in held if own is not None)),
            list(dict.fromkeys(plain for own, plain in held if own is None)),
        )
    return list(dict.fromkeys(literal_text(v) for v in present)), []


def _key_type(dtype: T.DataType) -> str:
    return number_kind(dtype) if isinstance(dtype, T.NumericType) else "string"


distinct_contains_set = _distinct_set(needs_missing=True, needs_extra=False)
distinct_equals_set = _distinct_set(needs_missing=True, needs_extra=True)
distinct_in_set = _distinct_set(needs_missing=False, needs_extra=True)


def distinct_mismatches(dataset: Dataset, column: str, values: list[object]) -> DataFrame:
    """Observed values with their counts against an expected set, complete.

    ``side`` is ``match``, ``extra`` (observed only) or ``missing`` (expected
    only, with count 0).
    """
    col, dtype = dataset.column(column)
    kind = _key_type(dtype)
    observed = dataset.frame.where(col.isNotNull()).groupBy(col.cast(kind).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    held, impossible = _distinct_literals(values, dtype)
    spark = dataset.frame.sparkSession
    expected = local_frame(spark, [(v,) for v in held], f"wanted {kind}")
    joined = observed.join(expected, F.col("value") == F.col("wanted"), "full_outer")
    never = local_frame(spark, [(str(v), 0, "missing") for v in impossible], "value string, n bigint, side string")
    return joined.select(
        F.coalesce("value", "wanted").cast("string").alias("value"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("value").isNull(), "missing")
        .when(F.col("wanted").isNull(), "extra").otherwise("match").alias("side"),
    ).union(never)
