"""One query per expectation, with the counts and verdict the SQL must reproduce."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import Dataset, Rule, evaluate
from verification.fixtures import FIXTURES, frame, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-02-02 00:00:00"
COLUMNS = "expect_column_values_to_"


def dataset(spark: SparkSession, sf_dir: str, source: str) -> Dataset:
    return Dataset(source, frame(spark, sf_dir, source), dataset_id=1)


def check_query(source: str, rules: Sequence[Rule], *, observed: bool = False,
                others: Sequence[str] = ()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        results = evaluate(
            dataset(spark, sf_dir, source), rules, as_of=AS_OF,
            datasets={n: dataset(spark, sf_dir, n) for n in others},
        )
        columns = [
            "rule_config_id", "is_success", "element_count", "missing_count", "unexpected_count",
            F.round("unexpected_percent", 6).alias("unexpected_percent"),
        ]
        if observed:
            columns.append(F.round(F.col("observed_value").try_cast("double"), 4).alias("observed"))
        return results.select(*columns)

    return run


@dataclass(frozen=True)
class Counts:
    """Conditions that define a row check, in SQL."""

    rule: int
    unexpected: str
    element: str = "TRUE"
    missing: str | None = None
    mostly: float = 1.0
    by_success_rate: bool = False
    of_nonmissing: bool = False
    missing_outside: bool = False
    weight: str = "1"


def row_oracle(source: str, *checks: Counts, subquery: str | None = None) -> str:
    parts = []
    for c in checks:
        def total(condition: str) -> str:
            return f"coalesce(sum(CASE WHEN {condition} THEN {c.weight} END), 0)::BIGINT"

        missing = total(c.missing) if c.missing else "NULL::BIGINT"
        base = "(n + m)" if c.missing_outside else "(n - m)" if c.of_nonmissing else "n"
        rate = f"(CASE WHEN {base} = 0 THEN 0.0::DOUBLE ELSE u::DOUBLE / {base}::DOUBLE END)"
        ok = (f"(1.0::DOUBLE - {rate}) >= {c.mostly}::DOUBLE" if c.by_success_rate
              else f"{rate} <= (1.0::DOUBLE - {c.mostly}::DOUBLE)")
        parts.append(
            f"SELECT {c.rule}::BIGINT AS rule_config_id, {ok} AS is_success, n AS element_count, "
            f"m AS missing_count, u AS unexpected_count, round({rate} * 100, 6) AS unexpected_percent "
            f"FROM (SELECT {total(c.element)} AS n, {missing} AS m, {total(c.unexpected)} AS u "
            f"FROM {subquery or source})"
        )
    return _with_source(source, "\nUNION ALL\n".join(parts))


def _with_source(source: str, sql: str) -> str:
    return with_fixtures(sql, *([source] if source in FIXTURES else []))


@dataclass(frozen=True)
class Scalar:
    """A check on one number, in SQL."""

    rule: int
    value: str
    low: float | None = None
    high: float | None = None
    strict_low: bool = False
    strict_high: bool = False
    missing: str | None = None
    ok: str | None = None
    element: str = "count(*)"
    unexpected: str | None = None


def scalar_oracle(source: str, *checks: Scalar, observed: bool = True) -> str:
    parts = []
    for c in checks:
        tests = ["v IS NOT NULL"]
        if c.low is not None:
            tests.append(f"v {'>' if c.strict_low else '>='} {c.low}")
        if c.high is not None:
            tests.append(f"v {'<' if c.strict_high else '<='} {c.high}")
        ok = c.ok or " AND ".join(tests)
        missing = f"count(*) FILTER (WHERE {c.missing})" if c.missing else "NULL::BIGINT"
        bad = c.unexpected or "CASE WHEN ok THEN 0 ELSE 1 END"
        percent = (
            "CASE WHEN ok THEN 0.0 ELSE 100.0 END" if c.unexpected is None
            else f"CASE WHEN n = 0 THEN 0.0 ELSE ({bad})::DOUBLE / n * 100 END"
        )
        observed_sql = ", round(v::DOUBLE, 4) AS observed" if observed else ""
        parts.append(
            f"SELECT {c.rule}::BIGINT AS rule_config_id, ok AS is_success, n AS element_count, "
            f"m AS missing_count, ({bad})::BIGINT AS unexpected_count, "
            f"round(({percent})::DOUBLE, 6) AS unexpected_percent{observed_sql} FROM "
            f"(SELECT *, coalesce({ok}, FALSE) AS ok FROM "
            f"(SELECT ({c.element})::BIGINT AS n, {missing} AS m, {c.value} AS v FROM {source}))"
        )
    return _with_source(source, "\nUNION ALL\n".join(parts))


def schema_oracle(*rows: tuple[int, bool, int, int, float]) -> str:
    """Schema checks: the figures follow from the columns DuckDB sees."""
    return "\nUNION ALL\n".join(
        f"SELECT {r}::BIGINT AS rule_config_id, {ok} AS is_success, {n}::BIGINT AS element_count, "
        f"NULL::BIGINT AS missing_count, {u}::BIGINT AS unexpected_count, "
        f"round({p}::DOUBLE, 6) AS unexpected_percent"
        for r, ok, n, u, p in rows
    )


def _blank(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(key: str, query: Query, oracle: str | None) -> None:
    QUERIES[key] = query
    if oracle is not None:
        ORACLES[key] = oracle


# --- rows -------------------------------------------------------------------

add("r1_not_null", check_query("orders_gaps", [
    Rule(1, COLUMNS + "not_be_null", "priority"),
    Rule(2, COLUMNS + "not_be_null", "status", {"mostly": 0.5}),
    Rule(3, COLUMNS + "not_be_null", "o_orderkey"),
]), row_oracle("orders_gaps", Counts(1, "priority IS NULL"), Counts(2, _blank("status"), mostly=0.5),
               Counts(3, "o_orderkey IS NULL")))

add("r2_null_only", check_query("orders_gaps", [
    Rule(1, COLUMNS + "be_null", "priority", {"mostly": 0.1}), Rule(2, COLUMNS + "be_null", "status"),
]), row_oracle("orders_gaps", Counts(1, "priority IS NOT NULL", mostly=0.1), Counts(2, f"NOT {_blank('status')}")))

_SIZE = "TRY_CAST(trim(size_text) AS DOUBLE)"
add("r3_range", check_query("part_texts", [
    Rule(1, COLUMNS + "be_between", "p_size", {"min_value": 5, "max_value": 40}),
    Rule(2, COLUMNS + "be_between", "p_size", {"min_value": 1, "max_value": 50, "strict_min": True, "strict_max": True, "mostly": 0.9}),
    Rule(3, COLUMNS + "be_between", "size_text", {"min_value": 10, "max_value": "30"}),
]), row_oracle(
    "part_texts", Counts(1, "p_size < 5 OR p_size > 40", missing="p_size IS NULL"),
    Counts(2, "p_size <= 1 OR p_size >= 50", missing="p_size IS NULL", mostly=0.9),
    Counts(3, f"{_SIZE} < 10 OR {_SIZE} > 30", missing=_blank("size_text"))))

add("r4_regex_match", check_query("orders_gaps", [
    Rule(1, COLUMNS + "match_regex", "priority", {"regex": "1-URGENT|2-HIGH|3-.*"}),
    Rule(2, COLUMNS + "match_regex", "status", {"regex": "[FO]", "mostly": 0.4}),
]), row_oracle(
    "orders_gaps",
    Counts(1, f"{_blank('priority')} OR NOT regexp_full_match(trim(priority), '1-URGENT|2-HIGH|3-.*')", missing=_blank("priority")),
    Counts(2, f"{_blank('status')} OR NOT regexp_full_match(trim(status), '[FO]')", missing=_blank("status"), mostly=0.4)))

add("r5_regex_match_list", check_query("orders_gaps", [
    Rule(1, COLUMNS + "match_regex_list", "priority", {"regex_list": ["1-.*", ".*HIGH"]}),
    Rule(2, COLUMNS + "match_regex_list", "priority", {"regex_list": ["[0-9]-.*", ".*H.*"], "match_on": "all"}),
]), row_oracle(
    "orders_gaps",
    Counts(1, "priority IS NOT NULL AND NOT (regexp_full_match(priority, '1-.*') OR regexp_full_match(priority, '.*HIGH'))", missing="priority IS NULL"),
    Counts(2, "priority IS NOT NULL AND NOT (regexp_full_match(priority, '[0-9]-.*') AND regexp_full_match(priority, '.*H.*'))", missing="priority IS NULL")))

add("r6_regex_not_match", check_query("orders_gaps", [
    Rule(1, COLUMNS + "not_match_regex", "priority", {"regex": "1-URGENT|2-HIGH"}),
    Rule(2, COLUMNS + "not_match_regex", "status", {"regex": "F", "mostly": 0.5}),
]), row_oracle(
    "orders_gaps",
    Counts(1, f"NOT {_blank('priority')} AND regexp_full_match(trim(priority), '1-URGENT|2-HIGH')", missing=_blank("priority")),
    Counts(2, f"NOT {_blank('status')} AND regexp_full_match(trim(status), 'F')", missing=_blank("status"), mostly=0.5)))

add("r7_regex_not_match_list", check_query("orders_gaps", [
    Rule(1, COLUMNS + "not_match_regex_list", "priority", {"regex_list": ["1-.*", ".*HIGH"]}),
    Rule(2, COLUMNS + "not_match_regex_list", "priority", {"regex_list": ["[0-9]-.*", ".*H.*"], "match_on": "ALL"}),
]), row_oracle(
    "orders_gaps",
    Counts(1, "priority IS NOT NULL AND (regexp_full_match(priority, '1-.*') OR regexp_full_match(priority, '.*HIGH'))", missing="priority IS NULL"),
    Counts(2, "priority IS NOT NULL AND (regexp_full_match(priority, '[0-9]-.*') AND regexp_full_match(priority, '.*H.*'))", missing="priority IS NULL")))


def _in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = [f"{i}-X" for i in range(1, 60)] + ["1-URGENT", "2-HIGH"]
    results = evaluate(dataset(spark, sf_dir, "orders_gaps"), [
        Rule(1, COLUMNS + "be_in_set", "priority", {"value_set": ["1-URGENT", "2-HIGH", "9-NONE"]}),
        Rule(2, COLUMNS + "be_in_set", "status", {"value_set": '["F","O"]', "mostly": 0.9}),
        Rule(3, COLUMNS + "be_in_set", "priority", {"value_set": many}),
    ])
    doc = F.try_parse_json("results")
    return results.select(
        "rule_config_id", "is_success", "element_count", "missing_count", "unexpected_count",
        F.round("unexpected_percent", 6).alias("unexpected_percent"),
        *[F.try_variant_get(doc, f"$.{k}", "bigint").alias(k)
          for k in ("match_count", "distinct_match_count", "total_reference_values")],
        "observed_value",
    )


def _in_set_oracle() -> str:
    parts = []
    for rule, c, values, size, mostly in (
        (1, "priority", ("1-URGENT", "2-HIGH"), 3, 1.0), (2, "status", ("F", "O"), 2, 0.9),
        (3, "priority", ("1-URGENT", "2-HIGH"), 61, 1.0),
    ):
        listed = ", ".join(f"'{v}'" for v in values)
        blank = _blank(c)
        entries = " || ',' || ".join(
            f"'\"{v}\":' || count(*) FILTER (WHERE {c} = '{v}')" for v in values
        )
        parts.append(f"""
        SELECT {rule}::BIGINT AS rule_config_id, (CASE WHEN n = 0 THEN 0.0 ELSE u::DOUBLE / n END) <= (1.0::DOUBLE - {mostly}::DOUBLE) AS is_success,
               n AS element_count, m AS missing_count, u AS unexpected_count,
               round((CASE WHEN n = 0 THEN 0.0 ELSE u::DOUBLE / n END) * 100, 6) AS unexpected_percent,
               (n - m - u)::BIGINT AS match_count, d AS distinct_match_count, {size}::BIGINT AS total_reference_values, o AS observed_value
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {blank}) AS m,
                     count(*) FILTER (WHERE NOT {blank} AND {c} NOT IN ({listed})) AS u,
                     count(DISTINCT {c}) FILTER (WHERE {c} IN ({listed})) AS d, '{{' || {entries} || '}}' AS o
              FROM orders_gaps)""")
    return with_fixtures("\nUNION ALL\n".join(parts), "orders_gaps")


add("r8_value_in_set", _in_set, _in_set_oracle())

add("r8_value_in_set_second_name", check_query("orders_gaps", [
    Rule(1, COLUMNS + "be_in_reference_set", "priority", {"value_set": ["1-URGENT", "5-LOW"]}),
]), row_oracle("orders_gaps", Counts(1, "priority NOT IN ('1-URGENT', '5-LOW')", missing=_blank("priority"))))

add("r9_value_not_in_set", check_query("orders_gaps", [
    Rule(1, COLUMNS + "not_be_in_set", "priority", {"value_set": ["1-URGENT"]}),
    Rule(2, COLUMNS + "not_be_in_set", "o_custkey", {"value_set": [1, 2, "3", 4.0], "mostly": 0.99}),
]), row_oracle("orders_gaps", Counts(1, "priority IN ('1-URGENT')", missing="priority IS NULL"),
               Counts(2, "o_custkey IN (1, 2, 3, 4)", missing="o_custkey IS NULL", mostly=0.99)))

add("r10_length_between", check_query("orders_gaps", [
    Rule(1, "expect_column_value_lengths_to_be_between", "priority", {"min_value": 6, "max_value": 8}),
    Rule(2, "expect_column_value_lengths_to_be_between", "status", {"min_value": 2, "mostly": 0.2}),
]), row_oracle("orders_gaps", Counts(1, "length(priority) < 6 OR length(priority) > 8", by_success_rate=True),
               Counts(2, "length(status) < 2", by_success_rate=True, mostly=0.2)))

add("r11_length_equal", check_query("orders_gaps", [
    Rule(1, "expect_column_value_lengths_to_equal", "priority", {"value": 8}),
    Rule(2, "expect_column_value_lengths_to_equal", None, {"value": 1, "column": "status", "mostly": 0.6}),
]), row_oracle("orders_gaps", Counts(1, "length(priority) <> 8", missing="priority IS NULL"),
               Counts(2, "length(status) <> 1", missing="status IS NULL", mostly=0.6)))

add("r12_data_type", check_query("part_texts", [
    Rule(1, COLUMNS + "be_of_type", "size_text", {"type_": "NUMBER"}),
    Rule(2, COLUMNS + "be_of_type", "size_text", {"type_": "VARCHAR"}),
    Rule(3, COLUMNS + "be_of_type", "p_size", {"type_": "DATE"}),
    Rule(4, COLUMNS + "be_of_type", "date_text", {"type_": "DATE", "mostly": 0.5}),
    Rule(5, COLUMNS + "be_of_type", "p_retailprice", {"type_": "INT"}),
    Rule(6, COLUMNS + "be_of_type", "size_text", {"type_": "BOOLEAN"}),
]), row_oracle(
    "part_texts",
    Counts(1, f"NOT {_blank('size_text')} AND TRY_CAST(size_text AS DECIMAL(38,10)) IS NULL", missing=_blank("size_text")),
    Counts(2, "FALSE", missing=_blank("size_text")),
    Counts(3, "TRUE"),
    Counts(4, f"NOT {_blank('date_text')} AND TRY_CAST(date_text AS DATE) IS NULL", missing=_blank("date_text"), mostly=0.5),
    Counts(5, "p_retailprice IS NOT NULL AND TRY_CAST(p_retailprice AS DECIMAL(38,10)) IS NULL", missing="p_retailprice IS NULL"),
    Counts(6, f"NOT {_blank('size_text')} AND lower(trim(size_text)) NOT IN ('1', '0', 't', 'f')", missing=_blank("size_text"))))

_Z = "abs((price - (SELECT avg(price) FROM orders_gaps)) / (SELECT stddev_samp(price) FROM orders_gaps))"
add("r13_z_score", check_query("orders_gaps", [
    Rule(1, "expect_column_value_z_scores_to_be_less_than", "price", {"threshold": 1.5, "double_sided": True, "mostly": 0.8}),
    Rule(2, "expect_column_value_z_scores_to_be_less_than", "price", {"threshold": 1.2}),
]), row_oracle(
    "orders_gaps",
    Counts(1, f"price IS NOT NULL AND NOT ({_Z} < 1.5)", element="price IS NOT NULL", missing="FALSE", mostly=0.8),
    Counts(2, f"price IS NOT NULL AND NOT ({_Z[3:]} < 1.2)", element="price IS NOT NULL", missing="FALSE")))

add("r14_pair_greater", check_query("labelled", [
    Rule(1, "expect_column_pair_values_a_to_be_greater_than_b", None, {"column_A": "n_chars", "column_B": "quality"}),
    Rule(2, "expect_column_pair_values_a_to_be_greater_than_b", None, {"column_A": "quality", "column_B": "toxic", "ignore_row_if": "either_value_is_missing", "mostly": 0.3}),
    Rule(3, "expect_column_pair_values_a_to_be_greater_than_b", None, {"column_A": "quality", "column_B": "toxic", "or_equal": True, "ignore_row_if": "both_values_are_missing"}),
]), row_oracle(
    "labelled",
    Counts(1, "NOT (n_chars > quality)", missing="n_chars IS NULL OR quality IS NULL", of_nonmissing=True),
    Counts(2, "NOT (quality > toxic)", element="quality IS NOT NULL AND toxic IS NOT NULL", missing="FALSE", of_nonmissing=True, mostly=0.3),
    Counts(3, "NOT (quality >= toxic)", element="NOT (quality IS NULL AND toxic IS NULL)",
           missing="(quality IS NULL OR toxic IS NULL) AND NOT (quality IS NULL AND toxic IS NULL)", of_nonmissing=True)))

add("r15_pair_equal", check_query("labelled", [
    Rule(1, "expect_column_pair_values_to_be_equal", None, {"column_A": "quality", "column_B": "toxic"}),
    Rule(2, "expect_column_pair_values_to_be_equal", None, {"column_A": "quality", "column_B": "toxic", "ignore_row_if": "neither", "mostly": 0.5}),
    Rule(3, "expect_column_pair_values_to_be_equal", None, {"column_A": "n_chars", "column_B": "quality", "ignore_row_if": "either_value_is_missing"}),
]), row_oracle(
    "labelled",
    Counts(1, "quality IS DISTINCT FROM toxic", element="NOT (quality IS NULL AND toxic IS NULL)"),
    Counts(2, "quality IS DISTINCT FROM toxic", mostly=0.5),
    Counts(3, "n_chars IS DISTINCT FROM quality AND quality IS NOT NULL", element="quality IS NOT NULL")))

add("r16_pair_in_set", check_query("labelled", [
    Rule(1, "expect_column_pair_values_to_be_in_set", None, {"column_A": "quality", "column_B": "toxic", "value_pairs_set": [[1, 0], [0, 0]]}),
    Rule(2, "expect_column_pair_values_to_be_in_set", None, {"column_list": ["lang", "quality"], "value_pairs_set": [["en", 1], ["de", None], ["fr", "0"]], "ignore_row_if": "neither"}),
]), row_oracle(
    "labelled",
    Counts(1, "NOT (quality IS NULL AND toxic IS NULL) AND NOT coalesce((quality = 1 AND toxic = 0) OR (quality = 0 AND toxic = 0), FALSE)",
           element="NOT (quality IS NULL AND toxic IS NULL)", missing="quality IS NULL AND toxic IS NULL"),
    Counts(2, "NOT ((lang IS NOT DISTINCT FROM 'en' AND quality IS NOT DISTINCT FROM 1) OR (lang IS NOT DISTINCT FROM 'de' AND quality IS NULL) "
              "OR (lang IS NOT DISTINCT FROM 'fr' AND quality IS NOT DISTINCT FROM 0))", missing="lang IS NULL AND quality IS NULL")))

_DUP = "(SELECT *, count(*) OVER (PARTITION BY {0}) AS copies FROM {1})"
add("r17_unique", check_query("documents", [
    Rule(1, COLUMNS + "be_unique", "text", {"mostly": 0.8}), Rule(2, COLUMNS + "be_unique", "doc_id"),
]), row_oracle("documents", Counts(1, f"NOT {_blank('text')} AND copies > 1", missing=_blank("text"), by_success_rate=True, mostly=0.8),
               subquery=_DUP.format("text", "documents")) + "\nUNION ALL\n" +
    row_oracle("documents", Counts(2, "copies > 1", missing="doc_id IS NULL", by_success_rate=True),
               subquery=_DUP.format("doc_id", "documents")))

add("r18_compound_unique", check_query("labelled", [
    Rule(1, "expect_compound_columns_to_be_unique", None, {"column_list": ["lang", "quality"]}),
    Rule(2, "expect_compound_columns_to_be_unique", None, {"column_list": ["source", "quality", "toxic"], "ignore_row_if": "any_value_is_missing", "mostly": 0.5}),
]), with_fixtures("\nUNION ALL\n".join([
    row_oracle("x", Counts(1, "rn > 1", missing="FALSE"),
               subquery="(SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) AS rn FROM labelled)"),
    row_oracle("x", Counts(2, "rn > 1 AND quality IS NOT NULL AND toxic IS NOT NULL AND source IS NOT NULL",
                           element="quality IS NOT NULL AND toxic IS NOT NULL AND source IS NOT NULL",
                           missing="quality IS NULL OR toxic IS NULL OR source IS NULL", mostly=0.5),
               subquery="(SELECT *, row_number() OVER (PARTITION BY source, quality, toxic ORDER BY doc_id) AS rn FROM labelled)"),
]), "labelled"))

_SUM3 = "abs(coalesce(quality, 0) + coalesce(toxic, 0) - 1)"
add("r19_multicolumn_sum", check_query("labelled", [
    Rule(1, "expect_multicolumn_sum_to_equal", None, {"column_list": ["quality", "toxic"], "sum_total": 1}),
    Rule(2, "expect_multicolumn_sum_to_equal", None, {"column_list": ["quality", "toxic"], "sum_total": 1, "ignore_row_if": "any_value_is_missing", "mostly": 0.4}),
]), row_oracle(
    "labelled", Counts(1, f"{_SUM3} > 0.0001", missing="quality IS NULL OR toxic IS NULL", by_success_rate=True),
    Counts(2, f"{_SUM3} > 0.0001 AND NOT (quality IS NULL OR toxic IS NULL)", element="NOT (quality IS NULL OR toxic IS NULL)",
           missing="quality IS NULL OR toxic IS NULL", by_success_rate=True, mostly=0.4)))

add("r20_unique_within_record", check_query("labelled", [
    Rule(1, "expect_select_column_values_to_be_unique_within_record", None, {"column_list": ["quality", "toxic"]}),
    Rule(2, "expect_select_column_values_to_be_unique_within_record", None, {"column_list": "quality, toxic", "ignore_row_if": "any_value_is_missing", "mostly": 0.4}),
]), row_oracle(
    "labelled", Counts(1, "quality IS NOT DISTINCT FROM toxic", missing="FALSE", missing_outside=True),
    Counts(2, "quality = toxic", element="quality IS NOT NULL AND toxic IS NOT NULL", missing="quality IS NULL OR toxic IS NULL",
           missing_outside=True, mostly=0.4)))

add("r21_unexpected_rows", check_query("lineitem", [
    Rule(1, "unexpected_rows_expectation", None, {"unexpected_rows_query": "SELECT l.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate < o.o_orderdate"}),
    Rule(2, "unexpected_rows_expectation", None, {"unexpected_rows_query": "SELECT l_orderkey FROM lineitem WHERE l_quantity < 0;"}),
], others=["orders"]), """
    SELECT r::BIGINT AS rule_config_id, u = 0 AS is_success, n AS element_count, 0::BIGINT AS missing_count, u AS unexpected_count,
           round(CASE WHEN n = 0 THEN 0.0 ELSE u::DOUBLE / n END * 100, 6) AS unexpected_percent
    FROM (SELECT 1 AS r, (SELECT count(*) FROM lineitem) AS n,
                 (SELECT count(*) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate < o.o_orderdate) AS u
          UNION ALL SELECT 2, (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_quantity < 0))""")

# --- scalars ----------------------------------------------------------------

_NUM = {"min": "min", "max": "max", "sum": "sum", "mean": "avg", "median": "median", "stdev": "stddev_samp"}
for _i, (_name, _function) in enumerate(_NUM.items(), 1):
    _low, _high = {"min": (800, 1000), "max": (1, 2000.5), "sum": (0, 1e12), "mean": (1300, 1400),
                   "median": (1500, 1600), "stdev": (0, 1000)}[_name]
    _expectation = f"expect_column_{_name}_to_be_between"
    add(f"a{_i}_{_name}_between", check_query("part_texts", [
        Rule(1, _expectation, "p_retailprice", {"min_value": _low, "max_value": _high}),
        Rule(2, _expectation, "size_text", {"min_value": 1, "max_value": 49, "strict_min": True}),
        Rule(3, _expectation, "p_size", {"max_value": 50, "strict_max": True}),
    ], observed=True), scalar_oracle(
        "part_texts",
        Scalar(1, f"{_function}(p_retailprice)", _low, _high, missing="p_retailprice IS NULL"),
        Scalar(2, f"{_function}({_SIZE})", 1, 49, strict_low=True, missing="size_text IS NULL"),
        Scalar(3, f"{_function}(p_size::DOUBLE)", None, 50, strict_high=True, missing="p_size IS NULL")))

add("a7_proportion_non_null", check_query("orders_gaps", [
    Rule(1, "expect_column_proportion_of_non_null_values_to_be_between", "priority", {"min_value": 0.7, "max_value": 0.9}),
    Rule(2, "expect_column_proportion_of_non_null_values_to_be_between", "price", {"min_value": 0.9}),
], observed=True), scalar_oracle(
    "orders_gaps", Scalar(1, "count(priority)::DOUBLE / count(*)", 0.7, 0.9, unexpected="n - round(v * n)"),
    Scalar(2, "count(price)::DOUBLE / count(*)", 0.9, unexpected="n - round(v * n)")))

add("a8_proportion_unique", check_query("documents", [
    Rule(1, "expect_column_proportion_of_unique_values_to_be_between", "text", {"min_value": 0.9, "max_value": 1}),
    Rule(2, "expect_column_proportion_of_unique_values_to_be_between", "doc_id", {"min_value": 1, "strict_min": True}),
], observed=True), scalar_oracle(
    "documents", Scalar(1, "count(DISTINCT text)::DOUBLE / count(text)", 0.9, 1, missing="text IS NULL"),
    Scalar(2, "count(DISTINCT doc_id)::DOUBLE / count(doc_id)", 1, strict_low=True, missing="doc_id IS NULL")))

add("a9_unique_value_count", check_query("orders_gaps", [
    Rule(1, "expect_column_unique_value_count_to_be_between", "priority", {"min_value": 4, "max_value": 4}),
    Rule(2, "expect_column_unique_value_count_to_be_between", "o_custkey", {"max_value": 10}),
], observed=True), scalar_oracle(
    "orders_gaps", Scalar(1, "count(DISTINCT priority)", 4, 4, missing="priority IS NULL"),
    Scalar(2, "count(DISTINCT o_custkey)", None, 10, missing="o_custkey IS NULL")))


def _mode_sql(rule: int, column: str, values: str, ties_okay: bool) -> str:
    test = "bool_or" if ties_okay else "bool_and"
    return f"""
    SELECT {rule}::BIGINT AS rule_config_id, ok AS is_success, n AS element_count, m AS missing_count,
           (CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS unexpected_count,
           (CASE WHEN ok THEN 0.0 ELSE 100.0 END)::DOUBLE AS unexpected_percent
    FROM (SELECT (SELECT count(*) FROM orders_gaps) AS n, (SELECT count(*) FROM orders_gaps WHERE {column} IS NULL) AS m,
                 coalesce({test}(v IN ({values})), FALSE) AS ok
          FROM (SELECT {column} AS v, count(*) AS c, max(count(*)) OVER () AS top FROM orders_gaps
                WHERE {column} IS NOT NULL GROUP BY {column}) WHERE c = top)"""


_MODE = "expect_column_most_common_value_to_be_in_set"
add("a10_most_common_in_set", check_query("orders_gaps", [
    Rule(1, _MODE, "priority", {"value_set": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]}),
    Rule(2, _MODE, "priority", {"value_set": ["9"]}),
    Rule(3, _MODE, "o_orderkey", {"value_set": [1, 2, 3], "ties_okay": True}),
    Rule(4, _MODE, "o_orderkey", {"value_set": [1, 2, 3]}),
]), with_fixtures("\nUNION ALL\n".join([
    _mode_sql(1, "priority", "'1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'", False),
    _mode_sql(2, "priority", "'9'", False), _mode_sql(3, "o_orderkey", "1, 2, 3", True),
    _mode_sql(4, "o_orderkey", "1, 2, 3", False)]), "orders_gaps"))


def _fresh_sql(rule: int, interval: str) -> str:
    return f"""SELECT {rule}::BIGINT AS rule_config_id, ok AS is_success, n AS element_count, NULL::BIGINT AS missing_count,
        CASE WHEN ok THEN 0 ELSE n END AS unexpected_count, CASE WHEN ok THEN 0.0 ELSE 100.0 END::DOUBLE AS unexpected_percent
        FROM (SELECT count(*) AS n, coalesce(max(ts) > TIMESTAMP '{AS_OF}' - {interval}, FALSE) AS ok FROM events)"""


_FRESH = "expect_column_values_to_be_fresh"
add("a11_freshness", check_query("events", [
    Rule(1, _FRESH, "ts", {"freshness_threshold_value": 5, "freshness_threshold_unit": "DAY"}),
    Rule(2, _FRESH, "ts", {"freshness_threshold_value": 30, "freshness_threshold_unit": "minute"}),
]), "\nUNION ALL\n".join([_fresh_sql(1, "INTERVAL 5 DAY"), _fresh_sql(2, "INTERVAL 30 MINUTE")]))

# --- distinct sets ----------------------------------------------------------


def _distinct_query(expectation: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        results = evaluate(dataset(spark, sf_dir, "orders_gaps"), [
            Rule(1, expectation, "priority", {"value_set": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]}),
            Rule(2, expectation, "priority", {"value_set": ["1-URGENT", "9-NONE"]}),
            Rule(3, expectation, "priority", {"value_set": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}),
            Rule(4, expectation, "priority", {"value_set": ["1-URGENT", "2-HIGH"]}),
        ])
        doc = F.try_parse_json("details")
        return results.select(
            "rule_config_id", "is_success", "element_count", "unexpected_count",
            F.get_json_object("details", "$.missing").alias("missing"),
            *[F.try_variant_get(doc, f"$.{k}", "bigint").alias(k)
              for k in ("missing_count", "extra_count", "observed_count")],
        )

    return run


def _distinct_sql(test: str) -> str:
    sets = {1: ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), 2: ("1-URGENT", "9-NONE"),
            3: ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), 4: ("1-URGENT", "2-HIGH")}
    parts = []
    for rule, values in sets.items():
        rows = " UNION ALL ".join(f"SELECT '{v}' AS v" for v in values)
        parts.append(f"""
        SELECT {rule}::BIGINT AS rule_config_id, ({test}) AS is_success, n AS element_count,
               (CASE WHEN {test} THEN 0 ELSE 1 END)::BIGINT AS unexpected_count,
               '[' || coalesce(missing_list, '') || ']' AS missing, m AS missing_count, x AS extra_count, d AS observed_count
        FROM (SELECT (SELECT count(priority) FROM orders_gaps) AS n, (SELECT count(DISTINCT priority) FROM orders_gaps) AS d,
                     (SELECT count(*) FROM ({rows}) WHERE v NOT IN (SELECT priority FROM orders_gaps WHERE priority IS NOT NULL)) AS m,
                     (SELECT string_agg('"' || v || '"', ',' ORDER BY v) FROM ({rows})
                      WHERE v NOT IN (SELECT priority FROM orders_gaps WHERE priority IS NOT NULL)) AS missing_list,
                     (SELECT count(DISTINCT priority) FROM orders_gaps WHERE priority NOT IN (SELECT v FROM ({rows}))) AS x)""")
    return with_fixtures("\nUNION ALL\n".join(parts), "orders_gaps")


add("d1_distinct_contains_set", _distinct_query("expect_column_distinct_values_to_contain_set"), _distinct_sql("m = 0"))
add("d2_distinct_equals_set", _distinct_query("expect_column_distinct_values_to_equal_set"), _distinct_sql("m = 0 AND x = 0"))
add("d3_distinct_in_set", _distinct_query("expect_column_distinct_values_to_be_in_set"), _distinct_sql("x = 0"))

# --- neighbouring numbers beyond 2**53, decimals, line breaks at the end ------

_EDGE = 2**53

add("r3_between_exact", check_query("neighbours", [
    Rule(1, COLUMNS + "be_between", "edge", {"min_value": 0, "max_value": _EDGE}),
    Rule(2, COLUMNS + "be_between", "edge", {"min_value": _EDGE, "max_value": 2**60, "strict_min": True}),
    Rule(3, COLUMNS + "be_between", "big", {"min_value": str(_EDGE + 101), "max_value": 2**60}),
    Rule(4, COLUMNS + "be_between", "money", {"min_value": "100.25", "max_value": "200.26", "strict_min": True}),
]), row_oracle("neighbours", Counts(1, f"edge > {_EDGE}", missing="FALSE"), Counts(2, f"edge <= {_EDGE}", missing="FALSE"),
               Counts(3, f"big < {_EDGE + 101}", missing="FALSE"), Counts(4, "money <= 100.25 OR money > 200.26", missing="FALSE")))

add("r4_full_match", check_query("neighbours", [
    Rule(1, COLUMNS + "match_regex_list", "ended", {"regex_list": ["[A-Z]", "never"]}),
    Rule(2, COLUMNS + "not_match_regex_list", "ended", {"regex_list": ["[A-Z]"]}),
]), row_oracle("neighbours", Counts(1, "length(ended) <> 1", missing="FALSE"), Counts(2, "length(ended) = 1", missing="FALSE")))

add("r16_pair_in_set_exact", check_query("neighbours", [
    Rule(1, "expect_column_pair_values_to_be_in_set", None, {
        "column_A": "edge", "column_B": "parity", "value_pairs_set": [[_EDGE, 0], [str(_EDGE + 1), 1], ["x", 1], [0.5, 0]]}),
    Rule(2, "expect_column_pair_values_to_be_in_set", None, {
        "column_A": "money", "column_B": "parity", "value_pairs_set": [["3.25", 1], ["4.25", 0], ["5.251", 1]]}),
]), row_oracle(
    "neighbours", Counts(1, f"NOT ((edge = {_EDGE} AND parity = 0) OR (edge = {_EDGE + 1} AND parity = 1))", missing="FALSE"),
    Counts(2, "NOT ((money = 3.25 AND parity = 1) OR (money = 4.25 AND parity = 0))", missing="FALSE")))

add("r8_value_in_set_exact", check_query("neighbours", [
    Rule(1, COLUMNS + "be_in_set", "edge", {"value_set": [_EDGE, f"{_EDGE}.0"]}),
    Rule(2, COLUMNS + "be_in_set", "money", {"value_set": ["10.25", 11.25, "12.2501", "x"]}),
    Rule(3, COLUMNS + "be_in_set", "big", {"value_set": [_EDGE + k for k in range(60)]}),
]), row_oracle("neighbours", Counts(1, f"edge <> {_EDGE}", missing="FALSE"), Counts(2, "money NOT IN (10.25, 11.25)", missing="FALSE"),
               Counts(3, f"big >= {_EDGE + 60}", missing="FALSE")))

add("r3_between_decimal", check_query("wide_numbers", [
    Rule(1, COLUMNS + "be_between", "wide", {"min_value": "100000000000000000000000000000000005.5", "max_value": "100000000000000000000000000000000400"}),
    Rule(2, COLUMNS + "be_between", "wide", {"min_value": -1e300, "max_value": "100000000000000000000000000000000020.5", "strict_max": True}),
    Rule(3, COLUMNS + "be_between", "wide", {"min_value": 0, "max_value": "1e40"}),
    Rule(4, COLUMNS + "be_between", "money", {"min_value": "10.255", "max_value": "200.245", "strict_min": True, "strict_max": True}),
    Rule(5, COLUMNS + "be_between", "small", {"min_value": 0.5, "max_value": "1e30"}),
]), row_oracle(
    "wide_numbers",
    Counts(1, "o_orderkey < 6 OR o_orderkey > 400", missing="FALSE"), Counts(2, "o_orderkey > 20", missing="FALSE"),
    Counts(3, "FALSE", missing="FALSE"), Counts(4, "o_orderkey + 0.25 <= 10.255 OR o_orderkey + 0.25 >= 200.245", missing="FALSE"),
    Counts(5, "parity < 0.5", missing="FALSE")))

add("r4_patterns_left_open", check_query("orders_gaps", [
    Rule(1, COLUMNS + "match_regex", "priority", {"regex": "(?x) [1-2]-.*  # the urgent ones"}),
    Rule(2, COLUMNS + "not_match_regex", "priority", {"regex": "b)|(?:.*A"}),
    Rule(3, COLUMNS + "match_regex_list", "priority", {"regex_list": ["\\Q1-URGENT", "2(?x)-H I G H # no blanks"]}),
    Rule(4, COLUMNS + "not_match_regex_list", "priority", {"regex_list": ["1-.*", "x)|(?:y"]}),
]), row_oracle(
    "orders_gaps",
    Counts(1, f"{_blank('priority')} OR NOT regexp_full_match(trim(priority), '[1-2]-.*')", missing=_blank("priority")),
    Counts(3, "priority IS NOT NULL AND priority NOT IN ('1-URGENT', '2-HIGH')", missing="priority IS NULL"),
) + "\nUNION ALL\n" + "\nUNION ALL\n".join(
    f"SELECT {r}::BIGINT, FALSE, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE" for r in (2, 4)))

add("r19_sum_exact", check_query("wide_numbers", [
    Rule(1, "expect_multicolumn_sum_to_equal", None, {"column_list": ["edge", "edge_too"], "sum_total": 2**54}),
    Rule(2, "expect_multicolumn_sum_to_equal", None, {"column_list": ["wide", "minus_wide"], "sum_total": "0.00005"}),
    Rule(3, "expect_multicolumn_sum_to_equal", None, {"column_list": ["wide", "minus_wide", "money"], "sum_total": "7.25"}),
    Rule(4, "expect_multicolumn_sum_to_equal", None, {"column_list": ["wide", "wide"], "sum_total": "1e39"}),
    Rule(5, "expect_multicolumn_sum_to_equal", None, {"column_list": ["minus_money", "money"], "sum_total": -0.0}),
]), row_oracle(
    "wide_numbers", Counts(1, "parity = 1", missing="FALSE", by_success_rate=True), Counts(2, "FALSE", missing="FALSE", by_success_rate=True),
    Counts(3, "o_orderkey <> 7", missing="FALSE", by_success_rate=True), Counts(4, "TRUE", missing="FALSE", by_success_rate=True),
    Counts(5, "FALSE", missing="FALSE", by_success_rate=True)))

_SIZES = {"min": ("min(o_orderkey)", 0), "max": ("max(o_orderkey)", 0), "sum": ("sum(o_orderkey::HUGEINT + 9007199254740992)", 9007199254740992)}
for _i, (_name, (_value, _base)) in enumerate(_SIZES.items(), 1):
    _expectation = f"expect_column_{_name}_to_be_between"

    def _exact_scalars(spark: SparkSession, sf_dir: str, expectation: str = _expectation) -> DataFrame:
        """Observed values keep every digit; bounds next to a value are told apart from it."""
        given = dataset(spark, sf_dir, "wide_numbers")
        least = given.frame.agg(F.min("o_orderkey")).first()[0]
        return evaluate(given, [
            Rule(1, expectation, "big", {"max_value": _EDGE + least}), Rule(2, expectation, "big", {"max_value": _EDGE + least, "strict_max": True}),
            Rule(3, expectation, "big", {"min_value": str(_EDGE + least + 1)}),
            Rule(4, expectation, "money" if "sum" in expectation else "wide", {"min_value": "1e35", "max_value": "1e36"}),
        ]).select("rule_config_id", "is_success", "element_count", "observed_value")

    _low = "(SELECT min(o_orderkey) FROM wide_numbers)"
    _own = _value if _base else f"{_value}::HUGEINT + 9007199254740992"
    _other = "money" if _name == "sum" else "wide"
    add(f"a{_i}_{_name}_exact", _exact_scalars, with_fixtures(f"""
        SELECT r::BIGINT AS rule_config_id, CASE r WHEN 1 THEN v <= {_EDGE} + {_low} WHEN 2 THEN v < {_EDGE} + {_low} WHEN 3 THEN v >= {_EDGE + 1} + {_low}
               ELSE w::DOUBLE BETWEEN 1e35 AND 1e36 END AS is_success, n AS element_count,
               CASE WHEN r < 4 THEN v::VARCHAR ELSE w::VARCHAR END AS observed_value
        FROM (SELECT count(*) AS n, {_own} AS v, {_name}({_other}) AS w FROM wide_numbers), (VALUES (1), (2), (3), (4)) t(r)""", "wide_numbers"))

_EXACT_SETS = check_query("neighbours", [
    Rule(1, "expect_column_distinct_values_to_equal_set", "edge", {"value_set": [_EDGE, _EDGE + 1]}),
    Rule(2, "expect_column_distinct_values_to_equal_set", "edge", {"value_set": [_EDGE, _EDGE + 2]}),
    Rule(3, "expect_column_distinct_values_to_be_in_set", "edge", {"value_set": [_EDGE, _EDGE + 2]}),
    Rule(4, "expect_column_distinct_values_to_contain_set", "edge", {"value_set": [_EDGE + 1, 0.5]}),
])

add("d2_distinct_equals_set_exact", lambda spark, sf_dir: _EXACT_SETS(spark, sf_dir).select("rule_config_id", "is_success", "element_count"), with_fixtures(f"""
    SELECT r::BIGINT AS rule_config_id, ok AS is_success, (SELECT count(*) FROM neighbours) AS element_count
    FROM (SELECT count(*) = 2 AND bool_and(edge IN ({_EDGE}, {_EDGE + 1})) AS e FROM (SELECT DISTINCT edge FROM neighbours)),
         LATERAL (VALUES (1, e), (2, FALSE), (3, NOT e), (4, FALSE)) AS t(r, ok)""", "neighbours"))

# --- tables -----------------------------------------------------------------

add("t1_row_count_between", check_query("orders", [
    Rule(1, "expect_table_row_count_to_be_between", None, {"min_value": 10, "max_value": 10000000}),
    Rule(2, "expect_table_row_count_to_be_between", None, {"max_value": 100, "strict_max": True}),
], observed=True), scalar_oracle("orders", Scalar(1, "count(*)", 10, 10000000), Scalar(2, "count(*)", None, 100, strict_high=True)))

add("t2_row_count_equal", check_query("region", [
    Rule(1, "expect_table_row_count_to_equal", None, {"value": 5}), Rule(2, "expect_table_row_count_to_equal", None, {"value": 6}),
], observed=True), scalar_oracle("region", Scalar(1, "count(*)", ok="v = 5"), Scalar(2, "count(*)", ok="v = 6")))

add("t3_row_count_equal_other", check_query("orders", [
    Rule(1, "expect_table_row_count_to_equal_other_table", None, {"other_dataset_name": "orders_gaps"}),
    Rule(2, "expect_table_row_count_to_equal_other_table", None, {"other_dataset_name": "Customer"}),
], observed=True, others=["orders_gaps", "customer"]), scalar_oracle(
    "orders", Scalar(1, "count(*)", ok="TRUE"), Scalar(2, "count(*)", ok="v = (SELECT count(*) FROM customer)")))


def _columns_sql(tests: dict[int, str], table: str = "orders") -> str:
    """Checks on the number of columns, over the columns DuckDB sees."""
    return "\nUNION ALL\n".join(
        f"""SELECT {rule}::BIGINT AS rule_config_id, ({test}) AS is_success, n AS element_count, NULL::BIGINT AS missing_count,
            (CASE WHEN {test} THEN 0 ELSE 1 END)::BIGINT AS unexpected_count,
            (CASE WHEN {test} THEN 0.0 ELSE 100.0 END)::DOUBLE AS unexpected_percent
            FROM (SELECT count(*) AS n FROM (DESCRIBE SELECT * FROM {table}))"""
        for rule, test in tests.items()
    )


add("t4_column_count_between", check_query("orders", [
    Rule(1, "expect_table_column_count_to_be_between", None, {"min_value": 6, "max_value": 6}),
    Rule(2, "expect_table_column_count_to_be_between", None, {"min_value": 6, "strict_min": True}),
]), _columns_sql({1: "n BETWEEN 6 AND 6", 2: "n > 6"}))
add("t5_column_count_equal", check_query("orders", [
    Rule(1, "expect_table_column_count_to_equal", None, {"value": 6}), Rule(2, "expect_table_column_count_to_equal", None, {"value": 5}),
]), _columns_sql({1: "n = 6", 2: "n = 5"}))

_NAMES = "(SELECT column_name AS c, row_number() OVER () - 1 AS i FROM (DESCRIBE SELECT * FROM orders))"


def _exists_sql(rule: int, name: str, index: int | None) -> str:
    at = "" if index is None else f" AND i = {index}"
    return f"""SELECT {rule}::BIGINT AS rule_config_id, ok AS is_success, 1::BIGINT AS element_count, NULL::BIGINT AS missing_count,
        (CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS unexpected_count, (CASE WHEN ok THEN 0.0 ELSE 100.0 END)::DOUBLE AS unexpected_percent
        FROM (SELECT count(*) > 0 AS ok FROM {_NAMES} WHERE lower(c) = lower('{name}'){at})"""


add("t6_column_exists", check_query("orders", [
    Rule(1, "expect_column_to_exist", "O_OrderKey"), Rule(2, "expect_column_to_exist", "o_custkey", {"column_index": 1}),
    Rule(3, "expect_column_to_exist", "o_custkey", {"column_index": 2}), Rule(4, "expect_column_to_exist", "missing"),
]), "\nUNION ALL\n".join([_exists_sql(1, "O_OrderKey", None), _exists_sql(2, "o_custkey", 1),
                           _exists_sql(3, "o_custkey", 2), _exists_sql(4, "missing", None)]))


def _ordered_sql(rule: int, names: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS w, {i} AS i" for i, n in enumerate(names))
    return f"""SELECT {rule}::BIGINT AS rule_config_id, u = 0 AS is_success, {len(names)}::BIGINT AS element_count, NULL::BIGINT AS missing_count,
        u AS unexpected_count, round(u * 100.0 / {len(names)}, 6)::DOUBLE AS unexpected_percent
        FROM (SELECT count(*) FILTER (WHERE w IS DISTINCT FROM c) AS u FROM ({rows}) FULL JOIN {_NAMES} USING (i))"""


_ORDERED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
add("t7_columns_match_ordered_list", check_query("orders", [
    Rule(1, "expect_table_columns_to_match_ordered_list", None, {"column_list": _ORDERED}),
    Rule(2, "expect_table_columns_to_match_ordered_list", None, {"column_list": ["o_custkey", "o_orderkey", "o_orderstatus"]}),
]), "\nUNION ALL\n".join([_ordered_sql(1, _ORDERED), _ordered_sql(2, ["o_custkey", "o_orderkey", "o_orderstatus"])]))


def _set_sql(rule: int, exact_case: list[str], any_case: list[str], exact: bool) -> str:
    wanted = " UNION ALL ".join([f"SELECT '{n}' AS w, TRUE AS s" for n in exact_case] + [f"SELECT '{n.upper()}' AS w, FALSE AS s" for n in any_case])
    size = len(exact_case) + len(any_case)
    return f"""SELECT {rule}::BIGINT AS rule_config_id, (m = 0 AND ({'x = 0' if exact else 'TRUE'})) AS is_success, {size}::BIGINT AS element_count,
        NULL::BIGINT AS missing_count, (m + x)::BIGINT AS unexpected_count, round((m + x) * 100.0 / {size}, 6)::DOUBLE AS unexpected_percent
        FROM (SELECT (SELECT count(*) FROM ({wanted}) WHERE NOT EXISTS (SELECT 1 FROM {_NAMES} WHERE CASE WHEN s THEN c = w ELSE upper(c) = w END)) AS m,
                     (SELECT count(*) FROM {_NAMES} WHERE upper(c) NOT IN (SELECT upper(w) FROM ({wanted}))) AS x)"""


add("t8_columns_match_set", check_query("orders", [
    Rule(1, "expect_table_columns_to_match_set", None, {"column_set": ["CS:o_orderkey", "O_CUSTKEY", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]}),
    Rule(2, "expect_table_columns_to_match_set", None, {"column_set": "['CS:O_ORDERKEY', 'o_custkey']", "exact_match": False}),
    Rule(3, "expect_table_columns_to_match_set", None, {"column_set": ["o_custkey"], "exact_match": False}),
]), "\nUNION ALL\n".join([
    _set_sql(1, ["o_orderkey"], _ORDERED[1:], True), _set_sql(2, ["O_ORDERKEY"], ["o_custkey"], False), _set_sql(3, [], ["o_custkey"], False)]))
