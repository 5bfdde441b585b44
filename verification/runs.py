"""Sources, sinks, capture of failing rows and the suite runner."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline import Dataset, Rule, evaluate, run_suite
from plumbline.functions.durable import ensure_checkpoint_dir
from plumbline.functions.local import local_frame
from plumbline.operators import capture
from plumbline.plans import execution, fusion, pivot
from plumbline.plans.suite import context_for, resolve_rules, run_summary, with_parsed_kwargs
from plumbline.sources import datasets, reference_csv, sinks
from verification.checks import COLUMNS, Counts, row_oracle
from verification.fixtures import frame, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return register


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/verification-{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------


@query("s1_table_source", "SELECT * FROM customer")
def table_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.table_dataset(spark, "customer", f"{sf_dir}/customer.parquet").frame


@query("s2_query_source", """
    SELECT o_orderpriority AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY o_orderpriority""")
def query_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.query_dataset(
        spark, "by_priority",
        "SELECT o_orderpriority AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS total "
        "FROM orders GROUP BY o_orderpriority",
        {"orders": frame(spark, sf_dir, "orders")},
    ).frame


_TYPES = """CASE column_type WHEN 'BIGINT' THEN 'NUMBER(19,0)' WHEN 'INTEGER' THEN 'NUMBER(10,0)'
    WHEN 'DOUBLE' THEN 'FLOAT' WHEN 'VARCHAR' THEN 'TEXT' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ(6)'
    WHEN 'TIMESTAMP_NS' THEN 'TIMESTAMP_NTZ(6)' ELSE column_type END"""


@query("s3_column_metadata", f"""
    SELECT (row_number() OVER ())::INTEGER AS ordinal, column_name, {_TYPES} AS data_type,
           (CASE column_type WHEN 'BIGINT' THEN 19 WHEN 'INTEGER' THEN 10 END)::INTEGER AS numeric_precision,
           (CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 0 END)::INTEGER AS numeric_scale
    FROM (DESCRIBE SELECT * FROM lineitem)""")
def column_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.column_metadata(frame(spark, sf_dir, "lineitem")).drop("is_nullable")


@query("s4_csv_export", "SELECT * FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, path = frame(spark, sf_dir, "supplier"), scratch(spark)
    reference_csv.export_csv(source, path)
    return reference_csv.read_reference_csv(spark, path, source.schema)


@query("s5_csv_load", with_fixtures("SELECT p_partkey, size_text, date_text FROM part_texts", "part_texts"))
def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULLs travel as a marker and come back as NULL, blanks stay blanks."""
    source, path = frame(spark, sf_dir, "part_texts").select("p_partkey", "size_text", "date_text"), scratch(spark)
    reference_csv.export_csv(source, path, single_file=False)
    return reference_csv.read_reference_csv(spark, path, source.schema)


@query("s5_csv_texts", "SELECT doc_id, text, lang, replace(source, 'src1', 'a\\\\\"' || chr(10) || ',') AS source, n_chars FROM documents")
def csv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks, quotes, delimiters and backslashes inside texts survive the round trip."""
    documents = frame(spark, sf_dir, "documents")
    source = documents.withColumn("source", F.replace("source", F.lit("src1"), F.lit('a\\\\"\n,')))
    path = scratch(spark)
    reference_csv.export_csv(source, path)
    return reference_csv.read_reference_csv(spark, path, source.schema)


@query("s5_csv_pages", "SELECT * FROM pages")
def csv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, path = frame(spark, sf_dir, "pages"), scratch(spark)
    reference_csv.export_csv(source, path)
    return reference_csv.read_reference_csv(spark, path, source.schema)


_SIZES = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("size_text", T.IntegerType())])


def _sizes_csv(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    reference_csv.export_csv(frame(spark, sf_dir, "part_texts").select("p_partkey", "size_text"), path)
    return path


@query("s6_tolerant_load", with_fixtures(
    "SELECT p_partkey, TRY_CAST(trim(size_text) AS INTEGER) AS size_text FROM part_texts WHERE size_text IS DISTINCT FROM 'x'", "part_texts"))
def tolerant_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_csv.read_reference_csv(spark, _sizes_csv(spark, sf_dir), _SIZES, on_error="continue")


@query("s6_rejected_rows", with_fixtures(
    "SELECT 'size_text is not int' AS problem, p_partkey::VARCHAR AS p_partkey, size_text FROM part_texts WHERE size_text = 'x'", "part_texts"))
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_csv.rejected_rows(spark, _sizes_csv(spark, sf_dir), _SIZES)


# --- a suite over parts, used by several queries ----------------------------

PART_RULES = [
    Rule(1, COLUMNS + "not_be_null", "size_text", expectation_id=1),
    Rule(2, COLUMNS + "be_between", "p_size", {"min_value": 5, "max_value": 40}, expectation_id=10),
    Rule(3, COLUMNS + "be_of_type", "size_text", {"type_": "NUMBER"}, expectation_id=7),
    Rule(4, "expect_table_row_count_to_be_between", None, {"max_value": 1}, expectation_id=30),
    Rule(5, COLUMNS + "be_unique", "p_partkey", expectation_id=17),
]
_RULE_SQL = {
    1: "(size_text IS NULL OR trim(size_text) = '')",
    2: "(p_size < 5 OR p_size > 40)",
    3: "(size_text = 'x')",
}


def _parts(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset("part_texts", frame(spark, sf_dir, "part_texts"), dataset_id=3, primary_key=("p_partkey",))


def _part_plan(spark: SparkSession, sf_dir: str, rules=PART_RULES, run_id: int = 1) -> fusion.Plan:
    return fusion.plan_rules(context_for(_parts(spark, sf_dir)), rules, run_id)


def _failing_sql(columns: str, rules=(1, 2, 3)) -> str:
    return " UNION ALL ".join(
        f"SELECT 1::BIGINT AS dataset_run_id, {r}::BIGINT AS rule_config_id, {columns} FROM part_texts WHERE {_RULE_SQL[r]}"
        for r in rules
    )


@query("s7_pivot_export", with_fixtures(f"""
    SELECT p_partkey, CASE WHEN {_RULE_SQL[1]} THEN 'FAIL' ELSE 'PASS' END AS missing_size,
           CASE WHEN {_RULE_SQL[2]} THEN 'FAIL' ELSE 'PASS' END AS size_range
    FROM part_texts WHERE {_RULE_SQL[1]} OR {_RULE_SQL[2]} OR {_RULE_SQL[3]}""", "part_texts"))
def pivot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = fusion.failed_rows(_part_plan(spark, sf_dir), [1, 2, 3])
    table = pivot.failure_pivot(failed, PART_HEADERS, run_id=1, dataset_id=3, dataset_name="part_texts")
    path = sinks.export_failure_pivot(table, scratch(spark), "part texts", 1)
    names = [h.header for h in PART_HEADERS]
    schema = T.StructType([
        T.StructField(f.name, T.LongType() if f.name == "p_partkey" else T.StringType()) for f in table.schema.fields
    ])
    back = reference_csv.read_reference_csv(spark, path, schema)
    return back.select("p_partkey", F.col(f"`{names[0]}`").alias("missing_size"), F.col(f"`{names[1]}`").alias("size_range"))


@query("s8_append_failed_rows", with_fixtures(
    f"SELECT rule_config_id, count(*) AS failed, sum(p_partkey)::BIGINT AS keys FROM ({_failing_sql('p_partkey')}) GROUP BY rule_config_id", "part_texts"))
def append_failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    failed = fusion.failed_rows(_part_plan(spark, sf_dir))
    sinks.append_failed_rows(failed.where("rule_config_id <> 2"), path)
    sinks.append_failed_rows(failed.where("rule_config_id = 2"), path)
    return spark.read.parquet(path).groupBy(F.col("rule_config_id").cast("bigint").alias("rule_config_id")).agg(
        F.count(F.lit(1)).alias("failed"), F.sum("p_partkey").alias("keys")
    )


# --- cross-cutting ----------------------------------------------------------


@query("x1_mostly_boundary", row_oracle(
    "orders", Counts(1, "o_orderstatus = 'P'", mostly=0.95), Counts(2, "o_orderkey % 4 = 0", mostly=0.75),
    Counts(3, "o_orderkey % 4 = 0", mostly=0.75, by_success_rate=True)))
def mostly_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "orders").withColumns({
        "kept": F.when(F.col("o_orderkey") % 4 != 0, F.lit("yes")), "word": F.when(F.col("o_orderkey") % 4 != 0, F.lit("yes")).otherwise(F.lit("")),
        "status": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
    })
    results = evaluate(Dataset("orders", df), [
        Rule(1, COLUMNS + "not_be_null", "status", {"mostly": 0.95}),
        Rule(2, COLUMNS + "not_be_null", "kept", {"mostly": 0.75}),
        Rule(3, "expect_column_value_lengths_to_be_between", "word", {"min_value": 1, "mostly": 0.75}),
    ])
    return results.select(
        "rule_config_id", "is_success", "element_count", "missing_count", "unexpected_count",
        F.round("unexpected_percent", 6).alias("unexpected_percent"),
    )

_SINCE = "TIMESTAMP '1997-06-01 00:00:00'"


@query("x2_incremental", with_fixtures("\nUNION ALL\n".join([
    row_oracle("x", Counts(1, "priority IS NULL"), subquery=f"(SELECT * FROM orders_gaps WHERE o_orderdate > {_SINCE})"),
    row_oracle("x", Counts(2, "o_totalprice < 1000 OR o_totalprice > 200000", missing="o_totalprice IS NULL"), subquery="orders_gaps"),
    "SELECT 3::BIGINT AS rule_config_id, ok AS is_success, n AS element_count, m AS missing_count, (CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS unexpected_count, "
    "(CASE WHEN ok THEN 0.0 ELSE 100.0 END)::DOUBLE AS unexpected_percent FROM (SELECT count(*) AS n, count(*) FILTER (WHERE priority IS NULL) AS m, "
    f"count(DISTINCT priority) BETWEEN 4 AND 4 AS ok FROM orders_gaps WHERE o_orderdate > {_SINCE})",
]), "orders_gaps"))
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Dataset(
        "orders_gaps", frame(spark, sf_dir, "orders_gaps"), incremental_columns=(None, "o_orderdate"),
        last_validated="1997-06-01 00:00:00",
    )
    return evaluate(orders, [
        Rule(1, COLUMNS + "not_be_null", "priority"),
        Rule(2, COLUMNS + "be_between", "o_totalprice", {"min_value": 1000, "max_value": 200000}),
        Rule(3, "expect_column_unique_value_count_to_be_between", "priority", {"min_value": 4, "max_value": 4}),
    ]).select(
        "rule_config_id", "is_success", "element_count", "missing_count", "unexpected_count",
        F.round("unexpected_percent", 6).alias("unexpected_percent"),
    )


@query("x3_failed_keys", with_fixtures(
    "SELECT dataset_run_id, rule_config_id, 'part_texts' AS table_name, '{\"p_partkey\":' || p_partkey || '}' AS failed_key FROM ("
    + _failing_sql("p_partkey") + ")", "part_texts"))
def failed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _part_plan(spark, sf_dir)
    return capture.failed_keys(fusion.failed_rows(plan), plan.dataset).drop("load_timestamp")


_PART_COLUMNS = "p_partkey, p_brand, p_type, p_size, p_retailprice, size_text, date_text"


@query("x4_failed_rows", with_fixtures(_failing_sql(_PART_COLUMNS), "part_texts"))
def failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.failed_rows(_part_plan(spark, sf_dir)).drop("dataset_id", "load_timestamp")


@query("x4_failed_rows_of_duplicates", """
    SELECT 2::BIGINT AS rule_config_id, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM
      (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)
    WHERE rn > 1
    UNION ALL SELECT 1, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
    FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) WHERE n > 1""")
def failed_rows_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Dataset("lineitem", frame(spark, sf_dir, "lineitem"), primary_key=("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    plan = fusion.plan_rules(context_for(lines), [
        Rule(1, COLUMNS + "be_unique", "l_partkey"),
        Rule(2, "expect_compound_columns_to_be_unique", None, {"column_list": ["l_orderkey", "l_linenumber"]}),
    ])
    return fusion.failed_rows(plan).select(
        "rule_config_id", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )


_ERROR_RULES = [
    Rule(1, COLUMNS + "be_between", "o_totalprice", {"min_value": 20000, "max_value": 250000}),
    Rule(2, COLUMNS + "match_regex", "priority", {"regex": "1-.*"}),
    Rule(3, COLUMNS + "be_in_set", "status", {"value_set": ["F"]}),
    Rule(4, COLUMNS + "be_unique", "o_custkey"),
]
_ERRORS = """errors AS (
    SELECT 1 AS rule_config_id, o_totalprice::VARCHAR AS v, o_totalprice AS d FROM orders_gaps WHERE o_totalprice < 20000 OR o_totalprice > 250000
    UNION ALL SELECT 2, trim(priority), NULL FROM orders_gaps WHERE priority IS NULL OR NOT regexp_full_match(trim(priority), '1-.*')
    UNION ALL SELECT 3, trim(status), NULL FROM orders_gaps WHERE trim(status) <> '' AND status NOT IN ('F')
    UNION ALL SELECT 4, o_custkey::VARCHAR, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders_gaps) WHERE n > 1)"""


def _error_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = fusion.plan_rules(context_for(Dataset("orders_gaps", frame(spark, sf_dir, "orders_gaps"))), _ERROR_RULES)
    return capture.failing_values(plan)


@query("x5_error_profile", with_fixtures("SELECT * FROM orders_gaps", "orders_gaps").rsplit("SELECT * FROM orders_gaps", 1)[0].rstrip() + ", " + _ERRORS + """
    SELECT rule_config_id::BIGINT AS rule_config_id, round(min(d), 2) AS low, round(max(d), 2) AS high,
           CASE WHEN max(d) IS NULL THEN min(v) END AS low_text, CASE WHEN max(d) IS NULL THEN max(v) END AS high_text,
           count(*) AS error_total_count, count(DISTINCT v) AS error_unique_count,
           round(count(DISTINCT v) * 100.0 / count(*), 6)::DOUBLE AS error_unique_percent,
           count(*) FILTER (WHERE v IS NULL) AS error_missing_count
    FROM errors GROUP BY rule_config_id""")
def error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = capture.error_profiles(_error_values(spark, sf_dir))
    low, high = (F.col(f"error_{k}_value") for k in ("min", "max"))
    numeric = F.col("rule_config_id").isin(1, 4)
    return profile.select(
        "rule_config_id", F.round(low.try_cast("double"), 2).alias("low"), F.round(high.try_cast("double"), 2).alias("high"),
        F.when(~numeric, low).alias("low_text"), F.when(~numeric, high).alias("high_text"),
        "error_total_count", "error_unique_count", F.round("error_unique_percent", 6).alias("error_unique_percent"),
        "error_missing_count",
    )


@query("x6_error_value_counts", with_fixtures("SELECT * FROM orders_gaps", "orders_gaps").rsplit("SELECT * FROM orders_gaps", 1)[0].rstrip() + ", " + _ERRORS + """
    SELECT rule_config_id::BIGINT AS rule_config_id, v AS value, count(*) AS n FROM errors WHERE v <> '' GROUP BY rule_config_id, v""")
def error_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.error_value_counts(_error_values(spark, sf_dir))


@query("x6_error_value_counts_top", with_fixtures("SELECT * FROM orders_gaps", "orders_gaps").rsplit("SELECT * FROM orders_gaps", 1)[0].rstrip() + ", " + _ERRORS + """
    SELECT rule_config_id::BIGINT AS rule_config_id, v AS value, n, rank FROM (
      SELECT rule_config_id, v, count(*) AS n, row_number() OVER (PARTITION BY rule_config_id ORDER BY count(*) DESC, v) AS rank
      FROM errors WHERE v <> '' GROUP BY rule_config_id, v) WHERE rank <= 10""")
def error_value_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent failing values of each rule."""
    return capture.error_value_counts(_error_values(spark, sf_dir), top=10)


@query("x7_ignore_policies", with_fixtures("\nUNION ALL\n".join(
    f"SELECT {i}::BIGINT AS rule_config_id, count(*) FILTER (WHERE NOT ({c})) AS element_count, count(*) FILTER (WHERE {c}) AS missing_count, "
    f"count(*) FILTER (WHERE quality IS NOT DISTINCT FROM toxic AND NOT ({c})) AS unexpected_count FROM labelled"
    for i, c in enumerate(["FALSE", "quality IS NULL OR toxic IS NULL", "quality IS NULL AND toxic IS NULL"], 1)), "labelled"))
def ignore_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = Dataset("labelled", frame(spark, sf_dir, "labelled"))
    return evaluate(labelled, [
        Rule(i, "expect_select_column_values_to_be_unique_within_record", None, {"column_list": ["quality", "toxic"], "ignore_row_if": p})
        for i, p in enumerate(["never", "any_value_is_missing", "all_values_are_missing"], 1)
    ]).select("rule_config_id", "element_count", "missing_count", "unexpected_count")


@query("x8_numeric_coercion", row_oracle(
    "numerals", Counts(1, "p_size < 10 OR p_size > 30", missing="FALSE"),
    Counts(2, "(p_size % 4 = 0 AND -p_size < -20) OR (p_size % 4 = 1 AND p_size + 0.5 > 20)", missing="mixed IS NULL"),
    Counts(3, "NOT (p_size > p_partkey)", missing="FALSE", of_nonmissing=True)))
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks read text columns as numbers, in digits or in numerals."""
    return evaluate(Dataset("numerals", frame(spark, sf_dir, "numerals")), [
        Rule(1, COLUMNS + "be_between", "spoken", {"min_value": 10, "max_value": 30}),
        Rule(2, COLUMNS + "be_between", "mixed", {"min_value": -20, "max_value": 20}),
        Rule(3, "expect_column_pair_values_a_to_be_greater_than_b", None, {"column_A": "spoken", "column_B": "p_partkey"}),
    ]).select(
        "rule_config_id", "is_success", "element_count", "missing_count", "unexpected_count",
        F.round("unexpected_percent", 6).alias("unexpected_percent"),
    )


@query("x9_result_append", row_oracle(
    "part_texts", Counts(1, _RULE_SQL[1]), Counts(2, _RULE_SQL[2], missing="FALSE"),
    Counts(3, _RULE_SQL[3], missing=_RULE_SQL[1])).replace("is_success, n AS", "is_success, 2::BIGINT AS runs, n AS"))
def result_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    for run_id in (1, 2):
        sinks.append(fusion.result_frame(_part_plan(spark, sf_dir, PART_RULES[:3], run_id)), path)
    return spark.read.parquet(path).groupBy("rule_config_id").agg(
        F.bool_and("is_success").alias("is_success"), F.count_distinct("dataset_run_id").alias("runs"),
        F.max("element_count").alias("element_count"), F.max("missing_count").alias("missing_count"),
        F.max("unexpected_count").alias("unexpected_count"),
        F.round(F.max("unexpected_percent"), 6).alias("unexpected_percent"),
    )


# --- suite ------------------------------------------------------------------

_RESOLVED = """
    SELECT r.rule_config_id, coalesce(r.column_name, '') AS column_name, coalesce(r.expectation_id, 0) AS expectation_id,
           r.expectation_name, r.kwargs, r.dimension, h.handler
    FROM rules r LEFT JOIN master m ON r.expectation_id = m.expectation_id
    LEFT JOIN handlers h ON upper(m.validation_name) = upper(h.expectation_type) AND h.is_active
    WHERE r.dataset_id = 11 AND h.handler IS NOT NULL AND r.is_active AND (r.dq_engine IS NULL OR upper(r.dq_engine) = 'SQL')"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_rules(*[frame(spark, sf_dir, n) for n in ("rules", "master", "handlers")], dataset_id=11)


@query("m1_rule_resolution", with_fixtures(_RESOLVED, "rules", "master", "handlers"))
def rule_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query("m2_kwargs_parse", with_fixtures(
    "SELECT rule_config_id, kwargs, NOT (kwargs IS NOT NULL AND (NOT json_valid(kwargs) OR json_type(CASE WHEN json_valid(kwargs) THEN kwargs ELSE '1' END) <> 'OBJECT')) AS kwargs_ok FROM rules", "rules"))
def kwargs_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = frame(spark, sf_dir, "rules").select("rule_config_id", "kwargs")
    return with_parsed_kwargs(rules)


def suite_rules() -> list[Rule]:
    """Twenty rules on order lines: the headline suite, in one scan."""
    between = COLUMNS + "be_between"
    return [
        *[Rule(i, COLUMNS + "not_be_null", c) for i, c in enumerate(
            ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"], 1)],
        Rule(7, between, "l_quantity", {"min_value": 2, "max_value": 49}),
        Rule(8, between, "l_discount", {"min_value": 0, "max_value": 0.09}),
        Rule(9, between, "l_tax", {"min_value": 0, "max_value": 0.08}),
        Rule(10, between, "l_extendedprice", {"min_value": 1000, "max_value": 90000, "mostly": 0.9}),
        Rule(11, COLUMNS + "be_in_set", "l_returnflag", {"value_set": ["A", "N", "R"]}),
        Rule(12, COLUMNS + "be_in_set", "l_linestatus", {"value_set": ["O"]}),
        Rule(13, COLUMNS + "match_regex", "l_returnflag", {"regex": "A|R"}),
        Rule(14, "expect_column_value_lengths_to_equal", "l_linestatus", {"value": 1}),
        Rule(15, "expect_column_pair_values_a_to_be_greater_than_b", None, {"column_A": "l_extendedprice", "column_B": "l_quantity"}),
        Rule(16, "expect_column_mean_to_be_between", "l_quantity", {"min_value": 20, "max_value": 30}),
        Rule(17, "expect_column_max_to_be_between", "l_discount", {"max_value": 0.1}),
        Rule(18, "expect_column_stdev_to_be_between", "l_quantity", {"min_value": 1, "max_value": 20}),
        Rule(19, "expect_table_row_count_to_be_between", None, {"min_value": 1}),
        Rule(20, COLUMNS + "not_be_in_set", "l_linenumber", {"value_set": [7]}),
    ]


_SUITE_COUNTS = [
    *[Counts(i, f"{c} IS NULL") for i, c in enumerate(
        ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"], 1)],
    Counts(7, "l_quantity < 2 OR l_quantity > 49", missing="FALSE"), Counts(8, "l_discount < 0 OR l_discount > 0.09", missing="FALSE"),
    Counts(9, "l_tax < 0 OR l_tax > 0.08", missing="FALSE"),
    Counts(10, "l_extendedprice < 1000 OR l_extendedprice > 90000", missing="FALSE", mostly=0.9),
    Counts(11, "l_returnflag NOT IN ('A', 'N', 'R')", missing="FALSE"), Counts(12, "l_linestatus NOT IN ('O')", missing="FALSE"),
    Counts(13, "NOT regexp_full_match(l_returnflag, 'A|R')", missing="FALSE"), Counts(14, "length(l_linestatus) <> 1", missing="FALSE"),
    Counts(15, "NOT (l_extendedprice > l_quantity)", missing="FALSE", of_nonmissing=True),
    Counts(20, "l_linenumber IN (7)", missing="FALSE"),
]


@query("m3_fused_suite", row_oracle("lineitem", *_SUITE_COUNTS) + """
    UNION ALL SELECT r::BIGINT, ok, n, 0::BIGINT, (CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT, (CASE WHEN ok THEN 0.0 ELSE 100.0 END)::DOUBLE FROM (
      SELECT 16 AS r, avg(l_quantity) BETWEEN 20 AND 30 AS ok, count(*) AS n FROM lineitem
      UNION ALL SELECT 17, max(l_discount) <= 0.1, count(*) FROM lineitem
      UNION ALL SELECT 18, stddev_samp(l_quantity) BETWEEN 1 AND 20, count(*) FROM lineitem)
    UNION ALL SELECT 19, count(*) >= 1, count(*), NULL, (CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END)::BIGINT, 0.0::DOUBLE FROM lineitem""")
def fused_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(Dataset("lineitem", frame(spark, sf_dir, "lineitem")), suite_rules()).select(
        "rule_config_id", "is_success", "element_count", "missing_count", "unexpected_count",
        F.round("unexpected_percent", 6).alias("unexpected_percent"),
    )


@query("m4_run_summary", with_fixtures("""
    SELECT dataset_run_id, dataset_id, count(*) AS evaluated_expectations, count(*) FILTER (WHERE status = 'SUCCESS') AS successful_expectations,
           count(*) FILTER (WHERE status = 'FAILURE') AS unsuccessful_expectations, count(*) FILTER (WHERE status = 'ERROR') AS error_expectations,
           CASE WHEN count(*) FILTER (WHERE status = 'ERROR') > 0 THEN 'ERROR' WHEN count(*) FILTER (WHERE status = 'FAILURE') > 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS run_status,
           round(count(*) FILTER (WHERE status = 'SUCCESS') * 100.0 / count(*), 6)::DOUBLE AS success_percent
    FROM rule_results GROUP BY dataset_run_id, dataset_id""", "rule_results"))
def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = run_summary(frame(spark, sf_dir, "rule_results"))
    return summary.withColumn("success_percent", F.round("success_percent", 6))


PART_HEADERS = [
    pivot.RuleHeader(1, "SIZE_TEXT_Completeness_NULL_CHECK_1"),
    pivot.RuleHeader(2, "P_SIZE_Validity_RANGE_CHECK(5_40)_2"),
    pivot.RuleHeader(3, "SIZE_TEXT_Validity_DATATYPE_CHECK(NUMBER)_3"),
]


def _part_metadata(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    import json

    rules = local_frame(
        spark, [(r.rule_id, r.expectation_id, r.column, json.dumps(r.kwargs)) for r in PART_RULES],
        "rule_config_id bigint, expectation_id bigint, column_name string, kwargs string",
    )
    master = local_frame(spark, [
        (1, "NULL_CHECK", "Completeness", "ROW"), (10, "RANGE_CHECK", "Validity", "ROW"),
        (7, "DATATYPE_CHECK", "Validity", "ROW"), (30, "COUNT_CHECK", "Volume", "TABLE"),
        (17, "UNIQUE_CHECK", "Uniqueness", "ROW"),
    ], "expectation_id bigint, check_type string, dimension string, check_level string")
    return rules, master


def _flag(rule: int, name: str) -> str:
    return f"CASE WHEN max(CASE WHEN {_RULE_SQL[rule]} THEN 1 ELSE 0 END) = 1 THEN 'FAIL' ELSE 'PASS' END AS \"{name}\""


@query("m5_failure_pivot", with_fixtures(f"""
    SELECT 1::BIGINT AS dataset_run_id, 3::BIGINT AS dataset_id, 'part_texts' AS dataset_name,
           {', '.join(_flag(h.rule_config_id, h.header) for h in PART_HEADERS)}, {_PART_COLUMNS}
    FROM part_texts WHERE {_RULE_SQL[1]} OR {_RULE_SQL[2]} OR {_RULE_SQL[3]} GROUP BY ALL""", "part_texts"))
def failure_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_suite(_parts(spark, sf_dir), PART_RULES, run_id=1)
    headers = [h for h in pivot.rule_headers(run.results, *_part_metadata(spark)) if h.check_level == "ROW"]
    table = pivot.failure_pivot(run.failed_rows(), headers, run_id=1, dataset_id=3, dataset_name="part_texts")
    return table.drop("export_timestamp")


def _history_sql() -> str:
    names = [PART_HEADERS[0].header, PART_HEADERS[1].header, PART_HEADERS[2].header, "TABLE_Volume_COUNT_CHECK_4"]
    cells = {
        1: [f"CASE WHEN {_RULE_SQL[1]} THEN 'FAIL' ELSE 'PASS' END", f"CASE WHEN {_RULE_SQL[2]} THEN 'FAIL' ELSE 'PASS' END",
            "'NOT CONFIGURED'", "'FAIL - TABLE CHECK'"],
        2: ["'NOT CONFIGURED'", f"CASE WHEN {_RULE_SQL[2]} THEN 'FAIL' ELSE 'PASS' END",
            f"CASE WHEN {_RULE_SQL[3]} THEN 'FAIL' ELSE 'PASS' END", "'NOT CONFIGURED'"],
    }
    where = {1: f"{_RULE_SQL[1]} OR {_RULE_SQL[2]}", 2: f"{_RULE_SQL[2]} OR {_RULE_SQL[3]}"}
    return " UNION ALL ".join(
        f"SELECT {run}::BIGINT AS dataset_run_id, 3::BIGINT AS dataset_id, 'part_texts' AS dataset_name, "
        + ", ".join(f'{c} AS "{n}"' for c, n in zip(cells[run], names))
        + f", {_PART_COLUMNS} FROM part_texts WHERE {where[run]}"
        for run in (1, 2)
    )


@query("m6_failure_history", with_fixtures(_history_sql(), "part_texts"))
def failure_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    first = run_suite(parts, [PART_RULES[0], PART_RULES[1], PART_RULES[3]], run_id=1)
    second = run_suite(parts, [PART_RULES[1], PART_RULES[2]], run_id=2)
    results = first.results.unionByName(second.results)
    failed = first.failed_rows().unionByName(second.failed_rows())
    runs = pivot.recent_run_ids(first.summary.unionByName(second.summary), 3, 2)
    headers = pivot.rule_headers(results, *_part_metadata(spark), failed_only=False, run_ids=runs, dataset_id=3)
    return pivot.failure_history(failed, results, headers, dataset_id=3, dataset_name="part_texts").drop("dq_timestamp")


_BROKEN = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _RULE_SQL.values())
_ANY_RULE = f"({_RULE_SQL[1]} OR {_RULE_SQL[2]} OR {_RULE_SQL[3]})"


@query("m8_full_run", with_fixtures(f"""
    SELECT 'results' AS part, 4::BIGINT AS n UNION ALL
    SELECT 'failed_rows', (SELECT sum({_BROKEN}) FROM part_texts)::BIGINT UNION ALL
    SELECT 'failed_keys', (SELECT sum({_BROKEN}) FROM part_texts)::BIGINT UNION ALL
    SELECT 'failure_file', (SELECT count(*) FROM part_texts WHERE {_ANY_RULE}) UNION ALL
    SELECT 'run_log_evaluated', 4 UNION ALL SELECT 'run_log_unsuccessful', 3 UNION ALL SELECT 'run_log_errors', 1 UNION ALL
    SELECT 'audit', 7""", "part_texts"))
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset and rules from configuration, one run, and what it left behind, read back."""
    config = local_frame(spark, [(3, "part_texts", "QUERY", "SELECT * FROM parts_given", '{"primary_key": ["p_partkey"]}', False)],
                         "dataset_id bigint, dataset_name string, dataset_type string, custom_sql string, primary_key_columns string, is_incremental boolean")
    rules, master = _part_metadata(spark)
    chosen = rules.where("rule_config_id <= 3").union(local_frame(
        spark, [(9, 1, "size_text", "not json")], "rule_config_id bigint, expectation_id bigint, column_name string, kwargs string"))
    handled = {1: PART_RULES[0].expectation, 10: PART_RULES[1].expectation, 7: PART_RULES[2].expectation}
    named = F.coalesce(*[F.when(F.col("expectation_id") == k, v) for k, v in handled.items()])
    rules = chosen.withColumns({"dataset_id": F.lit(3), "is_active": F.lit(True), "dq_engine": F.lit("SQL"),
                                "dimension": F.lit("Validity"), "expectation_name": named})
    handlers = local_frame(spark, [(v, v, True) for v in handled.values()], "expectation_type string, handler string, is_active boolean")
    out = execution.execute_dataset(
        spark, config, rules, master.withColumn("validation_name", named), handlers, 3, run_id=5, target=scratch(spark),
        tables={"parts_given": frame(spark, sf_dir, "part_texts")},
    )
    log = out.read("run_log")
    counts = [out.read(p).select(F.lit(p).alias("part")) for p in ("results", "failed_rows", "failed_keys", "audit")]
    counts.append(spark.read.option("header", True).option("multiLine", True).csv(out.failure_file).select(F.lit("failure_file").alias("part")))
    found = reduce(DataFrame.union, counts).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return found.union(log.select(F.inline(F.array(*[
        F.struct(F.lit(f"run_log_{k}").alias("part"), F.col(f"{k}_expectations" if k != "unsuccessful" else "unsuccessful_expectations").alias("n"))
        for k in ("evaluated", "unsuccessful")
    ] + [F.struct(F.lit("run_log_errors").alias("part"), F.col("error_expectations").alias("n"))]))))


_LATEST = "(SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 2 = 0)"


@query("x2_increments_lose_nothing", f"""
    WITH early AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 0),
    late AS (SELECT count(*) AS n FROM orders WHERE o_orderdate > {_LATEST})
    SELECT 1::BIGINT AS dataset_run_id, n AS element_count, 1::BIGINT AS attempts FROM early
    UNION ALL SELECT 2, n, 2 FROM late""")
def increments_lose_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows arrive while a run is on, and a run id is repeated: each row is validated by one run, each run kept once."""
    orders, folder, target = frame(spark, sf_dir, "orders"), scratch(spark), scratch(spark)
    orders.where("o_orderkey % 2 = 0").write.parquet(f"{folder}/orders")
    config = local_frame(spark, [(3, "orders_given", "TABLE", "orders_given", True, "o_orderdate")],
                         "dataset_id bigint, dataset_name string, dataset_type string, table_name string, is_incremental boolean, incr_date_column_1 string")
    named = COLUMNS + "not_be_null"
    rules = local_frame(spark, [(1, 1, "o_custkey", "{}", 3, True, "SQL", "Validity", named)],
                        "rule_config_id bigint, expectation_id bigint, column_name string, kwargs string, dataset_id int, is_active boolean, dq_engine string, dimension string, expectation_name string")
    master = local_frame(spark, [(1, "NULL_CHECK", "Completeness", "ROW", named)], "expectation_id bigint, check_type string, dimension string, check_level string, validation_name string")
    handlers = local_frame(spark, [(named, named, True)], "expectation_type string, handler string, is_active boolean")

    def run(run_id: int, log: DataFrame | None) -> execution.Execution:
        given = {"orders_given": spark.read.schema(orders.schema).parquet(f"{folder}/orders")}
        return execution.execute_dataset(spark, config, rules, master, handlers, 3, run_id=run_id, target=target, tables=given, run_log=log)

    first = run(1, None)
    # What is newer than the first run's bound arrives before that run is read.
    orders.where("o_orderkey % 2 = 1").write.mode("append").parquet(f"{folder}/orders")
    run(2, first.read("run_log"))
    last = run(2, first.read("run_log"))
    tried = execution.manifest(spark, target).groupBy("dataset_run_id").agg(F.count(F.lit(1)).alias("attempts"))
    return last.read("results").join(tried, "dataset_run_id").select("dataset_run_id", "element_count", "attempts")


@query("m7_audit_trail", with_fixtures("""
    SELECT * FROM (SELECT NULL::BIGINT AS rule_config_id, 'RULES_FETCHING' AS step_name, 'COMPLETED' AS status
    UNION ALL SELECT 1, 'RULE', 'COMPLETED' UNION ALL SELECT 2, 'RULE', 'COMPLETED' UNION ALL SELECT 99, 'RULE', 'FAILED'
    UNION ALL SELECT NULL, 'SQL_EXECUTION', 'ERROR') WHERE (SELECT count(*) FROM part_texts) > 0""", "part_texts"))
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_suite(_parts(spark, sf_dir), [*PART_RULES[:2], Rule(99, COLUMNS + "not_be_null", "no_such_column")], run_id=1)
    return run.audit.select("rule_config_id", "step_name", "status")
