"""Edge cases of the expectations on small hand-made frames."""

from __future__ import annotations

import json

import pytest

from plumbline import Dataset, Rule, evaluate, run_suite
from plumbline.operators.base import Context, Options
from plumbline.operators.group_checks import distinct_mismatches, most_common_values
from plumbline.operators.registry import ALIASES, EXPECTATIONS, catalogue
from plumbline.plans import fusion

V = "expect_column_values_to_"


def results(spark, rows, schema, rules, **kwargs):
    frame = spark.createDataFrame(rows, schema)
    key = tuple(kwargs.pop("key", ()))
    found = evaluate(Dataset("t", frame, primary_key=key), rules, **kwargs).collect()
    return {r["rule_config_id"]: r.asDict() for r in found}


def test_blank_counts_as_missing_and_null_alike(spark):
    rows = [("a",), ("  ",), ("",), (None,)]
    r = results(spark, rows, "c string", [Rule(1, V + "not_be_null", "c"), Rule(2, V + "be_null", "c")])
    assert r[1]["unexpected_count"] == 3 and r[1]["missing_count"] is None
    assert r[2]["unexpected_count"] == 1


def test_empty_table_passes_row_checks_and_fails_scalar_checks(spark):
    rules = [
        Rule(1, V + "not_be_null", "c"), Rule(2, V + "be_between", "c", {"min_value": 1, "max_value": 2}),
        Rule(3, "expect_column_mean_to_be_between", "c", {"min_value": 0}),
        Rule(4, V + "be_unique", "c"), Rule(5, "expect_column_most_common_value_to_be_in_set", "c", {"value_set": [1]}),
        Rule(6, "expect_column_proportion_of_unique_values_to_be_between", "c", {"max_value": 0}),
        Rule(7, V + "be_in_set", "c", {"value_set": [1]}),
        Rule(8, "expect_column_value_z_scores_to_be_less_than", "c", {"threshold": 1}),
    ]
    r = results(spark, [], "c int", rules)
    assert [r[i]["is_success"] for i in range(1, 9)] == [True, True, False, True, False, True, True, True]
    assert all(r[i]["element_count"] == 0 for i in r)
    assert r[1]["unexpected_percent"] == 0.0


def test_all_null_column(spark):
    r = results(spark, [(None,), (None,)], "c double", [
        Rule(1, V + "be_between", "c", {"min_value": 0, "max_value": 1}),
        Rule(2, "expect_column_min_to_be_between", "c", {"min_value": 0}),
        Rule(3, "expect_column_median_to_be_between", "c", {}),
        Rule(4, "expect_column_value_z_scores_to_be_less_than", "c", {"threshold": 3}),
    ])
    assert r[1]["is_success"] and r[1]["missing_count"] == 2 and r[1]["missing_percent"] == 100.0
    assert not r[2]["is_success"] and r[2]["unexpected_percent"] == 100.0
    assert not r[3]["is_success"]
    assert r[4]["is_success"] and r[4]["element_count"] == 0


def test_strict_bounds_at_the_bound(spark):
    rows = [(1,), (5,), (10,)]
    r = results(spark, rows, "c int", [
        Rule(1, V + "be_between", "c", {"min_value": 1, "max_value": 10}),
        Rule(2, V + "be_between", "c", {"min_value": 1, "max_value": 10, "strict_min": True}),
        Rule(3, V + "be_between", "c", {"min_value": 1, "max_value": 10, "strict_min": "true", "strict_max": True}),
        Rule(4, "expect_column_max_to_be_between", "c", {"max_value": 10, "strict_max": True}),
        Rule(5, "expect_column_max_to_be_between", "c", {"max_value": 10}),
    ])
    assert [r[i]["unexpected_count"] for i in (1, 2, 3)] == [0, 1, 2]
    assert (r[4]["is_success"], r[5]["is_success"]) == (False, True)


def test_mostly_at_the_boundary(spark):
    rows = [(None,)] * 1 + [("x",)] * 3
    r = results(spark, rows, "c string", [
        Rule(1, V + "not_be_null", "c", {"mostly": 0.75}), Rule(2, V + "not_be_null", "c", {"mostly": 0.76}),
        # 1 - 0.95 is a little more than 0.05, and 1 - 0.9 a little less than 0.1.
        Rule(3, V + "match_regex", "c", {"regex": "x", "mostly": "0.75"}),
    ])
    assert [r[i]["is_success"] for i in (1, 2, 3)] == [True, False, True]


def test_regex_alternation_is_anchored_as_a_whole(spark):
    rows = [("a",), ("b",), ("ab",), ("xb",)]
    r = results(spark, rows, "c string", [
        Rule(1, V + "match_regex", "c", {"regex": "a|b"}), Rule(2, V + "not_match_regex", "c", {"regex": "a|b"}),
    ])
    assert r[1]["unexpected_count"] == 2 and r[2]["unexpected_count"] == 2


def test_text_numerals_in_ranges_and_sums(spark):
    rows = [("三百二十一", "1"), ("−五点五", "2"), ("一万二千", None), ("abc", "4"), ("", "5"), (None, "6")]
    r = results(spark, rows, "c string, d string", [
        Rule(1, V + "be_between", "c", {"min_value": 0, "max_value": 1000}),
        Rule(2, "expect_column_sum_to_be_between", "c", {"min_value": 12315, "max_value": 12316}),
        Rule(3, "expect_column_pair_values_a_to_be_greater_than_b", None, {"column_A": "c", "column_B": "d"}),
    ])
    assert r[1]["unexpected_count"] == 2 and r[1]["missing_count"] == 2
    assert r[2]["is_success"] and float(r[2]["observed_value"]) == 12315.5
    assert r[3]["unexpected_count"] == 1 and r[3]["missing_count"] == 2


def test_mode_ties(spark):
    rows = [("a",), ("a",), ("b",), ("b",), ("c",), (None,)]
    rule = "expect_column_most_common_value_to_be_in_set"
    r = results(spark, rows, "c string", [
        Rule(1, rule, "c", {"value_set": ["a"]}), Rule(2, rule, "c", {"value_set": ["a"], "ties_okay": True}),
        Rule(3, rule, "c", {"value_set": ["a", "b"]}), Rule(4, rule, "c", {"value_set": ["c"], "ties_okay": True}),
    ])
    assert [r[i]["is_success"] for i in (1, 2, 3, 4)] == [False, True, True, False]
    assert json.loads(r[1]["observed_value"]) == ["a", "b"]
    dataset = Dataset("t", spark.createDataFrame(rows, "c string"))
    assert {(x["value"], x["n"]) for x in most_common_values(dataset, "c").collect()} == {("a", 2), ("b", 2)}


def test_value_sets_as_json_text_and_mixed_types(spark):
    rows = [(1, 1.0, "1"), (2, 2.5, " 1"), (3, 5.0, None)]
    r = results(spark, rows, "i int, d double, s string", [
        Rule(1, V + "be_in_set", "i", {"value_set": '["1", 2]'}), Rule(2, V + "be_in_set", "d", {"value_set": [1, "5"]}),
        Rule(3, V + "be_in_set", "s", {"value_set": [1]}), Rule(4, V + "not_be_in_set", "s", {"value_set": ["1"]}),
    ])
    assert [r[i]["unexpected_count"] for i in (1, 2, 3, 4)] == [1, 1, 1, 1]
    assert json.loads(r[3]["results"])["total_reference_values"] == 1
    assert json.loads(r[2]["observed_value"]) == {"1": 1, "5": 1}


def test_large_value_set_gives_the_same_as_a_small_one(spark):
    rows = [(f"v{i % 50}",) for i in range(500)] + [("other",), (" ",), (None,)]
    small, large = [f"v{i}" for i in range(30)], [f"v{i}" for i in range(30)] + [f"w{i}" for i in range(3000)]
    r = results(spark, rows, "c string", [
        Rule(1, V + "be_in_set", "c", {"value_set": small}), Rule(2, V + "be_in_set", "c", {"value_set": large}),
    ])
    for k in ("element_count", "missing_count", "unexpected_count", "observed_value"):
        assert r[1][k] == r[2][k]
    assert json.loads(r[2]["results"])["distinct_match_count"] == 30


def test_pair_sets_are_null_safe(spark):
    rows = [("a", 1), ("a", None), (None, None), ("b", 2)]
    r = results(spark, rows, "x string, y int", [
        Rule(1, "expect_column_pair_values_to_be_in_set", None, {
            "column_list": ["x", "y"], "value_pairs_set": [["a", "1"], ["a", None]], "ignore_row_if": "neither"}),
        Rule(2, "expect_column_pair_values_to_be_in_set", None, {
            "column_A": "x", "column_B": "y", "value_pairs_set": [["a", 1]]}),
        Rule(3, "expect_column_pair_values_to_be_equal", None, {"column_A": "x", "column_B": "x"}),
    ])
    assert (r[1]["unexpected_count"], r[1]["element_count"]) == (2, 4)
    assert (r[2]["unexpected_count"], r[2]["element_count"], r[2]["missing_count"]) == (2, 3, 1)
    assert r[3]["is_success"]


def test_unique_counts_all_copies_and_compound_only_the_surplus(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None), (None, None)]
    r = results(spark, rows, "k int, v string", [
        Rule(1, V + "be_unique", "k"),
        Rule(2, "expect_compound_columns_to_be_unique", None, {"column_list": ["k", "v"]}),
        Rule(3, "expect_compound_columns_to_be_unique", None, {"column_list": ["k", "v"], "ignore_row_if": "any_value_is_missing"}),
    ])
    assert (r[1]["unexpected_count"], r[1]["missing_count"]) == (5, 1)
    assert (r[2]["unexpected_count"], r[2]["element_count"]) == (2, 6)
    assert (r[3]["unexpected_count"], r[3]["element_count"], r[3]["missing_count"]) == (1, 3, 3)


def test_types(spark):
    rows = [("1.5", 1, True), ("x", 2, False), ("1.5d", 3, None), (" ", 4, True)]
    r = results(spark, rows, "s string, i int, b boolean", [
        Rule(1, V + "be_of_type", "s", {"type_": "INT"}), Rule(2, V + "be_of_type", "s", {"type_": "FLOAT"}),
        Rule(3, V + "be_of_type", "i", {"type_": "STRING"}), Rule(4, V + "be_of_type", "i", {"type_": "BOOLEAN"}),
        Rule(5, V + "be_of_type", "b", {"type_": "TIMESTAMP_NTZ"}), Rule(6, V + "be_of_type", "i", {"type_": "NO_SUCH"}),
    ])
    assert [r[i]["unexpected_count"] for i in (1, 2, 3, 4, 5)] == [2, 2, 0, 4, 4]
    assert r[1]["missing_count"] == 1 and r[6]["status"] == "ERROR"


def test_constant_column_passes_the_z_score_check_with_its_statistics(spark):
    r = results(spark, [(3.0,), (3.0,)], "c double", [
        Rule(1, "expect_column_value_z_scores_to_be_less_than", "c", {"threshold": 0.1})])
    assert r[1]["is_success"] and json.loads(r[1]["observed_value"]) == {"mean": 3.0, "stddev": 0.0}


def test_freshness_with_zone(spark):
    rows = [("2024-01-01 00:00:00",)]
    frame = spark.createDataFrame(rows, "t string").selectExpr("cast(t as timestamp_ntz) AS t")
    name = "expect_column_values_to_be_fresh"
    rules = [
        Rule(1, name, "t", {"freshness_threshold_value": 1, "freshness_threshold_unit": "hours"}),
        Rule(2, name, "t", {"freshness_threshold_value": 10, "freshness_threshold_unit": "HOUR"}),
        # Midnight in Tokyo is 15:00 UTC of the day before.
        Rule(3, name, "t", {"freshness_threshold_value": 10, "freshness_threshold_unit": "HOUR", "timezone": "Asia/Tokyo"}),
    ]
    found = evaluate(Dataset("t", frame), rules, as_of="2024-01-01 08:00:00").collect()
    assert {r["rule_config_id"]: r["is_success"] for r in found} == {1: False, 2: True, 3: False}


def test_ordered_columns_notice_different_lengths(spark):
    r = results(spark, [(1, 2)], "a int, b int", [
        Rule(1, "expect_table_columns_to_match_ordered_list", None, {"column_list": ["a"]}),
        Rule(2, "expect_table_columns_to_match_ordered_list", None, {"column_list": ["a", "b"]}),
    ])
    assert (r[1]["unexpected_count"], r[1]["is_success"]) == (1, False) and r[2]["is_success"]


def test_bad_rules_become_errors_and_leave_the_others_alone(spark):
    r = results(spark, [(1,)], "c int", [
        Rule(1, V + "not_be_null", "missing"), Rule(2, V + "match_regex", "c", {"regex": "("}),
        Rule(3, "no_such_expectation", "c"), Rule(4, V + "be_between", "c", {"min_value": 1}),
        Rule(5, V + "not_be_null", "c"), Rule(6, "unexpected_rows_expectation", None, {"unexpected_rows_query": "selec 1"}),
    ])
    assert [r[i]["status"] for i in range(1, 7)] == ["ERROR"] * 4 + ["SUCCESS", "ERROR"]
    assert all(r[i]["error_message"] for i in (1, 2, 3, 4, 6))


def test_a_rule_that_fails_while_running_is_isolated(spark):
    frame = spark.createDataFrame([(1,), (0,)], "c int")
    run = run_suite(Dataset("t", frame), [
        Rule(1, V + "not_be_null", "c"),
        Rule(2, "unexpected_rows_expectation", None, {"unexpected_rows_query": "select 1 / c as x from t where 1 / c > 0"}),
    ], run_id=1)
    status = {r["rule_config_id"]: r["status"] for r in run.results.collect()}
    assert status == {1: "SUCCESS", 2: "ERROR"} and run.status == "ERROR"


def test_column_names_ignore_case_and_may_need_quotes(spark):
    r = results(spark, [(1, 2)], "`odd name` int, `a.b` int", [
        Rule(1, V + "not_be_null", "ODD NAME"), Rule(2, V + "be_between", "a.b", {"min_value": 0, "max_value": 1}),
        Rule(3, V + "be_unique", "a.b"),
    ])
    assert [r[i]["status"] for i in (1, 2, 3)] == ["SUCCESS", "FAILURE", "SUCCESS"]


def test_batched_scans_give_the_same_results(spark):
    frame = spark.range(0, 2000).selectExpr("id", "cast(id % 17 as double) AS v", "cast(id % 5 as string) AS s")
    rules = [
        *[Rule(i, V + "be_between", "v", {"min_value": i, "max_value": 16}) for i in range(1, 12)],
        Rule(20, "expect_column_median_to_be_between", "v", {"min_value": 8, "max_value": 8}),
        Rule(21, "expect_column_value_z_scores_to_be_less_than", "v", {"threshold": 1.0}),
    ]
    one = evaluate(Dataset("t", frame), rules).collect()
    many = evaluate(Dataset("t", frame), rules, options=Options(aggregates_per_scan=5)).collect()
    assert sorted(one) == sorted(many)


def test_fused_and_single_rule_runs_agree_and_failed_rows_match_counts(spark):
    frame = spark.createDataFrame(
        [(i, i % 7 if i % 5 else None, f"t{i % 3}" if i % 4 else " ") for i in range(200)], "id int, n int, s string")
    dataset = Dataset("t", frame, primary_key=("id",))
    rules = [
        Rule(1, V + "not_be_null", "n"), Rule(2, V + "be_between", "n", {"min_value": 1, "max_value": 5}),
        Rule(3, V + "match_regex", "s", {"regex": "t[01]"}), Rule(4, V + "be_in_set", "s", {"value_set": ["t0"]}),
        Rule(5, V + "be_unique", "n"), Rule(6, "expect_compound_columns_to_be_unique", None, {"column_list": ["n", "s"]}),
        Rule(7, "expect_column_value_lengths_to_equal", "s", {"value": 2}),
        Rule(8, "expect_column_value_z_scores_to_be_less_than", "n", {"threshold": 1.0, "failed_row_count": 3}),
        Rule(9, V + "be_in_set", "s", {"value_set": [f"t{i}" for i in range(1, 50)]}),
    ]
    together = {r["rule_config_id"]: r for r in evaluate(dataset, rules).collect()}
    for rule in rules:
        assert evaluate(dataset, [rule]).collect()[0] == together[rule.rule_id]
    plan = fusion.plan_rules(Context(dataset), rules, 5)
    counts = {r["rule_config_id"]: r["count"] for r in fusion.failed_rows(plan).groupBy("rule_config_id").count().collect()}
    for rule in rules:
        expected = 3 if rule.rule_id == 8 else together[rule.rule_id]["unexpected_count"]
        assert counts.get(rule.rule_id, 0) == expected, rule


def test_one_scan_for_all_row_rules(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 AS m").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    result = evaluate(Dataset("t", frame), [
        Rule(1, V + "not_be_null", "id"), Rule(2, V + "be_between", "m", {"min_value": 0, "max_value": 1}),
        Rule(3, "expect_column_mean_to_be_between", "id", {"min_value": 0}), Rule(4, "expect_table_row_count_to_equal", None, {"value": 100}),
    ])
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_increment_reaches_the_scan_as_a_filter(spark, tmp_path):
    spark.range(100).selectExpr("id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) AS ts").write.parquet(str(tmp_path / "t"))
    dataset = Dataset("t", spark.read.parquet(str(tmp_path / "t")), incremental_columns=(None, "ts"), last_validated="2024-03-01 00:00:00")
    result = evaluate(dataset, [Rule(1, V + "not_be_null", "id")])
    assert result.collect()[0]["element_count"] == 39
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in result._jdf.queryExecution().executedPlan().toString()


def test_mismatches_are_complete(spark):
    dataset = Dataset("t", spark.createDataFrame([(1.0,), (1.0,), (2.5,)], "c double"))
    found = {(r["value"], r["n"], r["side"]) for r in distinct_mismatches(dataset, "c", [1, "7"]).collect()}
    assert found == {("1.0", 2, "match"), ("2.5", 1, "extra"), ("7.0", 0, "missing")}


def test_catalogue_lists_every_expectation(spark):
    names = {r["expectation_name"] for r in catalogue(spark).collect()}
    assert names == set(EXPECTATIONS) | set(ALIASES) and len(EXPECTATIONS) == 43


@pytest.mark.parametrize("text", ["[1, 2", "['a' 'b']"])
def test_broken_lists_are_rule_errors(spark, text):
    r = results(spark, [(1,)], "c int", [Rule(1, V + "be_in_set", "c", {"value_set": text})])
    assert r[1]["status"] == "ERROR"


def test_set_results_do_not_depend_on_the_size_of_the_set(spark):
    frame = spark.createDataFrame([(5.0,), (6.0,), (6.0,), (7.5,)], "v double")
    few, many = ["5", "5.0", 6], ["5", "5.0", 6, *range(100, 160)]
    rows = evaluate(Dataset("t", frame), [
        Rule(1, "expect_column_values_to_be_in_set", "v", {"value_set": few}),
        Rule(2, "expect_column_values_to_be_in_set", "v", {"value_set": many}),
    ]).orderBy("rule_config_id").collect()
    assert [json.loads(r["observed_value"]) for r in rows] == [{"5": 1, "6": 2}] * 2
    assert [json.loads(r["results"])["distinct_match_count"] for r in rows] == [2, 2]


def test_patterns_that_only_python_knows_are_one_error(spark):
    rows = evaluate(Dataset("t", spark.createDataFrame([("x",)], "s string")), [
        Rule(1, "expect_column_values_to_match_regex", "s", {"regex": "(?P<x>a)"}),
        Rule(2, "expect_column_values_to_match_regex", "s", {"regex": "x"}),
    ]).orderBy("rule_config_id").collect()
    assert [r["status"] for r in rows] == ["ERROR", "SUCCESS"]


def test_exact_numbers_beyond_doubles(spark):
    frame = spark.createDataFrame([(2**53 + 1,)], "n long").selectExpr("n", "cast(6 as decimal(38,0)) AS d", "cast('100000000000000000001' as decimal(38,0)) AS w")
    rows = {r["rule_config_id"]: r for r in evaluate(Dataset("t", frame), [
        Rule(1, V + "be_between", "d", {"min_value": 0, "max_value": 5.5}), Rule(2, V + "be_between", "w", {"min_value": 0, "max_value": 10**20}),
        Rule(3, "expect_column_max_to_be_between", "n", {"max_value": 2**53}), Rule(4, "expect_column_sum_to_be_between", "n", {"max_value": 2**53}),
        Rule(5, "expect_column_min_to_be_between", "n", {"min_value": 2**53 + 2}),
        Rule(6, "expect_multicolumn_sum_to_equal", None, {"column_list": ["n", "n"], "sum_total": 2**54}),
        Rule(7, "expect_multicolumn_sum_to_equal", None, {"column_list": ["n", "n"], "sum_total": 2**54 + 2}),
        Rule(8, V + "be_between", "n", {"min_value": float("-inf"), "max_value": float("inf")}),
    ]).collect()}
    assert [rows[k]["is_success"] for k in range(1, 9)] == [False, False, False, False, False, False, True, True]
    assert rows[3]["observed_value"] == rows[4]["observed_value"] == rows[5]["observed_value"] == str(2**53 + 1)


def test_a_sum_of_more_than_38_digits_is_a_double(spark):
    frame = spark.createDataFrame([(1,)] * 30, "n int").selectExpr("cast('9e36' as decimal(38,0)) AS w")
    row = evaluate(Dataset("t", frame), [Rule(1, "expect_column_sum_to_be_between", "w", {"min_value": 1e38, "max_value": 1e39})]).first()
    assert row["is_success"] and float(row["observed_value"]) == pytest.approx(2.7e38)


def test_queries_of_rules_leave_views_alone(spark):
    spark.createDataFrame([(7,)], "x int").createOrReplaceTempView("orders")
    frame, other = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,)], "y int")
    run = run_suite(Dataset("orders", frame), [
        Rule(1, "unexpected_rows_expectation", None, {"unexpected_rows_query": "WITH o AS (SELECT * FROM orders) SELECT o.*, p.* FROM o JOIN parts p ON x = y -- both"}),
        Rule(2, "unexpected_rows_expectation", None, {"unexpected_rows_query": "SELECT x FROM Orders ORDER BY x LIMIT 1;"}),
    ], run_id=1, datasets={"parts": Dataset("parts", other)})
    assert [r["unexpected_count"] for r in run.results.orderBy("rule_config_id").collect()] == [1, 1]
    assert spark.table("orders").first()["x"] == 7 and not spark.catalog.tableExists("parts")
    assert run.failed_rows().count() == 2
    spark.catalog.dropTempView("orders")
