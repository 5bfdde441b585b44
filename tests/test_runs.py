"""Sources, sinks, pivots and the stream."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from plumbline import Dataset, Rule, run_suite
from plumbline.operators import capture
from plumbline.plans import execution, pivot, reports
from plumbline.plans.suite import rules_from
from plumbline.sources.datasets import query_dataset, table_dataset
from plumbline.sources.reference_csv import export_csv, read_reference_csv, rejected_rows
from plumbline.streaming.incremental import validate_stream

V = "expect_column_values_to_"


def test_csv_keeps_quotes_blanks_and_nulls(spark, tmp_path):
    rows = [(1, 'say "hi", you', 1.5), (2, "", None), (3, None, 2.0), (4, " padded ", -1.0)]
    frame = spark.createDataFrame(rows, "i int, s string, d double")
    export_csv(frame, str(tmp_path / "out"), single_file=True)
    files = list((tmp_path / "out").glob("*.csv.gz"))
    assert len(files) == 1
    back = read_reference_csv(spark, str(tmp_path / "out"), frame.schema)
    assert sorted(back.collect()) == sorted(frame.collect())


def test_csv_null_markers_and_bad_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text('i,s\n1,NULL\nnan,b\n\\N,c\nx,d\n5,e,extra\n6,"f"\n')
    schema = T.StructType.fromDDL("i int, s string")
    path = str(tmp_path / "in.csv")
    kept = read_reference_csv(spark, path, schema, on_error="continue").collect()
    assert [tuple(r) for r in kept] == [(1, None), (None, "b"), (None, "c"), (6, "f")]
    assert {r["problem"] for r in rejected_rows(spark, path, schema).collect()} == {"i is not int", "wrong number of fields"}
    with pytest.raises(PySparkException, match="malformed reference row"):
        read_reference_csv(spark, path, schema).collect()
    with pytest.raises(ValueError):
        read_reference_csv(spark, path, schema, on_error="ignore")


def test_table_and_query_datasets(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "numbers"))
    table = table_dataset(spark, "numbers", str(tmp_path / "numbers"), dataset_id=4)
    query = query_dataset(spark, "even", "select id from numbers where id % 2 = 0", {"numbers": table.frame})
    assert (table.frame.count(), query.frame.count(), table.dataset_id) == (5, 3, 4)


def test_failed_keys_fall_back_to_the_candidate_key(spark):
    frame = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    run = run_suite(Dataset("t", frame, candidate_key=("id",)), [Rule(1, V + "not_be_null", "v")], run_id=3)
    assert [r["failed_key"] for r in run.failed_keys().collect()] == ['{"id":1}']
    assert [r["failed_row"] for r in capture.failed_records(run.failed_rows()).collect()] == ['{"id":1}']
    bare = run_suite(Dataset("t", frame), [Rule(1, V + "not_be_null", "v")], run_id=3)
    with pytest.raises(ValueError):
        bare.failed_keys()


def test_run_without_failures_has_no_failed_rows(spark):
    run = run_suite(Dataset("t", spark.range(3)), [Rule(1, V + "not_be_null", "id")], run_id=1)
    assert run.failed_rows() is None and run.status == "SUCCESS"
    assert run.summary.first()["success_percent"] == 100.0


def test_pivot_merges_duplicate_rows(spark):
    frame = spark.createDataFrame([(1, None), (1, None), (9, "a"), (2, "b")], "n int, s string")
    run = run_suite(Dataset("my set", frame, dataset_id=2), [
        Rule(1, V + "not_be_null", "s"), Rule(2, V + "be_between", "n", {"min_value": 0, "max_value": 5})], run_id=8)
    headers = [pivot.RuleHeader(1, "S_1"), pivot.RuleHeader(2, "N_2")]
    table = pivot.failure_pivot(run.failed_rows(), headers, run_id=8, dataset_id=2, dataset_name="my set")
    assert {(r["S_1"], r["N_2"], r["n"]) for r in table.collect()} == {("FAIL", "PASS", 1), ("PASS", "FAIL", 9)}
    assert table.count() == 2
    assert "my_set_DQ_FAILURE" in run.results.where("rule_config_id = 1").first()["results"]


def test_unparsable_arguments_are_errors_of_their_rule_only(spark):
    resolved = spark.createDataFrame(
        [(1, "c", 1, V + "not_be_null", "{bad", None, "h"), (2, "c", 1, V + "not_be_null", None, None, "h"),
         (3, "c", 1, V + "not_be_null", "[1]", None, V + "be_null")],
        "rule_config_id int, column_name string, expectation_id int, expectation_name string, kwargs string, dimension string, handler string")
    good, bad = rules_from(resolved)
    assert [r.rule_id for r in good] == [2] and [r.rule_id for r, _ in bad] == [1, 3]
    run = run_suite(Dataset("t", spark.createDataFrame([(1,)], "c int")), good, run_id=1, unparsed=bad)
    assert {r["rule_config_id"]: r["status"] for r in run.results.collect()} == {1: "ERROR", 2: "SUCCESS", 3: "ERROR"}


def test_error_metrics_count_blank_and_repeated_values(spark):
    frame = spark.createDataFrame([("x",), ("x ",), ("y",), (None,), ("ok",)], "c string")
    run = run_suite(Dataset("t", frame), [Rule(1, V + "match_regex", "c", {"regex": "ok"})], run_id=1)
    row = run.error_metrics().first()
    assert row["partial_unexpected_counts"] == '{"x":2,"y":1}'
    assert '"error_missing_count":1' in row["unexpected_rows"] and '"error_unique_count":2' in row["unexpected_rows"]


def test_flatten_record_with_awkward_keys(spark):
    frame = spark.createDataFrame([('{"a b":1,"n":{"x":2},"z":null}', 7)], "failed_row string, run int")
    row = reports.flatten_record(frame, ["a b", "n", "z", "none"]).first()
    assert (row["run"], row["a b"], row["n"], row["z"], row["none"]) == (7, "1", '{"x":2}', None, None)


def test_stream_validates_each_row_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id int, v string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        dataset = Dataset("t", spark.createDataFrame([], schema))
        validate_stream(stream, dataset, [Rule(1, V + "not_be_null", "v")], results_path=out,
                        checkpoint_path=str(tmp_path / "cp"), failed_rows_path=str(tmp_path / "failed")).awaitTermination()

    arrive([(1, "a"), (2, None)])
    run()
    arrive([(3, None), (4, None), (5, "b")])
    run()
    results = spark.read.parquet(out).orderBy("dataset_run_id").collect()
    assert [(r["element_count"], r["unexpected_count"]) for r in results] == [(2, 1), (3, 2)]
    assert spark.read.parquet(str(tmp_path / "failed")).select(F.sum("id")).first()[0] == 9


def configured(spark, kwargs="{}"):
    name = V + "not_be_null"
    config = spark.createDataFrame([(3, "t", "TABLE", "given", True, "ts", '{"primary_key": ["id"]}')],
        "dataset_id long, dataset_name string, dataset_type string, table_name string, is_incremental boolean, incr_date_column_1 string, primary_key_columns string")
    rules = spark.createDataFrame([(1, 1, "v", kwargs, 3, True, "SQL", "Validity", name)],
        "rule_config_id long, expectation_id long, column_name string, kwargs string, dataset_id int, is_active boolean, dq_engine string, dimension string, expectation_name string")
    master = spark.createDataFrame([(1, "NULL_CHECK", "Completeness", "ROW", name)], "expectation_id long, check_type string, dimension string, check_level string, validation_name string")
    return config, rules, master, spark.createDataFrame([(name, name, True)], "expectation_type string, handler string, is_active boolean")


def stamped(spark, rows):
    return spark.createDataFrame(rows, "id int, v string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_a_run_that_fails_half_way_leaves_nothing_and_a_repeated_one_replaces(spark, tmp_path, monkeypatch):
    tables = {"given": stamped(spark, [(1, "a", "2024-01-01"), (2, None, "2024-01-02"), (3, None, None)])}

    def run(run_id):
        return execution.execute_dataset(spark, *configured(spark), 3, run_id=run_id, target=str(tmp_path), tables=tables)

    first = run(1)
    before = {p: sorted(map(str, first.read(p).drop("run_timestamp", "load_timestamp", "failure_file", "created_timestamp", "run_time", "start_timestamp", "end_timestamp").collect()))
              for p in ("results", "failed_rows", "failed_keys", "run_log", "audit")}
    assert first.read("results").first()["element_count"] == 3 and first.read("failed_rows").count() == 2

    plain = execution.sinks.append

    def failing(df, target, **kwargs):
        if target.endswith("dq_rule_audit_log"):
            raise RuntimeError("lost")
        plain(df, target, **kwargs)

    monkeypatch.setattr(execution.sinks, "append", failing)
    with pytest.raises(RuntimeError):
        run(2)
    monkeypatch.setattr(execution.sinks, "append", plain)
    assert {r["dataset_run_id"] for r in first.read("results").collect()} == {1}
    again = run(1)
    for part, rows in before.items():
        shown = again.read(part).drop("run_timestamp", "load_timestamp", "failure_file", "created_timestamp", "run_time", "start_timestamp", "end_timestamp")
        assert sorted(map(str, shown.collect())) == rows, part
    assert execution.manifest(spark, str(tmp_path)).count() == 2


def test_increments_end_where_they_were_read(spark, tmp_path):
    early = [(1, "a", "2024-01-01"), (2, None, "2024-01-02"), (9, None, None)]
    dataset = execution.configured_dataset(spark, configured(spark)[0], 3, {"given": stamped(spark, early)})
    assert str(dataset.validate_until) == "2024-01-02 00:00:00"
    late = dataset.with_frame(stamped(spark, [*early, (3, "b", "2024-01-03")]))
    assert sorted(r["id"] for r in late.increment().collect()) == [1, 2, 9]
    out = execution.execute_dataset(spark, *configured(spark), 3, run_id=1, target=str(tmp_path), tables={"given": stamped(spark, early)})
    after = execution.configured_dataset(spark, configured(spark)[0], 3, {"given": late.frame}, out.read("run_log"), 2)
    assert [r["id"] for r in after.increment().collect()] == [3]
    same = execution.configured_dataset(spark, configured(spark)[0], 3, {"given": late.frame}, out.read("run_log"), 1)
    assert same.last_validated is None
