"""Operators against straightforward Python on small or skewed inputs."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline import Dataset, Rule
from plumbline.functions.numerals import numeral_text, numeral_value
from plumbline.functions.rows import numbered
from plumbline.operators import microsegments as seg
from plumbline.operators import profile as prof
from plumbline.operators import relationships as rel
from plumbline.operators.correlations import correlation_matrix, line_equations
from plumbline.operators.equations import EquationError, parse_equation, validate_equations
from plumbline.operators.group_checks import Repeated, surplus_copies
from plumbline.operators.lasso import fit_cross_validated, fit_fixed_alpha
from plumbline.operators.percentiles import column_percentiles, exact_percentiles


@pytest.mark.parametrize("text,value", [
    ("三百二十一", 321), ("−五点五", -5.5), ("-二", -2), ("一万二千", 12000), ("十", 10), ("千", 1000),
    ("三兆五億", 3000500000000), ("五・二五", 5.25), ("二〇", 0), ("abc", None), ("", None), ("  ", None), (None, None),
    ("12", 12), (" 7 ", 7), ("1_000", 1000), ("1e3", 1000), ("1.5d", None), ("一点x", None), ("3万", None), (".", None),
])
def test_numeral_values(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(numeral_value(F.col("t"))).first()[0]
    assert got == value


def spoken(n: int) -> str:
    """Japanese reading of a whole number, digit by digit."""
    if n == 0:
        return "零"
    groups, out = [], ""
    while n:
        n, g = divmod(n, 10_000)
        groups.append(g)
    for i in reversed(range(len(groups))):
        digits = f"{groups[i]:04d}"
        for place, d in enumerate(digits):
            if d != "0":
                out += ("" if d == "1" and place < 3 else "〇一二三四五六七八九"[int(d)]) + ("千", "百", "十", "")[place]
        if groups[i]:
            out += ("", "万", "億", "兆")[i]
    return out


def test_numeral_texts_read_back(spark):
    rng = random.Random(1)
    numbers = [rng.randrange(10 ** rng.randint(1, 15)) for _ in range(300)] + [0, 1, 10, 10_000, 10**12]
    frame = spark.createDataFrame([(n,) for n in numbers], "n long")
    rows = frame.select("n", numeral_text(F.col("n")).alias("t"), numeral_value(numeral_text(F.col("n"))).alias("v")).collect()
    for r in rows:
        assert r["t"] == spoken(r["n"]) and r["v"] == r["n"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_subnormal=False) | st.sampled_from([0.0, 1.0, 2.0]), min_size=1, max_size=60))
def test_exact_percentiles(spark, values):
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probabilities = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {r["probability"]: r["value"] for r in exact_percentiles(frame, F.col("v"), probabilities).collect()}
    for p in probabilities:
        assert math.isclose(got[p], float(np.percentile(values, 100 * p)), rel_tol=1e-9, abs_tol=1e-6)


def test_exact_percentiles_with_a_hot_value(spark):
    frame = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    values = frame.toPandas()["v"]
    got = {r["probability"]: r["value"] for r in exact_percentiles(frame, F.col("v"), [0.3, 0.34, 0.5]).collect()}
    for p, v in got.items():
        assert math.isclose(v, float(np.percentile(values, 100 * p)), rel_tol=1e-12)


def test_surplus_of_a_key_that_holds_most_rows(spark):
    hot = spark.range(250_000).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    rest = spark.createDataFrame([(2, "a"), (2, "b"), (3, "c"), (None, "n"), (None, "m")], "k int, v string")
    out = surplus_copies(hot.unionByName(rest), ["k"]).groupBy("k", "v").count().collect()
    assert {(r["k"], r["v"]): r["count"] for r in out} == {(1, "same"): 249_999, (2, "b"): 1, (None, "n"): 1}


def test_numbering_with_many_copies(spark):
    hot = spark.range(210_000).select(F.lit("b").alias("v"))
    rest = spark.createDataFrame([("a",), ("c",), ("c",)], "v string")
    out = numbered(hot.unionByName(rest), ["v"], "n").groupBy("v").agg(F.min("n"), F.max("n"), F.count_distinct("n")).collect()
    assert {tuple(r) for r in out} == {("a", 1, 1, 1), ("b", 2, 210_001, 210_000), ("c", 210_002, 210_003, 2)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 5)), min_size=1, max_size=25, unique_by=lambda t: t[0]))
def test_monotonicity(spark, pairs):
    row = seg.monotonicity(spark.createDataFrame(pairs, "o int, v int"), "o").first()
    values = pd.Series([v for _, v in sorted(pairs)])
    steps = values.diff().dropna()
    assert row["monotonic_increasing"] == values.is_monotonic_increasing
    assert row["monotonic_decreasing"] == values.is_monotonic_decreasing
    assert row["strictly_monotonic_increasing"] == bool((steps > 0).all())
    assert row["strictly_monotonic_decreasing"] == bool((steps < 0).all())


def test_monotonicity_across_slices(spark):
    frame = spark.range(20_000).select("id", (F.col("id") * 2).alias("up"), F.when(F.col("id") == 12_345, 0).otherwise(F.col("id")).alias("broken"))
    got = {r["column_name"]: r["monotonic_trend"] for r in seg.monotonicity(frame, "id").collect()}
    assert got == {"up": 2, "broken": 0}


def test_monotonicity_in_the_columns_own_kind(spark, monkeypatch):
    monkeypatch.setattr(seg, "SLICE_STEPS", 40)
    frame = spark.range(200).select(
        (F.col("id") + 2**60).alias("o"), (F.col("id") + 2**60).alias("longs"), F.expr("cast(id as decimal(38,0)) + cast('1e37' as decimal(38,0))").alias("wide"),
        F.when(F.col("id") == 150, 2**60 - 1).otherwise(F.col("id") + 2**60).alias("broken"), (-F.col("id") / 7).alias("falls"))
    got = {r["column_name"]: r["monotonic_trend"] for r in seg.monotonicity(frame, "o").collect()}
    assert got == {"longs": 2, "wide": 2, "broken": 0, "falls": -2}
    dated = spark.sql("select date_add(date'2024-01-01', cast(id as int)) as d, id % 2 as v from range(10)")
    assert seg.monotonicity(dated, "d").first()["monotonic_trend"] == 0
    assert seg.monotonicity(dated.select("d"), "d").count() == 0


def chi_square(table: pd.DataFrame) -> float:
    observed = table.to_numpy(dtype=float)
    expected = np.outer(observed.sum(1), observed.sum(0)) / observed.sum()
    if observed.shape == (2, 2):
        gap = expected - observed
        observed = observed + np.minimum(0.5, np.abs(gap)) * np.sign(gap)
    return float(((observed - expected) ** 2 / expected).sum())


def test_cramers_v_against_crosstabs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice("xy"), rng.choice(["p", "q", "r", None]), "k") for _ in range(300)]
    rows = [(a, b, c, "hot" if a == "a" and c == "p" else d) for a, b, c, d in rows]
    frame = spark.createDataFrame(rows, "a string, b string, c string, d string")
    pdf = frame.toPandas()
    got = {(r["col1"], r["col2"]): r["cramers_v"] for r in rel.cramers_v(rel.contingency(frame, list("abcd"))).collect()}
    for x, y in itertools.combinations("abcd", 2):
        table = pd.crosstab(pdf[x], pdf[y])
        smaller = min(table.shape) - 1
        expected = math.sqrt(chi_square(table) / (table.to_numpy().sum() * smaller)) if smaller else 0.0
        assert math.isclose(got[(x, y)], expected, abs_tol=1e-9)


def test_rules_need_strength_and_confidence(spark):
    frame = spark.createDataFrame([("de", "eur")] * 8 + [("de", "usd")] * 2 + [("us", "usd")] * 10, "country string, currency string")
    rules = {(r["if_val"], r["then_val"], r["confidence"]) for r in rel.mine_categorical_rules(frame, "t").collect()}
    assert rules == {("de", "eur", 0.8), ("us", "usd", 1.0)}
    assert rel.mine_categorical_rules(frame, "t", min_confidence=0.9).count() == 1


def test_line_equations_keep_the_sign(spark):
    frame = spark.range(100).select(
        F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("minus"), F.col("id").cast("double").alias("same"),
        (F.col("id") * 2.5 - 4).alias("line"), F.when(F.col("id") > 5, F.col("id") * 3.0).alias("gappy"), F.lit(1.0).alias("flat"))
    got = {r["target_variable"]: (r["equation"], r["relationship_type"]) for r in line_equations(frame, frame.columns).collect()}
    assert got == {
        "minus": ("minus = -x", "inverse"), "same": ("same = x", "direct"),
        "line": ("line = 2.500000 * x - 4.000000", "scaled"), "gappy": ("gappy = 3.000000 * x", "scaled"),
    }


def test_correlations_over_several_scans(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(200, 8)), columns=list("abcdefgh"))
    got = correlation_matrix(spark.createDataFrame(pdf), list(pdf.columns)).collect()
    assert len(got) == 28
    for r in got:
        assert math.isclose(r["correlation"], pdf[r["col1"]].corr(pdf[r["col2"]]), abs_tol=1e-12)


def test_equations_with_gaps_and_zero_division(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 0.0), (2.0, 4.0, 1.0), (None, 6.0, 1.0), (4.0, float("nan"), 1.0)], "x double, y double, `z z` double")
    got = {r["equation"]: r for r in validate_equations(frame, ["y = x * 2", "y = x / z z", "x = x + nope"], 0.0).collect()}
    assert (got["y = x * 2"]["valid"], got["y = x * 2"]["total_records"]) == (True, 2)
    assert (got["y = x / z z"]["satisfied_records"], got["y = x / z z"]["total_records"]) == (0, 2)
    assert "nope" in got["x = x + nope"]["error_message"]


@pytest.mark.parametrize("expression", ["__import__('os')", "x ** 2", "x if x else x", "x.y", "[x]", "'a'", "True"])
def test_equations_allow_arithmetic_only(expression):
    with pytest.raises(EquationError):
        parse_equation(f"x = {expression}", ["x"])


def _linear(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3)) * [1, 5, 20] + [3, 10, 100]
    y = 4 + 2 * x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.1, size=600)
    return spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))


def test_lasso_fixed_alpha(spark):
    row = fit_fixed_alpha(_linear(spark), ["a", "b", "c", "absent"], "y").first()
    assert row["status"] == "success" and row["r2"] > 99 and row["accuracy"] is not None and row["total_data"] == 600
    assert math.isclose(row["coefficients"]["a"], 2, abs_tol=0.02) and math.isclose(row["coefficients"]["b"], 0.5, abs_tol=0.01)
    assert row["equation"].startswith("y = ") and "* c" not in row["equation"]
    assert fit_fixed_alpha(_linear(spark), ["absent"], "y").first()["status"] == "error"


def test_lasso_cross_validated(spark):
    row = fit_cross_validated(_linear(spark), ["a", "b"], "y").first()
    assert row["error"] is None and row["r2_test"] > 99 and set(row["coefficients"]) == {"a", "b", "a*b", "a/b"}
    few = spark.createDataFrame([(1.0, 2.0)] * 3, "a double, y double")
    assert fit_cross_validated(few, ["a"], "y").first()["error"] == "Insufficient clean data"


def test_profile_alerts(spark):
    frame = spark.createDataFrame(
        [(i, None, 0 if i else 1, "c", f"u{i}" if i < 30 else None, None if i else 5) for i in range(50)],
        "id int, gone string, zeros int, same string, wide string, rare int")
    got = {r["column_name"]: r["alert"] for r in prof.profile_columns(frame, prof.ProfileOptions(exact=True)).collect()}
    assert got == {
        "id": "Unique Key", "gone": "All Missing", "zeros": "Zeros", "same": "Constant", "wide": "High Cardinality",
        "rare": "High Nulls, Constant",
    }
    sketched = {r["column_name"]: r["alert"] for r in prof.profile_columns(frame).collect()}
    assert sketched["gone"] == "All Missing" and sketched["same"] == "Constant"


def test_profile_in_batches_equals_one_scan(spark):
    frame = spark.range(50).selectExpr("id", "cast(id % 4 as double) AS d", "concat('t', id % 3) AS t", "id > 5 AS b")
    options = dict(exact=True, extended=True, order_by=("id",))
    one = prof.profile_columns(frame, prof.ProfileOptions(**options)).orderBy("column_id").collect()
    many = prof.profile_columns(frame, prof.ProfileOptions(columns_per_scan=1, **options)).orderBy("column_id").collect()
    assert one == many and len(one) == 4
    assert json.loads(one[2]["first_few_rows"]) == ["t0", "t1", "t2", "t0", "t1"]


def test_report_of_an_empty_dataset_is_an_error(spark):
    with pytest.raises(prof.EmptyDatasetError):
        prof.report_profile(spark.createDataFrame([], "a int"))
    assert prof.profile_columns(spark.createDataFrame([], "a int")).first()["total_count"] == 0


def test_character_classes(spark):
    counts = prof.value_counts(spark.createDataFrame([("aB1 漢",), ("aB1 漢",), ("ひ",)], "t string"), ["t"])
    got = {(r["kind"], r["class"]): r["n"] for r in seg.character_classes(seg.character_counts(counts)).collect()}
    assert got[("category", "Lowercase Letter")] == 2 and got[("script", "Han")] == 2 and got[("block", "Hiragana")] == 1
    assert got[("block", "Basic Latin")] == 8 and got[("script", "Common")] == 4


def test_sampled_records_are_repeatable(spark):
    frame = spark.range(1000).select("id")
    pick = [seg.microsegment_records(frame, order_by=["id"], sample=50).select("microsegment_profile").collect() for _ in range(2)]
    assert pick[0] == pick[1] and len(pick[0]) == 50


def test_rule_identity_is_plain_data():
    rule = Rule(1, "x", "c", {"mostly": "0.5", "flag": "yes", "list": "a, b"})
    assert (rule.mostly, rule.flag("flag"), rule.items("list")) == (0.5, True, ["a", "b"])
    assert Dataset("t", None, primary_key=("a",), candidate_key=("b",)).key_columns == ("a",)


def test_rows_of_a_hot_key_are_spread_over_tasks(spark):
    hot = spark.range(20_000).selectExpr("1 AS k", "id % 10000 AS v")
    rest = spark.range(20_000).selectExpr("id + 2 AS k", "id AS v").union(spark.range(500).selectExpr("id + 2 AS k", "-1 AS v"))
    frame = hot.union(rest)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = Repeated(frame, ["k"]).rows
        tasks = [r["count"] for r in rows.where("k = 1").groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(tasks) == 20_000 and max(tasks) < 5_000
        copies = surplus_copies(frame, ["k"], ("v",))
        assert copies.count() == 20_500 - 1
        assert {r["n"] for r in copies.where("k = 1").groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("v = 0").collect()} == {1}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_percentiles_of_awkward_columns_in_a_fixed_number_of_scans(spark):
    draw = np.random.default_rng(2)
    pdf = pd.DataFrame({
        "wide": np.concatenate([draw.normal(size=500), draw.normal(size=499) * 1e300, [1e-310]]),
        "close": 1e15 + draw.integers(0, 3, 1000) * 0.125, "signs": draw.choice([-2.5, -0.0, 0.0, 4.0], 1000), "same": np.full(1000, 7.0),
    })
    frame = spark.createDataFrame(pdf).withColumn("gone", F.lit(None).cast("double")).withColumn("odd", F.when(F.col("signs") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    probabilities = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column_name"], r["probability"]): r["value"] for r in column_percentiles(frame, {c: F.col(c) for c in frame.columns}, probabilities).collect()}
    for c in pdf:
        for p in probabilities:
            assert math.isclose(got[c, p], float(np.percentile(pdf[c], 100 * p)), rel_tol=1e-12, abs_tol=1e-300), (c, p)
    assert ("gone", 0.5) not in got and (got["odd", 0.0], got["odd", 1.0]) == (-math.inf, math.inf)
    assert math.isnan(exact_percentiles(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"), F.col("v"), [1.0]).first()["value"])

    def jobs(columns):
        frames = spark.range(5000).select(*[(F.col("id") * (k + 1.5)).alias(f"c{k}") for k in range(columns)])
        spark.sparkContext.setJobGroup(f"percentiles-{columns}", "")
        column_percentiles(frames, {c: F.col(c) for c in frames.columns}, [0.1, 0.5])
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"percentiles-{columns}"))

    few, many = jobs(8), jobs(16)
    assert few == many <= 30


def test_correlations_with_gaps_offsets_and_constants(spark):
    draw = np.random.default_rng(4)
    pdf = pd.DataFrame(draw.normal(size=(300, 100)) + 1e6 * np.arange(100), columns=[f"c{k}" for k in range(100)])
    pdf["c1"] = pdf["c0"] * -2
    pdf["c2"] = 3.0
    pdf["c3"] = pdf["c3"].where(draw.random(300) < 0.5)
    pdf["c4"] = np.nan
    frame = spark.createDataFrame(pdf).repartition(3)
    frame = frame.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame.columns])
    plan = correlation_matrix(frame, list(pdf.columns))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan
    got = {(r["col1"], r["col2"]): r["correlation"] for r in correlation_matrix(frame, list(pdf.columns)).collect()}
    assert len(got) == 4950 and got["c0", "c1"] == pytest.approx(-1) and got["c0", "c2"] is None and got["c0", "c4"] is None
    for a, b in [("c0", "c3"), ("c3", "c5"), ("c98", "c99"), ("c7", "c50")]:
        assert math.isclose(got[a, b], pdf[a].corr(pdf[b]), abs_tol=1e-9)
    wild = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, float("nan"), 3.0), (3.0, 5.0, 7.0)], "a double, b double, c double")
    rows = {(r["col1"], r["col2"]): r["correlation"] for r in correlation_matrix(wild, ["a", "b", "c"]).collect()}
    assert math.isnan(rows["a", "b"]) and rows["a", "c"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 3, 7])[0, 1])


def test_no_long_text_crosses_a_shuffle(spark, tmp_path):
    long = ["x" * 5000 + str(k) for k in range(20)] * 3 + ["short", "short", None]
    spark.createDataFrame([(t,) for t in long], "t string").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    for found in (seg.word_counts(prof.column_values(frame, ["t"])), prof.key_counts(frame, ["t"])):
        for line in found._jdf.queryExecution().executedPlan().toString().splitlines():
            assert not ("Exchange hashpartitioning" in line and "value#" in line)
    row = prof.profile_columns(frame, prof.ProfileOptions(exact=True, extended=True)).first()
    assert (row["distinct_count"], row["unique_count"]) == (21, 0)
    values = json.loads(row["value_counts"])
    assert values["x" * 5000 + "7"] == 3 and values["short"] == 2 and len(values) == 21


def test_copies_of_few_rows_are_dealt_over_tasks(spark):
    frame = spark.range(2_500_000).selectExpr("id % 2 AS v")
    tasks = numbered(frame, ["v"], "n").groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("rows"), F.min("n"), F.max("n")).collect()
    assert sum(r["rows"] for r in tasks) == 2_500_000 and max(r["rows"] for r in tasks) <= 1_100_000
    assert (min(r["min(n)"] for r in tasks), max(r["max(n)"] for r in tasks)) == (1, 2_500_000)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_surplus_copies_cross_one_shuffle(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, *range(6)]), draw.choice([None, "a", "b"]), draw.randrange(4), draw.randrange(1000)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "k int, l string, o int, v int")
    # 70,000 keys of one row: none of them is hot.
    frame = frame.unionByName(spark.range(70_000).selectExpr("int(id + 10) AS k", "'c' AS l", "1 AS o", "2 AS v"))
    out = surplus_copies(frame, ["k", "l"], ("o",))
    assert plan_of(out).count("Exchange hashpartitioning(") <= 3 and "SortMergeJoin" not in plan_of(out)
    expected = []
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[2], r[3]))
        expected += own[1:]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("repeats", [True, False])
def test_rows_of_repeated_values_stay_where_they_are(spark, repeats):
    from plumbline.plans import fusion
    values = "int(id % 1000)" if repeats else "int(CASE WHEN id < 2 THEN -1 ELSE id END)"
    frame = spark.range(20_000).selectExpr(f"{values} AS k", "id").union(spark.createDataFrame([(-5, -1), (None, -2), (None, -3)], "k int, id long"))
    plan = fusion.plan_rules(fusion_context(frame), [Rule(1, "expect_column_values_to_be_unique", "k")])
    failed = fusion.failed_rows(plan)
    assert "SortMergeJoin" not in plan_of(failed) and "Exchange hashpartitioning(" not in plan_of(failed)
    assert failed.count() == (20_000 if repeats else 2) and failed.where("k = -5 OR k IS NULL").count() == 0


def fusion_context(frame):
    from verification.runs import context_for
    return context_for(Dataset("t", frame, primary_key=("id",)))


def test_distinct_values_are_counted_column_by_column(spark):
    from verification.profiles import _distinct_counts
    frame = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, "b")], "k int, v string")
    counts = _distinct_counts(frame, ["k", "v"])
    assert {r["column_name"]: r["distinct"] for r in counts.collect()} == {"k": 2, "v": 2} and "Expand" not in plan_of(counts)
