"""Profiles, numerals and microsegments."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.durable import stored
from plumbline.functions.numerals import localise_stats, normalise_numeric
from plumbline.operators import microsegments as seg
from plumbline.operators import profile as prof
from plumbline.operators.percentiles import exact_percentiles
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


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Columns of the profiled fixture and their kinds.
_GAPS = {
    "o_orderkey": "numeric", "o_custkey": "numeric", "o_totalprice": "numeric", "o_orderdate": "other",
    "o_orderpriority": "text", "o_orderstatus": "text", "priority": "text", "status": "text", "price": "numeric",
}


def _column_sql(c: str, kind: str, i: int) -> str:
    number = kind == "numeric"
    q = {n: f"quantile_cont({c}, {p})" if number else "NULL::DOUBLE" for n, p in prof.PERCENTILES.items()}
    return f"""
    SELECT {i}::INTEGER AS column_id, '{c}' AS column_name, '{kind}' AS kind, count(*) AS total_count, count({c}) AS non_null_count,
           count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS missing_count,
           {f"min({c})::DOUBLE" if number else "NULL::DOUBLE"} AS min_number, {f"max({c})::DOUBLE" if number else "NULL::DOUBLE"} AS max_number,
           {f"min({c})" if kind == "text" else "NULL"} AS min_text, {f"max({c})" if kind == "text" else "NULL"} AS max_text,
           {f"stddev_samp({c})" if number else "NULL::DOUBLE"} AS std_dev, {", ".join(f"{v} AS {n}" for n, v in q.items())},
           {f"count(*) FILTER (WHERE {c} = 0)" if number else "0::BIGINT"} AS zero_count,
           {f"avg(length({c}))" if kind == "text" else "NULL::DOUBLE"} AS avg_length,
           {f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DATE) IS NULL)" if kind == "text" else "0::BIGINT"} AS invalid_date_count
    FROM orders_gaps"""


_PROFILE_SQL = "profile AS (" + "\nUNION ALL\n".join(_column_sql(c, k, i) for i, (c, k) in enumerate(_GAPS.items(), 1)) + ")"
_ALERT = """coalesce(nullif(concat_ws(', ',
    CASE WHEN non_null_count = 0 THEN 'All Missing' WHEN missing_count * 100.0 / total_count > 80 THEN 'High Nulls' END,
    CASE WHEN distinct_count = 1 AND non_null_count > 0 THEN 'Constant' END,
    CASE WHEN distinct_count * 100.0 / total_count >= 99.5 AND non_null_count > 1 THEN 'Unique Key' END,
    CASE WHEN kind = 'text' AND distinct_count * 100.0 / total_count > 50 AND distinct_count > 10 THEN 'High Cardinality' END,
    CASE WHEN kind = 'numeric' AND zero_count * 100.0 / total_count > 50 THEN 'Zeros' END), ''), 'OK')"""


def _with_profile(sql: str) -> str:
    return with_fixtures("SELECT 1", "orders_gaps").rsplit("SELECT 1", 1)[0].rstrip() + ", " + _PROFILE_SQL + sql


@query("p1_native_profile", _with_profile("""
    SELECT column_id, column_name, kind, total_count, non_null_count, distinct_count, missing_count, min_number, max_number, min_text, max_text,
           round(std_dev, 4) AS std_dev, round(p05, 4) AS p05, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p95, 4) AS p95,
           zero_count, round(avg_length, 4) AS avg_length, invalid_date_count,
           round(missing_count * 100.0 / total_count, 4)::DOUBLE AS missing_percentage, round(distinct_count * 100.0 / total_count, 4)::DOUBLE AS distinct_percentage
    FROM profile"""))
def native_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = prof.profile_columns(frame(spark, sf_dir, "orders_gaps"), prof.ProfileOptions(exact=True))
    number, text = F.col("kind") == "numeric", F.col("kind") == "text"
    shaped = profile.withColumns({
        "min_number": F.when(number, F.col("min_value")).try_cast("double"), "max_number": F.when(number, F.col("max_value")).try_cast("double"),
        "min_text": F.when(text, F.col("min_value")), "max_text": F.when(text, F.col("max_value")),
    }).drop("run_id", "dataset_id", "data_type", "inferred_data_type", "min_value", "max_value", "first_few_rows", "alert")
    return _rounded(shaped, "std_dev", *prof.PERCENTILES, "avg_length", "missing_percentage", "distinct_percentage")


_RANKS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, distinct)``, exact; each column by itself, so that no row is written once per column."""
    return reduce(DataFrame.unionByName, [
        df.select(c).distinct().agg(F.lit(c).alias("column_name"), F.count(F.col(c)).alias("distinct")) for c in columns
    ])


@query("p1_native_profile_sketched", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count(*) AS total_count, count({c}) AS non_null_count, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high,
        round(stddev_samp({c}), 4) AS std_dev, count(*) FILTER (WHERE {c} = 0) AS zero_count, TRUE AS distinct_near, TRUE AS percentiles_near FROM lineitem"""
    for c in _LINE_NUMBERS))
def native_profile_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns: exact figures as they are, and whether the sketched ones keep their bounds against exact counts."""
    lines = frame(spark, sf_dir, "lineitem").select(*_LINE_NUMBERS)
    # A row per column, sketched once.
    profile = stored(prof.profile_columns(lines))
    found = {r["column_name"]: r for r in profile.collect()}
    tests = []
    for c, r in found.items():
        col = F.col(c)
        for p, share in _RANKS.items():
            below, upto = F.count_if(col < r[p]) / F.count(col), F.count_if(col <= r[p]) / F.count(col)
            tests.append(((below <= share + 0.005) & (upto >= share - 0.005)).alias(f"{c}_{p}"))
    held = lines.agg(*tests).first()
    near = {c: all(held[f"{c}_{p}"] for p in _RANKS) for c in found}
    distinct = {r["column_name"]: r["distinct"] for r in _distinct_counts(lines, list(found)).collect()}
    close = {c: abs(r["distinct_count"] / distinct[c] - 1) <= 0.08 for c, r in found.items()}

    def verdict(values: dict[str, bool]):
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("column_name"))

    return profile.select(
        "column_name", "total_count", "non_null_count", F.col("min_value").cast("double").alias("low"), F.col("max_value").cast("double").alias("high"),
        F.round("std_dev", 4).alias("std_dev"), "zero_count", verdict(close).alias("distinct_near"), verdict(near).alias("percentiles_near"),
    )


@query("p1_exact_percentiles", "\nUNION ALL\n".join(
    f"SELECT {p}::DOUBLE AS probability, round(quantile_cont(l_extendedprice, {p}), 4) AS value FROM lineitem" for p in (0.0, 0.05, 0.5, 0.9999, 1.0)))
def large_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(exact_percentiles(frame(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), [0.0, 0.05, 0.5, 0.9999, 1.0]), "value")


@query("p2_column_alerts", _with_profile(f"SELECT column_name, {_ALERT} AS alert FROM profile"))
def column_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = prof.profile_columns(frame(spark, sf_dir, "orders_gaps"), prof.ProfileOptions(exact=True))
    return profile.select("column_name", "alert")


@query("p3_dataset_summary", with_fixtures("""
    SELECT count(*) AS total_rows, 6::INTEGER AS total_columns, sum((quality IS NULL)::INT + (toxic IS NULL)::INT)::BIGINT AS missing_values_count,
           round(sum((quality IS NULL)::INT + (toxic IS NULL)::INT) * 100.0 / (count(*) * 6), 4)::DOUBLE AS null_percent,
           count(DISTINCT doc_id) + count(DISTINCT lang) + count(DISTINCT source) + count(DISTINCT n_chars) + count(DISTINCT quality) + count(DISTINCT toxic) AS unique_values_count,
           (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labelled)))::BIGINT AS duplicate_count
    FROM labelled""", "labelled"))
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = prof.dataset_summary(frame(spark, sf_dir, "labelled"), exact=True)
    return _rounded(summary, "null_percent").drop("run_id", "dataset_id", "dataset_name", "null_count", "table_size_gb")


_LINES = [*_LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


@query("p3_dataset_summary_sketched", "SELECT count(*) AS total_rows, 11::INTEGER AS total_columns, 0::BIGINT AS missing_values_count, 0.0::DOUBLE AS null_percent, TRUE AS distinct_near, TRUE AS duplicates_near FROM lineitem")
def dataset_summary_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact figures as they are, and whether the sketched ones are within a tenth of the exact ones."""
    lines = frame(spark, sf_dir, "lineitem").select(*_LINES)
    distinct = _distinct_counts(lines, _LINES).agg(F.sum("distinct").alias("n"))
    exact = distinct.crossJoin(lines.distinct().agg(F.count(F.lit(1)).alias("rows")))
    summary = prof.dataset_summary(lines).crossJoin(exact)
    return summary.select(
        "total_rows", "total_columns", "missing_values_count", "null_percent",
        (F.abs(F.col("unique_values_count") / F.col("n") - 1) <= 0.1).alias("distinct_near"),
        (F.abs(F.col("total_rows") - F.col("duplicate_count") - F.col("rows")) <= 0.1 * F.col("rows")).alias("duplicates_near"),
    )


@query("p4_first_few_rows", with_fixtures("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, to_json(list({c}::VARCHAR ORDER BY p_partkey) FILTER (WHERE {c} IS NOT NULL))::VARCHAR AS first_few_rows "
    "FROM (SELECT * FROM part_texts ORDER BY p_partkey LIMIT 5)" for c in ("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice", "size_text", "date_text")), "part_texts"))
def first_few_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.first_few_rows(frame(spark, sf_dir, "part_texts"), ["p_partkey"])


def _moment(c: str, table: str, power: int) -> str:
    return f"(SELECT avg(pow({c} - (SELECT avg({c}) FROM {table}), {power})) / pow(stddev_pop({c}), {power}) FROM {table})"


def _extended_sql(c: str, kind: str) -> str:
    number, text = kind == "numeric", kind == "text"
    return f"""
    SELECT '{c}' AS column_name, {f"round(avg({c}), 4)" if number else "NULL::DOUBLE"} AS mean_value, {f"round(sum({c}), 2)::DOUBLE" if number else "NULL::DOUBLE"} AS sum_value,
           {f"count(*) FILTER (WHERE {c} < 0)" if number else "0::BIGINT"} AS negative_count,
           {f"round({_moment(c, 'orders_gaps', 4)} - 3, 4)" if number else "NULL::DOUBLE"} AS kurtosis_value,
           {f"round({_moment(c, 'orders_gaps', 3)}, 4) + 0.0::DOUBLE" if number else "NULL::DOUBLE"} AS skewness_value,
           {f"min(length({c}))" if text else "NULL::BIGINT"} AS min_length, {f"max(length({c}))" if text else "NULL::BIGINT"} AS max_length,
           {f"median(length({c}))" if text else "NULL::DOUBLE"} AS median_length,
           (SELECT count(*) FROM (SELECT {c} FROM orders_gaps WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1)) AS unique_count
    FROM orders_gaps HAVING count(*) >= 0"""


@query("p5_extended_statistics", with_fixtures("\nUNION ALL\n".join(_extended_sql(c, k) for c, k in _GAPS.items()), "orders_gaps"))
def extended_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = prof.profile_columns(frame(spark, sf_dir, "orders_gaps"), prof.ProfileOptions(exact=True, extended=True))
    profile = _rounded(profile, "mean_value", "kurtosis_value", "skewness_value")
    return profile.withColumn("skewness_value", F.col("skewness_value") + 0.0).select(
        "column_name", "mean_value", F.round("sum_value", 2).alias("sum_value"), "negative_count", "kurtosis_value",
        "skewness_value", "min_length", "max_length", "median_length", "unique_count",
    )


@query("p5_long_values", """
    SELECT value, n, rank FROM (SELECT text AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, substring(text, 1, 64), length(text), md5(text)) AS rank
      FROM documents WHERE length(text) > 64 GROUP BY text) WHERE rank <= 50""")
def long_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent long texts, counted by digests and read back whole."""
    texts = frame(spark, sf_dir, "documents").where(F.length("text") > 64).select("text")
    return prof.top_keys(texts, prof.key_counts(texts, ["text"]), 50).drop("column_name")


@query("p5_value_counts", with_fixtures("""
    SELECT column_name, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM (
      SELECT 'priority' AS column_name, priority AS value, count(*) AS n FROM orders_gaps WHERE priority IS NOT NULL GROUP BY priority
      UNION ALL SELECT 'status', status, count(*) FROM orders_gaps GROUP BY status
      UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, count(*) FROM orders_gaps GROUP BY o_custkey)) WHERE rank <= 50""", "orders_gaps"))
def top_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.top_values(prof.value_counts(frame(spark, sf_dir, "orders_gaps"), ["priority", "status", "o_custkey"]))


def _report_sql(c: str, label: str) -> str:
    number, total = label == "Numeric", "(count(*)::DOUBLE)"
    return f"""
    SELECT * EXCLUDE (kind, total_count, non_null_count), nullif({_ALERT}, 'OK') AS column_alert FROM (
    SELECT '{c}' AS column_name, '{label}' AS data_type, count(DISTINCT {c}) AS distinct_count,
           round(count(DISTINCT {c})::DOUBLE / count({c}), 6) AS distinct_share,
           (SELECT count(*) FROM (SELECT {c} FROM labelled WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1)) AS unique_count,
           round((SELECT count(*) FROM (SELECT {c} FROM labelled WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1))::DOUBLE / count({c}), 6) AS unique_share,
           count(*) - count({c}) AS missing_count, round((count(*) - count({c}))::DOUBLE / count(*), 6) AS missing_share,
           {f"count(*) FILTER (WHERE {c} = 0)" if number else "0::BIGINT"} AS zero_count,
           {f"round(count(*) FILTER (WHERE {c} = 0) / {total}, 6)" if number else "0.0::DOUBLE"} AS zero_share,
           {f"round(avg({c}), 4)" if number else "NULL::DOUBLE"} AS mean_value, {f"round(stddev_samp({c}), 4)" if number else "NULL::DOUBLE"} AS std_dev,
           min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, {f"sum({c})::DOUBLE" if number else "NULL::DOUBLE"} AS sum_value,
           '{"numeric" if number else "text"}' AS kind, count(*) AS total_count, count({c}) AS non_null_count
    FROM labelled)"""


@query("p6_report_profile", with_fixtures("\nUNION ALL\n".join(_report_sql(c, k) for c, k in {
    "doc_id": "Numeric", "lang": "Categorical", "source": "Categorical", "n_chars": "Numeric", "quality": "Numeric", "toxic": "Numeric"}.items()), "labelled"))
def report_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = prof.report_profile(frame(spark, sf_dir, "labelled"))
    rounded = _rounded(_rounded(report, "mean_value", "std_dev"), "distinct_share", "unique_share", "missing_share", "zero_share", digits=6)
    # Bytes of texts are an estimate from their mean length.
    return rounded.drop("column_id", "memory_size_bytes")


@query("p7_inferred_types", """
    SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'NUMBER(19,0)' WHEN 'INTEGER' THEN 'NUMBER(10,0)' WHEN 'DOUBLE' THEN 'FLOAT'
           WHEN 'VARCHAR' THEN 'TEXT' ELSE 'TIMESTAMP_NTZ(6)' END AS data_type, (SELECT count(*) FROM orders) AS total_count
    FROM (DESCRIBE SELECT * FROM orders)""")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.profile_columns(frame(spark, sf_dir, "orders")).select("column_name", "data_type", "total_count")


_CHARS = "^[一二三四五六七八九十百千万億兆0-9.,\\s・点〇零]*$"


@query("p8_numeral_columns", with_fixtures("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, count({c}) > 0 AND count(*) FILTER (WHERE NOT regexp_matches({c}, '{_CHARS}')) = 0 AS is_numeral FROM numerals"
    for c in ("spoken", "mixed", "p_brand")), "numerals"))
def numeral_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.numeral_columns(frame(spark, sf_dir, "numerals"))


@query("p8_numeral_profile", with_fixtures(
    "SELECT round(avg(p_size), 4) AS mean_value, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, count(DISTINCT p_size) AS distinct_count FROM numerals", "numerals"))
def numeral_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = prof.report_profile(frame(spark, sf_dir, "numerals").select("spoken", "p_brand"), translate_numerals=True)
    return report.where("column_name = 'spoken'").select(
        F.round("mean_value", 4).alias("mean_value"), F.col("min_value").cast("double").alias("low"),
        F.col("max_value").cast("double").alias("high"), "distinct_count",
    )


@query("p9_localised_statistics", with_fixtures("""
    SELECT p_brand, n, CASE WHEN n = 0 THEN '零' ELSE
      (CASE WHEN n >= 1000 THEN (CASE WHEN n >= 2000 THEN translate((n // 1000)::VARCHAR, '123456789', '一二三四五六七八九') ELSE '' END) || '千' ELSE '' END) ||
      (CASE WHEN n // 100 % 10 > 0 THEN (CASE WHEN n // 100 % 10 > 1 THEN translate((n // 100 % 10)::VARCHAR, '123456789', '一二三四五六七八九') ELSE '' END) || '百' ELSE '' END) ||
      (CASE WHEN n // 10 % 10 > 0 THEN (CASE WHEN n // 10 % 10 > 1 THEN translate((n // 10 % 10)::VARCHAR, '123456789', '一二三四五六七八九') ELSE '' END) || '十' ELSE '' END) ||
      (CASE WHEN n % 10 > 0 THEN translate((n % 10)::VARCHAR, '123456789', '一二三四五六七八九') ELSE '' END) END AS n_ja
    FROM (SELECT p_brand, count(*) AS n FROM numerals GROUP BY p_brand)""", "numerals"))
def localised_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = frame(spark, sf_dir, "numerals").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return localise_stats(counts, ["n"])


_DIGITS = "translate({0}::VARCHAR, '123456789', '一二三四五六七八九')"


def _spoken(n: str) -> str:
    """A whole number below 10**8 in numerals."""
    def group(g: str) -> str:
        parts = [
            f"CASE WHEN {g} // {p} % 10 > 0 THEN (CASE WHEN {g} // {p} % 10 > 1 THEN {_DIGITS.format(f'({g} // {p} % 10)')} ELSE '' END) || '{name}' ELSE '' END"
            for p, name in ((1000, "千"), (100, "百"), (10, "十"))
        ]
        return " || ".join([*parts, f"CASE WHEN {g} % 10 > 0 THEN {_DIGITS.format(f'({g} % 10)')} ELSE '' END"])

    return f"CASE WHEN {n} = 0 THEN '零' ELSE (CASE WHEN {n} >= 10000 THEN {group(f'({n} // 10000)')} || '万' ELSE '' END) || {group(f'({n} % 10000)')} END"


_COUNTS = ("total_rows", "total_columns", "missing_values_count", "null_count", "duplicate_count")


@query("p9_localised_summary", with_fixtures(f"""
    SELECT *, {', '.join(f"{_spoken(c)} AS {c}_ja" for c in _COUNTS)} FROM (
      SELECT count(*) AS total_rows, 6::INTEGER AS total_columns, sum((quality IS NULL)::INT + (toxic IS NULL)::INT)::BIGINT AS missing_values_count,
             sum((quality IS NULL)::INT + (toxic IS NULL)::INT)::BIGINT AS null_count,
             (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labelled)))::BIGINT AS duplicate_count FROM labelled)""", "labelled"))
def localised_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.localised_summary(frame(spark, sf_dir, "labelled")).select(*_COUNTS, *[f"{c}_ja" for c in _COUNTS])


@query("u1_numeral_values", with_fixtures("""
    SELECT p_partkey, p_size::DOUBLE AS spoken, CASE p_size % 4 WHEN 0 THEN -p_size::DOUBLE WHEN 1 THEN p_size + 0.5 END AS mixed,
           CASE WHEN p_size % 4 = 2 THEN 'mixed' ELSE '' END AS unparsed FROM numerals""", "numerals"))
def numeral_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = normalise_numeric(frame(spark, sf_dir, "numerals"), ["spoken", "mixed"])
    return parsed.select("p_partkey", "spoken", "mixed", F.array_join("unparsed_columns", ",").alias("unparsed"))


@query("u2_numeral_texts", with_fixtures("""
    SELECT p_partkey, spoken AS small, spoken || '万' || spoken AS large, '−' || spoken || '点五' AS negative FROM numerals""", "numerals"))
def numeral_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    values = frame(spark, sf_dir, "numerals").select(
        "p_partkey", size.alias("small"), (size * 10_000 + size).alias("large"), (-size - 0.5).alias("negative")
    )
    texts = localise_stats(values, ["small", "large", "negative"])
    return texts.select("p_partkey", *[F.col(f"{c}_ja").alias(c) for c in ("small", "large", "negative")])


# --- microsegments ----------------------------------------------------------

_SEGMENTS = "SELECT l_returnflag AS flag, l_linestatus AS status, cast(month(l_shipdate) AS int) AS ship_month, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus, month(l_shipdate)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = frame(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.month("l_shipdate").alias("ship_month")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")
    )


@query("p10_microsegment_records", f"""
    SELECT row_number() OVER (ORDER BY ship_month, flag, status) AS microsegment_id, flag, status, ship_month::BIGINT AS ship_month, lines, quantity FROM ({_SEGMENTS})""")
def microsegment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = seg.microsegment_records(_segments(spark, sf_dir), order_by=["ship_month", "flag", "status"])
    doc = F.parse_json("microsegment_profile")
    return records.select("microsegment_id", *[
        F.variant_get(doc, f"$.{c}", t).alias(c)
        for c, t in {"flag": "string", "status": "string", "ship_month": "bigint", "lines": "bigint", "quantity": "double"}.items()
    ])


@query("p10_microsegment_numbers", """
    SELECT l_returnflag, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_linenumber) AS microsegment_id FROM lineitem""")
def microsegment_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct rows, many copies: numbering must split the copies."""
    rows = frame(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber")
    records = seg.microsegment_records(rows, order_by=["l_returnflag", "l_linenumber"])
    doc = F.parse_json("microsegment_profile")
    return records.select(
        "microsegment_id", F.variant_get(doc, "$.l_returnflag", "string").alias("l_returnflag"),
        F.variant_get(doc, "$.l_linenumber", "int").alias("l_linenumber"),
    )


@query("p10_microsegment_summary", with_fixtures("""
    SELECT count(*) AS total_records, 5::INTEGER AS total_columns, sum((quality IS NULL)::INT + (toxic IS NULL)::INT)::BIGINT AS missing_values_count,
           2::INTEGER AS columns_with_missing_values, 0::INTEGER AS columns_fully_missing,
           round(sum((quality IS NULL)::INT + (toxic IS NULL)::INT) / (count(*) * 5.0), 6)::DOUBLE AS missing_values_share,
           sum(coalesce(octet_length(encode(lang)), 0) + coalesce(octet_length(encode(source)), 0) + 8 * (n_chars IS NOT NULL)::INT + 8 * (quality IS NOT NULL)::INT + 8 * (toxic IS NOT NULL)::INT)::BIGINT AS memory_size_bytes,
           round(sum(coalesce(octet_length(encode(lang)), 0) + coalesce(octet_length(encode(source)), 0) + 8 * (n_chars IS NOT NULL)::INT + 8 * (quality IS NOT NULL)::INT + 8 * (toxic IS NOT NULL)::INT)::DOUBLE / count(*), 6) AS average_record_size_bytes,
           '{"Numeric": 3, "Text": 2}' AS column_data_types,
           (SELECT count(*) FROM (SELECT 1 FROM labelled GROUP BY lang, source, n_chars, quality, toxic HAVING count(*) > 1)) AS duplicate_records_count,
           round((SELECT count(*) FROM (SELECT 1 FROM labelled GROUP BY lang, source, n_chars, quality, toxic HAVING count(*) > 1))::DOUBLE / count(*), 6) AS duplicate_records_share
    FROM labelled""", "labelled"))
def microsegment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(seg.microsegment_summary(frame(spark, sf_dir, "labelled").drop("doc_id")), "missing_values_share", "duplicate_records_share", "average_record_size_bytes", digits=6)


def _numeric_sql(c: str, table: str) -> str:
    return f"""
    SELECT '{c}' AS column_name, round(var_samp({c}), 3) AS variance_value, round(max({c}) - min({c}), 4)::DOUBLE AS value_range,
           round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS interquartile_range, round(stddev_samp({c}) / avg({c}), 6) AS coefficient_of_variation,
           round((SELECT avg(abs(x.{c} - (SELECT median({c}) FROM {table}))) FROM {table} x), 4) AS mean_absolute_deviation,
           round((SELECT median(abs(x.{c} - (SELECT median({c}) FROM {table}))) FROM {table} x), 4)::DOUBLE AS median_absolute_deviation,
           round(skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)), 5) + 0.0::DOUBLE AS skewness_value, 0::BIGINT AS infinite_count,
           count(*) FILTER (WHERE {c} < 0) AS negative_count, count(*) FILTER (WHERE {c} = 0) AS zero_count
    FROM {table}"""


@query("p11_numeric_statistics", with_fixtures("\nUNION ALL\n".join(
    _numeric_sql(c, "orders_gaps") for c in ("o_orderkey", "o_custkey", "o_totalprice", "price")), "orders_gaps"))
def numeric_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = seg.numeric_statistics(frame(spark, sf_dir, "orders_gaps"))
    return stats.select(
        "column_name", F.round("variance_value", 3).alias("variance_value"), F.round("value_range", 4).alias("value_range"),
        F.round("interquartile_range", 4).alias("interquartile_range"), F.round("coefficient_of_variation", 6).alias("coefficient_of_variation"),
        F.round("mean_absolute_deviation", 4).alias("mean_absolute_deviation"), "negative_count", "zero_count", "infinite_count",
        F.round("median_absolute_deviation", 4).alias("median_absolute_deviation"), (F.round("skewness_value", 5) + 0.0).alias("skewness_value"),
    )


def _frequency_sql(c: str, table: str) -> str:
    return f"""
    SELECT '{c}' AS column_name, count(*) AS distinct_count, count(*) FILTER (WHERE n = 1) AS unique_count,
           round(sum(pow(n - m, 2) / m), 4) AS chi_squared, round(CASE WHEN count(*) > 1 THEN 1 - -sum(n / t * log2(n / t)) / log2(count(*)) END, 6) AS data_imbalance
    FROM (SELECT n::DOUBLE AS n, avg(n) OVER () AS m, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}))"""


@query("p11_frequency_statistics", with_fixtures("\nUNION ALL\n".join(
    _frequency_sql(c, "orders_gaps") for c in ("o_custkey", "priority", "status", "o_orderstatus")), "orders_gaps"))
def frequency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "orders_gaps").select("o_custkey", "priority", "status", "o_orderstatus")
    return _rounded(_rounded(seg.frequency_statistics(df), "chi_squared"), "data_imbalance", digits=6)


@query("p11_histograms", "\nUNION ALL\n".join(f"""
    SELECT '{c}' AS column_name, bin::INTEGER AS bin, round(any_value(low) + bin * any_value(width), 6)::DOUBLE AS bin_start, round(any_value(low) + (bin + 1) * any_value(width), 6)::DOUBLE AS bin_end, count(*) AS n FROM (
      SELECT least(49, floor(({c} - low) / ((high - low) / 50))) AS bin, low, (high - low) / 50 AS width FROM lineitem, (SELECT min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM lineitem)) GROUP BY bin"""
    for c in ("l_quantity", "l_linenumber")))
def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(seg.histograms(frame(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber")), "bin_start", "bin_end", digits=6)


def _text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.column_values(frame(spark, sf_dir, "documents"), ["text", "lang"])


@query("p11_character_counts", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, ch AS character, count(*) AS n FROM (SELECT unnest(string_split({c}, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch" for c in ("text", "lang")))
def character_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.character_counts(_text_counts(spark, sf_dir))


_PUNCTUATION = seg.PUNCTUATION.replace("'", "''")


@query("p11_word_counts", "\nUNION ALL\n".join(f"""
    SELECT '{c}' AS column_name, word, count(*) AS n FROM (
      SELECT trim(w, '{_PUNCTUATION}') AS word FROM (SELECT unnest(regexp_split_to_array(lower({c}), '\\s+')) AS w FROM documents)) WHERE word <> '' GROUP BY word"""
    for c in ("text", "lang")))
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.word_counts(_text_counts(spark, sf_dir))


@query("p11_length_counts", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, length({c})::INTEGER AS length, count(*) AS n FROM documents GROUP BY length({c})" for c in ("text", "lang")))
def length_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.length_counts(_text_counts(spark, sf_dir))


_CATEGORY = " ".join(f"WHEN regexp_matches(ch, '^\\p{{{code}}}$') THEN '{name}'" for code, name in seg.CATEGORIES.items())
_SCRIPT = " ".join(f"WHEN regexp_matches(ch, '^\\p{{{s}}}$') THEN '{s}'" for s in seg.SCRIPTS)
_BLOCK = " ".join(f"WHEN unicode(ch) BETWEEN {a} AND {b} THEN '{name}'" for name, (a, b) in seg.BLOCKS.items())


@query("p11_character_classes", f"""
    WITH chars AS (SELECT 'text' AS column_name, ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)
    SELECT column_name, kind, class, count(*) AS characters, sum(n)::BIGINT AS n FROM (
      SELECT column_name, 'category' AS kind, CASE {_CATEGORY} ELSE 'Unassigned' END AS class, n FROM chars
      UNION ALL SELECT column_name, 'script', CASE {_SCRIPT} ELSE 'Common' END, n FROM chars
      UNION ALL SELECT column_name, 'block', CASE {_BLOCK} ELSE 'Other' END, n FROM chars) GROUP BY column_name, kind, class""")
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prof.column_values(frame(spark, sf_dir, "documents"), ["text"])
    return seg.character_classes(seg.character_counts(counts))


@query("p11_monotonicity", """
    WITH steps AS (SELECT o_orderkey AS o, o_orderkey * 2.0 AS up, -floor(o_orderkey / 3.0) AS down, o_totalprice AS price FROM orders),
    pairs AS (SELECT up, down, price, lag(up) OVER w AS pu, lag(down) OVER w AS pd, lag(price) OVER w AS pp FROM steps WINDOW w AS (ORDER BY o))
    SELECT *, CASE WHEN strictly_monotonic_increasing THEN 2 WHEN monotonic_increasing THEN 1 WHEN strictly_monotonic_decreasing THEN -2 WHEN monotonic_decreasing THEN -1 ELSE 0 END::INTEGER AS monotonic_trend FROM (
    SELECT 'up' AS column_name, bool_and(pu <= up) AS monotonic_increasing, bool_and(pu < up) AS strictly_monotonic_increasing, bool_and(pu >= up) AS monotonic_decreasing,
           bool_and(pu > up) AS strictly_monotonic_decreasing FROM pairs
    UNION ALL SELECT 'down', bool_and(pd <= down), bool_and(pd < down), bool_and(pd >= down), bool_and(pd > down) FROM pairs
    UNION ALL SELECT 'price', bool_and(pp <= price), bool_and(pp < price), bool_and(pp >= price), bool_and(pp > price) FROM pairs)""")
def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = frame(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") * 2.0).alias("up"), (-F.floor(F.col("o_orderkey") / 3.0)).cast("double").alias("down"),
        F.col("o_totalprice").alias("price"),
    )
    return seg.monotonicity(steps, "o_orderkey")


@query("p11_attribute_summary")
def attribute_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.attribute_summary(_segments(spark, sf_dir), order_by="ship_month").drop("first_few_rows")
