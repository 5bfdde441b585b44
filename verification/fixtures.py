"""Inputs derived from the test tables, as SQL that Spark and the oracle both run.

The tables hold no NULLs and no metadata, so gaps, rule histories, failing
records and microsegments are derived from them here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_MONTH = "cast(year(l_shipdate) * 12 + month(l_shipdate) AS bigint)"
_RUN = f"({_MONTH} * 10000000 + l_suppkey)"
_RULE = "cast(l_suppkey * 10 + l_linenumber AS bigint)"
_MONTH_TEXT = (
    "concat(cast(year(l_shipdate) AS string), '-', lpad(cast(month(l_shipdate) AS string), 2, '0'), '-01')"
)


def _count(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


FIXTURES: dict[str, str] = {
    "orders_gaps": """
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus,
               nullif(o_orderpriority, '5-LOW') AS priority,
               CASE WHEN o_orderstatus = 'P' THEN '  ' ELSE o_orderstatus END AS status,
               CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price
        FROM orders""",
    "neighbours": """
        SELECT o_orderkey, o_custkey % 2 AS parity, o_orderkey + 9007199254740992 AS big,
               cast(o_orderkey AS decimal(20,2)) + cast(0.25 AS decimal(20,2)) AS money,
               9007199254740992 + o_orderkey % 2 AS edge,
               concat(o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE chr(10) END) AS ended
        FROM orders""",
    "wide_numbers": """
        SELECT o_orderkey, o_orderkey % 2 AS parity, o_orderkey % 2 AS small, o_orderkey + 9007199254740992 AS big,
               9007199254740992 + o_orderkey % 2 AS edge, 9007199254740992 AS edge_too,
               cast(o_orderkey AS decimal(38,0)) + cast('100000000000000000000000000000000000' AS decimal(38,0)) AS wide,
               cast(0 AS decimal(38,0)) - (cast(o_orderkey AS decimal(38,0)) + cast('100000000000000000000000000000000000' AS decimal(38,0))) AS minus_wide,
               cast(o_orderkey AS decimal(20,2)) + cast(0.25 AS decimal(20,2)) AS money,
               cast(0 AS decimal(20,2)) - (cast(o_orderkey AS decimal(20,2)) + cast(0.25 AS decimal(20,2))) AS minus_money
        FROM orders""",
    "labelled": """
        SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "part_texts": """
        SELECT p_partkey, p_brand, p_type, p_size, p_retailprice,
               CASE WHEN p_size % 7 = 0 THEN 'x' WHEN p_size % 11 = 0 THEN NULL
                    WHEN p_size % 13 = 0 THEN ' ' ELSE cast(p_size AS string) END AS size_text,
               CASE WHEN p_size % 5 = 0 THEN 'not a date' WHEN p_size % 5 = 1 THEN NULL
                    ELSE concat('20', lpad(cast(p_size AS string), 2, '0'), '-01-15') END AS date_text
        FROM part""",
    "numerals": """
        SELECT p_partkey, p_size, p_retailprice,
               concat(CASE WHEN p_size >= 20 THEN translate(cast(cast(floor(p_size / 10) AS bigint) AS string), '123456789', '一二三四五六七八九') ELSE '' END,
                      CASE WHEN p_size >= 10 THEN '十' ELSE '' END,
                      CASE WHEN p_size % 10 > 0 THEN translate(cast(p_size % 10 AS string), '123456789', '一二三四五六七八九') ELSE '' END) AS spoken,
               CASE WHEN p_size % 4 = 0 THEN concat('-', cast(p_size AS string))
                    WHEN p_size % 4 = 1 THEN concat(cast(p_size AS string), '.5') WHEN p_size % 4 = 2 THEN 'none'
                    ELSE NULL END AS mixed,
               p_brand
        FROM part""",
    "lines": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus, l_shipdate,
               l_extendedprice * 2 + 1 AS price_line, -l_quantity AS minus_quantity,
               CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 3 END AS triple_quantity,
               l_quantity + l_linenumber AS quantity_sum
        FROM lineitem""",
    "categories": """
        SELECT n.n_name AS nation, r.r_name AS region,
               CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE 'light' END AS weight,
               c.c_mktsegment AS segment,
               CASE WHEN c.c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS balance,
               CASE WHEN c.c_acctbal > 500 THEN 'rich' WHEN c.c_acctbal IS NULL THEN NULL ELSE 'poor' END AS wealth,
               c.c_custkey
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "rule_results": f"""
        SELECT {_RUN} AS dataset_run_id, l_suppkey AS dataset_id,
               concat('set_', cast(l_suppkey AS string)) AS dataset_name,
               {_RULE} AS rule_config_id,
               CASE WHEN l_linenumber % 2 = 1 THEN 'expect_column_values_to_be_in_set'
                    ELSE 'expect_column_values_to_not_be_null' END AS expectation_name,
               'l_returnflag' AS column_name,
               '{{"value_set":["A","N"]}}' AS kwargs,
               CASE WHEN l_linenumber = 6 THEN 'ERROR'
                    WHEN {_count("l_returnflag = 'R'")} = 0 THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
               {_count("l_returnflag = 'R'")} = 0 AS is_success,
               count(*) AS element_count,
               {_count("l_discount = 0")} AS missing_count,
               {_count("l_returnflag = 'R'")} AS unexpected_count,
               concat('{{"A":', cast({_count("l_returnflag = 'A'")} AS string),
                      ',"N":', cast({_count("l_returnflag = 'N'")} AS string), '}}') AS observed_value,
               concat('{{"match_count":', cast({_count("l_returnflag <> 'R'")} AS string),
                      ',"distinct_match_count":', cast(count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_returnflag END) AS string),
                      ',"total_reference_values":2,"failed_records_table":"set_', cast(l_suppkey AS string),
                      CASE WHEN l_linenumber = 5 THEN '_OTHER' ELSE '_DQ_FAILURE' END, '"}}') AS results,
               max(l_shipdate) AS run_timestamp
        FROM lineitem
        GROUP BY {_RUN}, l_suppkey, l_linenumber, {_RULE}""",
    "datasets": """
        SELECT s_suppkey AS dataset_id, cast(s_nationkey AS bigint) AS project_id,
               concat('project ', cast(s_nationkey AS string)) AS project_name,
               concat('set_', cast(s_suppkey AS string)) AS dataset_name,
               'Warehouse' AS database_name, 'Public' AS schema_name, s_name AS table_name,
               CASE WHEN s_acctbal < 0 THEN 'select 1' END AS custom_sql
        FROM supplier""",
    "rules": f"""
        SELECT {_RULE} AS rule_config_id, l_suppkey AS dataset_id, cast(l_linenumber AS bigint) AS expectation_id,
               CASE WHEN l_linenumber % 2 = 1 THEN 'expect_column_values_to_be_in_set'
                    ELSE 'expect_column_values_to_not_be_null' END AS expectation_name,
               CASE WHEN l_linenumber = 4 THEN NULL WHEN l_suppkey % 9 = 0 THEN '{{broken'
                    WHEN l_linenumber = 2 THEN '["A"]' ELSE '{{"value_set":["A","N"]}}' END AS kwargs,
               CASE WHEN l_linenumber = 3 THEN '' WHEN l_linenumber = 2 THEN 'Validity' END AS dimension,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE 'l_returnflag' END AS column_name,
               CASE WHEN l_linenumber = 1 THEN 'sql' WHEN l_linenumber = 5 THEN 'PANDAS' END AS dq_engine,
               l_suppkey % 5 <> 0 AS is_active
        FROM lineitem GROUP BY l_suppkey, l_linenumber""",
    "master": """
        SELECT cast(l_linenumber AS bigint) AS expectation_id,
               concat('Check ', cast(l_linenumber AS string)) AS validation_name,
               CASE WHEN l_linenumber % 2 = 0 THEN 'Completeness' ELSE 'Conformity' END AS dimension,
               concat('CHECK', cast(l_linenumber AS string)) AS check_type,
               CASE WHEN l_linenumber = 6 THEN 'TABLE' ELSE 'ROW' END AS check_level
        FROM lineitem GROUP BY l_linenumber""",
    "handlers": """
        SELECT concat('CHECK ', cast(l_linenumber AS string)) AS expectation_type,
               concat('handler_', cast(l_linenumber AS string)) AS handler,
               l_linenumber <> 6 AS is_active
        FROM lineitem GROUP BY l_linenumber""",
    "run_log": f"""
        SELECT {_RUN} AS dataset_run_id, l_suppkey AS dataset_id, max(l_shipdate) AS created_timestamp,
               CASE WHEN month(min(l_shipdate)) <> 2
                    THEN concat('failures/set_', cast(l_suppkey AS string), '_', cast({_MONTH} AS string)) END AS failure_file
        FROM lineitem GROUP BY {_RUN}, l_suppkey, {_MONTH}""",
    "failed_records": f"""
        SELECT {_RUN} AS dataset_run_id, {_RULE} AS rule_config_id,
               concat('{{"L_ORDERKEY":', cast(l_orderkey AS string), ',"L_RETURNFLAG":"', l_returnflag,
                      CASE WHEN l_linenumber % 2 = 0 THEN concat('","L_LINESTATUS":"', l_linestatus) ELSE '' END,
                      '"}}') AS failed_row,
               l_shipdate AS load_timestamp
        FROM lineitem WHERE l_quantity > 40""",
    "segment_details": f"""
        SELECT l_suppkey % 7 AS dataset_id, l_suppkey % 3 AS kpi_id, l_suppkey AS microsegment_def_id,
               cast(ascii(l_returnflag) AS bigint) AS microsegment_id,
               {_MONTH} AS microsegment_profiler_snapshot_id,
               CASE WHEN l_suppkey % 13 = 0 THEN '{{}}' ELSE
                 concat('{{"SHIP_MONTH_GRAIN":"', {_MONTH_TEXT}, '","FLAG":"', l_returnflag,
                        '","QTY_SUM":', cast(cast(sum(l_quantity) AS bigint) AS string),
                        ',"LINES":"', cast(count(*) AS string), '"}}') END AS microsegment_profile
        FROM lineitem GROUP BY l_suppkey, l_returnflag, {_MONTH}, {_MONTH_TEXT}""",
    "segment_definitions": """
        SELECT s_suppkey AS microsegment_def_id, s_suppkey % 7 AS dataset_id, s_suppkey % 3 AS kpi_id,
               s_name AS microsegment_def_name,
               CASE WHEN s_suppkey % 2 = 0 THEN concat('segments of ', s_name) END AS microsegment_def_description
        FROM supplier""",
    "segment_attributes": """
        SELECT s_suppkey AS microsegment_def_id, 'FLAG' AS column_name, 'CATEGORY' AS column_type,
               'NONE' AS aggregation_type, 'all' AS filter_condition, 'return flag' AS explanation
        FROM supplier WHERE s_suppkey % 4 <> 0
        UNION ALL
        SELECT s_suppkey, 'QTY_SUM', 'METRIC', 'SUM', 'all', 'quantity' FROM supplier WHERE s_suppkey % 4 <> 0""",
    "segment_anomalies": f"""
        SELECT l_suppkey % 7 AS dataset_id, l_suppkey % 3 AS kpi_id, l_suppkey AS microsegment_def_id,
               cast(ascii(l_returnflag) AS bigint) AS microsegment_id,
               {_MONTH} AS microsegment_profiler_snapshot_id,
               'IQR' AS anomaly_detection_method,
               sum(l_quantity) > 40 AS is_within_anomaly,
               CASE WHEN count(*) > 1 THEN TRUE WHEN min(l_tax) = 0 THEN NULL ELSE FALSE END AS is_across_anomaly,
               CASE WHEN sum(l_quantity) > 40 THEN 'high quantity' END AS within_microsegment_anomaly_reason,
               CASE WHEN count(*) > 1 THEN 'many lines' END AS across_microsegment_anomaly_reason,
               cast(0.5 AS decimal(5,2)) AS within_microsegment_anomaly_confidence_score,
               CASE WHEN count(*) > 1 THEN cast(0.75 AS decimal(5,2)) END AS across_microsegment_anomaly_confidence_score,
               max(l_shipdate) AS created_timestamp
        FROM lineitem GROUP BY l_suppkey, l_returnflag, {_MONTH}
        HAVING max(l_discount) > 0.05""",
    "segment_tagged": f"""
        SELECT l_suppkey % 7 AS dataset_id, l_suppkey % 3 AS kpi_id, l_suppkey AS microsegment_def_id,
               cast(ascii(l_returnflag) AS bigint) AS microsegment_id,
               {_MONTH} AS microsegment_profiler_snapshot_id,
               concat('[{{"attribute_name":"QTY","attribute_value":"', cast(cast(sum(l_quantity) AS bigint) AS string),
                      '","metric_column":"QTY"}},{{"attribute_name":"MONTH","attribute_value":"', {_MONTH_TEXT},
                      '","time_column":"MONTH"}},{{"attribute_name":"STATUS","attribute_value":"x",',
                      '"categorical_column":"STATUS"}},{{"attribute_name":"FLAG","attribute_value":"', l_returnflag,
                      '","categorical_column":"FLAG"}}]') AS microsegment_profile
        FROM lineitem GROUP BY l_suppkey, l_returnflag, {_MONTH}, {_MONTH_TEXT}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Make the tables a query names visible to it."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a fixture derived from the test tables."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    register_tables(spark, sf_dir, FIXTURES[name])
    return spark.sql(FIXTURES[name])


def with_fixtures(sql: str, *names: str) -> str:
    """Oracle SQL with the fixtures it reads in front of it."""
    if not names:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in names) + "\n" + sql.lstrip()
