"""Reporting views over metadata derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.plans import reports
from verification.fixtures import frame, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def view(key: str, function: Callable[..., DataFrame], *inputs: str, oracle: str,
         shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(function(*[frame(spark, sf_dir, name) for name in inputs]))

    QUERIES[key] = run
    ORACLES[key] = with_fixtures(oracle, *inputs)


_KEYS = ("dataset_id", "kpi_id", "microsegment_def_id", "microsegment_id", "microsegment_profiler_snapshot_id")
_KEY_LIST = ", ".join(_KEYS)


_ON = " AND ".join(f"a.{k} = d.{k}" for k in _KEYS)


def _k(alias: str) -> str:
    return ", ".join(f"{alias}.{k}" for k in _KEYS)


view("v1_conformity_dimension", reports.conformity_dimension, "rule_results", oracle="""
    SELECT dataset_run_id, dataset_id, dataset_name, rule_config_id, is_success, json_extract(kwargs, '$.value_set')::VARCHAR AS referential_set,
           element_count, missing_count, element_count - missing_count AS non_null_count, (results ->> '$.match_count')::BIGINT AS match_count, unexpected_count,
           (results ->> '$.distinct_match_count')::BIGINT AS distinct_match_count, (results ->> '$.total_reference_values')::BIGINT AS total_reference_count,
           run_timestamp::DATE AS run_date, run_timestamp AS run_time
    FROM rule_results WHERE expectation_name = 'expect_column_values_to_be_in_set'
    QUALIFY row_number() OVER (PARTITION BY rule_config_id ORDER BY run_timestamp DESC, dataset_run_id DESC) = 1""")

view("v2_conformity_distribution", reports.conformity_distribution, "rule_results", oracle="""
    , latest AS (SELECT * FROM rule_results WHERE expectation_name = 'expect_column_values_to_be_in_set'
                 QUALIFY row_number() OVER (PARTITION BY rule_config_id ORDER BY dataset_run_id DESC) = 1)
    SELECT dataset_run_id, dataset_id, rule_config_id, dataset_name, column_name, k AS ref_value, json_extract_string(observed_value, '$.' || k)::BIGINT AS count_match,
           element_count - missing_count AS non_null_count, run_timestamp::DATE AS run_date
    FROM (SELECT *, unnest(json_keys(observed_value)) AS k FROM latest)
    UNION ALL SELECT dataset_run_id, dataset_id, rule_config_id, dataset_name, column_name, 'Others', unexpected_count, element_count - missing_count, run_timestamp::DATE
    FROM latest WHERE unexpected_count > 0""")

view("v3_latest_run_status", reports.latest_run_status, "rule_results", "rules", "master", "datasets", oracle="""
    SELECT c.rule_config_id, r.dataset_run_id, d.dataset_name, coalesce(nullif(c.dimension, ''), m.dimension) AS dimension, r.is_success, r.run_timestamp,
           r.run_timestamp::DATE AS run_date
    FROM rule_results r JOIN rules c ON r.rule_config_id = c.rule_config_id AND c.is_active JOIN master m ON m.expectation_id = c.expectation_id
    JOIN datasets d ON d.dataset_id = c.dataset_id
    QUALIFY row_number() OVER (PARTITION BY c.rule_config_id ORDER BY r.run_timestamp DESC, r.dataset_run_id DESC) = 1""")

view("v4_ranked_runs", reports.ranked_runs, "rule_results", oracle="""
    SELECT dataset_id, dataset_run_id, dense_rank() OVER (PARTITION BY dataset_id ORDER BY dataset_run_id DESC)::INTEGER AS rnk
    FROM (SELECT DISTINCT dataset_id, dataset_run_id FROM rule_results)""")

view("v5_failed_file_latest", reports.failed_file_latest, "run_log", "datasets", "rule_results", oracle="""
    SELECT d.dataset_name, r.dataset_run_id, r.created_timestamp, res.results ->> '$.failed_records_table' AS failure_table, r.failure_file AS failed_file
    FROM run_log r JOIN datasets d ON d.dataset_id = r.dataset_id LEFT JOIN rule_results res ON r.dataset_run_id = res.dataset_run_id
    WHERE NOT res.is_success AND res.results ->> '$.failed_records_table' LIKE '%_DQ_FAILURE'
    QUALIFY row_number() OVER (PARTITION BY d.dataset_name ORDER BY r.created_timestamp DESC, r.dataset_run_id DESC, failure_table) = 1""")

view("v6_failed_file_history", reports.failed_file_history, "run_log", "datasets", "rule_results", oracle="""
    SELECT DISTINCT d.dataset_id, d.dataset_name, r.dataset_run_id, r.created_timestamp, res.results ->> '$.failed_records_table' AS failure_table, r.failure_file
    FROM run_log r JOIN datasets d ON d.dataset_id = r.dataset_id JOIN rule_results res ON r.dataset_run_id = res.dataset_run_id
    WHERE NOT res.is_success AND r.failure_file IS NOT NULL AND suffix(res.results ->> '$.failed_records_table', '_DQ_FAILURE')""")

view("v7_last_run_failed_records", reports.last_run_failed_records, "failed_records", "rules", "datasets", oracle="""
    SELECT m.dataset_id, m.dataset_name, f.dataset_run_id, f.rule_config_id, f.failed_row, f.load_timestamp
    FROM (SELECT c.dataset_id, d.dataset_name, max(x.dataset_run_id) AS run FROM failed_records x LEFT JOIN rules c ON c.rule_config_id = x.rule_config_id
          LEFT JOIN datasets d ON d.dataset_id = c.dataset_id GROUP BY ALL) m JOIN failed_records f ON f.dataset_run_id = m.run""")

view("v8_results_with_date", reports.results_with_date, "rule_results", oracle="SELECT *, run_timestamp::DATE AS run_date FROM rule_results")

view("v9_failed_record_analysis", reports.failed_record_analysis, "failed_records", oracle="""
    SELECT rule_config_id, dataset_run_id AS max_dataset, failed_row FROM failed_records
    QUALIFY row_number() OVER (PARTITION BY rule_config_id ORDER BY dataset_run_id DESC, len(json_keys(failed_row)) DESC, failed_row) = 1""")

view("v10_failed_record_flatten", lambda df: reports.flatten_record(df, ["L_ORDERKEY", "L_RETURNFLAG", "L_LINESTATUS", "ABSENT"]), "failed_records", oracle="""
    SELECT dataset_run_id, rule_config_id, load_timestamp, failed_row ->> '$.L_ORDERKEY' AS "L_ORDERKEY", failed_row ->> '$.L_RETURNFLAG' AS "L_RETURNFLAG",
           failed_row ->> '$.L_LINESTATUS' AS "L_LINESTATUS", failed_row ->> '$.ABSENT' AS "ABSENT" FROM failed_records""")


def _context_shape(df: DataFrame) -> DataFrame:
    context = F.parse_json("microsegment_context")
    return df.select(
        *_KEYS, "microsegment_profile",
        F.variant_get(context, "$.definition.microsegment_def_name", "string").alias("def_name"),
        F.try_variant_get(context, "$.attributes[0].column_name", "string").alias("first_attribute"),
        F.try_variant_get(context, "$.attributes[1].explanation", "string").alias("second_explanation"),
        "is_anomaly", "anomaly_detection_method", "is_within_anomaly", "is_across_anomaly", "within_microsegment_anomaly_reason",
        "across_microsegment_anomaly_reason", F.col("within_microsegment_anomaly_confidence_score").cast("double").alias("within_score"),
        F.col("across_microsegment_anomaly_confidence_score").cast("double").alias("across_score"), "anomaly_created_timestamp",
    )


view("v11_microsegment_context", reports.microsegment_context, "segment_details", "segment_definitions", "segment_attributes", "segment_anomalies",
     shape=_context_shape, oracle=f"""
    SELECT {_k('d')}, d.microsegment_profile, f.microsegment_def_name AS def_name, CASE WHEN f.microsegment_def_id % 4 <> 0 THEN 'FLAG' END AS first_attribute,
           CASE WHEN f.microsegment_def_id % 4 <> 0 THEN 'quantity' END AS second_explanation, a.microsegment_id IS NOT NULL AS is_anomaly, a.anomaly_detection_method,
           a.is_within_anomaly, a.is_across_anomaly, a.within_microsegment_anomaly_reason, a.across_microsegment_anomaly_reason,
           a.within_microsegment_anomaly_confidence_score::DOUBLE AS within_score, a.across_microsegment_anomaly_confidence_score::DOUBLE AS across_score,
           a.created_timestamp AS anomaly_created_timestamp
    FROM (SELECT * FROM segment_details QUALIFY microsegment_profiler_snapshot_id = max(microsegment_profiler_snapshot_id) OVER (PARTITION BY dataset_id, kpi_id, microsegment_def_id)) d
    JOIN segment_definitions f ON f.microsegment_def_id = d.microsegment_def_id
    LEFT JOIN segment_anomalies a ON {_ON}""")

_FLAT = f"""
    , base AS (SELECT {_k('d')}, f.microsegment_def_name, f.microsegment_def_description, d.microsegment_profile, a.anomaly_detection_method, a.is_within_anomaly,
             a.is_across_anomaly, a.within_microsegment_anomaly_reason AS wr, a.across_microsegment_anomaly_reason AS ar,
             a.within_microsegment_anomaly_confidence_score AS ws, a.across_microsegment_anomaly_confidence_score AS acs, a.created_timestamp AS anomaly_created_ts
      FROM segment_details d LEFT JOIN segment_definitions f ON f.microsegment_def_id = d.microsegment_def_id LEFT JOIN segment_anomalies a ON {_ON}),
    flat AS (SELECT *, json_extract_string(microsegment_profile, '$.' || k) AS v FROM (
               SELECT *, unnest(CASE WHEN len(json_keys(microsegment_profile)) = 0 THEN [NULL] ELSE json_keys(microsegment_profile) END) AS k FROM base)),
    typed AS (SELECT *, TRY_CAST(v AS DECIMAL(38,0)) AS num, CASE WHEN regexp_matches(v, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST(v AS DATE) END AS day FROM flat)"""
_FLAT_INPUTS = ("segment_details", "segment_definitions", "segment_anomalies")


def _scores(df: DataFrame) -> DataFrame:
    df = df.withColumn("confidence_score", F.col("confidence_score").cast("double"))
    return df.withColumn("metric_value", F.col("metric_value").cast("bigint")) if "metric_value" in df.columns else df


view("v12_anomaly_flat", reports.anomaly_flat, *_FLAT_INPUTS, shape=_scores, oracle=_FLAT + f"""
    SELECT {_KEY_LIST}, microsegment_def_name, microsegment_def_description, k AS attribute_name, v AS attribute_value, CASE WHEN num IS NOT NULL THEN k END AS metric_name,
           num::BIGINT AS metric_value, CASE WHEN day IS NOT NULL THEN k END AS time_attribute_name, day AS time_attribute_value,
           CASE WHEN is_within_anomaly THEN 'WITHIN' WHEN is_across_anomaly THEN 'ACROSS' ELSE 'NONE' END AS anomaly_scope, anomaly_detection_method,
           coalesce(wr, ar) AS anomaly_reason, greatest(coalesce(ws, 0), coalesce(acs, 0))::DOUBLE AS confidence_score, anomaly_created_ts FROM typed""")

_V13 = _FLAT + f"""
    SELECT {_KEY_LIST}, microsegment_def_name, k AS attribute_name, v AS attribute_value, CASE WHEN num IS NOT NULL THEN k END AS metric_column,
           CASE WHEN day IS NOT NULL AND num IS NULL THEN k END AS time_column, CASE WHEN day IS NULL AND num IS NULL THEN k END AS categorical_column,
           coalesce(is_within_anomaly OR is_across_anomaly, FALSE) AS is_anomaly,
           CASE WHEN is_within_anomaly THEN 'WITHIN' WHEN is_across_anomaly THEN 'ACROSS' END AS anomaly_scope, anomaly_detection_method,
           CASE WHEN is_within_anomaly OR is_across_anomaly THEN coalesce(wr, ar) END AS anomaly_reason,
           CASE WHEN is_within_anomaly OR is_across_anomaly THEN greatest(coalesce(ws, 0), coalesce(acs, 0))::DOUBLE END AS confidence_score, anomaly_created_ts FROM typed"""
view("v13_anomaly_flat_classes", reports.anomaly_flat_classes, *_FLAT_INPUTS, shape=_scores, oracle=_V13)
view("v13_anomaly_flat_classes_2", reports.anomaly_flat_classes_2, *_FLAT_INPUTS, shape=_scores, oracle=_V13)

_FLAGS = "coalesce(a.is_within_anomaly, FALSE) OR coalesce(a.is_across_anomaly, FALSE) AS is_anomaly, a.anomaly_detection_method"

view("v14_final_analysis", reports.final_analysis, "segment_details", "segment_anomalies", oracle=f"""
    , kv AS (SELECT *, json_extract_string(microsegment_profile, '$.' || k) AS v FROM (SELECT *, unnest(json_keys(microsegment_profile)) AS k FROM segment_details)),
    m AS (SELECT {_KEY_LIST}, max(CASE WHEN k LIKE '%_AGG' OR k LIKE '%_SUM' THEN TRY_CAST(v AS DOUBLE) END) AS metric_value,
                 max(CASE WHEN k LIKE '%_GRAIN' OR k LIKE '%_DT_%' THEN TRY_CAST(v AS DATE) END) AS time_value,
                 coalesce(string_agg(v, ' | ' ORDER BY k) FILTER (WHERE k NOT LIKE '%_AGG' AND k NOT LIKE '%_SUM' AND k NOT LIKE '%_GRAIN' AND k NOT LIKE '%_DT_%'), '') AS categorical_legend
          FROM kv GROUP BY {_KEY_LIST})
    SELECT m.*, {_FLAGS}, a.within_microsegment_anomaly_reason, a.across_microsegment_anomaly_reason FROM m LEFT JOIN segment_anomalies a USING ({_KEY_LIST})""")

view("v15_tagged_analysis", reports.tagged_analysis, "segment_tagged", "segment_anomalies",
     shape=lambda df: df.withColumn("within_microsegment_anomaly_confidence_score", F.col("within_microsegment_anomaly_confidence_score").cast("double")), oracle=f"""
    , kv AS (SELECT *, e ->> '$.attribute_name' AS k, e ->> '$.attribute_value' AS v FROM (
               SELECT *, unnest(json_extract(microsegment_profile, '$[*]')) AS e FROM segment_tagged)),
    m AS (SELECT {_KEY_LIST}, max(CASE WHEN e ->> '$.metric_column' IS NOT NULL THEN TRY_CAST(v AS DOUBLE) END) AS metric_value,
                 max(CASE WHEN e ->> '$.time_column' IS NOT NULL THEN TRY_CAST(v AS DATE) END) AS time_value,
                 string_agg(v, ' | ' ORDER BY k) FILTER (WHERE e ->> '$.categorical_column' IS NOT NULL) AS categorical_legend FROM kv GROUP BY {_KEY_LIST})
    SELECT m.*, {_FLAGS}, a.within_microsegment_anomaly_reason, a.within_microsegment_anomaly_confidence_score::DOUBLE AS within_microsegment_anomaly_confidence_score
    FROM m LEFT JOIN segment_anomalies a USING ({_KEY_LIST})""")

view("v16_dataset_names", reports.dataset_names, "datasets", oracle="""
    SELECT dataset_id, project_id, upper(project_name) AS project_name, upper(dataset_name) AS dataset_name, database_name, schema_name, table_name, custom_sql FROM datasets""")
