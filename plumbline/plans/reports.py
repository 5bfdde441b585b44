"""Reporting views over results, runs, failing records and microsegments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.suite import FAILURE_TABLE_SUFFIX

IN_SET = "expect_column_values_to_be_in_set"
SEGMENT_KEYS = (
    "dataset_id", "kpi_id", "microsegment_def_id", "microsegment_id", "microsegment_profiler_snapshot_id",
)


def latest(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key in the given order.

    The filter on the rank is pushed below the shuffle, so each task sends at
    most one row per key.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def conformity_dimension(results: DataFrame) -> DataFrame:
    """Latest value-set result per rule with its match figures."""
    in_set = results.where(F.col("expectation_name") == IN_SET)
    doc = F.try_parse_json("results")
    return latest(in_set, ["rule_config_id"], F.desc("run_timestamp"), F.desc("dataset_run_id")).select(
        "dataset_run_id", "dataset_id", "dataset_name", "rule_config_id", "is_success",
        F.get_json_object("kwargs", "$.value_set").alias("referential_set"),
        "element_count", "missing_count",
        (F.col("element_count") - F.col("missing_count")).alias("non_null_count"),
        F.try_variant_get(doc, "$.match_count", "bigint").alias("match_count"),
        "unexpected_count",
        F.try_variant_get(doc, "$.distinct_match_count", "bigint").alias("distinct_match_count"),
        F.try_variant_get(doc, "$.total_reference_values", "bigint").alias("total_reference_count"),
        F.to_date("run_timestamp").alias("run_date"),
        F.col("run_timestamp").alias("run_time"),
    )


def conformity_distribution(results: DataFrame) -> DataFrame:
    """Matched values of the latest value-set result per rule, all others as one row."""
    in_set = results.where(F.col("expectation_name") == IN_SET)
    newest = latest(in_set, ["rule_config_id"], F.desc("dataset_run_id"), F.desc("run_timestamp")).select(
        "dataset_run_id", "dataset_id", "rule_config_id", "dataset_name", "column_name",
        F.from_json("observed_value", "map<string,bigint>").alias("matched"),
        (F.col("element_count") - F.col("missing_count")).alias("non_null_count"),
        "unexpected_count", F.to_date("run_timestamp").alias("run_date"),
    )
    # Both parts come out of one pass over the latest rows.
    others = F.when(
        F.col("unexpected_count") > 0,
        F.struct(F.lit("Others").alias("key"), F.col("unexpected_count").alias("value")),
    )
    entries = F.concat(
        F.coalesce(F.map_entries("matched"), F.array().cast("array<struct<key:string,value:bigint>>")),
        F.array_compact(F.array(others)),
    )
    return newest.withColumn("e", F.explode(entries)).select(
        "dataset_run_id", "dataset_id", "rule_config_id", "dataset_name", "column_name",
        F.col("e.key").alias("ref_value"), F.col("e.value").alias("count_match"),
        "non_null_count", "run_date",
    )


def latest_run_status(
    results: DataFrame, rules: DataFrame, master: DataFrame, datasets: DataFrame
) -> DataFrame:
    """Latest verdict per active rule with dataset name and dimension."""
    active = (
        rules.where("is_active").alias("c")
        .join(F.broadcast(master.alias("m")), F.col("c.expectation_id") == F.col("m.expectation_id"))
        .join(datasets.alias("d"), F.col("c.dataset_id") == F.col("d.dataset_id"))
        .select(
            F.col("c.rule_config_id").alias("rule_config_id"), F.col("d.dataset_name").alias("dataset_name"),
            F.coalesce(F.nullif("c.dimension", F.lit("")), "m.dimension").alias("dimension"),
        )
    )
    # The rank comes first: one row per rule is left to join.
    newest = latest(
        results.select("rule_config_id", "dataset_run_id", "is_success", "run_timestamp"),
        ["rule_config_id"], F.desc("run_timestamp"), F.desc("dataset_run_id"),
    )
    return newest.join(active, "rule_config_id").select(
        "rule_config_id", "dataset_run_id", "dataset_name", "dimension", "is_success",
        "run_timestamp", F.to_date("run_timestamp").alias("run_date"),
    )


def ranked_runs(results: DataFrame) -> DataFrame:
    """Runs per dataset, newest first."""
    runs = results.select("dataset_id", "dataset_run_id").distinct()
    order = Window.partitionBy("dataset_id").orderBy(F.desc("dataset_run_id"))
    return runs.withColumn("rnk", F.dense_rank().over(order))


def _failed_tables(run_log: DataFrame, datasets: DataFrame, results: DataFrame) -> DataFrame:
    failed = results.where(~F.col("is_success")).select(
        "dataset_run_id",
        F.get_json_object("results", "$.failed_records_table").alias("failure_table"),
    ).distinct()
    return (
        run_log.join(datasets.select("dataset_id", "dataset_name"), "dataset_id")
        .join(failed, "dataset_run_id")
        .select("dataset_id", "dataset_name", "dataset_run_id", "created_timestamp",
                "failure_table", "failure_file")
    )


def failed_file_latest(run_log: DataFrame, datasets: DataFrame, results: DataFrame) -> DataFrame:
    """Where the failing rows of the newest failed run of each dataset are."""
    runs = _failed_tables(run_log, datasets, results).where(
        F.col("failure_table").like(f"%{FAILURE_TABLE_SUFFIX}")
    )
    return latest(runs, ["dataset_name"], F.desc("created_timestamp"), F.desc("dataset_run_id"),
                  F.col("failure_table")).select(
        "dataset_name", "dataset_run_id", "created_timestamp", "failure_table",
        F.col("failure_file").alias("failed_file"),
    )


def failed_file_history(run_log: DataFrame, datasets: DataFrame, results: DataFrame) -> DataFrame:
    """Where the failing rows of every failed run are."""
    return (
        _failed_tables(run_log, datasets, results)
        .where(F.col("failure_file").isNotNull() & F.col("failure_table").endswith(FAILURE_TABLE_SUFFIX))
        .distinct()
    )


def last_run_failed_records(records: DataFrame, rules: DataFrame, datasets: DataFrame) -> DataFrame:
    """Failing records of the newest run of each dataset."""
    # Runs and rules are counted down before names are joined.
    runs = records.groupBy("rule_config_id").agg(F.max("dataset_run_id").alias("run"))
    newest = (
        runs.join(rules.select("rule_config_id", "dataset_id"), "rule_config_id", "left")
        .join(datasets.select("dataset_id", "dataset_name"), "dataset_id", "left")
        .groupBy("dataset_id", "dataset_name").agg(F.max("run").alias("max_run"))
    )
    # One row per dataset; nearly all records may be of one run, so they stay where they are.
    return records.join(F.broadcast(newest.withColumnRenamed("max_run", "dataset_run_id")), "dataset_run_id").select(
        "dataset_id", "dataset_name", "dataset_run_id", "rule_config_id", "failed_row", "load_timestamp"
    )


def results_with_date(results: DataFrame) -> DataFrame:
    return results.withColumn("run_date", F.to_date("run_timestamp"))


def failed_record_analysis(records: DataFrame) -> DataFrame:
    """Per rule, a record of the newest run with the most fields."""
    return latest(
        records, ["rule_config_id"], F.desc("dataset_run_id"),
        F.desc(F.size(F.json_object_keys("failed_row"))), F.col("failed_row"),
    ).select("rule_config_id", F.col("dataset_run_id").alias("max_dataset"), "failed_row")


def flatten_record(
    df: DataFrame, keys: Sequence[str], column: str = "failed_row", keep: Sequence[str] | None = None
) -> DataFrame:
    """Named fields of a JSON document as text columns; the document is parsed once."""
    kept = [c for c in (keep if keep is not None else df.columns) if c != column]
    parsed = df.withColumn("_doc", F.try_parse_json(column))
    return parsed.select(
        *kept,
        *[F.try_variant_get("_doc", "$['" + k.replace("'", "\\'") + "']", "string").alias(k) for k in keys],
    )


def dataset_names(datasets: DataFrame) -> DataFrame:
    return datasets.select(
        "dataset_id", "project_id", F.upper("project_name").alias("project_name"),
        F.upper("dataset_name").alias("dataset_name"), "database_name", "schema_name",
        "table_name", "custom_sql",
    )


def microsegment_context(
    details: DataFrame, definitions: DataFrame, attributes: DataFrame, anomalies: DataFrame
) -> DataFrame:
    """Newest snapshot per definition, with its nested context and its anomalies."""
    key = ["dataset_id", "kpi_id", "microsegment_def_id"]
    newest = details.groupBy(*key).agg(
        F.max("microsegment_profiler_snapshot_id").alias("microsegment_profiler_snapshot_id")
    )
    current = details.join(newest, [*key, "microsegment_profiler_snapshot_id"])
    # Attributes of a definition are its columns: a short list by nature.
    nested = attributes.groupBy("microsegment_def_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "column_name", "column_type", "aggregation_type", "filter_condition", "explanation"
        ))).alias("attributes")
    )
    context = definitions.join(nested, "microsegment_def_id", "left").select(
        "microsegment_def_id",
        F.to_json(F.struct(
            F.struct("microsegment_def_name", "microsegment_def_description", "kpi_id", "dataset_id")
            .alias("definition"),
            F.coalesce("attributes", F.array()).alias("attributes"),
        )).alias("microsegment_context"),
    )
    joined = current.join(context, "microsegment_def_id").join(
        _renamed(anomalies), list(SEGMENT_KEYS), "left"
    )
    return joined.select(
        *SEGMENT_KEYS, "microsegment_profile", "microsegment_context",
        F.col("anomaly_detection_method").isNotNull().alias("is_anomaly"),
        *ANOMALY_COLUMNS, "anomaly_created_timestamp",
    )


ANOMALY_COLUMNS = (
    "anomaly_detection_method", "is_within_anomaly", "is_across_anomaly",
    "within_microsegment_anomaly_reason", "across_microsegment_anomaly_reason",
    "within_microsegment_anomaly_confidence_score", "across_microsegment_anomaly_confidence_score",
)


def _renamed(anomalies: DataFrame) -> DataFrame:
    return anomalies.select(
        *SEGMENT_KEYS, *ANOMALY_COLUMNS, F.col("created_timestamp").alias("anomaly_created_timestamp")
    )


def _flattened(details: DataFrame, definitions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Segments with one row per profile attribute, attributes without value kept."""
    names = definitions.select("microsegment_def_id", "microsegment_def_name", "microsegment_def_description")
    base = details.join(names, "microsegment_def_id", "left").join(
        _renamed(anomalies), list(SEGMENT_KEYS), "left"
    )
    attributes = F.map_entries(F.from_json("microsegment_profile", "map<string,string>"))
    value = F.col("a.value")
    return base.withColumn("a", F.explode_outer(attributes)).withColumns({
        "attribute_name": F.col("a.key"), "attribute_value": value,
        "number": value.try_cast("decimal(38,0)"),
        # Only whole dates: a bare year or number is no date.
        "day": F.when(value.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), value.try_cast("date")),
    })


def _scope(default: str | None) -> Column:
    return (
        F.when(F.col("is_within_anomaly"), "WITHIN").when(F.col("is_across_anomaly"), "ACROSS")
        .otherwise(F.lit(default))
    )


def _reason() -> Column:
    return F.coalesce("within_microsegment_anomaly_reason", "across_microsegment_anomaly_reason")


def _score() -> Column:
    zero = F.lit(0).cast("decimal(5,2)")
    return F.greatest(
        F.coalesce("within_microsegment_anomaly_confidence_score", zero),
        F.coalesce("across_microsegment_anomaly_confidence_score", zero),
    )


def anomaly_flat(details: DataFrame, definitions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Profile attributes as rows, numeric ones as metric, dates as time."""
    flat = _flattened(details, definitions, anomalies)
    name = F.col("attribute_name")
    return flat.select(
        *SEGMENT_KEYS, "microsegment_def_name", "microsegment_def_description",
        "attribute_name", "attribute_value",
        F.when(F.col("number").isNotNull(), name).alias("metric_name"),
        F.col("number").alias("metric_value"),
        F.when(F.col("day").isNotNull(), name).alias("time_attribute_name"),
        F.col("day").alias("time_attribute_value"),
        _scope("NONE").alias("anomaly_scope"), "anomaly_detection_method",
        _reason().alias("anomaly_reason"), _score().alias("confidence_score"),
        F.col("anomaly_created_timestamp").alias("anomaly_created_ts"),
    )


def anomaly_flat_classes(details: DataFrame, definitions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """As ``anomaly_flat``, each attribute in exactly one class, reasons only for anomalies."""
    flat = _flattened(details, definitions, anomalies)
    name, number, day = F.col("attribute_name"), F.col("number"), F.col("day")
    anomalous = F.coalesce(F.col("is_within_anomaly") | F.col("is_across_anomaly"), F.lit(False))
    return flat.select(
        "dataset_id", "kpi_id", "microsegment_def_id", "microsegment_def_name",
        "microsegment_profiler_snapshot_id", "microsegment_id", "attribute_name", "attribute_value",
        F.when(number.isNotNull(), name).alias("metric_column"),
        F.when(day.isNotNull() & number.isNull(), name).alias("time_column"),
        F.when(day.isNull() & number.isNull(), name).alias("categorical_column"),
        anomalous.alias("is_anomaly"), _scope(None).alias("anomaly_scope"),
        "anomaly_detection_method",
        F.when(anomalous, _reason()).alias("anomaly_reason"),
        F.when(anomalous, _score()).alias("confidence_score"),
        F.col("anomaly_created_timestamp").alias("anomaly_created_ts"),
    )


# Second name of the same view.
anomaly_flat_classes_2 = anomaly_flat_classes


def _legend_view(segments: DataFrame, anomalies: DataFrame, columns: Sequence[str]) -> DataFrame:
    flags = anomalies.select(*SEGMENT_KEYS, *ANOMALY_COLUMNS)
    joined = segments.join(flags, list(SEGMENT_KEYS), "left")
    return joined.select(
        *SEGMENT_KEYS, "metric_value", "time_value", "categorical_legend",
        (F.coalesce("is_within_anomaly", F.lit(False)) | F.coalesce("is_across_anomaly", F.lit(False)))
        .alias("is_anomaly"),
        "anomaly_detection_method", *columns,
    )


def final_analysis(details: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row per segment: metric, time and legend told apart by attribute name.

    All attributes of a segment sit in its own document, so the pivot needs
    array functions and no shuffle.
    """
    entries = F.map_entries(F.from_json("microsegment_profile", "map<string,string>"))

    def metric(name: Column) -> Column:
        return name.like("%_AGG") | name.like("%_SUM")

    def time(name: Column) -> Column:
        return name.like("%_GRAIN") | name.like("%_DT_%")

    def values(test) -> Column:
        return F.filter(F.col("e"), lambda a: test(a["key"]))

    shaped = details.withColumn("e", F.array_sort(entries)).where(F.size("e") > 0).select(
        *SEGMENT_KEYS,
        F.array_max(F.transform(values(metric), lambda a: a["value"].try_cast("double"))).alias("metric_value"),
        F.array_max(F.transform(values(time), lambda a: _day(a["value"]))).alias("time_value"),
        F.array_join(
            F.transform(values(lambda n: ~metric(n) & ~time(n)), lambda a: a["value"]), " | "
        ).alias("categorical_legend"),
    )
    return _legend_view(
        shaped, anomalies,
        ["within_microsegment_anomaly_reason", "across_microsegment_anomaly_reason"],
    )


def _day(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("date"))


TAGGED = (
    "array<struct<attribute_name:string,attribute_value:string,metric_column:string,"
    "time_column:string,categorical_column:string>>"
)


def tagged_analysis(details: DataFrame, anomalies: DataFrame) -> DataFrame:
    """As ``final_analysis``, for profiles that are lists of tagged attributes."""
    items = F.array_sort(F.from_json("microsegment_profile", TAGGED))

    def tagged(tag: str) -> Column:
        return F.filter(F.col("e"), lambda a: a[tag].isNotNull())

    shaped = details.withColumn("e", items).where(F.size("e") > 0).select(
        *SEGMENT_KEYS,
        F.array_max(F.transform(tagged("metric_column"), lambda a: a["attribute_value"].try_cast("double")))
        .alias("metric_value"),
        F.array_max(F.transform(tagged("time_column"), lambda a: _day(a["attribute_value"]))).alias("time_value"),
        F.array_join(F.transform(tagged("categorical_column"), lambda a: a["attribute_value"]), " | ")
        .alias("categorical_legend"),
    )
    return _legend_view(
        shaped, anomalies,
        ["within_microsegment_anomaly_reason", "within_microsegment_anomaly_confidence_score"],
    )
