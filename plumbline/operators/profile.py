"""Column and dataset profiles.

Everything that is a plain aggregate comes from one scan over all columns.  Only
statistics about single values (exact distinct, unique, frequencies) need the
values themselves; they come from one shuffle of ``(column, value)`` counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.local import local_frame
from plumbline.functions.numerals import (
    NUMERAL_COLUMN_PATTERN, localise_stats, normalise_numeric,
)
from plumbline.functions.text import is_text
from plumbline.model import quoted
from plumbline.operators.percentiles import column_percentiles
from plumbline.sources.datasets import estimated_bytes, type_label

PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}
# Bytes counted per value of a fixed-width type.
TYPE_BYTES = {
    T.ByteType: 8, T.ShortType: 8, T.IntegerType: 8, T.LongType: 8, T.FloatType: 4,
    T.DoubleType: 8, T.DecimalType: 16, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


#: Size of the sketches: distinct counts are about 2 % off, percentiles about 0.1 % of the ranks.
DISTINCT_SIZE = 12
QUANTILE_SIZE = 4096
#: Characters up to which a value stands for itself where values are counted.
KEY_LENGTH = 64


@dataclass(frozen=True)
class ProfileOptions:
    """``exact`` replaces sketches by exact counts and percentiles.

    Extended profiles quote the ``value_limit`` most frequent values of a column,
    ties broken by value, and the ``length_limit`` shortest lengths of its texts;
    None quotes all.  ``value_counts`` has every value as a frame.
    """

    exact: bool = False
    extended: bool = False
    columns_per_scan: int = 50
    first_rows: int = 5
    order_by: tuple[str, ...] = ()
    value_limit: int | None = 50
    length_limit: int | None = None


def profile_columns(
    df: DataFrame, options: ProfileOptions = ProfileOptions(), run_id: int = 0, dataset_id: int = 0
) -> DataFrame:
    """One row per column: counts, distinct, extremes, spread, percentiles and alerts."""
    fields = [f for f in df.schema.fields if _profiled(f.dataType)]
    ids = {f.name: i for i, f in enumerate(df.schema.fields, 1)}
    firsts = _first_rows(df, fields, options)
    batches = [
        fields[i:i + options.columns_per_scan]
        for i in range(0, len(fields), options.columns_per_scan)
    ]
    profile = reduce(
        lambda a, b: a.unionByName(b),
        [_batch_profile(df, batch, ids, firsts, options) for batch in batches],
    )
    if options.exact or options.extended:
        counts = key_counts(df, [f.name for f in fields])
        profile = _with_value_statistics(profile, df, counts, options)
    if options.exact:
        profile = _with_exact_percentiles(profile, df, fields)
    total, non_null = F.col("total_count"), F.col("non_null_count")
    profile = profile.withColumns({
        "missing_count": total - non_null,
        "missing_percentage": _percent(total - non_null, total),
        "distinct_percentage": _percent(F.col("distinct_count"), total),
    })
    profile = profile.withColumn("alert", column_alerts())
    if options.extended:
        profile = _with_extended_ratios(profile)
    return profile.select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(dataset_id).cast("bigint").alias("dataset_id"), "*",
    )


def _profiled(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole) * 100, F.lit(0.0))


def _is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _first_rows(df: DataFrame, fields: Sequence[T.StructField], options: ProfileOptions) -> Column:
    """Non-null values of a few rows per column, as JSON arrays in one struct."""
    ordered = df.orderBy(*[F.col(quoted(c)) for c in options.order_by]) if options.order_by else df
    few = ordered.select(*[F.col(quoted(f.name)).cast("string").alias(f"c{i}")
                           for i, f in enumerate(fields)]).limit(options.first_rows)
    return (
        few.agg(F.struct(*[
            F.to_json(F.collect_list(f"c{i}")).alias(f"c{i}") for i in range(len(fields))
        ]).alias("s")).scalar()
    )


def _batch_profile(
    df: DataFrame, fields: Sequence[T.StructField], ids: dict[str, int], firsts: Column,
    options: ProfileOptions,
) -> DataFrame:
    position = {f.name: i for i, f in enumerate(f for f in df.schema.fields if _profiled(f.dataType))}
    aggregates: dict[str, Column] = {"n": F.count(F.lit(1))}
    sketches: dict[str, Column] = {}
    rows = []
    for f in fields:
        p = f"c{ids[f.name]}_"
        named = _column_aggregates(F.col(quoted(f.name)), f.dataType, options)
        aggregates.update({p + k: v for k, v in named.items()})
        own = {} if options.exact else _column_sketches(F.col(quoted(f.name)), f.dataType)
        sketches.update({p + k: v for k, v in own.items()})
        m = {k: F.col(p + k) for k in (*named, *own)}
        if "quantiles" in m:
            ranks = F.array(*[F.lit(r) for r in PERCENTILES.values()])
            m["percentiles"] = F.when(m["non_null"] > 0, F.kll_sketch_get_quantile_double(m["quantiles"], ranks))
        if "hashes" in m:
            m["distinct"] = F.hll_sketch_estimate(m["hashes"])
        first = F.col("_first")[f"c{position[f.name]}"]
        rows.append(_profile_struct(f, ids[f.name], m, first, options))
    wide = df.agg(*[v.alias(k) for k, v in aggregates.items()]).withColumn("_first", firsts)
    if sketches:
        # A row each; sketches apart, so that the plain aggregates are compiled.
        wide = wide.crossJoin(df.agg(*[v.alias(k) for k, v in sketches.items()]))
    return wide.select(F.inline(F.array(*rows)))


def _column_sketches(col: Column, dtype: T.DataType) -> dict[str, Column]:
    """One sketch of a column's distinct values and, for numbers, one for all its percentiles."""
    out = {"hashes": F.hll_sketch_agg(F.when(col.isNotNull(), F.xxhash64(col)), F.lit(DISTINCT_SIZE))}
    if _is_numeric(dtype):
        out["quantiles"] = F.kll_sketch_agg_double(col.cast("double"), F.lit(QUANTILE_SIZE))
    return out


def _column_aggregates(col: Column, dtype: T.DataType, options: ProfileOptions) -> dict[str, Column]:
    out = {"non_null": F.count(col), "min": F.min(col), "max": F.max(col)}
    if _is_numeric(dtype):
        value = col.cast("double")
        out["stddev"] = F.stddev_samp(value)
        out["zero"] = F.count_if(col == 0)
        if options.extended:
            out["mean"] = F.avg(value)
            out["sum"] = F.sum(value)
            out["negative"] = F.count_if(col < 0)
            out["kurtosis"] = F.kurtosis(value)
            out["skewness"] = F.skewness(value)
    if is_text(dtype):
        length = F.length(col)
        out["avg_length"] = F.avg(length)
        out["invalid_dates"] = F.count_if(col.isNotNull() & col.try_cast("date").isNull())
        if options.extended:
            out["min_length"] = F.min(length)
            out["max_length"] = F.max(length)
            # Lengths take few distinct values, so the exact median is safe here.
            out["median_length"] = F.median(length)
    return out


def _profile_struct(
    f: T.StructField, column_id: int, m: dict[str, Column], first: Column, options: ProfileOptions
) -> Column:
    def metric(name: str, dtype: str) -> Column:
        return (m[name] if name in m else F.lit(None)).cast(dtype)

    percentiles = {
        name: (F.try_element_at(m["percentiles"], F.lit(i + 1)) if "percentiles" in m else F.lit(None))
        for i, name in enumerate(PERCENTILES)
    }
    fields = {
        "column_id": F.lit(column_id),
        "column_name": F.lit(f.name),
        "data_type": F.lit(type_label(f.dataType)),
        "inferred_data_type": F.lit(type_label(f.dataType)),
        "kind": F.lit("numeric" if _is_numeric(f.dataType) else "text" if is_text(f.dataType) else "other"),
        "total_count": F.col("n"),
        "non_null_count": m["non_null"],
        "distinct_count": metric("distinct", "bigint"),
        "min_value": m["min"].cast("string"),
        "max_value": m["max"].cast("string"),
        "std_dev": metric("stddev", "double"),
        **{name: value.cast("double") for name, value in percentiles.items()},
        "zero_count": F.coalesce(metric("zero", "bigint"), F.lit(0)),
        "avg_length": metric("avg_length", "double"),
        "invalid_date_count": F.coalesce(metric("invalid_dates", "bigint"), F.lit(0)),
        "first_few_rows": first,
    }
    if options.extended:
        width = TYPE_BYTES.get(type(f.dataType), 8)
        fields |= {
            "mean_value": metric("mean", "double"),
            "sum_value": metric("sum", "double"),
            "negative_count": F.coalesce(metric("negative", "bigint"), F.lit(0)),
            "kurtosis_value": metric("kurtosis", "double"),
            "skewness_value": metric("skewness", "double"),
            "min_length": metric("min_length", "bigint"),
            "max_length": metric("max_length", "bigint"),
            "median_length": metric("median_length", "double"),
            "memory_size_bytes": (
                F.floor(F.coalesce(m["avg_length"], F.lit(0.0)) * m["non_null"])
                if "avg_length" in m else m["non_null"] * width
            ).cast("bigint"),
        }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def column_alerts() -> Column:
    """Alert texts of a profile row, ``OK`` when there is none."""
    total, non_null, distinct = F.col("total_count"), F.col("non_null_count"), F.col("distinct_count")
    text, numeric = F.col("kind") == "text", F.col("kind") == "numeric"
    found = F.concat_ws(
        ", ",
        F.when(non_null == 0, "All Missing").when(F.col("missing_percentage") > 80, "High Nulls"),
        F.when((distinct == 1) & (non_null > 0), "Constant"),
        F.when((F.col("distinct_percentage") >= 99.5) & (non_null > 1), "Unique Key"),
        F.when(text & (F.col("distinct_percentage") > 50) & (distinct > 10), "High Cardinality"),
        F.when(numeric & (total > 0) & (_percent(F.col("zero_count"), total) > 50), "Zeros"),
    )
    return F.when(found == "", "OK").otherwise(found)


def value_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``(column_name, value, n)`` over the non-null values of all given columns.

    Counted per task before the one shuffle, so frequent values cost nothing.
    """
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).cast("string").alias("value"))
        for c in columns
    ])
    return (
        df.select(F.inline(entries)).where(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def column_values(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``(column_name, value, n)``: the non-null values as they stand, each once per row.

    For statistics of what is inside the values: nothing is shuffled to find equal ones.
    """
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).cast("string").alias("value"), F.lit(1).cast("bigint").alias("n"))
        for c in columns
    ])
    return df.select(F.inline(entries)).where(F.col("value").isNotNull())


def key_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``(column_name, is_long, key, head, length, n)`` over the non-null values of all given columns.

    A value of up to ``KEY_LENGTH`` characters is its own key; a longer one has a
    128-bit digest instead, so that no long text crosses a shuffle.  ``head`` is
    its beginning.
    """
    value = F.col("value")
    is_long = F.length(value) > KEY_LENGTH
    rows = column_values(df, columns).select(
        "column_name", is_long.alias("is_long"), F.when(is_long, F.md5(value.cast("binary"))).otherwise(value).alias("key"),
        F.substring(value, 1, KEY_LENGTH).alias("head"), F.length(value).alias("length"),
    )
    return rows.groupBy("column_name", "is_long", "key", "head", "length").agg(F.count(F.lit(1)).alias("n"))


def _order_of_values() -> list[Column]:
    return [F.desc("n"), F.asc("head"), F.asc("length"), F.asc("key")]


def top_keys(df: DataFrame, counts: DataFrame, limit: int | None) -> DataFrame:
    """``(column_name, value, n, rank)``: the most frequent values per column, whole texts again.

    Ties go by the beginning of the value, then by its length.
    """
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(*_order_of_values()))
    if limit is not None:
        # A column may have any number of values: parts of it are cut to the best first.
        salted = counts.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(64)))
        part = F.row_number().over(Window.partitionBy("column_name", "_salt").orderBy(*_order_of_values()))
        counts = salted.withColumn("_place", part).where(F.col("_place") <= limit).drop("_salt", "_place")
    ranked = counts.withColumn("rank", place)
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    short = ranked.where(~F.col("is_long")).select("column_name", F.col("key").alias("value"), "n", "rank")
    names = df.columns
    texts = column_values(df, [f.name for f in df.schema.fields if is_text(f.dataType)] or names[:1])
    long = ranked.where("is_long").select("column_name", "key", "n", "rank")
    found = texts.where(F.length("value") > KEY_LENGTH).withColumn("key", F.md5(F.col("value").cast("binary"))).select("column_name", "key", "value")
    # With a limit, so many rows per column.
    whole = found.join(long if limit is None else F.broadcast(long), ["column_name", "key"]).groupBy("column_name", "rank").agg(
        F.min("value").alias("value"), F.min("n").alias("n")
    )
    return short.unionByName(whole.select(*short.columns))


def top_values(counts: DataFrame, limit: int | None = 50) -> DataFrame:
    """The ``limit`` most frequent values per column, or all, ties broken by value."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def _with_value_statistics(profile: DataFrame, df: DataFrame, counts: DataFrame, options: ProfileOptions) -> DataFrame:
    stats = counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_exact"),
        F.count_if(F.col("n") == 1).alias("unique_count"),
    )
    if options.extended:
        top = top_keys(df, counts, options.value_limit).groupBy("column_name").agg(
            F.to_json(F.map_from_entries(F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                lambda e: F.struct(e["value"], e["n"]),
            ))).alias("value_counts")
        )
        lengths = counts.groupBy("column_name", "length").agg(F.sum("n").alias("n"))
        if options.length_limit is not None:
            order = Window.partitionBy("column_name").orderBy("length")
            lengths = lengths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.length_limit)
        # At most one entry per length that occurs.
        length_map = (
            lengths.groupBy("column_name").agg(
                F.to_json(F.map_from_entries(F.transform(
                    F.array_sort(F.collect_list(F.struct("length", "n"))),
                    lambda e: F.struct(e["length"].cast("string"), e["n"]),
                ))).alias("length_distribution")
            )
        )
        stats = stats.join(top, "column_name", "left").join(length_map, "column_name", "left")
    joined = profile.join(F.broadcast(stats), "column_name", "left")
    distinct = F.coalesce("distinct_exact", F.lit(0)) if options.exact else F.col("distinct_count")
    extra = {"distinct_count": distinct}
    if options.extended:
        extra["unique_count"] = F.coalesce("unique_count", F.lit(0))
        extra["length_distribution"] = F.when(F.col("kind") == "text", F.col("length_distribution"))
    joined = joined.withColumns(extra).drop("distinct_exact")
    if not options.extended:
        joined = joined.drop("unique_count")
    return joined.select(*profile.columns, *[c for c in joined.columns if c not in profile.columns])


def _with_exact_percentiles(
    profile: DataFrame, df: DataFrame, fields: Sequence[T.StructField]
) -> DataFrame:
    """Exact percentiles of all numeric columns, found together."""
    numbers = {f.name: F.col(quoted(f.name)) for f in fields if _is_numeric(f.dataType)}
    if not numbers:
        return profile
    wide = column_percentiles(df, numbers, list(PERCENTILES.values())).groupBy("column_name").agg(*[
        F.max(F.when(F.col("probability") == p, F.col("value"))).alias(f"_{name}")
        for name, p in PERCENTILES.items()
    ])
    return (
        profile.join(F.broadcast(wide), "column_name", "left")
        .withColumns({name: F.col(f"_{name}") for name in PERCENTILES})
        .select(*profile.columns)
    )


def _with_extended_ratios(profile: DataFrame) -> DataFrame:
    total, non_null = F.col("total_count"), F.col("non_null_count")
    return profile.withColumns({
        "unique_percent": _percent(F.col("unique_count"), total),
        "is_unique": (F.col("unique_count") == non_null) & (non_null > 0),
        "zero_percentage": _percent(F.col("zero_count"), total),
        "negative_percentage": _percent(F.col("negative_count"), total),
        "invalid_dates_percentage": _percent(F.col("invalid_date_count"), non_null),
    })


def dataset_summary(
    df: DataFrame, *, exact: bool = False, run_id: int = 0, dataset_id: int = 0,
    dataset_name: str = "",
) -> DataFrame:
    """One row: size, missing cells, distinct values over all columns, duplicate rows."""
    fields = [f for f in df.schema.fields if _profiled(f.dataType)]
    columns = [F.col(quoted(f.name)) for f in fields]
    missing = reduce(
        lambda a, b: a + b, [F.count_if(F.col(quoted(f.name)).isNull()) for f in df.schema.fields]
    )
    base = [F.count(F.lit(1)).alias("total_rows"), missing.alias("missing_values_count")]
    if exact:
        distinct_sum = key_counts(df, [f.name for f in fields]).agg(F.count(F.lit(1))).scalar()
        distinct_rows = df.select(*columns).distinct().agg(F.count(F.lit(1))).scalar()
        wide = df.agg(*base).withColumns(
            {"unique_values_count": distinct_sum, "distinct_rows": distinct_rows}
        )
    else:
        approx = reduce(lambda a, b: a + b, [F.approx_count_distinct(c) for c in columns])
        wide = df.agg(
            *base, approx.alias("unique_values_count"),
            F.approx_count_distinct(F.xxhash64(*columns)).alias("distinct_rows"),
        )
    cells = F.col("total_rows") * len(df.columns)
    return wide.select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        F.lit(dataset_name).alias("dataset_name"),
        "total_rows",
        F.lit(len(df.columns)).alias("total_columns"),
        "missing_values_count",
        F.col("missing_values_count").alias("null_count"),
        _percent(F.col("missing_values_count"), cells).alias("null_percent"),
        "unique_values_count",
        (F.col("total_rows") - F.col("distinct_rows")).alias("duplicate_count"),
        F.lit(round(estimated_bytes(df) / 2**30, 4)).alias("table_size_gb"),
    )


def first_few_rows(df: DataFrame, order_by: Sequence[str] = (), limit: int = 5) -> DataFrame:
    """Per column, the non-null values of a few rows as a JSON array of strings."""
    fields = [f for f in df.schema.fields if _profiled(f.dataType)]
    options = ProfileOptions(first_rows=limit, order_by=tuple(order_by))
    firsts = _first_rows(df, fields, options)
    one = df.sparkSession.range(1).select(firsts.alias("f"))
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col("f")[f"c{i}"].alias("first_few_rows"))
        for i, f in enumerate(fields)
    ])))


class EmptyDatasetError(ValueError):
    """A report profile of a dataset without rows."""


def report_profile(df: DataFrame, *, translate_numerals: bool = False) -> DataFrame:
    """Exact column report: distinct, unique, missing, zeros, mean, spread, sum, size."""
    if df.isEmpty():
        raise EmptyDatasetError("Dataset is empty. Cannot profile.")
    if translate_numerals:
        df = translate_numeral_columns(df)
    profile = profile_columns(df, ProfileOptions(exact=True, extended=True))
    count = F.col("non_null_count")
    return profile.select(
        "column_id", "column_name", _report_type().alias("data_type"),
        "distinct_count",
        F.try_divide(F.col("distinct_count").cast("double"), count).alias("distinct_share"),
        "unique_count",
        F.try_divide(F.col("unique_count").cast("double"), count).alias("unique_share"),
        "missing_count",
        F.try_divide(F.col("missing_count").cast("double"), F.col("total_count")).alias("missing_share"),
        "zero_count",
        F.try_divide(F.col("zero_count").cast("double"), F.col("total_count")).alias("zero_share"),
        "mean_value", "std_dev", "min_value", "max_value", "sum_value", "memory_size_bytes",
        F.when(F.col("alert") != "OK", F.col("alert")).alias("column_alert"),
    )


def _report_type() -> Column:
    label = F.col("data_type")
    return (
        F.when(F.col("kind") == "numeric", "Numeric")
        .when(label == "BOOLEAN", "Boolean")
        .when(label.startswith("TIMESTAMP") | (label == "DATE"), "DateTime")
        .when((F.col("kind") == "text") & (F.col("distinct_count") <= 50), "Categorical")
        .when(F.col("kind") == "text", "Text")
        .otherwise("Unsupported")
    )


def localised_summary(df: DataFrame, *, exact: bool = True) -> DataFrame:
    """Dataset summary with a numeral rendering of its figures."""
    return localise_stats(
        dataset_summary(df, exact=exact),
        ["total_rows", "total_columns", "missing_values_count", "null_count",
         "duplicate_count", "null_percent"],
    )


def numeral_columns(df: DataFrame) -> DataFrame:
    """Per text column: are all its non-null values written in numeral characters?"""
    names = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not names:
        return local_frame(df.sparkSession, [], "column_name string, non_null_count bigint, is_numeral boolean")
    aggregates = [
        a for i, c in enumerate(names) for a in (
            F.count(F.col(quoted(c))).alias(f"n{i}"),
            F.count_if(~F.col(quoted(c)).rlike(NUMERAL_COLUMN_PATTERN)).alias(f"bad{i}"),
        )
    ]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"n{i}").alias("non_null_count"),
            ((F.col(f"n{i}") > 0) & (F.col(f"bad{i}") == 0)).alias("is_numeral"),
        )
        for i, c in enumerate(names)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def translate_numeral_columns(df: DataFrame) -> DataFrame:
    """Convert the text columns that hold nothing but numerals; one row per column is read."""
    names = [r["column_name"] for r in numeral_columns(df).where("is_numeral").collect()]
    return normalise_numeric(df, names).drop("unparsed_columns") if names else df


def as_profile_json(profile: DataFrame) -> DataFrame:
    """Profile rows as JSON documents, for stores with one document column."""
    return profile.select("column_name", F.to_json(F.struct("*")).alias("profile"))


def type_counts(df: DataFrame) -> str:
    """How many columns of each report type the schema has, as JSON."""
    kinds: dict[str, int] = {}
    for f in df.schema.fields:
        kind = ("Numeric" if _is_numeric(f.dataType) else "Boolean" if isinstance(f.dataType, T.BooleanType)
                else "DateTime" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
                else "Text" if is_text(f.dataType) else "Unsupported")
        kinds[kind] = kinds.get(kind, 0) + 1
    return json.dumps(dict(sorted(kinds.items())))
