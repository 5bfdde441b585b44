"""Datasets from tables, files and queries, and their column metadata."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T

from plumbline.functions.local import local_frame
from plumbline.model import Dataset


def table_dataset(spark: SparkSession, name: str, source: str, **metadata: Any) -> Dataset:
    """Dataset over a catalog table, or over Parquet files when given a path."""
    is_path = "/" in source or source.endswith(".parquet")
    frame = spark.read.parquet(source) if is_path else spark.table(source)
    return Dataset(name=name, frame=frame, **metadata)


def query_dataset(
    spark: SparkSession,
    name: str,
    sql: str,
    tables: Mapping[str, DataFrame] | None = None,
    **metadata: Any,
) -> Dataset:
    """Dataset over a query; ``tables`` are made visible to it as temporary views."""
    for view, frame in (tables or {}).items():
        frame.createOrReplaceTempView(view)
    return Dataset(name=name, frame=spark.sql(sql), **metadata)


def type_label(dtype: T.DataType) -> str:
    """Type as a short label such as NUMBER(38,0), TEXT or TIMESTAMP_NTZ(6)."""
    if isinstance(dtype, T.DecimalType):
        return f"NUMBER({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.ByteType):
        return "NUMBER(3,0)"
    if isinstance(dtype, T.ShortType):
        return "NUMBER(5,0)"
    if isinstance(dtype, T.IntegerType):
        return "NUMBER(10,0)"
    if isinstance(dtype, T.LongType):
        return "NUMBER(19,0)"
    if isinstance(dtype, T.FractionalType):
        return "FLOAT"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "TEXT"
    if isinstance(dtype, T.TimestampNTZType):
        return "TIMESTAMP_NTZ(6)"
    if isinstance(dtype, T.TimestampType):
        return "TIMESTAMP_LTZ(6)"
    if isinstance(dtype, T.DateType):
        return "DATE"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, T.BinaryType):
        return "BINARY"
    if isinstance(dtype, T.ArrayType):
        return "ARRAY"
    if isinstance(dtype, (T.MapType, T.StructType)):
        return "OBJECT"
    return dtype.simpleString().upper()


def numeric_shape(dtype: T.DataType) -> tuple[int | None, int | None]:
    """Precision and scale of an exact numeric type."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision, dtype.scale
    for kind, digits in ((T.ByteType, 3), (T.ShortType, 5), (T.IntegerType, 10), (T.LongType, 19)):
        if isinstance(dtype, kind):
            return digits, 0
    return None, None


def column_metadata(df: DataFrame) -> DataFrame:
    """One row per column, read from the schema alone; no job runs."""
    rows = [
        (i, f.name, type_label(f.dataType), *numeric_shape(f.dataType), f.nullable)
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return local_frame(
        df.sparkSession, rows,
        "ordinal int, column_name string, data_type string, "
        "numeric_precision int, numeric_scale int, is_nullable boolean",
    )


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for a frame: file sizes at the leaves, no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
