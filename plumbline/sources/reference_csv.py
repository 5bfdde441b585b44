"""Reference tables as compressed CSV: export, strict or tolerant load, bad rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Texts that stand for NULL in an exported file.
NULL_MARKERS = ("NULL", "nan", "\\N")
_QUOTED_EMPTY = "\x01empty\x01"


def export_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Write gzip CSV with a header, replacing what is there.

    Every task writes a file of its own.  ``single_file`` suits small reference
    tables and downloads: one task then writes everything.
    """
    out = df.coalesce(1) if single_file else df
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "NULL")
        # The writer trims text unless told otherwise.
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("compression", "gzip")
        .csv(path)
    )


def _parsed(raw: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return raw
    return raw.try_cast(dtype)


def read_reference_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    on_error: str = "abort",
) -> DataFrame:
    """Load a reference table, every column read as text and then converted.

    ``abort`` fails the read at the first malformed row; ``continue`` leaves such
    rows out, and ``rejected_rows`` returns exactly those.
    """
    if on_error not in ("abort", "continue"):
        raise ValueError(f"on_error must be 'abort' or 'continue', not {on_error!r}")
    rows = _checked_rows(spark, path, schema)
    if on_error == "abort":
        problem = F.when(
            F.col("problem").isNotNull(),
            F.raise_error(F.concat(F.lit("malformed reference row: "), F.col("problem"))),
        ).otherwise(F.lit(True))
        rows = rows.where(problem.cast("boolean"))
    else:
        rows = rows.where(F.col("problem").isNull())
    return rows.select("parsed.*")


def rejected_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows a tolerant load leaves out, with the reason."""
    return (
        _checked_rows(spark, path, schema)
        .where(F.col("problem").isNotNull())
        .select("problem", "raw.*")
    )


def _checked_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    corrupt = "_malformed"
    text_schema = T.StructType(
        [T.StructField(f.name, T.StringType()) for f in schema.fields]
        + [T.StructField(corrupt, T.StringType())]
    )
    raw = (
        spark.read.schema(text_schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        # Quoted line breaks belong to the text.  Gzip files are read by one task each anyway.
        .option("multiLine", True)
        .option("lineSep", "\n")
        .option("mode", "PERMISSIVE")
        # An empty field is NULL, an empty text in quotes is not.
        .option("emptyValue", _QUOTED_EMPTY)
        .option("columnNameOfCorruptRecord", corrupt)
        .csv(path)
    )

    def text(name: str) -> Column:
        col = F.col(f"`{name}`")
        return F.when(col == _QUOTED_EMPTY, "").when(~col.isin(*NULL_MARKERS), col)

    parsed, problems = [], [F.when(F.col(corrupt).isNotNull(), F.lit("wrong number of fields"))]
    for f in schema.fields:
        raw_value = text(f.name)
        value = _parsed(raw_value, f.dataType)
        parsed.append(value.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            problems.append(
                F.when(
                    raw_value.isNotNull() & (F.trim(raw_value) != "") & value.isNull(),
                    F.lit(f"{f.name} is not {f.dataType.simpleString()}"),
                )
            )
    return raw.select(
        F.struct(*parsed).alias("parsed"),
        F.coalesce(*problems).alias("problem"),
        F.struct(*[
            F.when(F.col(f"`{f.name}`") == _QUOTED_EMPTY, "").otherwise(F.col(f"`{f.name}`")).alias(f.name)
            for f in schema.fields
        ]).alias("raw"),
    )
