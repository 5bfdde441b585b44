"""Categorical relationships: low-cardinality columns, Cramér's V, if-then rules."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.local import local_frame
from plumbline.model import quoted
from plumbline.operators.profile import value_counts


# Up to here counting whole combinations first fits each task's hash table.
FEW_COMBINATIONS = 100_000
RULES = (
    "dataset_name string, if_col string, if_val string, then_col string, then_val string, "
    "confidence double, score double, columns array<string>"
)


def low_cardinality_columns(
    df: DataFrame, columns: Sequence[str] | None = None, max_distinct: int = 100
) -> DataFrame:
    """``(column_name, distinct_count)`` of columns with few distinct non-null values.

    A sketch drops the columns that are clearly too wide in one scan, so the
    exact count never shuffles a key-like column.
    """
    names = [c for c in (columns or df.columns) if c in df.columns]
    sketch = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    # One row, one figure per column.
    row = sketch.first()
    near = [c for i, c in enumerate(names) if row[i] <= 2 * max_distinct]
    empty = [c for i, c in enumerate(names) if row[i] == 0]
    spark = df.sparkSession
    if not near:
        return local_frame(spark, [], "column_name string, distinct_count bigint")
    exact = value_counts(df, near).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    exact = exact.where(F.col("distinct_count") <= max_distinct)
    if empty:
        none = local_frame(spark, [(c, 0) for c in empty], "column_name string, distinct_count bigint")
        exact = exact.unionByName(none)
    return exact


def contingency(df: DataFrame, columns: Sequence[str], *, joint: bool = False) -> DataFrame:
    """``(col1, col2, a, b, n)`` for every pair of columns, rows with NULL left out.

    Each row contributes one entry per column pair, summed per task before the
    shuffle; with few distinct values per column only small tables move.  With
    ``joint`` rows are first counted by all columns together, which pays when
    their combinations are known to be few.
    """
    texts = df.select(*[F.col(quoted(c)).cast("string").alias(f"t{i}") for i, c in enumerate(columns)],
                      F.lit(1).cast("bigint").alias("n"))
    if joint:
        texts = (
            df.groupBy(*[F.col(quoted(c)).alias(f"t{i}") for i, c in enumerate(columns)])
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*[F.col(f"t{i}").cast("string").alias(f"t{i}") for i in range(len(columns))], "n")
        )
    pairs = F.array(*[
        F.struct(
            F.lit(columns[i]).alias("col1"), F.lit(columns[j]).alias("col2"),
            F.col(f"t{i}").alias("a"), F.col(f"t{j}").alias("b"),
        )
        for i, j in combinations(range(len(columns)), 2)
    ])
    return (
        texts.select("n", F.inline(pairs)).where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("col1", "col2", "a", "b").agg(F.sum("n").alias("n"))
    )


def cramers_v(table: DataFrame) -> DataFrame:
    """``(col1, col2, cramers_v)``, with the continuity correction for 2x2 tables.

    chi2 is ``n * (sum o^2 / (r c) - 1)``, so empty cells need no rows.
    """
    pair = ["col1", "col2"]
    whole, by_a, by_b = (Window.partitionBy(*pair, *more) for more in ([], ["a"], ["b"]))
    one, n = F.lit(1), F.col("n")
    # One shuffle by pair serves all windows; a pair has few cells.
    cells = table.select(
        *pair, n.cast("double").alias("o"),
        F.sum(n).over(by_a).cast("double").alias("row_n"), F.count(one).over(by_a).alias("row_cells"),
        F.sum(n).over(by_b).cast("double").alias("col_n"), F.count(one).over(by_b).alias("col_cells"),
        F.sum(n).over(whole).cast("double").alias("total"),
    )
    o, ri, cj = F.col("o"), F.col("row_n"), F.col("col_n")
    row_share, col_share = 1 / F.col("row_cells").cast("double"), 1 / F.col("col_cells").cast("double")
    joined = cells.groupBy(*pair).agg(
        F.max("total").alias("total"),
        F.round(F.sum(row_share)).alias("r"), F.round(F.sum(col_share)).alias("k"),
        F.sum(row_share / ri).alias("row_inverse"), F.sum(col_share / cj).alias("col_inverse"),
        F.sum(o * o / (ri * cj)).alias("ratio"),
        # In a 2x2 table every cell is equally far from its expectation.
        F.max(F.abs(o - ri * cj / F.col("total"))).alias("gap"),
    )
    total = F.col("total")
    plain = total * (F.col("ratio") - 1)
    corrected = (
        F.pow(F.greatest(F.col("gap") - 0.5, F.lit(0.0)), 2)
        * total * F.col("row_inverse") * F.col("col_inverse")
    )
    is_2x2 = (F.col("r") == 2) & (F.col("k") == 2)
    chi2 = F.greatest(F.when(is_2x2, corrected).otherwise(plain), F.lit(0.0))
    smaller = F.least("r", "k") - 1
    v = F.sqrt(F.try_divide(chi2, total * smaller))
    return joined.select(*pair, F.coalesce(v, F.lit(0.0)).alias("cramers_v"))


def strong_pairs(v: DataFrame, threshold: float = 0.5) -> DataFrame:
    return v.where(F.col("cramers_v") >= threshold)


def if_then_rules(
    table: DataFrame, pairs: DataFrame, dataset_name: str, min_confidence: float = 0.7
) -> DataFrame:
    """For each value of the first column, its most frequent partner, if frequent enough."""
    by_value = Window.partitionBy("col1", "col2", "a")
    ranked = (
        table.join(F.broadcast(pairs), ["col1", "col2"])
        .withColumn("share", F.col("n") / F.sum("n").over(by_value))
        .withColumn("rank", F.row_number().over(by_value.orderBy(F.desc("n"), "b")))
    )
    return ranked.where((F.col("rank") == 1) & (F.col("share") >= min_confidence)).select(
        F.lit(dataset_name).alias("dataset_name"),
        F.col("col1").alias("if_col"), F.col("a").alias("if_val"),
        F.col("col2").alias("then_col"), F.col("b").alias("then_val"),
        F.round("share", 3).alias("confidence"),
        F.round("cramers_v", 2).alias("score"),
        F.array("col1", "col2").alias("columns"),
    )


def mine_categorical_rules(
    df: DataFrame, dataset_name: str, columns: Sequence[str] | None = None,
    *, max_distinct: int = 100, min_strength: float = 0.5, min_confidence: float = 0.7,
) -> DataFrame:
    """The whole path from columns to rules; only column names reach the driver."""
    order = [c for c in (columns or df.columns) if c in df.columns]
    few = {
        r["column_name"]: r["distinct_count"]
        for r in low_cardinality_columns(df, order, max_distinct).collect()
    }
    names = [c for c in order if c in few]
    if len(names) < 2:
        return local_frame(df.sparkSession, [], RULES)
    combined = math.prod(few[c] + 1 for c in names)
    table = contingency(df, names, joint=combined <= FEW_COMBINATIONS)
    pairs = strong_pairs(cramers_v(table), min_strength)
    return if_then_rules(table, pairs, dataset_name, min_confidence)
