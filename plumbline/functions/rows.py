"""Row numbering and replication without a single-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.durable import stored
from plumbline.model import quoted

#: Rows of so many copies are written out where they are; others in blocks, so many blocks to a task.
_FEW = 16
_BLOCK = 10_000
_TASK_BLOCKS = 100


def replicated(df: DataFrame, count: str, index: str) -> DataFrame:
    """Each row ``count`` times, numbered from 0 in ``index``.

    Counts beyond a few are cut into blocks and dealt over a given number of
    tasks.  The number is explicit: a row stands for a block, so Spark would see
    next to no bytes and put all blocks into one task.
    """
    n = F.col(count)
    few = df.where(n <= _FEW).withColumn(index, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    many = df.where(n > _FEW)
    blocks = df.select(n.alias("_n")).where(F.col("_n") > _FEW).agg(F.sum(F.ceil(F.col("_n") / _BLOCK))).first()[0] or 0
    dealt = many.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(_BLOCK).cast("bigint")))
    ).repartition(max(1, math.ceil(blocks / _TASK_BLOCKS)))
    large = dealt.withColumn(
        index,
        F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + (_BLOCK - 1), n - 1))),
    ).drop("_block")
    return few.unionByName(large)


def orderable(name: str, dtype: T.DataType) -> Column:
    """The column in a form that sorts and groups."""
    col = F.col(quoted(name))
    return F.to_json(col) if isinstance(dtype, (T.MapType, T.VariantType)) else col


def numbered(df: DataFrame, order_by: Sequence[str], index: str) -> DataFrame:
    """Rows numbered from 1 in the given order, remaining columns as tie-break.

    Identical rows are counted first and sorted once.  The sorted rows are
    stored, each with its place in its partition, and numbers follow from the
    partition totals; no window ever spans the table.
    """
    names = df.columns
    counted = df.groupBy(*[quoted(c) for c in names]).agg(F.count(F.lit(1)).alias("_n"))
    order = list(dict.fromkeys([*order_by, *names]))
    placed = stored(
        counted.sort(*[F.col(quoted(c)) for c in order])
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", 33))
    # One row per partition of the sorted frame.
    totals = placed.groupBy("_part").agg(F.sum("_n").alias("_total"))
    offsets = totals.select(
        "_part",
        F.coalesce(
            F.sum("_total").over(
                Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    before = F.coalesce(
        F.sum("_n").over(
            Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    start = placed.withColumn("_before", before).join(F.broadcast(offsets), "_part")
    copies = replicated(start, "_n", "_copy")
    return copies.select(
        (F.col("_offset") + F.col("_before") + F.col("_copy") + 1).alias(index),
        *[F.col(quoted(c)) for c in names],
    )
