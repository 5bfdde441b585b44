"""Vectors of a table, and searches of query vectors against all rows in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows in a shard and queries in a block; one task holds one of each.
SHARD_ROWS = 1 << 15
BLOCK_QUERIES = 1 << 12

Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sound(vector: Column) -> Column:
    """Not null, not empty, every component finite."""
    return (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )


def clean(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(id, vec)`` of the rows that have an id and a sound vector, components in double precision."""
    return (
        rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull() & sound(F.col("vec")))
    )


def search_blocks(
    queries: DataFrame, rows: DataFrame, top: int, search: Search, score_type: str,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``(query_id, vec_id, score)``: what ``search`` finds for each block of queries in each shard of rows.

    Only the best ``top`` of a shard leave it, so no pair of a query and a row
    becomes a row of a frame.  Vectors meet vectors of their own dimension.
    """
    n_shards = max(1, math.ceil(rows.count() / shard_rows))
    n_blocks = max(1, math.ceil(queries.count() / block_queries))

    def dealt(frame: DataFrame, own: str, count: int, other: str, others: int, asks: bool) -> DataFrame:
        return frame.select(
            "id", "vec", F.size("vec").alias("dim"), F.lit(asks).alias("asks"),
            F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
        ).select("id", "vec", "dim", "asks", "shard", "block")

    both = dealt(rows, "shard", n_shards, "block", n_blocks, False).union(
        dealt(queries, "block", n_blocks, "shard", n_shards, True)
    )

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        ids = group.column("id").to_numpy()
        column = group.column("vec").combine_chunks()
        vectors = column.flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        sides = []
        for side in (asks, ~asks):
            own, matrix = ids[side], vectors[side]
            order = np.lexsort((*matrix.T[::-1], own)) if len(np.unique(own)) < len(own) else np.argsort(own)
            own, matrix = own[order], matrix[order]
            first = np.ones(len(own), dtype=bool)
            first[1:] = own[1:] != own[:-1]
            sides += [own[first], np.ascontiguousarray(matrix[first])]
        found = search(*sides, top)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    return both.groupBy("dim", "shard", "block").applyInArrow(run, f"query_id bigint, vec_id bigint, score {score_type}")


def ranked(found: DataFrame, top: int, nearest: bool) -> DataFrame:
    """The best of all shards, numbered from 1; ties go to the smaller vec_id."""
    score = F.col("score").asc() if nearest else F.col("score").desc()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(score, F.col("vec_id").asc()))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score"
    )
