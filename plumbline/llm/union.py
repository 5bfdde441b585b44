"""Connected components: of the pairs in one task, and of edges over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.durable import stored


#: Edges of a task, about, where there are fewer than the partitions would hold.
TASK_EDGES = 1 << 16


class Forest:
    """Union of array positions; pairs inside one set are dropped by vector operations."""

    def __init__(self, size: int):
        self.root = np.arange(size, dtype=np.int64)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = self.root[left], self.root[right]
        open_ = a != b
        if not open_.any():
            return
        pairs = np.unique(np.stack([np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])], axis=1), axis=0)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        moved = np.arange(len(self.root), dtype=np.int64)
        for x in up:
            moved[x] = top(x)
        self.root = moved[self.root]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` ``(a, b)``: the smallest node reachable.

    Large and small stars alternate until nothing changes; each round is stored,
    so that the plan stays short and a lost executor costs one round only.  Few
    edges stay in few tasks, whose shuffles leave few files.
    Nodes are of one orderable type and not null.
    """
    flat = (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b")).distinct()
    )
    current = stored(flat)
    mark = _mark(current)
    tasks = 1 + mark[0] // TASK_EDGES  # the rounds make no more edges than there are
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        current = current.coalesce(tasks)
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b")).coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").where(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        current = stored(small.union(least.select("a", F.col("_m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks))
        last, mark = mark, _mark(current)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select("b", "b").distinct()
    )


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]
