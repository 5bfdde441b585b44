"""Approximate nearest neighbours: cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.vectors import clean, ranked, search_blocks

#: Hash tables, buckets probed over all tables as a share of all buckets, and candidates at least.
TABLES = 32
PROBES = 0.02
LEAST = 256


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(n, width // (2 * half), 2, half)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        half *= 2
    return rows / np.float32(np.sqrt(width))


def rotated(rows: np.ndarray, table: int, seed: int = 17) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform: nearly a random rotation."""
    draw = np.random.default_rng([seed, table])
    for _ in range(3):
        rows = hadamard(rows * draw.choice(np.array([-1, 1], np.float32), rows.shape[1]))
    return rows


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Directions in single precision, padded to a power of two."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    scaled /= np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    return np.pad(scaled, ((0, 0), (0, width - vectors.shape[1]))).astype(np.float32)


class Index:
    """For each table, the rows in the bucket of each signed axis."""

    def __init__(self, vectors: np.ndarray, tables: int):
        units = unit_rows(vectors)
        self.tables, self.buckets = tables, 2 * units.shape[1]
        self.order = np.empty((tables, len(vectors)), dtype=np.int32)
        self.start = np.empty((tables, self.buckets + 1), dtype=np.int64)
        for t in range(tables):
            turned = rotated(units, t)
            axis = np.abs(turned).argmax(axis=1)
            code = 2 * axis + (turned[np.arange(len(turned)), axis] < 0)
            self.order[t] = np.argsort(code, kind="stable")
            self.start[t] = np.searchsorted(code[self.order[t]], np.arange(self.buckets + 1))

    def probes(self, queries: np.ndarray) -> np.ndarray:
        """Per query all buckets, table after table, the most promising first."""
        units = unit_rows(queries)
        cost = np.empty((len(queries), self.tables, self.buckets), dtype=np.float32)
        for t in range(self.tables):
            turned = rotated(units, t)
            best = np.abs(turned).max(axis=1, keepdims=True)
            cost[:, t, 0::2], cost[:, t, 1::2] = (best - turned) ** 2, (best + turned) ** 2
        return np.argsort(cost.reshape(len(queries), -1), axis=1, kind="stable")

    def candidates(self, probes: np.ndarray, share: float, least: int) -> np.ndarray:
        """Rows in the first ``share`` of the buckets, and in further ones up to ``least`` rows."""
        table, bucket = np.divmod(probes, self.buckets)
        begin, end = self.start[table, bucket], self.start[table, bucket + 1]
        reach = max(1, round(share * len(probes)))
        while True:
            own = [self.order[t, a:b] for t, a, b in zip(table[:reach].tolist(), begin[:reach].tolist(), end[:reach].tolist()) if b > a]
            rows = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int32)
            if len(rows) >= min(least, self.order.shape[1]) or reach >= len(probes):
                return rows
            reach *= 2


def nearest(query_ids, queries, ids, vectors, top: int, tables: int = TABLES, share: float = PROBES, least: int = LEAST):
    """Up to ``top`` candidates per query by exact Euclidean distance, ties to the smaller id."""
    out: tuple[list, list, list] = ([], [], [])
    if len(ids):
        index = Index(vectors, tables)
        for k in range(0, len(queries), 256):
            for asked, query, probes in zip(query_ids[k : k + 256], queries[k : k + 256], index.probes(queries[k : k + 256])):
                rows = index.candidates(probes, share, least)
                rows = rows[ids[rows] != asked]
                gap = vectors[rows] - query
                scale = np.abs(gap).max() if len(rows) else 0.0
                # Components whose squares would overflow are scaled first.
                far = np.sqrt((gap * gap).sum(axis=1)) if scale < 1e150 else scale * np.sqrt(((gap / scale) ** 2).sum(axis=1))
                best = np.lexsort((ids[rows], far))[:top]
                out[0].append(np.full(len(best), asked)), out[1].append(ids[rows[best]]), out[2].append(far[best])
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(o) if o else e for o, e in zip(out, empty))


def nearest_neighbours(
    queries: DataFrame, rows: DataFrame, top: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
    tables: int = TABLES, share: float = PROBES, least: int = LEAST,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``top`` nearest rows found, by Euclidean distance.

    Every row is indexed in its shard, in ``tables`` tables of one bucket per
    signed axis.  A query probes the ``share`` of all buckets nearest to its
    rotations, and more until it has ``least`` candidates, then ranks these
    exactly.  Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do rows without id.  A repeated vec_id counts
    once, with its smallest vector, and is no candidate of itself.  An empty
    table gives no rows.  Other columns play no part.
    """
    moves = F.exists("vec", lambda x: x != 0)

    def search(query_ids, asked, ids, vectors, k):
        return nearest(query_ids, asked, ids, vectors, k, tables, share, least)

    found = search_blocks(
        clean(queries, vec_id, embedding).where(moves), clean(rows, vec_id, embedding).where(moves), top, search, "double"
    )
    return ranked(found, top, nearest=True)


def op5(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100."""
    return nearest_neighbours(embeddings.where(F.col("vec_id") % 100 == 0), embeddings)
