"""Near-duplicates among embeddings: collisions in sorted one-dimensional projections, counted per pair."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.durable import stored
from plumbline.llm.tables import written
from plumbline.llm.union import Forest, components

#: One-dimensional projections in which collisions are counted, and how often a pair at the threshold collides in one.
PROJECTIONS = 32
COLLIDES = 0.9
#: Chance that a pair at the threshold passes the count, and that it meets in a cell.
RECALL = 0.9999
#: Distinct vectors of a label that one cell should hold, and of one side of a tile.
CELL = 1 << 13
BLOCK = 1 << 12
_ROWS = 256
_PAIRS = 1 << 16


def calibrated(projections: int, similarity: float, collides: float = COLLIDES, recall: float = RECALL) -> tuple[float, int]:
    """Half width of a window and the collisions a pair must reach.

    Along a normally drawn direction, unit vectors at distance ``d`` differ by a
    normal variable of deviation ``d``, whatever the data.  The window is as
    wide as makes a pair of the least similarity collide with the chance
    ``collides``; the count is the highest that it reaches with the chance
    ``recall`` over independent projections.  More similar pairs collide oftener.
    """
    distance = math.sqrt(max(0.0, 2 - 2 * similarity))
    half = NormalDist().inv_cdf((1 + collides) / 2) * distance + 1e-9
    reached, least = 0.0, projections + 1
    while reached < recall:
        least -= 1
        reached += math.comb(projections, least) * collides**least * (1 - collides) ** (projections - least)
    return half, least


def tables_for(depth: int, similarity: float, recall: float = RECALL) -> int:
    """Tables of ``depth`` signs that a pair needs to share a cell in one of them with the chance ``recall``."""
    if depth == 0:
        return 1
    together = (1 - math.acos(similarity) / math.pi) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-together))) if together < 1 else 1


def directions(seed: int, count: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def similar_pairs(left: np.ndarray, right: np.ndarray, own: bool, similarity: float, projections: int = PROJECTIONS, apart=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of unit vectors that are counted as candidates and reach the similarity, in blocks.

    Each projection sorts the right side; the window round a left vector's
    value is a run of ranks there, and a rank inside is a collision.  With
    ``own`` both sides are the same vectors and each pair comes once.
    ``apart(i, j)`` may strike pairs off before they are verified.
    """
    half, least = calibrated(projections, similarity)
    axes = directions(17, projections, left.shape[1])
    asked, held = left @ axes, right @ axes
    kind = np.uint16 if len(right) < 1 << 16 else np.uint32
    ranks, lows, widths = [], [], []
    for k in range(projections):
        order = np.argsort(held[:, k], kind="stable")
        rank = np.empty(len(right), dtype=kind)
        rank[order] = np.arange(len(right))
        line = held[order, k]
        low = np.searchsorted(line, asked[:, k] - half, side="left")
        ranks.append(rank), lows.append(low.astype(kind))
        widths.append((np.searchsorted(line, asked[:, k] + half, side="right") - low).astype(kind))
    for s in range(0, len(left), _ROWS):
        e, skip = min(s + _ROWS, len(left)), s if own else 0
        counts = np.zeros((e - s, len(right) - skip), dtype=np.uint8)
        for rank, low, width in zip(ranks, lows, widths):
            # Ranks below the window wrap round to large numbers.
            counts += (rank[None, skip:] - low[s:e, None]) < width[s:e, None]
        i, j = np.nonzero(counts >= least)
        i, j = i + s, j + skip
        if own:
            i, j = i[i < j], j[i < j]
        if apart is not None:
            fresh = apart(i, j)
            i, j = i[fresh], j[fresh]
        for k in range(0, len(i), _PAIRS):
            a, b = i[k : k + _PAIRS], j[k : k + _PAIRS]
            near = np.einsum("ij,ij->i", left[a], right[b]) >= similarity
            yield a[near], b[near]


def _tagged(rows: DataFrame) -> DataFrame:
    """``(id, label, d1, d2, vec)``: rows with a 128-bit key of the vector, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, keys = batch.column("vec"), [(None, None)] * batch.num_rows
            offsets = vec.offsets.to_numpy()
            values = vec.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero
            valid = vec.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(valid).tolist():
                own = values[offsets[k] : offsets[k + 1]]
                if len(own) and np.isfinite(own).all() and own.any():
                    key = xxhash.xxh3_128_digest(own.tobytes())
                    keys[k] = (int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True))
            d1, d2 = zip(*keys) if keys else ((), ())
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), vec], names=["id", "label", "d1", "d2", "vec"])

    return rows.mapInArrow(run, "id bigint, label string, d1 bigint, d2 bigint, vec array<double>")


def _placed(nodes: DataFrame, depth: int, tables: int) -> DataFrame:
    """Each node once per table, with its cell there and its cells in all of them."""
    powers = 1 << np.arange(depth, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            offsets, values = vec.offsets.to_numpy().astype(np.int64), vec.values.to_numpy()
            sizes, cells = np.diff(offsets), np.zeros((batch.num_rows, tables), dtype=np.int64)
            if depth:
                for dim in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == dim)
                    sides = units(values[offsets[rows][:, None] + np.arange(dim)]) @ directions(29, depth * tables, dim) > 0
                    cells[rows] = (sides.reshape(len(rows), tables, depth) * powers).sum(axis=2)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables, pa.int32()), pa.array(cells.ravel()))
            kept = [batch.column(c) for c in ("node", "label", "copies", "vec")]
            for t in range(tables):
                yield pa.record_batch(
                    [*kept, pa.array(sizes.astype(np.int32)), pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(cells[:, t]), whole],
                    names=["node", "label", "copies", "vec", "dim", "t", "cell", "cells"],
                )

    return nodes.mapInArrow(run, "node bigint, label string, copies bigint, vec array<double>, dim int, t int, cell bigint, cells array<bigint>")


def linked(nodes: DataFrame, similarity: float, projections: int = PROJECTIONS, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``(node, links, root)``: for nodes with links, how many vectors they link with in a tile and a node they are connected to.

    ``nodes`` are ``(node, label, copies, vec)``.  Where a label has more of
    them than a cell should hold, tables of random signs cut the labels into
    cells, as many tables as the recall needs.  A cell that is still large is
    searched in tiles, so no task holds more than two blocks.  A pair counts in
    the first table where it shares a cell, so no pair ever leaves a task.
    """
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, largest / cell))))
    tables = tables_for(depth, similarity)
    placed = _placed(nodes, depth, tables)
    where = ["label", "dim", "t", "cell"]
    hot = placed.groupBy(*where).count().where(F.col("count") > block).select(
        *where, F.ceil(F.col("count") / block).cast("int").alias("blocks")
    )
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = placed.join(hot, where, "left").withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(
        *where, "node", "copies", "vec", "cells", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high")
    )

    def search(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        table, low, high = key[2].as_py(), key[4].as_py(), key[5].as_py()
        group = group.sort_by("node")
        side = group.column("side").to_numpy()
        nodes_, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        vectors = units(group.column("vec").combine_chunks().flatten().to_numpy().reshape(len(nodes_), -1))
        cells = group.column("cells").combine_chunks().flatten().to_numpy().reshape(len(nodes_), -1)[:, :table]
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)

        def fresh(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (cells[left[i]] != cells[right[j]]).all(axis=1)

        links, forest = np.zeros(len(nodes_), dtype=np.int64), Forest(len(nodes_))
        for i, j in similar_pairs(vectors[left], vectors[right], low == high, similarity, projections, fresh if table else None):
            a, b = left[i], right[j]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            forest.link(a, b)
        some = links > 0
        return pa.table({"node": nodes_[some], "links": links[some], "root": nodes_[forest.root[some]]})

    return dealt.groupBy(*where, "low", "high").applyInArrow(search, "node bigint, links bigint, root bigint")


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", similarity: float = 0.93,
    cell: int = CELL, block: int = BLOCK,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row.

    Vectors of equal label link if their cosine is ``similarity`` or more.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest vec_id reachable and ``kept`` marks the row that bears it.

    Equal vectors of a label are one node, however many rows hold them.  Pairs
    that share a cell are candidates by their count of collisions and confirmed
    in double precision, so no link is false; a pair at the threshold is missed
    with a chance of about 2 in 10,000, closer pairs less often.

    Vectors that are null, empty, zero or hold null or non-finite entries, and
    rows without label, link with nothing and keep their vec_id.  Vectors of
    different dimensions do not link.  Rows without vec_id count as links, are
    never kept and give no component its name.  Repeated rows are rows of
    their own, so a vec_id held twice may be kept twice; an empty table gives
    none; other columns play no part.
    """
    narrow = rows.select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vec")
    )
    tagged = written(_tagged(narrow))
    key = ["label", "d1", "d2"]
    nodes = written(
        tagged.where(F.col("d1").isNotNull()).groupBy(*key)
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"), F.first("vec").alias("vec"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    found = stored(linked(nodes.select("node", "label", "copies", "vec"), similarity, PROJECTIONS, cell, block))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.join(links, "node", "left").join(roots, "node", "left").select(
        *key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "low", F.coalesce("root", "node").alias("root")
    )
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(lowest, "root").select(*key, "n_links", "component_id")
    single = F.col("d1").isNull()
    out = tagged.where(~single).select("id", *key).join(named, key, "left").select("id", "n_links", "component_id")
    alone = tagged.where(single).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def op12(rows: DataFrame) -> DataFrame:
    """Links at a cosine of 0.93 and more."""
    return near_duplicates(rows)


def sql() -> str:
    return """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS w FROM embeddings
        ), s AS (
            SELECT * FROM v WHERE label IS NOT NULL AND len(w) > 0
            AND len([x FOR x IN w IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN w IF x <> 0]) > 0
        ), e AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.w) = len(b.w)
            WHERE list_cosine_similarity(a.w, b.w) >= 0.93
        ), r AS (
            SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
        ), c AS (
            SELECT node, min(root) AS root FROM r GROUP BY node
        )
        SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, root AS component_id, vec_id = root AS kept
        FROM v JOIN c ON c.node = v.vec_id
    """
