"""Exact top-k inner products, by descending length and Cauchy-Schwarz bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.vectors import clean, ranked, search_blocks

#: Rows whose partial sums are taken at once, and the share of rotated dimensions summed first.
CHUNK = 1024
HEAD = 0.375
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) for every component."""
    with np.errstate(over="ignore"):
        return np.floor(vectors * scale)


def _exact_large(query_ids, queries, ids, rows, top: int, scale: int):
    """Python integers, for components whose products leave the exact range of doubles."""
    def integers(matrix):
        return [[int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(x * scale)) for x in row] for row in matrix.tolist()]

    out: tuple[list, list, list] = ([], [], [])
    asked, there = integers(queries), integers(rows)
    for own, q in zip(query_ids.tolist(), asked):
        best = sorted((-sum(a * b for a, b in zip(q, r)), i) for i, r in zip(ids.tolist(), there) if i != own)[:top]
        out[0].extend([own] * len(best)), out[1].extend(i for _, i in best)
        out[2].extend(min(max(-s, _LONG[0]), _LONG[1]) for s, _ in best)
    return tuple(np.array(o, dtype=np.int64) for o in out)


def highest(query_ids, queries, ids, rows, top: int, scale: int = 64, chunk: int = CHUNK, head: float = HEAD):
    """Per query the ``top`` rows of highest integer inner product, ties to the smaller id."""
    nothing = np.zeros(0, np.int64)
    if not len(ids) or not len(query_ids):
        return nothing, nothing, nothing
    q, x = whole(queries, scale), whole(rows, scale)
    if not float(np.abs(q).max()) * float(np.abs(x).max()) * x.shape[1] < 2.0**52:
        return _exact_large(query_ids, queries, ids, rows, top, scale)
    length = np.sqrt((x * x).sum(axis=1))
    order = np.lexsort((ids, -length))
    x, ids, length = x[order], ids[order], length[order]
    # The leading directions of the rows come first, so that partial sums hold most of a product.
    _, turn = np.linalg.eigh(x.T @ x)
    first = max(1, round(head * x.shape[1]))
    qt, xt = q @ turn[:, ::-1], x @ turn[:, ::-1]
    q_rest, x_rest = (np.sqrt(np.maximum((m[:, first:] ** 2).sum(axis=1), 0.0)) for m in (qt, xt))
    qt, xt = np.ascontiguousarray(qt[:, :first]), np.ascontiguousarray(xt[:, :first])
    q_length = np.sqrt((q * q).sum(axis=1))
    slack = 1e-9 * q_length * length[0] + 1e-6
    low = np.full(len(q), -np.inf)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), nothing)] * len(q)
    active = np.arange(len(q))
    for k in range(0, len(x), chunk):
        # Rows are sorted by length: a query this bound ends needs none of the rest.
        active = active[q_length[active] * length[k] + slack[active] >= low[active]]
        if not len(active):
            break
        bound = qt[active] @ xt[k : k + chunk].T
        bound += q_rest[active, None] * x_rest[None, k : k + chunk]
        open_ = bound >= (low[active] - slack[active])[:, None]
        for i in np.nonzero(open_.any(axis=1))[0].tolist():
            at = active[i]
            left = k + np.nonzero(open_[i])[0]
            left = left[ids[left] != query_ids[at]]
            scores = np.concatenate([best[at][0], x[left] @ q[at]])
            names = np.concatenate([best[at][1], ids[left]])
            keep = np.lexsort((names, -scores))[:top]
            best[at] = scores[keep], names[keep]
            if len(keep) == top:
                low[at] = scores[keep[-1]]
    counts = [len(b[1]) for b in best]
    return (
        np.repeat(query_ids, counts),
        np.concatenate([b[1] for b in best]),
        np.concatenate([b[0] for b in best]).astype(np.int64),
    )


def top_products(
    queries: DataFrame, rows: DataFrame, top: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` rows of highest inner product of floor(scale * x).

    Each shard takes its rows by descending length.  A query leaves a shard
    once its length times the next row's cannot reach its lowest kept score;
    before that, rows drop out whose partial sum over the leading rotated
    directions plus the product of the residual lengths is too low.  What is
    left is scored in exact integers, so the result is exact.  Null or empty
    vectors, vectors with null or non-finite components, and rows without id
    take no part.  A repeated vec_id counts once, with its smallest vector.
    Scores beyond a long stand at its limits.  An empty table gives no rows.
    Other columns play no part.
    """
    def search(query_ids, asked, ids, vectors, k):
        return highest(query_ids, asked, ids, vectors, k, scale)

    found = search_blocks(clean(queries, vec_id, embedding), clean(rows, vec_id, embedding), top, search, "bigint")
    return ranked(found, top, nearest=False)


def op6(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20."""
    return top_products(embeddings.where(F.col("vec_id") % 20 == 0), embeddings)
