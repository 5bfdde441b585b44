"""Whitening of embeddings by shifted CholeskyQR: distributed Gram passes, triangular solves, SVD of the composed factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.tables import written

#: Components of vectors held at once in a task, about.
_ENTRIES = 1 << 21
#: Parts in which the sums of a matrix row are added up before their total.
_SALT = 64
#: Gram passes at most.  Two follow the shifted one; more serve matrices of deficient rank.
_PASSES = 8
#: A direction with less than this share of the largest deviation counts as having none.
_FLAT = 1e-12
#: Scaled entries from here on are no longs any more.
_LONGEST = float(1 << 62)


@dataclass
class Fit:
    """What is known of the vectors of one dimension."""

    n: int
    sums: list[int]
    #: Upper triangular factors of the passes so far: the centred matrix is Q R1, Q is Q' R2 and so on.
    factors: list[np.ndarray] = field(default_factory=list)
    axes: np.ndarray | None = None
    variances: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``, whole part and remainder apart, so that nothing cancels."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return (x - whole).astype(np.float64) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of ``(n x - S)**2`` per row, exact."""
        largest = max(int(np.abs(x).max(initial=0)), max(map(abs, self.sums), default=0))
        if largest * (self.n + 1) >= 1 << 62:
            gaps = x.astype(object) * self.n - np.array(self.sums, dtype=object)
            return [int(v) for v in (gaps * gaps).sum(axis=1)]
        gaps = x * self.n - np.array(self.sums, dtype=np.int64)
        # Three limbs of 21 bits: no product or sum of products leaves 64 bits.
        low, rest = gaps & 0x1FFFFF, gaps >> 21
        middle, high = rest & 0x1FFFFF, rest >> 21
        parts = [(0, low, low, 1), (21, low, middle, 2), (42, low, high, 2), (42, middle, middle, 1), (63, middle, high, 2), (84, high, high, 1)]
        totals = [((a * b).sum(axis=1).tolist(), shift, times) for shift, a, b, times in parts]
        return [sum(t[k] * times << shift for t, shift, times in totals) for k in range(len(x))]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.variances)


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and matrices of the vectors of each dimension; null entries are NaN, null and empty vectors are left out."""
    array = batch.column(column)
    offsets = array.offsets.to_numpy().astype(np.int64)
    sizes = np.where(array.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    values = array.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        step = max(1, _ENTRIES // dim)
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            yield some, values[offsets[some][:, None] + np.arange(dim)]


def _whole(rows: DataFrame, scale: int) -> DataFrame:
    """``(id, x)``: the sound vectors of ``rows`` ``(id, vec)``, scaled and rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in _matrices(batch, "vec"):
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * vectors.astype(np.float64))
                    kept = (np.isfinite(vectors) & (np.abs(x) < _LONGEST)).all(axis=1)
                x = x[kept].astype(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * vectors.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.record_batch([batch.column("id").take(pa.array(at[kept])), flat], names=["id", "x"])

    return rows.mapInArrow(run, "id bigint, x array<bigint>")


def _sums(fit: DataFrame) -> dict[int, Fit]:
    """Numbers of vectors and exact sums of each dimension; a row per task, dimension and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                dim = x.shape[1]
                small = int(np.abs(x).max()) * len(x) < 1 << 62
                own = (x if small else x.astype(object)).sum(axis=0).tolist()
                counts[dim] = counts.get(dim, 0) + len(at)
                sums[dim] = [a + b for a, b in zip(sums.get(dim, [0] * dim), own)]
        rows = [(d, j, counts[d], Decimal(s)) for d, own in sums.items() for j, s in enumerate(own)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["dim", "j", "n", "s"])

    found = fit.mapInArrow(run, "dim int, j int, n bigint, s decimal(38,0)").groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    fits: dict[int, Fit] = {}
    # One row per dimension and place.
    for r in sorted(found.collect(), key=lambda r: (r["dim"], r["j"])):
        fits.setdefault(r["dim"], Fit(r["n"], [])).sums.append(int(r["s"]))
    return fits


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Matrices by dimension from rows ``(dim, i, part, row)``, added place by place."""

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        column = group.column("row").combine_chunks()
        total = column.flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "row": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "dim int, i int, row array<double>"
    some = parts.groupBy("dim", "i", "part").applyInArrow(add, schema)
    rows = some.groupBy("dim", "i").applyInArrow(add, schema).toArrow().sort_by([("dim", "ascending"), ("i", "ascending")]).to_pylist()
    out: dict[int, list[list[float]]] = {}
    for r in rows:
        out.setdefault(r["dim"], []).append(r["row"])
    return {dim: np.array(m) for dim, m in out.items()}


def solved(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``Q`` with ``Q R = rows`` for an upper triangular ``R``, column by column for all rows at once."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _products(fit: DataFrame, fits: dict[int, Fit], white: bool) -> dict[int, np.ndarray]:
    """Gram matrices of the orthogonalised rows, or sums (first row) and products of the whitened ones."""
    wanted = {d: f for d, f in fits.items() if f.axes is not None} if white else fits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The task's number, so that partial sums can be added in two steps.
        from pyspark import TaskContext

        part, totals = TaskContext.get().partitionId() % _SALT, {}
        for batch in batches:
            for _, x in _matrices(batch, "x"):
                if (own := wanted.get(x.shape[1])) is None:
                    continue
                if white:
                    rows = own.whitened(x)
                    product = np.vstack([rows.sum(axis=0), rows.T @ rows])
                else:
                    rows = own.centred(x)
                    for factor in own.factors:
                        rows = solved(factor, rows)
                    product = rows.T @ rows
                totals[x.shape[1]] = totals.get(x.shape[1], 0) + product
        for dim, total in totals.items():
            size = len(total)
            yield pa.record_batch(
                [pa.array(np.full(size, dim, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, part, np.int32)),
                 pa.array(total.tolist(), pa.list_(pa.float64()))], names=["dim", "i", "part", "row"],
            )

    return _added(fit.mapInArrow(run, "dim int, i int, part int, row array<double>"))


def factor_of(gram: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """The upper Cholesky factor, of the shifted matrix where asked or where the matrix is not definite."""
    dim, eps = len(gram), np.finfo(float).eps
    gram = (gram + gram.T) / 2
    if not shift:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    least = min(0.01, 11 * (n * dim + dim * (dim + 1)) * eps) * np.linalg.norm(gram, 2)
    while True:
        try:
            return np.linalg.cholesky(gram + least * np.eye(dim)).T
        except np.linalg.LinAlgError:
            least *= 10


def fitted(fit: DataFrame, components: int) -> dict[int, Fit]:
    """The components of the vectors ``x`` of ``fit``, for each dimension.

    Each pass reads the rows once, orthogonalises them by the factors known
    and adds up their Gram matrix; its Cholesky factor is the next one.  The
    first is shifted, so that it exists whatever the condition.  The passes end
    when the singular values of the composed factor stay as they are.
    """
    fits = _sums(fit)
    open_, last = dict(fits), {}
    composed: dict[int, np.ndarray] = {}
    for turn in range(_PASSES):
        if not open_:
            break
        grams = _products(fit, open_, white=False)
        for dim, own in list(open_.items()):
            gram = grams[dim]
            if not np.trace(gram) > 0:
                del open_[dim]
                continue
            factor = factor_of(gram, own.n, shift=turn == 0)
            own.factors.append(factor)
            composed[dim] = factor @ composed[dim] if dim in composed else factor
            values = np.linalg.svd(composed[dim], compute_uv=False)
            firm = values > _FLAT * values[0]
            before = last.get(dim)
            last[dim] = values
            if turn >= 2 and np.all(np.abs(values - before)[firm] <= 1e-13 * values[firm]):
                del open_[dim]
    for dim, factor in composed.items():
        own = fits[dim]
        _, values, axes = np.linalg.svd(factor)
        k = min(components, int((values > _FLAT * values[0]).sum()))
        own.axes, own.variances = axes[:k].T.copy(), values[:k] ** 2 / own.n
        own.explained = values[:k] ** 2 / (values**2).sum()
    for dim, total in (_products(fit, fits, white=True) if composed else {}).items():
        own = fits[dim]
        mean = total[0] / own.n
        own.identity_error = float(np.abs(total[1:] / own.n - np.outer(mean, mean) - np.eye(len(mean))).max())
    for own in fits.values():
        own.factors = []
    return fits


def whitened(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per vector and component.

    Entries become whole numbers, ``floor(scale * entry)``.  Components are the
    first unit eigenvectors of the covariance of the distinct whole vectors;
    ``whitened`` is the centred vector along one, over its standard deviation.
    ``deviation``, a decimal, is the exact sum of ``(n x - S)**2``.

    Vectors that are null, empty, hold null or non-finite entries, or entries
    beyond whole numbers of 62 bits are dropped.  Vectors of each dimension are
    whitened among themselves.  A direction without spread is no component, so
    fewer than ``components`` rows come back where there are fewer; a single
    distinct vector has none.  Of equal variances any basis may be chosen.
    Repeated rows and rows without vec_id give rows of their own; an empty
    table gives none; other columns play no part.
    """
    narrow = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    whole = _whole(narrow, scale)
    fits = {d: f for d, f in fitted(written(whole.select("x").distinct()), components).items() if f.axes is not None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                if (own := fits.get(x.shape[1])) is None:
                    continue
                values = own.whitened(x)
                size, k = values.shape
                deviations = pa.array([Decimal(v) for v in own.deviations(x)], pa.decimal128(38, 0))
                again = pa.array(np.repeat(np.arange(size), k))
                yield pa.record_batch(
                    [batch.column("id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                     pa.array(np.full(size * k, own.n, np.int64)), deviations.take(again), pa.array(values.ravel()),
                     pa.array(np.tile(own.explained, size)), pa.array(np.full(size * k, own.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return whole.mapInArrow(
        run, "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )


def op13(rows: DataFrame) -> DataFrame:
    """Four components at a scale of 256, the deviation as a long (null beyond 64 bits) and, exact at any size, as a decimal."""
    exact = F.col("deviation")
    return whitened(rows).select(
        "vec_id", "component", "n", exact.try_cast("bigint").alias("deviation"), "whitened", "explained", "identity_error",
        exact.alias("deviation_decimal"),
    )
