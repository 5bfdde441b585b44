"""Numeric relationships: correlation matrix, line equations, correlated features."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.durable import stored
from plumbline.functions.local import local_frame
from plumbline.model import quoted


def _value(name: str) -> Column:
    return F.col(quoted(name)).cast("double")


#: Groups of tasks whose moments are merged before their total.
_PARTS = 64
_MOMENTS = ("n", "mx", "my", "sxx", "syy", "sxy")


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, j, n, mx, my, sxx, syy, sxy)``: counts, means and centred sums of the rows where columns i < j are both present.

    A task multiplies matrices of values and of presences, batch by batch, and
    leaves one row of moments per column; these are merged by the rule for
    combining means and deviations.  No pair of a row's values becomes a row.  A
    NaN or infinite value makes the sums of its pairs NaN.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Everything a worker needs is in here: the package need not be installed there.
        from pyspark import TaskContext

        shift, total = None, None
        for batch in batches:
            held = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            wild = held & ~np.isfinite(x)
            x = np.where(wild, 0.0, x)
            if shift is None:
                # Near the mean, so that the sums of squares do not swallow the deviations.
                shift = x.sum(axis=0) / np.maximum(1, (held & ~wild).sum(axis=0))
            mask = held.astype(np.float64)
            x = np.where(held & ~wild, x - shift, 0.0)
            own = np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x, wild.astype(np.float64).T @ mask])
            total = own if total is None else total + own
        if total is None:
            return
        n, sums, squares, products, wild = total
        with np.errstate(divide="ignore", invalid="ignore"):
            some = np.where(n > 0, n, 1.0)
            mean = sums / some
            spread = np.maximum(0.0, squares - sums * mean)
            out = [n, mean + shift[:, None], mean.T + shift[None, :], spread, spread.T, products - sums * mean.T]
            bad = (wild + wild.T) > 0
        out = [out[0], *[np.where(bad, np.nan, m) for m in out[1:]]]
        part = TaskContext.get().partitionId() % parts
        yield pa.record_batch(
            [pa.array(np.arange(len(n), dtype=np.int32)), pa.array(np.full(len(n), part, np.int32)), *[pa.array(m.tolist(), pa.list_(pa.float64())) for m in out]],
            names=["i", "part", *names],
        )

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        n, mx, my, sxx, syy, sxy = (
            group.column(m).combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1) for m in names
        )
        rows = n.sum(axis=0)
        some = np.where(rows > 0, rows, 1.0)
        # What saw no row of a pair says nothing about it.
        x, y = (np.where(n > 0, m, 0.0) for m in (mx, my))
        ax, ay = (n * x).sum(axis=0) / some, (n * y).sum(axis=0) / some
        dx, dy = np.where(n > 0, x - ax, 0.0), np.where(n > 0, y - ay, 0.0)
        merged = [rows, ax, ay, *[
            np.where(n > 0, s, 0.0).sum(axis=0) + (n * a * b).sum(axis=0) for s, a, b in ((sxx, dx, dx), (syy, dy, dy), (sxy, dx, dy))
        ]]
        head = {"i": pa.array([key[0].as_py()], pa.int32())}
        return pa.table(head | {m: pa.array([v.tolist()], pa.list_(pa.float64())) for m, v in zip(names, merged)})

    parts, names = _PARTS, _MOMENTS
    lists = ", ".join(f"{m} array<double>" for m in names)
    source = df.select(*[_value(c).alias(f"c{k}") for k, c in enumerate(columns)])
    found = source.mapInArrow(moments, f"i int, part int, {lists}")
    found = found.groupBy("i", "part").applyInArrow(merge, f"i int, {lists}").groupBy("i").applyInArrow(merge, f"i int, {lists}")
    # A row per pair of columns.
    return found.select("i", F.posexplode(F.arrays_zip(*names)).alias("j", "m")).where(F.col("i") < F.col("j")).select(
        "i", "j", F.col("m.n").cast("bigint").alias("n"), *[F.col(f"m.{m}") for m in names[1:]]
    )


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], *, sample_fraction: float | None = None
) -> DataFrame:
    """``(col1, col2, correlation)`` for every pair in column order.

    One scan serves any number of columns.  Rows where either side is NULL are
    left out per pair; a pair with a constant side or fewer than two rows has
    NULL.  The whole table is used unless a sample is asked for.
    """
    names = [c for c in columns if c in df.columns]
    source = df if sample_fraction is None else df.sample(fraction=sample_fraction, seed=42)
    pairs = list(combinations(range(len(names)), 2))
    wanted = local_frame(
        df.sparkSession, [(i, j, names[i], names[j]) for i, j in pairs], "i int, j int, col1 string, col2 string"
    )
    if not pairs:
        return wanted.select("col1", "col2", F.lit(None).cast("double").alias("correlation"))
    correlation = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    # Rounding may lead a little beyond one.
    bounded = F.when(F.abs(correlation) > 1, F.signum(correlation)).otherwise(correlation)
    found = pair_moments(source, names).select("i", "j", F.when(F.isnan("sxy"), F.col("sxy")).otherwise(bounded).alias("correlation"))
    # One row per pair of columns on either side.
    return wanted.join(F.broadcast(found), ["i", "j"], "left").select("col1", "col2", "correlation")


def line_equations(
    df: DataFrame, columns: Sequence[str], matrix: DataFrame | None = None, threshold: float = 0.9
) -> DataFrame:
    """Equations between columns that are (nearly) linear functions of each other.

    Columns are grouped greedily in column order: the first of a group is the
    anchor, every column correlated with it gets a line through it.  The matrix
    has one entry per column pair, so it is read on the driver.
    """
    names = [c for c in columns if c in df.columns]
    matrix = correlation_matrix(df, names) if matrix is None else matrix
    known = {(r["col1"], r["col2"]): r["correlation"] for r in matrix.collect()}

    def r(a: str, b: str) -> float | None:
        value = known.get((a, b), known.get((b, a)))
        return None if value is None or math.isnan(value) else value

    grouped: set[str] = set()
    wanted: list[tuple[str, str]] = []
    for anchor in names:
        if anchor in grouped:
            continue
        close = [c for c in names if c != anchor and abs(r(anchor, c) or 0.0) >= threshold]
        if close:
            grouped.update([anchor, *close])
            wanted += [(anchor, c) for c in close]
    schema = (
        "target_variable string, feature_variable string, equation string, slope double, "
        "intercept double, relationship_type string, correlation double"
    )
    if not wanted:
        return local_frame(df.sparkSession, [], schema)
    aggregates, rows = [], []
    for i, (x, y) in enumerate(wanted):
        # regr_* functions look at pairs where both sides are present.
        vy, vx = _value(y), _value(x)
        aggregates += [
            F.regr_count(vy, vx).alias(f"n{i}"), F.regr_sxx(vy, vx).alias(f"sxx{i}"),
            F.regr_syy(vy, vx).alias(f"syy{i}"), F.regr_avgx(vy, vx).alias(f"mx{i}"),
            F.regr_avgy(vy, vx).alias(f"my{i}"),
        ]
        sign = math.copysign(1.0, r(x, y))
        slope = sign * F.sqrt(F.try_divide(f"syy{i}", f"sxx{i}"))
        rows.append(F.struct(
            F.lit(y).alias("target_variable"), F.lit(x).alias("feature_variable"),
            slope.alias("a"), (F.col(f"my{i}") - slope * F.col(f"mx{i}")).alias("b"),
            F.lit(r(x, y)).alias("correlation"), F.col(f"n{i}").alias("n"),
        ))
    lines = df.agg(*aggregates).select(F.inline(F.array(*rows))).where(
        (F.col("n") >= 2) & F.col("a").isNotNull()
    )
    a, b, eps = F.col("a"), F.col("b"), 1e-6
    y, x = F.col("target_variable"), F.col("feature_variable")
    through_origin = F.abs(b) < eps
    kind = (
        F.when((F.abs(a - 1) < eps) & through_origin, "direct")
        .when((F.abs(a + 1) < eps) & through_origin, "inverse").otherwise("scaled")
    )
    plain = F.format_string("%s = %.6f * %s", y, a, x)
    equation = (
        F.when(kind == "direct", F.concat(y, F.lit(" = "), x))
        .when(kind == "inverse", F.concat(y, F.lit(" = -"), x))
        .when(through_origin, plain)
        .otherwise(F.concat(plain, F.when(b > 0, " + ").otherwise(" - "), F.format_string("%.6f", F.abs(b))))
    )
    return lines.select(
        y, x, equation.alias("equation"), F.round(a, 6).alias("slope"),
        F.round(b, 6).alias("intercept"), kind.alias("relationship_type"), "correlation",
    )


def correlated_features(matrix: DataFrame, threshold: float) -> DataFrame:
    """``(target_variable, feature, correlation)``: strong, yet not the same column again.

    The matrix is stored, so that both directions read it and neither computes it again.
    """
    matrix = stored(matrix)
    both = matrix.select(
        F.col("col1").alias("target_variable"), F.col("col2").alias("feature"), "correlation"
    ).unionByName(matrix.select(
        F.col("col2").alias("target_variable"), F.col("col1").alias("feature"), "correlation"
    ))
    size = F.abs("correlation")
    return both.where((size >= threshold) & (size < 0.9999)).withColumn(
        "correlation", F.round("correlation", 4)
    )


def features_by_target(features: DataFrame) -> DataFrame:
    """One row per target with its features, at most one per column."""
    return features.groupBy("target_variable").agg(
        F.array_sort(F.collect_list(F.struct("feature", "correlation"))).alias("correlated_features")
    )
