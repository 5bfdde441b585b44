"""Exact percentiles of any number of columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.local import local_frame

#: Bins into which a scan cuts the values between two bounds.
BINS = 4096
#: Bins of the first scan to a factor of e; positive doubles span 1,455 such factors.
_STEPS = 128
# Places of the values that have no logarithm, beyond those that have one.
_ZERO, _INFINITE, _NAN = 0, 4000 * _STEPS, 4000 * _STEPS + 1


@dataclass
class _Rank:
    """A place in the order of a column, from 0, and the bounds between which its value lies."""

    column: int
    rank: int
    # Among the values between the bounds.
    place: int = 0
    low: float = -math.inf
    high: float = math.nan


def _first_bin(v: Column) -> Column:
    """A number that never falls as the value rises; what shares it has one sign and nearly the same size."""
    size = F.floor(F.ln(F.abs(v)) * _STEPS) + 2000 * _STEPS
    place = F.when(F.isnan(v), _NAN).when(v == 0, _ZERO).when(F.abs(v) == float("inf"), _INFINITE).otherwise(size)
    return F.when((v < 0) & ~F.isnan(v), -place).otherwise(place).cast("int")


def _scan(values: DataFrame, parts: Mapping[int, Column], bin_: Column) -> DataFrame:
    """``(part, bin, n, low, high, upto)``: values per part and bin, and how many of the part up to its end.

    ``parts`` gives the part of a column's value or NULL, ``bin_`` the bin of the
    value ``v`` in its ``part``.  A part has a few hundred thousand bins at most,
    and that many rows is all a window sees.
    """
    entries = F.array(*[
        F.struct(F.when(F.col(f"v{c}").isNotNull(), part).alias("part"), F.col(f"v{c}").alias("v")) for c, part in parts.items()
    ])
    rows = values.select(F.inline(entries)).where(F.col("part").isNotNull())
    counted = rows.groupBy("part", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    line = Window.partitionBy("part").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("upto", F.sum("n").over(line))


def _narrowed(values: DataFrame, ranks: list[_Rank]) -> None:
    """Move the bounds of every rank to those of its bin, in one scan."""
    bounds = sorted({(r.column, r.low, r.high) for r in ranks})
    number = {b: k for k, b in enumerate(bounds)}
    parts: dict[int, Column] = {}
    for (c, low, high), k in reversed(number.items()):
        v = F.col(f"v{c}")
        parts[c] = F.when((v >= low) & (v <= high), k).otherwise(parts.get(c, F.lit(None).cast("int")))
    # In halves, so that no difference leaves the range of doubles.
    start = F.array(*[F.lit(low / 2) for _, low, _ in bounds])[F.col("part")]
    step = F.array(*[F.lit((high / 2 - low / 2) / BINS) for _, low, high in bounds])[F.col("part")]
    place = F.try_divide(F.col("v") / 2 - start, step)
    bins = _scan(values, parts, F.least(F.lit(BINS - 1), F.floor(F.coalesce(place, F.lit(0.0)))).cast("int"))
    wanted = local_frame(
        values.sparkSession, sorted({(number[r.column, r.low, r.high], r.place) for r in ranks}), "part int, place bigint"
    )
    held = (F.col("upto") - F.col("n") <= F.col("place")) & (F.col("place") < F.col("upto"))
    # A few rows per column on either side.
    rows = bins.join(F.broadcast(wanted), "part").where(held).select(
        "part", "place", (F.col("place") - F.col("upto") + F.col("n")).alias("inside"), "low", "high"
    ).collect()
    found = {(r["part"], r["place"]): r for r in rows}
    for r in ranks:
        hit = found[number[r.column, r.low, r.high], r.place]
        r.place, r.low, r.high = hit["inside"], hit["low"], hit["high"]


def column_percentiles(df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float]) -> DataFrame:
    """Interpolated percentiles of several columns as rows ``(column_name, probability, value)``.

    All ranks of all columns are narrowed down together.  The first scan counts
    the values by sign and size; each further one cuts the bin of every rank
    into thousands, until a bin holds a single value.  The scans are four or so,
    whatever the columns, ranks and rows; nothing is sorted but bins, and no
    value that lies outside the bins looked at leaves its task.  The scans run
    when this is called.  NaN counts as the largest value; a column without
    values has no rows.
    """
    spark, names = df.sparkSession, list(values)
    schema = "column_name string, probability double, value double"
    wanted = [float(p) for p in probabilities]
    if not names or not wanted:
        return local_frame(spark, [], schema)
    # Adding zero turns -0.0 into 0.0.
    source = df.select(*[(v.cast("double") + F.lit(0.0)).alias(f"v{c}") for c, v in enumerate(values.values())])
    shares = F.array(*[F.lit(p) for p in sorted(set(wanted))])
    first = _scan(source, {c: F.lit(c) for c in range(len(names))}, _first_bin(F.col("v")))
    total = F.sum("n").over(Window.partitionBy("part"))
    position = first.withColumn("total", total).withColumn("position", F.explode(F.transform(shares, lambda p: p * (F.col("total") - 1))))
    rank = position.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))))
    rank = rank.where((F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    totals: dict[int, int] = {}
    open_: list[_Rank] = []
    for r in rank.select("part", "total", "rank", (F.col("rank") - F.col("upto") + F.col("n")).alias("inside"), "low", "high").distinct().collect():
        totals[r["part"]] = r["total"]
        open_.append(_Rank(r["part"], r["rank"], r["inside"], r["low"], r["high"]))
    done: dict[tuple[int, int], float] = {}
    while open_:
        done |= {(r.column, r.rank): r.high for r in open_ if r.low == r.high or r.high != r.high}
        open_ = [r for r in open_ if (r.column, r.rank) not in done]
        if open_:
            _narrowed(source, open_)
    rows = []
    for c, total_ in sorted(totals.items()):
        for p in wanted:
            at = p * (total_ - 1)
            lower, upper, weight = done[c, math.floor(at)], done[c, math.ceil(at)], at - math.floor(at)
            rows.append((names[c], p, lower if weight == 0 else lower * (1 - weight) + upper * weight))
    return local_frame(spark, rows, schema)


def exact_percentiles(df: DataFrame, value: Column, probabilities: Sequence[float]) -> DataFrame:
    """Interpolated percentiles of one column as rows ``(probability, value)``."""
    return column_percentiles(df, {"v": value}, probabilities).select("probability", "value")
