"""Best-fit packing of documents into sequences after Martello-Toth dominance."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.durable import stored
from plumbline.llm.batches import give_back, slices, texts_of
from plumbline.llm.byte_bpe import DEFAULT, byte_bpe

CAPACITY = 1024
#: Pieces of one length that one window numbers, about.
NUMBERED = 1 << 15

_PLAN = ("length", "first", "last", "each", "sequence", "at")

#: Sizes in one sequence, and how many sequences look so.
Pattern = tuple[tuple[int, ...], int]


class Sizes:
    """How many items of each size are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for size, count in counts.items():
            if not 0 < size <= capacity:
                raise ValueError(f"size {size} does not fit a capacity of {capacity}")
            self.n[size] = count

    def largest(self, most: int, taken: tuple[int, ...] = ()) -> int:
        """The largest size up to ``most`` of which one is left beside the taken ones; 0 if none."""
        for size in np.nonzero(self.n[: max(0, most) + 1])[0][::-1].tolist():
            if self.n[size] > taken.count(size):
                return size
        return 0

    def smallest(self, how_many: int, taken: tuple[int, ...] = ()) -> list[int]:
        out: list[int] = []
        for size in np.nonzero(self.n)[0].tolist():
            out += [size] * min(how_many - len(out), int(self.n[size]) - taken.count(size))
            if len(out) >= how_many:
                break
        return out

    def take(self, pattern: tuple[int, ...]) -> int:
        """Remove the pattern as often as it goes."""
        need = Counter(pattern)
        times = min(int(self.n[s]) // k for s, k in need.items())
        for s, k in need.items():
            self.n[s] -= times * k
        return times


def _dominant(sizes: Sizes, item: int, capacity: int) -> tuple[int, ...] | None:
    """A set of at most three items with ``item`` that dominates every other feasible set, if one is found.

    A set dominates another if the other's items can be split into groups, each
    no larger than a different item of the set: exchanging them never costs a
    sequence.
    """
    rest = capacity - item
    second = sizes.largest(rest, (item,))
    if not second:
        return (item,)
    if second == rest:
        return (item, second)
    small = sizes.smallest(3, (item,))
    if len(small) < 2 or sum(small[:2]) > rest:
        return (item, second)  # no two others fit, so the largest is best
    if len(small) == 3 and sum(small) <= rest:
        return None  # sets of four are not looked at
    # Two others at most.  The pair with the largest sum, and the largest lower member of any pair:
    present = np.nonzero(sizes.n)[0].tolist()
    best, lower = 0, 0
    for a in present:
        if a > rest or sizes.n[a] <= (item,).count(a):
            continue
        b = sizes.largest(min(a, rest - a), (item, a))
        if b:
            best, lower = max(best, a + b), max(lower, b)
    if second >= best:
        return (item, second)
    third = sizes.largest(rest - second, (item, second))
    if third and third >= lower:
        return (item, second, third)
    return None


def reduced(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences fixed by dominance, and what is left."""
    sizes, fixed = Sizes(counts, capacity), []
    moved = True
    while moved:  # what is fixed may make further sets dominant
        moved = False
        for item in range(capacity, 0, -1):
            while sizes.n[item]:
                pattern = _dominant(sizes, item, capacity)
                if pattern is None:
                    break
                fixed.append((pattern, sizes.take(pattern)))
                moved = True
    return fixed, {s: int(sizes.n[s]) for s in np.nonzero(sizes.n)[0].tolist()}


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit by descending size, equal sequences and equal sizes taken together."""
    bins: dict[int, list[Pattern]] = {}

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if count:
            bins.setdefault(room, []).append((pattern, count))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in bins if r >= size), default=None)
            if room is None:
                each = capacity // size
                put(capacity - each * size, (size,) * each, left // each)
                put(capacity - left % each * size, (size,) * (left % each), int(left % each > 0))
                break
            pattern, count = bins[room].pop()
            if not bins[room]:
                del bins[room]
            each = min(room // size, left)
            filled = min(count, left // each)
            put(room, pattern, count - filled)
            put(room - each * size, pattern + (size,) * each, filled)
            left -= filled * each
    return [entry for entries in bins.values() for entry in entries]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first, last, each, sequence, offset)``: where the items of a length go, by their number.

    Items ``first`` to ``last`` of the length fill sequences from ``sequence``
    on, ``each`` per sequence, starting at ``offset``.
    """
    fixed, rest = reduced(counts, capacity)
    rows, used, sequence = [], Counter(), 0
    for pattern, count in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((size, used[size], used[size] + each * count - 1, each, sequence, offset))
            used[size] += each * count
            offset += each * size
        sequence += count
    return rows


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = DEFAULT, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the token pieces of each row.

    A document's ids end with ``end_id``.  Documents beyond the capacity are
    cut so that all pieces but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path).ids
        end = np.array([end_id], dtype=np.uint32)
        try:
            for part in slices(batches, "text"):
                owner, place, start, length, crc = [], [], [], [], []
                for at, text_ in enumerate(texts_of(part.column("text"))):
                    ids = np.concatenate([encode(text_), end]).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(at), place.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b].tobytes()))
                yield pa.record_batch(
                    [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(place, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        finally:
            # Workers outlive their tasks, and the tokenizer is quickly loaded again.
            del encode
            byte_bpe.cache_clear()
            give_back()

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = DEFAULT, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``, gapless in each sequence.

    The plan works on how many pieces there are of each length, at most
    ``capacity`` numbers.  Sets that Martello and Toth's reduction proves
    dominant are fixed, best-fit packs the rest, and the pieces of each length
    take the planned places by their number.  Lengths of many pieces are
    numbered in salted parts.  Null text is the empty text, one end id; rows
    without doc_id and repeated rows are packed like any other; an empty table
    gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, doc_id, text, path, end_id, capacity))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # As an Arrow table; from Python rows every executor would start more workers to read them.
    columns = np.array(plan(counts, capacity), dtype=np.int64).reshape(-1, len(_PLAN)).T
    places = spark.createDataFrame(pa.table(dict(zip(_PLAN, map(pa.array, columns)))))
    salts = max(1, math.ceil(max(counts.values(), default=0) / NUMBERED))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    numbered = salted.withColumn("_inside", inside).join(bases, ["length", "_salt"]).withColumn("_number", F.col("_base") + F.col("_inside"))
    # The plan has a bounded number of rows: it grows with the capacity, not with the documents.
    number = F.col("_number")
    put = numbered.join(F.broadcast(places), "length").where((number >= F.col("first")) & (number <= F.col("last")))
    step = number - F.col("first")
    return put.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(step / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + (step % F.col("each")) * F.col("length")).alias("offset"),
    )
