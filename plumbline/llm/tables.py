"""Written tables in the shared folder, and bit filters of bounded size."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.durable import ensure_checkpoint_dir

#: A filter of unknown load has two to the power of this bits, 8 MB.
FILTER_BITS = 26
#: Bits for an entry where the load is known, and least and most powers of two: 128 KB to 64 MB.
ENTRY_BITS = 16
LEAST_BITS, MOST_BITS = 20, 29


def bits_for(entries: int) -> int:
    """The power of two of bits for so many entries; beyond the largest filter it lets more through."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, entries) * ENTRY_BITS - 1).bit_length()))


def written(df: DataFrame) -> DataFrame:
    """The frame as Parquet in the checkpoint folder, read again: columnar and compressed."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class BitFilter:
    """Which hashes may be among those it was built from; never denies one of them.

    Its size is bounded, so it can be sent to every task.  With more entries
    than it was sized for it lets more through, and whoever asks it must be right
    with any answer.
    """

    def __init__(self, hashes: DataFrame, column: str, bits: int = FILTER_BITS):
        self.bits = bits
        mask = (1 << bits) - 1
        h = F.col(column)
        places = F.explode(F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, bits).bitwiseAND(F.lit(mask)))).alias("p")
        words = hashes.select(places).groupBy(F.shiftright("p", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")
        )
        self.words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        # At most 2**(bits - 6) rows.
        found = words.toArrow()
        self.words[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)

    @classmethod
    def of(cls, bits: int) -> BitFilter:
        """A filter of nothing."""
        out = cls.__new__(cls)
        out.bits, out.words = bits, np.zeros(1 << (bits - 6), dtype=np.uint64)
        return out

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        h, mask = hashes.view(np.uint64), np.uint64((1 << self.bits) - 1)
        out = np.ones(len(h), dtype=bool)
        for place in (h & mask, (h >> np.uint64(self.bits)) & mask):
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out
