"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.batches import slices, texts_of

#: Components of a hypervector.
WIDTH = 1024
#: Languages a model may hold; its size is this times the width.
MOST_LANGUAGES = 1000
#: Letters up to here have a vector of their own, later ones share as many again.
_OWN = 4096
_SYMBOLS = 2 * _OWN
_SLICE = 1 << 20
#: Trigrams whose vectors are summed at once while learning, 10 KB each.
_BLOCK = 512
#: Trigrams whose vectors are held at once, 5 KB each.
MOST_KINDS = 1 << 13


@cache
def _symbols() -> np.ndarray:
    """The symbol of each code point: 0 for what is no letter, lower and upper case alike."""
    out = np.zeros(0x110000, dtype=np.int32)
    for point in range(0x110000):
        if chr(point).isalpha():
            low = ord(chr(point).lower()[0])
            out[point] = low if low < _OWN else _OWN + low % _OWN
    return out


@cache
def _letters(width: int) -> np.ndarray:
    """A random vector of ones and minus ones for each symbol; drawn alike everywhere."""
    return (2 * np.random.default_rng(29).integers(0, 2, (_SYMBOLS, width), dtype=np.int8) - 1).astype(np.int8)


def bound(grams: np.ndarray, width: int) -> np.ndarray:
    """The vector of each letter trigram: its letters' vectors, rotated by their place, multiplied."""
    letters = _letters(width)
    first, rest = np.divmod(grams, _SYMBOLS * _SYMBOLS)
    second, third = np.divmod(rest, _SYMBOLS)
    # Only the vectors that are used are rotated, by slices of the columns.
    out = letters[third]
    for chosen, turn in ((second, 1), (first, 2)):
        own = letters[chosen]
        out[:, turn:] *= own[:, :-turn]
        out[:, :turn] *= own[:, -turn:]
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of letters over all texts, and the text of each.

    Whatever stands between letters is one gap, and a gap opens and closes each text.
    """
    points = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    marks = _symbols()[points]
    # A text's symbols are those from the blank before it up to the one after it.
    opens = np.zeros(len(points), dtype=bool)
    opens[np.cumsum(lengths) - lengths] = True
    kept = np.nonzero((marks != 0) | np.concatenate([[True], marks[:-1] != 0]))[0]
    opened = np.searchsorted(kept, np.nonzero(opens)[0])
    missing = (opened >= len(kept)) | (kept[np.minimum(opened, len(kept) - 1)] != np.nonzero(opens)[0])
    if missing.any():
        kept = np.sort(np.concatenate([kept, np.nonzero(opens)[0][missing]]))
    marks, owner = marks[kept].astype(np.int64), np.append(owner, np.int32(len(texts)))[kept]
    gram = (marks[:-2] * _SYMBOLS + marks[1:-1]) * _SYMBOLS + marks[2:]
    whose = owner[:-2]
    # The last symbol may be the gap that opens the next text.
    inside = (whose == owner[1:-1]) & ((whose == owner[2:]) | (marks[2:] == 0)) & (whose < len(texts))
    inside &= (marks[1:-1] != 0) | (marks[2:] != 0)
    return gram[inside], whose[inside].astype(np.int64)


@dataclass
class Profiles:
    """Unit prototypes, one row per language in the order of their names."""

    names: list[str]
    vectors: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        gram, whose = trigrams(texts)
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not len(gram) or not self.names:
            return names, scores
        width = self.vectors.shape[1]
        both, counts = np.unique((whose << 40) | gram, return_counts=True)
        kinds, at = np.unique(both & ((1 << 40) - 1), return_inverse=True)
        if len(kinds) > MOST_KINDS and len(texts) > 1:
            # Fewer texts at once, so that the vectors of their trigrams stay few.
            half = len(texts) // 2
            del gram, whose, both, counts, kinds, at
            (left, a), (right, b) = self.predict(texts[:half]), self.predict(texts[half:])
            return left + right, np.concatenate([a, b])
        # A single text may have any number of trigrams: their vectors are made where they are summed.
        vectors = bound(kinds, width).astype(np.float32) if len(kinds) <= MOST_KINDS else None
        counts, whose = counts.astype(np.float32), both >> 40
        edges = np.searchsorted(whose, np.arange(len(texts) + 1))
        step = 4096
        for k in np.nonzero(np.diff(edges))[0].tolist():
            bundle = np.zeros(width)
            for a in range(edges[k], edges[k + 1], step):
                part = slice(a, min(a + step, edges[k + 1]))
                own = bound(kinds[at[part]], width).astype(np.float32) if vectors is None else vectors[at[part]]
                bundle += counts[part] @ own
            length = np.sqrt(bundle @ bundle)
            cosines = self.vectors @ bundle / length if length else np.zeros(len(self.names))
            best = int(cosines.argmax())
            names[k], scores[k] = self.names[best], min(1.0, max(0.0, float(cosines[best])))
        return names, scores


def learned(rows: DataFrame, text: str = "text", lang: str = "lang", width: int = WIDTH) -> Profiles:
    """Prototypes: for each language the sum of the trigram vectors of all its texts.

    Sums are whole numbers, so they do not depend on how rows are spread.  Rows
    without text or language teach nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches, "text", _SLICE // 2):
            tongues = part.column("lang").to_pylist()
            order = {name: k for k, name in enumerate(dict.fromkeys(tongues))}
            which = np.array([order[t] for t in tongues])
            gram, whose = trigrams(texts_of(part.column("text")))
            both, counts = np.unique((which[whose] << 40) | gram, return_counts=True)
            tongue, gram = both >> 40, both & ((1 << 40) - 1)
            for name, k in order.items():
                mine = np.nonzero(tongue == k)[0]
                total = totals.setdefault(name, np.zeros(width, dtype=np.int64))
                for a in range(0, len(mine), _BLOCK):
                    some = mine[a : a + _BLOCK]
                    total += np.rint(counts[some].astype(np.float64) @ bound(gram[some], width)).astype(np.int64)
        if totals:
            yield pa.record_batch([pa.array(list(totals)), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.int64()))], names=["lang", "total"])

    narrow = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    sums = (
        narrow.mapInArrow(run, "lang string, total array<bigint>")
        .select("lang", F.posexplode("total").alias("place", "value"))
        .groupBy("lang", "place").agg(F.sum("value").alias("value"))
    )
    # Bounded: languages times width, which is checked.
    most = MOST_LANGUAGES * width
    cells = sums.limit(most + 1).toPandas()
    if len(cells) > most:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(cells["lang"].unique().tolist())
    vectors = np.zeros((len(names), width))
    row = {name: k for k, name in enumerate(names)}
    vectors[cells["lang"].map(row).to_numpy(dtype=int), cells["place"].to_numpy(dtype=int)] = cells["value"].to_numpy(dtype=float)
    lengths = np.sqrt((vectors**2).sum(axis=1))
    known = lengths > 0
    return Profiles([n for n, k in zip(names, known) if k], vectors[known] / lengths[known, None])


def identified(docs: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns of ``docs`` with ``lang_pred`` and ``score``.

    The score is the cosine with the nearest prototype, 0 at least; ties go to
    the first name.  ``und`` with score 0 stands for null text, text without
    letters, and a model that has learned nothing.  Very long texts are bundled
    in parts and judged whole; repeated rows get equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", _SLICE):
            names, scores = profiles.predict(texts_of(part.column("_text")))
            yield pa.record_batch([*[part.column(k) for k in keep], pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    narrow = docs.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{kinds}{', ' if kinds else ''}lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 when divided by 4; not for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def taught(docs: DataFrame) -> Profiles:
    """Prototypes from all documents that have an id and are not held out."""
    return learned(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def op1(docs: DataFrame) -> DataFrame:
    """Every document, judged by prototypes of those not held out."""
    named = identified(docs.select("doc_id", "text"), taught(docs), keep=("doc_id",))
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
