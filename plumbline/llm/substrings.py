"""Substring deduplication: windows of words that an earlier document holds, found in FM-indexes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.batches import powers, raw_texts, single_blanks, slices
from plumbline.llm.fm_index import FMIndex, Minima, matching_owners
from plumbline.llm.tables import BitFilter, bits_for, written

WINDOW = 13
#: Words whose smallest hash in a window decides where the window is looked up.
ANCHOR = 6
#: Words of one index, about; anchors of more segments than this are cut into windows.
SHARD_WORDS = 1 << 17
HOT_SEGMENTS = 1 << 12
#: Windows of a chunk, about: passages are first compared in chunks, then by windows.
CHUNK = 64
_SEEN = 1 << 20
_FOLD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a text with one blank between, where each begins and ends, and hashes of them.

    All windows of a text are slices of its line; the words themselves are never listed.
    """

    def __init__(self, text: bytes, anchor: int):
        self.line = single_blanks(text)
        raw = np.frombuffer(self.line, dtype=np.uint8)
        blanks = np.flatnonzero(raw == 32)
        self.begin = np.concatenate([[0], blanks + 1])
        self.end = np.append(blanks, len(raw))
        self.count = len(self.begin) if len(raw) else 0
        if self.count < anchor:
            self.grams = np.zeros(0, np.uint64)
            return
        up, down = powers(len(raw))
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw + np.uint64(1)) * up, out=sums[1:])
        hashes = (sums[self.end] - sums[self.begin]) * down[self.begin]
        # A hash of each ``anchor`` consecutive words.
        grams = np.zeros(self.count - anchor + 1, dtype=np.uint64)
        for k in range(anchor):
            grams = (grams ^ hashes[k : k + len(grams)]) * _FOLD
            grams ^= grams >> np.uint64(29)
        self.grams = grams

    def slice(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last``, inclusive."""
        return self.line[self.begin[first] : self.end[last]]


def chunks(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, numbers of windows and 128-bit keys of a document's chunks.

    A chunk opens at each window whose first words hash low, about every
    ``CHUNK`` windows, so equal passages are cut alike.  Its key covers the
    words of all its windows.
    """
    windows = words.count - window + 1
    cut = np.nonzero(words.grams[1:windows] < np.uint64((1 << 64) // CHUNK))[0] + 1
    first, stop = np.concatenate([[0], cut]), np.append(cut, windows)
    line, digest = words.line, xxhash.xxh3_128_digest
    ends = words.end[stop + window - 2]
    keys = b"".join(digest(line[a:b]) for a, b in zip(words.begin[first].tolist(), ends.tolist()))
    return first, stop - first, np.frombuffer(keys, dtype="<i8").reshape(-1, 2)


def segments_of(grams: np.ndarray, allowed: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, numbers of windows and anchors of the segments of the allowed windows.

    The anchor of a window is the smallest hash of its ``anchor`` consecutive
    words, leftmost if equal; windows in a row with the same anchor make one
    segment.  Equal windows have equal anchors wherever they stand.
    """
    inside, n = window - anchor + 1, len(allowed)
    low = np.uint64((1 << (inside - 1).bit_length()) - 1)
    high = grams & ~low
    # The lowest bits hold the place, so that a minimum finds both.
    least = high[:n]
    for k in range(1, inside):
        least = np.minimum(least, high[k : k + n] | np.uint64(k))
    place = np.arange(n) + (least & low).astype(np.int64)
    opens = np.ones(n, dtype=bool)
    opens[1:] = (place[1:] != place[:-1]) | (allowed[1:] != allowed[:-1])
    first = np.nonzero(opens)[0]
    size = np.diff(np.append(first, n))
    kept = allowed[first]
    return first[kept], size[kept], grams[place[first[kept]]]


def _mixed(k1: np.ndarray, doc: int) -> np.ndarray:
    return k1 ^ np.int64(doc) ^ (np.int64(doc) << np.int64(26))


def _first_segments(doc: int, text: bytes, firsts: BitFilter, window: int, anchor: int):
    """Words and segments of the chunks that this document may be the first to hold."""
    words = Words(text, anchor)
    none = np.zeros(0, np.int64)
    if words.count < window:
        return words, none, none, none.astype(np.uint64)
    _, n, keys = chunks(words, window)
    mine = firsts.holds(_mixed(keys[:, 0], doc))
    if not mine.any():
        return words, none, none, none.astype(np.uint64)
    return words, *segments_of(words.grams, np.repeat(mine, n), window, anchor)


def _chunk_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(doc_id, start, n, k1, k2)``: the chunks of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]]
            for k, text in enumerate(raw_texts(part.column("text"))):
                words = Words(text, anchor)
                if words.count >= window:
                    first, n, keys = chunks(words, window)
                    for column, values in zip(out, (np.full(len(first), k), first, n, keys)):
                        column.append(values)
            owner, first, n, keys = map(np.concatenate, out)
            yield pa.record_batch(
                [part.column("doc_id").take(pa.array(owner)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1])],
                names=["doc_id", "start", "n", "k1", "k2"],
            )

    return docs.mapInArrow(run, "doc_id bigint, start int, n int, k1 bigint, k2 bigint")


def _anchor_rows(docs: DataFrame, firsts: BitFilter, window: int, anchor: int) -> DataFrame:
    """``(doc_id, mark)``: the different anchors of each document's first chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            owner, mark = [], []
            for k, (doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), raw_texts(part.column("text")))):
                own = np.unique(_first_segments(doc, text, firsts, window, anchor)[3])
                owner.append(np.full(len(own), k)), mark.append(own.view(np.int64))
            yield pa.record_batch(
                [part.column("doc_id").take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(mark))], names=["doc_id", "mark"]
            )

    return docs.mapInArrow(run, "doc_id bigint, mark bigint")


def _shared_segments(docs: DataFrame, firsts: BitFilter, shared: BitFilter, window: int, anchor: int) -> DataFrame:
    """Each segment of a first chunk whose anchor may be shared: ``(doc_id, start, k1, k2, mark, n, words)``.

    ``k1`` and ``k2`` are the 128-bit key of its words.  ``mark``, ``n``, its
    windows, and ``words`` are filled once per task for each distinct segment.
    """

    digest = xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches, "text"):
            if len(seen) > _SEEN:
                seen.clear()
            owner, starts, sizes, marks = ([np.zeros(0, np.int64)] for _ in range(4))
            keys: list[bytes] = []
            lines: list[bytes | None] = []
            for k, (doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), raw_texts(part.column("text")))):
                words, first, n, mark = _first_segments(doc, text, firsts, window, anchor)
                held = np.flatnonzero(shared.holds(mark)) if len(mark) else ()
                if not len(held):
                    continue
                first, n = first[held], n[held]
                for column, values in zip((owner, starts, sizes, marks), (np.full(len(held), k), first, n, mark[held].view(np.int64))):
                    column.append(values)
                line = words.line
                for a, b in zip(words.begin[first].tolist(), words.end[first + n + window - 2].tolist()):
                    own = line[a:b]
                    key = digest(own)
                    keys.append(key)
                    if key in seen:
                        lines.append(None)
                    else:
                        seen.add(key)
                        lines.append(own)
            both = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            texts = pa.array(lines, pa.binary())
            known = pa.array(np.array([x is None for x in lines], dtype=bool))
            n_, m_ = (pc.if_else(known, pa.scalar(None, kind), pa.array(np.concatenate(c), kind)) for c, kind in ((sizes, pa.int32()), (marks, pa.int64())))
            yield pa.record_batch(
                [part.column("doc_id").take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(starts), pa.int32()),
                 pa.array(both[:, 0]), pa.array(both[:, 1]), m_, n_, texts],
                names=["doc_id", "start", "k1", "k2", "mark", "n", "words"],
            )

    return docs.mapInArrow(run, "doc_id bigint, start int, k1 bigint, k2 bigint, mark bigint, n int, words binary")


def first_owners(lines: list[bytes], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each line, the smallest owner of any line that holds the window's words.

    Builds one FM-index over all lines and streams their windows through it.
    """
    words = [line.split() for line in lines]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    names = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for own in words for w in own))}
    symbols = np.zeros(int(counts.sum()) + len(words), dtype=np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    inside = np.ones(len(symbols), dtype=bool)
    inside[starts + counts] = False
    symbols[inside] = np.fromiter((names[w] for own in words for w in own), np.int64, int(counts.sum()))
    index = FMIndex(symbols, window)
    owner = np.repeat(owners, counts + 1)
    lowest = Minima(owner[index.order])
    windows = counts - window + 1
    ends = np.concatenate([np.arange(s + window - 1, s + c) for s, c in zip(starts.tolist(), counts.tolist())])
    lengths, first = matching_owners(index, lowest, symbols, ends, window)
    # What no other suffix shares belongs to its own line.
    first = np.where(lengths < window, np.repeat(owners, windows), first)
    return np.split(first, np.cumsum(windows)[:-1])


def _distinct_windows(windows: DataFrame) -> DataFrame:
    """``(w1, w2, owner, words)``: each distinct window with the smallest document that holds it."""
    return windows.groupBy("w1", "w2").agg(F.min("owner").alias("owner"), F.min("words").alias("words"))


def _searched(segments: DataFrame, window: int) -> DataFrame:
    """``(k1, k2, at, first)``: per distinct segment and window, the smallest document that holds the window.

    Segments are dealt by their anchor.  The windows of an anchor with very many
    distinct segments are dealt one by one, by their own words and each distinct
    one once, so that neither a short phrase nor a passage in very many contexts
    meets in one task.
    """
    one = segments.where(F.col("words").isNotNull()).groupBy("k1", "k2").agg(
        F.min("mark").alias("mark"), F.min("n").alias("n"), F.min("words").alias("words")
    )
    lowest = segments.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"))
    distinct = written(one.join(lowest, ["k1", "k2"]))
    row = distinct.agg(F.sum(F.col("n") + window).alias("w")).first()
    shards = max(1, math.ceil((row["w"] or 0) / SHARD_WORDS))
    hot = written(distinct.groupBy("mark").count().where(F.col("count") > HOT_SEGMENTS).select("mark"))
    usual = distinct.join(hot, "mark", "left_anti").select(
        F.pmod(F.xxhash64("mark"), F.lit(shards)).alias("shard"), "k1", "k2", F.lit(0).alias("at"), "owner", "words"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            if len(seen) > _SEEN:
                seen.clear()
            for r in batch.to_pylist():
                words = r["words"].split()
                for k in range(len(words) - window + 1):
                    line = b" ".join(words[k : k + window])
                    key = xxhash.xxh3_128_digest(line)
                    own = (int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True))
                    rows.append((r["k1"], r["k2"], k, *own, r["owner"], None if key in seen else line))
                    seen.add(key)
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k1", "k2", "at", "w1", "w2", "owner", "words"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        owners = group["owner"].to_numpy(np.int64)
        found = first_owners([bytes(w) for w in group["words"]], owners, window)
        return pd.DataFrame({"k1": group["k1"], "k2": group["k2"], "at": group["at"], "firsts": [f.tolist() for f in found]})

    def searched(lines: DataFrame) -> DataFrame:
        return lines.groupBy("shard").applyInPandas(search, "k1 bigint, k2 bigint, at int, firsts array<bigint>")

    if hot.isEmpty():
        return searched(usual)
    schema = "k1 bigint, k2 bigint, at int, w1 bigint, w2 bigint, owner bigint, words binary"
    single = written(distinct.join(hot, "mark", "left_semi").select("k1", "k2", "owner", "words").mapInArrow(cut, schema))
    # A window in many segments is one line of its shard, with its smallest document.
    lines = written(_distinct_windows(single))
    many = max(1, math.ceil(lines.count() * (window + 1) / SHARD_WORDS))
    lines = lines.select(F.pmod("w1", F.lit(many)).alias("shard"), F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.lit(0).alias("at"), "owner", "words")
    answers = searched(lines).select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "firsts")
    return searched(usual).union(single.join(answers, ["w1", "w2"]).select("k1", "k2", "at", "firsts"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, late)``: runs ``(start, n)`` of windows of ``docs`` ``(doc_id, text)`` whose words a smaller doc_id holds too."""
    found = written(_chunk_rows(docs, window, anchor))
    lowest = found.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"))
    judged = written(found.join(lowest, ["k1", "k2"]).select("doc_id", "start", "n", "k1", (F.col("doc_id") == F.col("owner")).alias("first")))
    # What follows looks at chunks in the first document that holds them: the rest repeats these window by window.
    doc = F.col("doc_id")
    mixed = F.col("k1").bitwiseXOR(doc).bitwiseXOR(F.shiftleft(doc, 26)).alias("h")
    # A chunk has several anchors, few of which are shared.
    bits = bits_for(judged.count())
    firsts = BitFilter(judged.where("first").select(mixed), "h", bits)
    several = _anchor_rows(docs, firsts, window, anchor).groupBy("mark").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = BitFilter(several.where("low < high"), "mark", bits)
    segments = written(_shared_segments(docs, firsts, shared, window, anchor))
    places = segments.select("doc_id", "start", "k1", "k2")
    owned = places.join(_searched(segments, window), ["k1", "k2"])
    at = (F.col("start") + F.col("at")).cast("int")
    runs = F.filter(
        F.transform("firsts", lambda f, i: F.when(f < doc, F.struct((at + i).alias("start"), F.lit(1).alias("n")))), lambda s: s.isNotNull()
    )
    single = owned.select("doc_id", runs.alias("late")).where(F.size("late") > 0)
    whole = judged.where(~F.col("first")).select("doc_id", F.array(F.struct("start", "n")).alias("late"))
    return single.union(whole).groupBy("doc_id").agg(F.flatten(F.collect_list("late")).alias("late"))


def covered(n_words: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which words the runs of windows cover."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
    keep: tuple[str, ...] = (), as_is: bool = False,
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` and the ``keep`` columns: each text without the words that windows of earlier documents repeat.

    Words are separated by ASCII white space.  A window is ``window``
    consecutive words of one document; it repeats if its words also start in a
    document of smaller doc_id.  Windows are judged on the input.  ``kept`` is
    the kept words with one blank between; with ``as_is``, a text that loses
    nothing stays as it is, null included.

    Chunks, cut by content, are compared first: a chunk that an earlier
    document holds repeats with all its windows, and looks no further.  In the
    others, windows with equal words have the same anchor, so they meet in one
    shard; only segments whose anchor a bit filter of the shared anchors lets through
    go there, each distinct one once.  Each shard is an FM-index, which the segments stream through.

    Null text has no words and a text shorter than the window keeps all.  Rows
    without doc_id keep all and make no other repeat.  Rows with the same doc_id
    should have the same text: a window that repeats in one of them counts for
    all.  An empty table gives no rows;
    other columns play no part.
    """
    own = [F.col(k) for k in keep]
    narrow = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *own, F.xxhash64(F.col(doc_id).cast("bigint")).alias("_h")
    )
    late = written(repeated_windows(narrow.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), window, anchor))
    losing = BitFilter(late.select(F.xxhash64("doc_id").alias("h")), "h")

    def result(part: pa.RecordBatch, runs: list[np.ndarray | None]) -> pa.RecordBatch:
        rows, texts = [], part.column("text")
        for raw, late_, given in zip(raw_texts(texts), runs, texts.is_valid().to_pylist()):
            line = single_blanks(raw)
            n = left = line.count(b" ") + 1 if line else 0
            if late_ is not None:
                start, count = late_[late_.sum(axis=1) + window - 1 <= n].T
                words = [w for w, g in zip(line.split(b" "), covered(n, start, count, window).tolist()) if not g]
                line, left = b" ".join(words), len(words)
            if as_is and n == left:
                line = raw
            rows.append((n, n - left, line.decode("utf-8") if given or not as_is else None))
        columns = list(zip(*rows)) or [()] * 3
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.record_batch(
            [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)], *[part.column(k) for k in keep]],
            names=["doc_id", "n_words", "n_removed", "kept", *keep],
        )

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            part = part.filter(pa.array(~losing.holds(part.column("_h").to_numpy())))
            yield result(part, [None] * part.num_rows)

    def may_lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(losing.holds(batch.column("_h").to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            flat = part.column("late")
            both = [None if x is None else np.stack([x.values.field(0).to_numpy(), x.values.field(1).to_numpy()], axis=1).astype(np.int64)
                    for x in (y if y.is_valid else None for y in flat)]
            yield result(part, both)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string" + "".join(f", `{k}` {narrow.schema[k].dataType.simpleString()}" for k in keep)
    # Only the texts that may lose words travel to what they lose.
    both = narrow.mapInArrow(may_lose, narrow.schema).join(late, "doc_id", "left").select("doc_id", "text", "late", *keep)
    return both.mapInArrow(cut, schema).union(narrow.mapInArrow(untouched, schema))


def op7(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
