"""SimHash near-duplicates, joined by vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.durable import stored
from plumbline.llm.batches import joined, raw_texts, single_blanks, slices
from plumbline.llm.union import Forest, components

#: Distinct fingerprints that one shard of the tree should hold.
SHARD = 1 << 16
#: Distinct fingerprints, at most, from which vantage points and radii are chosen.
SAMPLE = 1 << 15
#: Residents of a node below which all its pairs are compared.
LEAF = 256
_BLOCK = 1 << 22


#: Bytes of text whose shingles are hashed at once, and shingles of one length at a time.
HASH_BYTES = 1 << 20
_LANES = 1 << 14
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(total: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turned(total + lane * _P2, 31) * _P1


def xxh64(whole: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """``xxhash.xxh64`` of many pieces of an array of bytes, those of a length together."""
    out, seed_ = np.empty(len(starts), dtype=np.uint64), np.uint64(seed)
    order = np.argsort(lengths, kind="stable")
    sizes, firsts = np.unique(lengths[order], return_index=True)
    # Eight and four bytes from any place on.
    padded = np.concatenate([whole, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(whole) + 1, np.dtype("<u8"), padded.data, 0, (1,))
    four = np.ndarray(len(whole) + 1, np.dtype("<u4"), padded.data, 0, (1,))
    with np.errstate(over="ignore"):
        for n, first, end in zip(sizes.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(order)]):
            for k in range(first, end, _LANES):
                rows = order[k : min(end, k + _LANES)]
                at = starts[rows]
                if n >= 32:
                    sums = [seed_ + _P1 + _P2, seed_ + _P2, seed_, seed_ - _P1]
                    for p in range(0, n - 31, 32):
                        sums = [_mixed(x, eight[at + (p + 8 * i)]) for i, x in enumerate(sums)]
                    h = sum(_turned(x, b) for x, b in zip(sums, (1, 7, 12, 18)))
                    for x in sums:
                        h = (h ^ _mixed(np.uint64(0), x)) * _P1 + _P4
                else:
                    h = np.full(len(at), seed_ + _P5)
                h, p = h + np.uint64(n), n // 32 * 32
                for p in range(p, n - 7, 8):
                    h = _turned(h ^ _mixed(np.uint64(0), eight[at + p]), 27) * _P1 + _P4
                p = n // 8 * 8
                if p + 4 <= n:
                    h = _turned(h ^ (four[at + p].astype(np.uint64) * _P1), 23) * _P2 + _P3
                for p in range(n // 4 * 4, n):
                    h = _turned(h ^ (whole[at + p].astype(np.uint64) * _P5), 11) * _P1
                h = (h ^ (h >> np.uint64(33))) * _P2
                h = (h ^ (h >> np.uint64(29))) * _P3
                out[rows] = h ^ (h >> np.uint64(32))
    return out


def all_shingles(texts: list[bytes], width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """``shingles`` of each text, those of many texts hashed at once."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > HASH_BYTES:
            yield from _together(texts[start:k], width, seed)
            start, size = k, 0
        size += len(text)
    yield from _together(texts[start:], width, seed)


def _together(texts: list[bytes], width: int, seed: int) -> Iterator[np.ndarray]:
    if not texts:
        return
    # A text is followed by a blank, so a blank ends each word; an empty text is a blank alone.
    whole, starts = joined([single_blanks(t.lower()) for t in texts])
    ends = np.flatnonzero(whole == 32)
    begins = np.concatenate([[0], ends[:-1] + 1])
    first = np.searchsorted(ends, starts)
    words = np.where(np.diff(starts) > 1, np.diff(first), 0)
    counts = np.where(words > 0, np.maximum(1, words - width + 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    last = at + np.repeat(np.minimum(width, words) - 1, counts)
    hashes = xxh64(whole, begins[at], ends[last] - begins[at], seed)
    yield from (hashes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """Hashes of all word shingles, repeats included; a text of fewer words is one shingle, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    ends = starts + lengths
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(width, len(words)) - 1 :][:n]
    return np.array([digest(line[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist())], dtype=np.uint64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included; 0 without words."""
    return majority(shingles(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        marks = np.array([majority(x) for x in all_shingles(raw_texts(part.column("text")), width, seed)], dtype=np.uint64)
        yield pa.record_batch([part.column("doc_id"), pa.array(marks.view(np.int64))], names=["doc_id", "mark"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, mark)`` per row: the fingerprint as a signed long.  Null text has no words."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(lambda batches: _fingerprints(batches, width, seed), "doc_id bigint, mark bigint")


def hamming(marks: np.ndarray, mark: np.uint64) -> np.ndarray:
    return np.bitwise_count(marks ^ mark)


class Tree:
    """The upper levels of a vantage-point tree; node k has children 2k+1 (near) and 2k+2 (far)."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.depth = depth
        self.vantage = np.zeros((1 << depth) - 1, dtype=np.uint64)
        self.radius = np.full((1 << depth) - 1, 64, dtype=np.int16)
        draw = np.random.default_rng(seed)
        groups = {0: np.sort(sample)}
        for node in range(len(self.vantage)):
            here = groups.pop(node, np.zeros(0, np.uint64))
            if len(here) > 1:
                self.vantage[node], self.radius[node] = vantage_of(here, draw)
            gap = hamming(here, self.vantage[node])
            groups[2 * node + 1], groups[2 * node + 2] = here[gap <= self.radius[node]], here[gap > self.radius[node]]

    def place(self, marks: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, shards and whether the mark lives there; otherwise it visits the shard.

        Of two marks within reach on two sides of a radius, the near one visits
        the far side, so each pair meets in the shard where one of them lives.
        """
        at = np.arange(len(marks))
        node, lives = np.zeros(len(marks), dtype=np.int64), np.ones(len(marks), dtype=bool)
        for _ in range(self.depth):
            gap, radius = np.bitwise_count(marks[at] ^ self.vantage[node]).astype(np.int16), self.radius[node]
            near = np.where(lives, gap <= radius, gap - reach <= radius)
            far = gap + reach > radius
            stays = lives & (gap > radius)  # what lives on the far side
            at, node, lives = (
                np.concatenate([at[near], at[far]]),
                np.concatenate([2 * node[near] + 1, 2 * node[far] + 2]),
                np.concatenate([lives[near], stays[far]]),
            )
        return at, node - ((1 << self.depth) - 1), lives


def vantage_of(marks: np.ndarray, draw: np.random.Generator) -> tuple[np.uint64, int]:
    """Of a few marks, the one whose distances spread most, and their median."""
    tried = marks[draw.integers(0, len(marks), 8)]
    some = marks if len(marks) <= 4096 else marks[draw.integers(0, len(marks), 4096)]
    best = max(tried, key=lambda v: float(hamming(some, v).std()))
    return best, int(np.median(hamming(some, best)))


def _brute(marks: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int, forest: Forest) -> None:
    if not len(left) or not len(right):
        return
    step, there = max(1, _BLOCK // len(right)), marks[right]
    for k in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(marks[left[k : k + step], None] ^ there[None, :]) <= reach)
        forest.link(left[k : k + step][i], right[j])


def _cross(marks, visitors, residents, reach, forest, draw, depth=0) -> None:
    """Links of visitors to residents, which are cut at vantage points while that prunes."""
    if not len(visitors) or not len(residents):
        return
    if len(residents) <= LEAF or depth > 40:
        return _brute(marks, visitors, residents, reach, forest)
    vantage, radius = vantage_of(marks[residents], draw)
    gap, mine = hamming(marks[residents], vantage), hamming(marks[visitors], vantage).astype(np.int16)
    if not 0 < (gap <= radius).sum() < len(residents):
        return _brute(marks, visitors, residents, reach, forest)
    _cross(marks, visitors[mine - reach <= radius], residents[gap <= radius], reach, forest, draw, depth + 1)
    _cross(marks, visitors[mine + reach > radius], residents[gap > radius], reach, forest, draw, depth + 1)


def _within(marks, residents, reach, forest, draw, depth=0) -> None:
    """Links among residents."""
    if len(residents) <= LEAF or depth > 40:
        return _brute(marks, residents, residents, reach, forest)
    vantage, radius = vantage_of(marks[residents], draw)
    gap = hamming(marks[residents], vantage).astype(np.int16)
    near, far = gap <= radius, gap > radius
    if not 0 < near.sum() < len(residents):
        return _brute(marks, residents, residents, reach, forest)
    _within(marks, residents[near], reach, forest, draw, depth + 1)
    _within(marks, residents[far], reach, forest, draw, depth + 1)
    _cross(marks, residents[near & (gap + reach > radius)], residents[far], reach, forest, draw)


def _placed(frames: Iterator[pd.DataFrame], tree: Tree, reach: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        marks = frame["mark"].to_numpy().view(np.uint64)
        at, shard, lives = tree.place(marks, reach)
        yield pd.DataFrame({"shard": shard, "mark": marks[at].view(np.int64), "lives": lives})


def _shard_links(frame: pd.DataFrame, reach: int) -> pd.DataFrame:
    frame = frame.sort_values(["mark", "lives"]).drop_duplicates("mark", keep="last")
    marks = frame["mark"].to_numpy().view(np.uint64)
    lives = frame["lives"].to_numpy()
    forest, draw = Forest(len(marks)), np.random.default_rng(11)
    residents, visitors = np.nonzero(lives)[0], np.nonzero(~lives)[0]
    _within(marks, residents, reach, forest, draw)
    _cross(marks, visitors, residents, reach, forest, draw)
    linked = np.nonzero(forest.root != np.arange(len(marks)))[0]
    return pd.DataFrame({"a": marks[linked].view(np.int64), "b": marks[forest.root[linked]].view(np.int64)})


def links(marks: DataFrame, reach: int = 3, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``(a, b)``: a spanning forest, shard by shard, of all pairs of distinct marks within ``reach`` bits.

    The number of shards grows with the marks.  Vantage points come from a
    bounded sample and only steer the partition; every pair is found.
    """
    count = marks.count()
    depth = max(0, math.ceil(math.log2(max(1, count / shard))))
    chosen = marks.orderBy(F.xxhash64("mark")).limit(sample).toPandas()["mark"].to_numpy(dtype=np.int64).view(np.uint64)
    tree = Tree(chosen, depth)
    placed = marks.mapInPandas(lambda frames: _placed(frames, tree, reach), "shard bigint, mark bigint, lives boolean")
    return placed.groupBy("shard").applyInPandas(lambda frame: _shard_links(frame, reach), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, reach: int = 3) -> DataFrame:
    """``(doc_id, mark, component_id)`` per row of ``docs``.

    Rows with the same fingerprint are one node; nodes link at ``reach`` or
    fewer differing bits, and ``component_id`` is the smallest doc_id of the
    connected nodes.  Null and blank texts share fingerprint 0.  Rows without
    doc_id get the component of their fingerprint, null if no row there has an
    id.  Repeated rows give repeated results; an empty table gives none; other
    columns play no part.
    """
    rows = stored(fingerprints(docs, doc_id, text, width))
    nodes = stored(rows.groupBy("mark").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes.select("mark"), reach)).withColumnsRenamed({"node": "mark"})
    known = nodes.join(roots, "mark", "left").select("mark", "low", F.coalesce("root", "mark").alias("root"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(lowest, "root").select("mark", "component_id")
    return rows.join(named, "mark").select("doc_id", "mark", "component_id")


def op10(docs: DataFrame) -> DataFrame:
    """The result with the fingerprint in hexadecimal digits."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id"
    )
