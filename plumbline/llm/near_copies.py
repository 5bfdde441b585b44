"""Texts whose sets of word shingles are similar by Jaccard, all of them: SimHash first, then prefixes in order of rarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.durable import stored
from plumbline.llm.batches import raw_texts, slices
from plumbline.llm.simhash import all_shingles, links as simhash_links, majority
from plumbline.llm.tables import BitFilter, bits_for, written
from plumbline.llm.union import components

#: Texts, about, and share of all, from which frequent shingles are learned, the larger; and how many of these are sent to the tasks at most.
SAMPLE = 1 << 14
SHARE = 1 / 16
FREQUENT = 1 << 20
#: Pairs per key row below which all pairs of unlinked texts are compared at once.
AT_ONCE = 32
#: Texts of the largest group, about, with which those outside are compared in a turn.
PICKS = 8
#: Pairs whose texts are unpacked at once.
PAIRS = 256
_SEEN = 1 << 18


def _sets(part: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Shingles, set of them in order of their hashes, and 64-bit node of each text; equal sets are one node."""
    for hashes in all_shingles(raw_texts(part.column("text")), width):
        own = _set(hashes)
        yield hashes, own, _node(own)


def _set(hashes: np.ndarray) -> np.ndarray:
    own = np.sort(hashes)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _node(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def parities(own: np.ndarray) -> bytes:
    """For each of about as many bits as there are shingles, whether an odd number of them falls on it."""
    bits = 1 << max(6, (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def surely_apart(one: bytes, other: bytes, sizes: int, similarity: float) -> bool:
    """``all_apart`` of a single pair."""
    return bool(all_apart(pa.array([one], pa.binary()), pa.array([other], pa.binary()), np.array([sizes]), similarity)[0])


def all_apart(ones: pa.Array, others: pa.Array, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets of ``sizes`` shingles together are less similar for certain, pair by pair of rows of parities.

    A bit on which the parities differ takes a shingle that only one set has,
    and so many are too many from ``sizes * (1 - s) / (1 + s)`` on.  The longer
    row of bits is folded to the shorter.
    """
    widths = [pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ones, others)]
    kinds, kind = np.unique(np.stack(widths, axis=1), axis=0, return_inverse=True)
    differ = np.zeros(len(ones), dtype=np.int64)
    for k in range(len(kinds)):
        rows = np.flatnonzero(kind.reshape(-1) == k)
        x, y = (np.frombuffer(b"".join(c.take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1) for c in (ones, others))
        if x.shape[1] < y.shape[1]:
            x, y = y, x
        folded = np.bitwise_xor.reduce(x.reshape(len(rows), -1, y.shape[1]), axis=1)
        differ[rows] = np.bitwise_count(folded ^ y).sum(axis=1)
    return differ > sizes * (1 - similarity) / (1 + similarity) + 1e-9


class Order:
    """Shingles by how often a sample holds them, rare ones first, then by hash.

    Any fixed order finds all pairs; this one keeps common passages out of the
    prefixes.  The sample grows with the texts, so a shingle that counts as
    rare is in about as many texts whatever their number.
    """

    def __init__(self, marks: np.ndarray, counts: np.ndarray):
        at = np.argsort(marks)
        self.marks, self.counts = marks[at], counts[at]

    def prefix(self, own: np.ndarray, similarity: float) -> np.ndarray:
        """Sets that are similar enough have a shingle of these in common."""
        n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
        if not len(self.marks) or not len(own):
            return own[:n]
        at = np.minimum(np.searchsorted(self.marks, own), len(self.marks) - 1)
        rank = np.where(self.marks[at] == own, self.counts[at], 0)
        return own[np.argsort(rank, kind="stable")[:n]]


def _read(docs: DataFrame, width: int, order: Order, similarity: float) -> DataFrame:
    """``(doc_id, node, mark, n, bits, marks)``: all that is needed of each text, so that shingles are made once.

    ``mark`` is the SimHash over all shingles, repeats included.  Size, parities
    and prefix of the set are given where a task first meets the node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text"):
            if len(seen) > _SEEN:
                seen.clear()
            rows = []
            for hashes, own, node in _sets(part, width):
                if len(own) and node not in seen:
                    seen.add(node)
                    rows.append((node, majority(hashes), len(own), parities(own), order.prefix(own, similarity).view(np.int64)))
                else:
                    rows.append((node, majority(hashes), None, None, None))
            nodes, simhashes, sizes, bits, marks = zip(*rows)
            yield pa.record_batch(
                [
                    part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(np.array(simhashes, dtype=np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(marks, pa.list_(pa.int64())),
                ],
                names=["doc_id", "node", "mark", "n", "bits", "marks"],
            )

    return docs.mapInArrow(run, "doc_id bigint, node bigint, mark bigint, n int, bits binary, marks array<bigint>")


def _order(docs: DataFrame, width: int) -> Order:
    share = min(1.0, max(SHARE, SAMPLE / max(1, docs.count())))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            marks = np.concatenate([np.zeros(0, np.uint64), *[own for _, own, _ in _sets(part, width)]])
            yield pa.record_batch([pa.array(marks.view(np.int64))], names=["mark"])

    often = some.mapInArrow(run, "mark bigint").groupBy("mark").count().where("count > 2").orderBy(F.desc("count"), "mark").limit(FREQUENT).toArrow()
    return Order(often.column("mark").to_numpy().view(np.uint64), often.column("count").to_numpy().astype(np.int32))


def _held(sets: DataFrame) -> DataFrame:
    """``(node, n, bits, marks, places)``: size, parities and shared prefix of the texts that have such, once per node.

    The places are those in the whole prefix.
    """
    several = sets.select("node", F.explode("marks").alias("mark")).groupBy("mark").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    several = written(several.where("low < high").select("mark"))
    shared = BitFilter(several, "mark", bits_for(several.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("marks")
            marks, sizes = lists.flatten(), lists.value_lengths().to_numpy()
            held, row = shared.holds(marks.to_numpy()), np.repeat(np.arange(len(lists)), sizes)
            places = (np.arange(len(marks)) - (np.cumsum(sizes) - sizes)[row]).astype(np.int32)
            left = np.bincount(row[held], minlength=len(lists))
            ends = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            own = [pa.ListArray.from_arrays(ends, x.filter(pa.array(held))) for x in (marks, pa.array(places))]
            out = pa.record_batch([*[part.column(c) for c in ("node", "n", "bits")], *own], names=["node", "n", "bits", "marks", "places"])
            yield out.filter(pa.array(left > 0))

    found = sets.where(F.col("marks").isNotNull()).select("node", "n", "bits", "marks")
    return found.mapInArrow(run, "node bigint, n int, bits binary, marks array<bigint>, places array<int>").dropDuplicates(["node"])


class Texts:
    """The texts of a few nodes, fetched when they are compared."""

    def __init__(self, docs: DataFrame, known: DataFrame, width: int):
        # ``known`` has a row ``(node, low)`` per node, with the smallest document that bears it.
        self.docs, self.known, self.width = docs, known, width

    def of(self, nodes: DataFrame) -> DataFrame:
        """``(node, zipped)``: one text per node, compressed; only documents that may bear a node are read out."""
        # The hash of a null id finds the documents without one.
        wanted = written(nodes.join(self.known, "node").select("node", F.xxhash64("low").alias("h")))
        asked, width = BitFilter(wanted, "h", bits_for(wanted.count())), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = zstandard.ZstdCompressor(level=1)
            for batch in batches:
                some = batch.filter(pa.array(asked.holds(batch.column("h").to_numpy())))
                for part in slices(iter([some]), "text"):
                    nodes_ = pa.array([node for _, _, node in _sets(part, width)], pa.int64())
                    zipped = pa.array([codec.compress(t) for t in raw_texts(part.column("text"))], pa.binary())
                    yield pa.record_batch([part.column("h"), nodes_, zipped], names=["h", "node", "zipped"])

        own = self.docs.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "h bigint, node bigint, zipped binary")
        return own.join(wanted, ["h", "node"]).dropDuplicates(["node"]).select("node", "zipped")

    def similar(self, pairs: DataFrame, similarity: float) -> DataFrame:
        """The pairs ``(a, b)`` whose sets reach the similarity."""
        pairs, width = written(pairs), self.width
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = written(self.of(nodes))
        sides = [texts.select(F.col("node").alias(c), F.col("zipped").alias(f"text_{c}")) for c in "ab"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = zstandard.ZstdDecompressor()
            last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
            for part in (batch.slice(k, PAIRS) for batch in batches for k in range(0, batch.num_rows, PAIRS)):
                keep, ones = np.zeros(part.num_rows, dtype=bool), part.column("a").to_pylist()
                # Rows come sorted by one side, so its set is made once.
                new = [a != before for a, before in zip(ones, [last[0], *ones])]
                zipped = zip(new, part.column("text_a").to_pylist(), part.column("text_b").to_pylist())
                sets = map(_set, all_shingles([codec.decompress(t) for first, x, y in zipped for t in ((x, y) if first else (y,))], width))
                for k, a in enumerate(ones):
                    if new[k]:
                        last = (a, next(sets))
                    x, y = last[1], next(sets)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = common >= similarity * (len(x) + len(y) - common) - 1e-9
                yield part.select(["a", "b"]).filter(pa.array(keep))

        both = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(run, "a bigint, b bigint")


def _perhaps(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs that sizes and parities do not rule out."""
    sides = [held.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes = part.column("n_a").to_numpy().astype(np.int64) + part.column("n_b").to_numpy()
            keep = ~all_apart(part.column("bits_a"), part.column("bits_b"), sizes, similarity)
            yield part.select(["a", "b"]).filter(pa.array(keep))

    near = F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b") - 1e-9
    return pairs.join(sides[0], "a").join(sides[1], "b").where(near).mapInArrow(run, "a bigint, b bigint")


def _by_simhash(known: DataFrame, texts: Texts, similarity: float) -> DataFrame:
    """``(a, b)``: nodes whose SimHashes are linked in vantage-point trees and whose sets reach the similarity.

    Each node is compared with one of its group, so a large group costs no square.
    """
    marks = written(known.groupBy("mark").agg(F.min("node").alias("first")))
    roots = components(simhash_links(marks.select("mark"))).withColumnsRenamed({"node": "mark"})
    grouped = known.join(roots, "mark", "left").select("node", F.coalesce("root", "mark").alias("root"))
    first = grouped.groupBy("root").agg(F.min("node").alias("a"))
    pairs = grouped.join(first, "root").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"))
    return texts.similar(pairs, similarity)


def _enough(n: str, place: str, m: str, at: str, similarity: float) -> Column:
    """Whether sets of sizes ``n`` and ``m`` whose first common shingle has these places can be similar enough.

    They have no more in common than what either holds from there on.  A
    shingle that is not the first may rule out a similar pair, the first never does.
    """
    common = F.least(F.col(n) - F.col(place), F.col(m) - F.col(at))
    return common >= F.lit(similarity / (1 + similarity)) * (F.col(n) + F.col(m)) - 1e-6


def _links(held: DataFrame, texts: Texts, found: DataFrame, similarity: float) -> DataFrame | None:
    """``(node, root)`` of all nodes linked by pairs that reach the similarity, of which ``found`` are known.

    Texts that share a key are first compared with a few texts of the largest
    group linked so far, while that links anything; then all pairs that are
    still in different groups are compared.  So a key of many near copies
    costs no square of them, and no pair is left out.  A key whose texts are
    one group is done with, so each turn has fewer keys than the one before.
    """
    keys = held.select("node", "n", F.explode(F.arrays_zip("marks", "places")).alias("x")).select("node", "n", F.col("x.marks").alias("mark"), F.col("x.places").alias("place"))
    real = keys.groupBy("mark").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("mark")
    keys = written(keys.join(real, "mark"))
    edges = stored(found)
    total, linked, turn = keys.count(), edges.count(), 0
    roots = stored(components(edges)) if linked else None
    while total:
        if roots is None:
            members = keys.withColumn("root", F.col("node"))
        else:
            members = keys.join(roots, "node", "left").select("mark", "node", "n", "place", F.coalesce("root", "node").alias("root"))
        groups = members.groupBy("mark", "root").agg(F.count(F.lit(1)).alias("c"))
        main = groups.groupBy("mark").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("g"), F.count(F.lit(1)).alias("k"))
        main = stored(main.where("k > 1").select("mark", "g", F.col("m.c").alias("c"), F.col("m.root").alias("main")))
        open_ = main.agg(F.sum((F.col("g") - F.col("c")) * F.col("g"))).first()[0] or 0
        if not open_:
            break
        members = written(members.join(main.select("mark", "c", "main"), "mark"))
        keys = members.select("mark", "node", "n", "place")
        last = open_ <= AT_ONCE * total or (turn > 0 and not linked)
        others = members.select("mark", F.col("node").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("root").alias("apart"), "main", "c")
        if not last:
            # A hash of the node alone, so keys that share texts pick the same.
            drawn = F.pmod(F.xxhash64("other", F.lit(turn)), F.lit(1 << 20))
            others = others.where((F.col("apart") == F.col("main")) & (drawn * F.col("c") < PICKS << 20))
        rest = members.where(F.col("root") != F.col("main")).drop("main", "c").join(others.drop("main", "c"), "mark").where(F.col("root") != F.col("apart"))
        pairs = rest.where(_enough("n", "place", "m", "at", similarity)).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        new = stored(texts.similar(_perhaps(pairs, held, similarity), similarity))
        linked = new.count()
        edges = edges.union(new)
        if linked:
            roots = stored(components(edges))
        if last:
            break
        turn += 1
    return roots


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)`` per row of ``docs``: the smallest doc_id of the texts linked to it.

    Texts link if the Jaccard coefficient of their sets of ``width``-word
    shingles is ``similarity`` or more; letters A to Z count as small ones.  A
    text of fewer words is one shingle; null and blank texts have none and are
    alike.  SimHashes of the shingles, joined by vantage-point trees, find most
    links; a prefix filter then finds every other pair.  Shingles and sets are
    told apart by 64-bit hashes, and links are confirmed on the whole sets.
    Repeated rows give repeated results; an empty table gives none; other
    columns play no part.
    """
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    read = written(_read(narrow, width, _order(narrow, width), similarity))
    known = written(read.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("mark").alias("mark")))
    texts = Texts(narrow, known.select("node", "low"), width)
    found = _by_simhash(known, texts, similarity)
    roots = _links(written(_held(read)), texts, found, similarity)
    if roots is None:
        named = known.select("node", F.col("low").alias("component_id"))
    else:
        joined = known.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
        lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
        named = joined.join(lowest, "root").select("node", "component_id")
    return read.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
