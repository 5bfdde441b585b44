"""Toxicity by a convolutional text classifier that learns from all labelled rows.

Learners, each with its share of the rows, go over them in rounds; after every
round their networks are averaged by rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.durable import stored
from plumbline.llm.batches import give_back, joined, powers, slices, texts_of
from plumbline.llm.tables import BitFilter, bits_for

#: Rows a learner has before there is another one, and learners at most; with more rows each has more.
LEARNER_ROWS = 2048
LEARNERS = 16
#: Rounds over all rows, at most and at least; in between, as many as make about equally many steps.
ROUNDS, LEAST_ROUNDS = 20, 5
#: Rows of the table of embeddings that are added up together.
_BLOCK = 256
#: Outputs are told apart to this part of a logit when they are counted.
_LOGIT = 1024
#: Rows of embeddings a word or its beginning is hashed to.
BUCKETS = 1 << 22
_SLICE = 1 << 20
_BEGINNING = 4
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two bucket numbers for each word of all texts, and where each text's words start.

    Words are runs of letters and digits of the lower-cased text; the second
    bucket is that of the word's first bytes.
    """
    raw, starts = joined([t.lower().encode("utf-8", "replace") for t in texts])
    if not len(raw):
        return np.zeros((0, 2), np.int64), starts
    inside = _IN_WORD[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    both = []
    for stop, mark in ((end, 1), (np.minimum(end, begin + _BEGINNING), 2)):
        value = (sums[stop] - sums[begin]) * down[begin]
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * mark)
        both.append((value >> np.uint64(42)).astype(np.int64))
    return np.stack(both, axis=1), np.searchsorted(begin, starts)


@dataclass
class Network:
    """Hashed word embeddings, filters of several widths, maxima over the text, one output.

    Words from which training learned nothing have the embedding 0, so they
    cannot raise a maximum by chance.
    """

    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    size: int = 16
    seed: int = 5
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted buckets
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, 16), np.float32))  # row 0 is the unknown word

    def __post_init__(self):
        draw = np.random.default_rng(self.seed)
        self.kernel = [(draw.normal(0, 0.5, (w, self.size, self.filters))).astype(np.float32) for w in self.widths]
        self.bias = [np.zeros(self.filters, np.float32) for _ in self.widths]
        self.out = draw.normal(0, 0.5, len(self.widths) * self.filters).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.scale, self.offset = 1.0, 0.0
        self.shrunk = 1.0  # what all embeddings are to be multiplied by
        self.first = [np.zeros_like(w) for w in self.weights()]
        self.second = [np.zeros_like(w) for w in self.weights()]
        self.steps = 0.0

    def copy(self) -> Network:
        """Another one that may learn by itself."""
        out = Network.__new__(Network)
        out.__dict__.update(self.__dict__)
        for name in ("kernel", "bias", "first", "second"):
            setattr(out, name, [w.copy() for w in getattr(self, name)])
        out.out, out.shift, out.table = self.out.copy(), self.shift.copy(), self.table.copy()
        return out

    def weights(self) -> list[np.ndarray]:
        return [*self.kernel, *self.bias, self.out, self.shift]

    def rows_of(self, buckets: np.ndarray) -> np.ndarray:
        """Rows of the table; a worker looks buckets up in a flat array."""
        if not hasattr(self, "_flat"):
            self._flat = np.zeros(BUCKETS, dtype=np.int32)
            self._flat[self.known] = np.arange(1, len(self.known) + 1)
        return self._flat[buckets]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_flat"}

    def pooled(self, rows: np.ndarray, starts: np.ndarray, places: bool = False):
        """Per text the maximum of each filter, and on request where it was reached.

        Each text is followed by blanks, so that every word, and the first blank, opens a window of each width.
        """
        gap = max(self.widths)
        lengths = np.diff(starts)
        begin = starts[:-1] + gap * np.arange(len(lengths))
        slots = np.zeros((len(rows) + gap * len(lengths), 2), dtype=np.int64)
        slots[np.arange(len(rows)) + gap * np.repeat(np.arange(len(lengths)), lengths)] = rows
        words = self.table[slots[:, 0]] + self.table[slots[:, 1]]
        if self.shrunk != 1:
            words *= np.float32(self.shrunk)
        # A window that opens after the first blank would reach into the next text.
        beyond = (begin + lengths)[:, None] + np.arange(1, gap)
        tops, where = [], []
        for kernel, bias in zip(self.kernel, self.bias):
            width = len(kernel)
            value = words @ kernel[0]
            for j in range(1, width):
                value[:-j] += words[j:] @ kernel[j]
            value[beyond] = -np.inf
            top = np.maximum.reduceat(value, begin, axis=0)
            tops.append(top + bias)
            if places:
                reached = value == np.repeat(top, lengths + gap, axis=0)
                at = np.where(reached, np.arange(len(value))[:, None], len(value))
                where.append(np.minimum.reduceat(at, begin, axis=0))
        return (np.concatenate(tops, axis=1), where, slots, words) if places else np.concatenate(tops, axis=1)

    def logits(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows, starts), 0) @ self.out + self.shift[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        buckets, starts = hashed_words(texts)
        raw = self.logits(self.rows_of(buckets), starts).astype(np.float64) * self.scale + self.offset
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))

    def begin(self, known: np.ndarray) -> None:
        """Start from small embeddings of the known buckets."""
        self.known = known
        self.table = np.random.default_rng(self.seed + 1).normal(0, 0.1, (len(known) + 1, self.size)).astype(np.float32)
        self.table[0] = 0

    def step(self, texts: list[np.ndarray], labels: np.ndarray, keep: float, rate: float = 0.02, steepness: float = 3.0) -> np.ndarray:
        """Adam for the filters, plain steps for the embeddings, so that a word moves as far as it has evidence.

        All embeddings are multiplied by ``keep``.  Returns the rows of the table that moved.
        """
        weights = self.weights()
        self.steps += 1
        rows = np.concatenate(texts)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        tops, where, slots, words = self.pooled(rows, starts, places=True)
        hidden = np.maximum(tops, 0)
        chance = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift[0], -40, 40)))
        wrong = ((chance - labels) / len(labels)).astype(np.float32)
        back = wrong[:, None] * self.out * (tops > 0)
        slope_kernel, slope_bias, ids, moves = [], [], [], []
        for n, (kernel, at) in enumerate(zip(self.kernel, where)):
            own = back[:, n * self.filters : (n + 1) * self.filters]
            slope = np.zeros_like(kernel)
            for j in range(len(kernel)):
                there = at + j
                slope[j] = np.einsum("nf,nfd->df", own, words[there])
                move = own[:, :, None] * kernel[j].T[None]
                for side in (0, 1):
                    ids.append(slots[there, side].ravel()), moves.append(move.reshape(-1, self.size))
            slope_kernel.append(slope), slope_bias.append(own.sum(axis=0))
        slopes = [*slope_kernel, *slope_bias, hidden.T @ wrong, wrong.sum(keepdims=True)]
        for w, g, m, v in zip(weights, slopes, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        ids, moves = np.concatenate(ids), np.concatenate(moves)
        touched, at = np.unique(ids, return_inverse=True)
        slope = np.zeros((len(touched), self.size), np.float32)
        np.add.at(slope, at, moves)
        slope[touched == 0] = 0  # the unknown word stays
        self.table[touched] -= np.float32(steepness / self.shrunk) * slope
        self.shrunk *= keep
        if self.shrunk < 1e-4:
            self.table *= np.float32(self.shrunk)
            self.shrunk = 1.0
        return touched

    def head(self) -> np.ndarray:
        """All but the embeddings as one vector."""
        return np.concatenate([w.ravel() for w in [*self.weights(), *self.first, *self.second]]).astype(np.float64)

    def with_head(self, vector: np.ndarray) -> None:
        at = 0
        for w in [*self.weights(), *self.first, *self.second]:
            w[...] = vector[at : at + w.size].reshape(w.shape)
            at += w.size

    def settle(self) -> None:
        """What training has not held up against the decay is forgotten."""
        used = np.nonzero(np.abs(self.table[1:]).max(axis=1) > 1e-3)[0]
        self.known, self.table = self.known[used], np.concatenate([self.table[:1], self.table[1 + used]])
        self.__dict__.pop("_flat", None)

    def calibrate(self, raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Fit scale and offset of the outputs so that scores are chances; returns the scores."""
        # Smoothed targets keep the scale finite where the classes separate.
        positive, negative = weights[labels == 1].sum(), weights[labels == 0].sum()
        target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
        self.scale, self.offset = 1.0, 0.0
        for _ in range(200):
            chance = 1 / (1 + np.exp(-np.clip(raw * self.scale + self.offset, -40, 40)))
            g, h = weights * (chance - target), weights * chance * (1 - chance) + 1e-9
            slope = np.array([(g * raw).sum(), g.sum()])
            bend = np.array([[(h * raw * raw).sum(), (h * raw).sum()], [(h * raw).sum(), h.sum()]]) + 1e-6 * np.eye(2)
            move = np.linalg.solve(bend, slope)
            size = np.abs(move).max()
            move *= min(1.0, 1.0 / size) if size else 0.0
            self.scale, self.offset = self.scale - move[0], self.offset - move[1]
            if size < 1e-6:
                break
        return 1 / (1 + np.exp(-np.clip(raw * self.scale + self.offset, -40, 40)))


@dataclass
class Classifier:
    """A network, or a constant where the labels teach no difference, and a threshold per language."""

    network: Network | None
    constant: float = 0.0
    threshold: float = 0.5
    by_language: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.constant) if self.network is None else self.network.scores(texts)


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The threshold of highest weighted F1; of equal ones, that nearest 0.5."""
    order = np.argsort(-scores, kind="stable")
    s, w, y = scores[order], weights[order], labels[order]
    hits, called, there = np.cumsum(w * y), np.cumsum(w), (w * y).sum()
    last = np.append(s[1:] < s[:-1], True)
    f1 = np.where(last, 2 * hits / (called + there), -1)
    tied = np.nonzero(f1 >= f1.max() - 1e-12)[0]
    below = np.append(s, 0.0)[tied + 1]
    # Anything in (below, s] is the same rule; the middle is kept unless 0.5 lies inside.
    fits = [0.5 if low < 0.5 <= high else (low + high) / 2 for low, high in zip(below.tolist(), s[tied].tolist())]
    return min(fits, key=lambda t: abs(t - 0.5))


def _known_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic)``, once per document."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isin(0, 1))


_ROWS = "doc_id bigint, toxic int, lang string, buckets binary, learner int, spare boolean"


def _sorted_rows(docs: DataFrame, labels: DataFrame, rows: int | None, learners: int) -> DataFrame:
    """Labels and the buckets of all words of documents, dealt to learners and sorted together, each label before its document.

    A bit filter lets the labelled ids through and few others, so that no other text is shuffled.
    """
    marks = _known_labels(labels)
    if rows is not None:
        parts = [marks.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for v in (0, 1)]
        marks = parts[0].union(parts[1])
    place = F.xxhash64("doc_id").alias("place")
    wanted = BitFilter(marks.select(place), "place", bits_for(marks.count()))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = batch.filter(pa.array(wanted.holds(batch.column("place").to_numpy(zero_copy_only=False)), pa.bool_()))
            for part in slices(iter([likely]), "text", _SLICE):
                buckets, starts = hashed_words(texts_of(part.column("text")))
                lists = pa.array([buckets[a:b].astype("<i4").tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())
                yield pa.record_batch([*[part.column(c) for c in ("place", "doc_id", "lang")], lists], names=["place", "doc_id", "lang", "buckets"])

    found = narrow.where(F.col("doc_id").isNotNull()).withColumn("place", place).mapInArrow(hashed, "place bigint, doc_id bigint, lang string, buckets binary")
    both = found.withColumn("toxic", F.lit(None).cast("int")).unionByName(
        marks.select(place, "doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("buckets"), "toxic")
    ).withColumns({"learner": F.pmod("place", F.lit(learners)).cast("int"), "spare": F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0})
    return both.repartitionById(learners, F.col("learner")).sortWithinPartitions("learner", "place", "doc_id", F.col("toxic").isNull(), "lang", "buckets")


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of sorted rows that have a label, each once."""
    names = ["doc_id", "toxic", "lang", "buckets", "learner", "spare"]
    open_id, label = None, None
    for part in batches:
        taken, values = [], []
        for k, (number, toxic) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("toxic").to_pylist())):
            if toxic is not None:
                open_id, label = number, toxic
            elif number == open_id:
                taken.append(k), values.append(label)
                open_id = None  # of a repeated document the first counts
        own = part.take(pa.array(taken, pa.int64()))
        yield pa.record_batch([own.column(c) if c != "toxic" else pa.array(values, pa.int32()) for c in names], names=names)


def _training_rows(docs: DataFrame, labels: DataFrame, rows: int | None = None, learners: int = 1) -> DataFrame:
    """All labelled documents, each once, with the buckets of all their words, dealt to learners; every fourth is spare.

    ``rows`` takes so many per class only.
    """
    return _sorted_rows(docs, labels, rows, learners).mapInArrow(_labelled, _ROWS)


def _packed(raw: bytes) -> bytes:
    """Length and compressed content, the four bytes of all numbers apart."""
    planes = np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if raw else b"")


def _unpacked(packed: bytes) -> np.ndarray:
    """Two bucket numbers for each word."""
    size = int.from_bytes(packed[:8], "little")
    if not size:
        return np.zeros((0, 2), np.int32)
    planes = pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1, 2)


def _dealt(found: DataFrame, before: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """The training rows, packed and stored, so that the order within a learner is the same in all rounds.

    ``before`` makes them of the rows of ``found`` in the same worker: another
    step would be another worker for each task, and idle workers stay.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(before(batches), "buckets", _SLICE):
            lists = pa.array([_packed(b) for b in part.column("buckets").to_pylist()], pa.binary())
            yield pa.record_batch([*[part.column(c) for c in ("learner", "toxic", "lang", "spare")], lists], names=["learner", "toxic", "lang", "spare", "buckets"])

    return stored(found.mapInArrow(pack, "learner int, toxic int, lang string, spare boolean, buckets binary"))


def _known_buckets(rows: DataFrame, least: int) -> np.ndarray:
    """Buckets that ``least`` texts have; those of fewer stay unknown, or single texts would be learned by heart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, dtype=np.int32)
        for part in slices(batches, "buckets", _SLICE):
            for packed in part.column("buckets").to_pylist():
                seen[np.unique(_unpacked(packed))] += 1
        there = np.nonzero(seen)[0]
        for k in range(0, len(there), 1 << 16):
            some = there[k : k + (1 << 16)]
            yield pa.record_batch([pa.array(some.astype(np.int64)), pa.array(seen[some].astype(np.int64))], names=["bucket", "n"])

    counts = rows.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    # At most ``BUCKETS`` numbers.
    return np.sort(counts.where(F.col("n") >= least).select("bucket").toArrow().column("bucket").to_numpy())


def _learnt(network: Network, rows: DataFrame, count: int, round_: int, rounds: int, batch: int = 64, decay: float = 0.03) -> None:
    """One round: all learners start from the network, which becomes their average by rows."""
    keep = 1 - decay * (1 - round_ / rounds)  # forgetting fades as training settles
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen, held, waiting = None, 0, [], 0
        own = before = moved = draw = None
        total = 1.0

        def study() -> None:
            nonlocal total, held, waiting
            order = draw.permutation(len(held))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                moved[own.step([held[i][0] for i in some], np.array([held[i][1] for i in some], dtype=np.float32), keep)] = True
                total *= keep
            held, waiting = [], 0

        def result() -> Iterator[pa.RecordBatch]:
            at = np.nonzero(moved)[0]
            change = own.table[at] * np.float32(own.shrunk) - before[at] * np.float32(total)
            cuts = np.nonzero(np.diff(at // _BLOCK, prepend=-1))[0].tolist() + [len(at)]
            blocks = [-1, *(at[cuts[:-1]] // _BLOCK).tolist()]
            places = [b"", *[(at[a:b] % _BLOCK).astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]]
            values = [np.concatenate([own.head(), [total, own.steps]]).tobytes(), *[change[a:b].astype("<f4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]]
            n = len(blocks)
            yield pa.record_batch(
                [pa.array(blocks, pa.int32()), pa.array([learner] * n, pa.int32()), pa.array([float(seen)] * n), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
                names=["block", "learner", "weight", "places", "values"],
            )

        try:
            for part in batches:
                for number, label, packed in zip(*[part.column(c).to_pylist() for c in ("learner", "toxic", "buckets")]):
                    if number != learner:
                        if learner is not None:
                            study()
                            yield from result()
                        learner, seen, total = number, 0, 1.0
                        before = shared.value.table
                        own = shared.value.copy()
                        moved, draw = np.zeros(len(before), dtype=bool), np.random.default_rng((own.seed, round_, number))
                    held.append((own.rows_of(_unpacked(packed)), label))
                    seen, waiting = seen + 1, waiting + len(held[-1][0])
                    # So many texts wait to be mixed, or so many words.
                    if len(held) >= 16 * batch or waiting > 1 << 20:
                        study()
            if learner is not None:
                study()
                yield from result()
        finally:
            give_back()

    def added(parts: pa.Table) -> pa.Table:
        # In the order of learners, so that sums are the same in every run.
        parts = parts.sort_by("learner")
        block = parts.column("block")[0].as_py()
        out = None
        for weight, places, values in zip(*[parts.column(c).to_pylist() for c in ("weight", "places", "values")]):
            if block < 0:
                out = (0 if out is None else out) + weight * np.frombuffer(values, np.float64)
            else:
                out = np.zeros((_BLOCK, Network.size)) if out is None else out
                out[np.frombuffer(places, "<i4")] += weight * np.frombuffer(values, "<f4").reshape(-1, Network.size)
        return pa.table({"block": pa.array([block], pa.int32()), "total": pa.array([out.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "block int, learner int, weight double, places binary, values binary")
    # A row per block of the table.
    sums = parts.groupBy("block").applyInArrow(added, "block int, total binary").toArrow()
    totals = dict(zip(sums.column("block").to_pylist(), sums.column("total").to_pylist()))
    head = np.frombuffer(totals.pop(-1), np.float64) / count
    network.with_head(head[:-2])
    network.steps = head[-1]
    table = network.table * np.float32(head[-2])
    for block, total in totals.items():
        own = table[block * _BLOCK : (block + 1) * _BLOCK]
        own += (np.frombuffer(total, np.float64).reshape(_BLOCK, -1)[: len(own)] / count).astype(np.float32)
    network.table = table
    shared.destroy()


def _outputs(network: Network, rows: DataFrame) -> DataFrame:
    """``(lang, toxic, output, n)``: how many texts have an output, in parts of a logit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "buckets", _SLICE):
            texts = [_unpacked(b) for b in part.column("buckets").to_pylist()]
            raw = network.logits(network.rows_of(np.concatenate(texts)), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
            output = np.rint(np.clip(raw.astype(np.float64), -64, 64) * _LOGIT).astype(np.int32)
            yield pa.record_batch([part.column("lang"), part.column("toxic"), pa.array(output)], names=["lang", "toxic", "output"])

    return rows.mapInArrow(run, "lang string, toxic int, output int").groupBy("lang", "toxic", "output").agg(F.count(F.lit(1)).alias("n"))


def trained(docs: DataFrame, labels: DataFrame, rows: int | None = None, least: int = 20) -> Classifier:
    """A classifier from all labelled documents, or from ``rows`` of each class.

    Every fourth is kept for calibration: of the scores, and of a threshold for
    each language with ``least`` documents of each class there.  Other languages
    take the common threshold.  Null labels teach nothing; of repeated labels
    the highest counts, and of repeated documents one.
    """
    marks = _known_labels(labels).agg(F.count(F.lit(1))).first()[0]
    learners = min(LEARNERS, max(1, -(-marks // LEARNER_ROWS)))
    found = _dealt(_sorted_rows(docs, labels, rows, learners), _labelled)
    numbers = {(r["toxic"], r["spare"]): r["n"] for r in found.groupBy("toxic", "spare").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = [sum(n for (v, _), n in numbers.items() if v == value) for value in (0, 1)]
    if not min(of):
        return Classifier(None, constant=float(of[1] > 0))
    split = len(numbers) == 4
    learn, check = (found.where(~F.col("spare")), found.where("spare")) if split else (found, found)
    count = sum(n for (_, spare), n in numbers.items() if not (split and spare))
    network = Network()
    network.begin(_known_buckets(learn, least=3))
    rounds = min(ROUNDS, max(LEAST_ROUNDS, round(ROUNDS * LEARNER_ROWS * learners / max(count, 1))))
    for k in range(rounds):
        _learnt(network, learn, count, k, rounds)
    network.settle()
    # Counts by language, class and output; bounded but for the languages.
    outputs = _outputs(network, check).toArrow()
    raw = outputs.column("output").to_numpy().astype(np.float64) / _LOGIT
    y, n = outputs.column("toxic").to_numpy().astype(np.int64), outputs.column("n").to_numpy().astype(np.float64)
    tongues = np.array(outputs.column("lang").to_pylist(), dtype=object)
    scores = network.calibrate(raw, y, n)
    out = Classifier(network, threshold=best_threshold(scores, y, n))
    for name in sorted({t for t in tongues if t is not None}):
        own = tongues == name
        if min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= least:
            out.by_language[name] = best_threshold(scores[own], y[own], n[own])
    return out


def scored(docs: DataFrame, classifier: Classifier, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns of ``docs`` with ``score``; null text is the empty text.

    Texts are read whole, however long; repeated rows get equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", _SLICE):
            yield pa.record_batch([*[part.column(k) for k in keep], pa.array(classifier.scores(texts_of(part.column("_text"))))], names=[*keep, "score"])

    narrow = docs.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{kinds}score double")


def threshold_of(classifier: Classifier, lang: Column) -> Column:
    """The calibrated threshold of a language; the common one where there is none."""
    out = F.lit(classifier.threshold)
    for name, value in classifier.by_language.items():
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text is divisible by 5; not for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def taught(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier that learns from labels of documents not held out."""
    return trained(docs, labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score; ``rejected`` compares it with its language's threshold."""
    classifier = taught(docs, labels)
    found = scored(docs.select("doc_id", "lang", "text"), classifier, keep=("doc_id", "lang"))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= threshold_of(classifier, F.col("lang"))).alias("rejected"),
    )
