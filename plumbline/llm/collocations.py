"""Phrase collocations by dynamic itemset counting over cyclic scans of shards."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.durable import ensure_checkpoint_dir
from plumbline.llm.batches import raw_texts, slices
from plumbline.llm.tables import BitFilter, written

#: Shards of the corpus; phrases are activated between two of them.
SHARDS = 4
#: Bytes of text counted at once, about; longer texts are cut at the marks that end a piece.
CHUNK_BYTES = 4 << 20
#: Rows of counts, and buckets of pairs, that a task holds before it passes them on.
HELD_ROWS = 1 << 20
HELD_PAIRS = 1 << 22
#: The filter of active phrases has a bit per so many bytes of text, the pairs of words are counted in as many buckets,
#: within these powers of two.  Both decide the cost only.
BYTES_A_BIT = 16
LEAST_BITS, MOST_BITS = 16, 28
#: Buckets that are packed together, and bytes of text per part of the phrases, parts within these powers of two; cost only.
BLOCK_BITS = 16
BYTES_A_PART = 4 << 20
LEAST_PARTS, MOST_PARTS = 4, 12
#: What ends a piece, and what ends a word within one.
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_BLANKS = b" \t"
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(_BLANKS)], _KIND[list(_BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def longer(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but the last word and of the last word."""
    h = (first ^ (first >> np.uint64(31))) * _ODD + last
    return (h ^ (h >> np.uint64(29))) * _ODD


def _chunks(texts: list[bytes]) -> Iterator[bytes]:
    """Texts one after the other, cut where a piece ends."""
    for text in texts if sum(map(len, texts)) > CHUNK_BYTES else [b"\n".join(texts)]:
        start = 0
        while len(text) - start > CHUNK_BYTES:
            stop = start + CHUNK_BYTES
            while stop < len(text):
                ends = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, min(CHUNK_BYTES, len(text) - stop), stop)] == 2)
                if len(ends):
                    stop += int(ends[0])
                    break
                stop = min(len(text), stop + CHUNK_BYTES)
            yield text[start:stop]
            start = stop
        yield text[start:]


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the words of a text, of their pieces, and the distinct words."""
    raw = np.frombuffer(text, dtype=np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin] if len(begin) else begin
    offsets = np.zeros(len(begin) + 1, dtype=np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    array = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), piece, coded.dictionary


class Active:
    """Which phrases are active: marks of those that have reached the threshold, and buckets of pairs that may.

    Both only ever gain bits, so what was active stays so.
    """

    def __init__(self, bits: int, least: int):
        self.bits, self.least, self.turn = bits, least, 0
        self.marks = BitFilter.of(bits)
        self.buckets = np.zeros(1 << (bits - 6), dtype=np.uint64)

    def bucket_of(self, marks: np.ndarray) -> np.ndarray:
        return (marks >> np.uint64(64 - self.bits)).astype(np.int64)

    def may_reach(self, marks: np.ndarray) -> np.ndarray:
        """Pairs whose bucket has reached the threshold."""
        at = self.bucket_of(marks)
        return (self.buckets[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def with_more(self, marks: DataFrame | None, buckets: DataFrame | None) -> Active:
        """With the bits of the hashes ``h`` and of the blocks ``(b, bits)`` of buckets set too; the same object if it has them all."""
        out = Active(self.bits, self.least)
        out.turn, out.marks.words, out.buckets = self.turn + 1, self.marks.words, self.buckets
        if marks is not None:
            out.marks = BitFilter(marks, "h", self.bits)
            out.marks.words |= self.marks.words
        if buckets is not None:
            # At most 2**(bits - BLOCK_BITS) rows of 2**BLOCK_BITS bits.
            found = buckets.toArrow()
            out.buckets = self.buckets.copy()
            for block, words in zip(found.column("b").to_pylist(), found.column("bits").to_pylist()):
                start = block << BLOCK_BITS - 6
                some = out.buckets[start : start + (1 << BLOCK_BITS - 6)]
                some |= np.frombuffer(words, "<u8")[: len(some)]
        same = (out.marks.words == self.marks.words).all() and (out.buckets == self.buckets).all()
        return self if same else out


def _grams(lang: str, text: bytes, longest: int, old: Active | None, new: Active, single: bool) -> Iterator[tuple[int, pa.Array | None, np.ndarray, np.ndarray]]:
    """Length, phrases, counts and hashes of what is active by ``new`` and was not by ``old``.

    A longer phrase is active if its first and last subphrases are active and
    have reached the threshold, and a pair if its bucket has, too.  Single words
    are always active; ``single`` asks for them and for the buckets of all
    pairs, which come as length 0 with buckets for hashes.
    """
    ids, piece, vocabulary = _words(text)
    if not len(ids):
        return
    hashes = word_hashes(lang, vocabulary.to_pylist())
    if single:
        yield 1, vocabulary, np.bincount(ids, minlength=len(vocabulary)), hashes
    size = len(vocabulary)
    # Per position: the number of the phrase that starts there, or -1.
    phrase, names, marks = ids.astype(np.int64), vocabulary, hashes
    now = new.marks.holds(hashes)
    then = old.marks.holds(hashes) if old is not None else np.zeros(size, dtype=bool)
    for length in range(2, longest + 1):
        n = len(ids) - length + 1
        if n <= 0:
            return
        first, rest = phrase[:n], phrase[1 : n + 1]
        at = np.flatnonzero((first >= 0) & (rest >= 0) & (piece[:n] == piece[length - 1 :]))
        if length > 2 or not single:
            at = at[now[first[at]] & now[rest[at]]]
        if not len(at):
            return
        key, where, inverse, counts = np.unique(first[at] * size + ids[at + length - 1], return_index=True, return_inverse=True, return_counts=True)
        left, right, last = first[at[where]], rest[at[where]], ids[at[where] + length - 1]
        own = longer(marks[left], hashes[last])
        is_now, counted = now[left] & now[right], then[left] & then[right]
        if length == 2:
            if single:
                yield 0, None, counts, new.bucket_of(own)
            is_now &= new.may_reach(own)
            if old is not None:
                counted &= old.may_reach(own)
        fresh = np.flatnonzero(is_now & ~counted)
        texts = None
        if length < longest:
            # The phrases that are active, numbered anew.
            some = np.flatnonzero(is_now)
            number = np.full(len(key), -1, dtype=np.int64)
            number[some] = np.arange(len(some))
            texts = pc.binary_join_element_wise(names.take(pa.array(left[some])), vocabulary.take(pa.array(last[some])), " ")
            if len(fresh):
                yield length, texts.take(pa.array(number[fresh])), counts[fresh], own[fresh]
            phrase = np.full(len(ids), -1, dtype=np.int64)
            phrase[at] = number[inverse]
            names, marks, counted = texts, own[some], counted[some]
            now = new.marks.holds(marks)
            then = counted & old.marks.holds(marks) if old is not None else np.zeros(len(marks), dtype=bool)
        elif len(fresh):
            yield length, pc.binary_join_element_wise(names.take(pa.array(left[fresh])), vocabulary.take(pa.array(last[fresh])), " "), counts[fresh], own[fresh]


_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())])
_PACKED = "k int, b int, packed binary"


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueezed(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _added(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row per phrase."""
    rows = pa.Table.from_batches(held).group_by(["lang", "k", "phrase"], use_threads=False).aggregate([("h", "min"), ("c", "sum")])
    return rows.select(["lang", "k", "phrase", "h_min", "c_sum"]).rename_columns(["lang", "k", "phrase", "h", "c"]).combine_chunks().to_batches()[0]


def _packed_phrases(rows: pa.RecordBatch, parts: int, least: int, longest: int) -> pa.RecordBatch:
    """Counts by length and part of the hash; as part -1 the hashes of shorter phrases that reach the threshold here."""
    k, c = rows.column("k").to_numpy(), rows.column("c").to_numpy()
    h = rows.column("h").to_numpy().view(np.uint64)
    key = k.astype(np.int64) << 32 | (h >> np.uint64(64 - parts)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    ordered = rows.select(["lang", "phrase", "c"]).take(pa.array(order))
    keys, cuts = np.unique(key[order], return_index=True)
    out = [(int(x) >> 32, int(x) & 0xFFFFFFFF, ordered.slice(a, b - a).serialize().to_pybytes()) for x, a, b in zip(keys, cuts, [*cuts[1:], len(order)])]
    out += [(n, -1, h[(k == n) & (c >= least)].astype("<u8").tobytes()) for n in range(1, longest)]
    return _packed_rows(out)


def _packed_buckets(held: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in order, once each, with counts up to the threshold."""
    buckets = np.concatenate([x for x, _ in held])
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    start = np.flatnonzero(np.diff(buckets, prepend=-1))
    counts = np.add.reduceat(np.concatenate([x for _, x in held])[order].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    return buckets[start], np.minimum(counts, least)


def _bucket_rows(buckets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Blocks of buckets as length 0: high bytes, low bytes and counts one after the other."""
    blocks, cuts = np.unique(buckets >> BLOCK_BITS, return_index=True)
    out = []
    for block, a, b in zip(blocks.tolist(), cuts, [*cuts[1:], len(buckets)]):
        place = buckets[a:b] & (1 << BLOCK_BITS) - 1
        out.append((0, block, (place >> 8).astype(np.uint8).tobytes() + place.astype(np.uint8).tobytes() + counts[a:b].astype("<u4").tobytes()))
    return _packed_rows(out)


def _packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([k for k, _, _ in rows], pa.int32()), pa.array([b for _, b, _ in rows], pa.int32()), pa.array([_squeezed(x) for _, _, x in rows], pa.binary())],
        names=["k", "b", "packed"],
    )


def _scanned(docs: DataFrame, longest: int, told: Broadcast, least: int, single: bool, parts: int) -> DataFrame:
    """``(k, b, packed)``: what one scan of a shard adds to the counts, added up per task and packed by parts.

    ``told`` is what was active when the shard was scanned before, and what is now.
    """

    def row_batch(lang: str, k: int, phrases: pa.Array, counts: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        n = len(counts)
        return pa.record_batch(
            [pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, k, np.int32)), phrases,
             pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "k", "phrase", "h", "c"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = told.value
        held: list[pa.RecordBatch] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        rows = some = 0
        for part in slices(batches, "text", CHUNK_BYTES):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), raw_texts(part.column("text"))):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for chunk in _chunks(texts):
                    for k, phrases, counts, hashes in _grams(lang, chunk, longest, old, new, single):
                        if k:
                            held.append(row_batch(lang, k, phrases, counts, hashes))
                            rows += len(counts)
                        else:
                            pairs.append((hashes, counts))
                            some += len(counts)
                    if rows > HELD_ROWS:
                        held = [_added(held)]
                        rows = held[0].num_rows
                        if rows > HELD_ROWS // 2:
                            yield _packed_phrases(held[0], parts, least, longest)
                            held, rows = [], 0
                    if some > HELD_PAIRS:
                        pairs = [_packed_buckets(pairs, least)]
                        some = len(pairs[0][0])
                        if some > HELD_PAIRS // 2:
                            yield _bucket_rows(*pairs[0])
                            pairs, some = [], 0
        if held:
            yield _packed_phrases(_added(held), parts, least, longest)
        if pairs:
            yield _bucket_rows(*_packed_buckets(pairs, least))

    return docs.mapInArrow(run, _PACKED)


def _summed(counts: DataFrame, least: int = 1) -> DataFrame:
    """``(lang, k, phrase, f)``: packed counts added up, those of ``least`` or more."""

    def run(blocks: pa.Table) -> pa.Table:
        held: list[pa.Table] = []
        rows = 0

        def total() -> pa.Table:
            added = pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("c", "sum")])
            return added.select(["lang", "phrase", "c_sum"]).rename_columns(["lang", "phrase", "c"])

        for packed in blocks.column("packed"):
            held.append(pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(_unsqueezed(packed.as_py())), _COUNTED)]))
            rows += held[-1].num_rows
            if rows > 2 * HELD_ROWS:
                held, rows = [total()], 0
        added = total()
        added = added.filter(pc.greater_equal(added.column("c"), least))
        k = pa.array(np.full(added.num_rows, blocks.column("k")[0].as_py(), np.int32))
        return pa.table({"lang": added.column("lang"), "k": k, "phrase": added.column("phrase"), "f": added.column("c")})

    return counts.where("k > 0 and b >= 0").groupBy("k", "b").applyInArrow(run, "lang string, k int, phrase string, f bigint")


def _reached(counts: DataFrame, least: int) -> DataFrame:
    """``(b, bits)``: per block which buckets of pairs reach the threshold."""

    def run(blocks: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
        for packed in blocks.column("packed"):
            raw = np.frombuffer(_unsqueezed(packed.as_py()), np.uint8)
            n = len(raw) // 6
            total[raw[:n].astype(np.int64) << 8 | raw[n : 2 * n]] += raw[2 * n :].view("<u4")
        bits = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.table({"b": blocks.column("b").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    return counts.where("k = 0").groupBy("b").applyInArrow(run, "b int, bits binary")


def _firm(counts: DataFrame) -> DataFrame:
    """``(h)``: the hashes of phrases that a single task has shown to reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                yield pa.record_batch([pa.array(np.frombuffer(_unsqueezed(packed), "<i8"))], names=["h"])

    return counts.where("k > 0 and b < 0").select("packed").mapInArrow(run, "h bigint")


def _hashed(phrases: DataFrame) -> DataFrame:
    """``(h)``: the hashes by which tasks know the phrases ``(lang, phrase)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.uint64)]
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                own = word_hashes(lang, text.split(" "))
                mark = own[:1]
                for k in range(1, len(own)):
                    mark = longer(mark, own[k : k + 1])
                out.append(mark)
            yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64))], names=["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h bigint")


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, shards: int = SHARDS) -> DataFrame:
    """``(lang, k, phrase, f)``: complete counts of all words, and of all phrases of 2 to ``longest`` words found ``least`` times or more.

    The corpus is dealt into shards that are scanned in turn, again and again.
    After each scan the phrases that have surely reached the threshold activate
    the phrases that are one word longer; a scan counts what is active and was
    not when the same shard was scanned before.  So each phrase is counted once
    in each shard, whenever it became active.  When every shard has been scanned
    since the counts of one length were complete, those of the next are: they
    are added up, and the phrases that reach the threshold only over many tasks
    become active as well.

    The first scans also count all pairs of words by buckets, so that pairs whose
    bucket never reaches the threshold, nearly all rare ones, are not written
    out.  Between two scans longer phrases count by single tasks; the rest is
    added up once.  Each task packs its counts by parts of the hash, compressed,
    so files and shuffles hold a row per task and part; parts are added up whole.

    What is active is told to the tasks by bits that are only ever gained.  A
    chance hit makes a phrase active that need not be; it is then counted like
    the others.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/phrases-{uuid.uuid4().hex}"
    docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
    ).write.partitionBy("shard").option("compression", "zstd").parquet(f"{folder}/texts")
    texts = spark.read.schema("lang string, text string, shard int").parquet(f"{folder}/texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    active = Active(min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / BYTES_A_BIT))))), least)
    parts = min(MOST_PARTS, max(LEAST_PARTS, math.ceil(math.log2(max(1, size / BYTES_A_PART)))))
    schema = f"{_PACKED}, step int"
    seen: dict[int, Active] = {}
    totals: list[DataFrame] = []
    step = needed = 0

    while len(totals) < longest:
        shard = step % shards
        if seen.get(shard) is not active:
            rows = texts.where(F.col("shard") == shard).select("lang", "text")
            told = spark.sparkContext.broadcast((seen.get(shard), active))
            scanned = _scanned(rows, longest, told, least, shard not in seen, parts)
            scanned.write.option("compression", "uncompressed").parquet(f"{folder}/counts/step={step}")
            # Its copies on the disks of driver and executors go, too.
            told.destroy()
            seen[shard] = active
            counts = spark.read.schema(schema).parquet(f"{folder}/counts")
            # The last cycle activates nothing more.
            if len(totals) < longest - 1:
                # What this scan alone shows to have reached the threshold.
                marks = _firm(counts.where(F.col("step") == step))
                if step < shards - 1:
                    marks = marks.union(_hashed(_summed(counts.where("k = 1"), least)))
                active = active.with_more(marks, _reached(counts, least) if step < shards else None)
        step += 1
        # Every shard has been scanned since the counts of the length before were complete.
        if len(seen) == shards and all(f.turn >= needed for f in seen.values()):
            k = len(totals) + 1
            totals.append(written(_summed(counts.where(F.col("k") == k), 1 if k == 1 else least)))
            if k < longest:
                active = active.with_more(_hashed(totals[-1].where(F.col("f") >= least)), None)
                needed = active.turn
    return reduce(DataFrame.unionByName, totals)


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, inside: int = 50, top: int | None = 2000, shards: int = SHARDS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: phrases whose words go together, best first, per language.

    Letters A to Z count as small ones.  Texts end pieces at ``.,;:!?`` and
    ASCII line ends, pieces are words between blanks and tabs.  A candidate has
    2 to ``longest`` words and a count ``a`` of ``least`` or more; it is cut in
    two where ``floor(1000000 a a / (l r))`` is lowest, first cut if equal.
    Candidates that occur inside a longer one ``inside`` percent of the time or
    more are dropped.  ``n`` is the number of words of the language.

    Null lang is ``und``, null text has no words.  Repeated rows count as often
    as they occur; ties in score and count go by the bytes of the phrase; an
    empty table gives no rows; other columns play no part.  ``top`` None returns
    all.  Counts up to 10**14 are exact.
    """
    counts = phrase_counts(docs, lang, text, longest, least, shards)
    total = counts.where("k = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    often = counts.where(F.col("f") >= least)
    words = F.split("phrase", " ")
    candidates = often.where("k >= 2").withColumnRenamed("f", "a")

    def joined(first, count):
        return F.array_join(F.slice(words, first, count), " ")

    cut = candidates.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")).select(
        "lang", "phrase", "k", "a", "at", joined(1, F.col("at")).alias("first"), joined(F.col("at") + 1, F.col("k") - F.col("at")).alias("rest")
    )
    parts = (
        cut.join(often.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(often.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    )
    # Products of 14, 14 and 7 digits stay within 38.
    exact = F.expr("(cast(a as decimal(14,0)) * cast(a as decimal(14,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))")
    scored = parts.withColumn("score", exact.cast("bigint")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("low"))
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda start: F.array_join(F.slice(words, start, size), " ")),
    ))
    within = candidates.where("k > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    own = scored.join(within, ["lang", "phrase"], "left").where(~F.coalesce(F.col("f") * 100 >= F.col("a") * inside, F.lit(False)))
    rows = own.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # A language may hold most phrases: parts of it are cut to the best first.
        salt = F.pmod(F.xxhash64("phrase"), F.lit(256))
        rows = rows.withColumn("_salt", salt).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
        rows = rows.where(F.col("_place") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    ranked = rows.withColumn("rank", place)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(docs: DataFrame) -> DataFrame:
    """Phrases of two and three words, ten times or more, the best 2000 of each language."""
    return collocations(docs)


def sql() -> str:
    return """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces
        ), g AS (
            SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase
            FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(ws) >= k
        ), f AS (
            SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase
        ), total AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
        ), c AS (
            SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 10
        ), cuts AS (
            SELECT lang, k, phrase, a, ws, cut, array_to_string(ws[1:cut], ' ') AS x, array_to_string(ws[cut + 1:k], ' ') AS y
            FROM c, (VALUES (1), (2)) t(cut) WHERE cut < k
        ), scored AS (
            SELECT cuts.*, l.f AS l, r.f AS r,
                   CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
            FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), inner_ AS (
            SELECT lang, phrase, max(a) AS a FROM (
                SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3
                UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, phrase
        )
        SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, o.a DESC, o.phrase) AS rank,
               o.phrase, o.a, l, r, n, score
        FROM lowest o JOIN total ON total.lang = o.lang LEFT JOIN inner_ i ON i.lang = o.lang AND i.phrase = o.phrase
        WHERE NOT coalesce(100 * i.a >= 50 * o.a, false) QUALIFY rank <= 2000
    """
