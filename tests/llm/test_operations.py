"""The training-data operations against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import (
    batches, byte_bpe, cross_polytope, fm_index, inner_products, language_id, licences, near_copies, packing, sentence_pieces, simhash,
    substrings, tables, token_counts, toxicity,
)
from plumbline.llm.shipping import ship
from plumbline.llm.union import components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, mark long, length int"
VECTORS = "vec_id long, embedding array<float>, score long, id string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def frame(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def awkward():
    draw = random.Random(3)
    base = [" ".join(draw.choice("alpha beta gamma delta eins zwei the of".split()) for _ in range(n)) for n in (5, 40, 60)]
    return [
        (0, base[1], "en"), (1, base[1], "en"), (2, "x " + base[1] + " y", None), (3, None, "en"), (4, "", "de"),
        (5, "\t\n ", None), (6, base[2] + "\n" + base[1], "en"), (7, base[0], "de"), (7, base[0], "de"),
        (None, base[1], "en"), (8, "Été ÀÉ …", "fr"), (9, "word " * 30_000, None), (10, "123 !!", "en"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward())


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_language_id_awkward_rows(docs, none):
    rows = language_id.op1(docs).collect()
    assert len(rows) == len(awkward())
    by_id = {r["doc_id"]: r for r in rows}
    for k in (3, 4, 5, 10):
        assert (by_id[k]["lang_pred"], by_id[k]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert by_id[2]["held_out"] == (zlib.crc32(b"2") % 4 == 2) and by_id[None]["held_out"] is False
    assert language_id.op1(none).count() == 0


def test_language_id_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language_id.op1(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_trigram_vectors_against_a_plain_bundle():
    text, width = "Ab, c!", 64
    letters = language_id._letters(width)
    marks = [0, ord("a"), ord("b"), 0, ord("c"), 0]
    plain = sum(
        np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(marks, marks[1:], marks[2:])
    )
    gram, whose = language_id.trigrams(["", text, "."])
    assert set(whose.tolist()) == {1} and (language_id.bound(gram, width).sum(axis=0) == plain).all()


def test_sentence_pieces_equal_the_library(docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.DEFAULT)
    expected = sorted(
        ((d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i).encode()).hexdigest())
         for d, t, *_ in awkward() for i in [library.encode(t or "", add_eos=True)]), key=str)
    assert sorted(map(tuple, sentence_pieces.op2(docs).collect()), key=str) == expected
    assert sentence_pieces.op2(none).count() == 0
    own, draw = sentence_pieces.Pieces(sentence_pieces.DEFAULT), random.Random(5)
    for _ in range(500):
        text = "".join(draw.choice(" ▁aehinrst.é日\n2²_") for _ in range(draw.randint(0, 60)))
        assert own.encode(text) == library.encode(text, add_eos=True)


def test_byte_bpe_equals_the_tokenizers_library():
    slow = Tokenizer.from_file(byte_bpe.DEFAULT)
    slow.encode_special_tokens = True
    own = byte_bpe.byte_bpe(byte_bpe.DEFAULT)
    assert own.fast is not None
    for text in ["", "Hello's  world\n\n x", "Été 日本 🙂", "<|endoftext|>", " " * 500 + "a", "a" * 3000, "1234 5\t\r\n "]:
        assert own.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_text_are_one_id_as_in_the_library(spark):
    library, own = Tokenizer.from_file(byte_bpe.DEFAULT), byte_bpe.ByteBPE(byte_bpe.DEFAULT)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext|", "é <|ENDOFTEXT|>", ""]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [64, 220, 50256, 275]
    assert own.fast is not None and [own.ids(t).tolist() for t in texts] == expected
    own.plain = False
    assert [own.ids(t).tolist() for t in texts] == expected
    own.fast = None
    assert [own.ids(t).tolist() for t in texts] == expected
    rows = frame(spark, list(enumerate(texts)))
    lengths = {r["n_tokens"]: r["documents"] for r in token_counts.suffix_sums(token_counts.histogram(rows), span=7).collect()}
    assert lengths == {n: sum(len(e) == n for e in expected) for n in map(len, expected)}
    for r in packing.packed(rows).collect():
        ids = np.array([*expected[r["doc_id"]], 2], dtype="<u4")
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_token_counts_answer_every_limit(docs, none):
    slow = Tokenizer.from_file(byte_bpe.DEFAULT)
    lengths = [len(slow.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in awkward()]
    sums = token_counts.suffix_sums(token_counts.histogram(docs), span=7)
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r["documents"] == lengths.count(n)
        assert r["documents_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
    for r in token_counts.at_limits(sums, [0, 3, 10, 10**6]).collect():
        assert r["truncated_total"] == sum(min(x, r["context_limit"]) for x in lengths)
        assert r["documents_cut"] == sum(x > r["context_limit"] for x in lengths)
        assert r["tokens_lost"] == sum(max(0, x - r["context_limit"]) for x in lengths)
    ordered = sorted(lengths)
    for r in token_counts.quantiles(sums, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r["n_tokens"] == ordered[math.ceil(r["share"] * len(ordered) - 1e-9) - 1]
    assert token_counts.token_counts(none).count() == 0


def test_licences(spark, none):
    mit = next(t for n, f, t in licences.TEMPLATES if (n, f) == ("MIT", "text"))
    rows = [
        (1, "Hello there.\nReleased under the MIT License.\nBye"), (2, "Copyright (c) 2020 Someone\n" + mit.upper()),
        (3, "intro words here\n\n" + mit), (4, None), (5, ""), (6, "MIT"), (7, "released under the mit licence " * 2000),
        (8, "Released under the MIT License."), (8, "Released under the MIT License."),
    ]
    found = sorted((r["doc_id"], r["unit"], r["position"], r["licence"], r["form"], round(r["dice"], 6)) for r in licences.op4(frame(spark, rows)).collect())
    notice = ("MIT", "notice", 1.0)
    assert (1, "line", 1, *notice) in found and found.count((8, "line", 0, *notice)) == 2
    assert (2, "paragraph", 1, "MIT", "text", 1.0) in found and (3, "paragraph", 1, "MIT", "text", 1.0) in found
    assert not {4, 5, 6, 7} & {f[0] for f in found}
    assert licences.op4(none).count() == 0


def vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(k, [float(x) for x in draw.normal(size=8).astype(np.float32)]) for k in range(400)]
    rows += [(k, rows[0][1]) for k in range(400, 430)] + [(430, rows[5][1]), (430, rows[5][1])]
    rows += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] + [1.0] * 7), (504, [float("inf")] * 8), (None, rows[1][1]), (600, [1.0, 2.0]), (700, [])]
    return rows


def sound(rows, zero):
    kept = {}
    for k, v in rows:
        if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            kept[k] = v
    return kept


def test_nearest_neighbours(spark):
    rows = vectors(spark)
    table = frame(spark, rows, VECTORS)
    kept = sound(rows, zero=False)
    found = {}
    for r in cross_polytope.op5(table).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == {k for k in kept if k % 100 == 0} - {600}  # nothing else has its dimension
    for q, got in found.items():
        exact = sorted((math.dist(kept[q], v), k) for k, v in kept.items() if k != q and len(v) == len(kept[q]))[:10]
        got = sorted(got)
        assert [g[0] for g in got] == list(range(1, 11)) and [g[2] for g in got] == [k for _, k in exact]
        assert np.allclose([g[1] for g in got], [d for d, _ in exact])
    assert cross_polytope.op5(table.where("false")).count() == 0


def test_nearest_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    asked = ids % 100 == 0
    _, got, _ = cross_polytope.nearest(ids[asked], x[asked], ids, x, 10, least=64)
    hits = 0
    for k, (q, i) in enumerate(zip(x[asked], ids[asked])):
        far = ((x - q) ** 2).sum(axis=1)
        far[ids == i] = np.inf
        hits += len(set(ids[np.argsort(far)[:10]].tolist()) & set(got[10 * k : 10 * k + 10].tolist()))
    assert hits >= 0.9 * 10 * asked.sum()


def test_top_products_are_exact(spark):
    rows = vectors(spark)
    kept = {k: [math.floor(64 * x) for x in v] for k, v in sound(rows, zero=True).items()}
    found = {}
    for r in inner_products.op6(frame(spark, rows, VECTORS)).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (k for k in kept if k % 20 == 0):
        exact = sorted((-sum(a * b for a, b in zip(kept[q], v)), k) for k, v in kept.items() if k != q and len(v) == len(kept[q]))[:20]
        assert [g[1:] for g in sorted(found.get(q, []))] == [(k, -s) for s, k in exact]
    ids = np.arange(4)
    large = np.array([[1e15, 1.0], [1e15, 2.0], [-1e15, 0.0], [3.0, 1e300]])
    asked, got, score = inner_products.highest(ids[:1], large[:1], ids, large, 3)
    assert got.tolist()[-1] == 2 and score.max() == 2**63 - 1


def repeats(rows, window):
    first, out = {}, []
    for i, text in sorted(((i, t) for i, t, *_ in rows if i is not None), key=lambda r: r[0]):
        words = (text or "").encode().split()
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(docs, none, spark):
    assert sorted(map(tuple, substrings.op7(docs).collect()), key=str) == repeats(awkward(), 13)
    assert substrings.op7(none).count() == 0
    table = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, substrings.op7(frame(spark, table)).collect()), key=str) == repeats(table, 13)


def test_substring_dedup_cuts_hot_anchors_into_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", 2)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 256)
    draw, phrase = random.Random(8), "all rights reserved by the owner of this"
    rows = []
    for k in range(120):
        own = [draw.choice("abcdefgh") for _ in range(30)]
        rows.append((k, " ".join([*own[:15], phrase, *own[15:]])))
    rows += [(k + 200, rows[k][1]) for k in range(10)] + [(300, rows[3][1][10:80])]
    assert sorted(map(tuple, substrings.op7(frame(spark, rows)).collect()), key=str) == repeats(rows, 13)


@pytest.mark.parametrize("size", [13, 20])
def test_substring_dedup_deals_windows_of_a_common_passage_once(spark, monkeypatch, size):
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", 20)
    most, plain = spark.sparkContext.accumulator(0), substrings.first_owners
    taken = spark.sparkContext.accumulator(0)

    def counted(lines, owners, window):
        taken.add(sum(len(line.split()) == window for line in lines))
        most.add(sum(len(line.split()) == window for line in lines) - len({line for line in lines if len(line.split()) == window}))
        return plain(lines, owners, window)

    monkeypatch.setattr(substrings, "first_owners", counted)
    draw = random.Random(14)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    passage = [draw.choice(words) for _ in range(size)]
    rows = [(k, " ".join([*draw.choices(words, k=30), *passage, *draw.choices(words, k=30)])) for k in range(300)]
    assert sorted(map(tuple, substrings.op7(frame(spark, rows)).collect()), key=str) == repeats(rows, 13)
    assert taken.value and not most.value


def test_backward_search_counts_every_pattern():
    draw = np.random.default_rng(2)
    lines = [draw.integers(1, 5, n) for n in (30, 17, 5, 40)]
    symbols = np.concatenate([np.append(x, 0) for x in lines])
    index = fm_index.FMIndex(symbols, 6)
    text = symbols.tolist()
    for n in range(1, 7):
        for pattern in {tuple(text[k : k + n]) for k in range(len(text) - n + 1) if 0 not in text[k : k + n]} | {(1,) * n}:
            low, high = np.array([0]), np.array([len(text)])
            for s in reversed(pattern):
                low, high = index.extend(np.array([s]), low, high)
            assert high[0] - low[0] == sum(tuple(text[k : k + n]) == pattern for k in range(len(text)))


def toxic_rows():
    draw = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    rows, labels = [], []
    for k in range(600):
        text = [draw.choice(words) for _ in range(40)]
        if k % 4 == 0:
            text[draw.randrange(40)] = "vile" + draw.choice(["", "st", "ness"])
        rows.append((k, " ".join(text), "en" if k % 2 else None))
        labels.append((k, 1, int(k % 4 == 0)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    extra = [(1000, None, "en"), (1001, "", None), (None, "vile", "en"), (1002, rows[1][1] * 2000 + " vile " + rows[1][1], "xx"), (5, rows[5][1], "en")]
    marks = spark.createDataFrame([*labels, (1000, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.op8(frame(spark, rows + extra), marks).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.9 * len(held)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1000]["predicted"] == by_id[1001]["predicted"] == 0 and by_id[1002]["predicted"] == 1


def test_long_labelled_texts_take_part_in_training(spark):
    rows, labels = toxic_rows()
    long = [(k, " ".join([t] * 300), g) if k % 10 == 1 else (k, t, g) for k, t, g in rows]
    found = toxicity._training_rows(frame(spark, long), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 3000)
    assert found.count() == len(rows) and found.agg(F.max(F.octet_length("buckets"))).first()[0] == 300 * 40 * 8


def test_toxicity_learns_from_every_labelled_row(spark):
    rows = [(k, f"w{k % 50} v{k % 7}", "en") for k in range(8000)]
    marks = spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(8000)], "doc_id long, quality int, toxic int")
    found = toxicity._dealt(toxicity._training_rows(frame(spark, rows + rows[:50] + [(9000, 'x', 'en')]), marks, learners=4))
    assert found.count() == 8000 and found.select("learner").distinct().count() == 4
    lists = toxicity._training_rows(frame(spark, rows[:1]), marks).first()["buckets"]
    assert toxicity._unpacked(toxicity._packed(bytes(lists))).astype("<i4").tobytes() == bytes(lists)


def test_training_rows_pass_one_python_step_after_their_shuffle(spark, monkeypatch):
    rows, labels = toxic_rows()
    plans, stored = [], toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    toxicity.taught(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert plans[0].split("Exchange")[0].count("MapInArrow") == 1


def test_several_learners_agree_and_repeat(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEARNER_ROWS", 100)
    rows, labels = toxic_rows()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    runs = [{r["doc_id"]: r for r in toxicity.op8(frame(spark, rows), marks).collect()} for _ in range(2)]
    assert all(runs[0][k]["score"] == runs[1][k]["score"] for k in runs[0])
    held = [r for r in runs[0].values() if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.9 * len(held)


def test_toxicity_without_labels(docs, none, spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.op8(docs, marks).collect()} == {0.0}
    assert toxicity.op8(none, marks).count() == 0


def fewest(sizes, capacity):
    """The least number of bins, by trying."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= sizes[k] and room not in rooms[:i]:
                go(k + 1, [*rooms[:i], room - sizes[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best


def test_dominance_keeps_the_optimum():
    draw = random.Random(1)
    for _ in range(150):
        sizes = sorted((draw.randint(1, 20) for _ in range(draw.randint(1, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.reduced(counts, 20)
        left = [s for s, n in rest.items() for _ in range(n)]
        used = [s for p, n in fixed for s in p * n]
        assert sorted(used + left) == sorted(sizes) and all(sum(p) <= 20 for p, _ in fixed)
        assert sum(n for _, n in fixed) + fewest(sorted(left, reverse=True), 20) == fewest(sizes, 20)


def test_packing(docs, none):
    rows = packing.packed(docs).collect()
    slow = Tokenizer.from_file(byte_bpe.DEFAULT)
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for doc, text, *_ in awkward():
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for r in documents[doc]:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert all(r["length"] == 1024 for r in documents[doc] if r["piece"])
    assert sum(r["length"] for r in rows) == sum(len(slow.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in awkward())
    assert packing.packed(none).count() == 0


def test_the_packing_plan_starts_no_workers_of_its_own(docs):
    assert "LocalTableScan" in packing.packed(docs)._jdf.queryExecution().executedPlan().toString()


def test_workers_do_not_keep_the_tokenizer(spark, docs):
    def kept(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([byte_bpe.byte_bpe.cache_info().currsize])], names=["n"])

    many = docs.repartition(8)
    assert packing.pieces(many).count() and {r["n"] for r in many.mapInArrow(kept, "n bigint").collect()} == {0}


def test_the_tokenizers_library_is_loaded_when_needed():
    own = byte_bpe.ByteBPE(byte_bpe.DEFAULT)
    assert own.ids("plain words").tolist() == own.encode("plain words").tolist() and not {"library", "slow"} & set(vars(own))


def plain_mark(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(rows):
    marks = [plain_mark(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (marks[a] ^ marks[b]).bit_count() <= 3:
            root[top(a)] = top(b)
    lowest = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            lowest[top(k)] = min(i, lowest.get(top(k), i))
    return sorted(((r[0], f"{m:016x}", lowest.get(top(k))) for k, (r, m) in enumerate(zip(rows, marks))), key=str)


def test_simhash(docs, none, spark):
    assert sorted(map(tuple, simhash.op10(docs).collect()), key=str) == linked(awkward())
    assert simhash.op10(none).count() == 0
    table = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.op10(frame(spark, table)).collect()), key=str) == linked(table)


def test_vantage_point_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    draw = random.Random(6)
    marks = {draw.getrandbits(64) for _ in range(300)}
    for m in list(marks)[:120]:
        for _ in range(3):
            m ^= 1 << draw.randrange(64)
            marks.add(m)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    edges = simhash.links(spark.createDataFrame([(m,) for m in signed], "mark long"), shard=40)
    got = {}
    for r in components(edges).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    root = {m: m for m in marks}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(marks, 2):
        if (a ^ b).bit_count() <= 3:
            root[top(a)] = top(b)
    groups = {}
    for m in marks:
        groups.setdefault(top(m), set()).add(m - (1 << 64) if m >> 63 else m)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def jaccard_components(rows, least=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in itertools.combinations(range(len(rows)), 2):
        common, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if common >= least * whole and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return sorted((i, rows[top(k)][0]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("at_once", [8, 0])
def test_near_copies_equal_brute_force_jaccard(spark, monkeypatch, at_once):
    monkeypatch.setattr(near_copies, "AT_ONCE", at_once)
    draw, words = random.Random(12), [f"{a}{b}" for a in "bcdfgklm" for b in "aeiou"]
    passage = [draw.choice(words) for _ in range(30)]
    texts = [None, "", " \n", "One two", "one TWO", "one two three four five six"]
    for k in range(25):
        text = [draw.choice(words) for _ in range(draw.choice([12, 60, 200]))] + passage * (k % 3 == 0)
        texts += [" ".join(text)] * (1 + k % 2)
        for _ in range(6):
            text = list(text)
            for _ in range(max(1, len(text) // 60)):
                text[draw.randrange(len(text))] = draw.choice(words)
            texts.append(" ".join(text))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    expected = jaccard_components(rows)
    assert sorted(map(tuple, near_copies.near_copies(frame(spark, rows)).collect())) == expected
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), SMALL).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted({c for _, c in expected})


def test_pipeline_hands_texts_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(3000).selectExpr("id as doc_id", "'some plain words' as text", "'en' as lang", "'web' as source", "16 as n_chars").coalesce(1)
    try:
        for given, most in ((before, 1000), ("0", 1000), ("70", 70)):
            spark.conf.set(name, given)
            kept = corpus_pipeline.language_stage(spark, docs, SMALL)
            found = [r["n"] for r in kept.mapInArrow(sizes, "n bigint").collect()]
            assert sum(found) == 3000 and max(found) <= most
    finally:
        spark.conf.set(name, before)


def test_pipeline_judges_few_texts_at_once(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("x" * 1000).alias("text")).coalesce(1)
    few = corpus_pipeline._kept(docs, lambda texts, _: np.full(len(texts), sum(map(len, texts)) <= 1 << 18))
    assert few.count() == 600


def test_pipeline_stages_on_awkward_rows(spark, docs, none):
    rows, labels = docs, f"{SMALL}"
    for name, stage in corpus_pipeline.STAGES:
        before = rows.count()
        rows = stage(spark, rows, labels)
        assert stage(spark, none, labels).count() == 0
        if name != "best_fit_packing":
            assert rows.columns == list(corpus_pipeline.COLUMNS) and rows.count() <= before
        if name == "language_id":
            assert not {3, 4, 5, 10} & {r["doc_id"] for r in rows.collect()}
        if name == "simhash_near_dedup":
            ids = [r["doc_id"] for r in rows.collect()]
            assert 0 in ids and 1 not in ids and ids.count(7) == 1 and ids.count(None) == 1


def test_pipeline_removes_copies_and_passages(spark):
    rows = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    assert len({t for _, t in texts}) == len(texts)
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_stage(spark, rows, SMALL).collect()}
    for i, n, gone, digest in repeats(texts, 13):
        if gone == n and n:
            assert i not in cut
        else:
            assert hashlib.sha256(b" ".join(cut[i].encode().split())).hexdigest() == digest
    assert corpus_pipeline.run(spark, SMALL).agg(F.sum("length")).first()[0] > 0


def test_language_scores_do_not_depend_on_how_texts_are_cut(spark, docs, monkeypatch):
    profiles = language_id.taught(docs)
    texts = [r[1] or "" for r in awkward()] + ["漢字" * 50 + " ".join(chr(0x4E00 + k) for k in range(3000))]
    names, scores = profiles.predict(texts)
    monkeypatch.setattr(language_id, "MOST_KINDS", 5)
    again, cut = profiles.predict(texts)
    assert again == names and np.allclose(cut, scores, atol=1e-6)


def test_near_copies_with_awkward_rows_and_a_shingle_that_many_share(spark, none):
    draw = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    common = "this text is under a licence"
    rows = [(k, " ".join([*draw.choices(words, k=25), common, *draw.choices(words, k=25)])) for k in range(80)]
    rows += [(100 + k, f"{rows[k][1]} {draw.choice(words)}") for k in range(0, 80, 4)]
    expected = jaccard_components(rows)
    assert sorted(map(tuple, near_copies.near_copies(frame(spark, rows)).collect())) == expected
    assert sum(c < i for i, c in expected) == 20
    assert near_copies.near_copies(none).count() == 0
    odd = [(None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (6, None), (7, ""), (None, None), (8, rows[5][1] + " x")]
    found = sorted(map(tuple, near_copies.near_copies(frame(spark, odd)).collect()), key=str)
    assert found == sorted([(None, None), (None, 6), (5, 5), (5, 5), (6, 6), (7, 6), (8, 5)], key=str)


def test_parities_never_rule_out_a_similar_pair():
    draw = np.random.default_rng(5)
    for size in (1, 3, 40, 600, 5000):
        one = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
        for changed in (0, 0.05, 0.1, 0.2, 0.5, 1):
            other = np.unique(np.concatenate([one[: len(one) - int(changed * len(one))], draw.integers(0, 2**63, int(changed * len(one))).astype(np.uint64)]))
            common = len(np.intersect1d(one, other))
            similar = common >= 0.8 * (len(one) + len(other) - common)
            apart = near_copies.surely_apart(near_copies.parities(one), near_copies.parities(other), len(one) + len(other), 0.8)
            assert not (similar and apart) and (apart or size < 100 or changed < 0.2)


def test_shingles_hashed_together_equal_those_of_each_text():
    draw = random.Random(8)
    texts = [bytes(draw.choice(b"ab \t\nZ\xc3\x85\x1c") for _ in range(draw.randint(0, 30))) for _ in range(300)]
    texts += [b"x" * n + b" Y " + b"z" * (n // 3) for n in range(140)] + [b"", b" ", b"word " * 4000]
    for width in (1, 3, 5):
        words = [t.lower().split() for t in texts]
        grams = [[b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else [] for w in words]
        assert [x.tolist() for x in simhash.all_shingles(texts, width)] == [[xxhash.xxh64_intdigest(g, 42) for g in own] for own in grams]
    assert list(simhash.all_shingles([], 3)) == []


def test_near_copies_make_the_shingles_of_all_texts_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(near_copies, "_read", lambda docs, *rest, f=near_copies._read: read.append(docs) or f(docs, *rest))
    rows = [(k, f"{'same words ' * 8}{k % 5} and some more of them") for k in range(20)]
    assert sorted(map(tuple, near_copies.near_copies(frame(spark, rows)).collect())) == jaccard_components(rows)
    assert len(read) == 1 and not hasattr(near_copies, "_nodes")


def test_a_shingle_counts_as_rare_by_its_texts_whatever_their_number(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 16)
    words = [f"w{k}" for k in range(2000)]
    draw = random.Random(4)
    rows = [(k, " ".join([*draw.choices(words, k=20), *["one shared passage of words"] * (k % 10 == 0)])) for k in range(4000)]
    order = near_copies._order(frame(spark, rows), 5)
    # 400 of the texts; a sample of 16 would hold one or two of them.
    assert xxhash.xxh64_intdigest(b"one shared passage of words", 42) in order.marks.tolist()


@pytest.mark.parametrize("at_once", [1 << 40, 0])
def test_near_copies_of_a_large_group_settle_in_few_turns(spark, monkeypatch, at_once):
    turns = []
    monkeypatch.setattr(near_copies, "AT_ONCE", at_once)
    monkeypatch.setattr(near_copies, "_perhaps", lambda *x, f=near_copies._perhaps: turns.append(1) or f(*x))
    draw, words = random.Random(3), [f"{a}{b}" for a in "bcdfgklm" for b in "aeiou"]
    base, rows = [draw.choice(words) for _ in range(100)], []
    for k in range(120):
        text = list(base)
        for _ in range(1 + k % 4):
            text[draw.randrange(100)] = draw.choice(words)
        rows.append((k, " ".join(text)))
    assert sorted(map(tuple, near_copies.near_copies(frame(spark, rows)).collect())) == jaccard_components(rows)
    assert len(turns) <= 4


def test_single_blanks_equal_splitting_and_joining():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice("ab \t\n\r\x0b\x0c é") for _ in range(draw.randint(0, 40))).encode()
        assert batches.single_blanks(text) == b" ".join(text.split())


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_nearest_neighbours_recall_of_the_query_itself(spark, table):
    frame_ = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    rows = frame_.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    found = {}
    for r in cross_polytope.op5(frame_).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i, got in found.items():
        far = ((x - x[ids == i]) ** 2).sum(axis=1)
        far[ids == i] = np.inf
        hits += len(got & set(ids[np.argsort(far)[:10]].tolist()))
    assert len(found) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(found)


def test_filters_grow_with_their_entries():
    assert [tables.bits_for(n) for n in (0, 1 << 16, 1 << 20, 1 << 40)] == [20, 20, 24, 29]


def test_texts_are_encoded_once(docs):
    plan = token_counts.token_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
