"""Collocations, embedding near-duplicates and whitening against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import collisions, collocations, whitening
from plumbline.llm.shipping import ship

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, phrase string, k int, n long, score double"
VECTORS = "vec_id long, embedding array<float>, label int, node long, n long, x string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def frame(spark, rows, schema):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def plain_collocations(rows, longest=3, least=10, inside=50, top=2000):
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        found = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * c >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in found.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def phrases():
    draw = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    fixed = ["New  York City", "red tape", "of the of", "Été à la", "x y z"]
    rows = [(None, "en"), ("", None), (" \t ", "de"), ("...", "en"), ("one-word", None), ("tick " * 3000, "fr"), ("a b c. " * 20, None)]
    for k in range(160):
        text = []
        for _ in range(draw.randint(0, 40)):
            text.append(draw.choice(words) if draw.random() < 0.8 else draw.choice(fixed))
            if draw.random() < 0.15:
                text[-1] += draw.choice([".", ",", "\n", "; ", "!?", "\t"])
        rows.append((" ".join(text), draw.choice(["en", "en", "de", None])))
    return rows + rows[20:30]


@pytest.mark.parametrize("shards, chunk", [(4, 4 << 20), (3, 60), (1, 200)])
def test_collocations(spark, monkeypatch, shards, chunk):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    rows = phrases()
    table = frame(spark, [(k, *r) for k, r in enumerate(rows)], DOCS).repartition(3)
    got = collocations.collocations(table, shards=shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows)


def test_collocations_of_longer_phrases_with_a_crowded_filter(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 8)
    monkeypatch.setattr(collocations, "MOST_BITS", 8)
    rows = phrases()
    table = frame(spark, [(k, *r) for k, r in enumerate(rows)], DOCS)
    got = collocations.collocations(table, longest=4, least=4, top=9)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 4, 4, top=9)


def test_collocations_of_nothing_and_of_documents(spark):
    assert collocations.op11(frame(spark, [], DOCS)).count() == 0
    assert collocations.op11(frame(spark, [(1, None, None), (2, "", "en")], DOCS)).count() == 0
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in table.select("text", "lang").collect()]
    assert sorted(map(tuple, collocations.op11(table).collect())) == plain_collocations(rows)


def test_a_scan_counts_what_became_active_since_the_last(spark):
    rows = [(k, "alpha beta gamma", "en") for k in range(24)]
    counts = {(r["k"], r["phrase"]): r["f"] for r in collocations.phrase_counts(frame(spark, rows, DOCS), least=10).collect()}
    assert counts == {(k, p): 24 for k, p in [
        (1, "alpha"), (1, "beta"), (1, "gamma"), (2, "alpha beta"), (2, "beta gamma"), (3, "alpha beta gamma")]}


def test_scans_pack_their_counts(spark):
    # 3,000 words and about 3,000 pairs of them, all rare but one.
    rows = [(f"w{k} w{k + 1}, often seen", "en") for k in range(3000)]
    told = spark.sparkContext.broadcast((None, collocations.Active(20, 10)))
    scan = collocations._scanned(spark.createDataFrame(rows, "text string, lang string").coalesce(1), 3, told, 10, True, 4).cache()
    # Per task a row per part of the hash, per block of buckets and per length, not one per word and pair.
    assert scan.count() <= 16 + (1 << 20 - collocations.BLOCK_BITS) + 2
    words = {r["phrase"]: r["f"] for r in collocations._summed(scan.where("k = 1")).collect()}
    assert len(words) == 3003 and words["often"] == 3000 and words["w5"] == 2
    reached = sum(int.from_bytes(r["bits"], "little").bit_count() for r in collocations._reached(scan, 10).collect())
    assert reached == 1 and collocations._firm(scan).count() == 2


def near_rows():
    draw = np.random.default_rng(8)
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(draw.normal(size=(120, 16)))]
    for k in range(40):
        at = np.array(rows[k][1])
        for _ in range(4):
            at = at + draw.normal(size=16) * np.linalg.norm(at) * 0.09
            rows.append((len(rows), at.tolist(), rows[k][2]))
    rows += [(len(rows) + k, rows[7][1], rows[7][2]) for k in range(30)]
    rows += [(900, rows[7][1], 99), (901, (np.array(rows[7][1]) * 3).tolist(), rows[7][2]), (5, rows[5][1], rows[5][2]), (None, rows[6][1], rows[6][2])]
    rows += [(910, None, 1), (911, [0.0] * 16, 1), (912, [float("nan")] * 16, 1), (913, [None] + [1.0] * 15, 1), (914, [float("inf")] * 16, 1)]
    return [*rows, (915, rows[0][1], None), (916, [], 1), (917, [1.0, 2.0], 1), (918, [2.0, 4.0], 1), (919, [-0.0] * 15 + [1.0], 2), (920, [0.0] * 15 + [1.0], 2)]


def plain_near(rows, least=0.93):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]

    def sound(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        return x if root[x] == x else top(root[x])

    units = [np.array(v) / np.linalg.norm(v) if lab is not None and sound(v) else None for _, v, lab in rows]
    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y >= least:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    lowest = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            lowest[top(k)] = min(i, lowest.get(top(k), i))
    return sorted(((i, links[k], lowest.get(top(k)), i is not None and lowest[top(k)] == i) for k, (i, *_) in enumerate(rows)), key=str)


@pytest.mark.parametrize("cell, block", [(1 << 13, 1 << 12), (1 << 13, 20), (16, 1 << 12), (16, 6)])
def test_embedding_near_duplicates(spark, cell, block):
    rows = near_rows()
    got = collisions.near_duplicates(frame(spark, rows, VECTORS), cell=cell, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_near(rows)


def test_embedding_near_duplicates_of_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, collisions.op12(table).collect()), key=str) == plain_near(rows)
    assert collisions.op12(table.where("false")).count() == 0


def test_collision_counts_reach_the_recall():
    draw, dim, n = np.random.default_rng(3), 32, 4000
    left = collisions.units(draw.normal(size=(n, dim)))
    aside = draw.normal(size=(n, dim))
    aside = collisions.units(aside - (aside * left).sum(axis=1, keepdims=True) * left)
    right = collisions.units(0.9301 * left + math.sqrt(1 - 0.9301**2) * aside)
    found = {(int(a), int(b)) for i, j in collisions.similar_pairs(left, right, False, 0.93) for a, b in zip(i, j)}
    exact = set(zip(*map(list, np.nonzero(left @ right.T >= 0.93))))
    assert found <= exact and len(found) >= 0.999 * len(exact) and len(exact) >= n
    half, least = collisions.calibrated(32, 0.93)
    apart = np.abs(left[:2000] @ collisions.directions(17, 32, dim) - left[2000:] @ collisions.directions(17, 32, dim)) <= half
    assert (apart.sum(axis=1) >= least).mean() < 0.02  # of unrelated pairs few are candidates


def test_tables_share_cells_as_often_as_the_recall_asks():
    for depth in (1, 3, 10):
        chance = (1 - math.acos(0.93) / math.pi) ** depth
        assert 1 - (1 - chance) ** collisions.tables_for(depth, 0.93) >= collisions.RECALL
    assert collisions.tables_for(0, 0.93) == 1


def plain_whitening(rows, scale=256, components=4):
    kept = []
    for i, v in rows:
        if v and all(c is not None and math.isfinite(np.float32(c)) for c in v):
            kept.append((i, [math.floor(scale * float(np.float32(c))) for c in v]))
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, dtype=float) - np.array(sums) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    out = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        white = (np.array(x, dtype=float) - np.array(sums) / n) @ axes[:, :components] / np.sqrt(e[:components])
        out[i] = n, deviation, white, e[:components] / e.sum()
    return out


def compare_whitening(got, expected, components=4):
    assert {r["vec_id"] for r in got} == set(expected)
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        n, deviation, white, explained = expected[r["vec_id"]]
        c = r["component"] - 1
        sign = signs.setdefault(c, math.copysign(1, r["whitened"] * white[c]))
        assert (r["n"], r["deviation"], int(r["deviation_decimal"])) == (n, deviation if deviation < 2**63 else None, deviation)
        assert abs(r["whitened"] - sign * white[c]) <= 1e-8 * max(1, abs(white[c])) and abs(r["explained"] / explained[c] - 1) <= 1e-9
        assert r["identity_error"] <= 1e-9
    assert len(signs) == components


def test_whitening(spark):
    draw = np.random.default_rng(6)
    spread = np.array([9, 5, 3, 2, 1, 0.5, 0.25, 0.1])
    rows = [(k, (draw.normal(size=8) * spread).tolist()) for k in range(300)]
    rows += [(300 + k, rows[3][1]) for k in range(100)]
    odd = [(500, None), (501, [float("nan")] * 8), (502, [None] + [1.0] * 7), (503, [float("inf")] * 8), (504, []), (505, [3e38] * 8)]
    expected = plain_whitening(rows)
    compare_whitening(whitening.op13(frame(spark, rows + odd, VECTORS).repartition(5)).collect(), expected)
    again = whitening.op13(frame(spark, [*rows, rows[0], (None, rows[1][1])], VECTORS)).collect()
    assert len(again) == 4 * (len(rows) + 2) and sum(r["vec_id"] == 0 for r in again) == 8 and sum(r["vec_id"] is None for r in again) == 4


def test_whitening_of_few_flat_and_empty_tables(spark):
    assert whitening.op13(frame(spark, [], VECTORS)).count() == 0
    assert whitening.op13(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).count() == 0
    # Two distinct vectors: one direction.  Other dimensions are whitened among themselves.
    rows = [(1, [1.0, 2.0, 5.0]), (2, [3.0, 2.0, 5.0]), (3, [1.0, 1.0]), (4, [2.0, 5.0]), (5, [4.0, 1.0])]
    got = whitening.op13(frame(spark, rows, VECTORS)).collect()
    one = {r["vec_id"]: r for r in got if r["vec_id"] < 3}
    assert len(got) == 2 + 3 * 2 and {abs(round(r["whitened"], 9)) for r in one.values()} == {1.0}
    assert all(r["component"] == 1 and abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-9 for r in one.values())
    compare_whitening([r for r in got if r["vec_id"] >= 3], plain_whitening(rows[2:], components=2), 2)
    # Dependent columns: a rank below the dimension.
    draw = np.random.default_rng(1)
    base = draw.normal(size=(200, 3)).round(1)
    rows = [(k, [*v, *(v * 2)]) for k, v in enumerate((base * 256).round().astype(float).tolist() and base.tolist())]
    rows = [(k, [float(x) for x in [*v[:3], *[2 * y for y in v[:3]]]]) for k, v in enumerate((np.round(base * 16) / 16).tolist())]
    got = whitening.op13(frame(spark, rows, VECTORS)).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    compare_whitening(got, plain_whitening(rows, components=3), 3)


def test_whitening_of_the_table_and_exact_deviations(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding").collect()]
    compare_whitening(whitening.op13(table).collect(), plain_whitening(rows))
    draw = random.Random(4)
    for most in (3, 10**6, 10**13, 10**18):
        x = [[draw.randint(-most, most) for _ in range(5)] for _ in range(7)]
        fit = whitening.Fit(1000, [draw.randint(-most, most) for _ in range(5)])
        assert fit.deviations(np.array(x)) == [sum((1000 * a - s) ** 2 for a, s in zip(v, fit.sums)) for v in x]
