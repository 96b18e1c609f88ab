"""Periodic runs, token counts and hard negatives against brute force, the library and plain code."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import multi_index, queries, runs, token_counts

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(w) // 3 + 1):
        same = np.array([x == y for x, y in zip(w, w[p:], strict=False)])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + p >= max(24, 3 * p):
                found.setdefault((a, b + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def test_catcher_online():
    """Any cut of the stream into appends gives the runs of the whole stream."""
    rng = random.Random(3)
    total = 0
    for _ in range(150):
        k, w = rng.choice((1, 2, 3, 30)), []
        for _ in range(rng.randrange(1, 8)):
            p = [rng.randrange(k) for _ in range(rng.choice((1, 2, 3, 5, 7, 8, 9, 13, 16, 17, 31, 40)))]
            w += (p * rng.randrange(1, 12))[: rng.randrange(1, 200)]
        want = brute_runs(w)
        total += len(want)
        for step in (len(w), 1, rng.randrange(2, 60)):
            catcher = runs.SquareCatcher()
            for at in range(0, len(w), step):
                catcher.append(np.array(w[at : at + step], np.int64))
            assert catcher.found() == want
    assert total > 100


def test_square_is_caught_while_the_stream_runs():
    """Runs are known as soon as they are long enough, and grow with later words."""
    catcher = runs.SquareCatcher()
    catcher.append(np.arange(100) + 10)
    for i in range(60):
        catcher.append(np.array([i % 9]))
        want = [(100, i + 1, 9)] if i + 1 >= 27 else []
        assert catcher.found() == want


@needs_data
def test_runs_of_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in queries.op11_runs(spark, DATA).collect()}
    planted = 0
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        found = brute_runs(w)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert len(got) == len(rows) and planted > 5


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a " * 30), (5, "x y z " * 8), (5, "x y z " * 8), (None, "q r " * 12 + "end"), (6, "é😀 " * 24 + "é"),
    (7, "alpha beta gamma delta epsilon " * 20_000), (8, "w" * 100_000), (9, "<|endoftext|> it's <|startoftext|>x <|ENDOFTEXT|> Ⅷ ½ 日本語 é"),
]


def test_runs_defined_cases(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "n_words", "_words", "_a", "_p", "period", "start", "_order")})
    rows = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.detect(docs).collect()]
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    assert by[1] == by[2] == by[3] == [(0, [], "")]
    assert by[4] == [(30, [(0, 30, 1)], "a")] and by[5] == [(24, [(0, 24, 3)], "x y z")] * 2
    assert by[None] == [(25, [(0, 24, 2)], "q r end")] and by[6] == [(25, [(0, 24, 1)], "é😀 é")]
    assert by[7] == [(100_000, [(0, 100_000, 5)], "alpha beta gamma delta epsilon")] and by[8][0][1] == []
    shown = runs.digest(runs.detect(runs.plant(docs))).collect()
    assert len(shown) == len(ODD) and [r["n_runs"] for r in shown if r["doc_id"] == 1] == [0]
    assert runs.digest(runs.detect(runs.plant(docs.limit(0)))).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_path())
    rows = ODD + ([(100 + i, t) for i, (t,) in enumerate(duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall())] if os.path.isdir(DATA) else [])
    rng = random.Random(2)
    letters = "abcABCéÉßΣςİıﬁ中日한각가́̈ \t\n\r\x0b\x0c\x85 　'sStTlLdD09½²٣,.!?<|>_—😀‍﻿\x7f"
    rows += [(10_000 + i, "".join(rng.choice(letters) if rng.random() < 0.9 else rng.choice(("<|endoftext|>", "ing", "'re", "the", "<|endo")) for _ in range(rng.randrange(50)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_bytes", "n_tokens", "over_limit")})
    got = sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=str)
    n = [len(e.ids) for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == sorted(((i, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n, strict=True)), key=str)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_merges_in_rank_order():
    """Each pop is the lowest rank of all adjacent pairs, the leftmost of equals."""
    merger = token_counts.PairMerger(token_counts.default_path())
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("aeinst") for _ in range(rng.randrange(1, 40)))
        symbols = [merger._symbols[s] for s in [*word[:-1], word[-1] + "</w>"]]
        while ranked := [(*merger._merges[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merger._merges]:
            rank = min(r[0] for r in ranked)
            made, i = next(r[1:] for r in ranked if r[0] == rank)
            symbols[i : i + 2] = [made]
        assert merger.word(word) == len(symbols)


def brute_negatives(rows: list, positives: int, negatives: int) -> list[tuple]:
    usable = []
    for k, (i, v, y) in enumerate(rows):
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((k, i, [math.floor(256 * x) for x in v], y))
    out = []
    first = lambda hits, n: sorted(hits, key=lambda h: (-h[0], h[1] is None, h[1] or 0))[:n]
    for k, i, v, y in usable:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m, z) for m, j, w, z in usable]
        for ps, p, _, _ in first([h for h in scored if h[3] == y and h[2] != k], positives):
            kept = first([h for h in scored if h[3] != y and 30 * ps <= 100 * h[0] <= 90 * ps], negatives)
            out += [(i, p, r + 1, j, ps, s) for r, (s, j, _, _) in enumerate(kept)]
    return sorted(out, key=str)


def vectors(seed: int, n: int, dims: int) -> list:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + 0.4 * rng.normal(size=dims) if i % 3 else centres[0]  # a third of all rows is one vector
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.choice([0, 1, 2, 9], p=[0.5, 0.3, 0.195, 0.005]))))
    rows += [(None, rows[5][1], 0), (100, rows[7][1], 1), (100, rows[7][1], 1), (200, rows[200][1], rows[200][2])]
    rows += [(n + 1, None, 1), (n + 2, rows[4][1], None), (n + 3, [None] * dims, 1), (n + 4, [math.nan] * dims, 1), (n + 5, [math.inf] * dims, 1), (n + 6, [0.5], 1)]
    return rows


@pytest.mark.parametrize(("n", "dims", "small"), [(1200, 12, True), (900, 7, False), (700, 1, True)])
def test_hard_negatives(spark, monkeypatch, n, dims, small):
    if small:  # several rounds, buckets, chunks of one cell and blocks of anchors
        for name, value in (("FIRST_ROWS", 16), ("MORE", 4), ("BUCKET", 64), ("BLOCK", 5), ("CELL_ROWS", 8), ("FIT_ROWS", 200)):
            monkeypatch.setattr(multi_index, name, value)
    rows = vectors(n, n, dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("row", "x", "cell", "score", "bucket", "anchor")})
    found = multi_index.mine(df.repartition(5), F.col("vec_id") % 100 == 0)
    got = sorted(map(tuple, found.collect()), key=str)
    want = brute_negatives([r for r in rows if not (r[1] and len(r[1]) != dims and dims > 1)], 5, 10)
    assert got == want and len(want) > 15


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert multi_index.mine(df, F.col("vec_id") % 100 == 0).count() == 0
    assert multi_index.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_visits_fall_and_stop():
    """Bounds fall from visit to visit, hold for every row, and the stop spares cells."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.floor(256 * (centres[rng.integers(40, size=4000)] + 0.05 * rng.normal(size=(4000, 16))))
    cells = multi_index.Cells(multi_index._fit(x[:, :8], 16), multi_index._fit(x[:, 8:], 16))
    (c1, d1), (c2, d2) = multi_index._nearest(x[:, :8], cells.codes[0]), multi_index._nearest(x[:, 8:], cells.codes[1])
    cell = c1 * len(cells.codes[1]) + c2
    cells.count([{"cell": int(c), "n": int((cell == c).sum()), "d1": float(d1[cell == c].max()), "d2": float(d2[cell == c].max())} for c in np.unique(cell)])
    seen = 0
    for q in x[:50]:
        score = x @ q
        visits = list(cells.visits(q, -math.inf, math.inf, len(x)))
        assert [b for _, b in visits] == sorted((b for _, b in visits), reverse=True) and len(visits) == len(np.unique(cell))
        assert all(score[cell == c].max() <= b + multi_index.SLACK for c, b in visits)
        fifth = np.sort(score)[-5]
        near = [c for c, _ in cells.visits(q, fifth, math.inf, len(x))]
        assert set(np.flatnonzero(score >= fifth)) <= set(np.flatnonzero(np.isin(cell, near)))
        seen += np.isin(cell, near).sum()
        low = [c for c, _ in cells.visits(q, -math.inf, fifth / 2, len(x))]
        assert set(np.flatnonzero(score <= fifth / 2)) <= set(np.flatnonzero(np.isin(cell, low)))
    assert seen < 0.4 * 50 * len(x)
