"""Operators against brute force on small generated corpora."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sievelight.llm import anchors, bktree, cotraining, disclosure, graphs, licenses, mixing, tiling, toxicity, url_model

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int, n: int = 60) -> list[tuple[int, str]]:
    """Random texts that share passages, lines and near copies."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["Über", "été", "the", "the", "of"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice((20, 36, 60, 90)))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 3, 20, 80, 200)))]
        for _ in range(rng.choice((0, 0, 1, 2))):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice((" ", "\n", "  ")).join(words)))
    rows += [(n + j, rows[j][1]) for j in range(5)]
    rows += [(n + 10 + j, rows[j][1] + " tail") for j in range(5, 12)]
    return rows


@pytest.mark.parametrize("piece", [200, 4 << 20])
def test_anchors(spark, monkeypatch, piece):
    monkeypatch.setattr(anchors, "PIECE", piece)
    rows = corpus(1)
    words = {i: WORD.findall(t) for i, t in rows}
    seen = Counter(tuple(w[a : a + 35]) for w in words.values() for a in range(len(w) - 34))
    want = {}
    for i, w in words.items():
        gone = {a + d for a in range(len(w) - 34) if seen[tuple(w[a : a + 35])] > 1 for d in range(35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in anchors.repeated_windows(df).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 0


def _fingerprint(text: str) -> int:
    w = WORD.findall(text.translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("limit", [1, 1024])
def test_bktree(spark, monkeypatch, limit):
    monkeypatch.setattr(bktree, "SHARD_LIMIT", limit)
    rows = corpus(2)
    fps = {i: _fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}
    for _ in fps:  # relax until stable
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    got = bktree.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("hex", bktree.fingerprint_hex("fp")).collect()
    assert {r["doc_id"]: r["hex"] for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == root


def test_bktree_finds_all_within_radius():
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(5)]
    values = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centre for _ in range(40)]
    tree = bktree.BKTree(values)
    for v in values[:50]:
        assert set(tree.within(v, 4)) == {u for u in values if (u ^ v).bit_count() <= 4}


def test_bktree_prunes():
    """Probes look at a part of the tree only."""
    rng = random.Random(13)
    values = [rng.getrandbits(52) for _ in range(1000)]
    tree = bktree.BKTree(values)
    for v in values:
        tree.within(v, 4)
    assert tree.visited < 0.75 * len(values) * len(tree.values)
    tree.visited = 0
    for v in values:
        tree.within(v, 0)
    assert tree.visited < 0.05 * len(values) * len(tree.values)


@pytest.mark.parametrize("limits", [(1024, 128, 20_000), (4, 128, 20_000), (4, 128, 30), (4, 4, 0), (2, 0, 0)])
def test_bktree_links_of_every_path(spark, monkeypatch, limits):
    """Plain shards, broadcast trees, finer shards and shuffled trees connect the same fingerprints."""
    for name, value in zip(("SHARD_LIMIT", "SHARD_TARGET", "BROADCAST_NODES"), limits, strict=True):
        monkeypatch.setattr(bktree, name, value)
    rng = random.Random(14)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(140):  # chains of near values, which crowd their shards
        values.append(values[rng.randrange(len(values))] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    root = {v: v for v in values}
    for _ in values:
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    found = bktree.links(spark.createDataFrame([(v,) for v in signed], "fp long"), picked=bktree.picked_blocks(len(values), 4, limits[1]))
    got = {v: v for v in values}
    pairs = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    for _ in values:
        for a, b in pairs:
            got[a] = got[b] = min(got[a], got[b])
    assert got == root and len(set(root.values())) < len(values)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 501)]
    got = {r["node"]: r["root"] for r in graphs.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(200)}, 500: 500, 501: 500}


def test_license_base(spark):
    rng = random.Random(4)
    parts = ["under the MIT license", "Apache License, Version 2", "CC BY-NC", "under the mit", "license cc by", "word", "Version 2"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for i in range(80)]
    phrases = [(label, p.split()) for label, p in licenses.PHRASES]
    want = {}
    for i, t in rows:
        w = ALNUM.findall(t.translate(LOWER))
        places = [(a, label) for label, p in phrases for a in range(len(w) - len(p) + 1) if w[a : a + len(p)] == p]
        starts = [a for a, _ in places]
        want[i] = (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_license_span_with_an_inserted_word(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a full copy of this software and associated documentation files"
    row = licenses.scan(spark.createDataFrame([(1, "x y z " + notice)], "doc_id long, text string")).first()
    assert row["labels"] == "mit" and row["n_base"] == 0 and row["score"] >= 0.8


def _tiles(a: list[str], b: list[str], k: int) -> int:
    """Words covered by greedy tiling, by scanning all pairs of places."""
    ma, mb, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ma and j + n not in mb:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return total
        ma |= set(range(i, i + n))
        mb |= set(range(j, j + n))
        total += n


def test_tiling(spark):
    rng = random.Random(5)
    items = [(i, " ".join("v%d" % rng.randrange(25) for _ in range(30))) for i in range(4)]
    docs = []
    for i in range(24):
        w = items[i % 4][1].split()
        cut = rng.randrange(31)
        w = w[cut:] + ["z"] * rng.randrange(4) + w[: cut - rng.randrange(12)]
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: r for r in tiling.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in docs:
        share = {k: _tiles(x.split(), t.split(), 5) / 30 for k, x in items}
        assert got[i]["max_coverage"] == pytest.approx(max(share.values()), abs=1e-6)
        assert got[i]["item_ids"] == sorted(k for k, s in share.items() if s >= 0.5)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _ok(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_pii_base(spark):
    rng = random.Random(6)
    bits = ["a.b@c.de", "x@y", "@", "_f@g.h-i", "10.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "+49 1", "é😀", "word", ".", " ", "-", "\n"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(("", " ", " ", "\n")) for _ in range(rng.randrange(14)))) for i in range(150)]
    got = {r["doc_id"]: r for r in disclosure.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, t) if _ok(k, m[0])]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and got[i]["spans"].startswith(joined)
        assert [got[i][f"n_{k}"] for k in PII] == [sum(s[0] == k for s in spans) for k in PII]


def test_terms_that_disclose(spark):
    """A term found only near one address is protected there; a common one is not."""
    rows = [(i, f"Contact our zanzibar office at secret@corp.org today please {i}") for i in range(3)] + [(10 + i, f"our office opens today please come {i}") for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in disclosure.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[0][1]
    assert f"term:{text.index('zanzibar')}:{text.index('zanzibar') + 8}" in got[0]
    assert f"term:{text.index('office')}:" not in got[0] and got[10] == ""
    clean = disclosure.sanitize(spark.createDataFrame(rows[:3], "doc_id long, text string")).first()["text"]
    assert "secret@corp.org" not in clean and "<EMAIL>" in clean


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", None]), rng.randrange(1, 200)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 200 for s in sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values())) and all(target[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    assert all(r["source_size"] == sizes[r["source"]] for r in got)


def mixed_by_hand(rows: list[tuple[int, str | None, int]], rank: dict[int, int]) -> tuple[dict[int, int], dict]:
    """Words taken by document, and targets: quotas shared out by rounds, then a walk in the order of seeded ranks."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, t, n in rows if t == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while True:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: share * weight[s] for s in open_}
    taken = {}
    for s in names:
        copies, run = int(target[s] // sizes[s]), 0
        rest = target[s] - copies * sizes[s]
        for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (rank[r[0]] >> 52, rank[r[0]] - (1 << 64) if rank[r[0]] >> 63 else rank[r[0]], r[0])):
            taken[i] = min(3, copies + (run < rest)) * n
            run += n
    return taken, target


def test_mixing_selection(spark):
    """Every document's copies."""
    rng = random.Random(15)
    rows = [(i, rng.choices(["a", "b", "c", "d", None], (60, 20, 3, 1, 8))[0], rng.randrange(0, 90)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    rank = {r["doc_id"]: r["r"] & (2**64 - 1) for r in df.selectExpr("doc_id", "xxhash64(17, doc_id, size) AS r").collect()}
    want, target = mixed_by_hand(rows, rank)
    got = {r["doc_id"]: r for r in mixing.mix_sources(df).collect()}
    assert {i: r["taken"] for i, r in got.items()} == want
    assert all(got[i]["target"] == pytest.approx(target[s]) for i, s, _ in rows)


def test_mixing_with_membership(spark):
    """Overlapping sources on Spark: rows without a source stay, and shared documents fill the source that lacks its own."""
    rows = [(i, ["a"], 1) for i in range(100)] + [(200 + i, ["b", "a"], 1) for i in range(50)] + [(300 + i, ["b"], 1) for i in range(10)] + [(400, [], 5), (401, None, 5), (402, ["z"], 7), (403, [None], 2)]
    df = spark.createDataFrame(rows, "doc_id long, m array<string>, size long")
    got = {r["doc_id"]: r for r in mixing.mix_sources(df, membership="m").collect()}
    assert len(got) == len(rows)
    assert all(got[i]["taken"] == 0 and got[i]["target"] is None for i in (400, 401))
    sizes = {"a": 150, "b": 60, "z": 7, None: 2}
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10, ("z",): 7, (None,): 2}
    weight, left, open_, target = {"a": 1, "b": 2, "z": 3, None: 1}, 219.0, set(sizes), {}
    while True:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: share * weight[s] for s in open_}
    scale = min(1.0, sum(patterns.values()) / sum(target.values()))
    drawn = mixing.route(patterns, {s: t * scale for s, t in target.items()})
    taken = {p: sum(r["taken"] for r in got.values() if r["m"] and tuple(sorted(r["m"], key=lambda s: (s is None, s or ""))) == p) for p in patterns}
    cost = lambda flow: sum(c * min(patterns[p], max(0, n - c * patterns[p])) for p, n in flow.items() for c in range(3))
    assert all(taken[p] <= 3 * patterns[p] for p in patterns)
    assert sum(taken.values()) == pytest.approx(sum(drawn.values()), abs=8) and cost(taken) == pytest.approx(cost(drawn), abs=16)
    assert sum(taken[p] for p in patterns if "a" in p or "b" in p) == pytest.approx(sum(target[s] * scale for s in "ab"), abs=3)


def test_mixing_of_overlapping_sources():
    """Words that two sources share are routed to the one that lacks its own; no copy is taken while fresh words are left."""
    drawn = mixing.route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 100.0, "b": 60.0})
    assert drawn == {("a",): pytest.approx(100.0), ("a", "b"): pytest.approx(50.0), ("b",): pytest.approx(10.0)}


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    stems, rows, labels = ["ba", "ko", "li", "mu", "ten", "ra", "so"], [], []
    for i in range(900):
        words = ["".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), "grumvex" + rng.choice(stems))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r["predicted"], labels[r["doc_id"]][1]) for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert len(held) > 200 and sum(p == y for p, y in held) / len(held) > 0.97


def test_cotraining_held_out(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(700):
        good = rng.random() < 0.6
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + ("" if good else rng.choice(["", "###", "%%%"])) for _ in range(rng.randrange(30, 90))]
        rows.append((i, " ".join(words), "en", rng.choice(["s1", "s2"]) if good else rng.choice(["s2", "s3"])))
        if i % 3:
            labels.append((i, int(good)))
    truth = dict(labels)
    got = cotraining.score_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [(int(r["kept"]), truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.95


def test_url_model_scores(spark):
    """Scores against interpolation written out over dictionaries."""
    rng = random.Random(10)
    urls = [f"http://{h}/{rng.choice(['fr', 'de', 'en'])}/{rng.randrange(99)}" for h in ("a.org", "x.com", "y.com", "z.net") for _ in range(30)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_model.judge_urls(pages).collect()}
    fold = {r["url"]: r["f"] for r in pages.selectExpr("url", "pmod(xxhash64(url), 5) = 0 AS f").distinct().collect()}
    rule = {r["url"]: r["rule_verdict"] for r in url_model.apply_rules(url_model.url_parts(pages)).collect()}
    order = url_model.ORDER
    counts = {v: [defaultdict(Counter) for _ in range(order + 1)] for v in ("allow", "block")}
    for u in set(urls):
        if rule[u] and not fold[u]:
            padded = url_model.START * order + u.translate(LOWER)
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    counts[rule[u]][k][padded[i - k : i]][padded[i]] += 1

    def score(u: str) -> float:
        padded, total = url_model.START * order + u.translate(LOWER), 0.0
        for i in range(order, len(padded)):
            p = {}
            for v, tables in counts.items():
                q = 1 / url_model.ALPHABET
                for k in range(order + 1):
                    c = tables[k].get(padded[i - k : i])
                    if c:
                        q = (c[padded[i]] + len(c) * q) / (sum(c.values()) + len(c))
                p[v] = q
            total += math.log2(p["allow"]) - math.log2(p["block"])
        return total / len(u)

    for i, u in enumerate(urls):
        assert got[i]["score"] == pytest.approx(score(u), abs=1e-6)
    # The threshold of 400 bins over [-4, 4] that lets most accepted and least rejected URLs of the fold pass.
    bins = {u: min(max(math.floor((score(u) + 4) * 50), 0), 399) for u in set(urls)}
    held = [(bins[u], rule[u]) for u in urls if fold[u] and rule[u]]
    size = Counter(v for _, v in held)
    best = (-1.0, -1.0, 0.0)
    for b in {x for x, _ in held}:
        lost, kept_out = (sum(v == c and x < b for x, v in held) / size[c] for c in ("allow", "block"))
        best = max(best, (1 - lost + kept_out, -abs(b - 200), b / 50 - 4))
    for i, u in enumerate(urls):
        if abs(score(u) - best[2]) > 1e-6:
            assert got[i]["verdict"] == (rule[u] or ("allow" if score(u) >= best[2] else "block"))


def test_toxicity_against_plain_code(spark, monkeypatch):
    """Counts, ratios, features, fit and scores written out over dictionaries and dense rows."""
    monkeypatch.setattr(toxicity, "FEATURES", 60)
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(["Tree", "river", "stone", "élan"] + ["vile", "nasty"] * (i % 4 == 0)) for _ in range(rng.randrange(0, 12)))) for i in range(120)] + [(500, None)]
    labels = [(i, int(i % 4 == 0)) for i in range(110)]
    mask = (1 << 64) - 1

    def buckets(text):
        points, out = [ord(c) for c in f" {text.lower()} "], set()
        for n in toxicity.SIZES:
            for i in range(len(points) - n + 1):
                h = 0
                for c in points[i : i + n]:
                    h = (h * 0x100000001B3 + c * 0x9E3779B97F4A7C15) & mask
                x = (h + n) & mask
                x ^= x >> 30
                x = x * 0xBF58476D1CE4E5B9 & mask
                x ^= x >> 27
                x = x * 0x94D049BB133111EB & mask
                out.add((x ^ x >> 31) & (toxicity.BUCKETS - 1))
        return out

    held = {i: buckets(t or "") for i, t in rows}
    taught = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    n = [sum(y == c for _, y in taught) for c in (0, 1)]
    count = [Counter(b for i, y in taught if y == c for b in held[i]) for c in (0, 1)]
    ratio = {b: math.log((count[1][b] + 1) / (n[1] + 2)) - math.log((count[0][b] + 1) / (n[0] + 2)) for b in count[0] | count[1]}
    support = {b: abs(r) / math.sqrt(1 / (count[1][b] + 1) + 1 / (count[0][b] + 1)) for b, r in ratio.items()}
    best = sorted(ratio, key=lambda b: (-round(support[b], 12), b))[:60]
    dense = {i: np.array([ratio[b] * (b in held[i]) for b in best]) for i, _ in rows}
    x, y = np.array([dense[i] for i, _ in taught]), np.array([float(c) for _, c in taught])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b, m, v, mb, vb = np.zeros(60), 0.0, np.zeros(60), np.zeros(60), 0.0, 0.0
    for t in range(1, 301):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        gw, gb = x.T @ g + toxicity.PENALTY * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.03 / math.sqrt(1 + t / 50)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for i, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(dense[i] @ w + b))), abs=1e-3)


def test_cotraining_against_plain_code(spark, monkeypatch):
    """Rounds, pseudo-labels, calibration and combination over dense rows of one array."""
    monkeypatch.setattr(cotraining, "HANDED", 10)
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(320):
        good = rng.random() < 0.5
        words = [rng.choice(["alpha", "beta", "gamma"] + ["delta"] * good + ["%%", "#x"] * (not good)) for _ in range(rng.randrange(8, 40))]
        rows.append((i, " ".join(words), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2"]) if good else rng.choice(["s2", "s3"])))
        if i % 3 == 0:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in cotraining.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    table = cotraining.described(docs).orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
    keys = table.column("key").to_pylist()
    widths = (cotraining.WORDS + cotraining.SHAPES, cotraining.META)
    views = []
    for sparse, width in zip((cotraining.text_view(table.column("text")), cotraining.metadata_view(table)), widths, strict=True):
        x = np.zeros((len(rows), width))
        np.add.at(x, (sparse.rows, sparse.slots), sparse.values.astype(np.float16).astype(float))
        views.append(x)

    def fit(x, y, start=None, balanced=True, rounds=200, penalty=1e-4):
        w, b = (np.zeros(x.shape[1]), 0.0) if start is None else (start[0].copy(), start[1])
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) if balanced else 1 / len(y)
        for t in range(1, rounds + 1):
            g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * share
            gw, gb = x.T @ g + penalty * w, g.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
            b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-7)
        return w, b

    truth = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    held = sorted(i for i in truth if zlib.crc32(f"c{i}".encode()) % 4 == 0)
    base = sorted(i for i in truth if i not in held)
    models = [fit(x[base], np.array([float(truth[i]) for i in base])) for x in views]
    told = [{}, {}]
    for _ in range(cotraining.ROUNDS):
        margins = [np.round(x @ w + b, 9) for x, (w, b) in zip(views, models, strict=True)]
        given = [{}, {}]
        for me in (0, 1):
            for label in (0, 1):
                sign = 1 if label else -1
                free = [i for i in range(len(rows)) if i not in truth and i not in told[1 - me] and sign * margins[me][i] > 0]
                given[1 - me] |= dict.fromkeys(sorted(free, key=lambda i: (-abs(margins[me][i]), keys[i]))[:10], label)
        for mine, more in zip(told, given, strict=True):
            mine |= more
        models = [fit(np.concatenate([x[base], x[list(t)]]), np.array([float(truth[i]) for i in base] + [float(c) for c in t.values()]), start, rounds=60) for x, t, start in zip(views, told, models, strict=True)]
    y = np.array([float(truth[i]) for i in held])
    odds = []
    for x, (w, b) in zip(views, models, strict=True):
        z = x @ w + b
        (slope,), shift = fit(z[held][:, None], y, balanced=False, rounds=600)
        odds.append(slope * z + shift)
    both = np.stack(odds, axis=1)
    w, b = fit(both[held], y, (np.array([0.5, 0.5]), 0.0), balanced=False, rounds=600)
    for name, z in (("text_score", odds[0]), ("metadata_score", odds[1]), ("score", both @ w + b)):
        for i in range(len(rows)):
            assert got[i][name] == pytest.approx(1 / (1 + math.exp(-z[i])), abs=0.02), name


def test_license_labels(spark):
    """Labels and scores by diagonals written out over word triples."""
    rng = random.Random(19)
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 4)):
            notice = rng.choice([t for _, t in licenses.TEMPLATES + licenses.PHRASES]).split()
            for _ in range(rng.choice((0, 0, 1, 2, 4))):  # words dropped, put in or changed
                at = rng.randrange(len(notice))
                notice[at : at + rng.randrange(2)] = rng.choice(([], ["x"], ["y", "z"]))
            words += notice + ["gap"] * rng.randrange(4)
        rows.append((i, " ".join(words)))

    def triples(text):
        w = ALNUM.findall(text.translate(LOWER))
        return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]

    known = [(label, triples(t), True) for label, t in licenses.PHRASES] + [(label, triples(t), False) for label, t in licenses.TEMPLATES]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        held, labels, best = triples(text), set(), 0.0
        for label, template, base in known:
            votes = defaultdict(set)
            for d, gram in enumerate(held):
                for at, other in enumerate(template):
                    if gram == other:
                        votes[d - at].add(at)
            groups, last = [], None
            for diagonal in sorted(votes):
                if last is None or diagonal - last > licenses.SLACK:
                    groups.append([])
                groups[-1].append(votes[diagonal])
                last = diagonal
            for group in groups:
                share = len(set.union(*group)) / len(template)
                if any(len(v) == len(template) for v in group) if base else share >= licenses.COVERAGE:
                    labels.add(label)
                    best = max(best, share)
        assert got[i]["labels"] == ",".join(sorted(labels)) and got[i]["score"] == pytest.approx(best, abs=1e-6)
