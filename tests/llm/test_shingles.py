"""The near-copy stage against brute force over all pairs."""

from __future__ import annotations

import random
import re
import time

import pytest

from sievelight.llm import shingles, store


def _grams(text: str | None) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_all_pairs_of_four_fifths(spark):
    """Copies with edits spread over them, far beyond 4 bits of SimHash, leave one document; looser ones stay."""
    rng = random.Random(11)
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((30, 80, 200)))]
        rows.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.choice((0.01, 0.02, 0.03, 0.06))))):
                copy[at] = f"v{rng.randrange(4000)}"
            rows.append(" ".join(copy))
    rows += [rows[0].upper(), "a b", "A  b", "a c", "", None, " "]
    rng.shuffle(rows)
    sets, parent = [_grams(t) for t in rows], list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((parent[a], parent[b]))
                parent = [x if p == y else p for p in parent]
    got = shingles.deduplicate(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(parent))
    assert len(got) < len(rows)


@pytest.mark.parametrize("best", [0, 2])
def test_large_groups(spark, monkeypatch, best):
    """A large group of near copies, cut into blocks: exactly as by all pairs, whichever go first."""
    monkeypatch.setattr(shingles, "BLOCK", 64)
    monkeypatch.setattr(shingles, "BEST", best)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(300):
        copy = list(words)
        for at in rng.sample(range(200), rng.choice((0, 1, 2, 3))):
            copy[at] = f"v{rng.randrange(9000)}"
        rows.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [f"{passage} " + " ".join(f"u{rng.randrange(90000)}" for _ in range(100)) for _ in range(60)]
    sets, parent = [_grams(t) for t in rows], list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((parent[a], parent[b]))
                parent = [x if p == y else p for p in parent]
    got = {r["doc_id"] for r in shingles.deduplicate(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == set(parent)


def test_bounds_lose_no_pair(spark):
    """Pairs right at and around the similarity, of sizes at class edges: the bounds keep every similar one."""
    rng = random.Random(13)
    rows = []
    for n in (1, 2, 3, 4, 5, 9, 16, 44, 45, 90, 135):
        base = [f"w{n}_{i}" for i in range(n + 4)]
        rows.append(" ".join(base))
        for more in {0, 1, n // 8, n // 4, n // 4 + 1}:
            rows.append(" ".join([*base, *(f"e{rng.randrange(10**9)}" for _ in range(more))]))
    rows = list(dict.fromkeys(rows))
    grams = [_grams(t) for t in rows]
    docs = spark.createDataFrame(list(enumerate(rows)), "key long, text string")
    held = range(len(rows))
    shared, sets = shingles.shared_prefixes(docs), shingles.described(docs)
    roots = spark.createDataFrame([], "node long, root long")
    got = {(r["a"], r["b"]) for r in shingles.remaining(shared, sets, roots).collect()}
    want = {(a, b) for b in held for a in held if a < b and 9 * len(grams[a] & grams[b]) >= 4 * (len(grams[a]) + len(grams[b]))}
    assert want and want <= got


def test_pairs_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """Near copies beyond 4 bits of SimHash, all in one group: few pairs across components are left for the join, and the result is that of the join alone."""
    rng = random.Random(14)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(400):
        copy = list(words)
        for at in rng.sample(range(150), rng.choice((1, 2, 3))):
            copy[at] = f"v{rng.randrange(9000)}"
        rows.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    left, remaining = [], shingles.remaining
    monkeypatch.setattr(shingles, "remaining", lambda *tables: left.append(remaining(*tables).count()) or remaining(*tables))
    got = sorted(r["doc_id"] for r in shingles.deduplicate(docs).collect())
    monkeypatch.setattr(shingles, "LOTS", 0)
    assert got == sorted(r["doc_id"] for r in shingles.deduplicate(docs).collect())
    assert left[0] <= len(rows) < left[1], left


@pytest.mark.parametrize("most", [0, 200_000])
def test_sets_travel_only_where_pairs_need_them(spark, monkeypatch, most):
    """Few pairs are broadcast to the sets, many meet them by a shuffle: the same similar ones, as by all pairs."""
    monkeypatch.setattr(shingles, "BROADCAST_NEEDS", most)
    words = [f"w{i}" for i in range(60)]
    rows = [" ".join([*words[: 60 - i], *(f"v{i}_{j}" for j in range(i))]) for i in range(12)] + [f"alone {i}" for i in range(300)]
    grams = [_grams(t) for t in rows]
    sets = store.materialize(shingles.described(spark.createDataFrame(list(enumerate(rows)), "key long, text string")))
    pairs = spark.createDataFrame([(a, b) for b in range(14) for a in range(b)], "a long, b long")
    dealt, inputs = store.materialize, []
    monkeypatch.setattr(shingles, "materialize", lambda df: inputs.append(df) or dealt(df))
    got = {(r["a"], r["b"]) for r in shingles.similar(pairs, sets).collect()}
    assert got == {(a, b) for b in range(14) for a in range(b) if 9 * len(grams[a] & grams[b]) >= 4 * (len(grams[a]) + len(grams[b]))}
    assert ("ResolvedHint (strategy=broadcast)" in inputs[-1]._jdf.queryExecution().analyzed().toString()) == bool(most)


def test_shuffle_files_of_a_table_go_with_its_write(spark):
    """Tables follow each other without gathering shuffle files on the disks; the session's setting stays as it was."""
    found = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before, tables = found(), []
    for given in (None, "false"):
        if given:
            spark.conf.set(store.CLEANUP, given)
        tables.append(store.materialize(spark.range(5000).repartition(4, "id").groupBy("id").count()))
        assert spark.conf.get(store.CLEANUP, None) == given
    spark.conf.unset(store.CLEANUP)
    end = time.time() + 10
    while found() - before and time.time() < end:
        time.sleep(0.2)
    assert not found() - before
    assert [t.count() for t in tables] == [5000, 5000]
