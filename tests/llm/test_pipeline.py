"""The whole pipeline against its stages done by hand."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from sievelight.llm import toxicity
from tests.llm.test_brute_force import PII, WORD, _ok, _tiles, mixed_by_hand
from tests.llm.test_shingles import _grams


def test_run(spark, tmp_path):
    rng = random.Random(18)
    vocabulary = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(f"b{rng.randrange(500)}" for _ in range(30))) for i in range(3)]
    rows: list[tuple] = []

    def add(words):
        text = " ".join(words)
        rows.append((len(rows), text, "en", rng.choice(["s1", "s1", "s2", None]), len(text)))

    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))]
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "grumvexish")
        if i % 11 == 1:
            words[5:5] = items[i % 3][1].split()
        if i % 7 == 2:
            words.insert(3, f"user{i}@host{i}.org")
            words.insert(9, f"10.0.{i}.7")
        add(words)
        if i % 6 == 3:  # a copy, a near copy and one too far away
            add(words)
            add(words[:-1] + ["changed"])
            add(["other" if k % 6 == 0 else w for k, w in enumerate(words)])
    labels = [(r[0], 1, int("grumvexish" in r[1])) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    scores = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    left = [r for r in rows if not scores[r[0]]]
    assert all(("grumvexish" in r[1]) == bool(scores[r[0]]) for r in rows)
    sets, root = [_grams(r[1]) for r in left], list(range(len(left)))
    for b in range(len(left)):
        for a in range(b):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((root[a], root[b]))
                root = [x if p == y else p for p in root]
    left = [left[i] for i in sorted(set(root))]
    clean = [r for r in left if all(_tiles(t.split(), r[1].split(), 5) < 15 for _, t in items)]
    assert len(rows) > len(left) > len(clean) > 50
    hidden = []
    for i, text, lang, source, n in clean:
        spans = sorted((m.start(), m.end(), k) for k, p in PII.items() for m in re.finditer(p, text) if _ok(k, m[0]))
        for start, end, kind in reversed(spans):
            text = f"{text[:start]}<{kind.upper()}>{text[end:]}"
        hidden.append((i, text, lang, source, n))
    sized = [(i, source, len(WORD.findall(text))) for i, text, _, source, _ in hidden]
    df = spark.createDataFrame(sized, "doc_id long, source string, size long")
    rank = {r["doc_id"]: r["r"] & (2**64 - 1) for r in df.selectExpr("doc_id", "xxhash64(17, doc_id, size) AS r").collect()}
    taken, _ = mixed_by_hand(sized, rank)
    got = {(r["doc_id"], r["text"], r["source"], r["taken"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {(i, text, source, taken[i]) for i, text, _, source, _ in hidden if taken[i]}


def test_batches_of_texts_are_short(spark):
    """Every stage reads its texts in short Arrow batches; a session that sets shorter ones keeps them."""
    setting, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 9) AS text", "'en' AS lang", "'s' AS source", "45L AS n_chars").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    def longest():
        return max(r["n"] for r in corpus_pipeline.documents(spark, docs).mapInArrow(sizes, "n long").collect())

    try:
        for given, most in ((10000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (100, 100)):
            spark.conf.set(setting, given)
            assert longest() == most
        spark.conf.set(setting, 10000)
        corpus_pipeline.hide_personal_data(spark, docs, "")
        assert int(spark.conf.get(setting)) == corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set(setting, before)
