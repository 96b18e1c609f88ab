"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievelight.llm import anchors, bktree, cotraining, disclosure, licenses, line_quality, mixing, shingles, tiling, toxicity, url_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon " * 8000
PLAIN = "The quick brown fox met a lazy dog near the old stone bridge. " * 6
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", "en", "a", 5),
    (4, LONG, "en", "b", len(LONG)),
    (5, PLAIN, "en", "b", len(PLAIN)),
    (5, PLAIN, "en", "b", len(PLAIN)),
    (6, PLAIN + "more", "fr", None, 1),
    (None, "no id under the MIT license, mail a@b.org", "de", "c", 3),
    (7, "é😀 ## Licensed under CC BY-NC 4.0. 10.0.0.1", "de", "c", 40),
    (8, "x" * 50_000 + " y", "es", "c", 50_002),
]
LABELS = [(1, 1, 0), (2, 0, 1), (4, 1, None), (5, None, 0), (5, 1, 1), (None, 1, 1), (6, 1, 0), (7, 0, 1), (8, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    clash = ["score", "size", "key", "spans", "row", "h", "fp", "taken", "target", "component_id", "places", "y", "base", "__x", "__id", "__key", "__k", "__spans", "__terms", "text_key", "spans_", "terms", "root", "copy", "kept_id", "no_id", "bad", "_copies", "_before", "rest", "edge", "extra", "pattern", "rank", "bin", "id", "trust", "me"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, PLAIN), (4, PLAIN), (None, "The quick brown fox met a lazy dog")], "item_id long, text string")


def operators(labels, benchmark):
    return {
        "licenses": licenses.scan,
        "toxicity": lambda d: toxicity.classify(d, labels),
        "line_quality": line_quality.line_quality,
        "cotraining": lambda d: cotraining.score_quality(d, labels),
        "anchors": anchors.repeated_windows,
        "tiling": lambda d: tiling.contamination(d, benchmark),
        "disclosure": disclosure.digest,
        "bktree": bktree.near_duplicates,
        "mixing": lambda d: mixing.mix_sources(mixing.sized(d)),
        "cleaned_text": line_quality.cleaned_text,
    }


@pytest.mark.parametrize("name", list(operators(None, None)))
def test_one_row_per_row(name, docs, empty, labels, benchmark):
    run = operators(labels, benchmark)[name]
    rows = run(docs).collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert run(empty).count() == 0


def test_defined_values(docs, labels, benchmark):
    lic = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (lic[1]["n_words"], lic[1]["n_base"], lic[1]["first_word"], lic[1]["labels"], lic[1]["score"]) == (0, 0, None, "", 0.0)
    assert lic[None]["base_labels"] == "mit" and lic[7]["labels"] == "cc-by-nc"
    quality = {r["doc_id"]: r for r in line_quality.line_quality(docs).collect()}
    assert quality[1]["n_words"] == 0 and quality[1]["base_failed"] and not quality[1]["kept"]
    cut = {r["doc_id"]: r for r in anchors.repeated_windows(docs).collect()}
    assert cut[1]["n_removed"] == 0 and cut[4]["n_removed"] == 40000 and cut[5]["n_removed"] == cut[5]["n_words"]
    found = {r["doc_id"]: r for r in bktree.near_duplicates(docs).collect()}
    assert found[1]["fp"] == 0 and found[2]["component_id"] == 1 == found[3]["component_id"]
    leaked = {r["doc_id"]: r for r in tiling.contamination(docs, benchmark).collect()}
    assert leaked[5]["contaminated"] and leaked[5]["item_ids"].count(4) == 2 and not leaked[4]["contaminated"] and not leaked[1]["contaminated"]
    private = {r["doc_id"]: r for r in disclosure.digest(docs).collect()}
    assert private[None]["n_email"] == 1 and private[7]["n_ip"] == 1 and private[1]["spans"] == ""


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, k, docs, empty, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns[:5] == corpus_pipeline.COLUMNS
    kept = out.collect()
    assert stage(spark, empty, str(tmp_path)).count() == 0
    if name == "pii":
        assert len(kept) == len(ROWS)
        texts = {r["doc_id"]: r["text"] for r in kept}
        assert texts[1] is None and texts[None].endswith("mail <EMAIL>") and texts[7].endswith("<IP>") and texts[4] == LONG
    if name == "simhash_near_dedup":
        assert {str(r["doc_id"]) for r in kept} >= {"1", "4", "5", "7", "8", "None"}
        assert sorted(str(r["doc_id"]) for r in kept if r["doc_id"] in (1, 2, 3, 5)) == ["1", "5"]
    if name == "benchmark_decontamination":
        assert None in {r["doc_id"] for r in kept}
        assert not {5, 6} & {r["doc_id"] for r in kept} and {1, 2, 4, 7} <= {r["doc_id"] for r in kept}


def test_url_edges(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.ORG/es/x?y"), (5, "HTTP://example.org/en/12"), (6, "https://x.com/fr/1"), (7, "https://x.com/de/1#z"), (8, "https://x.net/q"), (8, "https://x.net/q"), (None, "http://b.org"), (9, "http://b.org/" + "é" * 30_000)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("gram", F.lit("clash")).withColumn("score", F.lit("clash"))
    rows = url_model.judge_urls(pages).collect()
    assert len(rows) == len(urls)
    by = {r["page_id"]: r for r in rows}
    assert [by[i]["verdict"] for i in (1, 2, 3)] == ["block"] * 3 and by[1]["host"] == "" and by[3]["path"] == ""
    assert (by[4]["host"], by[4]["path"], by[4]["rule"], by[4]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert by[5]["rule"] == "example.org/en/1" and by[6]["rule"] == "com/fr/" and by[7]["verdict"] == "block"
    assert by[8]["rule"] is None and by[None]["rule"] is None and by[9]["rule"] == "org/"
    assert url_model.judge_urls(pages.limit(0)).count() == 0


OTHER = "A wholly different story about rivers and their many bends in spring. " * 6
IDS = [(None, OTHER), (1, PLAIN), (1, "short and clean words"), (-1, "another clean row"), (None, PLAIN + "x"), (None, "no id but clean"), (5, OTHER)]


def test_rows_are_told_apart_without_unique_ids(spark, benchmark):
    """Null ids, -1 and one id with several texts: no row is lost or judged by another's text."""
    docs = spark.createDataFrame(IDS, "doc_id long, text string")
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    clean = rows(tiling.decontaminate(docs, benchmark))
    assert clean == sorted([r for r in IDS if not r[1].startswith(PLAIN)], key=str)
    for deduplicate in (bktree.deduplicate, shingles.deduplicate):
        kept = rows(deduplicate(docs))
        assert {t for _, t in kept} >= {"short and clean words", "another clean row", "no id but clean"}
        assert [i for i, t in kept if t == OTHER] == [5]
    cut = anchors.repeated_windows(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in cut) == sorted([("None", 72), ("1", 78), ("1", 0), ("-1", 0), ("None", 78), ("None", 0), ("5", 72)])
    assert len(disclosure.sanitize(docs).collect()) == len(IDS) == len(mixing.mix_sources(mixing.sized(docs.withColumn("source", F.lit("a")))).collect())
