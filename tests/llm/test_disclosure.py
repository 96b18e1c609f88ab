"""Disclosing terms far from their entity, in other documents, and short or with digits."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from sievelight.llm import disclosure

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def test_terms_far_away_short_and_elsewhere(spark):
    gap = "plain words stand between them here " * 10
    rows = [(i, f"write {i} to secret@corp.org now {gap} Uwe keeps badge k7x9") for i in range(12)] + [(12, "only Uwe knows")] + [(10 + i, f"nobody else {i} {gap}") for i in range(20, 220)]
    got = {r["doc_id"]: r["spans"] for r in disclosure.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:13]:
        for term in ("Uwe", "k7x9"):
            if term in text:
                assert f"term:{text.index(term)}:{text.index(term) + len(term)}" in got[i].split(",")
    assert got[30] == ""
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[12] == "only <NAME> knows" and "<CODE>" in clean[0] and "<EMAIL>" in clean[0]


def test_spans_against_brute_force(spark):
    rng = random.Random(12)
    people = [(f"p{i}@m{i}.org", f"n{i}", f"{i}{i}x") for i in range(12)]
    rows: list[tuple[int, str]] = []
    for i in range(300):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))]
        for mail, name, code in rng.sample(people, rng.choice((0, 0, 1, 2))):
            for extra, p in ((mail, 0.7), (name, 0.8), (code, 0.5)):
                if rng.random() < p:
                    words.insert(rng.randrange(len(words)), extra)
        rows.append((i, " ".join(words)))
    rows += [(400 + i, rows[i][1]) for i in range(0, 300, 7)]  # copies of a text tell nothing more
    texts = {t for _, t in rows}
    total, with_term, with_entity, both = len(texts), Counter(), Counter(), defaultdict(Counter)
    for text in texts:
        terms, mails = {t.lower() for t in re.findall(r"[^\W_]+", text)}, {m[0] for m in re.finditer(EMAIL, text)}
        with_term.update(terms)
        with_entity.update(mails)
        for m in mails:
            both[m].update(terms)
    hidden = {t for m in both for t, n in both[m].items() if n >= 2 and with_entity[m] < total and n >= 0.9 * with_term[t] and math.log2(n * total / (with_entity[m] * with_term[t])) / math.log2(total / with_entity[m]) >= 0.9}
    assert any(t.startswith("n") for t in hidden)
    got = {r["doc_id"]: r["spans"] for r in disclosure.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        mails = [m.span() for m in re.finditer(EMAIL, text)]
        terms = [m.span() for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in hidden and not any(a < m.end() and m.start() < b for a, b in mails)]
        assert got[i] == ",".join([f"email:{a}:{b}" for a, b in mails] + [f"term:{a}:{b}" for a, b in terms])
