"""Information-theoretic sanitisation of personal data, with built-in Spark functions only.

Protected entities are found by fixed patterns (email, ip, card, phone) and named
by their normalised value.  Over the whole corpus, the different texts that hold
an entity and a term are counted: copies of a text tell nothing more.  Pointwise
mutual information then says how strongly the term reveals the entity.  A term
discloses when it gives away ``threshold`` of the entity's information,
PMI(term, entity) / IC(entity), and leaves little doubt which entity is meant,
P(entity | term) >= ``certainty``.  Disclosing terms are protected at every place
of every document, also where the entity itself does not stand.

Entities that stand in exactly the same texts are counted as one profile, so a
list of thousands of them costs no more than one.

Defined cases: null and empty texts have no span; repeated rows get the same
spans each; a term needs ``min_support`` different texts with the entity, so
single co-occurrences and exact copies never disclose; very long texts are
searched whole; an empty table gives an empty result; extra columns, whatever
their names, are ignored by ``digest`` and kept by ``sanitize``; a null doc_id is
kept and its row treated as any other.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.store import fresh, materialize, text_key

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the four kinds.  Possessive runs that start at a run's first
#: character (or where the match before ended) find the same matches as the plain
#: patterns, without backtracking or recursion on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: What replaces a span in ``sanitize``.
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "number": "<NUMBER>", "code": "<CODE>", "name": "<NAME>", "term": "<TERM>"}
#: Terms: runs of letters and digits of any length.
TERM = r"[\p{L}\p{M}\p{N}]+"
#: Rows (of a term, or of a text key and its terms) up to which a side is broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 100_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def running_sum(lengths: Column, steps: int = 20) -> Column:
    """Inclusive prefix sums of an array of up to 2**steps numbers, by doubling."""

    def doubled(x: Column, width: int) -> Column:
        return F.when(F.size(x) <= width, x).otherwise(F.transform(x, lambda v, i: v + F.when(i >= width, F.get(x, i - width)).otherwise(0)))

    for k in range(steps):
        lengths = let(lengths, partial(doubled, width=1 << k))
    return lengths


def _number(part: Column) -> Column:
    digits = F.ltrim(part, F.lit("0"))
    return F.when(F.length(digits) <= 3, F.coalesce(digits.try_cast("int"), F.lit(0))).otherwise(1000)


def _luhn(digits: Column) -> Column:
    def value(i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def accepted(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: _number(p) <= 255)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def mentions(text: Column) -> Column:
    """Array of (kind, start, end, value) in code points, by kind as listed, then start."""
    none = F.array().cast("array<struct<k:int,start:int,end:int,value:string>>")

    def placed(matches: Column, k: int, kind: str) -> Column:
        # Text between the matches and the matches themselves alternate: their lengths add up to the places.
        between = F.transform(F.split(text, PATTERNS[kind], -1), lambda x: F.length(x))
        ends = running_sum(F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda gap, x: gap + F.length(x)))
        spans = F.zip_with(matches, ends, lambda x, e: F.struct(F.lit(k).alias("k"), (e - F.length(x)).alias("start"), e.alias("end"), x.alias("value")))
        return F.when(F.size(matches) > 0, F.filter(spans, lambda s: accepted(kind, s["value"])))

    found = []
    for k, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        found.append(F.coalesce(F.when(hint, let(matches, partial(placed, k=k, kind=kind))), none))
    return F.concat(*found)


def terms_of(text: Column) -> Column:
    """The different terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))


def placed_terms(text: Column) -> Column:
    """Array of (term, start, end) in code points of all terms of a text, repeats included."""
    terms = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    gaps = F.transform(F.split(text, TERM, -1), lambda x: F.length(x))
    ends = running_sum(F.zip_with(F.slice(gaps, F.lit(1), F.size(terms)), terms, lambda gap, x: gap + F.length(x)))
    return F.zip_with(terms, ends, lambda t, e: F.struct(F.lower(t).alias("term"), (e - F.length(t)).alias("start"), e.alias("end")))


def entity_name(mention: Column) -> Column:
    """Kind and normalised value of a mention: one name for all spellings of a number or an address."""
    digits = F.regexp_replace(mention["value"], "[^0-9]", "")
    value = F.when(mention["k"] == KINDS.index("email"), F.lower(mention["value"])).when(mention["k"] >= KINDS.index("card"), digits).otherwise(mention["value"])
    return F.concat_ws(":", mention["k"], value)


def _small(side: DataFrame) -> DataFrame:
    """``side`` as a join side: broadcast only after its rows were counted."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def disclosing(texts: DataFrame, threshold: float, certainty: float, min_support: int) -> DataFrame:
    """(key, terms): the disclosing terms that each of ``texts(key, text)`` holds, where it holds any."""
    none = texts.select("key").limit(0).withColumn("terms", F.array().cast("array<string>"))
    holders = materialize(texts.withColumn("spans", mentions(F.col("text"))).filter(F.size("spans") > 0).dropDuplicates(["key"]))
    held = holders.select("key", F.explode(F.array_distinct(F.transform("spans", entity_name))).alias("entity"))
    # Entities of exactly the same texts are one profile.
    same = held.groupBy("entity").agg(F.count("*").alias("with_entity"), F.min("key").alias("a"), F.max("key").alias("b"), F.bit_xor(F.xxhash64("key")).alias("x"))
    profile = F.xxhash64("with_entity", "a", "b", "x").alias("profile")
    owned = materialize(held.join(same.filter(F.col("with_entity") >= min_support), "entity").select("key", profile, "with_entity").distinct())
    if owned.isEmpty():
        return none
    words = holders.join(owned.select("key").distinct(), "key", "left_semi").select("key", F.explode(terms_of(F.col("text"))).alias("term"))
    held_by = materialize(words.join(owned, "key").select("key", "term", "profile", "with_entity"))
    together = held_by.groupBy("profile", "term").agg(F.count("*").alias("both"), F.first("with_entity").alias("with_entity")).filter(F.col("both") >= min_support)
    # Texts that hold a term in the whole corpus, summed where the rows are; each of n copies counts 1/n.
    copies = texts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    weighed = texts.join(_small(copies), "key", "left").select((1 / F.coalesce("n", F.lit(1))).alias("share"), F.explode(terms_of(F.col("text"))).alias("term"))
    spread = weighed.groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("with_term"))
    counted = together.join(spread, "term")
    total = texts.agg(F.countDistinct("key")).first()[0]
    pmi = F.log2(F.col("both") * float(total) / (F.col("with_entity") * F.col("with_term")))
    information = F.log2(F.lit(float(total)) / F.col("with_entity"))
    strong = (pmi >= threshold * information - 1e-9) & (F.col("both") >= (certainty - 1e-9) * F.col("with_term")) & (F.col("with_entity") < total)
    wanted = materialize(counted.filter(strong).select("profile", "term", (F.col("with_term") > F.col("both")).alias("elsewhere")))
    # Most terms stand in texts of their entity only; the few others are sought in all texts.
    own = held_by.join(wanted, ["profile", "term"], "left_semi").select("key", "term")
    wide = _small(wanted.filter("elsewhere").select("term").distinct())
    found = texts.select("key", F.explode(terms_of(F.col("text"))).alias("term")).join(wide, "term", "left_semi").select("key", "term")
    return materialize(own.unionByName(found).distinct().groupBy("key").agg(F.collect_list("term").alias("terms")))


def find_spans(docs: DataFrame, spans: str, terms: str, threshold: float, certainty: float, min_support: int) -> DataFrame:
    """``docs`` with ``spans``, the pattern spans (k, start, end, value), and ``terms``, the (start, end) of disclosing terms outside them."""
    key, named = fresh(docs, "text_key", "named")
    texts = docs.select(text_key().alias("key"), "text")
    exposed = disclosing(texts, threshold, certainty, min_support)
    exposed = exposed.select(F.col("key").alias(key), F.col("terms").alias(named))
    marked = docs.withColumn(key, text_key()).join(_small(exposed), key, "left").withColumn(spans, mentions(F.col("text")))
    outside = lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    hits = F.filter(placed_terms(F.col("text")), lambda t: F.array_contains(named, t["term"]) & outside(t))
    places = F.transform(hits, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    return marked.withColumn(terms, F.when(F.col(named).isNull(), nothing).otherwise(places)).drop(key, named)


def _joined(spans: Column, name) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"]))


def _kind(s: Column) -> Column:
    out = F.lit(KINDS[-1])
    for k, kind in enumerate(KINDS[:-1]):
        out = F.when(s["k"] == k, kind).otherwise(out)
    return out


def _count(kinds: str, k: int) -> Column:
    return F.size(F.filter(kinds, lambda x: x == k))


def digest(docs: DataFrame, threshold: float = 0.9, certainty: float = 0.9, min_support: int = 2) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of ``docs(doc_id, text)``."""
    marked = find_spans(docs.select("doc_id", "text"), "spans", "terms", threshold, certainty, min_support)
    base = F.coalesce(_joined(F.col("spans"), _kind), F.array().cast("array<string>"))
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    marked = marked.select("doc_id", F.transform("spans", lambda s: s["k"]).alias("kinds"), base.alias("base"), F.concat(base, terms).alias("all"))
    return marked.select(
        "doc_id",
        *[_count("kinds", k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("all", ",").alias("spans"),
    )


def sanitize(docs: DataFrame, threshold: float = 0.9, certainty: float = 0.9, min_support: int = 2) -> DataFrame:
    """``docs`` with protected spans of ``text`` generalised to their kind; texts without any stay as they are.

    Disclosing terms are generalised to number, code (letters and digits), name
    (capitalised) or plain term.
    """
    spans, terms = fresh(docs, "spans", "terms")
    marked = find_spans(docs, spans, terms, threshold, certainty, min_support)
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _kind(s).alias("kind")))

    def general(t: Column) -> Column:
        term = F.substring("text", t["start"] + 1, t["end"] - t["start"])
        return F.when(~term.rlike(r"\D"), "number").when(term.rlike(r"\d"), "code").when(term.rlike(r"^\p{Lu}"), "name").otherwise("term")

    others = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), general(t).alias("kind")))
    hidden = F.array_sort(F.concat(plain, others))
    # Of overlapping spans the first hides its part, the next one what is left of it.
    label = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), s["kind"])
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    folded = F.aggregate(
        hidden, state,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["end"] <= a["at"], a["parts"]).otherwise(F.concat(a["parts"], F.array(F.substring("text", a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), label(s)))).alias("parts"),
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring("text", a["at"] + 1, F.lit(2**31 - 1))),
    )
    some = (F.size(spans) > 0) | (F.size(terms) > 0)
    return marked.withColumn("text", F.when(some, folded).otherwise(F.col("text"))).select(*docs.columns)
