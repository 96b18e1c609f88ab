"""Entity dictionaries, hierarchies and profile features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import normalize_text
from sievelight.operators.joins import candidates, small

PROFILE = "basic struct<name:string,phone:string,tel:string,birth:string,married:string>, contact struct<email:string>, education map<string,struct<school:string,degree:string,end:string>>, work map<string,struct<company:string,position:string,start:string,end:string>>"
#: Order of degrees (fixed values).
DEGREES = {"other": 0, "associate": 1, "bachelor": 2, "master": 3, "doctor": 4}
#: Legal suffixes that a company's name loses (fixed values).
LEGAL = r"(?i)[\s,]*(股份有限公司|有限责任公司|集团有限公司|有限公司|集团|inc\.?|ltd\.?|llc|gmbh|corp\.?|corporation|co\.)$"


def entity_mentions(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """(text_id, alias, start, end, entity_ids): longest aliases that no longer hit covers; a shared alias names all its entities.

    ASCII aliases must stand as whole words.  Texts meet aliases by a first word
    or character pair, so a text is compared with those that it may hold only.
    """
    aliases = registry.groupBy("alias").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids")).filter("alias <> ''")
    met = candidates(texts, "text_id", "text", aliases.select("alias"), "alias")
    hit = texts.select("text_id", F.lower("text").alias("text")).join(met.groupBy("text_id").agg(F.collect_set("alias").alias("met")), "text_id")
    hit = hit.select("text_id", "text", F.explode("met").alias("alias")).filter(F.contains("text", F.lower("alias")))
    quoted = F.regexp_replace(F.lower("alias"), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    ascii_ = F.col("alias").rlike(r"^[\x00-\x7F]+$")
    pattern = F.when(ascii_, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))).otherwise(quoted)
    n = F.length("alias")
    gaps = F.transform(F.split("text", pattern, F.lit(-1)), lambda g: F.length(g))
    # The last gap has no hit behind it; a hit starts after its own gap and all gaps and hits before.
    cut = hit.select("text_id", "alias", n.alias("n"), F.posexplode(F.slice(gaps, F.lit(1), F.size(gaps) - 1)).alias("i", "gap"))
    before = F.sum("gap").over(Window.partitionBy("text_id", "alias").orderBy("i"))
    found = cut.select("text_id", "alias", (before + F.col("i") * F.col("n")).cast("int").alias("start"), (before + (F.col("i") + 1) * F.col("n")).cast("int").alias("end"))
    # A hit inside a longer one falls to it: of equal starts the longest, and none that starts before the longest end so far.
    order = Window.partitionBy("text_id").orderBy("start", F.desc("end"), "alias")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = found.withColumn("reached", reached).filter(F.col("reached").isNull() | (F.col("end") > F.col("reached")))
    return kept.join(small(aliases), "alias").select("text_id", "alias", "start", "end", "entity_ids")


def resolve_exact(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name_id, entity_ids, n): entities whose normalised alias equals the name's."""
    keyed = registry.select(normalize_text(F.col("alias")).alias("key"), "entity_id").distinct()
    joined = names.withColumn("key", normalize_text(F.col("name"))).join(keyed, "key", "left")
    return joined.groupBy("name_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids")).withColumn("n", F.size("entity_ids"))


def company_hints(questions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(question_id, status, entity_ids): resolved, ambiguous, unregistered (names given, none known) or none; sub-questions inherit."""
    ids = mentions.groupBy(F.col("text_id").alias("question_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("entity_ids")))).alias("own"), F.max(F.size("entity_ids")).alias("widest"))
    own = questions.join(ids, "question_id", "left")
    parents = ids.select(F.col("question_id").alias("parent_id"), F.col("own").alias("inherited"), F.col("widest").alias("parent_widest"))
    joined = own.join(parents, "parent_id", "left").withColumn("entity_ids", F.coalesce("own", "inherited")).withColumn("w", F.coalesce("widest", "parent_widest"))
    status = F.when(F.col("w") > 1, "ambiguous").when(F.col("w") == 1, "resolved").when(F.size("given_names") > 0, "unregistered").otherwise("none")
    return joined.select("question_id", status.alias("status"), F.coalesce("entity_ids", F.array().cast("array<string>")).alias("entity_ids"))


def registry_check(records: DataFrame, kinds=("company", "publisher")) -> DataFrame:
    """(entity_id, problem): repeated ids, unknown kinds, empty or bare-number aliases."""
    copies = F.count("*").over(Window.partitionBy("entity_id"))
    rules = F.array(
        F.when(F.col("copies") > 1, "repeated_id"), F.when(~F.col("kind").isin(*kinds), "unknown_kind"), F.when(F.coalesce(F.size("aliases"), F.lit(0)) <= 0, "no_alias"),
        F.when(F.exists("aliases", lambda a: F.trim(a) == ""), "empty_alias"), F.when(F.exists("aliases", lambda a: a.rlike("^[0-9]+$")), "bare_number"),
    )
    return records.withColumn("copies", copies).select("entity_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("problem"))


def registry_version(records: DataFrame) -> DataFrame:
    """One row: a hash of the whole dictionary, whatever its order."""
    one = records.select(F.sha2(F.to_json(F.struct("entity_id", "kind", F.array_sort("aliases").alias("aliases"))), 256).alias("h"))
    return one.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("version"))


def hierarchy_path(tree: DataFrame) -> DataFrame:
    """(id, path): names from the node up to its root, for ``tree(id, parent, name)``.

    A path that would meet a node twice is a cycle and ends before it.  Paths are
    not cut: deeper ones than the session's limits of recursion allow are an error.
    """
    return tree.sparkSession.sql(
        """
        WITH RECURSIVE up(id, next, path, seen, level) AS (
          SELECT id, parent, array(name), array(id), 1 FROM {tree}
          UNION ALL SELECT up.id, t.parent, array_append(up.path, t.name), array_append(up.seen, t.id), up.level + 1
          FROM up JOIN {tree} t ON up.next = t.id WHERE NOT array_contains(up.seen, t.id))
        SELECT id, max_by(path, level) AS path FROM up GROUP BY id""",
        tree=tree.select("id", "parent", "name"),
    )


def code_lookup(codes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``codes(code, name)`` with the missing one of the two from ``dictionary(code, name)``."""
    by_code = dictionary.select("code", F.col("name").alias("_name"))
    by_name = dictionary.select("name", F.col("code").alias("_code"))
    joined = codes.join(small(by_code), "code", "left").join(small(by_name), "name", "left")
    return joined.withColumn("name", F.coalesce("name", "_name")).withColumn("code", F.coalesce("code", "_code")).drop("_name", "_code")


def match_school(names: DataFrame, schools: DataFrame) -> DataFrame:
    """``names(name_id, name)`` with school_id and rank; a school is found by any name or alias (joined by +), cleaned."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"[\s()（）,.'·-]+", "")
    known = schools.select("school_id", "rank", F.explode(F.concat(F.array("name_cn", "name_en"), F.split(F.coalesce("alias", F.lit("")), r"\+"))).alias("n")).withColumn("key", clean(F.col("n"))).filter("key <> ''").groupBy("key").agg(F.min("school_id").alias("school_id"), F.min_by("rank", "school_id").alias("rank"))
    return names.withColumn("key", clean(F.col("name"))).join(small(known), "key", "left").drop("key")


def normalize_company(c: Column) -> Column:
    """Lower-cased name without brackets, legal suffixes and punctuation."""
    text = F.regexp_replace(F.lower(F.trim(c)), r"[(（][^)）]*[)）]", "")
    return F.regexp_replace(F.regexp_replace(text, LEGAL, ""), r"[^\p{L}\p{N}]+", "")


def company_tags(names: DataFrame, lists: DataFrame) -> DataFrame:
    """(name_id, tags): curated lists ``lists(tag, entry)`` that name the company; ASCII entries must be equal, others contained."""
    entries = lists.withColumn("entry", normalize_company(F.col("entry"))).filter("entry <> ''").distinct()
    keyed = names.withColumn("key", normalize_company(F.col("name")))
    ascii_ = F.col("entry").rlike(r"^[\x00-\x7F]*$")
    equal = keyed.select("name_id", "key").join(small(entries.filter(ascii_).withColumnRenamed("entry", "key")), "key").select("name_id", "tag")
    met = candidates(keyed, "name_id", "key", entries.filter(~ascii_), "entry")
    held = keyed.select("name_id", "key").join(met, "name_id").filter(F.contains("key", "entry")).select("name_id", "tag")
    tags = equal.unionByName(held).groupBy("name_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return names.select("name_id").distinct().join(tags, "name_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def partial_date(c: Column) -> Column:
    """Date from a loose string or an epoch (seconds or milliseconds); invalid parts become 1, no year no date."""
    epoch = F.when(c.rlike(r"^\d{13}$"), F.timestamp_seconds(c.cast("long") / 1000)).when(c.rlike(r"^\d{9,10}$"), F.timestamp_seconds(c.cast("long")))
    pattern = r"((?:19|20)\d{2})(?:\D+(\d{1,2}))?(?:\D+(\d{1,2}))?"
    y, m, d = (F.regexp_extract(c, pattern, i).try_cast("int") for i in (1, 2, 3))
    month = F.when(m.between(1, 12), m).otherwise(1)
    date = F.make_date(y, month, F.when(d.between(1, 28), d).otherwise(1))
    return F.coalesce(epoch.cast("date"), F.when(y.isNotNull(), date))


def flatten_profiles(raw: DataFrame, column: str = "json") -> DataFrame:
    """Nested profile JSON as flat columns; the newest job and the first start are promoted, phone falls back to tel."""
    p = raw.withColumn("p", F.from_json(column, PROFILE))
    jobs, schools = F.map_values("p.work"), F.map_values("p.education")
    dated = F.array_sort(F.transform(jobs, lambda j: F.struct(partial_date(j["start"]).alias("s"), j["company"].alias("company"), j["position"].alias("position"))))
    latest = F.try_element_at(dated, F.lit(-1))
    return p.select(
        *[c for c in raw.columns if c != column], F.col("p.basic.name").alias("name"), F.coalesce(F.when(F.col("p.basic.phone") != "", F.col("p.basic.phone")), F.col("p.basic.tel")).alias("phone"),
        F.when(F.upper("p.basic.married") == "Y", "yes").when(F.upper("p.basic.married") == "N", "no").alias("married"), F.col("p.contact.email").alias("email"), partial_date(F.col("p.basic.birth")).alias("birth"),
        latest["company"].alias("company"), latest["position"].alias("position"), F.array_min(F.transform(dated, lambda j: j["s"])).alias("first_start"), F.size(jobs).alias("n_jobs"), F.size(schools).alias("n_schools"),
    )


def education_features(spans: DataFrame) -> DataFrame:
    """(person, highest, first, best_rank, band, end_year) of ``spans(person, degree, school_rank, start, end)``."""
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEGREES.items() for x in kv]), F.col("degree")), F.lit(0))
    out = spans.withColumn("level", level).groupBy("person").agg(
        F.max_by("degree", F.struct("level", "end")).alias("highest"), F.min_by("degree", F.struct("level", "start")).alias("first"), F.min("school_rank").alias("best_rank"), F.max(F.year("end")).alias("end_year")
    )
    return out.withColumn("band", F.when(F.col("best_rank") <= 20, "top20").when(F.col("best_rank") <= 50, "top50").when(F.col("best_rank") <= 100, "top100").when(F.col("best_rank").isNotNull(), "ranked"))


def work_features(spans: DataFrame) -> DataFrame:
    """(person, n_jobs, mean_days, latest_days, max_scale, first_start) of ``spans(person, start, end, scale)``."""
    days = F.datediff("end", "start")
    return spans.groupBy("person").agg(
        F.count("*").alias("n_jobs"), F.round(F.avg(days), 6).alias("mean_days"), F.max_by(days, F.struct("start", "end")).alias("latest_days"), F.max("scale").alias("max_scale"), F.min("start").alias("first_start")
    )


def completeness_score(df: DataFrame, fields: list[str], education: Column, work: Column, birth: Column, name: Column) -> DataFrame:
    """Share of filled fields, times 0.8 without education, 0.7 without work, 0.9 without birth, and halved without name."""
    filled = sum(F.when(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != ""), 1).otherwise(0) for f in fields)
    penalty = F.when(education, 1.0).otherwise(0.8) * F.when(work, 1.0).otherwise(0.7) * F.when(birth, 1.0).otherwise(0.9) * F.when(name, 1.0).otherwise(0.5)
    return df.withColumn("completeness", F.round(filled / len(fields) * penalty, 6))


def clean_contact_fields(df: DataFrame) -> DataFrame:
    """``phone`` as digits with one leading +, and ``keywords`` split into different non-empty terms."""
    digits = F.regexp_replace("phone", r"[^0-9+]", "")
    phone = F.when(F.startswith(digits, F.lit("+")), F.concat(F.lit("+"), F.replace(digits, F.lit("+"), F.lit("")))).otherwise(F.replace(digits, F.lit("+"), F.lit("")))
    words = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("keywords", F.lit("")), r"[,;，；、|\s]+"), lambda w: F.trim(w)), lambda w: w != ""))
    return df.withColumn("phone", phone).withColumn("keywords", words)
