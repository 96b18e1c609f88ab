"""Term statistics, term weights, query construction and tags."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import clean_question, drop_question_words, fine_tokens, tokenize
from sievelight.operators.joins import listed, small
from sievelight.operators.products import block_matches, block_postings, pair_codes
from sievelight.sources.tables import deal


def postings(chunks: DataFrame, key: str = "chunk_id", tokens: str = "tokens") -> DataFrame:
    """(key, term, tf): a row per chunk and different term.  Tokens travel once, by chunk; terms are counted where they then are."""
    width = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.select(key, tokens).repartition(width, key).select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


#: Term of the one posting that every chunk has; its length is the chunk's.
HEADER = ""


@dataclass(frozen=True)
class Index:
    """Postings that several plans share: (chunk_id, term, tf, length), with one HEADER row per chunk.

    They stay dealt by chunk, so whatever joins a broadcast side and groups by
    chunk needs no further shuffle.  Kept in memory or on disk until
    ``unpersist``.
    """

    rows: DataFrame

    @property
    def posts(self) -> DataFrame:
        return self.rows.filter(F.col("term") != HEADER)

    @property
    def size(self) -> DataFrame:
        """One row: chunks and their mean length."""
        return self.rows.filter(F.col("term") == HEADER).agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))

    def stats(self) -> DataFrame:
        """(term, freq, df): occurrences, and chunks that hold the term."""
        return self.posts.groupBy("term").agg(F.sum("tf").alias("freq"), F.count("*").alias("df"))

    def unpersist(self) -> None:
        self.rows.unpersist()


def with_pairs(tokens: Column) -> Column:
    """Tokens and their neighbouring pairs, joined by a blank."""
    n = F.size(tokens)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1)))
    return F.when(n > 1, F.concat(tokens, pairs)).otherwise(tokens)


#: Chunks whose tokens a task looks up at once.
LOOKED_UP = 512


def build_index(chunks: DataFrame, only: DataFrame | None = None, tokens: str = "tokens", pairs: bool = False) -> Index:
    """Postings of ``chunks(chunk_id, tokens)``, of the terms ``only(term)`` where given, with neighbouring pairs where asked for.

    A list of terms that is not long is sent to the chunks, which travel as their
    postings; otherwise tokens travel once, by chunk, and are counted where they
    then are.
    """
    spark = chunks.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = chunks.select("chunk_id", F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("t"))
    known = None if only is None else only.select("term").filter(F.col("term") != HEADER).distinct()
    few = None if known is None else listed(known)
    if few is not None:
        rows = _found(deal(held), few.column("term").to_pylist(), pairs).repartition(width, "chunk_id")
        return Index(rows.groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length")).persist())
    dealt = held.repartition(width, "chunk_id")
    terms = F.concat(F.array(F.lit(HEADER)), with_pairs(F.col("t")) if pairs else F.col("t"))
    exploded = dealt.select("chunk_id", F.size("t").alias("length"), F.explode(terms).alias("term"))
    if known is not None:
        exploded = exploded.join(known.unionByName(spark.createDataFrame([(HEADER,)], "term string")), "term")
    rows = exploded.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    return Index(rows.persist())


def _found(chunks: DataFrame, terms: list[str], pairs: bool) -> DataFrame:
    """(chunk_id, term, tf, length) of the ``terms`` that each row of ``chunks(chunk_id, t)`` holds, and its HEADER row."""
    words, word, keys, pair = pair_codes(terms) if pairs else (pa.array(terms, pa.string()), np.arange(len(terms)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    named = pa.array([*terms, HEADER], pa.string())

    def look(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, LOOKED_UP):
                batch = pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(at, min(at + LOOKED_UP, whole.num_rows)))) for c in whole.columns], whole.schema.names)
                row, term, times = block_postings(batch.column("t"), words, word, keys, pair)
                every = np.arange(batch.num_rows)
                row, term, times = np.r_[every, row], np.r_[np.full(len(every), len(terms)), term], np.r_[np.ones(len(every), np.int64), times]
                sizes = pc.list_value_length(batch.column("t")).take(pa.array(row)).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(pa.array(row)), named.take(pa.array(term)), pa.array(times, pa.int64()), sizes], ["chunk_id", "term", "tf", "length"])

    return chunks.mapInArrow(look, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, term string, tf long, length int")


def term_stats(chunks: DataFrame) -> DataFrame:
    """(term, freq, df): occurrences, and chunks that hold the term."""
    return postings(chunks).groupBy("term").agg(F.sum("tf").alias("freq"), F.count("*").alias("df"))


def _idf(s: Column, n: float) -> Column:
    return F.log10(F.lit(10.0) + (F.lit(n) - s + 0.5) / (s + 0.5))


def raw_weight(term: Column, freq: Column, df: Column) -> Column:
    """0.3 idf(freq) + 0.7 idf(df), times two for numbers and 0.01 for one or two letters."""
    number, latin = term.rlike(r"^[0-9. -]{2,}$"), term.rlike(r"^[a-z. -]+$")
    f = F.when(number, 3.0).when(freq.isNotNull(), F.greatest(freq.cast("double"), F.lit(10.0))).when(latin, 300.0).otherwise(10.0)
    d = F.when(number, 5.0).when(df.isNotNull(), df + 3.0).when(latin, 300.0).otherwise(3.0)
    kind = F.when(term.rlike(r"^[0-9,.]{2,}$"), 2.0).when(term.rlike("^[a-z]{1,2}$"), 0.01).otherwise(1.0) * F.when(term.rlike("^[0-9-]+"), 2.0).otherwise(1.0)
    return (0.3 * _idf(f, 1e7) + 0.7 * _idf(d, 1e9)) * kind


def term_weights(tokens: DataFrame, stats: DataFrame, key: str = "query_id", part: Column | None = None) -> DataFrame:
    """``tokens(key, pos, term, …)`` with ``weight``; the weights of a key, or of each ``part`` of it, add up to 1."""
    joined = tokens.join(stats, "term", "left")
    weighed = joined.withColumn("raw", raw_weight(F.col("term"), F.col("freq"), F.col("df")))
    share = Window.partitionBy(key) if part is None else Window.partitionBy(key, part)
    return weighed.withColumn("weight", F.col("raw") / F.sum("raw").over(share)).select(*tokens.columns, "weight")


def expand_synonyms(weights: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, term, boost) of the synonyms of weighted terms, a quarter of the term's weight each; ``synonyms(term, synonym)``."""
    return weights.join(synonyms, "term").select("query_id", F.col("synonym").alias("term"), (F.col("weight") / 4).alias("boost"))


def phrase_terms(weights: DataFrame) -> DataFrame:
    """(query_id, term, boost) of neighbouring term pairs with twice the larger weight."""
    order = Window.partitionBy("query_id").orderBy("pos")
    pairs = weights.withColumn("next", F.lead("term").over(order)).withColumn("next_weight", F.lead("weight").over(order)).filter("next is not null")
    return pairs.select("query_id", F.concat_ws(" ", "term", "next").alias("term"), (2 * F.greatest("weight", "next_weight")).alias("boost"))


#: Groups of a question that count, and keywords of it after which no token is taken.
MAX_GROUPS, MAX_KEYWORDS = 256, 32


def question_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, latin, grp, name, pos, term): the tokens of ``queries(query_id, text)`` in groups.

    A question of more than three words, fewer than 70 % of them other than plain
    Latin, is Latin: each token is a group.  Other questions are cut at blanks;
    neighbouring words that end in Latin letters are one group, of the first
    ``MAX_GROUPS`` groups each has its tokens.
    """
    cleaned = queries.select("query_id", F.split(clean_question(F.col("text")), "[ \t]+").alias("words"))
    other = F.size(F.filter("words", lambda w: ~w.rlike("^[a-zA-Z]+$")))
    shaped = cleaned.select("query_id", ((F.size("words") > 3) & (other / F.size("words") < 0.7)).alias("latin"), drop_question_words(F.array_join("words", " ")).alias("c"))
    pieces = F.when(F.col("latin"), tokenize(F.col("c"))).otherwise(F.filter(F.split("c", "[ \t]+"), lambda p: p != ""))
    cut = shaped.select("query_id", "latin", F.posexplode(pieces).alias("at", "piece"))
    order = Window.partitionBy("query_id").orderBy("at")
    joins = ~F.col("latin") & F.col("piece").rlike("[a-zA-Z]$") & F.coalesce(F.lag("piece").over(order).rlike("[a-zA-Z]$"), F.lit(False))
    grouped = cut.withColumn("new", (~joins).cast("int")).withColumn("grp", (F.sum("new").over(order) - 1).cast("int")).filter(F.col("latin") | (F.col("grp") < MAX_GROUPS))
    grouped = grouped.withColumn("name", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece")).over(Window.partitionBy("query_id", "grp"))), lambda x: x["piece"]), " "))
    tokens = F.when(F.col("latin"), F.array("piece")).otherwise(tokenize(F.col("piece")))
    spread = grouped.select("query_id", "latin", "grp", "name", "at", F.posexplode(tokens).alias("i", "term"))
    return spread.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "i")) - 1).select("query_id", "latin", "grp", "name", "pos", "term")


def question_weights(tokens: DataFrame, stats: DataFrame) -> DataFrame:
    """``question_tokens`` with their ``weight``: a share of the question where it is Latin, of the group elsewhere."""
    return term_weights(tokens, stats, part=F.when(F.col("latin"), -1).otherwise(F.col("grp")))


def query_terms(weights: DataFrame, synonyms: DataFrame, max_keywords: int | None = MAX_KEYWORDS) -> DataFrame:
    """(query_id, latin, grp, kind, term, boost) of ``question_weights``: what a question is searched by; ``synonyms(term, synonym)``.

    Latin questions: every token but single characters with its weight, its
    synonyms with a quarter, neighbouring tokens as a phrase with twice the larger
    weight.

    Other questions, per group: the heaviest tokens until group names, tokens,
    their finer tokens and synonyms make up ``max_keywords`` keywords of the
    question; a token's finer tokens with half of its weight, as neighbours with
    the whole, its synonyms with a fifth; phrases of neighbouring tokens of the
    group with 1.5.  A group with synonyms of its own counts five times, these
    count 0.7.
    """
    no_words, empty = F.array().cast("array<string>"), F.array().cast("array<struct<kind:string,term:string,boost:double>>")
    named = synonyms.filter("synonym is not null").groupBy("term").agg(F.array_sort(F.collect_set("synonym")).alias("own"))
    named = small(named)
    rows = weights.join(named, "term", "left").join(named.select(F.col("term").alias("name"), F.col("own").alias("group_own")), "name", "left")
    rows = rows.withColumns({"own": F.coalesce("own", no_words), "group_own": F.coalesce("group_own", no_words)})
    # Latin: single characters are no terms, and the words beside them are neighbours.
    rows = rows.filter(~F.col("latin") | ~F.col("term").rlike("^[a-z0-9]$")).withColumn("part", F.when(F.col("latin"), -1).otherwise(F.col("grp")))
    fine = F.when(~F.col("latin") & (F.length("term") >= 3) & ~F.col("term").rlike(r"^[0-9a-z.+#_*-]+$"), F.filter(fine_tokens(F.array("term")), lambda x: F.length(x) > 1)).otherwise(no_words)
    inside, by_weight = Window.partitionBy("query_id", "part"), [F.desc(F.round("weight", 9)), F.col("pos")]
    rows = rows.withColumn("fine", fine).withColumns({"next": F.lead("term").over(inside.orderBy("pos")), "next_weight": F.lead("weight").over(inside.orderBy("pos")), "first": F.row_number().over(inside.orderBy(*by_weight)) == 1, "n": F.count("*").over(inside)})
    cost = 1 + F.size("fine") + F.size("own") + F.when(F.col("first"), 1 + F.size("group_own")).otherwise(0)
    rows = rows.withColumn("cost", cost).withColumn("used", F.sum("cost").over(Window.partitionBy("query_id").orderBy("grp", *by_weight)))
    kept = F.col("latin") | (F.lit(True) if max_keywords is None else F.col("used") < max_keywords)
    times = F.when(~F.col("latin") & (F.size("group_own") > 0), 5.0).otherwise(1.0)
    rows = rows.withColumns({"kept": kept, "times": times, "b": times * F.col("weight")})
    row = lambda kind, term, boost: F.struct(F.lit(kind).alias("kind"), term.alias("term"), boost.alias("boost"))
    each = lambda kind, terms, boost: F.transform(terms, lambda x: row(kind, x, boost))
    phrase = row("phrase", F.concat_ws(" ", "term", "next"), F.when(F.col("latin"), 2 * F.greatest("weight", "next_weight")).otherwise(1.5 * F.col("times")))
    neighbours = F.filter(with_pairs(F.col("fine")), lambda x: F.contains(x, F.lit(" ")))
    found = F.concat(
        F.when(F.col("kept"), F.concat(F.array(row("token", F.col("term"), F.col("b"))), each("synonym", F.col("own"), F.col("b") / F.when(F.col("latin"), 4).otherwise(5)))).otherwise(empty),
        F.when(F.col("kept") & (F.size("fine") > 1), F.concat(each("fine", F.col("fine"), F.col("b") / 2), each("fine", neighbours, F.col("b")))).otherwise(empty),
        F.when(F.col("next").isNotNull(), F.array(phrase)).otherwise(empty),
        # A group's own synonyms need a group that is searched: one with a token left, or with a phrase.
        F.when(~F.col("latin") & F.col("first") & (F.col("kept") | (F.col("n") > 1)), each("group_synonym", F.col("group_own"), F.lit(0.7))).otherwise(empty),
    )
    return rows.select("query_id", "latin", "grp", F.explode(found).alias("x")).groupBy("query_id", "latin", "grp", "x.kind", "x.term").agg(F.sum("x.boost").alias("boost"))


#: Statistics of terms up to which they are broadcast to postings; more meet them by a shuffle.
BROADCAST_STATS = 1_000_000


def paragraph_weights(posts: DataFrame, stats: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term, weight) of ``posts(key, term, tf)``: a term's weight among all tokens of its chunk, once per term; ``stats`` has all of their terms.

    A term of one chunk that occurs ten times at most weighs as one that occurs
    ten times, so the other terms are broadcast (after a count) and postings stay
    where their chunk is.
    """
    common = small(stats.filter("df > 1 or freq > 10"), BROADCAST_STATS)
    known = posts.filter("term is not null").join(common, "term", "left").withColumns({"freq": F.coalesce("freq", F.lit(10)), "df": F.coalesce("df", F.lit(1))})
    weighed = known.withColumn("raw", raw_weight(F.col("term"), F.col("freq"), F.col("df")))
    return weighed.withColumn("weight", F.col("raw") / F.sum(F.col("raw") * F.col("tf")).over(Window.partitionBy(key))).select(key, "term", "weight")


def keywords_of(chunks: DataFrame, only: Column) -> DataFrame:
    """``paragraph_keywords`` of the chunks for which ``only`` holds, by the term statistics of all: other chunks are counted, not weighed."""
    return paragraph_keywords(paragraph_weights(postings(chunks.filter(only)), term_stats(chunks)))


def paragraph_keywords(weights: DataFrame, n: int = 30, key: str = "chunk_id") -> DataFrame:
    """The ``n`` heaviest of the different terms per chunk, with the least number of them that must match: min(3, n / 10)."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "term")
    ranked = weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.withColumn("min_match", F.least(F.lit(3), F.floor(F.count("*").over(Window.partitionBy(key)) / 10)).cast("int"))


def token_similarity(weights: DataFrame, posts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity): share of the query's weight whose terms the chunk holds; of ``pairs(query_id, chunk_id)`` only, where given."""
    query = weights.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    total = query.groupBy("query_id").agg(F.sum("weight").alias("total"))
    if pairs is None:
        # The weighted terms are broadcast after a count, so postings are added up where they are.
        held = posts.select("chunk_id", "term").join(small(query), "term")
    else:  # a few chunks per query: meet their postings only
        posts = posts.join(small(pairs.select("chunk_id").distinct()), "chunk_id", "left_semi")
        held = query.join(pairs, "query_id").join(posts.select("chunk_id", "term"), ["chunk_id", "term"])
    hit = held.groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("held"))
    return hit.join(small(total), "query_id").select("query_id", "chunk_id", (F.col("held") / F.col("total")).alias("similarity"))


def _piece(text: Column, n: int):
    return lambda i: text.substr(i + 1, F.lit(n))


def alias_expansions(queries: DataFrame, aliases: DataFrame, maximum: int = 8) -> DataFrame:
    """(query_id, alias): other names of the terms a query holds, unless it holds them already; ``aliases(canonical, alias, ord, narrower)``.

    A term is left out where the query holds its ``narrower`` term.
    """
    text = F.lower(F.col("text"))
    # Names stand anywhere in a query, inside words too: every piece of a query as long as some name meets the names.
    named = aliases.withColumn("name", F.lower("canonical")).filter("name <> ''")
    sizes = [r["n"] for r in named.select(F.length("name").alias("n")).distinct().collect()]  # a handful of lengths
    pieces = F.flatten(F.array(*[F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - n, F.lit(0))), _piece(text, n)) for n in sizes])) if sizes else F.array().cast("array<string>")
    met = queries.select("query_id", "text", F.explode(F.array_distinct(pieces)).alias("name")).join(small(named), "name")
    held = met.filter(~F.coalesce(F.contains(text, F.lower("narrower")), F.lit(False)))
    new = held.filter(~F.contains(text, F.lower("alias"))).groupBy("query_id", "alias").agg(F.min("ord").alias("ord"))
    return new.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "alias"))).filter(F.col("rank") <= maximum)


def all_tags(chunks: DataFrame) -> DataFrame:
    """(tag, n) over the array column ``tags``."""
    return chunks.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tag_portion(chunks: DataFrame, smooth: int = 1000) -> DataFrame:
    """(tag, n, portion): (n + 1) / (all + smooth)."""
    tags = all_tags(chunks)
    total = tags.agg(F.sum("n").alias("total"))
    return tags.join(F.broadcast(total)).select("tag", "n", ((F.col("n") + 1) / (F.col("total") + smooth)).alias("portion"))


#: Characters of chunks, and keys, of one block.
BLOCK_TEXT, BLOCK_KEYS = 1 << 26, 1 << 16


def matched_tags(terms: DataFrame, chunks: DataFrame, key: str, min_match: int = 1) -> DataFrame:
    """(key, tag, c): chunks with the tag that hold ``min_match`` of the key's ``terms(key, term)``; ``chunks(chunk_id, tokens, tags[, content])``.

    Blocks of keys and of chunks meet in a task, which sends on a count per key
    and tag: no pair of key and chunk is ever a row.
    """
    spark = chunks.sparkSession
    keys = terms.filter(F.col(key).isNotNull() & F.col("term").isNotNull()).groupBy(key).agg(F.collect_set("term").alias("terms"))
    words = chunks.filter("chunk_id is not null").select("chunk_id", F.array_distinct("tokens").alias("tokens"), "tags")
    # The text, where it is there, is measured without cutting it into tokens.
    length = F.length("content") if "content" in chunks.columns else F.length(F.array_join("tokens", " "))
    size = chunks.agg(F.sum(length)).first()[0] or 0
    width = max(spark.sparkContext.defaultParallelism, -(-size // BLOCK_TEXT))
    deep = -(-terms.select(key).distinct().count() // BLOCK_KEYS) or 1
    everywhere = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    words = words.select("*", F.pmod(F.xxhash64("chunk_id"), F.lit(width)).cast("int").alias("cb"), everywhere(deep, "kb"))
    keys = keys.select("*", F.pmod(F.xxhash64(key), F.lit(deep)).cast("int").alias("kb"), everywhere(width, "cb"))
    kinds = f"{key} {terms.schema[key].dataType.simpleString()}, tag {chunks.schema['tags'].dataType.elementType.simpleString()}, c long"

    def count(k: pa.Table, c: pa.Table) -> pa.Table:
        k, c = k.combine_chunks(), c.combine_chunks()
        one = lambda table, name: table.column(name).combine_chunks()
        if not k.num_rows or not c.num_rows:
            return pa.table([k.column(key).slice(0, 0), pa.array([], pa.string()), pa.array([], pa.int64())], [key, "tag", "c"])
        number, tag, n = block_matches(one(k, key), one(k, "terms"), one(c, "chunk_id"), one(c, "tokens"), one(c, "tags"), min_match)
        return pa.table([k.column(key).take(pa.array(number)), tag, pa.array(n)], [key, "tag", "c"])

    found = keys.groupBy("cb", "kb").cogroup(words.groupBy("cb", "kb")).applyInArrow(count, kinds)
    return found.groupBy(key, "tag").agg(F.sum("c").alias("c"))


def tag_lift(terms: DataFrame, chunks: DataFrame, key: str, min_match: int = 1, top: int = 3, smooth: int = 1000, floor: int = 0) -> DataFrame:
    """(key, tag, lift): tags of the chunks that hold enough of a key's ``terms(key, term)``, against their share in the corpus.

    lift = round(0.1 (c + 1) / (all c + smooth) / max(1e-6, portion)), at least
    ``floor``; without a floor only lifts over 0 stay; the ``top`` per key.
    """
    tagged = matched_tags(terms, chunks, key, min_match)
    share = tagged.withColumn("sum_c", F.sum("c").over(Window.partitionBy(key))).join(small(tag_portion(chunks, smooth).select("tag", "portion")), "tag")
    lift = F.round(0.1 * (F.col("c") + 1) / (F.col("sum_c") + smooth) / F.greatest(F.col("portion"), F.lit(1e-6))).cast("long")
    lift = F.greatest(lift, F.lit(floor).cast("long")) if floor else lift
    out = share.select(key, "tag", lift.alias("lift")).filter("lift > 0")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("lift"), "tag"))).filter(F.col("rank") <= top)


def rank_feature_score(query_tags: DataFrame, chunk_tags: DataFrame, pagerank: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): ten times the cosine of tag weights plus the chunk's pagerank; ``*_tags(…, tag, weight)``."""
    qn = query_tags.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("qn"))
    cn = chunk_tags.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("cn"))
    dot = query_tags.select("query_id", "tag", F.col("weight").alias("qw")).join(chunk_tags, "tag").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("dot"))
    joined = dot.join(qn, "query_id").join(cn, "chunk_id").join(pagerank, "chunk_id", "left")
    return joined.select("query_id", "chunk_id", (10 * F.col("dot") / (F.col("qn") * F.col("cn")) + F.coalesce("pagerank", F.lit(0))).alias("score"))
