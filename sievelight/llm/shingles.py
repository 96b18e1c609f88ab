"""Near copies by shared 5-word shingles: texts at similarity 0.8 or more, linked into groups.

Similarity is Jaccard's, over the distinct hashes of runs of five words, and every
link is checked on both whole sets.  With all shingles in one fixed order, sets of
similarity 4/5 share one of their first n - ceil(4n/5) + 1, so texts that share
such a prefix shingle are the candidates:

1. SimHash fingerprints of the candidates joined by BK-trees link most copies;
2. in large groups, lots of members meet inside tasks, each of which sends on a
   forest of its closest pairs across components: fewer rows than members;
3. all pairs that are left across components, in groups of every size.

The first two steps are for speed alone: they leave few components, so that few
pairs are left.  The third makes the result exact.  It drops pairs by three bounds that no
similar pair breaks (sizes, places of the shared shingle, parities of the shingles
per hash bucket) inside the join, compares the sets of the best pairs first, and of
the rest after the components are merged, until no pair across two components is
left unverified.

The order is by hash, with shingles that many texts share at the end.  They are
estimated from an eighth of the texts, and which ones are taken changes the
number of pairs to check but not which pairs are similar.

Defined cases: words are lower-cased (ASCII) and end at ASCII blanks; a text of
fewer than five words has itself as its one shingle; null, empty and blank texts
are alike; very long texts are read whole; equal texts are one; an empty table
gives an empty result; extra columns, whatever their names, are kept; null and
repeated doc_ids lose no text (see ``graphs.keep_one``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm import bktree
from sievelight.llm.graphs import connected_components, keep_one
from sievelight.llm.store import drop, materialize, text_key
from sievelight.llm.tokens import SPACES, pieces, split_words

WORDS = 5
#: Shingles that come last in the order: held by HOT or more texts of every SAMPLE-th; the HOT_LIMIT most frequent of them at most.
SAMPLE, HOT, HOT_LIMIT = 8, 3, 500_000
#: Longs of a text's parity sketch, one bit for each bucket of its shingles.
LONGS = 8
#: Sizes of one class differ by this factor at most; similar texts (5/4 at most) are in one class or in neighbours.
CLASS = 1.26
#: Members of a group that one task compares with all the others.
BLOCK = 2048
#: Texts that share a shingle, from which on their group is large; members of it that meet in one task, and times that they are dealt anew.
LARGE, LOT, LOTS = 64, 256, 2
#: Pairs of one text are checked in so many groups at most.
DEALS = 4096
#: Times that the best pair of each text and component goes first, before all that are left.
BEST = 2
#: Candidate keys up to which they are broadcast to the texts; more of them meet the texts by a shuffle.
BROADCAST_KEYS = 500_000
#: Rows that say where a set must go, up to which they are broadcast to the sets; more of them meet the sets by a shuffle.
BROADCAST_NEEDS = 200_000


def shingles(texts: pa.Array, k: int = WORDS):
    """Sorted distinct 64-bit shingle hashes, as longs, of each text."""
    words = split_words(texts, SPACES, lower=True)
    hashes = words.hashes()
    at, grams = words.grams(hashes, k)
    grams, bounds, first = grams.view(np.int64), np.searchsorted(at, words.first), words.first
    for d, n in enumerate(words.counts.tolist()):
        if n >= k:
            yield np.unique(grams[bounds[d] : bounds[d + 1]])
        else:
            yield np.array([xxhash.xxh64_intdigest(hashes[first[d] : first[d + 1]].tobytes())], np.uint64).view(np.int64)


def prefixes(docs: DataFrame, hot: list[int]) -> DataFrame:
    """(tok, key, n, pos): the first shingles of each text of ``docs(key, text)`` in the order with ``hot`` ones last."""
    last = np.array(sorted(hot), np.int64)

    def run(batches):
        seen = set()  # copies of a text in one task are one
        for batch in pieces(batches, "text"):
            new = [k not in seen and not seen.add(k) for k in batch.column("key").to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            if not batch.num_rows:
                continue
            toks, keys, sizes, places = [], [], [], []
            for key, held in zip(batch.column("key").to_pylist(), shingles(batch.column("text")), strict=True):
                n = len(held)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, held), len(last) - 1)] == held
                    held = np.concatenate((held[~late], held[late]))
                m = n - (4 * n + 4) // 5 + 1
                toks.append(held[:m])
                keys.append(np.full(m, key, np.int64))
                sizes.append(np.full(m, n, np.int32))
                places.append(np.arange(1, m + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (toks, keys, sizes, places)], ["tok", "key", "n", "pos"])

    return docs.select("key", "text").mapInArrow(run, "tok long, key long, n int, pos int")


def shared_prefixes(docs: DataFrame) -> DataFrame:
    """The different rows of ``prefixes`` whose shingle is in the prefix of another text, too."""
    some = prefixes(docs.filter(F.pmod("key", F.lit(SAMPLE)) == 0), []).select("tok", "key").distinct()
    hot = some.groupBy("tok").agg(F.count("*").alias("c")).filter(F.col("c") >= HOT).orderBy(F.desc("c"), "tok").limit(HOT_LIMIT)
    rows = prefixes(docs, hot.select("tok").toArrow().column("tok").to_pylist())
    group = Window.partitionBy("tok")
    rows = rows.withColumn("low", F.min("key").over(group)).withColumn("high", F.max("key").over(group)).filter("low <> high").drop("low", "high").distinct()
    return rows


def _packed(held: np.ndarray) -> bytes:
    """40 bits of each hash: two sets of 20,000 shingles meet by chance in 0.0004 of them."""
    return np.ascontiguousarray(held).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    out = np.zeros((len(held) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(held, np.uint8).reshape(-1, 5)
    return np.unique(out.view(np.uint64).ravel())


def _parities(held: np.ndarray) -> np.ndarray:
    """LONGS longs: a bit is set where an odd number of the shingles fall into its bucket.

    Each shingle that one of two sets has alone turns one bit, so the sets differ in as many shingles as their bits, or more.
    """
    odd = np.bincount((held.view(np.uint64) % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """(key, fp, held, parity0, ...) of each different text of ``docs(key, text)``: its fingerprint, packed shingles and parity sketch."""
    parities = [f"parity{i}" for i in range(LONGS)]

    def run(batches):
        for batch in pieces(batches, "text"):
            sets = list(shingles(batch.column("text")))
            held, odd = [_packed(x) for x in sets], np.array([_parities(x) for x in sets], np.int64).reshape(-1, LONGS)
            fps = [bktree._fingerprint(t or b"", WORDS) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(held, pa.binary()), *[pa.array(odd[:, i]) for i in range(LONGS)]], ["key", "fp", "held", *parities])

    return docs.dropDuplicates(["key"]).select("key", "text").mapInArrow(run, "key long, fp long, held binary, " + ", ".join(f"{c} long" for c in parities))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` of keys of ``sets(key, held)`` whose shingle sets have similarity 4/5 or more.

    A text's pairs are dealt by the other text, so that those of a text with many
    partners do not gather in one task; its set travels once to each deal.  Sets
    without a pair do not travel while pairs are few.
    """
    dealt = materialize(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(DEALS)).cast("int").alias("deal")))
    needs = dealt.select(F.col("b").alias("key"), "a", "deal").unionByName(dealt.select(F.col("a").alias("key"), "a", "deal").distinct())
    few = 2 * dealt.limit(BROADCAST_NEEDS + 1).count() <= BROADCAST_NEEDS
    groups = sets.select("key", "held").join(F.broadcast(needs) if few else needs, "key").groupBy("a", "deal").agg(F.collect_list(F.struct("key", "held")).alias("members"))

    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for i in range(batch.num_rows):
                a = batch.column("a")[i].as_py()
                held = {m["key"]: m["held"] for m in batch.column("members")[i].as_py()}
                one = _unpacked(held.pop(a))
                for b, other in held.items():
                    other = _unpacked(other)
                    if 9 * len(np.intersect1d(one, other, assume_unique=True)) >= 4 * (len(one) + len(other)):
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_a, out_b)], ["a", "b"])

    found = materialize(groups.mapInArrow(run, "a long, b long"))
    drop(dealt)
    return found


def _pairs(df: DataFrame, one: str, other: str) -> DataFrame:
    return df.filter(F.col(one) != F.col(other)).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))


def components(docs: DataFrame) -> DataFrame:
    """(node, root) for the keys of ``docs(key, text)`` that similar pairs connect with others; equal texts have equal keys."""
    shared = materialize(shared_prefixes(docs))
    keys = materialize(shared.select("key").distinct())
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    sets = materialize(described(docs.join(F.broadcast(keys) if few else keys, "key", "left_semi")))
    # 1. Equal and near fingerprints.
    firsts = materialize(sets.groupBy("fp").agg(F.min("key").alias("first")))
    alike = sets.join(firsts, "fp").select(F.col("key").alias("x"), F.col("first").alias("y"))
    near = bktree.links(firsts.select("fp")).join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    tried = materialize(_pairs(alike.unionByName(near.select("x", "y")), "x", "y").distinct())
    roots = merged(None, similar(tried, sets))
    # 2. Closest pairs in large groups.
    for turn in range(LOTS):
        pairs = materialize(closest(shared, sets, roots, turn).join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            drop(pairs)
            break
        before = roots, tried
        roots, tried = merged(roots, similar(pairs, sets)), materialize(tried.unionByName(pairs))
        for table in (*before, pairs):
            drop(table)
    # 3. All pairs that are left.
    rest = materialize(remaining(shared, sets, roots).join(tried, ["a", "b"], "left_anti"))
    for table in (shared, tried, firsts):
        drop(table)
    for turn in range(BEST + 1):
        ends = rest
        for end in "ab":
            ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
        ends = ends.withColumn("a_root", F.coalesce("a_root", "a")).withColumn("b_root", F.coalesce("b_root", "b")).filter("a_root <> b_root")
        if turn < BEST:
            pairs = ends.groupBy("a", "b_root").agg(F.min(F.struct("gap", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        else:
            pairs = ends.select("a", "b")
        pairs = materialize(pairs)
        if pairs.isEmpty():
            break
        before, roots = roots, merged(roots, similar(pairs, sets))
        read, rest = rest, materialize(ends.select("a", "b", "gap").join(pairs, ["a", "b"], "left_anti"))
        for table in (before, read, pairs):
            drop(table)
    for table in (rest, sets, keys):
        drop(table)
    return roots


def _forest(members: pa.Table) -> pa.Table:
    """(a, b) of a lot of ``members(key, root, n, parity0, ...)``: closest first, pairs that no bound of ``remaining`` rules out and that connect its components."""
    column = lambda name: members.column(name).to_numpy()
    key, n, (_, root) = column("key"), column("n").astype(np.int64), np.unique(column("root"), return_inverse=True)
    gap = np.zeros((len(key), len(key)), np.int64)
    for i in range(LONGS):
        odd = column(f"parity{i}").view(np.uint64)
        gap += np.bitwise_count(odd[:, None] ^ odd[None, :])
    fit = (root[:, None] < root[None, :]) & (9 * gap <= n[:, None] + n[None, :]) & (5 * np.minimum.outer(n, n) >= 4 * np.maximum.outer(n, n))
    x, y = np.nonzero(fit)
    near = np.lexsort((key[y], key[x], gap[x, y]))
    x, y, links, kept = x[near], y[near], bktree._Links(), []
    for at, (i, j) in enumerate(zip(root[x].tolist(), root[y].tolist(), strict=True)):
        links.add(i, j)
        if len(links.pairs) > len(kept):
            kept.append(at)
    kept = np.array(kept, np.int64)
    return pa.table([np.minimum(key[x[kept]], key[y[kept]]), np.maximum(key[x[kept]], key[y[kept]])], ["a", "b"])


def closest(shared: DataFrame, sets: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """(a, b): pairs across components of large groups, fewer than members; which ones depends on ``turn``.

    A text takes part in one of its large groups, which texts with the same
    groups choose alike, and there in one lot of about LOT members.
    """
    large = shared.groupBy("tok").agg(F.count("*").alias("c")).filter(F.col("c") >= LARGE)
    one = shared.join(large, "tok").groupBy("key").agg(F.first("n").alias("n"), F.max_by(F.struct("tok", "c"), F.struct(F.xxhash64("tok", F.lit(turn)), "tok")).alias("group"))
    one = one.select("key", "n", "group.tok", F.pmod(F.xxhash64("key", F.lit(turn)), F.ceil(F.col("group.c") / LOT)).alias("lot"))
    members = _named(one, roots).join(sets.drop("fp", "held"), "key")
    return members.groupBy("tok", "lot").applyInArrow(_forest, "a long, b long").distinct()


def remaining(shared: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, gap): different pairs of keys in one group, but in two components, that no bound keeps from being similar; gap is the number of parities that differ.

    A group is cut by size class: a text meets those of its own and of the next
    larger class; groups without any of the larger one are left out.  One side of a large class is dealt over blocks and the other
    travels to each of them; pairs are tested inside the join, so only those that
    pass come out of it.
    """
    parities = [f"parity{i}" for i in range(LONGS)]
    named = _named(shared, roots).withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(CLASS))).cast("int"))
    named = named.select("tok", "key", "n", "pos", "root", "class")
    both = named.withColumn("raised", F.lit(0)).unionByName(named.withColumn("class", F.col("class") + 1).withColumn("raised", F.lit(1)))
    met = both.groupBy("tok", "class").agg(F.count("*").alias("c"), F.min("raised").alias("raised"), F.min("root").alias("low"), F.max("root").alias("high"))
    met = met.filter("raised = 0 AND low <> high")
    met = met.select("tok", "class", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    held = sets.select("key", *parities)
    large = named.join(met, ["tok", "class"]).join(held, "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
    small = named.select("tok", "key", "n", "pos", "root", F.posexplode(F.array(F.col("class"), F.col("class") + 1)).alias("raised", "class")).join(met, ["tok", "class"]).join(held, "key")
    small = small.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    same = ["tok", "class", "block"]
    small = small.select([F.col(c).alias(f"{c}_b") for c in (*same, "raised", "key", "n", "pos", "root", *parities)])
    gap = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in parities), F.lit(0))
    sizes = 5 * F.least("n", "n_b") >= 4 * F.greatest("n", "n_b")
    # The first shingle that both sets hold has all others that they share behind it.
    places = 9 * (1 + F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b"))) >= 4 * (F.col("n") + F.col("n_b"))
    # Two texts of one class meet twice.
    once = (F.col("raised_b") > 0) | (F.col("key") < F.col("key_b"))
    apart = (F.col("root") != F.col("root_b")) & once & sizes & places & (9 * gap <= F.col("n") + F.col("n_b"))
    pairs = large.join(small, [*(F.col(c) == F.col(f"{c}_b") for c in same), apart])
    return pairs.select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b"), gap.alias("gap")).distinct()


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots(node, root)`` after ``links(a, b)``: links are taken between the components of their ends, which are few."""
    if roots is None:
        return materialize(connected_components(links))
    ends = links
    for end in "ab":
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    ends = ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b")
    parts = materialize(connected_components(ends))
    moved = roots.join(parts.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return materialize(moved.unionByName(parts.join(roots.select("node"), "node", "left_anti")))


def _named(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """``groups`` with the component of each key; a key without links is its own."""
    return groups.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id, null ones last."""
    roots = components(docs.select(text_key().alias("key"), "text"))
    return keep_one(docs, materialize(roots.select("node", "root")))
