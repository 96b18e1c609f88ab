"""SimHash near-duplicates: fingerprints linked by BK-trees over shards.

With ``radius`` differing bits and radius + picked blocks, two linked
fingerprints agree in at least ``picked`` blocks, so the blocks' combinations are
shards that lose no link.  The number of blocks follows the number of distinct
fingerprints: few blocks while shards stay small, so that a fingerprint has few
shards and a shard holds a tree worth pruning.  Each shard's BK-tree (children
keyed by their Hamming distance to the parent) is probed by the shard's members,
and only edges within the radius of the probe's distance are followed.

Shards of up to ``SHARD_LIMIT`` members become a tree in the task that gathers
them.  Crowded shards become several trees of that size each: while all their
nodes together stay under ``BROADCAST_NODES`` (they are counted first), these
trees are broadcast and probed where the fingerprints lie; beyond it, the members
of crowded shards are cut into finer shards, and at the finest cut trees and
probes meet by a shuffle.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; repeated rows share their fingerprint and component; a null doc_id
takes part and is never a component's smallest id unless all are null; very long
texts are read whole, in bounded steps; an empty table gives an empty result;
extra columns, whatever their names, are ignored (``deduplicate`` keeps them).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.graphs import connected_components, keep_one
from sievelight.llm.store import materialize, shuffle_width, text_key
from sievelight.llm.tokens import pieces

#: Fingerprints in one tree.
SHARD_LIMIT = 1024
#: Members that a shard holds on average at most before finer shards are cut.
SHARD_TARGET = 128
#: Blocks of the coarsest cut are radius + 1, those of the finest radius + FINEST.
FINEST = 4
#: Nodes of all broadcast trees together, 8 bytes each.
BROADCAST_NODES = 20_000


def _fingerprint(text: bytes, k: int) -> int:
    words = text.lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= k:
        return xxhash.xxh64_intdigest(line, 42)
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in spans], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) per row of ``docs(doc_id, text)``; fp holds the 64 bits as a long."""

    def run(batches):
        for batch in pieces(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = np.array([_fingerprint(t or b"", words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Nodes of distinct fingerprints; a child's key is its Hamming distance to the parent."""

    def __init__(self, values=()):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.visited = 0
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        """Add ``value`` where it is new."""
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Values at ``radius`` bits or fewer; ``visited`` counts the nodes looked at."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            self.visited += 1
            node = self.values[at]
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            kids = self.children[at]
            if kids:
                for key in range(d - radius, d + radius + 1):
                    if key in kids:
                        stack.append(kids[key])
        return found


class _Links:
    """Links that connect what was found: a link inside what is connected already is left out."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.pairs: list[tuple[int, int]] = []

    def _root(self, v: int) -> int:
        parent = self.parent
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    def add(self, a: int, b: int) -> None:
        x, y = self._root(a), self._root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.pairs.append((a, b))

    def batch(self) -> pa.RecordBatch:
        columns = np.array(self.pairs, np.uint64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns], ["a", "b"])


def _unsigned(values) -> list[int]:
    return [v & (2**64 - 1) for v in values]


def _probe(tree: BKTree, probes: list[int], radius: int, out: _Links) -> None:
    for value in probes:
        for other in tree.within(value, radius):
            if other != value:
                out.add(value, other)


def masks(blocks: int, picked: int) -> list[int]:
    """Bit masks of all choices of ``picked`` of ``blocks`` nearly equal bit blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(block, picked)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def picked_blocks(n: int, radius: int, target: int = SHARD_TARGET) -> int:
    """Blocks that a shard has in common, so that ``n`` fingerprints give ``target`` members a shard or fewer."""
    for picked in range(1, FINEST + 1):
        if n <= target << (64 * picked // (radius + picked)):
            return picked
    return FINEST


def _within_shards(radius: int):
    def run(batches):
        for batch in batches:
            found = _Links()
            for members in batch.column("fps").to_pylist():
                members = sorted(_unsigned(members))
                _probe(BKTree(members), members, radius, found)
            yield found.batch()

    return run


def _broadcast_trees(fps: DataFrame, crowded: DataFrame, chosen: list[int], radius: int) -> DataFrame:
    """Links of the members of ``crowded(c, members)`` shards, whose trees are sent to every task."""
    trees: dict[tuple[int, int], list[BKTree]] = {}
    for row in crowded.collect():  # BROADCAST_NODES members at most
        members = sorted(_unsigned(row["members"]))
        shard = (row["c"], members[0] & chosen[row["c"]])
        trees.setdefault(shard, []).extend(BKTree(members[i : i + SHARD_LIMIT]) for i in range(0, len(members), SHARD_LIMIT))
    sent = fps.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        asked = sorted({c for c, _ in sent.value})
        for batch in batches:
            found = _Links()
            for value in _unsigned(batch.column("fp").to_pylist()):
                for c in asked:
                    for tree in sent.value.get((c, value & chosen[c]), ()):
                        _probe(tree, [value], radius, found)
            yield found.batch()

    return fps.mapInArrow(run, "a long, b long")


def _shuffled_trees(shards: DataFrame, crowded: DataFrame, radius: int) -> DataFrame:
    """Links of crowded shards beyond broadcasting: every member probes its own tree of the shard and all lower ones."""
    wide = shards.join(crowded, ["c", "bits"]).withColumn("trees", F.ceil(F.col("n") / SHARD_LIMIT).cast("int"))
    wide = wide.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    probes = wide.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("own"))))
    # A tree's probes are dealt over tasks too, so that the first trees of a shard are no hot spots.
    probes = probes.withColumn("deal", F.when(F.col("tree") == F.col("own"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("fp", "tree"), F.col("trees")).cast("int")))
    nodes = probes.filter("deal < 0").groupBy("c", "bits", "tree").agg(F.first("trees").alias("trees"), F.collect_list("fp").alias("nodes"))
    nodes = nodes.withColumn("deal", F.explode(F.sequence(F.lit(-1), F.col("trees") - 1))).drop("trees")
    asked = probes.groupBy("c", "bits", "tree", "deal").agg(F.collect_list("fp").alias("asks"))

    def run(batches):
        for batch in batches:
            found = _Links()
            for members, asks in zip(batch.column("nodes").to_pylist(), batch.column("asks").to_pylist(), strict=True):
                _probe(BKTree(sorted(_unsigned(members))), sorted(_unsigned(asks)), radius, found)
            yield found.batch()

    return nodes.join(asked, ["c", "bits", "tree", "deal"]).select("nodes", "asks").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = 4, picked: int = 0) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps(fp)`` that connect all that lie within ``radius`` bits."""
    picked = picked or picked_blocks(fps.count(), radius)
    chosen = masks(radius + picked, picked)
    shard = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(chosen)])
    # A table of fingerprints is a small file, but its rows multiply here: deal it over all tasks first.
    dealt = fps.select("fp").repartition(shuffle_width(fps.sparkSession), "fp")
    shards = dealt.select("fp", F.explode(shard).alias("s")).select("s.c", "s.bits", "fp")
    counted = shards.groupBy("c", "bits").agg(F.count("*").alias("n"))
    crowded = materialize(counted.filter(F.col("n") > SHARD_LIMIT))
    nodes = crowded.agg(F.sum("n")).first()[0] or 0
    plain = shards
    if nodes:
        plain = shards.join(crowded.select("c", "bits"), ["c", "bits"], "left_anti")
    plain = plain.groupBy("c", "bits").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    found = plain.mapInArrow(_within_shards(radius), "a long, b long")
    if not nodes:
        return found
    if nodes <= BROADCAST_NODES:
        members = shards.join(crowded, ["c", "bits"]).groupBy("c", "bits").agg(F.collect_list("fp").alias("members"))
        return found.unionByName(_broadcast_trees(dealt, members.select("c", "members"), chosen, radius))
    if picked < FINEST:
        inside = materialize(shards.join(crowded.select("c", "bits"), ["c", "bits"], "left_semi").select("fp").distinct())
        return found.unionByName(links(inside, radius, picked + 1))
    return found.unionByName(_shuffled_trees(shards, crowded, radius))


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id among linked documents."""
    rows = materialize(fingerprints(docs, words))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(classes.select("fp"), radius))
    grouped = materialize(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    lowest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp) -> "F.Column":
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest doc_id (null ones last)."""
    hashed = docs.select(text_key().alias("key"), "text")
    texts = materialize(fingerprints(hashed.select(F.col("key").alias("doc_id"), "text"), words).distinct())
    classes = materialize(texts.select("fp").distinct())
    roots = connected_components(links(classes, radius))
    named = texts.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return keep_one(docs, materialize(named.select(F.col("doc_id").alias("node"), F.coalesce("root", "fp").alias("root"))))
