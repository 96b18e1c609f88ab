"""Exact substring deduplication with fixed-block anchors.

Every document's non-overlapping reference blocks of ``block`` words are an
index that all rolling windows of the same length probe.  A repeat of
``window`` >= 2 * block - 1 words holds a whole reference block on either side,
so probes that meet a block elsewhere anchor every repeat.  Hits are extended to
maximal exact repeats: around each anchor all ``window``-word sequences are
compared with those around the other anchors, and runs of repeated ones merge.

Hashes travel in packed arrays, one per text piece and shard of the hash range;
a hash that occurs often in a piece is sent once, so that a passage found in a
third of all documents stays one entry per piece.  A piece also decides at once
what repeats inside it.

Tasks take one shard of hashes or documents at a time from sorted rows, so memory
follows the size of a shard; there are as many as shuffle partitions.  Words are
compared by hash: 64 bits for whole windows.

Rows are told apart by doc_id where that is unique, else (null or repeated ids
with different texts) by a hash of their text, and equal texts share their hits.

Defined cases: null and blank texts have no word and nothing to remove; texts
shorter than a window are kept whole; all copies of a repeat are removed, ties
do not arise; repeated rows repeat each other's windows; a null doc_id is treated
like any other; very long texts travel in parts; an empty table gives an empty
result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.store import shuffle_width, text_key
from sievelight.llm.tokens import SPACES, Words, mix, pieces, split_words

#: Bytes of text in a piece.
PIECE = 4 << 20
#: Packed rows: entries (kind 0) go to the shard of their hashes, hits (kind 1, no hashes) to the shard of their documents.
ENTRY = "kind int, shard int, ids binary, counts binary, places binary, hashes binary, flags binary"
FIELDS = ["kind", "shard", "ids", "counts", "places", "hashes", "flags"]
HIT = "id long, places array<int>"


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal significance side by side: small numbers leave runs of zeros, which shuffle files compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _runs(ids: np.ndarray, places: np.ndarray):
    """(ids, start offsets) of the runs of equal consecutive ids; a new run also starts where places fall."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (places[1:] <= places[:-1])
    at = np.flatnonzero(new)
    return ids[at], at


def _pack(shards: int, shard: np.ndarray, ids: np.ndarray, places: np.ndarray, hashes: np.ndarray | None = None, flags: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per shard with entries, or with hits where there are no hashes; both come in document order."""
    order = np.argsort(shard.astype(np.uint16 if shards < 65536 else np.uint32), kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=shard.dtype))
    rows = []
    for s in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[s] : cuts[s + 1]]
        run_ids, starts = _runs(ids[at], places[at])
        counts = np.diff(np.append(starts, len(at))).astype(np.uint32)
        steps = np.diff(places[at], prepend=0).astype(np.int64)
        steps[starts] = places[at][starts]
        row = (int(hashes is None), int(s), planes(np.diff(run_ids, prepend=0)), planes(counts), planes(steps.astype(np.uint32)))
        rows.append((*row, None, None) if hashes is None else (*row, hashes[at].tobytes(), np.packbits(flags[at]).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i in range(7)], FIELDS)


def _by_hash(shards: int, ids, places, hashes, flags, wide: bool) -> pa.RecordBatch:
    shard = (hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    # Narrow entries: the shard number stands for the upper bits, the lower 32 travel.
    return _pack(shards, shard, ids, places, hashes if wide else hashes.astype(np.uint32), flags)


def _by_document(shards: int, ids: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    return _pack(shards, mix(ids.astype(np.uint64)) % np.uint64(shards), ids, places)


def _places(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, places) of a packed row."""
    counts = unplanes(r["counts"], np.uint32)
    steps = unplanes(r["places"], np.uint32).astype(np.int64)
    sums = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    return np.repeat(np.cumsum(unplanes(r["ids"], np.int64)), counts), sums - np.repeat(sums[first] - steps[first], counts)


def _unpack(rows: list[dict], wide: bool):
    parts = []
    for r in rows:
        hashes = np.frombuffer(r["hashes"], np.uint64 if wide else np.uint32)
        flags = np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=len(hashes)).astype(bool)
        parts.append((*_places(r), hashes, flags))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _local(hashes: np.ndarray, flags: np.ndarray):
    """(first entries, entries of hashes that occur twice or more); flags of equal hashes are joined in place."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = np.maximum.reduceat(flags[order].astype(np.uint8), starts).astype(bool)
    counts = np.diff(np.append(starts, len(order)))
    firsts = order[starts]
    flags[firsts] = joined
    twice = np.sort(order[np.repeat(counts > 1, counts)])
    return np.sort(firsts), twice


class _Shards:
    """Rows of batches sorted by shard, gathered one shard after the other."""

    def __init__(self):
        self.held: list[dict] = []

    def full(self, rows: list[dict]):
        """Add ``rows``; the shards that are complete now."""
        for r in rows:
            if self.held and r["shard"] != self.held[0]["shard"]:
                yield self.held
                self.held = []
            self.held.append(r)

    def last(self):
        if self.held:
            yield self.held


def _gather(batches):
    """Per document shard: one row per document with its different places."""
    shards = _Shards()
    fields = ["shard", "ids", "counts", "places"]
    for rows in chain(chain.from_iterable(shards.full(batch.select(fields).to_pylist()) for batch in batches), shards.last()):
        ids, places = (np.concatenate(x) for x in zip(*map(_places, rows), strict=True))
        order = np.lexsort((places, ids))
        ids, places = ids[order], places[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])
        ids, places = ids[new], places[new]
        run_ids, starts = np.unique(ids, return_index=True)
        offsets = np.append(starts, len(ids)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(run_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(places.astype(np.int32)))], ["id", "places"])


def _meet(shards: int, wide: bool):
    """Per hash shard: entries whose hash occurs twice or more with a flagged one among them become hits; hits pass."""

    def hits_of(rows: list[dict]):
        ids, places, hashes, flags = _unpack(rows, wide)
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(order)))
        hit = (counts > 1) & np.maximum.reduceat(flags[order].astype(np.uint8), starts).astype(bool)
        at = order[np.repeat(hit, counts)]
        if len(at):
            yield _by_document(shards, ids[at], places[at])

    def run(batches):
        complete = _Shards()
        for batch in batches:
            hits = pc.equal(batch.column("kind"), 1)
            if pc.any(hits).as_py():
                yield pa.RecordBatch.from_arrays(batch.filter(hits).columns, FIELDS)  # nullable fields, as in packed rows
            for rows in complete.full(batch.filter(pc.invert(hits)).to_pylist()):
                yield from hits_of(rows)
        for rows in complete.last():
            yield from hits_of(rows)

    return run


def matched_places(packed: DataFrame, shards: int, wide: bool) -> DataFrame:
    """(id, places) from packed entries and hits: entries meet by hash, then hits gather by document."""

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(shards, "shard").sortWithinPartitions("shard")

    return dealt(dealt(packed).mapInArrow(_meet(shards, wide), ENTRY)).mapInArrow(_gather, HIT)


def _word_indices(words: Words, texts: np.ndarray, places: np.ndarray) -> np.ndarray:
    return words.first[texts] + places


def repeated_windows(docs: DataFrame, window: int = 35, block: int = 18) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` as (doc_id, n_words, n_removed, kept_sha256)."""
    if window < 2 * block - 1:
        raise ValueError("window must hold a whole block: window >= 2 * block - 1")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    texts = docs.groupBy("doc_id").agg(F.min(text_key()).alias("a"), F.max(text_key()).alias("b"))
    unique = texts.filter("doc_id IS NULL OR a <> b").isEmpty()
    docs = docs.withColumn("id", F.col("doc_id") if unique else text_key())
    shards = shuffle_width(spark)

    # 1. Reference blocks and probes, by hash: anchors are probes or blocks that meet elsewhere.
    def probes(batches):
        for batch in pieces(batches, "text", PIECE):
            words = split_words(batch.column("text"), SPACES)
            ids = batch.column("id").to_numpy()
            at, hashes = words.grams(words.hashes(), block)
            if not len(at):
                continue
            texts, places = words.place(at)
            # Only documents with a whole window can hold or meet a repeat.
            long_ = words.counts[texts] >= window
            at, hashes, texts, places = at[long_], hashes[long_], texts[long_], places[long_]
            aligned = places % block == 0
            first, twice = _local(hashes, aligned)
            if len(twice):
                yield _by_document(shards, ids[texts[twice]], places[twice])
            if len(first):
                yield _by_hash(shards, ids[texts[first]], places[first], hashes[first], aligned[first], wide=False)

    anchors = matched_places(docs.mapInArrow(probes, ENTRY), shards, wide=False)

    # 2. Hashes of the windows around the anchors.  Both joins take the same texts by id, which are shuffled once.
    def extend(batches):
        for batch in pieces(batches, "text", PIECE):
            anchors_of = batch.column("places")
            lengths = pc.fill_null(pc.list_value_length(anchors_of), 0).to_numpy(zero_copy_only=False)
            if not lengths.any():
                continue
            words = split_words(batch.column("text"), SPACES)
            ids = batch.column("id").to_numpy()
            texts = np.repeat(np.arange(len(ids)), lengths)
            anchored = np.zeros(len(words.starts) + 1, np.int32)
            anchored[_word_indices(words, texts, anchors_of.flatten().to_numpy())] = 1
            reach = np.concatenate(([0], np.cumsum(anchored)))
            at, hashes = words.grams(words.hashes(), window)
            near = reach[at + window - block + 1] > reach[at]  # an anchor starts where the window still holds its block
            at, hashes = at[near], hashes[near]
            texts, places = words.place(at)
            flags = np.ones(len(at), bool)
            first, twice = _local(hashes, flags)
            if len(twice):
                yield _by_document(shards, ids[texts[twice]], places[twice])
            if len(first):
                yield _by_hash(shards, ids[texts[first]], places[first], hashes[first], flags[first], wide=True)

    entries = docs.join(anchors, "id", "left").select("id", "doc_id", "text", "places").mapInArrow(extend, ENTRY)

    # 3. Windows that repeat, and what they cover.
    verified = matched_places(entries, shards, wide=True).withColumnRenamed("places", "repeats")

    def finish(batches):
        for batch in pieces(batches, "text", PIECE):
            words = split_words(batch.column("text"), SPACES)
            repeats = batch.column("repeats")
            removed, digests = [], []
            for i in range(batch.num_rows):
                n, digest = _kept(words, i, repeats[i].values if repeats[i].is_valid else None, window)
                removed.append(n)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    judged = docs.join(verified, "id", "left").select("id", "doc_id", "text", "repeats")
    return judged.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept(words: Words, text: int, repeats, window: int = 0) -> tuple[int, str]:
    """Words removed from one text, and the digest of the words that stay."""
    a, b = int(words.first[text]), int(words.first[text + 1])
    parts = words.data[words.starts[a] : words.ends[b - 1]].tobytes().split() if b > a else []
    if repeats is not None and len(repeats):
        steps = np.zeros(b - a + 1, np.int32)
        starts = np.unique(repeats.to_numpy())
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + window, -1)
        parts = list(compress(parts, (np.cumsum(steps)[:-1] == 0).tolist()))
    return b - a - len(parts), hashlib.sha256(b" ".join(parts)).hexdigest()


#: DuckDB SQL for the query over ``documents``.
ORACLE = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM cut WHERE len(w) >= 35)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + d AS j FROM repeated, (SELECT unnest(range(0, 35)) AS d)
), kept AS (
  SELECT c.doc_id, string_agg(c.x, ' ' ORDER BY c.j) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM cut) c
  LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.j = g.j WHERE g.j IS NULL GROUP BY c.doc_id
)
SELECT cut.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM cut LEFT JOIN kept ON cut.doc_id = kept.doc_id
"""
