"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Every document is turned once into two short sparse rows, one per view, which are
written out.  Both views are logistic regressions that start from a bounded
sample of labelled rows (``MAX_LABELLED``, by the hash of doc_id).  In each round
both score all other documents, and either hands its ``HANDED`` most confident
ones of each class to the other's training set; the best of every task, then of
all tasks, are taken, so that only these reach the driver.  Each view is then
calibrated on labelled rows kept out of training, and the calibrated views are
combined into one probability that scores all documents.

The text view sees hashed words and character classes; the metadata view sees
language, source, length and line layout, and no word.

Defined cases: null and empty texts have a text view without words; null metadata
is a value of its own; very long texts are read whole, a piece at a time; without
labelled rows of both classes every score is 0.5; ties in confidence go to the
lower key (a hash of text and metadata); repeated rows score alike and are handed
over once; labels of a repeated doc_id count once, for the row with the lowest
key; an empty table gives an empty result; extra columns, whatever their names,
are ignored; a row with a null doc_id is kept and has no label.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.store import materialize
from sievelight.llm.tokens import NON_ALNUM, SPACES, pieces, split_words
from sievelight.llm.toxicity import held_out, labelled_sample

#: Labelled rows that training takes at most.
MAX_LABELLED = 6000
#: Rounds, and rows of each class that a view hands over per round.
ROUNDS, HANDED = 4, 200
#: Hashed word features and character-class features of the text view; hashed features of the metadata view.
WORDS, SHAPES, META = 4096, 8, 256
#: Character classes by byte: symbols, punctuation, digits, capitals, and bytes that start a character.
CLASSES = [np.isin(np.arange(256), [ord(c) for c in chars]) for chars in ("#*$%&|<>", ".,;:!?", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
STARTS = (np.arange(256) & 0xC0) != 0x80


@dataclass
class Sparse:
    """Rows of (slot, value) entries, ``counts`` of them per row."""

    slots: np.ndarray
    values: np.ndarray
    counts: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def pick(self, keep: np.ndarray) -> "Sparse":
        held = keep[self.rows]
        return Sparse(self.slots[held], self.values[held], self.counts[keep])

    def packed(self) -> tuple[pa.Array, pa.Array]:
        """The slots and the values of each row as bytes."""
        slots, values = self.slots.astype(np.uint16), self.values.astype(np.float16)
        cuts = np.concatenate(([0], np.cumsum(self.counts))).tolist()
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return tuple(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (slots, values))

    @staticmethod
    def unpacked(slots: list[bytes], values: list[bytes]) -> "Sparse":
        counts = np.array([len(x) // 2 for x in slots], np.int64)
        return Sparse(np.frombuffer(b"".join(slots), np.uint16).astype(np.int64), np.frombuffer(b"".join(values), np.float16).astype(np.float64), counts)


def text_view(column: pa.Array) -> Sparse:
    """Square-rooted shares of hashed words, then character classes and word statistics of each text."""
    n = len(column)
    words = split_words(column, NON_ALNUM, lower=True)
    at = np.repeat(np.arange(n), words.counts)
    held, times = np.unique(at * WORDS + (words.hashes() & np.uint64(WORDS - 1)).astype(np.int64), return_counts=True)
    shares = np.sqrt(times / np.maximum(words.counts, 1)[held // WORDS])
    raw = split_words(column, SPACES)
    lengths = np.array([len(t) for t in column.fill_null("").cast(pa.binary()).to_pylist()], np.int64)
    ends = np.cumsum(lengths)

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kind[raw.data])))
        return (sums[ends] - sums[ends - lengths]).astype(float)

    size = count(STARTS)
    raw_at, hashes = np.repeat(np.arange(n), raw.counts), raw.hashes()
    order = np.lexsort((hashes, raw_at))
    new = np.ones(len(order), bool)
    new[1:] = (raw_at[order][1:] != raw_at[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    different = np.bincount(raw_at[order][new], minlength=n)
    per_char, per_word = np.maximum(size, 1), np.maximum(raw.counts, 1)
    shapes = [count(k) / per_char * 10 for k in CLASSES] + [raw.counts / per_char * 5, different / per_word, np.log1p(size) / 10, (size > 0).astype(float)]
    slots = np.concatenate([held % WORDS, np.tile(np.arange(WORDS, WORDS + SHAPES), n)])
    rows = np.concatenate([held // WORDS, np.repeat(np.arange(n), SHAPES)])
    order = np.argsort(rows, kind="stable")
    return Sparse(slots[order], np.concatenate([shares, np.stack(shapes, axis=1).ravel()])[order], np.bincount(rows, minlength=n))


def metadata_view(batch: pa.RecordBatch) -> Sparse:
    """Hashed language, source, length and layout classes of each document."""
    slots = []
    columns = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars", "n_lines", "n_words")), strict=True)
    for lang, source, chars, lines, words in columns:
        length, layout = int(np.log2((chars or 0) + 1)), int(2 * np.log2((words or 0) / max(lines or 0, 1) + 1))
        for value in (f"lang={lang}", f"source={source}", f"chars={length}", f"layout={layout}", f"spread={int(4 * (chars or 0) / max(words or 0, 1))}"):
            slots.append(zlib.crc32(value.encode()) % META)
    return Sparse(np.array(slots, np.int64), np.ones(len(slots)), np.full(batch.num_rows, 5))


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float = 0.0

    def margin(self, x: Sparse) -> np.ndarray:
        return np.bincount(x.rows, x.values * self.weights[x.slots], len(x.counts)) + self.intercept


def logistic(x: Sparse, y: np.ndarray, width: int, start: Linear | None = None, balanced: bool = True, rounds: int = 200, rate: float = 0.05, penalty: float = 1e-4) -> Linear:
    """Logistic regression by Adam over all rows, of which both classes weigh alike if ``balanced``."""
    w, b = (np.zeros(width), 0.0) if start is None else (start.weights.copy(), start.intercept)
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) if balanced else np.full(len(y), 1 / max(1, len(y)))
    rows = x.rows
    for t in range(1, rounds + 1):
        z = np.bincount(rows, x.values * w[x.slots], len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        gw, gb = np.bincount(x.slots, x.values * g[rows], width) + penalty * w, float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-7)
    return Linear(w, float(b))


def dense(columns: list[np.ndarray]) -> Sparse:
    n = len(columns[0])
    return Sparse(np.tile(np.arange(len(columns)), n), np.stack(columns, axis=1).ravel(), np.full(n, len(columns)))


@dataclass
class Model:
    views: list[Linear]
    #: (slope, intercept) that make a view's margin the log-odds of its calibrated probability.
    scales: list[tuple[float, float]]
    #: Combination of the calibrated log-odds.
    combined: Linear

    def probability(self, views: tuple[Sparse, Sparse]) -> list[np.ndarray]:
        """Calibrated probability of the text view, of the metadata view, and of both."""
        odds = [a * m.margin(x) + b for m, x, (a, b) in zip(self.views, views, self.scales, strict=True)]
        return [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*odds, self.combined.margin(dense(odds)))]


def calibrated(views: list[Linear], x: tuple[Sparse, Sparse], y: np.ndarray) -> Model:
    """Both views scaled, and their combination fitted, on rows that trained neither."""
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(views, [(1.0, 0.0)] * 2, Linear(np.array([0.5, 0.5])))
    margins = [m.margin(v) for m, v in zip(views, x, strict=True)]
    fits = [logistic(dense([z]), y, 1, balanced=False, rounds=600) for z in margins]
    scales = [(float(f.weights[0]), f.intercept) for f in fits]
    odds = [a * z + b for z, (a, b) in zip(margins, scales, strict=True)]
    return Model(views, scales, logistic(dense(odds), y, 2, start=Linear(np.array([0.5, 0.5])), balanced=False, rounds=600))


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with the page metadata that the second view uses, and a key of all that the views see."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.length(text).cast("long").alias("n_chars"),
        (F.regexp_count(text, F.lit("\n")) + 1).alias("n_lines"), F.regexp_count(text, F.lit(r"[ \t\n\x0B\f\r]+")).alias("n_words"), F.xxhash64(text, F.col("lang").cast("string"), F.col("source").cast("string")).alias("key"),
    )


FEATURES = "doc_id long, key long, y int, ts binary, tv binary, ms binary, mv binary"


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, key, y, packed views) per row of ``docs``; y is null where a row trains with no label."""
    sample = labelled_sample(labels, "quality", held_out, MAX_LABELLED)
    rows = described(docs).join(F.broadcast(sample), "doc_id", "left")  # MAX_LABELLED rows of two numbers at most

    def run(batches):
        for batch in pieces(batches, "text"):
            packed = [*text_view(batch.column("text")).packed(), *metadata_view(batch).packed()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("y"), *packed], ["doc_id", "key", "y", "ts", "tv", "ms", "mv"])

    return rows.select("doc_id", "key", "y", "text", "lang", "source", "n_chars", "n_lines", "n_words").mapInArrow(run, FEATURES)


def _views(table) -> tuple[Sparse, Sparse]:
    return tuple(Sparse.unpacked(*(table.column(c).to_pylist() for c in names)) for names in (("ts", "tv"), ("ms", "mv")))


def confident(rows: DataFrame, views: list[Linear], told: list[dict], handed: int) -> list[dict[int, int]]:
    """What the views hand over of the unlabelled ``rows``: per receiving view, label by key."""
    known = [np.array(sorted(t), np.int64) for t in told]

    def run(batches):
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for me, (view, x) in enumerate(zip(views, _views(batch), strict=True)):
                margin = np.round(view.margin(x), 9)
                new = ~np.isin(keys, known[1 - me])
                for label in (0, 1):
                    sure = new & ((margin > 0) if label else (margin < 0))
                    old = best.get((me, label), (np.zeros(0, np.int64), np.zeros(0)))
                    k, trust = np.concatenate([old[0], keys[sure]]), np.concatenate([old[1], np.abs(margin[sure])])
                    k, first = np.unique(k, return_index=True)
                    order = np.lexsort((k, -trust[first]))[:handed]
                    best[me, label] = (k[order], trust[first][order])
        for (me, label), (k, trust) in best.items():
            n = len(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, me, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(k), pa.array(trust)], ["me", "label", "key", "trust"])

    found = rows.filter("y IS NULL").select("key", "ts", "tv", "ms", "mv").mapInArrow(run, "me int, label int, key long, trust double").distinct()
    out: list[dict[int, int]] = [{}, {}]
    for me in (0, 1):
        for label in (0, 1):
            for r in found.filter((F.col("me") == me) & (F.col("label") == label)).orderBy(F.desc("trust"), "key").limit(handed).collect():
                out[1 - me][r["key"]] = label
    return out


def train(rows: DataFrame, rounds: int, handed: int) -> Model | None:
    """The model of ``rows`` as ``features`` gives them; None without labelled rows of both classes."""
    packed = F.struct("key", "y", "ts", "tv", "ms", "mv")
    labelled = rows.filter("y IS NOT NULL").groupBy("doc_id").agg(F.min(packed).alias("r")).orderBy("doc_id").select("doc_id", "r.*").toArrow()
    ids, y = labelled.column("doc_id").to_numpy(), labelled.column("y").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = _views(labelled)
    held = np.array([zlib.crc32(f"c{i}".encode()) % 4 == 0 for i in ids.tolist()])
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False
    widths = (WORDS + SHAPES, META)
    base = [v.pick(~held) for v in x]
    views = [logistic(v, y[~held], w) for v, w in zip(base, widths, strict=True)]
    told: list[dict[int, int]] = [{}, {}]
    for _ in range(rounds):
        given = confident(rows, views, told, handed)
        if not given[0] and not given[1]:
            break
        for mine, more in zip(told, given, strict=True):
            mine |= more
        keys = sorted(told[0].keys() | told[1].keys())  # 4 * HANDED a round at most
        fetched = rows.filter("y IS NULL").join(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in keys], "key long")), "key")
        fetched = fetched.groupBy("key").agg(F.first("ts").alias("ts"), F.first("tv").alias("tv"), F.first("ms").alias("ms"), F.first("mv").alias("mv")).orderBy("key").toArrow()
        pool, order = _views(fetched), fetched.column("key").to_pylist()
        for me in (0, 1):
            mine = np.array([k in told[me] for k in order], bool)
            more, truth = pool[me].pick(mine), np.array([told[me][k] for k in order if k in told[me]], float)
            both = Sparse(*(np.concatenate([getattr(base[me], f), getattr(more, f)]) for f in ("slots", "values", "counts")))
            views[me] = logistic(both, np.concatenate([y[~held], truth]), widths[me], start=views[me], rounds=60)
    return calibrated(views, tuple(v.pick(held) for v in x), y[held])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, text_score, metadata_score, score, kept) per row of ``docs(doc_id, text, lang, source)``."""
    rows = materialize(features(docs, labels))
    model = docs.sparkSession.sparkContext.broadcast(train(rows, ROUNDS, HANDED))  # two vectors of WORDS + SHAPES and META weights

    def run(batches):
        for batch in batches:
            scores = [np.full(batch.num_rows, 0.5)] * 3 if model.value is None else model.value.probability(_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.asarray(s, float)) for s in scores]], ["doc_id", "text_score", "metadata_score", "score"])

    scored = rows.select("doc_id", "ts", "tv", "ms", "mv").mapInArrow(run, "doc_id long, text_score double, metadata_score double, score double")
    rounded = [F.round(c, 6).alias(c) for c in ("text_score", "metadata_score", "score")]
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, *rounded).withColumn("kept", F.col("score") >= threshold)
