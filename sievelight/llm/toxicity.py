"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training uses a bounded sample of labelled rows (``MAX_LABELLED``, the lowest
hashes of doc_id).  Spark counts, for every hashed n-gram, the toxic and clean
texts that hold it; the n-grams whose log-count ratio is best supported become
features, each worth its ratio where a text holds it; a logistic regression on
these is fitted on the driver.  Scoring runs over whole texts.

Defined cases: null and empty texts hold no n-gram and score by the intercept;
without labelled rows of both classes every score is 0; ties between features
are broken by bucket number; repeated rows score alike; labels of a repeated
doc_id count once, the highest label; very long texts are scored whole; an empty
table gives an empty result; extra columns, whatever their names, are ignored
(``reject_toxic`` keeps them); a null doc_id is kept and never trains.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.store import materialize
from sievelight.llm.tokens import mix, pieces

#: Labelled rows that training takes at most.
MAX_LABELLED = 12_000
#: Lengths of the character n-grams.
SIZES = (4, 5, 6)
#: Hash buckets, and features kept of them.
BUCKETS = 1 << 20
FEATURES = 4096
#: Add-one smoothing of the counts, and the weight of the L2 penalty.
ALPHA, PENALTY = 1.0, 1e-3


def char_buckets(text: str) -> np.ndarray:
    """Buckets of all character n-grams of a lower-cased text."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, code = [], points * np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(SIZES) + 1):
        # After n steps rolled[i] covers characters i to i + n - 1.
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in SIZES and len(rolled):
            out.append(mix(rolled + np.uint64(n)) & np.uint64(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    """slot: feature number by bucket (-1: none); weights: value times ratio by feature."""

    slot: np.ndarray
    weights: np.ndarray
    intercept: float
    fitted: bool = True

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        held = held_features(self.slot, text)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[held].sum(), -50, 50))))


def held_features(slot: np.ndarray, text: str | None) -> np.ndarray:
    """Distinct features that a text holds."""
    found = slot[char_buckets(text or "")]
    return np.unique(found[found >= 0])


def labelled_sample(labels: DataFrame, label: str, held_out, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, y): at most ``limit`` labelled rows outside ``held_out``, by hash of doc_id."""
    eligible = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    once = eligible.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def held_out(doc_id):
    """The third of all rows that no label is learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELLED) -> Model:
    sample = F.broadcast(labelled_sample(labels, label, held_out, limit))  # at most ``limit`` rows of two numbers
    texts = materialize(docs.select("doc_id", "text").join(sample, "doc_id").select("text", "y"))

    def count(batches):
        """Texts of either class by bucket, summed per batch before they are shuffled."""
        for batch in pieces(batches, "text", 8 << 20):
            seen = np.zeros((2, BUCKETS), np.int32)
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[y][np.unique(char_buckets(text or ""))] += 1
            at = np.flatnonzero(seen.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0][at].astype(np.int64)), pa.array(seen[1][at].astype(np.int64))], ["bucket", "clean", "toxic"])

    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    nothing = Model(np.zeros(0, np.int32), np.zeros(0), 0.0, fitted=False)
    if not n0 or not n1:
        return nothing
    counts = texts.mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + ALPHA) / (n1 + 2 * ALPHA)) - F.log((F.col("clean") + ALPHA) / (n0 + 2 * ALPHA))
    # The ratio over its standard error: rare n-grams need a larger ratio.
    support = F.abs(ratio) / F.sqrt(1 / (F.col("toxic") + ALPHA) + 1 / (F.col("clean") + ALPHA))
    best = counts.select("bucket", ratio.alias("ratio"), support.alias("support")).orderBy(F.desc("support"), "bucket").limit(FEATURES).collect()
    slot = np.full(BUCKETS, -1, np.int32)
    slot[[r["bucket"] for r in best]] = np.arange(len(best), dtype=np.int32)
    ratios = np.array([r["ratio"] for r in best])

    def hold(batches):
        for batch in pieces(batches, "text"):
            held = [held_features(slot, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([h.astype(np.int32).tobytes() for h in held], pa.binary())], ["y", "held"])

    rows = texts.mapInArrow(hold, "y int, held binary").toArrow()
    held = [np.frombuffer(b.as_py(), np.int32) for b in rows.column("held")]
    y = rows.column("y").to_numpy().astype(float)
    weights, intercept = fit(held, y, ratios)
    return Model(slot, weights * ratios, intercept)


def fit(held: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, rounds: int = 300, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept: class-balanced logistic loss, Adam over all rows.

    Rows are put in an order that does not depend on how Spark returned them.
    """
    order = sorted(range(len(y)), key=lambda i: (y[i], len(held[i]), held[i].tobytes()))
    held, y = [held[i] for i in order], y[order]
    row = np.repeat(np.arange(len(y)), [len(h) for h in held])
    feature = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
    value = ratios[feature]
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(len(ratios)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[feature], len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * share
        gw, gb = np.bincount(feature, value * g[row], len(w)) + PENALTY * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / 10 / np.sqrt(1 + t / 50)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS and FEATURES bound its size

    def run(batches):
        for batch in pieces(batches, "text"):
            scores = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs(doc_id, text)``; ``labels(doc_id, toxic)`` train."""
    scored = score(docs, train(docs, labels)).withColumn("score", F.round("score", 9))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the texts that score ``threshold`` or more; each row is judged by its own text."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names = docs.columns

    def run(batches):
        for batch in pieces(batches, "text"):
            stays = [model.value.score(t) < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*names)
