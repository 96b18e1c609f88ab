"""Periodic runs of words, found by catching squares online.

A run is a stretch of consecutive words with smallest period p (words p apart
are identical), at least ``MIN_WORDS`` and ``MIN_PERIODS`` periods long, that no
neighbouring word extends.  ``detect`` returns all runs of every text and the
text without their repeats.

Texts need no shuffle: each is searched whole in one task, in memory
proportional to its words, and the work grows with n log n.

Defined cases: a null or empty text has no words, no runs and an empty text
left.  Repeated rows and ids are judged row by row, and every row returns once;
a null doc_id stays null.  A text of any length is appended in pieces.  Extra
columns are left out.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.tokens import mix, pieces

MIN_WORDS = 24
MIN_PERIODS = 3
#: Blocks of the lowest level have 2**LOWEST words: the largest of which a run of MIN_WORDS words always holds one and its copy.
LOWEST = 3
#: Words appended at once.
APPEND = 1 << 18

_FACTOR = 0x9E3779B97F4A7C15
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SquareCatcher:
    """Runs of a stream of word numbers that is appended bit by bit.

    Level L has a catcher for every completed block of 2**L words that starts at
    a multiple of 2**L.  A catcher waits for a suffix of the stream that equals
    its block and starts p words later, 2**L <= p < 2**(L+1) (p < 2**(L+1) at
    the lowest level): with the block it makes a stretch of period p.  As a run
    has three periods, it holds a whole block and its copy one period later, so
    none is missed.  Every appended word ends one suffix per level, which is
    compared with one waiting catcher, with two at the lowest level; the
    comparisons of all words of an append advance together.  Hashes find equal
    blocks, the words themselves decide.

    A caught square is extended to both sides and so merged with the others of
    its run; a stretch that reaches the end of the stream stays open and grows
    with later words.
    """

    def __init__(self):
        self.ids = np.zeros(0, np.int64)
        self.runs: list[list[int]] = []  # start, end, period
        self.open: list[list[int]] = []
        self.last: dict[int, list[int]] = {}  # newest run of a period
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # block hashes, and hashes of the suffixes that longer ones begin with

    def append(self, ids: np.ndarray, longest: int | None = None) -> None:
        """Append words; ``longest`` bounds the words of a run, where texts are parted by words that occur once."""
        begin = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        for run in self.open:
            run[1] += self._equal(run[1], run[2], 1)
        self.open = [run for run in self.open if run[1] == len(self.ids)]
        hashes, at = mix(ids.astype(np.uint64) * np.uint64(_FACTOR) + np.uint64(1)), begin
        width, level, factor = 1, 0, _FACTOR
        while width <= len(self.ids):
            if longest is not None and level > LOWEST and MIN_PERIODS * width > longest:
                break
            if level == len(self.levels):
                self.levels.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
            blocks, tail = self.levels[level]
            # ``hashes`` has the suffixes of ``width`` words from word ``at`` on that end in an appended word.
            first = -at % width
            blocks = np.concatenate([blocks, hashes[first::width]])
            if level >= LOWEST:
                self._catch(at, hashes, blocks, level)
            known, at = np.concatenate([tail, hashes]), at - len(tail)
            self.levels[level] = (blocks, known[max(0, len(known) - width) :])
            if len(known) <= width:
                hashes = np.zeros(0, np.uint64)
            else:
                hashes = known[:-width] * np.uint64(factor) + known[width:]
            factor = factor * factor % (1 << 64)
            width, level = 2 * width, level + 1

    def _catch(self, at: int, hashes: np.ndarray, blocks: np.ndarray, level: int) -> None:
        width = 1 << level
        starts = np.arange(at, at + len(hashes))
        for back in (0, 1) if level == LOWEST else (1,):
            j = (starts >> level) - back
            ok = np.flatnonzero((j >= 0) & (starts > j << level) & (j < len(blocks)))
            ok = ok[hashes[ok] == blocks[j[ok]]]
            if len(ok):
                self._extend(j[ok] << level, starts[ok], width)

    def _extend(self, blocks: np.ndarray, starts: np.ndarray, width: int) -> None:
        """Extend matches of a block and a later suffix to stretches, but for those of a multiple of a known run's period."""
        periods = starts - blocks
        keep = np.ones(len(blocks), bool)
        for start, end, period in self.runs:
            lo, hi = np.searchsorted(blocks, (start, end))
            if hi > lo:
                keep[lo:hi] &= (periods[lo:hi] % period != 0) | (starts[lo:hi] + width > end)
        for block, start, period in sorted(zip(blocks[keep].tolist(), starts[keep].tolist(), periods[keep].tolist(), strict=True), key=lambda m: (m[2], m[0])):
            last = self.last.get(period)
            if last and last[0] <= block and start + width <= last[1]:
                continue
            if not np.array_equal(self.ids[block : block + width], self.ids[start : start + width]):
                continue
            run = [block - self._equal(block - 1, period, -1), start + width + self._equal(start + width, period, 1), period]
            self.last[period] = run
            if run[1] - run[0] >= MIN_PERIODS * period:
                self.runs.append(run)
            if run[1] == len(self.ids):
                self.open.append(run)
                if run[1] - run[0] < MIN_PERIODS * period:
                    self.runs.append(run)

    def _equal(self, at: int, period: int, step: int) -> int:
        """Words from ``at`` on, in the direction of ``step``, that equal those a period nearer."""
        ids, done, size = self.ids, 0, 32
        while True:
            if step > 0:
                size = min(size, len(ids) - at)
                differ = np.flatnonzero(ids[at : at + size] != ids[at - period : at - period + size])
            else:
                size = min(size, at + 1)
                differ = np.flatnonzero((ids[at + 1 - size : at + 1] != ids[at + 1 - size + period : at + 1 + period])[::-1])
            if len(differ):
                return done + int(differ[0])
            if not size:
                return done
            done, at, size = done + size, at + step * size, 2 * size

    def found(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of the stream so far, by start and period."""
        best: dict[tuple[int, int], int] = {}
        for start, end, period in self.runs:
            if end - start >= max(MIN_WORDS, MIN_PERIODS * period):
                best[start, end] = min(period, best.get((start, end), period))
        return sorted((start, end - start, period) for (start, end), period in best.items())


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of ``docs(doc_id, text)``.

    ``runs`` has start, length and period by start, then period.  ``collapsed``
    has the text's words without those that follow the first period of a run,
    joined by blanks.
    """

    def run(batches):
        for batch in pieces(batches, "text"):
            texts = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = [len(t) for t in texts]
            words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
            ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            # A word of its own parts each text from the next, so that no square spans two.
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, len(words.dictionary) + np.arange(len(texts)))
            first = ends - sizes + np.arange(len(texts))
            catcher = SquareCatcher()
            for at in range(0, len(ids), APPEND):
                catcher.append(ids[at : at + APPEND], max(sizes))
            runs: list[list[dict]] = [[] for _ in texts]
            for start, length, period in catcher.found():
                text = int(np.searchsorted(first, start, side="right")) - 1
                runs[text].append({"start": start - int(first[text]), "length": length, "period": period})
            left = [b" ".join(_collapse(t, r)) for t, r in zip(texts, runs, strict=True)]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, RUNS), pa.array(left, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _collapse(words: list[bytes], runs: list[dict]) -> list[bytes]:
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for r in runs:
        kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
    return list(compress(words, kept))


def plant(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with every tenth text (by its id's checksum) made periodic from some word on.

    Null ids, null texts and texts without words stay as they are.
    """
    words, n, h = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"), F.size("_words"), F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", (h % 10 == 0).alias("_chosen"), g.alias("_g"))
    chosen = chosen.withColumn("_words", F.when(F.col("_chosen") & F.col("text").isNotNull(), words))
    chosen = chosen.withColumn("_a", F.when(n > 0, (F.col("_g") % n).cast("int")))
    chosen = chosen.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    periodic = F.expr("array_join(transform(_words, (w, i) -> if(i < _a, w, _words[_a + (i - _a) % _p])), ' ')")
    return chosen.select("doc_id", F.when(F.col("_a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def _hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest(found: DataFrame) -> DataFrame:
    """Contract columns of what ``detect`` found."""
    longer = F.expr("array_sort(runs, (l, r) -> case when l.length * r.period > r.length * l.period then -1 when l.length * r.period < r.length * l.period then 1 when l.start <> r.start then sign(l.start - r.start)::int else sign(l.period - r.period)::int end)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.get("_order", F.lit(0))
    return found.withColumn("_order", longer).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(best[k].alias(k) for k in ("start", "length", "period")),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        _hex(lines).alias("runs_sha256"), _hex(F.col("collapsed")).alias("collapsed_sha256"),
    )
