"""Hard negatives by an inverted multi-index.

The components of a vector are cut into two halves, each with a codebook; a pair
of codes is a cell.  An anchor's half products with the codewords, raised by the
radii of the codewords (the farthest member's distance times the half's length),
bound the score of every row of a cell by their sum.  A heap over the two sorted
lists of half bounds (multi-sequence) visits cells from the highest bound down
and stops at the first that cannot hold a wanted row: below the fifth positive,
or below the tenth negative of every score window.  So results are exact; codes
decide only how much is read.

Codebooks are fitted on at most ``FIT_ROWS`` rows and have at most ``MAX_CODES``
words each, so cells and radii are small whatever the number of rows, and every
row is indexed.  Cells are packed into buckets of about ``BUCKET`` rows, a cell
with more is dealt over several; anchors travel only to buckets that they visit,
in blocks of about ``BLOCK``.  Buckets and blocks meet in a shuffle, each task
scores a bounded number of both, and keeps the best few per anchor and bucket.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part, nor do rows whose vectors are not of the most frequent
length (the smallest of these).  Repeated rows and ids are rows of their own: an
anchor's own row is no positive, another row of its id is.  Null ids are no
anchors and come last among equal scores.  Empty tables give no rows, extra
columns are left out.  Components are integers after ``floor(scale * x)`` and must
stay below 2**20 there; larger ones are an error.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.store import drop, materialize

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256
FIT_ROWS, FIT_ROUNDS = 16_384, 8
MAX_CODES, CELL_ROWS = 128, 64
BUCKET, BLOCK = 8_192, 4_096
#: Rows that an anchor visits before its bound is known, and the factor by which more follow where too few were found.
FIRST_ROWS, MORE = 512, 16
#: Added to bounds, which are floating, before they meet whole scores.
SLACK = 1e-3

ROW = "row long, vec_id long, label long, x array<long>"
WINDOWS = "windows array<struct<positive: long, low: long, high: long, floor: long>>"


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _nearest(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of every row and the distance to it."""
    code = np.argmin((codes**2).sum(1) - 2 * (x @ codes.T), axis=1)
    return code, np.sqrt(((x - codes[code]) ** 2).sum(1))


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """k-means codes of a sample, from rows spread over it."""
    codes = np.unique(x, axis=0)
    codes = codes[np.linspace(0, len(codes) - 1, min(k, len(codes))).astype(int)]
    for _ in range(FIT_ROUNDS):
        code, _ = _nearest(x, codes)
        sums = np.zeros_like(codes)
        np.add.at(sums, code, x)
        n = np.bincount(code, minlength=len(codes))
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
    return codes


class Cells:
    """Codebooks, radii and the rows of every cell: all that is needed to order and stop visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.codes = (first, second)
        self.half = first.shape[1]
        self.radii = [np.zeros(len(c)) for c in self.codes]
        self.rows = np.zeros(len(first) * len(second), np.int64)
        self.bucket, self.chunks = np.zeros_like(self.rows), np.ones_like(self.rows)

    def count(self, found: list) -> None:
        """Take over (cell, rows, farthest members of both halves) and pack cells into buckets."""
        bucket, filled = 0, 0
        for r in sorted(found, key=lambda r: r["cell"]):
            i, j = divmod(r["cell"], len(self.codes[1]))
            self.rows[r["cell"]] = r["n"]
            for radius, k, d in ((self.radii[0], i, r["d1"]), (self.radii[1], j, r["d2"])):
                radius[k] = max(radius[k], d)
            chunks = -(-r["n"] // BUCKET)
            if filled and (chunks > 1 or filled + r["n"] > BUCKET):
                bucket, filled = bucket + 1, 0
            self.bucket[r["cell"]], self.chunks[r["cell"]] = bucket, chunks
            bucket, filled = (bucket + chunks, 0) if chunks > 1 else (bucket, filled + r["n"])

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Upper bounds of both halves, then lower bounds."""
        out = []
        for part, codes, radii in zip((x[: self.half], x[self.half :]), self.codes, self.radii, strict=True):
            middle, reach = codes @ part, radii * np.sqrt((part**2).sum()) * (1 + 1e-9)
            out.append((middle + reach, middle - reach))
        return out[0][0], out[1][0], out[0][1], out[1][1]

    def visits(self, x: np.ndarray, floor: float, high: float, rows: int) -> Iterator[tuple[int, float]]:
        """Cells that hold rows, with bounds falling from the highest, until ``floor`` or ``rows``.

        Cells whose rows all score above ``high`` are passed over.
        """
        up1, up2, low1, low2 = self.halves(x)
        a, b = np.argsort(-up1, kind="stable"), np.argsort(-up2, kind="stable")
        wide, seen = len(b), 0
        heap = [(-(up1[a[0]] + up2[b[0]]), 0, 0)]
        while heap and seen < rows:
            bound, i, j = heapq.heappop(heap)
            if SLACK - bound < floor:
                return
            if j + 1 < wide:
                heapq.heappush(heap, (-(up1[a[i]] + up2[b[j + 1]]), i, j + 1))
            if not j and i + 1 < len(a):
                heapq.heappush(heap, (-(up1[a[i + 1]] + up2[b[0]]), i + 1, 0))
            cell = int(a[i]) * wide + int(b[j])
            if self.rows[cell] and low1[a[i]] + low2[b[j]] - SLACK <= high:
                seen += self.rows[cell]
                yield cell, -bound


class MultiIndex:
    """Index of all usable rows of ``vectors(vec_id, embedding, label)``; ``anchor`` marks the rows to search for."""

    def __init__(self, vectors: DataFrame, anchor: Column, scale: int = SCALE):
        spark = vectors.sparkSession
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("x"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
        lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
        dims, self.n = (lengths[0]["dims"], lengths[0]["count"]) if lengths else (0, 0)
        self.dims, half = dims, dims // 2
        rows = rows.filter(F.size("x") == dims)
        top = 1 << 20
        whole = F.transform("x", lambda x: F.floor(scale * x.cast("double")))
        rows = rows.withColumn("x", F.when(F.forall(whole, lambda x: F.abs(x) < top), whole).otherwise(F.raise_error(F.lit("components reach 2**20"))))
        # The fitted sample sets the speed only, so which rows it has does not matter.
        every = max(1, self.n // FIT_ROWS)
        sample = rows.select("x").filter(F.pmod(F.xxhash64("x"), F.lit(every)) == 0).limit(FIT_ROWS).collect()
        fitted = np.array([r["x"] for r in sample], np.float64).reshape(len(sample), dims) if sample else np.zeros((1, dims))
        codes = min(MAX_CODES, max(2, math.isqrt(self.n // CELL_ROWS)))
        self.cells = cells = Cells(_fit(fitted[:, :half], codes), _fit(fitted[:, half:], codes))

        def assign(batches):
            context = TaskContext.get()
            row = (context.partitionId() if context else 0) << 40
            for batch in batches:
                n = batch.num_rows
                if n:
                    x = _matrix(batch.column("x"), dims)
                    (c1, d1), (c2, d2) = _nearest(x[:, :half], cells.codes[0]), _nearest(x[:, half:], cells.codes[1])
                    added = [pa.array(np.arange(row, row + n)), pa.array((c1 * len(cells.codes[1]) + c2).astype(np.int32)), pa.array(d1), pa.array(d2)]
                    yield pa.RecordBatch.from_arrays([*added, *batch.columns], ["row", "cell", "d1", "d2", *batch.schema.names])
                    row += n

        self.rows = materialize(rows.mapInArrow(assign, "row long, cell int, d1 double, d2 double, vec_id long, label long, x array<long>, is_anchor boolean"))
        cells.count(self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect())
        places = [(c, int(cells.bucket[c]), int(cells.chunks[c])) for c in np.flatnonzero(cells.rows).tolist()]
        places = F.broadcast(spark.createDataFrame(places, "cell int, first long, chunks long"))  # at most MAX_CODES**2 rows
        self.members = self.rows.join(places, "cell").select("row", "vec_id", "label", "x", "cell", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("chunks"))).alias("bucket"))

    def anchors(self) -> DataFrame:
        return self.rows.filter("is_anchor").select("row", "vec_id", "label", "x")

    def _visits(self, requests: DataFrame) -> DataFrame:
        """(bucket, cells, row, vec_id, label, x, windows) per anchor and bucket that it visits.

        ``requests`` has ``floor``, ``high`` and ``rows``, where the visits end.
        """
        cells, dims = self.cells, self.dims

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("x"), dims)
                ends = zip(*(batch.column(c).to_pylist() for c in ("floor", "high", "rows")), strict=True)
                at, bucket, visited = [], [], []
                for k, (floor, high, rows) in enumerate(ends):
                    mine: dict[int, list[int]] = {}
                    for cell, _ in cells.visits(x[k], floor, high, rows):
                        for chunk in range(cells.chunks[cell]):
                            mine.setdefault(int(cells.bucket[cell]) + chunk, []).append(cell)
                    at += [k] * len(mine)
                    bucket += mine
                    visited += mine.values()
                own = batch.select(["row", "vec_id", "label", "x", "windows"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(visited, pa.list_(pa.int32())), *own.columns], ["bucket", "cells", *own.schema.names])

        return requests.select("row", "vec_id", "label", "x", "windows", "floor", "high", "rows").mapInArrow(run, f"bucket long, cells array<int>, {ROW}, {WINDOWS}")

    def search(self, requests: DataFrame, keep: int) -> DataFrame:
        """(anchor, positive, row, vec_id, score): per anchor and visited bucket the best ``keep`` rows.

        Without windows these have the anchor's label and are not its row, and
        ``positive`` is null; else they have other labels and scores inside the
        window of ``positive``.
        """
        visits = materialize(self._visits(requests))
        blocks = visits.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
        left = self.members.join(blocks, "bucket").select("bucket", block, "row", "vec_id", "label", "x", "cell")
        right = visits.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
        dims = self.dims

        def meet(rows: pa.Table, asking: pa.Table) -> pa.Table:
            return _score(rows, asking, dims, keep)

        hits = left.groupBy("bucket", "block").cogroup(right.drop("blocks").groupBy("bucket", "block"))
        found = materialize(hits.applyInArrow(meet, "anchor long, positive long, row long, vec_id long, score long"))
        drop(visits)
        return found


#: Anchors scored together, which bounds the score matrix of a task.
TOGETHER = 256
HITS = pa.schema([(k, pa.int64()) for k in ("anchor", "positive", "row", "vec_id", "score")])


def _best(score: np.ndarray, order: np.ndarray, at: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` of ``at`` with the highest scores, ties by ``order``."""
    if len(at) > keep:
        least = np.partition(score[at], len(at) - keep)[len(at) - keep]
        at = at[score[at] >= least]
    return at[np.lexsort((order[at], -score[at]))][:keep]


def _score(rows: pa.Table, asking: pa.Table, dims: int, keep: int) -> pa.Table:
    if not rows.num_rows or not asking.num_rows:
        return HITS.empty_table()
    x, key, label, cell = _matrix(rows["x"], dims), *(rows[c].to_numpy() for c in ("row", "label", "cell"))
    # Rank of each row's id among those here, null ids last.
    order = np.empty(len(key), np.int64)
    order[rows.select(["vec_id"]).append_column("at", pa.array(np.arange(len(key)))).sort_by([("vec_id", "ascending")])["at"].to_numpy()] = np.arange(len(key))
    members = {int(c): np.flatnonzero(cell == c) for c in np.unique(cell)}
    q, anchor, own = _matrix(asking["x"], dims), asking["row"].to_numpy(), asking["label"].to_numpy()
    cells, windows = asking["cells"].to_pylist(), asking["windows"].to_pylist()
    out: list[tuple[np.ndarray, int, int | None, np.ndarray]] = []
    for begin in range(0, len(anchor), TOGETHER):
        part = range(begin, min(begin + TOGETHER, len(anchor)))
        visitors: dict[int, list[int]] = {}
        for k in part:
            for c in cells[k]:
                visitors.setdefault(c, []).append(k)
        scores = np.full((len(part), len(key)), -np.inf)
        for c, who in visitors.items():
            if c in members:
                who = np.array(who)
                scores[np.ix_(who - begin, members[c])] = q[who] @ x[members[c]].T
        for k in part:
            score = scores[k - begin]
            if windows[k] is None:
                at = _best(score, order, np.flatnonzero((label == own[k]) & (key != anchor[k]) & (score > -np.inf)), keep)
                out.append((at, int(anchor[k]), None, score[at]))
                continue
            other = np.flatnonzero((label != own[k]) & (score > -np.inf))
            for w in windows[k]:
                at = other[(score[other] <= w["high"]) & (score[other] >= w["floor"])]
                at = _best(score, order, at, keep)
                out.append((at, int(anchor[k]), w["positive"], score[at]))
    at = np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64)
    sizes = [len(o[0]) for o in out]
    return pa.Table.from_arrays(
        [
            pa.array(np.repeat([o[1] for o in out], sizes).astype(np.int64)),
            pa.array([o[2] for o, n in zip(out, sizes, strict=True) for _ in range(n)], pa.int64()),
            pa.array(key[at]),
            rows["vec_id"].combine_chunks().take(pa.array(at)),
            pa.array(np.concatenate([o[3] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64)),
        ],
        schema=HITS,
    )


def _first(hits: DataFrame, keep: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _request(anchors: DataFrame, floor: Column, high: Column, rows: int, windows: Column) -> DataFrame:
    return anchors.withColumns({"floor": floor.cast("double"), "high": high.cast("double"), "rows": F.lit(rows).cast("long"), "windows": windows})


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors(vec_id, embedding, label)``.

    Rows of the ``anchor`` condition search all rows: first their best
    ``positives`` of the same label, then per positive the best ``negatives`` of
    other labels whose score is ``low`` to ``high`` percent of the positive's.
    """
    index = MultiIndex(vectors, anchor)
    anchors, all_rows = index.anchors(), max(index.n, 1)
    nothing, endless = F.lit(None).cast(WINDOWS.split(" ", 1)[1]), F.lit(math.inf)
    # Visit a few rows; with enough positives among them, the last one's score is where the whole search stops.
    asked, rows = _request(anchors, -endless, endless, FIRST_ROWS, nothing), FIRST_ROWS
    whole, used = [], []
    while rows < all_rows and not asked.isEmpty():
        found = index.search(asked, positives)
        last = _first(found, positives, "anchor").groupBy(F.col("anchor").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("last"))
        known = materialize(asked.select("row", "vec_id", "label", "x").join(last, "row", "left").withColumn("full", F.coalesce(F.col("n") >= positives, F.lit(False))))
        whole.append(index.search(_request(known.filter("full"), F.col("last"), endless, all_rows, nothing), positives))
        rows *= MORE
        asked = _request(known.filter("not full"), -endless, endless, rows, nothing)
        used += [found, known]
    whole.append(index.search(asked.withColumn("rows", F.lit(all_rows).cast("long")), positives))
    used += whole
    best = _first(reduce(DataFrame.unionByName, whole), positives, "anchor")
    best = materialize(best.select("anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # A window ends at whole scores: low * p <= 100 * s <= high * p.
    ends = {"low": F.ceil(low * F.col("positive_score") / 100).cast("long"), "high": F.floor(high * F.col("positive_score") / 100).cast("long")}
    windows = materialize(best.withColumns(ends).filter("low <= high"))
    mined = materialize(_negatives(index, anchors, windows, negatives, all_rows, used))
    for table in (index.rows, best, windows, *used):
        drop(table)
    return mined


def _negatives(index: MultiIndex, anchors: DataFrame, windows: DataFrame, negatives: int, all_rows: int, used: list[DataFrame]) -> DataFrame:
    def asked(windows: DataFrame, rows: int) -> DataFrame:
        packed = windows.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("positive", "low", "high", "floor")).alias("ranges"), F.min("floor").alias("from_"), F.max("high").alias("to_"))
        return _request(anchors.join(packed, "row"), F.col("from_"), F.col("to_"), rows, F.col("ranges")).drop("ranges", "from_", "to_")

    found = windows.withColumn("floor", F.col("low"))
    if all_rows > FIRST_ROWS:
        hits = index.search(asked(found, FIRST_ROWS), negatives)
        used.append(hits)
        last = _first(hits, negatives, "anchor", "positive").groupBy("anchor", "positive").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        found = windows.join(last, ["anchor", "positive"], "left").withColumn("floor", F.when(F.col("n") >= negatives, F.col("last")).otherwise(F.col("low"))).drop("n", "last")
    hits = index.search(asked(found, all_rows), negatives)
    used.append(hits)
    hits = _first(hits, negatives, "anchor", "positive").select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = windows.select("anchor", "positive", "positive_id", "positive_score")
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return hits.join(named, ["anchor", "positive"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Labels of every seventh row are taken for the next one's, the contract's noise.
def noisy(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


ORACLE = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)
QUALIFY row_number() OVER w <= 10
"""
