"""Streaming jobs: answer deltas, incremental ingest and session state; batch forms where they differ."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sievelight.sources.versions import ChunkTable

def fold_deltas(deltas: DataFrame) -> DataFrame:
    """(stream_id, answer, n_pieces): ``deltas(stream_id, seq, text)`` joined in order, each seq once."""
    once = deltas.groupBy("stream_id", "seq").agg(F.min("text").alias("text"))
    return once.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda d: d["text"]), "").alias("answer"), F.count("*").alias("n_pieces"))


class _Fold(StatefulProcessor):
    """Pieces of one stream by seq until all up to the finishing one are there."""

    def __init__(self, idle_ms: int, grace_ms: int):
        self.idle_ms, self.grace_ms = idle_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "seq int", "text string")
        self.mark = handle.getValueState("mark", "last int, n int, done boolean, timer long")

    def _wait(self, last: int, n: int, done: bool, now: int, before: int) -> None:
        """Remember where the stream is, and until when."""
        if before:
            self.handle.deleteTimer(before)
        at = now + (self.grace_ms if done else self.idle_ms)
        self.handle.registerTimer(at)
        self.mark.update((last, n, done, at))

    def _answer(self, key, finished: bool) -> pd.DataFrame:
        held = sorted((k[0], v[0]) for k, v in self.pieces.iterator())
        self.pieces.clear()
        return pd.DataFrame({"stream_id": [key[0]], "answer": ["".join(t for _, t in held)], "n_pieces": [len(held)], "finished": [finished]})

    def handleInputRows(self, key, rows, timerValues):
        last, n, done, timer = self.mark.get() if self.mark.exists() else (-1, 0, False, 0)
        if done:
            return
        for pdf in rows:
            for seq, text, finish in zip(pdf["seq"].tolist(), pdf["text"].tolist(), pdf["finish"].tolist(), strict=True):
                if not self.pieces.containsKey((int(seq),)):
                    self.pieces.updateValue((int(seq),), (text if isinstance(text, str) else "",))
                    n += 1
                last = int(seq) if finish else last
        done = last >= 0 and n > last
        if done:
            yield self._answer(key, True)
        self._wait(last, n, done, timerValues.getCurrentProcessingTimeInMs(), timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, n, done, _ = self.mark.get()
        if not done:
            yield self._answer(key, last >= 0)
        self.mark.clear()

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_delta_stream(deltas: DataFrame, idle: float = 600, grace: float = 600) -> DataFrame:
    """Streaming fold of ``deltas(stream_id, seq, text, finish)``: a row (stream_id, answer, n_pieces, finished) per stream that ends.

    A stream ends when all seqs from 0 to the finishing one are there, in any
    order, or with what it has after ``idle`` seconds without a delta.  Pieces are
    added to the state one by one, repeated seqs not at all, and go when the
    stream ends; for ``grace`` seconds more a mark makes late deltas ignored, then
    nothing is left.  The session gets the RocksDB state store.
    """
    deltas.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    folded = f"stream_id {deltas.schema['stream_id'].dataType.simpleString()}, answer string, n_pieces int, finished boolean"
    return deltas.groupBy("stream_id").transformWithStateInPandas(_Fold(int(idle * 1000), int(grace * 1000)), folded, "Append", "ProcessingTime")


def stream_timings(events: DataFrame) -> DataFrame:
    """(stream_id, first, span, max_gap, chars) in seconds of ``events(stream_id, ts, seq, text)``."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("stream_id").orderBy("ts", "seq")
    gaps = events.withColumn("at", at).withColumn("gap", F.col("at") - F.lag("at").over(order))
    return gaps.groupBy("stream_id").agg(F.min("at").alias("first"), ((F.max("at") - F.min("at")) / 1e6).alias("span"), (F.coalesce(F.max("gap"), F.lit(0)) / 1e6).alias("max_gap"), F.sum(F.length("text")).alias("chars"))


def incremental_ingest(stream: DataFrame, chunk: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "doc_id"):
    """Starts a query that chunks new documents and puts the chunks in place of theirs in the ``ChunkTable`` under ``path``.

    A batch is one version of the table: run again it changes nothing, and a
    document whose new version has no chunk loses its old ones.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ChunkTable(batch.sparkSession, path, key).replace(chunk(batch), batch.select(key), batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_doc_state(docs: DataFrame, ttl: int = 7200) -> DataFrame:
    """Streaming newest document per session, (session_id, name, ts, live), for ``docs(session_id, ts, name)``.

    A session's state lives ``ttl`` seconds of event time from its last write;
    then a row with live = false says that it is gone.
    """

    def newest(key, batches, state):
        if state.hasTimedOut:
            name, at = state.get
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "name": [name], "ts": [pd.Timestamp(at, unit="us")], "live": [False]})
            return
        name, at = state.get if state.exists else (None, None)
        for batch in batches:
            last = batch.loc[batch["ts"].idxmax()]
            micros = int(last["ts"].value // 1000)
            if at is None or micros >= at:
                name, at = last["name"], micros
        state.update((name, at))
        state.setTimeoutTimestamp(max(at // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "name": [name], "ts": [pd.Timestamp(at, unit="us")], "live": [True]})

    kind = docs.schema["session_id"].dataType.simpleString()
    marked = docs.select("session_id", "ts", "name").withWatermark("ts", "10 minutes")
    return marked.groupBy("session_id").applyInPandasWithState(newest, f"session_id {kind}, name string, ts timestamp, live boolean", "name string, at long", "update", "EventTimeTimeout")
