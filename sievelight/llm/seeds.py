"""Rolling word k-gram hashes as rows, for joins against small tables of k-grams."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sievelight.llm.tokens import NON_ALNUM, pieces, split_words

#: Hash value of the one row per document that carries its doc_id and word count.
HEADER = -1


def gram_rows(docs: DataFrame, k: int, header: bool = True) -> DataFrame:
    """(row, pos, h, doc_id): one row per word k-gram of ``docs(doc_id, text)``.

    Words are ASCII digits and letters (lower-cased) and non-ASCII characters.
    ``row`` numbers the input rows, so repeated doc_ids stay apart; the header
    row has h = HEADER, pos = the number of words, and the doc_id.
    """
    names = ["row", "pos", "h", "doc_id"]

    def run(batches):
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch in pieces(batches, "text"):
            words = split_words(batch.column("text"), NON_ALNUM, lower=True)
            n = batch.num_rows
            rows = np.arange(row, row + n)
            row += n
            if header:
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(words.counts.astype(np.int32)), pa.array(np.full(n, HEADER, np.int64)), batch.column("doc_id").cast(pa.int64())], names)
            at, hashes = words.grams(words.hashes(), k)
            if len(at):
                texts, places = words.place(at)
                hashes = hashes.view(np.int64)
                hashes[hashes == HEADER] = 0
                yield pa.RecordBatch.from_arrays([pa.array(rows[texts]), pa.array(places.astype(np.int32)), pa.array(hashes), pa.nulls(len(at), pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "row long, pos int, h long, doc_id long")


def text_grams(texts: Iterable[str], k: int) -> list[tuple[int, int, list[int]]]:
    """(text number, words, k-gram hashes by position) of a few texts, on the driver."""
    words = split_words(pa.array(list(texts), pa.string()), NON_ALNUM, lower=True)
    at, hashes = words.grams(words.hashes(), k)
    number, _ = words.place(at)
    hashes = hashes.view(np.int64)
    return [(i, int(n), hashes[number == i].tolist()) for i, n in enumerate(words.counts)]
