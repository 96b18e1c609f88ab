"""License scan by diagonal voting.

All rolling word 3-grams of the documents are joined to the 3-gram positions of
license templates.  Each hit votes for the diagonal (document position minus
template position); neighbouring diagonals merge, so that a few inserted or
dropped words do not split a span; a span is verified by the share of the
template's 3-grams that voted.  Exact phrases are full votes on one diagonal.

Defined cases: null and empty texts have no word, no place and score 0; ties on
coverage do not matter, as only the highest is reported; repeated rows are
scanned each on its own; very long texts are scanned whole; an empty table gives an
empty result; extra columns, whatever their names, are ignored; a null doc_id is
kept.  Words are compared by 64-bit hashes of three: a corpus of 5e13 words meets
the few hundred template places by chance 0.001 times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.seeds import HEADER, gram_rows, text_grams

K = 3
#: Exact phrases and their labels (fixed values).
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices of public licenses and their labels (fixed values).
TEMPLATES = (
    ("agpl-3", "gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial 4.0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4.0 international"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Share of a template's 3-grams that a verified span has.
COVERAGE = 0.8
#: Diagonals this far apart merge.
SLACK = 2


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, coverage: float = COVERAGE, slack: int = SLACK) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    known = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    rows = [(HEADER, -1, 0, 1, "", False)]
    for i, n, hashes in text_grams([t for _, t, _ in known], K):
        rows += [(h, i, at, n - K + 1, known[i][0], known[i][2]) for at, h in enumerate(hashes)]
    # As many rows as the templates above have 3-grams.
    places = F.broadcast(spark.createDataFrame(rows, "h long, template int, at int, need int, label string, base boolean"))
    hits = gram_rows(docs, K).join(places, "h")
    votes = hits.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.first("need").alias("need"), F.first("label").alias("label"), F.first("base").alias("base"), F.max("doc_id").alias("doc_id"), F.max("pos").alias("pos")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True)).cast("int")
    merged = votes.withColumn("apart", apart).withColumn("group", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.withColumn("whole", F.col("base") & (F.size("ats") == F.col("need")))
    spans = merged.groupBy("row", "template", "group").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("need").alias("need"), F.max("doc_id").alias("doc_id"), F.max("pos").alias("pos"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"),
        F.count_if("whole").alias("n_base"), F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first"), F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last"),
        F.min(F.col("diagonal") + F.array_min("ats")).alias("start"), F.max(F.col("diagonal") + F.array_max("ats")).alias("end"),
    )
    share = F.col("n") / F.col("need")
    verified = F.when(F.col("base"), F.col("n_base") > 0).otherwise((share >= coverage) & (F.col("template") >= 0))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    head = F.col("template") < 0
    return spans.groupBy("row").agg(
        F.max(F.when(head, F.col("doc_id"))).alias("doc_id"),
        F.max(F.when(head, F.col("pos"))).cast("long").alias("n_words"),
        F.sum("n_base").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        labels(F.col("base") & verified).alias("base_labels"),
        labels(verified).alias("labels"),
        F.round(F.coalesce(F.max(F.when(verified, share)), F.lit(0.0)), 6).alias("score"),
        F.array_sort(F.collect_list(F.when(verified, F.struct(F.col("start"), (F.col("end") + K).alias("stop"), F.col("label"))))).alias("spans"),
    ).drop("row")
