"""License scans by diagonal voting.

All rolling word pairs of the documents are joined with the positions of the same pairs in license templates.
A passage that follows a template lies on one diagonal (document position less template position); words
left out or put in shift it by a little. Votes are counted per diagonal, diagonals that lie close
together and near each other in the text are merged, and a merged span counts if it covers
enough of the template. Phrases are templates that must be covered whole on one diagonal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import cut_lineage, map_arrow
from .wordhash import ALNUM_WORDS, gram_hashes, text_chunks, word_hashes, word_spans

K = 2
#: Share of a template's word pairs that a span must cover; diagonals at most so far apart belong together.
COVERED, NEAR = 0.7, 4
#: A diagonal with fewer votes is not merged into a span; templates of up to WHOLE word pairs must be covered whole.
MIN_VOTES, WHOLE = 3, 6

#: Base phrases and their labels (fixed values of the contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license wordings beside the phrases: label and text.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "CC BY 4 0"),
    ("cc-by", "CC BY 3 0"),
    ("cc-by-nc", "CC BY NC"),
    ("cc-by-sa", "CC BY SA"),
    ("cc-by-nd", "CC BY ND"),
    ("cc0", "CC0 1 0 Universal Public Domain Dedication"),
]


def _grams(text: str) -> tuple[list[int], int]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    low, starts, ends, bounds = word_spans(data, np.array([0, len(data)]), ALNUM_WORDS)
    h, _, _ = gram_hashes(word_hashes(low, starts, ends), bounds, K)
    return h.view(np.int64).tolist(), len(starts)


def template_positions(spark: SparkSession, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for each word pair of each template: as many as the templates have words, whatever the input."""
    rows = []
    for number, (label, text, base) in enumerate([*((v, k, True) for k, v in phrases.items()), *((a, b, False) for a, b in templates)]):
        grams, _ = _grams(text)
        rows += [(number, label, base, len(grams), i, h) for i, h in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, size int, tpos int, hash long")


def _word_pairs(batches):
    """Per text its id (pos -2), its word count (pos -1) and each word pair's hash."""
    for batch in batches:
        keys, docs = batch.column(0).to_numpy(), batch.column(1)
        ids, known = docs.fill_null(0).to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False)
        for first, data, offsets in text_chunks(batch.column(2)):
            low, starts, ends, bounds = word_spans(data, offsets, ALNUM_WORDS)
            h, text, pos = gram_hashes(word_hashes(low, starts, ends), bounds, K)
            n = len(offsets) - 1
            here = np.arange(first, first + n)
            at = np.concatenate((np.full(n, -2), np.full(n, -1), pos)).astype(np.int32)
            value = np.concatenate((ids[here], np.diff(bounds), h.view(np.int64)))
            gone = np.zeros(len(value), dtype=bool)
            gone[:n] = ~known[here]
            yield pa.RecordBatch.from_arrays([pa.array(keys[np.concatenate((here, here, text + first))]), pa.array(at), pa.array(value, mask=gone)], names=["_row", "pos", "value"])


def votes(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows of ids and word counts (pos -2, -1), and word pairs that stand in a template, with their diagonal."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = map_arrow(rows, _word_pairs, "_row long, pos int, value long")
    # The templates are fixed, so this broadcast is of one size for any input.
    hits = pairs.join(F.broadcast(positions), (pairs.value == positions.hash) & (pairs.pos >= 0), "left")
    return hits.where((F.col("pos") < 0) | F.col("template").isNotNull()).select("_row", F.col("pos").cast("long").alias("pos"), "value", "template", "label", "base", "size", "tpos", (F.col("pos") - F.col("tpos")).cast("long").alias("diagonal"))


def spans(lines: DataFrame, covered: float = COVERED, near: int = NEAR) -> DataFrame:
    """Verified spans: _row, template, label, base, first and last word, covered share.

    Votes meet per (text, template, diagonal) with partial sums; a diagonal holds at most one vote of each template
    position in a place. A template that stands several times gives one span each.
    """
    key = ["_row", "template", "label", "base", "size"]
    lines = lines.where(F.col("template").isNotNull())
    # Base phrases, and templates of up to WHOLE pairs: the whole template on one diagonal.
    whole = lines.where((F.col("base") | (F.col("size") <= WHOLE)) & (F.col("votes") >= F.col("size")))
    whole = whole.select(*key, F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size")).alias("last"), F.lit(1.0).alias("share"))
    long = lines.where(~F.col("base") & (F.col("size") > WHOLE) & (F.col("votes") >= MIN_VOTES))
    order = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > near) | (F.col("first") - F.lag("last").over(order) > F.col("size"))
    merged = long.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(order))
    merged = merged.groupBy(*key, "_span").agg(F.min("first").alias("first"), (F.max("last") + (K - 1)).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("_seen"))
    merged = merged.select(*key, "first", "last", (F.col("_seen") / F.col("size")).alias("share")).where(F.col("share") >= covered)
    return whole.unionByName(merged)


def _joined(labels: Column) -> Column:
    return F.concat_ws(",", F.array_sort(labels))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, covered: float = COVERED) -> DataFrame:
    """Licenses of every row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest
    start. score is the largest covered share of a span (1 for a phrase), 0 without one. A null or empty text has
    no words and no label. Repeated rows each give their row; null ids stay null; other columns are
    ignored; an empty table gives an empty result.
    """
    hits = votes(docs, template_positions(docs.sparkSession, phrases, templates))
    # Texts and votes meet once, by text and diagonal; few rows are left.
    lines = hits.groupBy("_row", "template", "label", "base", "size", "diagonal").agg(
        F.max(F.when(F.col("pos") == -2, F.col("value"))).alias("doc_id"), F.max(F.when(F.col("pos") == -1, F.col("value"))).alias("n_words"),
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("seen"))
    lines = cut_lineage(lines)
    found = spans(lines, covered)
    heads = lines.where(F.col("template").isNull()).select("_row", "doc_id", "n_words")
    base = F.col("base")
    rows = heads.select("_row", "doc_id", "n_words", *(F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("base", "boolean"), ("first", "long"), ("share", "double"))))
    rows = rows.unionByName(found.select("_row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"), "label", "base", "first", "share"))
    out = rows.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"), _joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), _joined(F.collect_set("label")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    return out.drop("_row")
