"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` neighbouring k-gram hashes of a text the smallest is kept. Two texts that share
WINDOW + K - 1 words share a kept hash, so with K + WINDOW - 1 = 13 no shared window of 13 words is
missed. Kept hashes of documents and benchmark are joined; each hit names a pair of texts, and the
extension marks every document word inside a shared window. Items with fewer than 13 words are one
window each: for them the hashes of all runs of that length are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import cut_lineage, guarded, keyed, map_arrow
from .wordhash import ALNUM_WORDS, ODD, gram_hashes, mix, text_chunks, word_hashes, word_spans

#: Words of a window; k-gram of the fingerprints. The sliding window follows from both.
SPAN, K = 13, 7


def runs(words: np.ndarray, bounds: np.ndarray, lengths: set[int]):
    """(n, hash, text) of all runs of n words inside a text, for each n asked for, each hash built on the one before."""
    if not len(words) or not lengths:
        return
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    stop = bounds[1:][text]
    at, h = np.arange(len(words)), np.zeros(len(words), dtype=np.uint64)
    for n in range(1, max(lengths) + 1):
        fits = at + n <= stop[at]
        at, h = at[fits], h[fits]
        h = mix(h * ODD + words[at + (n - 1)] + np.uint64(n))
        if n in lengths:
            yield n, h, text[at]


def winnow(h: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Indices of hashes that are the rightmost smallest of some run of ``window`` of one text (all of it, if shorter)."""
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(n)
    for back in range(1, window):
        at = np.maximum(np.arange(n) - back, 0)
        same = (np.arange(n) >= back) & (text[at] == text)
        best = np.where(same & (h[at] < h[best]), at, best)
    # A run is whole if it has ``window`` hashes, or ends its text.
    first = np.searchsorted(text, text)
    last = np.append(text[1:] != text[:-1], True)
    whole = (np.arange(n) - first >= window - 1) | last
    return np.unique(best[whole])


#: Slots of the bit table that lets a document's hash pass to the join only if the benchmark may hold it.
SLOTS = 1 << 22


def _prints(span: int, k: int, lengths: list[int], slots: np.ndarray | None = None):
    """Fingerprints of texts as (id, key, kind, hash).

    Kind 0 is a text's word count; kind ``k`` a kept k-gram of a text with ``span`` words or more; kind -n a run of n words.
    An item (no ``slots``) gets the run of all its words if it is shorter than ``span``; a document gets the runs of all
    ``lengths``, less what no benchmark hash can equal. Only word-count rows carry the key.
    """

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1)
            for first, data, offsets in text_chunks(batch.column(2)):
                low, starts, ends, bounds = word_spans(data, offsets, ALNUM_WORDS)
                words, size = word_hashes(low, starts, ends), np.diff(bounds)
                n_texts = len(size)
                rows, kinds, hashes = [np.arange(n_texts)], [np.zeros(n_texts, dtype=np.int64)], [size]
                for n, h, text in runs(words, bounds, {k, *lengths}):
                    parts = [(n, winnow(h, text, span - k + 1))] if n == k else []
                    parts = [(kind, at[size[text[at]] >= span]) for kind, at in parts]
                    if n in lengths:
                        parts.append((-n, np.flatnonzero(size[text] == n) if slots is None else np.arange(len(h))))
                    for kind, at in parts:
                        if slots is not None:
                            at = at[slots[(h[at] & np.uint64(SLOTS - 1)).astype(np.int64)]]
                        rows.append(text[at])
                        kinds.append(np.full(len(at), kind))
                        hashes.append(h[at].view(np.int64))
                row = np.concatenate(rows) + first
                key = pa.concat_arrays([keys.slice(first, n_texts), pa.nulls(len(row) - n_texts, pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), key, pa.array(np.concatenate(kinds)), pa.array(np.concatenate(hashes))], names=["id", "key", "kind", "hash"])

    return run


def _extend(span: int):
    """For each pair of texts the document's words (first and end) inside runs that it shares with the item's windows."""

    def run(batches):
        seen: dict[str, tuple[np.ndarray, int]] = {}
        for batch in batches:
            keys, items, texts, others = batch.columns
            out: list[tuple] = []
            rows = 0
            for at, (first, data, offsets) in enumerate(text_chunks(texts)):
                low, starts, ends, bounds = word_spans(data, offsets, ALNUM_WORDS)
                words = word_hashes(low, starts, ends)
                for i in range(len(offsets) - 1):
                    doc = words[bounds[i] : bounds[i + 1]]
                    other = others[first + i].as_py()
                    if other not in seen:
                        if len(seen) > 2000:
                            seen.clear()
                        raw = np.frombuffer(other.encode(), dtype=np.uint8)
                        a, b, c, d = word_spans(raw, np.array([0, len(raw)]), ALNUM_WORDS)
                        n = min(span, len(b))
                        seen[other] = (np.unique(gram_hashes(word_hashes(a, b, c), d, n)[0]) if n else np.zeros(0, dtype=np.uint64), n)
                    want, n = seen[other]
                    if not n or len(doc) < n:
                        continue
                    h, _, pos = gram_hashes(doc, np.array([0, len(doc)]), n)
                    pos = pos[np.isin(h, want)]
                    if not len(pos):
                        continue
                    gap = np.flatnonzero(np.diff(pos) > n)  # runs that touch or overlap are one
                    begin, stop = np.append(pos[0], pos[gap + 1]), np.append(pos[gap], pos[-1]) + n
                    key, item = keys[first + i].as_py(), items[first + i].as_py()
                    out += [(key, item, int(x), int(y)) for x, y in zip(begin, stop, strict=True)]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["_key", "item_id", "begin", "stop"])

    return run


def shared_spans(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Word counts (_key, n_words; one row of each distinct id and text) and shared spans (_key, item_id, begin, stop)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = items.withColumn("_item", F.concat_ws(":", F.xxhash64("text").cast("string"), F.hash("text").cast("string")))
    texts = items.select("_item", "text").dropDuplicates(["_item"])
    schema = "id long, key string, kind long, hash long"
    own = map_arrow(texts.select(F.monotonically_increasing_id().alias("id"), "_item", "text"), _prints(span, k, list(range(1, span))), schema)
    heads = own.where("kind = 0").select("id", F.col("key").alias("_item"))
    prints = cut_lineage(own.where("kind <> 0").join(heads, "id").select("_item", "kind", "hash").distinct())
    lengths = sorted(-r.kind for r in prints.where("kind < 0").select("kind").distinct().collect())  # at most span - 1 numbers
    slots = np.zeros(SLOTS, dtype=bool)
    slots[prints.select(F.pmod("hash", F.lit(SLOTS)).alias("slot")).distinct().toPandas().slot.to_numpy(dtype=np.int64)] = True  # at most SLOTS numbers
    docs_rows = keyed(docs)
    marks = map_arrow(docs_rows.select(F.monotonically_increasing_id().alias("id"), "_key", "text"), _prints(span, k, lengths, slots), schema)
    hits = marks.join(guarded(prints), ["kind", "hash"], "left").where((F.col("kind") == 0) | F.col("_item").isNotNull())
    # A row of each text and of each hit: little, and read three times.
    hits = cut_lineage(hits.groupBy("id", "_item").agg(F.max("key").alias("_key"), F.max(F.when(F.col("kind") == 0, F.col("hash"))).alias("n_words")))
    words = hits.where(F.col("_item").isNull()).select("id", "_key", "n_words").dropDuplicates(["_key"])
    pairs = hits.where(F.col("_item").isNotNull()).select("id", "_item").join(words.select("id", "_key"), "id").select("_key", "_item")
    held = docs_rows.select("_key", "text").join(guarded(pairs.select("_key").distinct()), "_key").dropDuplicates(["_key"])
    both = pairs.join(held, "_key").join(texts.select("_item", F.col("text").alias("other")), "_item").select("_key", "_item", "text", "other")
    found = map_arrow(both, _extend(span), "_key string, item_id string, begin long, stop long").withColumnRenamed("item_id", "_item")
    found = found.join(items.select("_item", "item_id"), "_item").select("_key", "item_id", "begin", "stop")
    return words.select("_key", "n_words"), found


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """_key, n_words, n_hit, n_items, items (sorted ids), contaminated; one row of each distinct (id, text) of ``docs``.

    A text is contaminated if its hit words are a twentieth of its words or more.
    """
    words, found = shared_spans(docs, benchmark, span, k)
    by_item = found.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("begin", "stop"))).alias("runs"), F.array_sort(F.collect_set("item_id")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    union = F.aggregate("runs", start, lambda a, r: F.struct((a.n + F.greatest(F.lit(0).cast("long"), r.stop - F.greatest(r.begin, a.end))).alias("n"), F.greatest(a.end, r.stop).alias("end")), lambda a: a.n)
    out = words.join(by_item, "_key", "left").select("_key", "n_words", F.coalesce(F.when(F.col("runs").isNotNull(), union), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``.

    Null and empty texts have no words and are clean; so is everything if the benchmark is empty. An item without
    words is no window. Items with the same text all count; a null item_id is left out of the ids. Repeated
    rows each give their row, null ids stay null, other columns are ignored.
    """
    judged = contamination(docs, benchmark, span, k)
    ids = keyed(docs).select("doc_id", "_key")
    out = ids.join(judged, "_key")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    bad = contamination(docs, benchmark, span, k).where("contaminated").select("_key")
    columns = docs.columns
    return keyed(docs, *[c for c in columns if c not in ("doc_id", "text")]).join(guarded(bad), "_key", "left_anti").select(*columns)
