"""Substring removal by suffix automata of reference shards.

A span of ``span`` words that also starts in a document with a smaller id goes. Which documents say what first is
answered by suffix automata: every state knows the smallest id of the documents that hold its substrings,
and texts are streamed through the automaton, which keeps the longest match that ends at each word (matching statistics).

The reference is the corpus itself, so its automaton has no size bound and can't be sent to every task. It is
cut so that no window has to look into two shards: of the k-grams of a window the smallest hash is its anchor, which
follows from the window's words alone; neighbouring windows with one anchor are one passage; a shard holds all passages of
its anchors. Anchors of one document only can't be shared and are left out before anything else is moved. Equal passages are one, with their smallest id, on both
sides. Each shard's automaton is built where the shard's passages are streamed, and holds about ``SHARD_WORDS`` words. An anchor
of very many documents would outgrow that, so its passages are cut into single windows, which are dealt by their own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .columns import cut_lineage, map_arrow, ship, text_or_empty
from .wordhash import ODD, mix, text_chunks, word_hashes, word_spans

SPAN, K = 13, 4
#: Words that an automaton holds on average; documents of an anchor beyond which its passages are cut into windows.
SHARD_WORDS, HEAVY = 40_000, 1_000
#: Largest bit table that is sent to the tasks (64 MB). It only spares shuffling: a set bit too many costs a row, never a result.
MOST_BITS, BITS_A_KEY, CHUNK = 1 << 29, 16, 1 << 16

#: Words [^\x20\x09-\x0D]+, unchanged; byte 0 is a word byte and takes a value that UTF-8 has not.
EXACT_WORDS = np.arange(256, dtype=np.uint8)
EXACT_WORDS[[32, 9, 10, 11, 12, 13]] = 0
EXACT_WORDS[0] = 255


class Automaton:
    """Suffix automaton of several word sequences; each state keeps the smallest owner of its substrings."""

    def __init__(self):
        self.steps, self.link, self.length, self.least = [{}], [-1], [0], [None]

    def _state(self, length: int, steps: dict, link: int, owner: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.least.append(owner)
        return len(self.length) - 1

    def _split(self, at: int, word: bytes, to: int) -> int:
        """A copy of ``to`` for the substrings that end in ``at`` followed by ``word``; the longer ones stay with ``to``."""
        steps, link = self.steps, self.link
        copy = self._state(self.length[at] + 1, dict(steps[to]), link[to], self.least[to])
        while at >= 0 and steps[at].get(word) == to:
            steps[at][word] = copy
            at = link[at]
        link[to] = copy
        return copy

    def add(self, words: list[bytes], owner: int) -> None:
        steps, link, length, least = self.steps, self.link, self.length, self.least
        last = 0
        for word in words:
            known = steps[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, word, known)
            else:
                new, at = self._state(length[last] + 1, {}, 0, owner), last
                while at >= 0 and word not in steps[at]:
                    steps[at][word] = new
                    at = link[at]
                if at >= 0:
                    to = steps[at][word]
                    link[new] = to if length[to] == length[at] + 1 else self._split(at, word, to)
                last = new
            if least[last] > owner:
                least[last] = owner

    def settle(self) -> None:
        """A substring occurs wherever a longer one that ends with it does: owners go down the suffix links."""
        for at in np.argsort(-np.asarray(self.length), kind="stable").tolist():
            to = self.link[at]
            if to > 0 and self.least[at] < self.least[to]:
                self.least[to] = self.least[at]

    def first_owners(self, words: list[bytes], span: int) -> list[int | None]:
        """For each window of ``span`` words the smallest owner of it; None where the match that ends there is shorter."""
        steps, link, length = self.steps, self.link, self.length
        at, match, out = 0, 0, []
        for i, word in enumerate(words):
            while at and word not in steps[at]:
                at = link[at]
                match = length[at]
            to = steps[at].get(word)
            at, match = (to, match + 1) if to is not None else (0, 0)
            if match >= span:
                while length[link[at]] >= span:
                    at = link[at]
                match = span
            if i >= span - 1:
                out.append(self.least[at] if match == span else None)
        return out


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of h[i : i + width] for each i (the last of equal ones); places near the end see fewer."""
    n, best, size = len(h), np.arange(len(h)), 1

    def better(shift):
        other = best[np.minimum(np.arange(n) + shift, n - 1)]
        return np.where(h[other] <= h[best], other, best)

    while size * 2 <= width:
        best = better(size)
        size *= 2
    return better(width - size) if size < width else best


def hashes_at(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        h = mix(h * ODD + words[at + j] + np.uint64(j + 1))
    return h


def passages(texts: pa.Array, span: int, k: int):
    """For each chunk of texts: first row, bytes, word spans and hashes, and of each passage its text, first word, windows and anchor."""
    for first, data, offsets in text_chunks(texts):
        low, starts, ends, bounds = word_spans(data, offsets, EXACT_WORDS)
        words, size = word_hashes(low, starts, ends), np.diff(bounds)
        none = np.zeros(0, dtype=np.int64)
        if not len(words) or size.max() < span:
            yield first, data, (starts, ends, bounds, words), none, none, none, np.zeros(0, dtype=np.uint64)
            continue
        grams = hashes_at(words, np.arange(max(len(words) - k + 1, 0)), k)
        best = least_of(grams, span - k + 1)
        windows = np.maximum(size - span + 1, 0)
        text = np.repeat(np.arange(len(size)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + bounds[text]
        anchor = best[at]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
        yield first, data, (starts, ends, bounds, words), text[new], at[new], np.diff(np.append(new, len(at))), grams[anchor[new]]


def _anchors(span: int, k: int):
    """Each text's anchors, once."""

    def run(batches):
        for batch in batches:
            for _, _, _, text, _, _, anchor in passages(batch.column(0), span, k):
                once = np.unique(mix(anchor + text.astype(np.uint64) * ODD), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[once].view(np.int64))], names=["anchor"])

    return run


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _listed(span: int, k: int, again, heavy, chosen=None):
    """Passages whose anchor may stand in several documents: (doc_id, tag, start, n, anchor, passage).

    With ``chosen`` only passages that were chosen from their document, and with their words: (route, passage, owner, words).
    """

    def run(batches):
        shared, many = (np.frombuffer(b.value, dtype=np.uint8) for b in (again, heavy))
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, data, spans, text, at, n, anchor in passages(batch.column(2), span, k):
                starts, ends, bounds, words = spans
                use = np.flatnonzero(_holds(shared, anchor))
                text, at, n, anchor = text[use], at[use], n[use], anchor[use]
                cut = _holds(many, anchor)
                times = np.where(cut, n, 1)
                row = np.repeat(np.arange(len(n)), times)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                text, at, anchor, cut = text[row], at[row] + step, anchor[row], cut[row]
                n = np.where(cut, 1, n[row])
                passage = mix(hashes_at(words, at, span) * ODD + hashes_at(words, at + n - 1, span) + n.astype(np.uint64))
                doc = ids[text + first]
                if chosen is None:
                    cells = [doc, tags[text + first], (at - bounds[text]).astype(np.int32), n.astype(np.int32), anchor.view(np.int64), passage.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["doc_id", "tag", "start", "n", "anchor", "passage"])
                    continue
                use = np.flatnonzero(_holds(np.frombuffer(chosen.value, dtype=np.uint8), passage ^ doc.view(np.uint64)))
                route = np.where(cut, passage, anchor)[use].view(np.int64)
                said = [data[x:y].tobytes() for x, y in zip(starts[at[use]].tolist(), ends[at[use] + n[use] + span - 2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(passage[use].view(np.int64)), pa.array(doc[use]), pa.array(said, pa.binary())], names=["route", "passage", "owner", "words"])

    return run


def _match(span: int):
    """One shard: build its automaton, then stream its passages. ``owners``: the smallest id for each window of a passage."""

    def run(table: pa.Table) -> pa.Table:
        machine, said = Automaton(), {}
        for passage, owner, words in zip(*(table.column(c).to_pylist() for c in ("passage", "owner", "words")), strict=True):
            if passage not in said:
                said[passage] = words.split()
            machine.add(said[passage], owner)
        machine.settle()
        owners = [machine.first_owners(words, span) for words in said.values()]
        return pa.table({"passage": pa.array(said, pa.int64()), "owners": pa.array(owners, pa.list_(pa.int64()))})

    return run


def bit_table(keys: DataFrame, size: int) -> bytes:
    """Bits of ``keys`` (hash) modulo a power of two that follows from ``size``; tasks fill chunks, the driver gets MOST_BITS at most."""
    bits = 1 << 16
    while bits < min(BITS_A_KEY * size, MOST_BITS):
        bits *= 2

    def fill(table: pa.Table) -> pa.Table:
        slots = np.unique(table.column("slot").to_numpy())
        marked = np.zeros(CHUNK, dtype=bool)
        marked[slots % CHUNK] = True
        return pa.table({"chunk": [int(slots[0] // CHUNK)], "bits": [np.packbits(marked, bitorder="little").tobytes()]})

    slot = F.expr(f"hash & {bits - 1}L")
    chunks = keys.select(slot.alias("slot")).distinct().groupBy(F.floor(F.col("slot") / CHUNK)).applyInArrow(fill, "chunk long, bits binary")
    table = bytearray(bits // 8)
    for row in chunks.toLocalIterator():
        table[row.chunk * CHUNK // 8 : (row.chunk + 1) * CHUNK // 8] = row.bits
    return bytes(table)


def covered(docs: DataFrame, span: int, k: int) -> DataFrame:
    """doc_id, tag (the text's hash), runs: array of (begin, stop), the words of a text that an earlier document says first."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), "text")
    again = cut_lineage(map_arrow(rows.select("text"), _anchors(span, k), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    n_again, n_many = again.agg(F.count(F.lit(1)), F.count_if(F.col("n") > HEAVY)).first()
    hashes = again.select(F.col("anchor").alias("hash"), "n")
    shared = spark.sparkContext.broadcast(bit_table(hashes, n_again))
    heavy = spark.sparkContext.broadcast(bit_table(hashes.where(F.col("n") > HEAVY), n_many))
    listed = map_arrow(rows, _listed(span, k, shared, heavy), "doc_id long, tag int, start int, n int, anchor long, passage long")
    if BITS_A_KEY * n_again > MOST_BITS:  # the table is too full to tell enough anchors apart
        listed = listed.join(again.select("anchor"), "anchor", "left_semi")
    root = scratch_path(spark, "substrings")
    listed.select("doc_id", "tag", "start", "n", "passage").write.parquet(root)
    listed = spark.read.parquet(root)

    first = cut_lineage(listed.groupBy("passage").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    n_first, total = first.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") + span - 1), F.lit(0))).first()
    chosen = spark.sparkContext.broadcast(bit_table(first.select(F.col("passage").bitwiseXOR(F.col("doc_id")).alias("hash")), n_first))
    words = map_arrow(rows, _listed(span, k, shared, heavy, chosen), "route long, passage long, owner long, words binary")
    shard = F.pmod(F.xxhash64("route"), F.lit(total // SHARD_WORDS + 1))
    owners = words.groupBy(shard.alias("shard")).applyInArrow(_match(span), "passage long, owners array<long>")

    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("owners", i) < F.col("doc_id"))
    hits = listed.join(owners, "passage").withColumn("said", places).where(F.size("said") > 0)
    # Windows of a passage lie closer than their length, so what they cover is one run.
    run = F.struct((F.col("start") + F.element_at("said", 1)).alias("begin"), (F.col("start") + F.element_at("said", -1) + span).alias("stop"))
    return hits.groupBy("doc_id", "tag").agg(F.collect_set(run).alias("runs"))


def _cut(batches):
    for batch in batches:
        ids, texts, runs = batch.columns
        n_words, n_removed, kept = [], [], []
        for text, cut in zip(texts, runs, strict=True):
            words = (text.as_py() or "").encode().split()  # the same six blanks
            n_words.append(len(words))
            if cut.is_valid:
                keep = np.ones(len(words), dtype=bool)
                for run in cut.as_py():
                    keep[run["begin"] : run["stop"]] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def _told_apart(bits):
    """(doc_id, text, tag) of the rows whose key the bit table holds, and of the others."""

    def split(batches, held: bool):
        for batch in batches:
            mark = _holds(np.frombuffer(bits.value, dtype=np.uint8), batch.column(3).to_numpy().view(np.uint64))
            yield batch.select(["doc_id", "text", "tag"]).filter(pa.array(mark == held))

    def whole(batches):
        for batch in split(batches, False):
            yield from _cut([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(len(batch))], names=["doc_id", "text", "runs"])])

    return lambda batches: split(batches, True), whole


def remove_repeats(docs: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed and the text left (words joined by one space) of every row of ``docs``.

    A word goes if it stands in a run of ``span`` words that also starts in a document with a smaller doc_id, as
    the texts were given. Null and empty texts have no words; texts below ``span`` words stay whole. A null doc_id is
    neither smaller nor larger: nothing goes there and nothing goes because of it. Rows with one doc_id don't
    take from each other, so repeated rows give equal rows. Other columns are ignored. An empty table gives an empty result.
    """
    runs = cut_lineage(covered(docs, span, k).withColumn("hash", F.xxhash64("doc_id", "tag")))
    marked = docs.sparkSession.sparkContext.broadcast(bit_table(runs, runs.count()))
    held, whole = _told_apart(marked)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.hash("text").alias("tag"))
    rows = rows.select("*", F.xxhash64("doc_id", "tag").alias("hash"))
    # Only texts that may lose words are moved to their runs; all others are written as they are read.
    joined = map_arrow(rows, held, "doc_id long, text string, tag int").join(runs, ["doc_id", "tag"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_words long, n_removed long, text string"
    return map_arrow(joined, _cut, schema).unionByName(map_arrow(rows, whole, schema))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
g AS (SELECT r, doc_id, i, hash(list_slice(w, i, i + 12)) AS h, array_to_string(list_slice(w, i, i + 12), ' ') AS t FROM p),
f AS (SELECT h, t, min(doc_id) AS o FROM g GROUP BY h, t),
c AS (SELECT DISTINCT g.r, g.i + k.k AS i FROM g JOIN f USING (h, t), (SELECT unnest(range(13)) AS k) k WHERE f.o < g.doc_id),
q AS (SELECT r, list(i) AS x, count(*) AS n FROM c GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(q.n, 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN q.r IS NULL THEN d.w ELSE list_filter(d.w, lambda x, i: NOT list_contains(q.x, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN q ON q.r = d.r
"""
