"""Near-duplicates by bottom-k sketches from one hash function.

A text's sketch is the ``k`` smallest hashes of its shingle set. Texts with the same set are one class and
only classes are compared. A linked pair shares at least ``least_shared`` sketch values, so it
shares one of the rarest (size - least_shared + 1) values of either sketch: only those are posted in the
inverted lists, and values that stand in one sketch are not posted at all. In a list every class is
tried against a pivot (the class whose values are most common), which links a group of near copies with
one try a member. The classes of lists that still hold several components are posted again, under the rarest
of all their shingles: so few that the bound is exact, and with their places, which bound what two classes
can share beyond them. There each class outside a list's largest component is tried against the other
components, if the places allow a link: the likeliest pairs first, and of the others those that have not joined by then. After that every pair that may be linked is in one component or was tried,
so no link is lost and no group is spelled out as pairs. A try is first an estimate from the union's sketch, then the exact Jaccard of the full sets.
"""

from __future__ import annotations

from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import cut_lineage, guarded, keyed, map_arrow
from .components import components
from .wordhash import BLANK_WORDS, gram_hashes, mix, text_chunks, word_hashes, word_spans

WORDS, K, PERCENT = 5, 64, 85
#: Chance that a linked pair shares fewer sketch values than is counted on.
TAIL = 1e-8
_A, _B = np.uint64(0x632BE59BD9B4E019), np.uint64(0x8CB92BA72F3D8DD7)


def least_shared(k: int, percent: int, tail: float = TAIL) -> int:
    """Largest c with P(fewer than c of k draws are shared) <= tail at this similarity."""
    p, below = percent / 100, 0.0
    for c in range(k + 1):
        below += comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > tail:
            return c
    return k


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """Sorted distinct 63-bit shingle hashes of each text; with fewer words the whole sequence, without words nothing."""
    for _, data, offsets in text_chunks(texts):
        low, starts, ends, bounds = word_spans(data, offsets, BLANK_WORDS)
        hashes = word_hashes(low, starts, ends)
        grams, text, _ = gram_hashes(hashes, bounds, words)
        at = np.searchsorted(text, np.arange(len(offsets)))
        grams = grams >> np.uint64(1)
        for i in range(len(offsets) - 1):
            n = bounds[i + 1] - bounds[i]
            if 0 < n < words:
                yield gram_hashes(hashes[bounds[i] : bounds[i + 1]], np.array([0, n]), int(n))[0] >> np.uint64(1)
            else:
                yield np.unique(grams[at[i] : at[i + 1]])


def _sketch(words: int, k: int):
    def run(batches):
        for batch in batches:
            sizes, keys, kept = [], [], []
            for s in shingle_sets(batch.column(2), words):
                sizes.append(len(s))
                keys.append(np.array([mix(s ^ _A).sum(), mix(s ^ _B).sum()], dtype=np.uint64).tobytes() + len(s).to_bytes(4, "big") if len(s) else None)
                kept.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "_key", "n", "set", "sketch"])

    return run


#: Tries of a class in the first round against the components it is not in; the second has its square, the third the rest.
TURNS = 8
#: Pairs whose texts are hashed at once.
TRY_ROWS = 400


def _confirm(words: int, percent: int):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), TRY_ROWS):
                a, b, ta, tb = batch.slice(at, TRY_ROWS).columns
                ids = a.to_pylist()
                # A pivot's text comes in many rows: its set is made once.
                held = {x: held[x] for x in set(ids) if x in held}
                first = {x: i for i, x in reversed(list(enumerate(ids))) if x not in held}
                held.update(zip(first, shingle_sets(ta.take(pa.array(list(first.values()), pa.int64())), words), strict=True))
                ok = []
                for x, s in zip(ids, shingle_sets(tb, words), strict=True):
                    both = len(np.intersect1d(held[x], s, assume_unique=True))
                    ok.append(100 * both >= percent * (len(held[x]) + len(s) - both))
                yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    return run


def estimate_passes(a: Column, b: Column, na: Column, nb: Column, k: int, percent: int) -> Column:
    """May the pair be similar enough? Exact where the union's sketch is the union itself."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    whole = (na <= k) & (nb <= k) & (F.size(F.array_union(a, b)) <= k)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & F.when(whole, 100 * shared >= percent * F.size(union)).otherwise(shared >= least_shared(k, percent))


def _tried(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    # Few classes are in a pair: only their sketches travel.
    asked = cut_lineage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    some = classes.join(guarded(asked), "id", "left_semi")
    left = some.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = some.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    likely = pairs.join(right, "b").join(left, "a").where(estimate_passes(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), k, percent)).select("a", "b")
    likely = cut_lineage(likely)
    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    keys = classes.select("id", "_key").join(wanted, "id")
    held = cut_lineage(texts.join(guarded(keys), "_key").dropDuplicates(["id"]).select("id", "text"))
    both = likely.join(held.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(held.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return map_arrow(both.select("a", "b", "ta", "tb"), _confirm(words, percent), "a long, b long")


def _shingles(words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in range(0, len(batch), TRY_ROWS):
                sets = list(shingle_sets(batch.column(1).slice(at, TRY_ROWS), words))
                sizes = [len(x) for x in sets]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + TRY_ROWS], sizes)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "v"])

    return run


def _exact_postings(open_ids: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(v, id, root, n, at): the rarest shingles of each open class, as many as two linked sets must share one of.

    ``at`` is the shingle's place (from 1) in its class, rarest first; rarity is counted over the open classes.
    """
    wanted = classes.select("id", "n", "_key").join(open_ids, "id")
    held = texts.join(guarded(wanted.select("id", "_key")), "_key").dropDuplicates(["id"]).select("id", "text")
    values = cut_lineage(map_arrow(held, _shingles(words), "id long, v long"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("id")
    posted = values.join(common, "v").withColumn("_r", F.row_number().over(own.orderBy("df", "v"))).withColumn("_m", F.count(F.lit(1)).over(own))
    posted = posted.join(wanted.select("id", "n", "root"), "id").withColumn("at", F.col("_r") + F.col("n") - F.col("_m"))
    return posted.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1).select("v", "id", "root", "n", "at")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose classes are not in one component."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}")), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    return pairs.where("_a <> _b").drop("_a", "_b")


def links(classes: DataFrame, texts: DataFrame, words: int = WORDS, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links between classes (a, b), enough to connect every linked pair, and their components (node, root).

    ``classes`` (id, _key, n, sketch) has one row of each shingle set, ``texts`` (_key, text) the text of each.
    """
    values = classes.select("id", "n", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    size = F.least(F.col("n"), F.lit(k))
    # A set of up to k * percent / 100 shingles is compared with whole sets only: there the bound is exact.
    need = F.when(F.col("n") * 100 <= k * percent, F.ceil(F.col("n") * percent / 100.0)).otherwise(F.lit(least_shared(k, percent)))
    held = values.join(common, "v")
    own = Window.partitionBy("id")
    rank = F.row_number().over(own.orderBy("df", "v"))
    # Values of one sketch only are the rarest: they take their places in front.
    posted = held.withColumn("_r", rank).withColumn("_m", F.count(F.lit(1)).over(own)).withColumn("_sum", F.sum("df").over(own))
    posted = posted.where(F.col("_r") + size - F.col("_m") <= size - need + 1).select("v", "id", "n", (F.col("_sum") / size).alias("typical"))
    posted = cut_lineage(posted)
    pivots = posted.groupBy("v").agg(F.max_by("id", F.struct("typical", "id")).alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    stars = posted.join(pivots, "v").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = cut_lineage(stars)
    found = cut_lineage(_tried(stars, classes, texts, words, k, percent))
    roots = components(found)

    # Lists that still hold several components: their smaller ones against the rest, less what was tried.
    placed = posted.join(pivots.select("v"), "v").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("v", "id", "n", F.coalesce("root", "id").alias("root"))
    shares = placed.groupBy("v", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = shares.groupBy("v").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ids = placed.join(largest.select("v"), "v").select("id", "root").distinct()
    exact = cut_lineage(_exact_postings(open_ids, classes, texts, words, percent))
    shares = exact.groupBy("v", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = shares.groupBy("v").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    lists = exact.join(largest, "v")
    outside = lists.where("root <> main").select("v", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("at_b"), F.col("root").alias("other"))
    # If v is the first value that both hold, no more than this can be shared; at the pair's first common value it must do.
    most = F.least(F.col("n") - F.col("at"), F.col("nb") - F.col("at_b")) + 1
    may = (most * (100 + percent) >= percent * (F.col("n") + F.col("nb"))) & (F.col("root") != F.col("other")) & ((F.col("root") == F.col("main")) | (F.col("id") < F.col("b")))
    close = (most * (100 + percent) - percent * (F.col("n") + F.col("nb"))).alias("close")
    met = lists.alias("l").join(outside.alias("o"), (F.col("l.v") == F.col("o.v")) & may).select(F.col("id").alias("a"), "b", close)
    tried = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = cut_lineage(met.groupBy("a", "b").agg(F.max("close").alias("close")).join(tried, ["a", "b"], "left_anti"))
    # The pairs that may share most come first; one link spares a class its other tries against the same component.
    lined = rest.withColumn("_r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("close"), "a")))
    for turn in (F.col("_r") <= TURNS, F.col("_r").between(TURNS + 1, TURNS**2), F.col("_r") > TURNS**2):
        pairs = cut_lineage(apart(lined.where(turn).select("a", "b"), roots))
        if pairs.take(1):
            more = cut_lineage(_tried(pairs, classes, texts, words, k, percent))
            found = found.unionByName(more)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)) if more.take(1) else roots
    return found, roots


def near_duplicates(docs: DataFrame, words: int = WORDS, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, _key, n_shingles, component_id and kept of every row of ``docs``.

    component_id is the smallest doc_id that links reach, kept tells whether it is the row's own. Null
    and empty texts have no shingle, stand alone and are kept. Repeated rows share a component and
    an id, so each is kept or none; a null id counts only where a component has no other, and is kept then.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = keyed(docs)
    sets = cut_lineage(map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_key", "text"), _sketch(words, k), "doc_id long, _key string, n long, `set` binary, sketch array<long>"))
    classes = cut_lineage(sets.where("n > 0").select("set", "_key", "n", "sketch").dropDuplicates(["set"]).withColumn("id", F.monotonically_increasing_id()))
    _, roots = links(classes.drop("set"), rows.select("_key", "text"), words, k, percent)
    members = sets.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    placed = classes.select("id", "set").join(members, "set").join(roots.withColumnRenamed("node", "id"), "id", "left").select("set", "least", F.coalesce("root", "id").alias("root"))
    placed = cut_lineage(placed)
    ids = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set", "component_id")
    full = sets.where("n > 0").select("doc_id", "_key", "n", "set").join(ids, "set").select("doc_id", "_key", "n", "component_id")
    out = full.unionByName(sets.where("n = 0").select("doc_id", "_key", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "_key", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = WORDS, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` less all but one of each component, with their columns; rows without words all stay."""
    columns = docs.columns
    judged = near_duplicates(docs, words, k, percent)
    chosen = judged.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("component_id").agg(F.min("_key").alias("_key")).select("_key")
    chosen = chosen.unionByName(judged.where("n_shingles = 0").select("_key")).distinct()
    rows = keyed(docs, *[c for c in columns if c not in ("doc_id", "text")])
    one = rows.join(chosen, "_key", "left_semi")
    return one.dropDuplicates(["_key"]).select(*columns)
