"""Approximate nearest neighbours by a permutation index.

A vector is described by its nearest pivots in order. It is posted in the inverted files of its first
``post`` pivots; a query reads the files of its own first pivots, more of them the more pivots there are. Within a file candidates are ranked by the footrule
distance of the two pivot orders, and the best share is ranked again by the exact inner product.
Files are cut into blocks of bounded size, so that a file with most of the vectors is many tasks.
A query that found fewer than k candidates is searched against all vectors, in the same blocks.
"""

from __future__ import annotations

from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import cut_lineage, map_arrow, share_of, ship

#: Pivots: the power of two next to n^0.4 for n vectors, between these bounds (the bounds hold the model, not the rows).
PIVOTS = (16, 1024)
#: Files that a vector is posted in and a query reads (at up to ``READ_PIVOTS`` pivots, see ``files_read``); pivots compared by the footrule; share of a file that is ranked again.
POST, READ, ORDER, SHARE = 6, 14, 32, 0.55
READ_PIVOTS = 128
#: Vectors and queries of one task's block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def files_read(pivots: int, read: int = READ) -> int:
    """Files that a query reads of so many: with the root of the pivots, as a fixed number loses neighbours when the files grow finer."""
    return min(pivots, max(read, ceil(read * sqrt(pivots / READ_PIVOTS))))


def fit_pivots(vectors: DataFrame, count: int, size: int) -> np.ndarray:
    """Up to ``count`` of the ``size`` vectors, those with a small hash of their components, scaled to length 1: a bounded sample."""
    likely = vectors.select("vec").where(share_of(F.col("vec")) * size < 4 * count).distinct()
    rows = likely.orderBy(F.xxhash64("vec"), "vec").limit(count).collect() or vectors.select("vec").limit(1).collect()
    found = np.array([r.vec for r in rows], dtype=np.float64)
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vec as doubles) of the rows with a non-zero vector without null or non-finite components."""
    vec = F.col(vector_column).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), vec.alias("vec")).where(F.coalesce(fine, F.lit(False)))


def _orders(pivots: np.ndarray, order: int):
    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(len(batch), -1) if len(batch) else np.zeros((0, pivots.shape[1]))
            nearest = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :order].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(nearest), pa.list_(pa.int32()))], names=["vec_id", "vec", "nearest"])

    return run


def _places(orders: np.ndarray, pivots: int) -> np.ndarray:
    """Place of each pivot (row) in each order (column); pivots that an order lacks stand behind its end."""
    out = np.full((len(orders), pivots), orders.shape[1], dtype=np.int8)
    np.put_along_axis(out, orders, np.arange(orders.shape[1], dtype=np.int8)[None, :], axis=1)
    return np.ascontiguousarray(out.T)


def footrules(places: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Footrule distance of ``order`` from each column's order, less what is the same for all of them.

    A pivot that only the other order holds stands behind this one's end; those terms are a constant less the
    places of the pivots that both hold, so they come with the sum over this order's pivots.
    """
    part = places[order]
    return (np.abs(part - np.arange(len(order), dtype=np.int8)[:, None]) + part).sum(axis=0, dtype=np.int16)


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id, less the query's own rows."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search(pivots: int, k: int, share: float):
    def run(key, files: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(files) and len(asked):
            ids, vectors = files.vec_id.to_numpy(), np.stack(files.vec)
            queries = np.stack(asked.q_vec)
            scores = queries @ vectors.T
            if share < 1:
                theirs, own = np.stack(files.nearest), np.stack(asked.q_nearest)
                places = _places(theirs, pivots)
                keep = max(int(np.ceil(share * len(ids))), min(len(ids), 4 * k))
                for i, q in enumerate(asked.q_vec_id):
                    far = footrules(places, own[i])
                    near = np.argpartition(far, keep - 1)[:keep] if keep < len(ids) else np.arange(len(ids))
                    at = near[_best(ids[near], scores[i, near], q, k)]
                    out.append((np.full(len(at), q), ids[at], at, i))
            else:
                for i, q in enumerate(asked.q_vec_id):
                    at = _best(ids, scores[i], q, k)
                    out.append((np.full(len(at), q), ids[at], at, i))
            # The exact measure, summed in one order for every block.
            return pd.DataFrame({"query_id": np.concatenate([x[0] for x in out]), "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([(vectors[x[2]] * queries[x[3]]).sum(axis=1) for x in out])})
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def _blocks(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Number the blocks of each file: as many as its size asks for, a row's block from its id."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}s"))
    return rows.join(sizes, key).withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col(f"{name}s")).cast("int"))


def _ask(posted: DataFrame, asked: DataFrame, pivots: int, k: int, share: float) -> DataFrame:
    """Best k of each block of each file for the queries that read it: both sides have (file, vec_id, vec, nearest)."""
    files = _blocks(posted, "file", BLOCK_ROWS, "block")
    queries = _blocks(asked, "file", BLOCK_QUERIES, "part")
    # Each block meets each part of the queries once.
    parts = queries.select("file", "parts").distinct()
    left = files.join(parts, "file").select("file", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "vec", "nearest")
    right = queries.join(files.select("file", "blocks").distinct(), "file").select("file", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "vec_id", "vec", "nearest")
    keys = ["file", "block", "part"]
    # Fresh names: both sides stem from one table.
    right = right.select(*(F.col(c).alias(f"q_{c}") for c in right.columns))
    return left.groupBy(*keys).cogroup(right.groupBy("q_file", "q_block", "q_part")).applyInPandas(_search(pivots, k, share), "query_id long, vec_id long, score double")


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each vector once: query_id, rank, vec_id, score."""
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", post: int = POST, read: int = READ, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found, by inner product, of the rows where ``queries`` (a Column over vec_id) holds.

    Rows whose id or vector is null, whose vector is zero, empty or holds null or non-finite components take no part. Vectors of another
    length than the most common one take no part either. Of repeated ids each candidate counts once, with its largest score; a
    query never finds its own id. Fewer than k candidates give fewer rows; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_column, vector_column)
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vec") == lengths.d)
    count = min(max(PIVOTS[0], 2 ** round(0.4 * log2(lengths.n))), PIVOTS[1])
    pivots = fit_pivots(rows, count, lengths.n)
    size = min(ORDER, len(pivots))
    index = cut_lineage(map_arrow(rows, _orders(pivots, size), "vec_id long, vec array<double>, nearest array<int>"))
    asked = index.where(queries)
    posted = index.select("*", F.explode(F.slice("nearest", 1, min(post, size))).alias("file"))
    # A query may read more files than the footrule compares pivots: its longer order is made for the queries only.
    wide = files_read(len(pivots), read)
    longer = map_arrow(asked.select("vec_id", "vec"), _orders(pivots, max(wide, size)), "vec_id long, vec array<double>, nearest array<int>")
    read_files = longer.select("vec_id", "vec", F.slice("nearest", 1, size).alias("nearest"), F.explode(F.slice("nearest", 1, wide)).alias("file"))
    found = cut_lineage(_ask(posted, read_files, len(pivots), k, share))
    counts = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.countDistinct("vec_id").alias("c")).where(F.col("c") >= k)
    short = asked.join(counts, "vec_id", "left_anti")
    if short.take(1):  # every vector, in blocks, for those queries
        files = max(1, lengths.n // BLOCK_ROWS)
        blocks = index.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(files)).cast("int").alias("file"))
        every = short.select("*", F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("file"))
        found = found.unionByName(_ask(blocks, every, len(pivots), k, 1.0))
    return top(found, k)
