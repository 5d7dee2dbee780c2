"""Trie of conversation prefixes by ROLLUP over positional turn columns.

A conversation is cut into blocks of ``BLOCK`` turns, whose ids stand in positional columns. One ROLLUP over those columns
aggregates every prefix inside a block; grouping_id tells a prefix's length. A block is keyed by the node that the
blocks before it end in: an exclusive-or of hashes of (place, turn), so that it needs no walk down the trie, and all
blocks of all conversations go through the same ROLLUP at once.

Sums over a subtree need no walk either. A node belongs to its smallest member, and what a conversation owns is the lower end of its
path. So the tokens saved below a prefix are, for each member, those of its turns that it does not own, from the prefix on: a
difference of running sums, which a second ROLLUP adds up, together with one mark for the owner of each childless node.

One conversation, or one prefix, may hold any share of the rows: running sums are taken in parts of a sampled order and
carried over from part to part, groups are partial sums, and ids that end in one node are packed in parts before they are hashed.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import scratch_path
from .columns import cut_lineage, map_arrow

#: Turns of a block. Head of the rebuilt conversations: shared in groups of so many ids, less than so many turns.
BLOCK, GROUP, HEADS = 8, 100, 6
#: Ids that are packed into one row before they are hashed.
PACK = 10_000


def dealt(df: DataFrame, name: str, *order: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written in parts of a sampled order, with ``_part`` and ``_row``, which follow that order; no key stays in one part."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    root = scratch_path(df.sparkSession, name)
    parts.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).drop(*drop).write.parquet(root)
    return df.sparkSession.read.parquet(root)


def before(rows: DataFrame, key: str, sums: dict[str, Column], xors: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and running exclusive-ors of the rows before each row of its key, inside parts and then across them."""
    kinds = {**dict.fromkeys(sums, "sum"), **dict.fromkeys(xors or {}, "xor")}
    values = {**sums, **(xors or {})}

    def fold(kind: str, column: Column) -> Column:
        return F.sum(column) if kind == "sum" else F.bit_xor(column)

    nothing = F.lit(0).cast("long")
    earlier = W.partitionBy("_part", key).orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    own = rows.select("*", *[F.coalesce(fold(kinds[c], values[c]).over(earlier), nothing).alias(f"_in_{c}") for c in values])
    parts = rows.groupBy("_part", key).agg(*[fold(kinds[c], values[c]).alias(f"_all_{c}") for c in values])
    across = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row of each part at most
    parts = parts.select("_part", key, *[F.coalesce(fold(kinds[c], F.col(f"_all_{c}")).over(across), nothing).alias(f"_off_{c}") for c in values])
    joined = own.join(parts, ["_part", key])
    done = {c: (F.col(f"_in_{c}") + F.col(f"_off_{c}") if kinds[c] == "sum" else F.col(f"_in_{c}").bitwiseXOR(F.col(f"_off_{c}"))) for c in values}
    return joined.select(*rows.columns, *[v.alias(c) for c, v in done.items()]).drop("_part", "_row")


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and their turns (conv_id, place from 1, a, b, chars) after the heads were exchanged.

    The first h = crc32(id) % heads turns are those of the group's first conversation. Turns are ordered by turn (null first), then role, then text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    turns = turns.select("*", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("turn"), "text", "role").alias("b"), F.length("text").cast("long").alias("chars"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    turns = before(dealt(turns, "turns", *order, drop=("turn", "role", "text")), "conv_id", {"place": F.lit(1).cast("long")})
    turns = turns.withColumn("place", F.col("place") + 1)

    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    sizes = cut_lineage(sizes.select("conv_id", "size", (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"), (c - c % group).alias("base")))
    first = sizes.where(c == F.col("base")).select("base", F.col("size").alias("base_size"))
    sizes = sizes.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    head = turns.where((c % group == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    given = sizes.where("taken > 0").select("conv_id", "base", "h").join(head, "base").where("place <= h").select("conv_id", "place", "a", "b", "chars")
    own = turns.join(sizes.select("conv_id", "h", "taken"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "a", "b", "chars")
    return sizes.select("conv_id"), given.unionByName(own)


def _pack(batches):
    """Sorted (a, b, conv_id) as rows of PACK ids at most: (a, b, first, ids)."""
    key, held = None, []

    def row():
        return pa.RecordBatch.from_pylist([{"a": key[0], "b": key[1], "first": held[0], "ids": ",".join(map(str, held))}], schema=packed)

    packed = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != (a, b) or len(held) == PACK:
                if held:
                    yield row()
                key, held = (a, b), []
            held.append(c)
    if held:
        yield row()


def _digest(batches):
    """Sorted packs as one SHA-256 of each node; only the running hash is held."""
    key, running = None, None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        for a, b, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key == (a, b):
                running.update(b",")
            else:
                if key:
                    out.append({"a": key[0], "b": key[1], "ends_sha256": running.hexdigest()})
                key, running = (a, b), hashlib.sha256()
            running.update(ids.encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if key:
        yield pa.RecordBatch.from_pylist([{"a": key[0], "b": key[1], "ends_sha256": running.hexdigest()}], schema=schema)


def _blocks(ids: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """One row of each conversation and block: t1.. (turn ids), p1.. (running code points), the node before it (a, b) and the code points before it.

    A conversation without turns has a first block without turns.
    """
    at = F.col("place") - 1
    placed = turns.select("conv_id", F.floor(at / width).alias("block"), (at % width).cast("int").alias("slot"), F.struct("a", "b").alias("t"), "chars",
                          F.xxhash64("place", "a", "b").alias("x"), F.xxhash64("b", "a", "place").alias("y"))
    empty = [F.lit(None).cast(t).alias(n) for n, t in [("slot", "int"), ("t", "struct<a:bigint,b:bigint>"), ("chars", "bigint"), ("x", "bigint"), ("y", "bigint")]]
    placed = placed.unionByName(ids.select("conv_id", F.lit(0).cast("long").alias("block"), *empty))
    cells = [F.max(F.when(F.col("slot") == j, F.col("t"))).alias(f"t{j + 1}") for j in range(width)]
    runs = [F.coalesce(F.sum(F.when(F.col("slot") <= j, F.col("chars"))), F.lit(0)).alias(f"p{j + 1}") for j in range(width)]
    blocks = placed.groupBy("conv_id", "block").agg(*cells, *runs, *[F.coalesce(F.bit_xor(v), F.lit(0)).alias(f"block_{v}") for v in ("x", "y")])
    kept = dealt(blocks, "blocks", F.col("conv_id"), F.col("block"))
    return before(kept, "conv_id", {"chars": F.col(f"p{width}")}, {"a": F.col("block_x"), "b": F.col("block_y")})


def _rolled(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """Every prefix inside a block: the node (a, b), its parent (pa, pb), depth, level in the block, and the aggregates."""
    columns = ", ".join(f"t{j}" for j in range(1, width + 1))
    found = blocks.sparkSession.sql(
        f"SELECT block, a, b, {columns}, {width} - bit_count(grouping_id()) AS level, {sums} FROM {{blocks}} GROUP BY block, a, b, ROLLUP({columns})", blocks=blocks)
    last = F.coalesce(*[F.when(F.col("level") == j, F.col(f"t{j}").isNotNull()) for j in range(1, width + 1)], F.col("block") == 0)
    found = found.where(last)  # a prefix has all its turns; a later block's empty prefix is the block before's last

    def node(side: str, levels: range) -> Column:
        out = F.col(side)
        for j in levels:
            place, t = F.col("block") * width + j, F.col(f"t{j}")
            term = F.xxhash64(place, t["a"], t["b"]) if side == "a" else F.xxhash64(t["b"], t["a"], place)
            out = out.bitwiseXOR(F.when((F.col("level") >= j) & t.isNotNull(), term).otherwise(0))
        return out

    def parent(side: str) -> Column:
        out = F.col(side)
        for j in range(1, width):
            place, t = F.col("block") * width + j, F.col(f"t{j}")
            term = F.xxhash64(place, t["a"], t["b"]) if side == "a" else F.xxhash64(t["b"], t["a"], place)
            out = out.bitwiseXOR(F.when(F.col("level") > j, term).otherwise(0))
        return out

    rest = [c for c in found.columns if c not in ("block", "a", "b", *columns.split(", "))]
    return found.select(*rest, (F.col("block") * width + F.col("level")).alias("depth"), node("a", range(1, width + 1)).alias("a"), node("b", range(1, width + 1)).alias("b"),
                        parent("a").alias("pa"), parent("b").alias("pb"))


def trie(ids: DataFrame, turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """One row of each prefix of the conversations ``ids`` with ``turns`` (conv_id, place 1.., a, b: a 128-bit id of the turn, chars).

    a, b (the node's 128-bit id, 0 and 0 for the root), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = cut_lineage(_blocks(ids, turns, width))
    nodes = _rolled(blocks, width, "min(conv_id) AS conv_id, count(1) AS n_convs").where("n_convs > 0")
    nodes = cut_lineage(nodes.drop("level"))
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # What a conversation owns: its path from depth ``top`` on; ``leaf`` if that ends in a childless node.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    facts = blocks.join(owned, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    reach = F.lit(0).cast("long")
    for j in range(1, width + 1):
        theirs = F.col("top").isNull() | (F.col("block") * width + j < F.col("top"))
        reach = F.when(theirs, F.greatest(reach, F.col("chars") + F.col(f"p{j}"))).otherwise(reach)
    shared = facts.groupBy("conv_id").agg(F.max(reach).alias("shared"))
    facts = facts.join(shared, "conv_id")
    rest = [F.greatest(F.lit(0).cast("long"), F.col("shared") - F.col("chars") - (F.col(f"p{j - 1}") if j > 1 else 0)).alias(f"s{j}") for j in range(1, width + 1)]
    facts = facts.select("block", "a", "b", *[f"t{j}" for j in range(1, width + 1)], "leaf", *rest)
    sums = _rolled(facts, width, "sum(leaf) AS n_leaves, " + ", ".join(f"sum(s{j}) AS s{j}" for j in range(1, width + 1)))
    saved = F.coalesce(*[F.when(F.col("level") == j, F.col(f"s{j}")) for j in range(1, width + 1)], F.col("s1"))
    sums = sums.select("a", "b", "n_leaves", saved.alias("saved_tokens"))

    end = [F.bit_xor(f"block_{v}").alias(side) for side, v in (("a", "x"), ("b", "y"))]
    ends = blocks.groupBy("conv_id").agg(*end).select("a", "b", "conv_id")
    packs = map_arrow(ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id"), _pack, "a long, b long, first long, ids string")
    digests = map_arrow(packs.repartition("a", "b").sortWithinPartitions("a", "b", "first"), _digest, "a long, b long, ends_sha256 string")

    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
    out = nodes.join(sums, ["a", "b"], "left").join(digests, ["a", "b"], "left").join(above, ["pa", "pb"], "left")
    return out.select("a", "b", "conv_id", "depth", F.when(F.col("depth") > 0, F.col("above")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the rebuilt conversations: see ``trie`` and ``rebuilt``.

    A null conv_id names no conversation, so its rows are left out. Null roles and texts are empty; null turns come first; equal turns are
    ordered by role and text, and repeated rows are repeated turns. Conversations left without turns are members of the root. An
    empty table has no conversation, hence no node. Other columns are ignored.
    """
    ids, turns = rebuilt(conversations)
    return trie(ids, turns).drop("a", "b")


ORACLE = """
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8))) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM o), tab),
u AS (SELECT c.conv_id, o.k, 0 AS own, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.k <= c.h
    UNION ALL SELECT c.conv_id, o.k, 1, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h),
l AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY own, k) AS s FROM u GROUP BY conv_id),
b AS (SELECT conv_id, coalesce(s, []) AS s FROM c LEFT JOIN l USING (conv_id)),
m AS (SELECT conv_id, unnest(range(len(s) + 1)) AS depth, s FROM b),
p AS (SELECT conv_id, depth, list_slice(s, 1, depth) AS q, len(s) = depth AS ends FROM m),
n AS (SELECT depth, q, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(q[depth].t) END AS w FROM p GROUP BY depth, q),
i AS (SELECT row_number() OVER () AS id, * FROM n),
g AS (SELECT i.*, a.id AS pid, a.conv_id AS parent_conv_id FROM i LEFT JOIN i a ON a.depth = i.depth - 1 AND a.q = list_slice(i.q, 1, i.depth - 1)),
k AS (SELECT pid, count(*) AS n_children FROM g WHERE pid IS NOT NULL GROUP BY pid),
f AS (SELECT g.*, coalesce(k.n_children, 0) AS n_children FROM g LEFT JOIN k ON k.pid = g.id),
x AS (SELECT f.id, unnest(range(f.depth + 1)) AS d, f.q, f.w, (f.n_children = 0)::BIGINT AS leaf FROM f),
z AS (SELECT a.id, sum(x.leaf)::BIGINT AS n_leaves, sum(x.w)::BIGINT AS saved_tokens FROM x JOIN i a ON a.depth = x.d AND a.q = list_slice(x.q, 1, x.d) GROUP BY a.id)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs, f.n_children, z.n_leaves, z.saved_tokens, sha256(f.e) AS ends_sha256 FROM f JOIN z USING (id)
"""
