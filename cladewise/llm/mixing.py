"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The tree is domain, language, source. A node's budget is shared among its children by weight; no child gets more
than its capacity (its tokens times the most epochs), and what one cannot take goes to its siblings by weight before
anything is given back to the level above: a node's own capacity is the sum of its leaves', so a shortage reaches
the ancestors only if the whole family is full. A leaf's budget is a prefix of its seeded epochs: as many whole
passes as fit, then the documents of the next pass in that epoch's order while their tokens fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import cut_lineage, guarded

#: Most passes over a document; share of all tokens that is asked for (in percent); seed of the epochs' orders.
EPOCHS, PERCENT, SEED = 4, 60, "mix"
#: Hexadecimal digits of an order's bins: a leaf's cut is found in 16^DIGITS bins, then in as many inside one of them, then by documents.
DIGITS = 3
#: Target weights by name; a name that is not listed has weight 1.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 1}

LEVELS = ["domain", "lang", "source"]


def tokens(text: Column) -> Column:
    """Words of a text: maximal runs without blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def default_domain(source: Column) -> Column:
    """Domain of a source where the table names none: one of four, by the name's last character."""
    return F.concat(F.lit("domain"), (F.ascii(F.right(F.coalesce(source, F.lit("")), F.lit(1))) % 4).cast("string"))


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, weight).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Budget of each child from its parent's: rows have the parent's columns, child, weight, capacity and budget (the parent's).

    Children fill in the order of capacity per weight; the first that is not full, and all behind it, share what is
    left by weight. Whole numbers, rounded down; a parent has as many rows as it has children.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    held = nodes.withColumn("_left", left).withColumn("_weights", weights)
    full = (F.col("capacity") * F.col("_weights") <= F.col("_left") * F.col("weight")).cast("int")
    # Children before the first that is not full are full; behind it, all share by that one's level.
    held = held.withColumn("_full", F.min(full).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = held.withColumn("_r", F.row_number().over(order))
    level = F.min(F.when(F.col("_full") == 0, F.struct("_r", "_left", "_weights"))).over(Window.partitionBy(*parent))
    out = rank.withColumn("_level", level)
    part = F.expr("_level._left * weight div _level._weights")
    return out.withColumn("budget", F.when(F.col("_full") == 1, F.col("capacity")).otherwise(F.least(part, F.col("capacity")))).drop("_left", "_weights", "_full", "_r", "_level")


def leaf_budgets(sizes: DataFrame, budget: Column, epochs: int, weights: tuple[dict[str, int], ...]) -> DataFrame:
    """(domain, lang, source, tokens, budget) from the leaves' tokens: budgets go down the tree level by level."""
    sizes = sizes.withColumn("capacity", F.col("tokens") * epochs)
    total = sizes.agg(F.sum("tokens").alias("_t"), F.sum("capacity").alias("_c")).select(F.least(budget, F.col("_c")).alias("budget"))
    out = None
    for depth, level in enumerate(LEVELS):
        parent, own = LEVELS[:depth], LEVELS[: depth + 1]
        nodes = sizes.groupBy(*own).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(level, weights[depth]))
        nodes = nodes.join(F.broadcast(total), F.lit(True)) if out is None else nodes.join(out.select(*parent, "budget"), parent)
        out = share(nodes, parent, level)
    return out.select(*LEVELS, "tokens", "budget")


def _boundary(bins: DataFrame, by: str, room: str) -> DataFrame:
    """Of each leaf's bins (sum t) in order the first that no longer fits in ``room``, and the room left in it."""
    order = Window.partitionBy(*LEVELS).orderBy(by)
    upto = bins.withColumn("_upto", F.sum("t").over(order))
    over = upto.where(F.col("_upto") > F.col(room))
    return over.groupBy(*LEVELS).agg(F.min(F.struct(by, (F.col(room) - F.col("_upto") + F.col("t")).alias("_room"))).alias("_b")).select(*LEVELS, F.col(f"_b.{by}").alias(by), F.col("_b._room").alias("_room"))


def cuts(rows: DataFrame) -> DataFrame:
    """(leaf, cut): the last place in the order that fits. Rows have the leaf, rest (tokens wanted), place (hexadecimal) and n_tokens.

    A leaf without a row here takes its whole last pass. Rows with the same place go together.
    """
    rows = rows.select(*LEVELS, "rest", "n_tokens", "place", F.substring("place", 1, DIGITS).alias("a"), F.substring("place", DIGITS + 1, DIGITS).alias("b"))
    first = _boundary(rows.groupBy(*LEVELS, "a").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest")), "a", "rest")
    inner = rows.join(guarded(first), [*LEVELS, "a"])
    second = _boundary(inner.groupBy(*LEVELS, "a", "b").agg(F.sum("n_tokens").alias("t"), F.max("_room").alias("rest")), "b", "rest")
    last = inner.drop("_room").join(guarded(second), [*LEVELS, "b"])
    third = _boundary(last.groupBy(*LEVELS, "place").agg(F.sum("n_tokens").alias("t"), F.max("_room").alias("rest")), "place", "rest")
    return third.select(*LEVELS, F.col("place").alias("cut"))


def mix(docs: DataFrame, *keep: str, budget: int | None = None, percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED, domain: Column | None = None,
        weights: tuple[dict[str, int], ...] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """doc_id, the columns named, domain, lang, source, n_tokens and copies (passes that hold the document) of every row of ``docs``.

    ``budget`` is in tokens; without it ``percent`` of all. A null language or source is the leaf ``""``. A document without tokens costs
    nothing and comes with its leaf's passes. Rows with the same id (and all without one) have one place in
    an order and are taken together. Other columns are ignored; an empty table gives an empty result.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, (default_domain(source) if domain is None else domain).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"), tokens(F.col("text")).alias("n_tokens"))
    slim = cut_lineage(rows.select("doc_id", *LEVELS, "n_tokens"))
    sizes = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    wanted = F.lit(budget).cast("long") if budget is not None else F.expr(f"_t * {int(percent)} div 100")
    leaves = leaf_budgets(sizes, wanted, epochs, weights)
    passes = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")
    leaves = cut_lineage(leaves.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens")).select(*LEVELS, "passes", "rest"))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("passes").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    ordered = slim.join(guarded(leaves), LEVELS).withColumn("place", place)
    limits = leaves.join(cut_lineage(cuts(ordered)), LEVELS, "left")
    out = rows.join(guarded(limits), LEVELS)
    # ``cut`` is the first place that no longer fits.
    more = F.when(F.col("rest") <= 0, F.lit(0)).when(F.col("cut").isNull() | (place < F.col("cut")), F.lit(1)).otherwise(F.lit(0))
    return out.select("doc_id", *keep, *LEVELS, "n_tokens", (F.col("passes") + more).alias("copies"))


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _level_sql(depth: int, weights: dict[str, int]) -> str:
    parent, own = LEVELS[:depth], LEVELS[: depth + 1]
    cols, over = ", ".join(own), f"PARTITION BY {', '.join(parent)} " if parent else ""
    above = f"JOIN b{depth - 1} p USING ({', '.join(parent)})" if parent else "CROSS JOIN total p"
    order = f"{over}ORDER BY capacity / weight, {own[-1]}"
    return f"""
n{depth} AS (SELECT {', '.join('s.' + c for c in own)}, sum(s.capacity)::BIGINT AS capacity, sum(s.tokens)::BIGINT AS tokens, {_case('s.' + own[-1], weights)} AS weight FROM sizes s GROUP BY {', '.join('s.' + c for c in own)}),
m{depth} AS (SELECT n.*, p.budget AS above FROM n{depth} n {above}),
o{depth} AS (SELECT *, greatest(above - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS room,
  (sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS heavy, row_number() OVER ({order}) AS r FROM m{depth}),
f{depth} AS (SELECT *, min((capacity * heavy <= room * weight)::INT) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_full FROM o{depth}),
l{depth} AS (SELECT {', '.join(parent) + ', ' if parent else ''}arg_min(room, r) AS room1, arg_min(heavy, r) AS heavy1, 1 AS one FROM f{depth} WHERE is_full = 0 {'GROUP BY ' + ', '.join(parent) if parent else ''}),
b{depth} AS (SELECT {', '.join('f.' + c for c in own)}, f.tokens, CASE WHEN is_full = 1 THEN capacity ELSE least(room1 * weight // heavy1, capacity) END::BIGINT AS budget
  FROM f{depth} f LEFT JOIN l{depth} l ON {' AND '.join(f'f.{c} = l.{c}' for c in parent) or 'true'})"""


#: The same rows in DuckDB SQL for the default parameters.
ORACLE = (
    rf"""
WITH slim AS (SELECT doc_id, 'domain' || (ascii(right(coalesce(source, ''), 1)) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+'))::BIGINT AS n_tokens FROM documents),
sizes AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {EPOCHS})::BIGINT AS capacity FROM slim GROUP BY 1, 2, 3),
total AS (SELECT least(sum(tokens) * {PERCENT} // 100, sum(capacity))::BIGINT AS budget FROM sizes),"""
    + ",".join(_level_sql(d, w) for d, w in enumerate((DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)))
    + rf""",
leaves AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS passes, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM b2),
placed AS (SELECT s.*, passes, rest, md5('{SEED}:' || passes || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM slim s JOIN leaves USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, (passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM summed
"""
)
