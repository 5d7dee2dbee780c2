"""Ranks, quantiles and false-discovery control without a single-task sort.

Everything here starts from the counted distinct values. They are dealt to parts by sampled bounds and written once, so
that the parts stay as they are; running sums are taken inside a part, and the parts' totals carry the offsets. A
group, or the whole table, is thus never sorted in one task, and equal values never meet in one row
list: they are one counted row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut_lineage


def in_parts(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows dealt by sampled bounds of the order and written once, with ``_part``, a number that grows with it."""
    return cut_lineage(rows.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())


def positions(df: DataFrame, *order: Column, out: str = "place") -> DataFrame:
    """1..n in the given order, which must have no ties; any type orders.

    Rows are dealt by sampled bounds of the order and written once, so that the parts stay as they are; the rows of
    a part are numbered in it, and the parts' sizes carry the offsets.
    """
    dealt = in_parts(df, *order)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = dealt.withColumn("_rn", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return own.join(offsets, "_part").withColumn(out, F.col("_rn") + F.col("_off")).drop("_part", "_rn", "_off")


def _dealt_distribution(df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None, **extra: Column) -> DataFrame:
    """``distribution`` with the part (``_part``) of each value."""
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(
            (F.sum(weight) if weight else F.count(F.lit(1))).alias("n_eq"), *[c.alias(k) for k, c in extra.items()]
        )
    )
    dealt = in_parts(counted, *keys, value)
    every = W.partitionBy(*(keys or [F.lit(0)]))
    offsets = (
        dealt.groupBy(*keys, "_part")
        .agg(F.sum("n_eq").alias("_np"))
        .select(
            *keys,
            "_part",
            F.coalesce(F.sum("_np").over(every.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(
                "_before"
            ),
            F.sum("_np").over(every).alias("n"),
        )
    )
    inside = W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    run = dealt.withColumn("_run", F.coalesce(F.sum("n_eq").over(inside), F.lit(0)))
    return run.join(offsets, [*keys, "_part"]).select(
        *keys, value, "n_eq", (F.col("_before") + F.col("_run")).alias("n_below"), "n", "_part", *extra
    )


def distribution(df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None, **extra: Column) -> DataFrame:
    """One row per distinct value of a group.

    Adds n_eq (rows with the value), n_below (rows of the group with a smaller one)
    and n (rows of the group). Nulls are left out. ``weight`` is the row count a row
    stands for (default one); ``extra`` names further aggregates.
    """
    return _dealt_distribution(df, value, keys, weight, **extra).drop("_part")


def attach(df: DataFrame, stats: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Give every row the statistics of its value; rows with a null value get nulls."""
    return df.join(stats, [*keys, value], "left")


def average_rank() -> Column:
    return F.col("n_below") + (F.col("n_eq") + 1) / 2.0


def pct_rank_within(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "pct_rank") -> DataFrame:
    """Average rank over group size, times 100."""
    stats = distribution(df, value, keys).select(*keys, value, (average_rank() / F.col("n") * 100.0).alias(out))
    return attach(df, stats, value, keys)


def count_below(asked: DataFrame, value: str, population: DataFrame, pop_value: str, keys: Sequence[str] = ()) -> DataFrame:
    """For each distinct asked value: rows of the population strictly below it, and all of them."""
    keys = list(keys)
    pop = population.where(F.col(pop_value).isNotNull()).select(*keys, F.col(pop_value).alias(value), F.lit(1).alias("_p"))
    ask = asked.where(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("_p", F.lit(0))
    d = distribution(pop.unionByName(ask), value, keys, weight="_p", _asked=F.count_if(F.col("_p") == 0))
    return d.where("_asked > 0").select(*keys, value, F.col("n_below"), F.col("n"))


def percentile_strict(df: DataFrame, value: str, population: DataFrame, pop_value: str, keys: Sequence[str] = (),
                      out: str = "percentile") -> DataFrame:
    """Share of the population strictly below each value, times 100; null where it is empty."""
    stats = count_below(df, value, population, pop_value, keys).select(
        *keys, value, F.when(F.col("n") > 0, F.col("n_below") / F.col("n") * 100.0).alias(out)
    )
    return attach(df, stats, value, keys)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    keys = list(keys)
    d = distribution(df, value, keys, weight)
    picks = []
    for name, q in probs.items():
        h = (F.col("n") - 1) * q
        for part, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("n_below") <= at) & (at < F.col("n_below") + F.col("n_eq"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{part}"))
    agg = d.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    cols = []
    for name, q in probs.items():
        h = (F.col("n") - 1) * q
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return agg.select(*keys, "n", *cols)


def bh_fdr(df: DataFrame, p: str, out: str = "fdr", keys: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg values over all non-null p of a group (default: the whole table)."""
    keys = list(keys)
    d = _dealt_distribution(df, p, keys).select(*keys, p, (F.col(p) * F.col("n") / (F.col("n_below") + F.col("n_eq"))).alias("_raw"), "_part")
    every = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_part").desc())
    later = (
        d.groupBy(*keys, "_part")
        .agg(F.min("_raw").alias("_mp"))
        .select(*keys, "_part", F.min("_mp").over(every.rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
    )
    inside = W.partitionBy(*keys, "_part").orderBy(F.col(p).desc()).rowsBetween(W.unboundedPreceding, 0)
    stats = (
        d.withColumn("_run", F.min("_raw").over(inside))
        .join(later, [*keys, "_part"])
        .select(*keys, p, F.least(F.col("_run"), F.col("_later"), F.lit(1.0)).alias(out))
    )
    return attach(df, stats, p, keys)


def rank_all(df: DataFrame, score: str, tie: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """1..n by score, ties by a unique column of any type ascending; null scores come last."""
    s = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    return positions(df, s, F.col(tie).asc(), out=out)


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], largest: bool = False) -> DataFrame:
    """One whole row per key, the first in the given order, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    row = pick(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return best_row(df, keys, order)


def group_size_attach(df: DataFrame, keys: Sequence[str], out: str = "n_group") -> DataFrame:
    """Row count of the group on every row, counted before it is joined back."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), list(keys))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def dominant_class(counts: dict[str, str], order: Sequence[str]) -> Column:
    """Class with the largest count column; ties go to the class named first."""
    best = F.greatest(*[F.coalesce(F.col(counts[c]), F.lit(0)) for c in order])
    out = F.when(best == 0, None)
    for c in order:
        out = out.when(F.coalesce(F.col(counts[c]), F.lit(0)) == best, c)
    return out


def tier_order(col: str, order: Sequence[str]) -> Column:
    """Place of a label in a given order; unknown labels come last."""
    out = None
    for i, name in enumerate(order):
        out = F.when(F.col(col) == name, i) if out is None else out.when(F.col(col) == name, i)
    return out.otherwise(len(order))


def merge_summary(df: DataFrame, by: str, p: str, ratio: str) -> DataFrame:
    """Shares below 0.05 and 0.01 and the median ratio of merged results."""
    share = {f"share_{n}": F.avg(F.when(F.col(p) < cut, 1.0).otherwise(0.0)).alias(f"share_{n}") for n, cut in (("05", 0.05), ("01", 0.01))}
    agg = df.where(F.col(p).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *share.values())
    return agg.join(quantiles(df, ratio, {"median_or": 0.5}, [by]).drop("n"), by, "left")
