"""Tests over tables of counts, groups and strata."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, fisher_exact, normal_sf, odds_ratio_ci, t_two_sided
from .ranking import average_rank, distribution
from .tree import sized


def two_by_two(df: DataFrame, exposed: Column, hit: Column, keys: Sequence[str] = ()) -> DataFrame:
    """a, b, c, d per group: exposed with and without the hit, then the rest."""
    return df.groupBy(*keys).agg(
        F.count_if(exposed & hit).alias("a"),
        F.count_if(exposed & ~hit).alias("b"),
        F.count_if(~exposed & hit).alias("c"),
        F.count_if(~exposed & ~hit).alias("d"),
    )


def with_fisher(df: DataFrame, side: str = "greater", p: str = "p_value") -> DataFrame:
    ci = odds_ratio_ci("a", "b", "c", "d")
    return df.withColumns(
        {p: fisher_exact("a", "b", "c", "d", side), "odds_ratio": ci["odds_ratio"], "ci_lo": ci["lo"], "ci_hi": ci["hi"]}
    )


def chi_square(cells: DataFrame, row: str, col: str, n: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson test of an r x c table given as (row, col, count); corrected only when 2 x 2.

    Cells that do not occur count as zero: their expected values come from what the
    present cells leave over, so the table is never filled up.
    """
    keys = list(keys)
    agg = cells.groupBy(*keys, row, col).agg(F.sum(n).cast("double").alias("o")).where("o > 0")
    rows = agg.groupBy(*keys, row).agg(F.sum("o").alias("_nr"))
    cols = agg.groupBy(*keys, col).agg(F.sum("o").alias("_nc"))
    n_row = rows.groupBy(*keys).agg(F.sum("_nr").alias("total"), F.count(F.lit(1)).alias("n_rows"))
    n_col = cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cols"))
    size = n_row.join(n_col, keys) if keys else n_row.withColumn("n_cols", n_col.select("n_cols").scalar())
    full = agg.join(rows, [*keys, row]).join(cols, [*keys, col])
    full = full.join(size, keys) if keys else full.withColumns(
        {c: size.select(c).scalar() for c in ("total", "n_rows", "n_cols")}
    )
    e = F.col("_nr") * F.col("_nc") / F.col("total")
    yates = F.when((F.col("n_rows") == 2) & (F.col("n_cols") == 2), F.least(F.lit(0.5), F.abs(F.col("o") - e))).otherwise(0.0)
    # An absent cell adds e (or, corrected, (e - 0.5)^2 / e); all absent ones add total - sum of e.
    stat = full.groupBy(*keys).agg(
        F.sum((F.abs(F.col("o") - e) - yates) ** 2 / e).alias("present"),
        F.sum(e).alias("e_present"),
        F.count(F.lit(1)).alias("n_present"),
        *[F.max(c).alias(c) for c in ("total", "n_rows", "n_cols")],
    )
    absent = F.col("total") - F.col("e_present")
    n_absent = F.col("n_rows") * F.col("n_cols") - F.col("n_present")
    small = (F.col("n_rows") == 2) & (F.col("n_cols") == 2) & (n_absent == 1)
    missing = F.when(n_absent == 0, 0.0).when(small, (absent - F.least(F.lit(0.5), absent)) ** 2 / absent).otherwise(absent)
    df_ = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    return stat.select(
        *keys,
        (F.col("present") + missing).alias("chi2"),
        df_.alias("dof"),
        (n_absent > 0).alias("zero_cells"),
    ).withColumn("p_value", F.when(F.col("dof") == 0, 1.0).otherwise(chi2_sf("chi2", F.greatest(F.col("dof"), F.lit(1)))))


#: The rank-sum test is exact if the smaller side has at most so many rows, no value is tied, and n1 n2 is within the second bound:
#: beyond it the exact table of U would be too long, and the normal form takes over.
EXACT_ROWS, EXACT_PRODUCT = 8, 2_000_000


def exact_tail() -> Callable[..., Column]:
    """P(U >= u) for sides of n1 and n2 rows without ties, as a function of the columns n1, n2, u (whole numbers).

    The numbers of ways to reach each U are the coefficients of a Gaussian binomial: a product of m
    factors (1 - q^(n + i)) / (1 - q^i), in whole numbers of any size; one half of the symmetric table is made, once for each pair of sizes in a batch.
    """
    from functools import lru_cache
    from math import comb

    def table(m: int, n: int) -> np.ndarray:
        size = m * n // 2 + 1
        ways = np.zeros(size, dtype=np.int64 if comb(m + n, m) < 1 << 62 else object)
        ways[0] = 1
        for i in range(1, m + 1):
            for start in range(min(i, size)):
                ways[start::i] = np.add.accumulate(ways[start::i])
        for i in range(1, m + 1):
            if n + i < size:
                ways[n + i :] = ways[n + i :] - ways[: size - n - i].copy()
        return np.add.accumulate(ways)

    def tails(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
        below = lru_cache(maxsize=64)(table)

        def tail(a, b, x) -> float | None:
            if pd.isna(a) or pd.isna(b) or pd.isna(x):
                return None
            m, n, x = int(min(a, b)), int(max(a, b)), int(x)
            ways, every = below(m, n), comb(m + n, m)
            if x <= 0:
                return 1.0
            if m * n - x < len(ways):
                return int(ways[m * n - x]) / every
            return (every - int(ways[x - 1])) / every

        return pd.Series([tail(*row) for row in zip(n1, n2, u, strict=True)], dtype="float64")

    return F.pandas_udf(tails, "double")


def mann_whitney(df: DataFrame, value: str, group: Column, keys: Sequence[str] = (), side: str = "two-sided",
                 min_n: int = 3) -> DataFrame:
    """Rank-sum test of rows where ``group`` is true against the others.

    Exact where one side has at most ``EXACT_ROWS`` rows and no value is tied; otherwise average ranks and the normal form with
    tie and continuity correction. Null below ``min_n`` rows a side.
    """
    keys = list(keys)
    d = distribution(df, value, keys, g1=F.count_if(group))
    agg = d.groupBy(*keys).agg(
        F.sum(F.col("g1") * average_rank()).alias("r1"),
        F.sum("g1").alias("n1"),
        F.sum(F.col("n_eq") - F.col("g1")).alias("n2"),
        F.sum(F.col("n_eq").cast("double") ** 3 - F.col("n_eq")).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    agg = agg.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    u, other = F.col("u"), n1 * n2 - F.col("u")
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    shift = u - n1 * n2 / 2
    if side == "greater":
        p, at = normal_sf((shift - 0.5) / sigma), u
    elif side == "less":
        p, at = normal_sf((-shift - 0.5) / sigma), other
    else:
        p, at = F.least(2 * normal_sf((F.abs(shift) - 0.5) / sigma), F.lit(1.0)), F.greatest(u, other)
    enough = (F.col("n1") >= min_n) & (F.col("n2") >= min_n)
    few = enough & (F.col("ties") == 0) & (F.least("n1", "n2") <= EXACT_ROWS) & (F.col("n1") * F.col("n2") <= EXACT_PRODUCT)
    # Only tests that are exact pass their numbers on; the others pass nulls.
    tail = exact_tail()(F.when(few, F.col("n1")), F.when(few, F.col("n2")), F.when(few, at))
    exact = F.least(2 * tail, F.lit(1.0)) if side == "two-sided" else tail
    return agg.select(*keys, "n1", "n2", "u", F.when(few, exact).when(enough & (sigma > 0), p).when(enough, 1.0).alias("p_value"))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with its t-tail. Equal (x, y) pairs are one counted row throughout."""
    keys = list(keys)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("w"))
    rep = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = distribution(rep, x, keys).select(*keys, x, average_rank().alias("rx"), F.col("n").alias("nx"))
    ry = distribution(rep, y, keys).select(*keys, y, average_rank().alias("ry"))
    w = F.col("w").cast("double")
    mid = (F.col("nx") + 1) / 2.0
    dx, dy = F.col("rx") - mid, F.col("ry") - mid
    agg = (
        pairs.join(rx, [*keys, x])
        .join(ry, [*keys, y])
        .groupBy(*keys)
        .agg(F.sum(w * dx * dy).alias("sxy"), F.sum(w * dx * dx).alias("sxx"), F.sum(w * dy * dy).alias("syy"),
             F.sum("w").alias("n"))
    )
    rho = F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))
    v = F.col("n") - 2
    t = F.col("rho") * F.sqrt(v / ((1 + F.col("rho")) * (1 - F.col("rho"))))
    return agg.select(*keys, "n", rho.alias("rho")).withColumn(
        "p_value", F.when(F.abs(F.col("rho")) >= 1, 0.0).when(v > 0, t_two_sided(t, v))
    )


def cmh(tables: DataFrame, stratum: str, keys: Sequence[str] = ()) -> DataFrame:
    """Stratified 2 x 2 test without continuity correction; strata below two rows are skipped."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    per = tables.groupBy(*keys, stratum).agg(*[F.sum(x).alias(x) for x in "abcd"])
    agg = per.where(n >= 2).groupBy(*keys).agg(
        F.sum(a - (a + b) * (a + c) / n).alias("num"),
        F.sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("den"),
    )
    stat = F.when(F.col("den") > 0, F.col("num") ** 2 / F.col("den"))
    return agg.select(*keys, stat.alias("chi2")).withColumn("p_value", chi2_sf("chi2", F.lit(1)))


def empirical_p(observed: DataFrame, null: DataFrame, keys: Sequence[str], obs: str, sim: str) -> DataFrame:
    """Share of simulated values at or above the observed one, and how many completed."""
    keys = list(keys)
    joined = null.where(F.col(sim).isNotNull()).join(observed.select(*keys, obs), keys)
    return joined.groupBy(*keys).agg(
        F.max(obs).alias(obs),
        F.avg(F.when(F.col(sim) >= F.col(obs), 1.0).otherwise(0.0)).alias("p_emp"),
        F.count(F.lit(1)).alias("n_completed"),
    )


def significance_view(df: DataFrame, phylo: Sequence[str], fallback: str, low_power: str, cutoff: float = 0.10) -> DataFrame:
    """Dataset rule: where any row has a phylogenetic FDR those decide for every row."""
    any_phylo = F.coalesce(*[F.col(c) for c in phylo]).isNotNull()
    used = df.agg(F.coalesce(F.max(any_phylo), F.lit(False)).alias("used")).scalar()
    best = F.least(*[F.col(c) for c in phylo])
    chosen = F.when(used, best).otherwise(F.col(fallback))
    return df.where(~F.coalesce(F.col(low_power), F.lit(False)) & (chosen <= cutoff))


def testable_reason(conditions: dict[str, Column], ok: str = "testable") -> Column:
    """Name of the first condition that rules a pair out."""
    out = None
    for name, c in conditions.items():
        hit = F.coalesce(c, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(ok)


def multi_origin_binomial(df: DataFrame, observed: DataFrame, keys: Sequence[str], n: str, k: str, rate_keys: Sequence[str], has_alt: str,
                          tie: str, least: int = 2) -> DataFrame:
    """One-sided binomial test of k events in n origins against the share of leaves with the residue.

    The representative row of a physical pair is the one with most origins.
    """
    from ..functions.special import binom_test
    from .ranking import best_row

    rep = best_row(df.select(*keys, n, k, tie), list(keys), [-F.col(n), F.col(tie)]).where(F.col(n) >= least)
    rate = observed.groupBy(*rate_keys).agg(F.avg(has_alt).alias("expected_rate")).where("expected_rate > 0")
    return rep.join(rate, list(rate_keys)).withColumns({
        "observed_rate": F.col(k) / F.col(n), "binom_p": binom_test(k, n, "expected_rate", "greater")})


def verdict(df: DataFrame, by: str, ratio: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Thresholds set beforehand: median ratio above 5 with most tests significant, 2 or more, else."""
    from .ranking import quantiles

    share = df.groupBy(by).agg(F.avg(F.when(F.col(p) < alpha, 1.0).otherwise(0.0)).alias("share_sig"))
    out = quantiles(df, ratio, {"median_or": 0.5}, [by]).join(share, by)
    strong = (F.col("median_or") > 5) & (F.col("share_sig") > 0.5)
    return out.withColumn("verdict", F.when(strong, "strong").when(F.col("median_or") >= 2, "moderate").otherwise("weak"))


def branch_cooccurrence(matched_a: DataFrame, matched_b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Co-occurrence of origins on matching clades, per pair.

    Both inputs hold (keys, matched), one row per origin. The table is [[a, b], [c, d]] with
    d = origins - a, hence c = d; p is 1 where a = 0, null without origins.
    """
    a = matched_a.groupBy(*keys).agg(F.count_if("matched").alias("a"), F.count_if(~F.col("matched")).alias("c"))
    b = matched_b.groupBy(*keys).agg(F.count_if(~F.col("matched")).alias("b"))
    out = a.join(b, list(keys), "left").fillna(0, ["b"]).withColumn("d", F.col("c"))
    return out.withColumn("branch_p", F.when(F.col("a") == 0, 1.0).otherwise(fisher_exact("a", "b", "c", "d")))


def branch_evidence(pairs: DataFrame, origins: DataFrame, leaves: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Branch test of every pair (pair, tree, pos, alt, contact_tree, contact_pos, contact_alt): (pair, a, b, c, d, branch_p).

    ``origins`` holds (tree, pos, alt, node), the nodes above which a residue arose; ``leaves`` (tree, node, leaf). An origin of the
    variant and one of the contact are the same branch if their clades share more than ``threshold`` of the larger. Only clades with an
    origin are compared, each two of them once, however many pairs they stand in. Pairs without an origin of the variant have no row.
    """
    own = origins.distinct()
    first = pairs.select("pair", "tree", "pos", "alt").join(own, ["tree", "pos", "alt"]).select("pair", F.col("tree").alias("tree_a"), F.col("node").alias("node_a")).distinct()
    second = pairs.select("pair", F.col("contact_tree").alias("tree"), F.col("contact_pos").alias("pos"), F.col("contact_alt").alias("alt")).join(own, ["tree", "pos", "alt"])
    second = second.select("pair", F.col("tree").alias("tree_b"), F.col("node").alias("node_b")).distinct()

    def clades(nodes: DataFrame, side: str) -> DataFrame:
        return sized(leaves, side, ["tree", "node"], nodes.select(F.col(f"tree_{side}").alias("tree"), F.col(f"node_{side}").alias("node")).distinct())

    # Clades whose sizes alone rule a match out do not meet.
    least, most = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    both = clades(first, "a").join(clades(second, "b"), "leaf").where(least / most > threshold)
    shared = both.groupBy("tree_a", "node_a", "tree_b", "node_b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("shared"))
    same = shared.where(F.col("shared") / most > threshold)
    met = first.join(same, ["tree_a", "node_a"]).join(second, ["pair", "tree_b", "node_b"]).select("pair", "tree_a", "node_a", "tree_b", "node_b")

    def matched(rows: DataFrame, side: str) -> DataFrame:
        key = ["pair", f"tree_{side}", f"node_{side}"]
        return rows.join(met.select(*key).distinct().withColumn("matched", F.lit(True)), key, "left").select("pair", F.coalesce("matched", F.lit(False)).alias("matched"))

    return branch_cooccurrence(matched(first, "a"), matched(second, "b"), ["pair"])
