"""Comparison of tested pairs with their timing and origins: one long table of named results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.inference import chi_square, mann_whitney, two_by_two, with_fisher
from ..operators.summaries import decomposed_rates, excluding_group, explode_strata, independent_origins, stratified_2x2, test_coverage

C = F.col
KINDS = ("mt-mt", "nuc-nuc", "mt-nuc")
#: Bins of a variant's number of origins, by their largest number.
ORIGIN_BINS = {"0": 0, "1": 1, "2-5": 5, "6-10": 10}


def _row(df: DataFrame, analysis: str, stratum: Column, n, measure: str, value, p=None, lo=None, hi=None) -> DataFrame:
    def number(c, kind="double"):
        return F.lit(None).cast(kind) if c is None else (C(c) if isinstance(c, str) else c).cast(kind)

    return df.select(F.lit(analysis).alias("analysis"), stratum.alias("stratum"), number(n, "bigint").alias("n"), F.lit(measure).alias("measure"), number(value).alias("value"),
                     number(p).alias("p_value"), number(lo).alias("lo"), number(hi).alias("hi"))


def _tests(tables: DataFrame, analysis: str, stratum: Column) -> DataFrame:
    """2 x 2 tables with their tests as result rows."""
    return _row(tables, analysis, stratum, C("a") + C("b") + C("c") + C("d"), "odds_ratio", "odds_ratio", "p_value", "ci_lo", "ci_hi")


def origins(timing: DataFrame, pairs: DataFrame, key: Sequence[str], sig: Column) -> DataFrame:
    """Variants of several origins against those of fewer: does compensation go with them? And the variants' origins in bins."""
    each = independent_origins(timing, pairs, key, sig)
    table = with_fisher(two_by_two(each, C("n_origins") >= 2, C("has_compensation")))
    label = F.lit("11+")
    for name, top in reversed(ORIGIN_BINS.items()):
        label = F.when(C("n_origins") <= top, name).otherwise(label)
    counted = each.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = counted.agg(F.sum("n").alias("n")).scalar()
    return _tests(table, "independent_origins", F.lit("all")).unionByName(_row(counted, "origin_bins", C("bin"), "n", "share", C("n") / every))


def kinds(pairs: DataFrame, sig: str = "_sig", p: str = "fisher_p") -> DataFrame:
    """Pairs within either genome and between them: rates, one test over the three kinds, between against within, and their p-values by rank."""
    known = pairs.where(C("contact_type").isin(*KINDS))
    rates = known.groupBy("contact_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(sig).alias("k"))
    cells = known.groupBy("contact_type", sig).agg(F.count(F.lit(1)).alias("n"))
    three = chi_square(cells, "contact_type", sig, "n")
    size = rates.agg(F.sum("n").alias("n")).scalar()
    two = with_fisher(two_by_two(known, C("contact_type") == "mt-nuc", C(sig)), "two-sided")
    against = {f"{kind}_vs_nuc-nuc": C("contact_type").isin(kind, "nuc-nuc") for kind in KINDS if kind != "nuc-nuc"}
    ranked = mann_whitney(explode_strata(known, against), p, C("contact_type") != "nuc-nuc", ["stratum"], min_n=1)
    return (
        _row(rates, "significance_rate", C("contact_type"), "n", "rate", C("k") / C("n"))
        .unionByName(_row(three, "kinds", F.lit("all"), size, "chi2", "chi2", "p_value"))
        .unionByName(_tests(two, "between_vs_within", F.lit("all")))
        .unionByName(_row(ranked, "rank_of_p", C("stratum"), C("n1") + C("n2"), "u", "u", "p_value"))
    )


def compare(pairs: DataFrame, timing: DataFrame, left_out: tuple[str, Sequence[str]], key: Sequence[str]) -> DataFrame:
    """(analysis, stratum, n, measure, value, p_value, lo, hi).

    ``pairs`` holds the FDR columns, fisher_p, low_power, timing, is_ancestral, contact_type and the variant's ``key``; ``timing`` the key,
    is_ancestral, n_gains and n_losses of origins. Analyses: timing enrichment overall, by kind and with a group taken out; independent origins;
    kinds of pairs; evidence rates and missing tests by kind.
    """
    sig = rules.is_significant("low_power", "pagel_fdr", "branch_fdr", "fisher_fdr")
    x = pairs.withColumns({"_sig": sig, "_first": F.coalesce(C("timing") == "contact_first", F.lit(False))})
    strata = {"all": F.lit(True), "derived": ~C("is_ancestral"), "ancestral": C("is_ancestral"), **{k: C("contact_type") == k for k in KINDS}}
    strata.update({f"group_{k}": v for k, v in excluding_group(x, *left_out).items() if k != "all"})
    first = _tests(stratified_2x2(x, C("_first"), C("_sig"), strata), "timing_enrichment", C("stratum"))
    e = rules.evidence_flags("low_power", "pagel_fdr", "branch_fdr", "fisher_fdr")
    rates = decomposed_rates(x, "contact_type", fisher_only=e["fisher_only"], multi_origin=e["multi_origin"])
    cover = test_coverage(x, "contact_type", C("fisher_fdr") < 0.20, C("pagel_fdr").isNotNull())
    return (
        first.unionByName(origins(timing, x, key, C("_sig"))).unionByName(kinds(x))
        .unionByName(_row(rates, "multi_origin_rate", C("contact_type"), "n", "rate", "rate_multi_origin"))
        .unionByName(_row(cover, "na_rate", C("contact_type"), "n_eligible", "rate", "na_rate"))
    )
