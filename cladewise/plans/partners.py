"""Partners of carried variants: contingency, exact test, false-discovery control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import fisher_exact
from ..operators.alignment import asked_cells
from ..operators.inference import significance_view
from ..operators.ranking import bh_fdr
from ..operators.summaries import concordance_summary, contingency_alt, likely_incompatible
from ..session import cut_lineage

C = F.col


def find_partners(pairs: DataFrame, readable: DataFrame, carriers: DataFrame, aln: DataFrame, min_species: int = 20,
                  mask: str = "-X!*", branches: DataFrame | None = None) -> DataFrame:
    """One row per (pair, residue seen in carriers other than the reference one).

    ``pairs``: (pair, vid, contact_gene, contact_col, human_aa, contact_class, contact_type); ``readable``: species
    with a residue at the variant's position (vid, species); ``carriers``: (vid, species); ``aln``: (gene, species, seq), of which
    only the contacts' columns are read. Species are joined as rows. ``branches``: (pair, alt, branch_p) of the branch test,
    corrected over all of them into branch_fdr.
    """
    roles = readable.join(carriers.select("vid", "species").distinct().withColumn("_c", F.lit(True)), ["vid", "species"], "left")
    wanted = pairs.select(C("contact_gene").alias("gene"), C("contact_col").alias("col"))
    seen = asked_cells(aln, wanted).where(~C("ch").isin(*mask)).select(C("gene").alias("contact_gene"), C("col").alias("contact_col"), "species", C("ch").alias("alt"))
    j = pairs.join(roles, ["vid"]).join(seen, ["contact_gene", "contact_col", "species"])
    cells2 = j.select("pair", "human_aa", "alt", F.coalesce("_c", F.lit(False)).alias("is_carrier"))
    table = contingency_alt(cells2, ["pair"], "alt", "is_carrier", "human_aa")
    n_test = readable.groupBy("vid").agg(F.count(F.lit(1)).alias("n_species"))
    out = table.join(pairs.drop("human_aa"), ["pair"]).join(n_test, ["vid"])
    out = out.withColumns({"low_power": C("n_species") < min_species, "fisher_p": fisher_exact("a", "b", "c", "d"),
                           "likely_incompatible": likely_incompatible("contact_class", "sensitivity", "specificity")})
    # The correction reads its rows several times: without the cuts each time began at the texts.
    out = cut_lineage(bh_fdr(cut_lineage(out), "fisher_p", "fisher_fdr"))
    if branches is None:
        return out.withColumns({"branch_p": F.lit(None).cast("double"), "branch_fdr": F.lit(None).cast("double")})
    return bh_fdr(cut_lineage(out.join(branches.select("pair", "alt", "branch_p"), ["pair", "alt"], "left")), "branch_p", "branch_fdr")


def significant(tested: DataFrame, cutoff: float = 0.10) -> DataFrame:
    """Pairs that pass the rule of the whole data set: where any pair has a phylogenetic FDR those decide for all, else the exact test's."""
    x = tested if "pagel_fdr" in tested.columns else tested.withColumn("pagel_fdr", F.lit(None).cast("double"))
    return significance_view(x, ["pagel_fdr", "branch_fdr"], "fisher_fdr", "low_power", cutoff)


def summarise(tested: DataFrame, key: str = "vid", cutoff: float = 0.10) -> DataFrame:
    """Per variant: tested and significant partners, the significant ones by the rule of the whole data set."""
    chosen = significant(tested, cutoff).select("pair", "alt").distinct().withColumn("_sig", F.lit(True))
    x = tested.join(chosen, ["pair", "alt"], "left").withColumn("_sig", F.coalesce("_sig", F.lit(False)))
    return concordance_summary(x, key, C("_sig"), "contact_type", "contact_gene")


def merge_phylo(tested: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results of an external test joined on the whole key, corrected over all of them."""
    joined = tested.join(results.select(*keys, C("value").alias("pagel_p")), list(keys), "left")
    return bh_fdr(joined, "pagel_p", "pagel_fdr")
