"""Ranking of physical pairs for follow-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.lookup import closest_model, optional_left_merge
from ..operators.ranking import best_row, group_size_attach, rank_all

C = F.col


def prioritise(pairs: DataFrame, contacts: DataFrame, contact_keys: Sequence[str], pair_key: Sequence[str], physical_key: Sequence[str],
               tie: str, energies: DataFrame | None = None, coupling: DataFrame | None = None) -> DataFrame:
    """Closest model, additive score, optional measures, composite score, one row per physical pair, rank.

    Optional tables are joined on ``pair_key``. ``tie`` is a unique number per pair.
    """
    x = closest_model(pairs, contacts, contact_keys, "distance", pair_key)
    for extra in (energies, coupling):
        x = optional_left_merge(x, extra, pair_key)
    for name, kind in (("rescue", "double"), ("ddg_dar", "double"), ("di_percentile", "double"), ("note", "string")):
        if name not in x.columns:
            x = x.withColumn(name, F.lit(None).cast(kind))
    score = rules.contact_score("pagel_fdr", "branch_fdr", "fisher_fdr", "contact_class", "mechanism", "timing", "likely_incompatible",
                                "n_origins", "confidence", "distance")
    x = x.withColumn("priority_score", score)
    x = x.withColumns({"composite_score": rules.composite_score("priority_score", "rescue", "ddg_dar", "di_percentile", "note"),
                       "energy_tier": rules.energy_tier("rescue", "ddg_dar")})
    x = group_size_attach(x, list(physical_key), "n_clinical_variants")
    one = best_row(x, list(physical_key), [-C("composite_score"), C(tie)])
    ranked = rank_all(one, "composite_score", tie, "composite_rank")
    return ranked.withColumn("assay", rules.recommend("contact_type", "contact_class", "is_intra", "rescue"))
