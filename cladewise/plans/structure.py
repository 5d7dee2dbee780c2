"""Mapping of classified variants to structures and their contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.lookup import model_priority_loop
from ..operators.ranges import anchor_search_nearest, nearest_positions
from ..operators.spatial import classified_contacts
from ..operators.summaries import anchor_policy
from ..session import cut_lineage

C = F.col
#: Offsets up to the first are plain; a registered gene may go up to its own bound; up to the last one they are reported, not used.
WINDOW, DIAGNOSTIC = 10, 80


def map_variants(variants: DataFrame, models: DataFrame, residue_map: DataFrame, registry: DataFrame | None = None, proxies: DataFrame | None = None,
                 window: int = WINDOW, diagnostic: int = DIAGNOSTIC) -> DataFrame:
    """One row of every (variant, model): where the variant's residue stands in the model, or why it doesn't.

    ``variants``: (vid, gene, pos, ref_aa[, coord_status]); ``models``: (gene, pdb, role), the models of the gene's complex;
    ``residue_map``: (gene, pdb, chain, pos, resnum, aa[, struct_aa]), mapped positions with the residue of the reference and, if it was
    read, that of the structure; ``registry``: (gene, allow_extended_anchor, max_offset); ``proxies``: (gene, proxy), genes that stand in where a
    model has no chain of the gene. Every chain of the gene is tried and the smallest offset counts, the chain that sorts first on a tie; the
    nearest residue that agrees serves all windows. A failed variant keeps its first chain's reason, a large offset before others.

    (vid, gene, pos, ref_aa, pdb, role, chain, anchor, resnum, proxy_gene, anchor_method, anchor_detail, status, status_category)
    """
    v = variants if "coord_status" in variants.columns else variants.withColumn("coord_status", F.lit(None).cast("string"))
    chains = residue_map.select("gene", "pdb", "chain").distinct()
    has = chains.select("gene", "pdb").distinct()
    x = v.select("vid", "gene", "pos", "ref_aa", "coord_status").join(models, ["gene"], "left")
    x = x.join(has.withColumn("_own", F.lit(True)), ["gene", "pdb"], "left")
    if proxies is None:
        x = x.withColumns({"proxy_gene": F.lit(None).cast("string"), "_via": F.lit(None).cast("boolean")})
    else:
        x = x.join(proxies.select("gene", C("proxy").alias("_proxy")), ["gene"], "left")
        x = x.withColumn("proxy_gene", F.when(C("_own").isNull(), C("_proxy"))).drop("_proxy")
        x = x.join(has.select(C("gene").alias("proxy_gene"), "pdb", F.lit(True).alias("_via")), ["proxy_gene", "pdb"], "left")
    x = cut_lineage(x.withColumn("lookup", F.when(C("_own"), C("gene")).when(C("_via"), C("proxy_gene"))).drop("_own", "_via"))

    # The same residue of a gene is asked by many variants: all below works on distinct (gene, position, residue) and chains.
    key = ["lookup", "pdb", "chain", "pos", "ref_aa"]
    tried = x.where("lookup is not null and pos is not null").select("lookup", "pdb", "pos", "ref_aa").distinct().join(
        chains.withColumnRenamed("gene", "lookup"), ["lookup", "pdb"])
    place = F.concat_ws("|", "lookup", "pdb", "chain")
    keyed = residue_map.withColumnRenamed("gene", "lookup").withColumn("place", place)
    ref = keyed.select(C("place").alias("gene"), "pos", "aa")
    near = anchor_search_nearest(tried.withColumn("place", place), ref, "place", "pos", "ref_aa", diagnostic, "near")
    policy = anchor_policy(chains.select("gene").distinct(), registry).select(C("gene").alias("lookup"), "allow_extended", "max_offset") if registry is not None else None
    near = near.join(policy, ["lookup"], "left") if policy is not None else near.withColumns({"allow_extended": F.lit(False), "max_offset": F.lit(window)})
    near = near.withColumn("max_offset", F.greatest(F.coalesce("max_offset", F.lit(window)), F.lit(window)))
    near = cut_lineage(near.withColumn("reach", F.when(C("allow_extended"), C("max_offset")).otherwise(F.lit(window))))
    off = F.abs(C("near") - C("pos"))
    here = keyed.select("place", "pos", C("aa").alias("found_aa"))
    gap = nearest_positions(near.where("near is null").select("place", "pos").distinct(), ref, "place", "pos", 1).select(
        "place", "pos", F.abs(C("near") - C("pos")).alias("gap"))
    struct_aa = C("struct_aa") if "struct_aa" in residue_map.columns else C("aa")
    at = keyed.select("place", C("pos").alias("near"), "resnum", (struct_aa == C("aa")).alias("agrees"))
    y = near.join(here, ["place", "pos"], "left").join(gap, ["place", "pos"], "left").join(at, ["place", "near"], "left")
    plain = F.when(off <= window, C("near"))
    failure = rules.anchor_failure_class("pos", "ref_aa", "found_aa", C("found_aa").isNotNull(), plain, "near", "gap", C("max_offset"))
    used = C("near").isNotNull() & (off <= C("reach"))
    detail = F.when(C("near").isNotNull(), "extended_window").when(C("found_aa").isNull(), F.when(C("gap") <= C("max_offset"), "nearest_mapped_gap").otherwise("position_absent_from_pos_map")).otherwise("residue_not_in_window")
    y = y.select(*key, "near", "resnum", off.alias("off"), (used & C("agrees")).alias("mapped"), F.when(~used, failure).alias("failure"), detail.alias("detail"))
    best = F.min_by(F.when(C("mapped"), F.struct("chain", "near", "resnum", "off")), F.when(C("mapped"), F.struct("off", "chain")))
    why = F.min_by(F.when(C("failure").isNotNull(), F.struct("failure", "detail")), F.when(C("failure").isNotNull(), F.struct(~C("failure").startswith("large_offset_candidate_"), "chain")))
    found = y.groupBy("lookup", "pdb", "pos", "ref_aa").agg(best.alias("_b"), why.alias("_w"))

    out = x.join(found, ["lookup", "pdb", "pos", "ref_aa"], "left")
    out = model_priority_loop(out, ["vid"], "role", C("_b").isNotNull())
    delta = C("_b.near") - C("pos")
    missing = F.coalesce(C("coord_status") == "position_not_in_enst", F.lit(False))
    named = F.when(C("_b.off") > window, F.format_string("extended_offset_rescue_%+d", delta)).otherwise(F.format_string("isoform_offset_%+d", delta))
    status = (
        F.when(C("pdb").isNull(), "structural_ineligible").when(C("model_status").startswith("secondary_not"), C("model_status"))
        .when(C("lookup").isNull(), "no_chain_in_pdb").when(C("_b").isNotNull(), F.when(delta == 0, "ok").otherwise(named))
        .when(missing, "position_not_in_enst").otherwise(F.coalesce("_w.failure", F.lit("position_not_anchored")))
    )
    tried_ok = C("pdb").isNotNull() & ~C("model_status").startswith("secondary_not")
    hit = tried_ok & C("_b").isNotNull()
    out = out.withColumn("status", status)
    return out.select(
        "vid", "gene", "pos", "ref_aa", "pdb", "role", F.when(hit, C("_b.chain")).alias("chain"), F.when(hit, C("_b.near")).alias("anchor"), F.when(hit, C("_b.resnum")).alias("resnum"),
        F.coalesce("proxy_gene", F.lit("")).alias("proxy_gene"), F.when(hit, F.when(C("_b.off") > window, "extended_window").otherwise("default_window")).alias("anchor_method"),
        F.when(tried_ok & C("lookup").isNotNull() & C("_b").isNull(), F.when(missing, "transcript_position_missing").otherwise(C("_w.detail"))).alias("anchor_detail"),
        "status", rules.status_category("status", "proxy_gene").alias("status_category"))


def map_structure(variants: DataFrame, models: DataFrame, residue_map: DataFrame, atoms: DataFrame, beta: DataFrame, registry: DataFrame | None = None,
                  proxies: DataFrame | None = None, window: int = WINDOW, radius: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """(map, contacts): ``map_variants`` and the classified contacts of all residues it mapped, each residue searched once."""
    mapped = cut_lineage(map_variants(variants, models, residue_map, registry, proxies, window))
    placed = mapped.where("resnum is not null").select("pdb", "chain", "resnum").distinct()
    targets = beta.join(placed, ["pdb", "chain", "resnum"], "left_semi")
    contacts = classified_contacts(targets, beta, atoms, radius)
    return mapped, contacts
