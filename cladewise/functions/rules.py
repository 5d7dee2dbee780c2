"""Status, class and score rules as Column expressions.

Rule order is part of every contract: the first matching line wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, blank_to_null, parse_aa_change


def variant_flags(ref, alt, aa_text) -> Column:
    """struct of size and consequence flags for one change."""
    ref, alt = F.upper(F.trim(_col(ref))), F.upper(F.trim(_col(alt)))
    aa = F.coalesce(_col(aa_text), F.lit(""))
    low = F.lower(F.trim(aa))
    n, m = F.length(ref), F.length(alt)
    snv, mnv, indel = (n == 1) & (m == 1), (n == m) & (n > 1), n != m
    parsed = parse_aa_change(aa)
    same = F.coalesce(parsed["ref"] == parsed["alt"], F.lit(False))
    return F.struct(
        F.when(snv, "snv").when(mnv, "mnv").when(indel, "indel").otherwise("other").alias("variant_class"),
        snv.alias("is_snv"),
        mnv.alias("is_mnv"),
        indel.alias("is_indel"),
        (~low.contains("noncoding") & (aa != "")).alias("is_coding"),
        (parsed.isNotNull() & ~same & (parsed["alt"] != "*")).alias("is_missense"),
        same.alias("is_synonymous"),
        (aa.contains("*") | low.contains("ter")).alias("is_nonsense"),
        low.contains("frameshift").alias("is_frameshift"),
    )


def exclusion_reason(flags, parse_failure="") -> Column:
    """Why a row is not in the core set; the empty string means it is."""
    f = _col(flags)
    failure = F.lit("") if isinstance(parse_failure, str) and parse_failure == "" else F.coalesce(_col(parse_failure), F.lit(""))
    return (
        F.when(~f["is_coding"], "noncoding")
        .when(~f["is_snv"], "non_snv")
        .when(f["is_frameshift"], "frameshift")
        .when(f["is_nonsense"], "nonsense")
        .when(failure != "", failure)
        .when(~f["is_missense"], "not_missense")
        .otherwise("")
    )


def override_reason(reason, assembly, chromosome, is_snv, build: str = "GRCh38", mt: str = "MT") -> Column:
    """Source-level rules that replace an earlier reason."""
    return (
        F.when(_col(assembly) != build, F.lit("non_" + build.lower()))
        .when(_col(chromosome) == mt, "mt_in_nuclear_branch")
        .when(~_col(is_snv), "non_snv")
        .otherwise(_col(reason))
    )


def allele_consistency(a, b) -> Column:
    a, b = blank_to_null(F.upper(F.trim(_col(a)))), blank_to_null(F.upper(F.trim(_col(b))))
    return a == b


def match_key(encoded_by, gene, pos, ref, alt) -> Column:
    """gene|pos|ref|alt of a mitochondrial row with all four parts, else null."""
    parts = [blank_to_null(F.trim(_col(gene))), _col(pos).cast("string")]
    parts += [blank_to_null(F.upper(F.trim(_col(c)))) for c in (ref, alt)]
    complete = _col(encoded_by) == "mitochondrial"
    for p in parts:
        complete = complete & p.isNotNull()
    return F.when(complete, F.concat_ws("|", *parts))


def support_level(n) -> Column:
    n = _col(n)
    return F.when(n.isNull(), None).when(n == 0, "none").when(n == 1, "single_species").otherwise("multi_species")


def prefer_genomic_map(identity, coverage) -> Column:
    i, c = _col(identity), _col(coverage)
    return F.coalesce((i < 0.90) | (c < 0.95), F.lit(True)) | i.isNull() | c.isNull()


def warning_reasons(**flags) -> Column:
    """Names of the true flags in the given order, joined by |; null if none is."""
    hit = [F.when(F.coalesce(_col(c), F.lit(False)), F.lit(name)) for name, c in flags.items()]
    return F.nullif(F.array_join(F.array_compact(F.array(*hit)), "|"), F.lit(""))


def encoded_by(gene, prefix: str = "MT-") -> Column:
    return F.when(_col(gene).startswith(prefix), "mitochondrial").otherwise("nuclear")


def contact_type(a_mt, b_mt) -> Column:
    a, b = _col(a_mt), _col(b_mt)
    return F.when(a & b, "mt-mt").when(~a & ~b, "nuc-nuc").otherwise("mt-nuc")


def direction_label(a_mt, b_mt) -> Column:
    """Compartment of the variant side against the contact side; null where they are the same."""
    a, b = _col(a_mt), _col(b_mt)
    return F.when(a & ~b, "mt_dar_nuc_contact").when(~a & b, "nuc_dar_mt_contact")


def infer_contact_genome(dar_genome, contact_type_) -> Column:
    """Genome of the contact side from the pair type; the variant side decides where it is unknown."""
    t = _col(contact_type_)
    return F.when(t == "mt-mt", "mtDNA").when(t.isin("nuc-nuc", "mt-nuc"), "nucDNA").otherwise(_col(dar_genome))


def status_category(status, proxy_gene=None, gene_eligibility=None) -> Column:
    s = _col(status)
    proxy = F.coalesce(_col(proxy_gene), F.lit("")) if proxy_gene is not None else F.lit("")
    elig = F.coalesce(_col(gene_eligibility), F.lit("")) if gene_eligibility is not None else F.lit("")
    no_chain = s == "no_chain_in_pdb"
    anchoring = [
        "unresolved_structure_segment_candidate", "possible_large_offset_or_gap", "unmapped_reference_position",
        "anchor_window_exhausted", "reference_sequence_conflict", "position_not_anchored",
    ]
    return (
        F.when(s == "structural_ineligible", s)
        .when(s == "secondary_not_attempted_no_primary_support", "secondary_not_attempted")
        .when(s == "missing_structure_file", "missing_model_file")
        .when(s == "position_not_in_enst", "sequence_model_mismatch")
        .when(no_chain & (proxy != ""), "isoform_proxy_gap")
        .when(no_chain & (elig == "structurally_unrepresented"), "gene_unrepresented_in_panel")
        .when(no_chain, "chain_assignment_or_model_gap")
        .when(s.isin(anchoring), "residue_anchoring_failure")
        .when(s.startswith("large_offset_candidate_"), "mature_offset_candidate")
        .when(s.startswith("extended_offset_rescue_"), "mapped_with_extended_offset_rescue")
        .when(s.startswith("isoform_offset"), "mapped_with_isoform_offset")
        .when(s == "ok", "mapped_direct")
        .otherwise("other")
    )


def anchor_failure_class(pos, ref_aa, found_aa, is_mapped, default_anchor, extended_anchor, nearest_delta, window) -> Column:
    """Why a residue could not be anchored, from the nearest mapped distance outwards."""
    delta = _col(extended_anchor) - _col(pos)
    signed = F.concat(F.when(delta >= 0, "+").otherwise("-"), F.abs(delta).cast("string"))
    near, absent = _col(nearest_delta), ~_col(is_mapped)
    return (
        F.when(_col(default_anchor).isNotNull(), "anchored_default_window")
        .when(_col(extended_anchor).isNotNull(), F.concat(F.lit("large_offset_candidate_"), signed))
        .when(absent & (near <= 3), "unresolved_structure_segment_candidate")
        .when(absent & (near <= _col(window)), "possible_large_offset_or_gap")
        .when(absent, "unmapped_reference_position")
        .when(~_col(found_aa).eqNullSafe(_col(ref_aa)), "reference_sequence_conflict")
        .otherwise("anchor_window_exhausted")
    )


def remap_method(is_nuclear, has_map, pos, mapped) -> Column:
    nuc, known = _col(is_nuclear), _col(has_map)
    return (
        F.when(_col(pos).isNull(), None)
        .when(~nuc, "native")
        .when(~known, "anchor_fallback")
        .when(_col(mapped) == _col(pos), "transcript_identity")
        .otherwise("transcript_map")
    )


def reconciliation_status(is_nuclear, has_map, pos, mapped) -> Column:
    method = remap_method(is_nuclear, has_map, pos, mapped)
    return (
        F.when(~_col(is_nuclear), "mt_native")
        .when((method == "transcript_map") & _col(mapped).isNull(), "position_not_in_enst")
        .when(method == "transcript_identity", method)
        .when(method == "transcript_map", "transcript_remapped")
        .when(method == "anchor_fallback", "no_transcript_map")
        .otherwise("native")
    )


# Points of the additive contact rubric.
CLASS_POINTS = {"electrostatic": 3, "hbond": 2, "hydrophobic": 1}
MECHANISM_POINTS = {"charge_reversal": 3, "charge_rescue": 2, "volume_swap": 1, "polarity_swap": 1}
TIMING_POINTS = {"contact_first": 2, "co_occurring": 1}


def _points(c, table: dict) -> Column:
    c = F.lower(F.trim(_col(c)))
    out = F.lit(0)
    for name, score in table.items():
        out = F.when(c == name, score).otherwise(out)
    return out


def phylo_points(pagel_fdr, branch_fdr, fisher_fdr) -> Column:
    best = F.coalesce(F.least(_col(pagel_fdr), _col(branch_fdr)), _col(fisher_fdr))
    return F.when(best <= 0.01, 3).when(best <= 0.05, 2).when(best <= 0.10, 1).otherwise(0)


def contact_score(
    pagel_fdr, branch_fdr, fisher_fdr, contact_class, mechanism, timing, incompatible, origins, tier, distance
) -> Column:
    """Additive 0-17 score of a pair."""
    n = F.coalesce(_col(origins), F.lit(0))
    return (
        phylo_points(pagel_fdr, branch_fdr, fisher_fdr)
        + _points(contact_class, CLASS_POINTS)
        + _points(mechanism, MECHANISM_POINTS)
        + _points(timing, TIMING_POINTS)
        + F.when(_col(incompatible), 2).otherwise(0)
        + F.when(n >= 10, 2).when(n >= 2, 1).otherwise(0)
        + F.when(F.lower(F.trim(_col(tier))) == "high_confidence", 1).otherwise(0)
        + F.when(_col(distance) < 5.0, 1).otherwise(0)
    )


def energy_tier(rescue, dar) -> Column:
    r, d = _col(rescue), _col(dar)
    return (
        F.when(r.isNull(), "not_computed")
        .when((r > 1.0) & (d > 1.0), "strong")
        .when((r > 0.5) | (d > 0.5), "borderline")
        .otherwise("not_supported")
    )


def composite_score(base, rescue, dar, percentile, note, other=None) -> Column:
    """``other`` is the percentile that counts where the first is missing."""
    percentile = _col(percentile) if other is None else F.coalesce(_col(percentile), _col(other))
    energy = F.when((_col(rescue) > 1.0) & (_col(dar) > 1.0), 2).otherwise(0)
    coupling = F.when(
        (percentile > 75) & (F.coalesce(_col(note), F.lit("")) != "insufficient_meff"), 1
    ).otherwise(0)
    return F.coalesce(_col(base), F.lit(0)) + energy + coupling


def epistasis(dar, contact, double, sd_dar, sd_contact, sd_double) -> Column:
    """struct(rescue, epistasis, sd, significant) of a two-change energy cycle."""
    d, c, both = _col(dar), _col(contact), _col(double)
    epi = both - (d + c)
    sd = F.sqrt(sum((_col(s) * _col(s) for s in (sd_contact, sd_double)), _col(sd_dar) * _col(sd_dar)))
    return F.struct(
        (d - both).alias("rescue"),
        epi.alias("epistasis"),
        sd.alias("sd"),
        F.coalesce((sd > 0) & (F.abs(epi) > 2 * sd), F.lit(False)).alias("significant"),
    )


def recommend(contact_type_, contact_class, is_intra, rescue_bind) -> Column:
    """Follow-up assay text."""
    cross = F.lower(_col(contact_type_)) == "mt-nuc"
    return (
        F.when(
            cross & _col(rescue_bind).isNotNull(),
            "Co-IP pulldown + SDM + binding assay (mCSM-PPI2 validation recommended)",
        )
        .when(cross, "Co-IP pulldown + SDM")
        .when(
            _col(is_intra) & F.lower(_col(contact_class)).isin("electrostatic", "hbond"),
            "Thermal shift assay (DSF/nanoDSF) + SDM",
        )
        .when(~_col(is_intra), "SEC-MALS + SDM + thermal shift")
        .otherwise("SDM + functional assay (CI/III/IV/V activity)")
    )


def refine_timing(timing, similarity, threshold: int = 1) -> Column:
    """Split two timing classes by how mild the contact substitution is."""
    t, s = _col(timing), _col(similarity)
    mild = s >= threshold
    return (
        F.when(s.isNull() | F.isnan(s), t)
        .when(t == "co_occurring", F.when(mild, "permissive_background").otherwise("co_adaptation"))
        .when((t == "no_contact_change") & mild, "constitutively_permissive")
        .otherwise(t)
    )


def directional_class(is_ancestral, first, co, after, none) -> Column:
    f, c, a = _col(first) > 0, _col(co) > 0, _col(after) > 0
    return (
        F.when(_col(is_ancestral), "ancestral_cdav_not_directional")
        .when(~f & ~c & ~a, F.when(_col(none) > 0, "no_detected_partner_change").otherwise("ambiguous_no_origin"))
        .when(f & ~c & ~a, "permissive_background")
        .when(a & ~f & ~c, "responding_secondary")
        .when(c & ~f & ~a, "co_occurring_unresolved")
        .otherwise("mixed_timing")
    )


def is_significant(low_power, pagel_fdr, branch_fdr, fisher_fdr, cutoff: float = 0.10) -> Column:
    """Row rule: any phylogenetic FDR present decides alone, else the exact-test FDR."""
    best = F.coalesce(F.least(_col(pagel_fdr), _col(branch_fdr)), _col(fisher_fdr))
    return ~F.coalesce(_col(low_power), F.lit(False)) & F.coalesce(best <= cutoff, F.lit(False))


def evidence_flags(low_power, pagel_fdr, branch_fdr, fisher_fdr, cutoff: float = 0.10) -> Column:
    ok = ~F.coalesce(_col(low_power), F.lit(False))
    sig = {k: F.coalesce(_col(c) <= cutoff, F.lit(False)) for k, c in
           (("pagel", pagel_fdr), ("branch", branch_fdr), ("fisher", fisher_fdr))}
    multi = _col(pagel_fdr).isNotNull() | _col(branch_fdr).isNotNull()
    return F.struct(
        (ok & ~multi & sig["fisher"]).alias("fisher_only"),
        (ok & sig["branch"]).alias("branch_sig"),
        (ok & sig["pagel"]).alias("pagel_sig"),
        (ok & _col(pagel_fdr).isNotNull()).alias("pagel_tested"),
        (ok & sig["fisher"]).alias("fisher_sig"),
        (ok & multi).alias("multi_origin"),
    )


def bin_label(value, bins, closed: str = "both") -> Column:
    """Label of the first (lo, hi, label) bin a value is in; a None bound is open.

    closed="both" takes lo <= v <= hi, closed="right" takes lo < v <= hi.
    """
    v, out = _col(value), None
    for lo, hi, label in bins:
        low = F.lit(True) if lo is None else (v >= lo if closed == "both" else v > lo)
        test = low if hi is None else low & (v <= hi)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def mutation_code(ref, chain, number, alt) -> Column:
    return F.concat(_col(ref), _col(chain), _col(number).cast("int").cast("string"), _col(alt))


def mutation_status(pdb, ref, chain, number, alt, letters: str = "ACDEFGHIKLMNPQRSTVWY") -> Column:
    coords = _col(chain).isNotNull() & _col(number).isNotNull()
    valid = _col(ref).isin(list(letters)) & _col(alt).isin(list(letters))
    return (
        F.when(_col(pdb).isNull() | (_col(pdb) == ""), "no_pdb")
        .when(~coords, "missing_coords")
        .when(~F.coalesce(valid, F.lit(False)), "invalid_aa")
        .otherwise("ok")
    )


def contact_state(n_known, n_human, n_alt) -> Column:
    """State of the contact residue among carrier species, from three counts."""
    k, h, a = _col(n_known), _col(n_human), _col(n_alt)
    return (
        F.when(k == 0, "unknown").when(h == k, "conserved_human").when(a == k, "conserved_alt").otherwise("polymorphic")
    )


def offset_agreement(delta) -> Column:
    d = F.abs(_col(delta))
    return F.when(d <= 5, "agree").when(d <= 15, "close").when(d.isNotNull(), "mismatch")
