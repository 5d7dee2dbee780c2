"""Mapping of variants to models on a small fixture: every chain, window, substitute and reason."""

from cladewise.plans import structure


def test_map_variants(spark):
    def residues(gene, pdb, chain, cells):
        return [(gene, pdb, chain, pos, 1000 + pos, aa, seen) for pos, aa, seen in cells]

    rows = residues("ga", "p1", "A", [(10, "K", "K"), (13, "L", "L"), (40, "W", "W"), (60, "Y", "X")]) + residues("ga", "p1", "B", [(11, "K", "K"), (12, "L", "L")])
    rows += residues("ga", "s1", "A", [(10, "K", "K")]) + residues("gb", "p1", "C", [(5, "D", "D")]) + residues("gd", "p1", "D", [(7, "G", "G"), (33, "H", "H"), (90, "E", "E")])
    mapped = spark.createDataFrame(rows, "gene string, pdb string, chain string, pos long, resnum long, aa string, struct_aa string")
    models = spark.createDataFrame([(g, "p1", "primary") for g in ("ga", "gb", "gc", "gd", "ge")] + [("ga", "s1", "secondary")], "gene string, pdb string, role string")
    registry = spark.createDataFrame([("gd", "true", "30"), ("ga", "false", "50")], "gene string, allow_extended_anchor string, max_offset string")
    proxies = spark.createDataFrame([("gc", "gb"), ("ge", "none")], "gene string, proxy string")
    asked = [("same", "ga", 10, "K"), ("tie", "ga", 12, "L"), ("nearer", "ga", 13, "K"), ("large", "ga", 12, "W"), ("seen", "ga", 60, "Y"), ("conflict", "ga", 10, "D"), ("gap", "ga", 15, "R"),
             ("hole", "ga", 50, "R"), ("off", "ga", 900, "R"), ("via", "gc", 4, "D"), ("rescue", "gd", 12, "H"), ("beyond", "gd", 52, "E"), ("nochain", "ge", 1, "K"), ("nomodel", "gz", 1, "K"),
             ("twice", "ga", 10, "K"), ("lost", "ga", 10, "R")]
    v = spark.createDataFrame([(*x, "position_not_in_enst" if x[0] == "lost" else None) for x in asked], "vid string, gene string, pos long, ref_aa string, coord_status string")
    out = structure.map_variants(v, models, mapped, registry, proxies).collect()
    assert len(out) == len(asked) + sum(x[1] == "ga" for x in asked)
    got = {r.vid: r for r in out if r.role != "secondary"}
    assert {k: r.status for k, r in got.items()} == {
        "same": "ok", "twice": "ok", "tie": "ok", "nearer": "isoform_offset_-2", "large": "large_offset_candidate_+28", "seen": "possible_large_offset_or_gap", "conflict": "reference_sequence_conflict",
        "gap": "unresolved_structure_segment_candidate", "hole": "possible_large_offset_or_gap", "off": "unmapped_reference_position", "via": "isoform_offset_+1", "rescue": "extended_offset_rescue_+21",
        "beyond": "large_offset_candidate_+38", "nochain": "no_chain_in_pdb", "nomodel": "structural_ineligible", "lost": "position_not_in_enst"}
    assert (got["tie"].chain, got["tie"].resnum, got["nearer"].chain) == ("B", 1012, "B")
    assert (got["via"].proxy_gene, got["via"].chain) == ("gb", "C") and got["nochain"].status_category == "isoform_proxy_gap"
    assert got["rescue"].anchor_method == "extended_window" and got["same"].anchor_method == "default_window" and got["large"].anchor_detail == "extended_window"
    second = {r.vid: r.status for r in out if r.role == "secondary"}
    assert second["same"] == "ok" and second["nearer"] == "isoform_offset_-3" and second["off"] == "secondary_not_attempted_no_primary_support"
