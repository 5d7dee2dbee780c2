"""Known answers on small domain fixtures."""

from pyspark.sql import functions as F

from cladewise.functions import protein, rules, text
from cladewise.operators import alignment as al
from cladewise.operators import lookup, ranges
from cladewise.operators import tree as g
from cladewise.plans import classify as pc
from cladewise.plans import curate, timing
from cladewise.sources import readers

C = F.col


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first().x


def test_aliases_and_coordinates(spark):
    genes = spark.createDataFrame([("KORB2", "OLDK, KOR9", 1), ("TAV1", "TAVOLD", 2), ("ZIM", None, 3)], "symbol string, previous string, ord long")
    alias = {r.alias: r.symbol for r in lookup.alias_table(genes, "symbol", "previous", "ord").collect()}
    assert alias["OLDK"] == "KORB2" and alias["KOR9"] == "KORB2" and alias["TAVOLD"] == "TAV1" and "NOSUCH" not in alias
    raw = spark.createDataFrame([("TAV1", "7", "5200", "4100", "-"), ("ZIM", "Q", "300", "120", "-"), ("KORB2", "Q", "301", "350", "+")], "gene string, chr string, start string, end string, strand string")
    coords = readers.gene_coords(raw)
    assert all(r.start <= r.end for r in coords.collect())
    q = coords.where("chr = 'Q'").select("gene", C("start").alias("s"), C("end").alias("e"), F.lit(1).alias("o"))
    pts = spark.createDataFrame([(120,), (210,), (300,), (301,), (351,), (5,)], "p long")
    got = {r.p: r.locus for r in ranges.locus_by_position(pts, "p", q, "gene", "s", "e", "o", "elsewhere").collect()}
    assert got == {120: "ZIM", 210: "ZIM", 300: "ZIM", 301: "KORB2", 351: "elsewhere", 5: "elsewhere"}


def test_text_rules(spark):
    h = one(spark, text.extract_hgvs_c("n"), n="NM_77.2(KORB2):c.88A>T (p.Lys30Ile)")
    assert tuple(h) == ("NM_77.2:c.88A>T", "NM_77.2", "A", "T")
    assert tuple(one(spark, text.parse_protein_hgvs("n"), n="z (p.Lys30Ile)")) == ("K", "30", "I")
    assert one(spark, text.parse_protein_hgvs("n", allow_stop=False), n="p.Trp8*") is None
    assert tuple(one(spark, text.extract_hgvs_c("n"), n="something:c.7T>C")) == ("c.7T>C", "", "T", "C")
    assert one(spark, text.review_stars("n"), n="reviewed by expert panel") == 3
    assert one(spark, text.strip_tip_suffix("n"), n="Corvus_corax_CORVIDAE_PASSERIFORMES") == "Corvus_corax"
    assert one(spark, text.strip_tip_suffix("n"), n="XY_ZW") == "XY_ZW"
    assert one(spark, text.to_int("n"), n="12.25") is None and one(spark, text.to_int("n"), n="  41") == 41
    assert [one(spark, protein.charge_of(F.lit(b)) - protein.charge_of(F.lit(a)), n="") for a, b in (("G", "K"), ("E", "K"), ("K", "G"), ("E", "G"))] == [1, 2, -1, 1]


def test_nested_annotation(spark):
    doc = ('{"_id":"k","dbnsfp":{"revel":{"score":[0.31,0.9]},"alphamissense":{"pred":["LB","LP"]}},"gnomad_genome":{"af":{"af":0.02,"af_afr":0.05,"af_eas":0.01,"af_sas":0.05},'
           '"ac":{"ac":7},"an":{"an":400},"hom":{"hom":1}}}')
    df = spark.createDataFrame([(doc,), ('{"_id":"m","notfound":true}',)], "d string")
    f = text.population_frequency("d")
    rows = df.select(F.get_json_object("d", "$._id").alias("id"), text.to_float(text.first_scalar("d", "$.dbnsfp.revel.score")).alias("revel"),
                     text.prediction_class(text.first_scalar("d", "$.dbnsfp.alphamissense.pred")).alias("cls"), f.alias("f")).collect()
    r, none = rows
    assert (r.revel, r.cls, r.f.popmax_af, r.f.popmax_pop, r.f.ac, r.f.an, r.f.nhomalt) == (0.31, "likely_benign", 0.05, "afr", 7, 400, 1)
    assert none.revel is None and (none.f is None or none.f.popmax_af is None)


def test_mito_source(spark):
    rows = [("1", "150", "G", "A", "L9P"), ("2", "820", "T", "C", "H5Q"), ("3", "600", "A", "G", "S3T"), ("4", "830", "A", "G", "noncoding"), ("5", "840", "A", "G", "Q7*"), ("6", "?", "A", "G", "G2S")]
    src = spark.createDataFrame(rows, "id string, pos string, ref string, alt string, aachange string")
    iv = spark.createDataFrame([("MT-ONE", 100, 400), ("MT-TWO", 800, 900)], "gene string, start_pos long, end_pos long")
    seqs = spark.createDataFrame([], "gene string, start long, end long, strand string, seq string")
    out, lost = curate.curate_mito(src, iv, seqs, (800, 900))
    got = {r.record_id: r for r in out.collect()}
    assert {k for k, r in got.items() if r.eligible} == {"1", "2"}
    assert (got["1"].ref_nt, got["1"].alt_nt) == ("G", "A") and (got["2"].ref_nt, got["2"].alt_nt) == ("A", "G")  # complemented inside the range only
    assert got["4"].reason == "noncoding" and got["5"].reason == "nonsense"
    assert {r.record_id: r.exclusion_reason for r in lost.collect()} == {"3": "outside_panel", "6": "invalid_position"}


#: Residues and codons of one gene. Row e has a gap in the middle codon, row f ends early, row c carries the residue by another codon.
AA = {"Homo_sapiens|9606": "WL-KD", "b": "WL-ED", "c": "WLAED", "d": "WLQKD", "e": "WL--D", "f": "WL", "g": "WL-XD"}
NT = {"Homo_sapiens|9606": "TGGCTT---AAAGAT", "b": "TGGCTT---GAAGAT", "c": "TGGCTTGCTGAGGAT", "d": "TGGCTTCAAAAAGAT", "e": "TGGCTT------GAT", "f": "TGGCTT", "g": "TGGCTT---GAAGAT"}
VARIANTS = "vid string, genome string, gene string, eligible boolean, aa_pos long, wt string, mut string, nt_pos long, ref_nt string, alt_nt string, genomic_pos long"


def alignments(spark):
    def aln(d):
        return spark.createDataFrame([("g", i, k, v) for i, (k, v) in enumerate(d.items())], "gene string, species long, header string, seq string").withColumn("is_ref", C("header").startswith("Homo"))

    aa, nt = aln(AA), aln(NT)
    return aa, nt, al.position_map(al.reference_row(aa)), al.position_map(al.reference_row(nt))


def test_classify(spark):
    args = alignments(spark)
    v = spark.createDataFrame([("k", "nucDNA", "g", True, 3, "K", "E", 7, "A", "G", 1), ("shift", "nucDNA", "g", True, 2, "K", "E", 4, "A", "G", 1), ("none", "nucDNA", "g", True, 3, "K", "Q", 7, "A", "C", 1),
                              ("wrong", "nucDNA", "g", True, 3, "K", "W", 7, "A", "G", 1), ("no", "nucDNA", "g", True, 3, "Y", "E", 7, "A", "G", 1), ("far", "mtDNA", "h", True, 3, "K", "E", 7, "A", "G", 1),
                              ("out", "mtDNA", "g", False, 3, "K", "E", 7, "A", "G", 1)], VARIANTS)
    rows, carriers = pc.classify(v, *args)
    got = {r.vid: r for r in rows.collect()}
    for k in ("k", "shift"):  # the anchor search finds the residue one place on
        assert (got[k].status, got[k].mut_codon, got[k].n_species, got[k].n_species_codon, got[k].basis) == ("classified", "GAA", 2, 1, "nt_and_aa")
    assert (got["none"].n_species, got["none"].n_species_codon, got["none"].basis) == (0, 0, "no_disease_allele_detected")
    assert [got[k].reason for k in ("wrong", "no", "far", "out")] == ["transcript_mismatch", "anchor_not_found", "missing_alignment", "skipped_by_policy"]
    assert sorted((r.vid, r.species, r.same_codon) for r in carriers.collect()) == [("k", 1, True), ("k", 2, False), ("shift", 1, True), ("shift", 2, False)]
    assert {r.status for r in pc.qc(rows).collect()} == {"pass"}
    held = pc.layered_validation(rows, carriers, args[0], args[1], args[3]).collect()
    assert all(r.holds for r in held) and sorted((r.vid, r.layer, r.n_raw) for r in held if r.claim == "positive") == [("k", "codon", 1), ("k", "residue", 2), ("shift", "codon", 1), ("shift", "residue", 2)]
    # A claim that was altered, and carriers that were lost, no longer hold.
    broken = rows.withColumn("n_species_codon", F.when(C("vid") == "k", 2).otherwise(C("n_species_codon")))
    bad = pc.layered_validation(broken, carriers.where("vid <> 'shift'"), args[0], args[1], args[3]).where("not holds").collect()
    assert sorted((r.vid, r.layer) for r in bad) == [("k", "codon"), ("shift", "codon"), ("shift", "residue")]


def test_classify_with_maps(spark):
    v = spark.createDataFrame([("t", "nucDNA", "g", True, 53, "K", "E", 157, "A", "G", 1), ("gap", "nucDNA", "g", True, 54, "K", "E", 160, "A", "G", 1)], VARIANTS)
    tx = spark.createDataFrame([("g", 53, 3), ("g", 54, None)], "gene string, pos_from long, pos_to long")
    good = spark.createDataFrame([("g", 0.99, 0.99)], "gene string, identity_fraction double, coverage_fraction double")
    got = {r.vid: (r.status, r.reason, r.coordinate_method, r.n_species) for r in pc.classify(v, *alignments(spark), tx_map=tx, tx_quality=good)[0].collect()}
    assert got == {"t": ("classified", None, "transcript_map", 2), "gap": ("unresolved", "position_not_in_enst", "transcript_map", None)}
    poor = spark.createDataFrame([("g", 0.5, 0.99)], "gene string, identity_fraction double, coverage_fraction double")
    gmap = spark.createDataFrame([("g", 1, 7, 3)], "gene string, genomic_pos long, cds_pos long, aa_pos long")
    got = {r.vid: (r.status, r.coordinate_method, r.n_species) for r in pc.classify(v, *alignments(spark), tx_quality=poor, genomic_map=gmap)[0].collect()}
    assert got["t"] == ("classified", "genomic_map", 2)


def test_gapped_reference_coordinates(spark):
    rows = [("g", 0, "Homo_sapiens|9606|x", "QR---STV-W"), ("g", 1, "Vulpes", "QK---S-VYW"), ("g", 2, "Lepus", "-RPP-STV--")]
    aln = spark.createDataFrame(rows, "gene string, species long, header string, seq string")
    m = al.position_map(al.reference_row(aln), "-X*")
    assert [(r.pos, r.col) for r in m.orderBy("pos").collect()] == [(1, 0), (2, 1), (3, 5), (4, 6), (5, 7), (6, 9)]
    seen = {(r.species, r.pos): r.aa for r in g.leaf_states(al.explode_alignment(aln), m).collect()}
    assert seen[(1, 2)] == "K" and seen[(1, 6)] == "W" and (2, 1) not in seen and (1, 4) not in seen
    st = spark.createDataFrame([("g", "N1", s, c) for s, c in ((10, "W"), (9, "Y"), (2, "R"))], "gene string, node string, site int, aa string")
    kept, audit = g.harmonize_sites(st, m)
    assert sorted((r.pos, r.aa) for r in kept.collect()) == [(2, "R"), (6, "W")] and audit.first().rows_dropped == 1


EDGES = [("top", "left"), ("top", "right"), ("left", "p"), ("left", "q"), ("left", "r"), ("right", "s"), ("s", "u"), ("s", "v")]


def test_timing_of_a_contact(spark):
    edges = spark.createDataFrame([("t", *e) for e in EDGES], "tree string, parent string, child string")
    cs = g.with_self(g.closure(edges), edges)
    assert cs.count() == 9 + 8 + 6 + 2

    def timing_for(root, changes):
        ch = spark.createDataFrame([("t", p, c, 31, a, b) for p, c, a, b in changes], "tree string, parent string, child string, pos int, aa_from string, aa_to string")
        st = g.propagate_changes(cs, spark.createDataFrame([("t", 31, root)], "tree string, pos int, aa string"), ch)
        br = spark.createDataFrame([("t", "top", "left", 31, "H")], "tree string, parent string, child string, contact_pos int, contact_alt string")
        return g.timing_same_labels(br, st, cs).first().timing

    assert timing_for("H", []) == "contact_first"
    assert timing_for("N", [("top", "left", "N", "H")]) == "co_occurring"
    assert timing_for("N", [("left", "q", "N", "H")]) == "contact_after"
    assert timing_for("N", [("right", "s", "N", "H")]) == "no_contact_change"
    assert timing_for("N", []) == "no_contact_change"


def test_pair_timing_falls_back_to_low_tier(spark):
    edges = spark.createDataFrame([("t", *e) for e in EDGES], "tree string, parent string, child string")
    nodes = ["top", *(c for _, c in EDGES)]
    st = spark.createDataFrame([("t", n, p, "N") for n in nodes for p in (1, 2)], "tree string, node string, pos int, aa string")
    pairs = spark.createDataFrame([(1, "t", 1, "N", "H", 2, "N", "G")], "pair_id long, tree string, pos int, ref string, alt string, contact_pos int, contact_human string, contact_alt string")
    low = spark.createDataFrame([("t", "top", "left", 1, "N", "H")], "tree string, parent string, child string, pos int, aa_from string, aa_to string")
    a = timing.annotate_timing(pairs, edges, st, st).first()
    b = timing.annotate_timing(pairs, edges, st, st, low_changes=low).first()
    assert a.skip_reason == "no_origin_in_tree" and (b.confidence, b.n_no_contact_change, b.direction) == ("low_confidence", 1, "no_detected_partner_change")


def test_deep_tree_closure(spark):
    n = 150
    edges = spark.createDataFrame([("t", f"n{i}", f"n{i + 1}") for i in range(n)], "tree string, parent string, child string")
    r = g.closure(edges).agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
    assert (r.n, r.d) == (n * (n + 1) // 2, n)


def test_directions(spark):
    for counts, anc, want in (((1, 0, 0, 0), False, "permissive_background"), ((0, 0, 2, 0), False, "responding_secondary"), ((0, 1, 0, 1), False, "co_occurring_unresolved"),
                              ((1, 1, 0, 0), False, "mixed_timing"), ((1, 0, 0, 0), True, "ancestral_cdav_not_directional"), ((0, 0, 0, 0), False, "ambiguous_no_origin")):
        assert one(spark, rules.directional_class(F.lit(anc), *[F.lit(c) for c in counts]), n="") == want


def test_newick_labels(spark):
    t = spark.createDataFrame([(1, "((k:1,l)80:2,(m,(n,o)));")], "k long, s string")
    got = {(r.parent, r.child) for r in readers.read_newick(t, "k", "s").collect()}
    assert got == {("ROOT", "80"), ("ROOT", "anon_1"), ("80", "k"), ("80", "l"), ("anon_1", "m"), ("anon_1", "anon_2"), ("anon_2", "n"), ("anon_2", "o")}
