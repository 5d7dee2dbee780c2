"""Findings of the third review: small cases that failed before."""

import random

from pyspark.sql import functions as F

from cladewise.catalog import QUERIES
from cladewise.operators import alignment as al
from cladewise.operators import spatial
from cladewise.operators import tree as g
from cladewise.plans import timing
from cladewise.sources import sinks


def test_every_order_settles_a_customer(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(10, 1, "O", "5-LOW"), (11, 2, "F", "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.c_custkey for r in QUERIES["j19_resume_todo"](spark, str(tmp_path)).collect()] == [3]


def test_unobserved_leaf_keeps_its_change(spark):
    edges = spark.createDataFrame([("t", "r", "n"), ("t", "n", "seen"), ("t", "n", "blank"), ("t", "n", "plain")], "tree string, parent string, child string")
    root = spark.createDataFrame([("t", 1, "A"), ("t", 2, "A")], "tree string, pos int, aa string")
    changes = spark.createDataFrame([("t", "n", "seen", 1, "A", "C"), ("t", "n", "seen", 2, "A", "G"), ("t", "n", "blank", 1, "A", "D")], "tree string, parent string, child string, pos int, aa_from string, aa_to string")
    observed = spark.createDataFrame([("t", "seen", 1, "E")], "tree string, node string, pos int, aa string")
    clo = g.with_self(g.closure(edges), edges)
    out = g.propagate_observed(clo, edges, root.select("tree", "pos"), root, changes, observed)
    got = {(r.node, r.pos): r.aa for r in out.collect()}
    assert {n: a for (n, p), a in got.items() if p == 1} == {"r": "A", "n": "A", "seen": "E", "blank": "D", "plain": "A"}
    assert {a for (n, p), a in got.items() if p == 2} == {"A"}


def test_asked_pairs_in_small_slices_and_chunks(spark):
    """Rows of very different lengths: those that end before a pair are counted unread, the others in any slice and chunk."""
    rnd = random.Random(5)
    rows = [(g, k, "".join(rnd.choice("ACDX-") for _ in range(rnd.choice([0, 1, 2, 5, 9, 40])))) for g in ("a", "b") for k in range(60)]
    aln = spark.createDataFrame(rows, "gene string, species long, seq string").cache()
    want = {(r.gene, r.i, r.j): r.mi for r in al.all_information(aln).collect()}
    pairs = spark.createDataFrame([(*k,) for k in want if (k[1] + k[2]) % 5 == 0] + [("a", 30, 3)], "gene string, i long, j long").cache()
    counts = al.asked_counts(aln, pairs, size=20, chars=50).cache()
    assert {r.n for r in counts.groupBy("gene", "i", "j").sum("n").toDF("gene", "i", "j", "n").collect()} == {60}
    got = {(r.gene, r.i, r.j): r.mi for r in al.asked_information(counts).collect()}
    assert len(got) == pairs.count() and all(abs(v - want[g, min(i, j), max(i, j)]) < 1e-9 for (g, i, j), v in got.items())
    seqs = {g: [s for h, _, s in rows if h == g] for g in ("a", "b")}
    asked = {(r.gene, r.i, r.j) for r in pairs.collect()}
    brute = {}
    for g, i, j in asked:
        for s in seqs[g]:
            if len(s) > max(i, j):
                brute[g, i, j, s[i], s[j]] = brute.get((g, i, j, s[i], s[j]), 0) + 1
    assert {(r.gene, r.i, r.j, r.a, r.b): r.n for r in al.pair_columns(aln, pairs).collect()} == brute


def test_timing_meets_distinct_questions(spark, monkeypatch):
    """Equal pairs are timed once; a pair without a contact keeps its branches."""
    edges = spark.createDataFrame([("t", "r", "n"), ("t", "n", "x"), ("t", "n", "y")], "tree string, parent string, child string")
    rows = [("t", n, p, a) for n, p, a in (("r", 1, "A"), ("n", 1, "A"), ("x", 1, "C"), ("y", 1, "A"), ("r", 2, "A"), ("n", 2, "C"), ("x", 2, "C"), ("y", 2, "C"))]
    st = spark.createDataFrame(rows, "tree string, node string, pos int, aa string")
    asked = [(k, "t", 1, "A", "C", 2, "A", "C") for k in range(50)] + [(50, "t", 1, "A", "C", None, "A", None)]
    pairs = spark.createDataFrame(asked, "pair_id long, tree string, pos int, ref string, alt string, contact_pos int, contact_human string, contact_alt string")
    met, plain = [], g.timing_same_labels
    monkeypatch.setattr(timing.g, "timing_same_labels", lambda b, *rest: met.append(b.count()) or plain(b, *rest))
    got = {r.pair_id: (r.n_contact_first, r.n_no_contact_change) for r in timing.annotate_timing(pairs, edges, st, st).collect()}
    assert met == [2] and got == {**{k: (1, 0) for k in range(50)}, 50: (0, 1)}


def test_contact_classes_without_atom_pairs(spark):
    """Each class once, and no row an atom pair: nothing is joined per atom and counted back."""
    atoms = []
    for n, aa_a, aa_b, el, at, d in ((1, "G", "G", "N", "N", 3.0), (2, "R", "D", "C", "CB", 4.5), (3, "A", "L", "C", "CB", 4.5), (4, "A", "L", "C", "CA", 4.5)):
        atoms += [("m", "A", n, aa_a, at, el, 0.0, 10.0 * n, 0.0), ("m", "B", n, aa_b, at, el, d, 10.0 * n, 0.0), ("m", "B", n, aa_b, "X", "S", 90.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(atoms, "pdb string, chain string, resnum long, aa string, atom string, element string, x double, y double, z double")
    pairs = spark.createDataFrame([("m", "A", n, "B", n) for n in (1, 2, 3, 4)] + [("m", "A", 1, "B", 99)], "pdb string, a_chain string, a_resnum long, b_chain string, b_resnum long")
    out = spatial.classify_contact(pairs, atoms)
    assert {r.a_resnum: r.contact_class for r in out.collect()} == {1: "hbond", 2: "electrostatic", 3: "hydrophobic", 4: "vdw"}
    assert "bool_or" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_texts_are_not_dealt_by_language(spark):
    """The alignment, and a pair's map, without a shuffle of texts or cells by a handful of keys."""
    from cladewise.catalog.tables import Tables

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Tables(spark, "/root/testdata/sf0.001")
        assert "SortMergeJoin" not in t.aln._jdf.queryExecution().executedPlan().toString()
        plan = QUERIES["m04_map_from_gapped_pair"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Window" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    rows = spark.createDataFrame([(1, "AC-GT", "A-CGTTT"), (2, "", "A"), (3, "--", "AC")], "k long, a string, b string")
    got = {(r.k, r.pos_from, r.pos_to, r.same) for r in al.map_from_gapped_pair(rows, "k", "a", "b").collect()}
    assert got == {(1, 1, 1, True), (1, 2, None, False), (1, 3, 3, True), (1, 4, 4, True)}


def test_rows_meet_only_the_slices_they_reach(spark):
    """Cells and codons by place: a short row has none beyond its end, texts are not dealt by gene, and residues nobody asks for make no row."""
    aln = spark.createDataFrame([("g", 1, "ABCD" * 3000), ("g", 2, "AB"), ("g", 3, "")], "gene string, species long, seq string")
    asked = spark.createDataFrame([("g", c) for c in (0, 1, 5, 4096, 11999, 12000)], "gene string, col long")
    got = {(r.species, r.col): r.ch for r in al.asked_cells(aln, asked).collect()}
    assert got == {(1, 0): "A", (1, 1): "B", (1, 5): "B", (1, 4096): "A", (1, 11999): "D", (2, 0): "A", (2, 1): "B"}
    short = {(r.species, r.col): r.ch for r in al.asked_cells(aln, asked, short=True).collect()}
    assert len(short) == 18 and {k: v for k, v in short.items() if v is not None} == got
    nt = spark.createDataFrame([("g", 1, "ACG" * 12000), ("g", 2, "ACGT-")], "gene string, species long, seq string")
    columns = spark.createDataFrame([("g", 1, 0, 1, 2), ("g", 2, 3, 4, 5), ("g", 9000, 26997, 26999, 27003)], "gene string, codon_no long, c0 long, c1 long, c2 long")
    assert {(r.species, r.codon_no, r.codon) for r in al.asked_codons(nt, columns).collect()} == {(1, 1, "ACG"), (1, 2, "ACG"), (1, 9000, "AGA"), (2, 1, "ACG")}
    wanted = spark.createDataFrame([("g", 0, 1, "A"), ("g", 1, 2, "Z"), ("g", 8999, 9000, "D")], "gene string, col long, codon_no long, alt_aa string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = al.residues_with_codons(aln, nt, wanted, columns)
        assert both._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1  # the two texts of a species
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {(r.species, r.col, r.ch, r.codon) for r in both.collect()} == {(1, 0, "A", "ACG"), (2, 0, "A", "ACG"), (1, 8999, "D", "AGA")}


def test_asking_rows_and_cells_are_not_copied_or_shuffled(spark):
    """The anchor search copies the references, not the rows that ask; leaf states meet the reference's columns where the cells are made."""
    from cladewise.operators import ranges

    ref = spark.createDataFrame([("g", p, a) for p, a in enumerate("ACAACA", 1)], "gene string, pos int, aa string")
    asked = spark.createDataFrame([(k, "g", p, "C") for k, p in enumerate((1, 2, 4, 40))] + [(9, "h", 1, "A"), (10, "g", None, "A")], "k long, gene string, pos long, aa string")
    up, near = (f(asked, ref, "gene", "pos", "aa", window=3) for f in (ranges.anchor_search_ascending, ranges.anchor_search_nearest))
    assert {r.k: r.anchor for r in up.collect()} == {0: 2, 1: 2, 2: 2, 3: None, 9: None, 10: None}
    assert {r.k: r.anchor for r in near.collect()} == {0: 2, 1: 2, 2: 5, 3: None, 9: None, 10: None}
    assert up._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = g.leaf_states(spark.createDataFrame([("g", 1, 0, "A"), ("g", 1, 1, "-"), ("g", 2, 2, "C")], "gene string, species long, col int, ch string"), spark.createDataFrame([("g", 0, 1), ("g", 1, 2)], "gene string, col int, pos int"))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in out.collect()] == [("g", 1, 1, "A")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_nodes_whose_sizes_rule_a_match_out_do_not_meet(spark, monkeypatch):
    """F21 F22 F23 F25: sizes of large nodes are sent, those of others joined, and single leaves meet no large clade."""
    monkeypatch.setattr(g, "LARGE_NODE", 3)
    a = spark.createDataFrame([("top", x) for x in "abcdef"] + [("left", x) for x in "abc"] + [(x, x) for x in "abcdef"], "node string, leaf string")
    b = spark.createDataFrame([("all", x) for x in "abcdef"] + [("low", x) for x in "ab"] + [(x, x) for x in "abcdef"], "node string, leaf string")
    assert {(r.node_a, r.size_a) for r in g.sized(a, "a").collect()} == {("top", 6), ("left", 3)} | {(x, 1) for x in "abcdef"}
    assert {r.node_a for r in g.clade_overlap(a, b, 0.6).where("matched").collect()} == {"top", "left"} | set("abcdef")
    assert {(r.node_a, r.node_b, r.shared) for r in g.node_match_jaccard(a, b).collect()} == {("top", "all", 6), ("left", "low", 2)}


def test_closure_of_crowded_and_deep_trees(spark, monkeypatch):
    """F21 F22 F23 F25: levels that are set apart give the paths that doubling gives, sent or dealt."""
    rows = [("t", str(i), str(i + 1)) for i in range(7)] + [("t", "3", f"x{i}") for i in range(5)] + [("u", "r", "a"), ("u", "r", "b")]
    edges = spark.createDataFrame(rows, "tree string, parent string, child string")
    plain = sorted(map(tuple, g.closure(edges, 0).collect()))
    assert len(plain) == 28 + 20 + 2 and sorted(map(tuple, g.closure(edges).collect())) == plain
    monkeypatch.setattr(g, "SENT_PATHS", 0)
    assert sorted(map(tuple, g.closure(edges).collect())) == plain


def test_master_is_made_once_and_compressed(spark, tmp_path):
    """text files come from the Parquet rows, compressed, with every row in each."""
    made = spark.range(50).select(F.col("id"), F.rand().alias("draw"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("genome"))
    nan = made.withColumn("x", F.lit(float("nan")))
    sinks.write_master(nan, f"{tmp_path}/m")
    want = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/m/parquet").select("id", "draw", "genome").collect()))
    for part in ("jsonl", "by_genome"):
        assert not list((tmp_path / "m" / part).rglob("*.json")) and list((tmp_path / "m" / part).rglob("*.json.gz"))
        assert sorted(map(tuple, spark.read.schema("id long, draw double, genome string").json(f"{tmp_path}/m/{part}").collect())) == want


def test_contacts_of_residues_with_one_atom_are_not_put_together(spark):
    """F12 F13: pairs of single atoms need no grouping; a residue with two atoms keeps its nearest."""
    one = spark.createDataFrame([("p", "A", 1, 0.0, 0.0, 0.0), ("p", "A", 2, 1.0, 0.0, 0.0), ("p", "B", 1, 0.0, 2.0, 0.0), ("p", "B", 9, 50.0, 0.0, 0.0)], "pdb string, chain string, resnum long, x double, y double, z double")
    near = spatial.spatial_contacts(one, one, 4.0)
    assert "Aggregate" not in near._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.a_chain, r.a_resnum, r.b_chain, r.b_resnum): r.distance for r in near.collect()}
    assert len(got) == 6 and got["A", 1, "A", 2] == 1.0 and got["A", 1, "B", 1] == 2.0
    two = one.unionByName(spark.createDataFrame([("p", "B", 1, 0.0, 1.5, 0.0)], one.schema))
    rows = spatial.spatial_contacts(one, two, 4.0).collect()
    assert len(rows) == 6 and {r.distance for r in rows if (r.a_chain, r.a_resnum, r.b_chain, r.b_resnum) == ("A", 1, "B", 1)} == {1.5}


def test_classes_of_contacts_keep_their_distance(spark):
    """distinct pairs are classified with their distance, so they need not meet it again."""
    rows = [("p", "A", 1, "K", "N", "N", 0.0, 0.0, 0.0), ("p", "A", 2, "D", "O", "O", 3.0, 0.0, 0.0), ("p", "B", 3, "G", "C", "C", 0.0, 7.0, 0.0)]
    atoms = spark.createDataFrame(rows, "pdb string, chain string, resnum long, aa string, atom string, element string, x double, y double, z double")
    near = spatial.spatial_contacts(atoms, atoms, 8.0)
    got = {(r.a_resnum, r.b_resnum): (r.distance, r.contact_class) for r in spatial.classify_contact(near, atoms, "distance").collect()}
    assert got[1, 2] == got[2, 1] == (3.0, "hbond") and got[1, 3] == (7.0, "vdw") and len(got) == 6


def test_few_links_are_kept_in_few_partitions(spark, monkeypatch):
    """op3, pipeline: rounds over few links fill no partitions of their own; more links take more of them, with the same roots."""
    from cladewise.llm import components as cc

    rows = [(i, i + 1) for i in range(30)] + [(100, 40 + i) for i in range(9)] + [(7, 7)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(7)
    want = {i: 0 for i in range(1, 31)} | {i: 40 for i in [*range(41, 49), 100]}
    for part_rows in (20_000, 5):
        monkeypatch.setattr(cc, "PART_ROWS", part_rows)
        got = cc.components(links)
        assert {r.node: r.root for r in got.collect()} == want
        assert part_rows == 5 or got.rdd.getNumPartitions() == 1
