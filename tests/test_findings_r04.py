"""Findings of the fourth review: small cases that failed before."""

import random

import duckdb

from cladewise.catalog import ORACLES, QUERIES
from cladewise.operators import alignment as al


def both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over small tables."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=str), sorted(con.execute(ORACLES[name]).fetchall(), key=str)


def test_best_of_a_pair_skips_missing_fields(spark, tmp_path):
    """the row with the smallest p has no price, and a row without a key has no p; of equal p the smallest key."""
    orders = [(5, 1, "F", None, "1-URGENT"), (9, 1, "O", 200000.0, "5-LOW"), (None, 2, "F", 70000.0, "5-LOW"), (8, 3, "F", 10.0, "5-LOW"), (100011, 3, "F", 20.0, "5-LOW")]
    orders = [(*r[:4], None, r[4]) for r in orders]
    got, want = both(spark, tmp_path, "a10_best_per_pair", orders=(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
                     customer=([(k, 0, "MACHINERY") for k in (1, 2, 3)], "c_custkey long, c_nationkey int, c_mktsegment string"), nation=([(0, "A")], "n_nationkey int, n_name string"))
    assert got == want
    assert {r[0]: r[3:] for r in got} == {1: (5, 2.0), 2: (None, None), 3: (8, 0.0001)}


def test_closest_model_skips_missing_names(spark, tmp_path):
    """the nearest contact has no model; a part without distance, and one without contacts, have none; of equal distances the smallest model."""
    lines = [(1, None, 3.0, "N"), (1, 8, 4.0, "N"), (1, 2, 1.0, "A"), (2, 7, 9.0, "A"), (4, 6, 5.0, "R"), (4, 5, 5.0, "N"), (5, None, 2.0, "N"), (5, 3, 1.0, "A")]
    lines = sorted(lines, key=lambda r: (r[0], r[1] or 0))
    got, want = both(spark, tmp_path, "j14_closest_model", lineitem=(lines, "l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string"),
                     part=([(k, "b") for k in range(1, 6)], "p_partkey long, p_brand string"))
    assert got == want
    assert got == [(1, 3.0, 8), (2, None, None), (3, None, None), (4, 5.0, 5), (5, 2.0, None)]


def test_all_pairs_of_rows_in_few_copies(spark):
    """counts are those of every pair, also of long rows, other letters and a key given twice; a row is copied to 16 blocks, not to one a 128 rows."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ABC-") for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 200, 900]))) for _ in range(70)] + ["", "--", "ÄBé-", "ÄBC-", "𝄞BC"]
    rows = [("g", k // 2, s) for k, s in enumerate(texts)] + [("g", 500 + k, s) for k, s in enumerate(texts[::7])] + [("h", 1, "AB")]
    aln = spark.createDataFrame(rows, "gene string, species long, seq string")
    seqs = [s for g, _, s in rows if g == "g"]

    def ident(a, b):
        both = [(x, y) for x, y in zip(a, b) if x != "-" and y != "-"]
        return sum(x == y for x, y in both) / len(both) if both else 0.0

    for block in (10, 8192):
        got = {(r.gene, r.threshold): (r.m_eff, r.n_rows) for r in al.effective_count(aln, [0.3, 0.9], block=block).collect()}
        for t in (0.3, 0.9):
            want = sum(1 / (1 + sum(ident(a, b) >= t for j, b in enumerate(seqs) if j != i)) for i, a in enumerate(seqs))
            assert got["g", t][1] == len(seqs) and abs(got["g", t][0] - want) < 1e-9 and got["h", t] == (1.0, 1)
    many = spark.range(4000).selectExpr("'g' AS gene", "id AS species", "repeat('A', cast(id % 50 as int)) AS seq")
    blocks = al._block_pairs(many, al.BLOCK_ROWS).cache()
    assert blocks.count() == 16 * 4000
    assert blocks.groupBy("bi", "bj").count().agg({"count": "max"}).first()[0] < 1500


def test_contacts_are_classified_where_they_are_found(spark):
    """residues are shuffled, pairs are not; each class, two atoms of a residue, and a residue without atoms."""
    from cladewise.operators import spatial

    rows = []
    for n, aa_a, aa_b, el, at, d in ((1, "G", "G", "N", "N", 3.0), (2, "R", "D", "C", "CB", 3.9), (3, "A", "L", "C", "CB", 3.9), (4, "A", "L", "C", "CA", 3.9), (5, "R", "R", "C", "CB", 3.9), (6, "D", "H", "O", "O", 3.9)):
        rows += [("m", "A", n, aa_a, at, el, 0.0, 20.0 * n, 0.0), ("m", "B", n, aa_b, at, el, d, 20.0 * n, 0.0)]
    schema = "pdb string, chain string, resnum long, aa string, atom string, element string, x double, y double, z double"
    atoms = spark.createDataFrame(rows, schema)
    beta = atoms.unionByName(spark.createDataFrame([("m", "C", 9, "G", "CB", "C", 1.0, 20.0, 0.0)], schema))
    want = {1: "hbond", 2: "electrostatic", 3: "hydrophobic", 4: "vdw", 5: "vdw", 6: "electrostatic"}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = spatial.classified_contacts(beta, beta, atoms, 4.0)
        # By cell once a side, and by residue once a side and once for its atoms: nothing after the pairs are made.
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("cx") < plan.index("Aggregate") and plan.count("Join") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got = {(r.a_chain, r.a_resnum, r.b_chain, r.b_resnum): (r.distance, r.contact_class) for r in out.collect()}
    assert {k[1]: v[1] for k, v in got.items() if k[0] == "A"} == {k[1]: v[1] for k, v in got.items() if k[0] == "B"} == want and len(got) == 12
    plain = {tuple(r[1:5]): r.contact_class for r in spatial.classify_contact(spatial.spatial_contacts(beta, beta, 4.0), atoms).collect()}
    assert plain == {k: v[1] for k, v in got.items()}
    twice = beta.unionByName(beta.where("chain = 'B'").withColumn("x", beta.x - 1))
    assert {(r.a_resnum, r.distance, r.contact_class) for r in spatial.classified_contacts(beta, twice, atoms, 4.0).where("a_chain = 'A'").collect()} == {
        (k, 2.0 if k == 1 else 2.9, v) for k, v in want.items()}


def classified(spark, **how):
    from cladewise.plans import classify as pc
    from test_domain import VARIANTS, alignments

    args = alignments(spark)
    v = spark.createDataFrame([("k", "nucDNA", "g", True, 3, "K", "E", 7, "A", "G", 1), ("same", "nucDNA", "g", True, 3, "K", "E", 7, "A", "G", 1), ("none", "nucDNA", "g", True, 3, "K", "Q", 7, "A", "C", 1),
                               ("two", "nucDNA", "g", True, 3, "K", "E", 7, "A", "G", 1), ("two", "nucDNA", "g", True, 3, "K", "E", 7, "A", "G", 1), ("out", "mtDNA", "g", False, 3, "K", "E", 7, "A", "G", 1)], VARIANTS)
    return pc, args, *pc.classify(v, *args, **how)


def test_variants_are_not_written_to_classify_them(spark, monkeypatch):
    """what is written is what variants ask for, and the rows that fail a check; all checks of all parts read the table once."""
    from cladewise.plans import classify as pc

    written, plain = [], pc.cut_lineage
    monkeypatch.setattr(pc, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    _, _, rows, _ = classified(spark)
    got = sorted((r.vid, r.status, r.n_species, r.n_species_codon) for r in rows.collect())
    assert got == [("k", "classified", 2, 1), ("none", "classified", 0, 0), ("out", "skipped_by_policy", None, None), ("same", "classified", 2, 1), ("two", "classified", 4, 2), ("two", "classified", 4, 2)]
    both = rows.selectExpr("*", "'a' AS part").unionByName(rows.selectExpr("* EXCEPT (basis)", "'old' AS basis", "'b' AS part"))
    out = {(r.part, r.check_name): (r.status, r.n_failed, r.examples) for r in pc.qc(both, "part", ("a", "b", "c")).collect()}
    assert len(out) == 12 and {k: v for k, v in out.items() if v[0] == "fail"} == {("b", "valid_basis"): ("fail", 5, "k,none,same,two,two")}
    assert not any("basis" in c or "reason" in c or "eligible" in c for c in written) and written[-1] == ["part", "vid", "check_name"]


def test_claims_are_checked_by_place(spark):
    """carriers given once a place, not once a variant, hold the same claims and show the same that do not."""
    pc, args, rows, by_vid = classified(spark)
    places = classified(spark, by_place=True)[3].cache()
    assert sorted((r.ch, r.species, r.codon) for r in places.collect()) == [("E", 1, "GAA"), ("E", 2, "GAG")] and by_vid.where("vid <> 'two'").count() == 4
    once = rows.where("vid <> 'two'")
    check = lambda r, c: sorted(map(tuple, pc.layered_validation(r, c, args[0], args[1], args[3]).collect()))
    assert check(once, places) == check(once, by_vid.where("vid <> 'two'")) and all(x[-1] for x in check(once, places)) and len(check(once, places)) == 6
    lost = check(once, places.where("species <> 1"))
    assert [x[0:2] for x in lost if not x[-1]] == [("k", "codon"), ("same", "codon")]
