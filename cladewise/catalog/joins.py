"""J: lookups, range, band and spatial joins, merges and keyed updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, ranges, spatial
from .alignments import ASKED_SQL, asked
from .registry import query

C = F.col


def _genes(t):
    """Symbols with previous names: one row per nation, in key order."""
    k = C("n_nationkey")
    return t.nation.select(C("n_name").alias("symbol"), F.concat(F.lit("OLD_"), (k % 20).cast("string"), F.lit(" ,  ALT_"), k.cast("string")).alias("previous"), k.alias("ord"))


ALIAS_SQL = """g AS (SELECT n_name AS symbol, n_nationkey AS ord, unnest([n_name, 'OLD_' || (n_nationkey % 20), 'ALT_' || n_nationkey]) AS alias FROM nation),
al AS (SELECT alias, arg_max(symbol, ord) AS symbol FROM g GROUP BY 1)"""


@query("j01_alias_lookup", f"""
WITH {ALIAS_SQL}, o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'OLD_' ELSE 'ALT_' END || (o_custkey % 30) AS raw FROM orders)
SELECT o_orderkey, al.symbol, CASE WHEN al.symbol IS NULL THEN 'not_in_panel' ELSE '' END AS exclusion FROM o LEFT JOIN al ON al.alias = raw""")
def _(t):
    raw = F.concat(F.when(C("o_orderkey") % 3 == 0, "OLD_").otherwise("ALT_"), (C("o_custkey") % 30).cast("string"))
    out = lookup.alias_lookup(t.orders.select("o_orderkey", raw.alias("raw")), "raw", lookup.alias_table(_genes(t), "symbol", "previous", "ord"))
    return out.select("o_orderkey", "symbol", F.when(C("symbol").isNull(), "not_in_panel").otherwise("").alias("exclusion"))


@query("j02_locus_by_position", """
WITH p AS (SELECT DISTINCT l_partkey AS pos FROM lineitem), h AS (SELECT pos, string_agg(gene, '/' ORDER BY ord, gene) AS locus FROM p JOIN prx_interval ON pos BETWEEN start_pos AND end_pos GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, md5(COALESCE(locus, 'outside')) AS locus_md5, len(string_split(COALESCE(locus, 'outside'), '/')) AS n_parts FROM lineitem LEFT JOIN h ON pos = l_partkey""")
def _(t):
    out = ranges.locus_by_position(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_partkey", t.interval, "gene",
                                   "start_pos", "end_pos", "ord", "outside")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.md5("locus").alias("locus_md5"), F.size(F.split("locus", "/")).alias("n_parts"))


@query("j03_overlap_expand", """
WITH n AS (SELECT p_partkey, count(*) AS k FROM part JOIN prx_interval ON p_partkey BETWEEN start_pos AND end_pos GROUP BY 1)
SELECT p_partkey, 'SRC:' || p_partkey || ':' || gene AS row_id, 'SRC:' || p_partkey AS group_id, k > 1 AS is_overlap, k AS n_overlap
FROM part JOIN prx_interval ON p_partkey BETWEEN start_pos AND end_pos JOIN n USING (p_partkey)""")
def _(t):
    gid = F.concat(F.lit("SRC:"), C("p_partkey").cast("string"))
    return ranges.overlap_expand(t.part.select("p_partkey"), "p_partkey", t.interval, "gene", "start_pos", "end_pos", gid).select(
        "p_partkey", "row_id", "group_id", "is_overlap", "n_overlap")


@query("j04_registry_match", """
WITH r AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'gene' ELSE 'variant' END AS scope, 'Brand#' || (n_nationkey % 10) AS gene, CAST(n_nationkey * 13 % 200 AS VARCHAR) AS variant_id, n_name AS code, n_nationkey AS ord FROM nation
  UNION ALL SELECT 'variant', '', CAST(s_suppkey * 7 % 1500 AS VARCHAR), s_name, 100 + s_suppkey FROM supplier),
v AS (SELECT variant_id, arg_min(code, ord) AS code FROM r WHERE scope = 'variant' GROUP BY 1), g AS (SELECT gene, arg_min(code, ord) AS code FROM r WHERE scope = 'gene' GROUP BY 1)
SELECT p_partkey, COALESCE(v.code, g.code) AS code, CASE WHEN v.code IS NOT NULL THEN 'variant' WHEN g.code IS NOT NULL THEN 'gene' END AS matched_scope
FROM part LEFT JOIN v ON v.variant_id = CAST(p_partkey AS VARCHAR) LEFT JOIN g ON g.gene = p_brand""")
def _(t):
    k = C("n_nationkey")
    reg = t.nation.select(F.when(k % 2 == 0, "gene").otherwise("variant").alias("scope"), F.concat(F.lit("Brand#"), (k % 10).cast("string")).alias("gene"),
                          (k * 13 % 200).cast("string").alias("variant_id"), C("n_name").alias("code"), k.cast("bigint").alias("ord")).unionByName(
        t.supplier.select(F.lit("variant").alias("scope"), F.lit("").alias("gene"), (C("s_suppkey") * 7 % 1500).cast("string").alias("variant_id"),
                          C("s_name").alias("code"), (C("s_suppkey") + 100).alias("ord")))
    src = t.part.select("p_partkey", C("p_partkey").cast("string").alias("vid"), "p_brand")
    return lookup.registry_match(src, reg, "vid", "p_brand", ["code"], "ord").select("p_partkey", "code", "matched_scope")


@query("j05_annotate_scores", """
WITH s AS (SELECT p_partkey + 1 AS pos, 'A' AS ref, p_retailprice AS score FROM part WHERE p_size > 20)
SELECT vid, COALESCE(s.score, 0.0) AS score FROM prx_variant v LEFT JOIN s ON s.pos = v.pos AND s.ref = v.ref""")
def _(t):
    scores = t.part.where("p_size > 20").select((C("p_partkey") + 1).alias("pos"), F.lit("A").alias("ref"), C("p_retailprice").alias("score"))
    return lookup.annotate_scores(t.variant, scores, ["pos", "ref"], {"score": 0.0}).select("vid", "score")


MAP_SQL = "m AS (SELECT p_brand AS gene, p_partkey AS pos_from, CASE WHEN p_size % 4 <> 0 THEN p_partkey + p_size END AS pos_to FROM part WHERE p_brand <> 'Brand#3' AND p_size > 5)"


def _map(t):
    return t.part.where((C("p_brand") != "Brand#3") & (C("p_size") > 5)).select(
        C("p_brand").alias("gene"), C("p_partkey").alias("pos_from"), F.when(C("p_size") % 4 != 0, C("p_partkey") + C("p_size")).alias("pos_to"))


@query("j06_position_map_join", f"""
WITH {MAP_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m.pos_to AS mapped_pos, CASE WHEN p_brand NOT IN (SELECT gene FROM m) THEN 'no_map' WHEN m.pos_to IS NULL THEN 'gap' ELSE 'mapped' END AS map_status
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN m ON m.gene = p_brand AND m.pos_from = l_partkey""")
def _(t):
    src = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand")
    return lookup.position_map_join(src, _map(t), "p_brand", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "mapped_pos", "map_status")


REFPOS_SQL = """rp AS (SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY col) AS pos, ch AS aa FROM prx_cell WHERE is_ref AND ch <> '-'),
va AS (SELECT vid, ['en', 'de', 'fr', 'es'][CAST(1 + pkey % 4 AS INT)] AS gene, pos, ref_aa AS aa FROM prx_variant), vd AS (SELECT DISTINCT gene, pos, aa FROM va)"""


def _refpos(t):
    from ..operators.alignment import position_map, reference_row

    return position_map(reference_row(t.aln)).select("gene", "pos", C("ch").alias("aa"))


def _anchored(t):
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    return t.variant.select("vid", F.element_at(langs, (C("pkey") % 4 + 1).cast("int")).alias("gene"), "pos", C("ref_aa").alias("aa"))


@query("j07_anchor_search_ascending", f"""
WITH {REFPOS_SQL}, b AS (SELECT vd.gene, vd.pos, vd.aa, arg_min(rp.pos, CASE WHEN rp.pos = vd.pos THEN -1000 ELSE rp.pos - vd.pos END) AS anchor FROM vd JOIN rp ON rp.gene = vd.gene AND rp.aa = vd.aa AND rp.pos BETWEEN greatest(1, vd.pos - 10) AND vd.pos + 10 GROUP BY 1, 2, 3)
SELECT vid, anchor FROM va LEFT JOIN b USING (gene, pos, aa)""")
def _(t):
    return ranges.anchor_search_ascending(_anchored(t), _refpos(t), "gene", "pos", "aa").select("vid", "anchor")


@query("j08_anchor_search_nearest", f"""
WITH {REFPOS_SQL}, b AS (SELECT vd.gene, vd.pos, vd.aa, arg_min(rp.pos, abs(rp.pos - vd.pos) * 2 + CASE WHEN rp.pos > vd.pos THEN 1 ELSE 0 END) AS anchor FROM vd JOIN rp ON rp.gene = vd.gene AND rp.aa = vd.aa AND rp.pos BETWEEN vd.pos - 15 AND vd.pos + 15 GROUP BY 1, 2, 3)
SELECT vid, anchor FROM va LEFT JOIN b USING (gene, pos, aa)""")
def _(t):
    return ranges.anchor_search_nearest(_anchored(t), _refpos(t), "gene", "pos", "aa", window=15).select("vid", "anchor")


@query("j09_nearest_positions", """
WITH m AS (SELECT DISTINCT p_brand AS gene, p_partkey AS mp FROM part WHERE p_size % 5 = 0), a AS (SELECT DISTINCT p_brand AS gene, o_custkey AS pos FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT a.gene, pos, mp, row_number() OVER (PARTITION BY a.gene, pos ORDER BY abs(mp - pos), mp) AS nth FROM a JOIN m ON m.gene = a.gene)
SELECT gene, pos, mp AS near, nth FROM r WHERE nth <= 2""")
def _(t):
    ref = t.part.where("p_size % 5 = 0").select(C("p_brand").alias("gene"), C("p_partkey").alias("pos"))
    asked = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).join(t.orders, C("l_orderkey") == C("o_orderkey")).select(
        C("p_brand").alias("gene"), C("o_custkey").alias("pos"))
    return ranges.nearest_positions(asked, ref, "gene", "pos", 2)


RES = ["chain", "resnum"]


def _beta(t):
    """Representative atoms: the beta carbon, the alpha carbon for glycine."""
    from ..sources.readers import beta_atoms

    return beta_atoms(t.atom.withColumn("pdb", F.lit("m1")), "aa", "G")


BETA_SQL = "ba AS (SELECT * FROM prx_atom WHERE atom = CASE WHEN aa = 'G' THEN 'CA' ELSE 'CB' END)"
CONTACT_SQL = f"""{BETA_SQL}, ct AS (SELECT a.chain AS a_chain, a.resnum AS a_resnum, b.chain AS b_chain, b.resnum AS b_resnum, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance
 FROM ba a JOIN ba b ON (a.chain <> b.chain OR a.resnum <> b.resnum) AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 16.0)"""


@query("j11_spatial_contacts", f"WITH {CONTACT_SQL} SELECT a_chain, a_resnum, b_chain, b_resnum, round(distance, 6) AS distance FROM ct")
def _(t):
    b = _beta(t)
    return spatial.spatial_contacts(b, b, 4.0).select("a_chain", "a_resnum", "b_chain", "b_resnum", F.round("distance", 6).alias("distance"))


CLASS_SQL = f"""{CONTACT_SQL}, pa AS (SELECT a_chain, a_resnum, b_chain, b_resnum, p.aa AS a_aa, q.aa AS b_aa, p.element AS ae, q.element AS be, p.atom AS na, q.atom AS nb,
 sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d FROM ct JOIN prx_atom p ON p.chain = a_chain AND p.resnum = a_resnum JOIN prx_atom q ON q.chain = b_chain AND q.resnum = b_resnum),
cl AS (SELECT a_chain, a_resnum, b_chain, b_resnum, CASE WHEN bool_or(ae IN ('N','O') AND be IN ('N','O') AND d <= 3.5) THEN 'hbond'
 WHEN bool_or(((a_aa IN ('R','K','H') AND b_aa IN ('D','E')) OR (a_aa IN ('D','E') AND b_aa IN ('R','K','H'))) AND d <= 5) THEN 'electrostatic'
 WHEN bool_or(a_aa IN ('A','V','I','L','M','F','W','P','C') AND b_aa IN ('A','V','I','L','M','F','W','P','C') AND ae = 'C' AND be = 'C' AND na NOT IN ('N','CA','C','O') AND nb NOT IN ('N','CA','C','O') AND d <= 5) THEN 'hydrophobic' ELSE 'vdw' END AS contact_class FROM pa GROUP BY 1, 2, 3, 4)"""


@query("j12_classify_contact", f"WITH {CLASS_SQL} SELECT * FROM cl")
def _(t):
    b = _beta(t)
    return spatial.classified_contacts(b, b, t.atom.withColumn("pdb", F.lit("m1")), 4.0).drop("pdb", "distance")


@query("j13_pair_distance", f"""
WITH {BETA_SQL}, p AS (SELECT vec_id AS a_resnum, vec_id + 1 AS b_resnum FROM embeddings)
SELECT a_resnum, b_resnum, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM p LEFT JOIN ba a ON a.resnum = a_resnum LEFT JOIN ba b ON b.resnum = b_resnum""")
def _(t):
    b = _beta(t).withColumn("chain", F.lit("A"))
    pairs = t.embeddings.select(F.lit("m1").alias("pdb"), F.lit("A").alias("a_chain"), C("vec_id").alias("a_resnum"), F.lit("A").alias("b_chain"), (C("vec_id") + 1).alias("b_resnum"))
    return spatial.pair_distance(pairs, b).select("a_resnum", "b_resnum", F.round("distance", 6).alias("distance"))


@query("j14_closest_model", """
WITH c AS (SELECT DISTINCT l_partkey AS pk, l_suppkey AS model, CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END AS d FROM lineitem)
SELECT p_partkey, min(d) AS distance, arg_min(model, d) AS model FROM part LEFT JOIN c ON pk = p_partkey GROUP BY 1""")
def _(t):
    contacts = t.lineitem.select(C("l_partkey").alias("p_partkey"), C("l_suppkey").alias("model"), F.when(C("l_returnflag") != "A", C("l_extendedprice")).alias("distance"))
    return lookup.closest_model(t.part.select("p_partkey", "p_brand"), contacts, ["p_partkey"], "distance", ["p_partkey"]).select("p_partkey", "distance", F.when(C("distance").isNotNull(), C("model")).alias("model"))


@query("j15_optional_left_merge", """
SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def _(t):
    base = t.orders.select("o_orderkey", C("o_custkey").alias("k"), "o_totalprice")
    other = t.customer.where("c_acctbal > 0").select(C("c_custkey").alias("k"), "c_name", "c_acctbal", F.lit(0.0).alias("o_totalprice"))
    out = lookup.optional_left_merge(lookup.optional_left_merge(base, other, ["k"]), None, ["k"])
    return out.withColumnRenamed("k", "o_custkey")


@query("j16_identity_key_join", """
WITH a AS (SELECT pair_id, ann_id, dar_gene, contact_gene, fisher_p FROM prx_tested), b AS (SELECT pair_id, ann_id, dar_gene, contact_gene, timing FROM prx_tested WHERE timing IS NOT NULL)
SELECT pair_id, fisher_p, timing FROM a JOIN b USING (pair_id, ann_id, dar_gene, contact_gene)""")
def _(t):
    key = ["pair_id", "ann_id", "dar_gene", "contact_gene"]
    return lookup.identity_key_join(t.tested.select(*key, "fisher_p"), t.tested.where("timing is not null").select(*key, "timing"), key).select("pair_id", "fisher_p", "timing")


@query("j17_semi_filter", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def _(t):
    keep = t.orders.where("o_orderstatus = 'F'").select(C("o_orderkey").alias("l_orderkey"))
    return lookup.semi_filter(t.lineitem, keep, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("j18_anti_update", """
WITH n AS (SELECT o_orderkey, o_totalprice + 1 AS v FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, o_totalprice AS v, 'old' AS origin FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT o_orderkey, v, 'new' FROM n""")
def _(t):
    old = t.orders.select("o_orderkey", C("o_totalprice").alias("v"), F.lit("old").alias("origin"))
    new = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", (C("o_totalprice") + 1).alias("v"), F.lit("new").alias("origin"))
    return lookup.anti_update(old, new, ["o_orderkey"])


@query("j19_resume_todo", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return lookup.resume_todo(t.customer.select("c_custkey"), t.orders.select(C("o_custkey").alias("c_custkey")), "c_custkey")


@query("j20_taxid_match", """
WITH a AS (SELECT c_custkey % 1200 AS taxid, min(c_name) AS species_a FROM customer GROUP BY 1), b AS (SELECT o_custkey + 300 AS taxid, min(CASE WHEN o_custkey % 2 = 0 THEN c_name ELSE 'other' END) AS species_b FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 300 WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT COALESCE(a.taxid, b.taxid) AS taxid, species_a, species_b, CASE WHEN species_a IS NULL THEN 'only_b' WHEN species_b IS NULL THEN 'only_a' WHEN species_a = species_b THEN 'exact' ELSE 'taxid_only' END AS match_type FROM a FULL JOIN b ON a.taxid = b.taxid""")
def _(t):
    a = t.customer.select((C("c_custkey") % 1200).alias("taxid"), C("c_name").alias("species_a"))
    o = t.orders.where("o_orderstatus = 'F'").select((C("o_custkey") + 300).alias("taxid"), "o_custkey")
    b = o.join(t.customer.select(C("c_custkey").alias("taxid"), "c_name"), "taxid", "left").select("taxid", F.when(C("o_custkey") % 2 == 0, C("c_name")).otherwise("other").alias("species_b"))
    return lookup.taxid_match(a, b)


@query("j23_chain_gene_resolution", """
WITH s AS (SELECT o_orderkey AS k, n_name AS gene, 0 AS r, 0.0::DOUBLE AS sc FROM orders JOIN nation ON n_nationkey = o_custkey % 60
 UNION ALL SELECT o_orderkey, 'OV_' || o_orderpriority, 1, 0.0 FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT l_orderkey, 'L' || l_suppkey, 2, l_discount * 10 FROM lineitem WHERE l_discount * 10 > 0.30),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, sc DESC, gene) AS rn FROM s) SELECT k, gene, r AS source_rank FROM x WHERE rn = 1""")
def _(t):
    local = t.orders.join(t.nation, C("n_nationkey") == C("o_custkey") % 60).select(C("o_orderkey").alias("k"), C("n_name").alias("gene"))
    over = t.orders.where("o_orderstatus = 'F'").select(C("o_orderkey").alias("k"), F.concat(F.lit("OV_"), "o_orderpriority").alias("gene"))
    scored = t.lineitem.select(C("l_orderkey").alias("k"), F.concat(F.lit("L"), C("l_suppkey").cast("string")).alias("gene"), (C("l_discount") * 10).alias("sc"))
    return lookup.chain_gene_resolution([(local, None), (over, None), (scored, C("sc"))], ["k"])


@query("j24_proxy_fallback", """
WITH tb AS (SELECT p_brand AS gene, max(p_retailprice) AS v FROM part WHERE p_size > 48 GROUP BY 1), px AS (SELECT 'Brand#' || n_nationkey AS gene, 'Brand#' || (n_nationkey % 5) AS proxy FROM nation)
SELECT p_partkey, COALESCE(a.v, b.v) AS v, a.v IS NULL AND b.v IS NOT NULL AS used_proxy FROM part LEFT JOIN tb a ON a.gene = p_brand LEFT JOIN px ON px.gene = p_brand LEFT JOIN tb b ON b.gene = px.proxy""")
def _(t):
    table = t.part.where("p_size > 48").groupBy(C("p_brand").alias("gene")).agg(F.max("p_retailprice").alias("v"))
    k = C("n_nationkey")
    px = t.nation.select(F.concat(F.lit("Brand#"), k.cast("string")).alias("gene"), F.concat(F.lit("Brand#"), (k % 5).cast("string")).alias("proxy"))
    return lookup.proxy_fallback(t.part.select("p_partkey", "p_brand"), table, px, "p_brand", "v").select("p_partkey", "v", "used_proxy")


MODEL_SQL = """ml AS (SELECT l_orderkey AS vid, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 'primary' ELSE 'secondary' END AS role, l_quantity > 20 AS mapped, l_returnflag = 'A' AS rescue, l_linestatus AS lab FROM lineitem),
ms AS (SELECT *, CASE WHEN role <> 'primary' AND vid NOT IN (SELECT vid FROM ml WHERE role = 'primary' AND mapped) THEN 'secondary_not_attempted_no_primary_support' WHEN mapped THEN 'ok' ELSE 'position_not_anchored' END AS model_status FROM ml)"""


def _models(t):
    src = t.lineitem.select(C("l_orderkey").alias("vid"), "l_partkey", "l_suppkey", "l_linenumber", F.when(C("l_linenumber") <= 2, "primary").otherwise("secondary").alias("role"),
                            (C("l_quantity") > 20).alias("mapped"), (C("l_returnflag") == "A").alias("rescue"), C("l_linestatus").alias("lab"))
    return lookup.model_priority_loop(src, ["vid"], "role", C("mapped"))


@query("j25_model_priority_loop", f"WITH {MODEL_SQL} SELECT vid, l_partkey, l_suppkey, l_linenumber, model_status FROM ms")
def _(t):
    return _models(t).select("vid", "l_partkey", "l_suppkey", "l_linenumber", "model_status")


@query("j26_pair_column_join", f"""
WITH {ASKED_SQL}, p AS (SELECT DISTINCT gene, i, j FROM ask) SELECT p.gene, i, j, substr(seq, CAST(i + 1 AS INT), 1) AS a, substr(seq, CAST(j + 1 AS INT), 1) AS b, count(*) AS n FROM prx_aln s JOIN p ON p.gene = s.gene AND j < length(seq) GROUP BY ALL""")
def _(t):
    from ..operators.alignment import pair_columns

    return pair_columns(t.aln, asked(t))
