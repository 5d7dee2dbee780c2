"""G, J21, J22 and T14: trees as edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree as g
from ..session import cut_lineage
from .registry import query

C = F.col
SELF_SQL = """cs AS (SELECT * FROM prx_closure UNION ALL SELECT DISTINCT 'geo', child, child, 0 FROM prx_edge UNION ALL SELECT 'geo', 'ROOT', 'ROOT', 0)"""
ROOTS_SQL = "rs AS (SELECT 'geo' AS tree, pos, aa FROM prx_state WHERE node = 'ROOT')"


def clo(t):
    return g.closure(t.edge)


def clo_self(t):
    return g.with_self(clo(t), t.edge)


def states(t):
    return t.state.withColumn("tree", F.lit("geo")).where("aa <> '-'")


def changes(t):
    return g.branch_changes(states(t), t.edge)


def root_states(t):
    return states(t).where("node = 'ROOT'").select("tree", "pos", "aa")


def observed(t):
    return states(t).where(C("node").startswith("O"))


@query("g01_parent_map", """
SELECT 'leaf' AS kind, child AS node FROM prx_edge WHERE child NOT IN (SELECT parent FROM prx_edge) UNION ALL SELECT DISTINCT 'root', parent FROM prx_edge WHERE parent NOT IN (SELECT child FROM prx_edge)""")
def _(t):
    return g.leaves(t.edge).select(F.lit("leaf").alias("kind"), C("leaf").alias("node")).unionByName(g.roots(t.edge).select(F.lit("root").alias("kind"), C("root").alias("node")))


@query("g02_closure", "SELECT ancestor, node, depth FROM prx_closure")
def _(t):
    return clo(t).select("ancestor", "node", "depth")


LEAF_SQL = "lf AS (SELECT ancestor AS node, node AS leaf FROM cs WHERE node NOT IN (SELECT parent FROM prx_edge))"


@query("g03_descendant_leaves", f"WITH {SELF_SQL}, {LEAF_SQL} SELECT node, leaf FROM lf")
def _(t):
    return g.descendant_leaves(clo(t), t.edge).select("node", "leaf")


@query("g04_branch_changes", "SELECT parent, child, pos, aa_from, aa_to FROM prx_change")
def _(t):
    return changes(t).drop("tree")


@query("g05_harmonize_sites", """
WITH m AS (SELECT gene, col + 1 AS site, row_number() OVER (PARTITION BY gene ORDER BY col) AS pos FROM prx_cell WHERE is_ref AND ch NOT IN ('-', 'X', '*')), s AS (SELECT gene, col + 1 AS site FROM prx_cell)
SELECT s.gene, CAST(count(m.pos) AS BIGINT) AS rows_kept, count(*) - count(m.pos) AS rows_dropped, count(DISTINCT CASE WHEN m.pos IS NULL THEN s.site END) AS sites_dropped FROM s LEFT JOIN m USING (gene, site) GROUP BY 1""")
def _(t):
    from ..operators.alignment import explode_alignment, position_map, reference_row

    st = explode_alignment(t.aln).select("gene", (C("col") + 1).alias("site"), "species", "ch")
    return g.harmonize_sites(st, position_map(reference_row(t.aln), "-X*"))[1]


@query("g06_leaf_states", """
WITH m AS (SELECT gene, col, row_number() OVER (PARTITION BY gene ORDER BY col) AS pos FROM prx_cell WHERE is_ref AND ch NOT IN ('-', 'X', '*'))
SELECT gene, pos, c.ch AS aa, count(*) AS n FROM prx_cell c JOIN m USING (gene, col) WHERE c.ch NOT IN ('-', 'X', '*') GROUP BY 1, 2, 3""")
def _(t):
    from ..operators.alignment import explode_alignment, position_map, reference_row

    return g.leaf_states(explode_alignment(t.aln), position_map(reference_row(t.aln), "-X*")).groupBy("gene", "pos", "aa").agg(F.count("*").alias("n"))


NEAR_SQL = "nc AS (SELECT cs.node, c.pos, arg_min(c.aa_to, cs.depth) AS changed FROM cs JOIN prx_change c ON c.child = cs.ancestor GROUP BY 1, 2)"
PROP_SQL = f"{SELF_SQL}, {ROOTS_SQL}, {NEAR_SQL}, nd AS (SELECT node FROM cs WHERE depth = 0), pa AS (SELECT node, rs.pos, COALESCE(changed, rs.aa) AS aa FROM nd CROSS JOIN rs LEFT JOIN nc USING (node, pos))"


@query("g07_propagate_changes", f"WITH {PROP_SQL} SELECT node, pos, aa FROM pa")
def _(t):
    return g.propagate_changes(cut_lineage(clo_self(t)), root_states(t), changes(t)).drop("tree")


@query("g07b_propagate_observed", f"""
WITH {SELF_SQL}, {ROOTS_SQL}, ic AS (SELECT * FROM prx_change WHERE child NOT LIKE 'O%'), nc AS (SELECT cs.node, c.pos, arg_min(c.aa_to, cs.depth) AS changed FROM cs JOIN ic c ON c.child = cs.ancestor GROUP BY 1, 2),
nd AS (SELECT node FROM cs WHERE depth = 0), ps AS (SELECT unnest([1, 2, 3]) AS pos), ob AS (SELECT node, pos, aa FROM prx_state WHERE node LIKE 'O%' AND node <> 'ROOT' AND aa <> '-')
SELECT nd.node, ps.pos, CASE WHEN nd.node NOT IN (SELECT parent FROM prx_edge) THEN COALESCE(ob.aa, changed, rs.aa) ELSE COALESCE(changed, rs.aa) END AS aa FROM nd CROSS JOIN ps LEFT JOIN rs USING (pos) LEFT JOIN nc ON nc.node = nd.node AND nc.pos = ps.pos LEFT JOIN ob ON ob.node = nd.node AND ob.pos = ps.pos""")
def _(t):
    # Position 3 has no root state anywhere: it stays null.
    asked = root_states(t).select("tree", "pos").unionByName(root_states(t).where("pos = 1").select("tree", F.lit(3).alias("pos")))
    return g.propagate_observed(cut_lineage(clo_self(t)), t.edge, asked, root_states(t), changes(t), observed(t)).drop("tree")


@query("g07c_propagate_tiers", f"""
WITH {SELF_SQL}, {ROOTS_SQL}, lo AS (SELECT * FROM prx_change WHERE pos = 2 AND child LIKE 'C%'), lb AS (SELECT DISTINCT parent, child FROM lo),
ch AS (SELECT c.* FROM prx_change c WHERE NOT EXISTS (SELECT 1 FROM lb WHERE lb.parent = c.parent AND lb.child = c.child) UNION ALL SELECT * FROM lo),
nc AS (SELECT cs.node, c.pos, arg_min(c.aa_to, cs.depth) AS changed FROM cs JOIN ch c ON c.child = cs.ancestor GROUP BY 1, 2), nd AS (SELECT node FROM cs WHERE depth = 0),
lw AS (SELECT DISTINCT cs.node FROM cs JOIN lb ON lb.child = cs.ancestor) SELECT node, rs.pos, COALESCE(changed, rs.aa, '-') AS aa, node IN (SELECT node FROM lw) AS is_low FROM nd CROSS JOIN rs LEFT JOIN nc USING (node, pos)""")
def _(t):
    ch = cut_lineage(changes(t))
    low = ch.where((C("pos") == 2) & C("child").startswith("C"))
    return g.propagate_tiers(cut_lineage(clo_self(t)), root_states(t).select("tree", "pos"), root_states(t), ch, low).drop("tree")


ALT_SQL = "aq AS (SELECT 1 AS pos, 'C' AS alt UNION ALL SELECT 1, 'D' UNION ALL SELECT 2, 'C')"


def alts(t):
    rows = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(a).alias("alt")) for p, a in ((1, "C"), (1, "D"), (2, "C"))])
    return root_states(t).select("tree").distinct().select("tree", F.inline(rows))


@query("g08_gains_losses", f"""
WITH {ALT_SQL} SELECT 'gain' AS kind, c.pos, alt, parent, child FROM prx_change c JOIN aq ON aq.pos = c.pos AND aa_to = alt UNION ALL SELECT 'loss', c.pos, alt, parent, child FROM prx_change c JOIN aq ON aq.pos = c.pos AND aa_from = alt""")
def _(t):
    ch = changes(t)
    return g.gains(ch, alts(t)).withColumn("kind", F.lit("gain")).unionByName(g.losses(ch, alts(t)).withColumn("kind", F.lit("loss"))).drop("tree")


@query("g08b_gains_with_leaves", f"""
WITH {PROP_SQL}, {ALT_SQL}, ic AS (SELECT * FROM prx_change WHERE child NOT LIKE 'O%') SELECT c.pos, alt, parent, child FROM ic c JOIN aq ON aq.pos = c.pos AND aa_to = alt
UNION SELECT s.pos, alt, e.parent, e.child FROM prx_state s JOIN aq ON aq.pos = s.pos AND s.aa = alt JOIN prx_edge e ON e.child = s.node AND s.node LIKE 'O%' JOIN pa ON pa.node = e.parent AND pa.pos = s.pos WHERE pa.aa <> alt""")
def _(t):
    inner = changes(t).where(~C("child").startswith("O"))
    st = cut_lineage(g.propagate_changes(clo_self(t), root_states(t), inner))
    return g.gains_with_leaves(inner, alts(t), t.edge, observed(t), st).drop("tree")


@query("g09_ancestral_call", f"""
WITH aq AS (SELECT unnest([1, 1, 2, 4]) AS pos, unnest(['A', 'D', 'C', 'C']) AS alt), v AS (SELECT aq.pos, aq.alt, avg(CASE WHEN s.aa = alt THEN 1.0 ELSE 0.0 END) AS sh FROM aq JOIN prx_state s ON s.pos = aq.pos AND s.node LIKE 'O%' AND s.node <> 'ROOT' AND s.aa <> '-' GROUP BY 1, 2), r AS (SELECT pos, aa FROM prx_state WHERE node = 'ROOT' AND pos = 1)
SELECT aq.pos, aq.alt, CASE WHEN r.aa IS NOT NULL THEN r.aa = aq.alt ELSE COALESCE(sh >= 0.5, false) END AS is_ancestral, CASE WHEN r.aa IS NOT NULL THEN 'root_state' WHEN sh IS NOT NULL THEN 'leaf_majority' ELSE 'no_data' END AS method FROM aq LEFT JOIN v USING (pos, alt) LEFT JOIN r USING (pos)""")
def _(t):
    rows = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(a).alias("alt")) for p, a in ((1, "A"), (1, "D"), (2, "C"), (4, "C"))])
    asked = root_states(t).select("tree").distinct().select("tree", F.inline(rows))
    return g.ancestral_call(asked, root_states(t).where("pos = 1"), observed(t)).drop("tree")


CLO2_SQL = """c2 AS (SELECT parent AS ancestor, child AS node FROM prx_edge2 UNION ALL SELECT a.parent, b.child FROM prx_edge2 a JOIN prx_edge2 b ON b.parent = a.child UNION ALL SELECT a.parent, c.child FROM prx_edge2 a JOIN prx_edge2 b ON b.parent = a.child JOIN prx_edge2 c ON c.parent = b.child),
l2 AS (SELECT ancestor AS node, node AS leaf FROM c2 WHERE node LIKE 'O%' UNION ALL SELECT child, child FROM prx_edge2 WHERE child LIKE 'O%'), l1 AS (SELECT node, leaf FROM lf WHERE leaf LIKE 'O%')"""
MATCH_SQL = f"""{SELF_SQL}, {LEAF_SQL}, {CLO2_SQL}, n1 AS (SELECT node, count(*) AS n FROM l1 GROUP BY 1), n2 AS (SELECT node, count(*) AS n FROM l2 GROUP BY 1),
sh AS (SELECT a.node AS node_a, b.node AS node_b, count(*) AS shared FROM l1 a JOIN l2 b USING (leaf) GROUP BY 1, 2), sc AS (SELECT sh.*, n1.n AS size_a, n2.n AS size_b, shared::DOUBLE / (n1.n + n2.n - shared) AS jac FROM sh JOIN n1 ON n1.node = node_a JOIN n2 ON n2.node = node_b)"""


def leafsets(t):
    a = g.descendant_leaves(clo(t), t.edge).where(C("leaf").startswith("O"))
    b = g.descendant_leaves(g.closure(t.edge2), t.edge2)
    return cut_lineage(a), cut_lineage(b)


@query("j21_node_match_jaccard", f"""
WITH {MATCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY node_a ORDER BY jac DESC, node_b) AS rn FROM sc WHERE shared >= 2) SELECT node_a, node_b, shared, round(jac, 6) AS jaccard, size_a, size_b FROM r WHERE rn = 1""")
def _(t):
    return g.node_match_jaccard(*leafsets(t)).withColumn("jaccard", F.round("jaccard", 6))


@query("j22_clade_overlap", f"WITH {MATCH_SQL} SELECT n1.node AS node_a, COALESCE(bool_or(shared::DOUBLE / greatest(size_a, size_b) > 0.8), false) AS matched FROM n1 LEFT JOIN sc ON node_a = n1.node GROUP BY 1")
def _(t):
    return g.clade_overlap(*leafsets(t))


@query("g10_timing_matched", f"""
WITH {MATCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY node_a ORDER BY jac DESC, node_b) AS rn FROM sc WHERE shared >= 2), m AS (SELECT node_a AS origin, node_b AS node, size_a FROM r WHERE rn = 1),
b2 AS (SELECT node, substr('ACD', CAST(1 + ascii(right(node, 1)) % 3 AS INT), 1) AS aa FROM (SELECT 'TOP' AS node UNION ALL SELECT child FROM prx_edge2)), ch2 AS (SELECT e.child, c.aa AS aa_to FROM prx_edge2 e JOIN b2 p ON p.node = e.parent JOIN b2 c ON c.node = e.child WHERE p.aa <> c.aa),
aq AS (SELECT unnest(['A', 'C', 'D']) AS alt), o AS (SELECT n1.node AS origin, alt FROM n1 CROSS JOIN aq WHERE n1.node NOT LIKE 'O%'),
af AS (SELECT DISTINCT node_a AS origin, aa_to AS alt FROM sc JOIN ch2 ON ch2.child = node_b WHERE shared = size_b AND size_b < size_a)
SELECT o.origin, o.alt AS contact_alt, CASE WHEN pb.aa = o.alt THEN 'contact_first' WHEN pb.aa <> o.alt AND cb.aa = o.alt THEN 'co_occurring' WHEN af.origin IS NOT NULL AND m.origin IS NOT NULL THEN 'contact_after' ELSE 'no_contact_change' END AS timing
FROM o LEFT JOIN m ON m.origin = o.origin LEFT JOIN prx_edge2 e ON e.child = m.node LEFT JOIN b2 cb ON cb.node = m.node LEFT JOIN b2 pb ON pb.node = e.parent LEFT JOIN af ON af.origin = o.origin AND af.alt = o.alt""")
def _(t):
    a, b = leafsets(t)
    nodes = g.roots(t.edge2).select("tree", C("root").alias("node")).unionByName(t.edge2.select("tree", C("child").alias("node")))
    last = F.ascii(F.substring("node", -1, 1))
    st = nodes.select("tree", "node", F.lit(1).alias("pos"), F.substring(F.lit("ACD"), (last % 3 + 1).cast("int"), F.lit(1)).alias("aa"))
    na = a.groupBy("node").agg(F.count("*").alias("n"))
    nb = b.groupBy("node").agg(F.count("*").alias("n"))
    shared = a.select(C("node").alias("node_a"), "leaf").join(b.select(C("node").alias("node_b"), "leaf"), "leaf").groupBy("node_a", "node_b").agg(F.count("*").alias("shared"))
    shared = shared.join(na.select(C("node").alias("node_a"), C("n").alias("size_a")), "node_a")
    asked = F.array(*[F.lit(x) for x in "ACD"])
    origins = na.where(~C("node").startswith("O")).select(C("node").alias("origin"), F.lit(1).alias("contact_pos"), F.explode(asked).alias("contact_alt"))
    out = g.timing_matched(origins, g.node_match_jaccard(a, b), t.edge2, st, g.branch_changes(st, t.edge2), shared, nb)
    return out.select("origin", "contact_alt", "timing")


TIMING_SQL = f"""{PROP_SQL}, {ALT_SQL}, gb AS (SELECT c.parent, c.child, c.pos, alt FROM prx_change c JOIN aq ON aq.pos = c.pos AND aa_to = alt), ct AS (SELECT gb.*, 3 - gb.pos AS cpos, CASE WHEN gb.pos = 2 THEN 'D' ELSE 'C' END AS calt FROM gb),
be AS (SELECT DISTINCT cs.ancestor AS child, pa.pos, pa.aa FROM cs JOIN pa ON pa.node = cs.node WHERE cs.depth > 0),
tm AS (SELECT ct.*, p.aa AS parent_aa, CASE WHEN p.aa = calt THEN 'contact_first' WHEN k.aa = calt THEN 'co_occurring' WHEN EXISTS (SELECT 1 FROM be WHERE be.child = ct.child AND be.pos = ct.cpos AND be.aa = ct.calt) THEN 'contact_after' ELSE 'no_contact_change' END AS timing
FROM ct JOIN pa p ON p.node = ct.parent AND p.pos = ct.cpos JOIN pa k ON k.node = ct.child AND k.pos = ct.cpos)"""


def branch_timing(t):
    cs, ch = cut_lineage(clo_self(t)), cut_lineage(changes(t))
    st = cut_lineage(g.propagate_changes(cs, root_states(t), ch))
    br = g.gains(ch, alts(t)).withColumns({"contact_pos": 3 - C("pos"), "contact_alt": F.when(C("pos") == 2, "D").otherwise("C")})
    return g.timing_same_labels(br, st, cs)


@query("g11_timing_same_labels", f"WITH {TIMING_SQL} SELECT pos, alt, parent, child, parent_aa, timing FROM tm")
def _(t):
    return branch_timing(t).select("pos", "alt", "parent", "child", "parent_aa", "timing")


@query("g12_pair_timing", f"""
WITH {TIMING_SQL}, n AS (SELECT pos, alt, count(*) FILTER (timing = 'contact_first') AS f, count(*) FILTER (timing = 'co_occurring') AS c, count(*) FILTER (timing = 'contact_after') AS a, count(*) FILTER (timing = 'no_contact_change') AS z FROM tm GROUP BY 1, 2)
SELECT pos, alt, f AS n_contact_first, c AS n_co_occurring, a AS n_contact_after, z AS n_no_contact_change, CASE greatest(f, c, a, z) WHEN f THEN 'contact_first' WHEN c THEN 'co_occurring' WHEN a THEN 'contact_after' ELSE 'no_contact_change' END AS dominant_timing,
 CASE WHEN pos = 1 AND alt = 'A' THEN 'ancestral_cdav_not_directional' WHEN f + c + a = 0 THEN 'no_detected_partner_change' WHEN f > 0 AND c + a = 0 THEN 'permissive_background' WHEN a > 0 AND f + c = 0 THEN 'responding_secondary' WHEN c > 0 AND f + a = 0 THEN 'co_occurring_unresolved' ELSE 'mixed_timing' END AS direction FROM n""")
def _(t):
    from ..functions.rules import directional_class

    n = g.timing_counts(branch_timing(t), ["tree", "pos", "alt"]).join(g.ancestral_call(alts(t), root_states(t), observed(t)), ["tree", "pos", "alt"])
    d = directional_class("is_ancestral", "n_contact_first", "n_co_occurring", "n_contact_after", "n_no_contact_change")
    return n.select("pos", "alt", *[f"n_{k}" for k in g.TIMINGS], "dominant_timing", d.alias("direction"))


@query("g13_contact_state_in_carriers", """
WITH c AS (SELECT DISTINCT o_custkey AS pair, 'O' || o_orderkey AS sp FROM orders WHERE o_orderpriority <> '5-LOW'), j AS (SELECT pair, s.aa FROM c JOIN prx_state s ON s.node = sp AND s.pos = 2 AND s.aa <> '-'), n AS (SELECT pair, count(*) AS k, count(*) FILTER (aa = 'A') AS h, count(*) FILTER (aa = 'C') AS a FROM j GROUP BY 1)
SELECT c_custkey AS pair, CASE WHEN COALESCE(k, 0) = 0 THEN 'unknown' WHEN h = k THEN 'conserved_human' WHEN a = k THEN 'conserved_alt' ELSE 'polymorphic' END AS contact_state FROM customer LEFT JOIN n ON pair = c_custkey""")
def _(t):
    pairs = t.customer.select(C("c_custkey").alias("pair"), F.lit(2).alias("contact_pos"), F.lit("A").alias("human_aa"), F.lit("C").alias("alt_aa"))
    car = t.orders.where("o_orderpriority <> '5-LOW'").select(C("o_custkey").alias("pair"), F.concat(F.lit("O"), C("o_orderkey").cast("string")).alias("species"))
    return g.contact_state_in_carriers(pairs, car, observed(t).select(C("node").alias("species"), "pos", "aa"))


@query("g14_mrca_age", """
WITH o AS (SELECT o_orderpriority || o_custkey % 50 AS set_id, o_orderkey, o_custkey, c_nationkey, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'),
a AS (SELECT set_id, count(*) AS n, count(DISTINCT o_custkey) AS c, count(DISTINCT c_nationkey) AS k, count(DISTINCT n_regionkey) AS r FROM o GROUP BY 1)
SELECT set_id, n AS n_present, CASE WHEN n = 1 THEN 0.0 WHEN c = 1 THEN 1.5 WHEN k = 1 THEN 3.0 WHEN r = 1 THEN 4.5 ELSE 6.0 END::DOUBLE AS age FROM a""")
def _(t):
    edges = t.edge.withColumn("branch_length", F.lit(1.5))
    cs = g.with_self(g.closure(edges), edges)
    sets = t.orders.where("o_orderstatus = 'F'").select(F.lit("geo").alias("tree"), F.concat("o_orderpriority", (C("o_custkey") % 50).cast("string")).alias("set_id"),
                                                       F.concat(F.lit("O"), C("o_orderkey").cast("string")).alias("species"))
    return g.mrca_age(sets, cs, g.root_distance(cs, edges), g.leaves(edges)).drop("tree")


@query("g15_prune_tree", f"""
WITH {SELF_SQL}, k AS (SELECT 'O' || o_orderkey AS leaf FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'), al AS (SELECT DISTINCT cs.ancestor AS node FROM cs JOIN k ON k.leaf = cs.node), f AS (SELECT parent AS node FROM prx_edge WHERE child IN (SELECT node FROM al) GROUP BY 1 HAVING count(*) >= 2),
st AS (SELECT node FROM f UNION SELECT leaf FROM k) SELECT arg_min(cs.ancestor, cs.depth) AS parent, cs.node AS child FROM cs WHERE depth > 0 AND cs.node IN (SELECT node FROM st) AND cs.ancestor IN (SELECT node FROM st) GROUP BY 2""")
def _(t):
    keep = t.orders.where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.lit("geo").alias("tree"), F.concat(F.lit("O"), C("o_orderkey").cast("string")).alias("leaf"))
    return g.prune_tree(clo(t), t.edge, keep).drop("tree")


@query("g16_asr_audit", """
SELECT (SELECT count(DISTINCT node) FROM prx_state WHERE aa <> '-') AS n_nodes, (SELECT count(*) FROM prx_edge WHERE child NOT IN (SELECT parent FROM prx_edge)) AS n_leaves, (SELECT count(DISTINCT parent || '|' || child) FROM prx_change) AS n_changed_branches, (SELECT count(*) FROM prx_change) AS n_changes""")
def _(t):
    return g.asr_audit(states(t), t.edge, changes(t)).drop("tree")


@query("g17_tier_pairs", """
WITH r AS (SELECT ann_id, arg_min(timing, pair_id) AS refined FROM prx_tested GROUP BY 1), j AS (SELECT t.pair_id, t.pagel_fdr, t.contact_type, t.fisher_p, COALESCE(refined IN ('contact_first', 'co_occurring'), false) AS mild FROM prx_tested t LEFT JOIN r USING (ann_id))
SELECT pair_id, CASE WHEN mild THEN '1A' ELSE '1B' END AS tier FROM j WHERE pagel_fdr <= 0.1 UNION ALL SELECT pair_id, '1C' FROM j WHERE contact_type = 'mt-nuc' AND fisher_p < 0.05 AND mild""")
def _(t):
    timing = t.tested.where("timing is not null").groupBy("ann_id").agg(F.min_by("timing", "pair_id").alias("refined"))
    pairs = t.tested.select("pair_id", "ann_id", "pagel_fdr", "contact_type", C("fisher_p").alias("perm_p"))
    return g.tier_pairs(pairs, timing, ["ann_id"], ("contact_first", "co_occurring")).select("pair_id", "tier")


@query("g18_direction_assignment", """
WITH i AS (SELECT ann_id, min(contact_gene) AS human_aa FROM prx_tested WHERE status = 'F' GROUP BY 1) SELECT pair_id, human_aa, CASE WHEN a_mt THEN 'mt-dar' ELSE 'nuc-dar' END AS direction FROM prx_tested LEFT JOIN i USING (ann_id) WHERE fisher_p < 0.05 AND contact_type = 'mt-nuc'""")
def _(t):
    info = t.tested.where("status = 'F'").select("ann_id", C("contact_gene").alias("human_aa"))
    pairs = t.tested.select("pair_id", "ann_id", "contact_type", "a_mt", C("fisher_p").alias("perm_p"))
    return g.direction_assignment(pairs, info, ["ann_id"], C("a_mt")).select("pair_id", "human_aa", "direction")


@query("t14_branch_cooccurrence", f"""
WITH {MATCH_SQL}, m1 AS (SELECT n1.node, COALESCE(bool_or(shared::DOUBLE / greatest(size_a, size_b) > 0.3), false) AS k FROM n1 LEFT JOIN sc ON node_a = n1.node GROUP BY 1), m2 AS (SELECT n2.node, COALESCE(bool_or(shared::DOUBLE / greatest(size_a, size_b) > 0.3), false) AS k FROM n2 LEFT JOIN sc ON node_b = n2.node GROUP BY 1),
x AS (SELECT count(*) FILTER (k) AS a, count(*) FILTER (NOT k) AS c FROM m1 WHERE node NOT LIKE 'O%'), y AS (SELECT count(*) FILTER (NOT k) AS b FROM m2 WHERE node NOT LIKE 'O%') SELECT a, b, c, c AS d, a + c AS n_origins FROM x, y""")
def _(t):
    from ..operators.inference import branch_cooccurrence

    a, b = leafsets(t)
    ma = g.clade_overlap(a, b, 0.3).where(~C("node_a").startswith("O")).withColumn("pair", F.lit(1))
    mb = g.clade_overlap(b, a, 0.3).where(~C("node_a").startswith("O")).withColumn("pair", F.lit(1))
    return branch_cooccurrence(ma, mb, ["pair"]).select("a", "b", "c", "d", (C("a") + C("c")).alias("n_origins"))
