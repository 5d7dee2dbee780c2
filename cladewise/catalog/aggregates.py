"""A: counts, rates, audits, linkage and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as s
from .registry import query
from .scalars import BEST_SQL, MEFF_BINS, ORIGIN_BINS, REASON_SQL, SIG_SQL
from .statistics import STRATA_SQL, TERM, mw_sql, strata

C = F.col
R6 = lambda c: F.round(c, 6).alias(c)

CLASSIFIED_SQL = """cv AS (SELECT *, CASE WHEN status = 'P' THEN 'unresolved' WHEN line <= 2 THEN 'skipped_by_policy' ELSE 'classified' END AS cs, pkey % 3 = 0 AS aa, pkey % 6 = 0 AS nt,
 CASE WHEN status <> 'P' AND line > 2 THEN CASE WHEN line = 7 THEN 'classified_warning' ELSE 'classified_clean' END END AS subset FROM prx_variant)"""


def _classified(t):
    st = F.when(C("status") == "P", "unresolved").when(C("line") <= 2, "skipped_by_policy").otherwise("classified")
    return t.variant.withColumns({"cs": st, "aa": C("pkey") % 3 == 0, "nt": C("pkey") % 6 == 0}).withColumn(
        "subset", F.when(C("cs") == "classified", F.when(C("line") == 7, "classified_warning").otherwise("classified_clean")))


@query("a01_status_summary", f"""
WITH {CLASSIFIED_SQL} SELECT genome, count(*) AS rows_total, count(*) FILTER (cs = 'classified') AS classified, count(*) FILTER (cs = 'unresolved') AS unresolved, count(*) FILTER (cs = 'skipped_by_policy') AS skipped,
 count(*) FILTER (cs = 'classified' AND aa) AS aa_cdav, count(*) FILTER (cs = 'classified' AND NOT aa) AS aa_udav, count(*) FILTER (cs = 'classified' AND nt) AS nt_cdav, count(*) FILTER (cs = 'classified' AND NOT nt) AS nt_udav FROM cv GROUP BY 1""")
def _(t):
    return s.status_summary(_classified(t), "genome", "cs", "aa", "nt")


LINK_SQL = """k AS (SELECT *, CASE WHEN genome = 'mtDNA' THEN gene || '|' || pos || '|' || ref || '|' || alt END AS mk FROM prx_variant),
lg AS (SELECT mk, string_agg(DISTINCT source_db, ',' ORDER BY source_db) AS sources, count(*) AS n_rows, count(DISTINCT vid) AS n_ids, count(DISTINCT source_db) AS n_sources, count(DISTINCT source_db) = 2 AS is_shared FROM k WHERE mk IS NOT NULL GROUP BY 1),
ls AS (SELECT vid, okey, source_db, CASE WHEN mk IS NULL THEN 'not_applicable' WHEN is_shared THEN 'shared' ELSE source_db || '_only' END AS duplicate_status, COALESCE(n_ids, 0) AS partner_count FROM k LEFT JOIN lg USING (mk))"""


def _linked(t):
    from ..functions.rules import encoded_by, match_key

    v = t.variant.withColumn("mk", match_key(encoded_by("gene"), "gene", "pos", "ref", "alt"))
    return v, s.link_duplicates(v, "mk", "source_db", "vid", ["clin", "mito"])


@query("a02_link_duplicates", f"WITH {LINK_SQL} SELECT * FROM lg")
def _(t):
    return _linked(t)[1]


@query("a02b_duplicate_status", f"WITH {LINK_SQL} SELECT vid, duplicate_status, partner_count FROM ls")
def _(t):
    v, g = _linked(t)
    return s.duplicate_status(v, g, "mk", "source_db").select("vid", "duplicate_status", "partner_count")


@query("a03_overlap_summary", f"""
WITH {LINK_SQL} SELECT count(*) AS rows_total, count(DISTINCT okey) AS ids_total, count(*) FILTER (duplicate_status = 'shared') AS rows_present, count(DISTINCT okey) FILTER (duplicate_status = 'shared') AS ids_present,
 count(*) FILTER (duplicate_status LIKE '%_only') AS rows_absent, count(DISTINCT okey) FILTER (duplicate_status LIKE '%_only') AS ids_absent FROM ls""")
def _(t):
    v, g = _linked(t)
    return s.overlap_summary(s.duplicate_status(v, g, "mk", "source_db"), "okey", "duplicate_status")


DOM_SQL = """dn AS (SELECT o_custkey AS gene, o_orderpriority AS transcript, count(*) AS n FROM orders GROUP BY 1, 2), dm AS (SELECT gene, transcript FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, transcript DESC) AS r FROM dn) WHERE r = 1)"""


def _dominant(t):
    return s.dominant_value(t.orders.select(C("o_custkey").alias("gene"), C("o_orderpriority").alias("transcript")), "gene", "transcript")


@query("a04_dominant_value", f"WITH {DOM_SQL} SELECT * FROM dm")
def _(t):
    return _dominant(t)


@query("a05_preferred_transcript", f"""
WITH {DOM_SQL}, c AS (SELECT c_custkey AS gene, c_mktsegment AS transcript FROM customer WHERE c_acctbal > 5000)
SELECT c_custkey AS gene, COALESCE(c.transcript, dm.transcript) AS preferred, CASE WHEN c.transcript IS NOT NULL THEN 'curated_select' WHEN dm.transcript IS NOT NULL THEN 'dominant' ELSE 'no_preferred' END AS selection_rule
FROM customer LEFT JOIN c ON c.gene = c_custkey LEFT JOIN dm ON dm.gene = c_custkey""")
def _(t):
    curated = t.customer.where("c_acctbal > 5000").select(C("c_custkey").alias("gene"), C("c_mktsegment").alias("transcript"))
    return s.preferred_transcript(t.customer.select(C("c_custkey").alias("gene")), curated, _dominant(t))


@query("a06_qc_check", """
WITH c AS (SELECT 'price_positive' AS check_name, o_orderkey AS id FROM orders WHERE o_totalprice <= 0 UNION ALL SELECT 'status_known', o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'customer_present', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)),
n(check_name) AS (VALUES ('price_positive'), ('status_known'), ('customer_present')), r AS (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY id) AS rn FROM c)
SELECT n.check_name, CASE WHEN count(id) = 0 THEN 'pass' ELSE 'fail' END AS status, count(id) AS n_failed, COALESCE(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FILTER (rn <= 10), '') AS examples FROM n LEFT JOIN r ON r.check_name = n.check_name GROUP BY 1""")
def _(t):
    lost = t.orders.join(t.customer, C("o_custkey") == C("c_custkey"), "left_anti")
    checks = [s.qc_check("price_positive", t.orders, C("o_totalprice") <= 0, "o_orderkey"), s.qc_check("status_known", t.orders, C("o_orderstatus") == "P", "o_orderkey"),
              s.qc_check("customer_present", lost, F.lit(True), "o_orderkey")]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query("a07_exception_audit", f"""
WITH {CLASSIFIED_SQL}, x AS (SELECT CASE WHEN line <> 5 THEN brand END AS brand, cs FROM cv WHERE cs = 'unresolved' OR subset = 'classified_warning') SELECT brand, cs, count(*) AS n_rows FROM x GROUP BY 1, 2""")
def _(t):
    return s.exception_audit(_classified(t).withColumn("brand", F.when(C("line") != 5, C("brand"))), "cs", "subset", ["brand", "cs"])


KINDS = ["noncoding", "non_snv", "frameshift", "nonsense", "not_missense", "never_seen"]


@query("a08_mismatch_summary", f"""
WITH r AS (SELECT {REASON_SQL} AS kind FROM prx_variant), k AS (SELECT unnest(range(6)) AS nth, unnest({KINDS}) AS kind) SELECT nth, k.kind, count(r.kind) AS n FROM k LEFT JOIN r ON r.kind = k.kind GROUP BY 1, 2""")
def _(t):
    from .scalars import _reason

    return s.mismatch_summary(t.variant.select(_reason().alias("kind")), "kind", KINDS)


@query("a09_contact_universe", """
SELECT dar_gene, contact_gene, bool_or(is_ancestral) AS any_is_ancestral, count(DISTINCT timing) AS n_classes, string_agg(DISTINCT timing, ',' ORDER BY timing) AS classes, count(*) AS n_rows, arg_min(status, pair_id) AS status FROM prx_tested GROUP BY 1, 2""")
def _(t):
    return s.contact_universe(t.tested, ["dar_gene", "contact_gene"], "is_ancestral", "timing", "pair_id", ["status"])


@query("a10_best_per_pair", """
SELECT ann_id, min(pagel_fdr) AS min_pagel_fdr, min(branch_fdr) AS min_branch_fdr, arg_min(pair_id, fisher_p) AS best_pair_id, arg_min(odds_ratio, fisher_p) AS best_odds_ratio FROM prx_tested GROUP BY 1""")
def _(t):
    return s.best_per_pair(t.tested, ["ann_id"], ["pagel_fdr", "branch_fdr"], "fisher_p", ["pair_id", "odds_ratio"], "pair_id")


from .joins import MODEL_SQL, _models  # noqa: E402


@query("a11_model_support_summary", f"""
WITH {MODEL_SQL}, a AS (SELECT vid, count(*) FILTER (role = 'primary') AS primary_attempted, count(*) FILTER (role = 'primary' AND model_status = 'ok') AS primary_mapped, count(*) FILTER (role <> 'primary' AND model_status NOT LIKE 'secondary%') AS secondary_attempted,
 count(*) FILTER (role <> 'primary' AND model_status = 'ok') AS secondary_mapped, string_agg(DISTINCT lab, ',' ORDER BY lab) AS lab_list, bool_or(rescue) AS any_rescue FROM ms GROUP BY 1)
SELECT *, CASE WHEN primary_mapped > 0 AND secondary_mapped > 0 THEN 'primary_and_secondary' WHEN primary_mapped > 0 THEN 'primary_only' WHEN secondary_mapped > 0 THEN 'secondary_only' ELSE 'unmapped' END AS support_class FROM a""")
def _(t):
    return s.model_support_summary(_models(t), "vid", "role", "model_status", ["rescue"], ["lab"])


A12 = ["genome", "brand", "source_db", "assembly", "chromosome", "linestatus", "status", "priority", "ref_aa", "alt_aa", "line"]


@query("a12_composite_key_counts", f"SELECT {', '.join(A12)}, count(*) AS n FROM prx_variant GROUP BY ALL")
def _(t):
    return s.composite_key_counts(t.variant, A12)


@query("a13_mapping_rate", f"""
WITH {CLASSIFIED_SQL}, a AS (SELECT brand, count(DISTINCT okey) FILTER (cs = 'classified') AS n_eligible, count(DISTINCT okey) FILTER (cs = 'classified' AND aa) AS n_mapped FROM cv GROUP BY 1) SELECT *, round(n_mapped / n_eligible, 6) AS rate FROM a""")
def _(t):
    return s.mapping_rate(_classified(t), "okey", C("cs") == "classified", C("aa"), ["brand"]).withColumn("rate", F.round("rate", 6))


@query("a14_contingency_alt", """
WITH c AS (SELECT p_brand AS pair, o_orderpriority AS res, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag <> 'A') AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
t AS (SELECT *, sum(a) OVER (PARTITION BY pair) - a AS c, sum(b) OVER (PARTITION BY pair) - b AS d FROM c)
SELECT pair, res, a, b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round(a / (a + c), 6) AS sensitivity, round(a / (a + b), 6) AS specificity, a / (a + c) >= 0.5 AND a / (a + b) >= 0.5 AS incompatible FROM t WHERE a > 0 AND res <> '5-LOW'""")
def _(t):
    cells = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.part, C("l_partkey") == C("p_partkey")).select(
        C("p_brand").alias("pair"), C("o_orderpriority").alias("res"), (C("l_returnflag") == "A").alias("carrier"), F.lit("5-LOW").alias("human"), F.lit("hbond").alias("cls"))
    out = s.contingency_alt(cells, ["pair"], "res", "carrier", "human").withColumn("cls", F.lit("hbond"))
    return out.withColumn("incompatible", s.likely_incompatible("cls", "sensitivity", "specificity")).select(
        "pair", "res", "a", "b", "c", "d", R6("sensitivity"), R6("specificity"), "incompatible")


@query("a15_concordance_summary", f"""
WITH b AS ({BEST_SQL}), g AS (SELECT *, {SIG_SQL} AS sig FROM b) SELECT ann_id, count(*) AS n_tested, count(*) FILTER (sig) AS n_sig, count(*) FILTER (sig AND contact_type <> 'mt-nuc') AS intra_sig, count(*) FILTER (sig AND contact_type = 'mt-nuc') AS inter_sig,
 COALESCE(string_agg(DISTINCT CASE WHEN sig THEN contact_gene END, ',' ORDER BY CASE WHEN sig THEN contact_gene END), '') AS sig_genes FROM g GROUP BY 1""")
def _(t):
    from ..functions.rules import is_significant

    sig = is_significant("low_power", "pagel_fdr", "branch_fdr", "fisher_fdr")
    return s.concordance_summary(t.tested.withColumn("sig", sig), "ann_id", C("sig"), "contact_type", "contact_gene")


@query("a16_independent_origins", f"""
WITH b AS ({BEST_SQL}), g AS (SELECT *, {SIG_SQL} AS sig, CASE WHEN is_ancestral THEN pair_id % 5 ELSE n_origins END AS n FROM b) SELECT ann_id, is_ancestral, max(n) AS n_origins, count(*) AS n_tested, count(*) FILTER (sig) AS n_sig, bool_or(sig) AS has_compensation FROM g GROUP BY 1, 2""")
def _(t):
    from ..functions.rules import is_significant

    sig = is_significant("low_power", "pagel_fdr", "branch_fdr", "fisher_fdr")
    timing = t.tested.select("ann_id", "is_ancestral", (C("pair_id") % 5).alias("n_losses"), C("n_origins").alias("n_gains"))
    return s.independent_origins(timing, t.tested, ["ann_id"], sig)


@query("a17_stratified_2x2", f"""
WITH b AS ({BEST_SQL}), src AS (SELECT contact_type, COALESCE(timing = 'contact_first', false) AS f, {SIG_SQL} AS s FROM b), {STRATA_SQL.format(src='src', term=TERM)}
SELECT stratum, a, b, c, d, round(p, 6) AS p_value, round((a + 0.5::DOUBLE) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds_ratio FROM sp""")
def _(t):
    from ..functions.rules import is_significant

    sig = is_significant("low_power", "pagel_fdr", "branch_fdr", "fisher_fdr")
    out = s.stratified_2x2(t.tested, F.coalesce(C("timing") == "contact_first", F.lit(False)), sig, strata())
    return out.select("stratum", "a", "b", "c", "d", R6("p_value"), R6("odds_ratio"))


@query("a18_decomposed_rates", """
WITH g AS (SELECT contact_type, NOT low_power AND pagel_fdr IS NULL AND branch_fdr IS NULL AND fisher_fdr <= 0.1 AS fo, NOT low_power AND (pagel_fdr IS NOT NULL OR branch_fdr IS NOT NULL) AS mo FROM prx_tested)
SELECT COALESCE(contact_type, 'all') AS contact_type, count(*) AS n, count(*) FILTER (fo) AS n_fisher_only, count(*) FILTER (mo) AS n_multi_origin, round(count(*) FILTER (fo) / count(*), 6) AS rate_fisher_only, round(count(*) FILTER (mo) / count(*), 6) AS rate_multi_origin FROM g GROUP BY ROLLUP (contact_type)""")
def _(t):
    from ..functions.rules import evidence_flags

    e = evidence_flags("low_power", "pagel_fdr", "branch_fdr", "fisher_fdr")
    out = s.decomposed_rates(t.tested, "contact_type", fisher_only=e["fisher_only"], multi_origin=e["multi_origin"])
    return out.withColumns({c: F.round(c, 6) for c in ("rate_fisher_only", "rate_multi_origin")})


@query("a19_test_coverage", """
WITH g AS (SELECT contact_type, fisher_p < 0.20 AND n_origins >= 3 AS el, pagel_fdr IS NOT NULL AS ran FROM prx_tested)
SELECT COALESCE(contact_type, 'all') AS contact_type, count(*) AS n, count(*) FILTER (el) AS n_eligible, count(*) FILTER (el AND ran) AS n_ran, count(*) FILTER (el AND NOT ran) AS n_na, round(count(*) FILTER (el AND NOT ran) / count(*) FILTER (el), 6) AS na_rate FROM g GROUP BY ROLLUP (contact_type)""")
def _(t):
    return s.test_coverage(t.tested, "contact_type", (C("fisher_p") < 0.20) & (C("n_origins") >= 3), C("pagel_fdr").isNotNull()).withColumn("na_rate", F.round("na_rate", 6))


@query("a20_excluding_group", """
WITH g AS (SELECT *, dar_gene IN ('MACHINERY', 'BUILDING') AS i FROM prx_tested), x AS (SELECT 'all' AS stratum, * FROM g UNION ALL SELECT CASE WHEN i THEN 'group_only' ELSE 'without_group' END, * FROM g)
SELECT stratum, count(*) FILTER (timing = 'contact_first' AND fisher_p < 0.1) AS a, count(*) FILTER (timing = 'contact_first' AND NOT fisher_p < 0.1) AS b, count(*) FILTER (timing IS DISTINCT FROM 'contact_first' AND fisher_p < 0.1) AS c, count(*) FILTER (timing IS DISTINCT FROM 'contact_first' AND NOT fisher_p < 0.1) AS d FROM x GROUP BY 1""")
def _(t):
    groups = s.excluding_group(t.tested, "dar_gene", ["MACHINERY", "BUILDING"])
    return s.stratified_2x2(t.tested, F.coalesce(C("timing") == "contact_first", F.lit(False)), C("fisher_p") < 0.1, groups).select("stratum", "a", "b", "c", "d")


@query("a21_complex_breakdown", """
SELECT complex_id, a_mt, count(*) AS n, string_agg(DISTINCT dar_gene, ', ' ORDER BY dar_gene) AS genes, min(fisher_p) AS p_min, max(fisher_p) AS p_max FROM prx_tested WHERE pagel_fdr <= 0.1 GROUP BY 1, 2""")
def _(t):
    return s.complex_breakdown(t.tested.where("pagel_fdr <= 0.1"), ["complex_id", "a_mt"], "dar_gene", "fisher_p")


@query("a22_class_distribution", """
WITH g AS (SELECT contact_gene, COALESCE(pagel_fdr <= 0.1, false) AS s FROM prx_tested) SELECT contact_gene, count(*) FILTER (s) AS n_sig, count(*) FILTER (NOT s) AS n_nonsig, round(count(*) FILTER (s) * 100.0 / sum(count(*) FILTER (s)) OVER (), 6) AS pct_sig, round(count(*) FILTER (NOT s) * 100.0 / sum(count(*) FILTER (NOT s)) OVER (), 6) AS pct_nonsig FROM g GROUP BY 1""")
def _(t):
    return s.class_distribution(t.tested, "contact_gene", C("pagel_fdr") <= 0.1).withColumns({c: F.round(c, 6) for c in ("pct_sig", "pct_nonsig")})


CS = """SELECT *, unnest(list_filter(['all', CASE WHEN contact_type = 'mt-mt' THEN 'mt-mt' END, CASE WHEN contact_type = 'nuc-nuc' THEN 'nuc-nuc' END, CASE WHEN contact_type = 'mt-nuc' THEN 'mt-nuc' END], lambda x: x IS NOT NULL)) AS stratum FROM prx_tested"""


@query("a23_compartment_summary", f"""
WITH x AS ({CS}), n AS (SELECT stratum, count(*) AS n_total, count(*) FILTER (is_ancestral) AS n_flag, count(*) FILTER (is_ancestral AND COALESCE(pagel_fdr <= 0.1, false)) AS n_pagel, quantile_cont(odds_ratio, 0.5) FILTER (is_ancestral) AS median_flag,
 quantile_cont(odds_ratio, 0.95) FILTER (is_ancestral) AS p95_flag, quantile_cont(odds_ratio, 0.5) FILTER (NOT is_ancestral) AS median_rest FROM x GROUP BY 1), {mw_sql('SELECT stratum, is_ancestral AS g, odds_ratio AS v FROM x', ['stratum'], 'greater')}
SELECT n.stratum, n_total, n_flag, n_pagel, round(n_pagel / n_flag, 6) AS rate_pagel, round(median_flag, 6) AS median_flag, round(p95_flag, 6) AS p95_flag, round(median_rest, 6) AS median_rest, round(p_value, 6) AS mw_p FROM n JOIN mp USING (stratum)""")
def _(t):
    out = s.compartment_summary(t.tested, strata(), "is_ancestral", "odds_ratio", pagel=C("pagel_fdr") <= 0.1)
    return out.select("stratum", "n_total", "n_flag", "n_pagel", *[R6(c) for c in ("rate_pagel", "median_flag", "p95_flag", "median_rest", "mw_p")])


@query("a24_rate_bins", """
WITH l AS (SELECT CASE WHEN n_origins = 1 THEN '1' WHEN n_origins BETWEEN 2 AND 5 THEN '2-5' WHEN n_origins BETWEEN 6 AND 10 THEN '6-10' WHEN n_origins >= 11 THEN '>10' END AS bin, contact_type, fisher_p < 0.05 AS s, odds_ratio FROM prx_tested),
g AS (SELECT b.bin, c.contact_type FROM (SELECT unnest(['1', '2-5', '6-10', '>10']) AS bin) b, (SELECT DISTINCT contact_type FROM prx_tested) c)
SELECT g.bin, g.contact_type, count(l.s) AS n, count(*) FILTER (l.s) AS n_sig, CASE WHEN count(l.s) > 0 THEN round(count(*) FILTER (l.s) * 100.0 / count(l.s), 6) END AS pct_sig, round(quantile_cont(odds_ratio, 0.5), 6) AS median FROM g LEFT JOIN l USING (bin, contact_type) GROUP BY 1, 2""")
def _(t):
    return s.rate_bins(t.tested, "n_origins", ORIGIN_BINS, "contact_type", C("fisher_p") < 0.05, "odds_ratio").select("bin", "contact_type", "n", "n_sig", R6("pct_sig"), R6("median"))


@query("a25_meff_bins", """
WITH m AS (SELECT ann_id, quantile_cont(odds_ratio, 0.5) AS mm, quantile_cont(fisher_p, 0.5) AS me, count(*) AS n FROM prx_tested GROUP BY 1), l AS (SELECT *, CASE WHEN me > 0 AND me <= 0.2 THEN '(0,0.2]' WHEN me > 0.2 AND me <= 0.6 THEN '(0.2,0.6]' WHEN me > 0.6 THEN '>0.6' END AS bin FROM m)
SELECT bin, count(*) AS n_genes, CAST(sum(n) AS BIGINT) AS n_rows, round(quantile_cont(mm, 0.5), 6) AS median FROM l WHERE bin IS NOT NULL GROUP BY 1""")
def _(t):
    return s.meff_bins(t.tested, "ann_id", "fisher_p", "odds_ratio", MEFF_BINS)[1].select("bin", "n_genes", "n_rows", R6("median"))


OFF_SQL = """os AS (SELECT o_custkey AS gene, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 41 - 10 END AS off FROM orders), oo AS (SELECT gene, count(*) AS n, quantile_cont(off, 0.5) AS offset_median, min(off) AS offset_min, max(off) AS offset_max FROM os WHERE off IS NOT NULL GROUP BY 1)"""


def _offsets(t):
    off = C("o_orderkey") % 41 - 10
    st = F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit("large_offset_candidate_"), F.when(off >= 0, "+").otherwise(""), off.cast("string"))).otherwise("ok")
    return s.observed_offsets(t.orders.select(C("o_custkey").alias("gene"), st.alias("st")), "gene", "st")


@query("a26_observed_offsets", f"WITH {OFF_SQL} SELECT gene, n, round(offset_median, 6) AS offset_median, offset_min, offset_max FROM oo")
def _(t):
    return _offsets(t).withColumn("offset_median", F.round("offset_median", 6))


@query("a27_offset_agreement", f"""
WITH {OFF_SQL}, d AS (SELECT c_custkey AS gene, offset_median - c_custkey % 30 AS delta, offset_max FROM customer LEFT JOIN oo ON gene = c_custkey)
SELECT gene, round(delta, 6) AS delta, CASE WHEN abs(delta) <= 5 THEN 'agree' WHEN abs(delta) <= 15 THEN 'close' WHEN delta IS NOT NULL THEN 'mismatch' END AS agreement, CASE WHEN delta IS NULL THEN 'no_observation' WHEN abs(delta) <= 5 THEN 'accept' WHEN abs(delta) <= 15 THEN 'review' ELSE 'reject' END AS decision,
 greatest(COALESCE(abs(offset_max), 0) + 5, 10) AS max_offset FROM d""")
def _(t):
    ann = t.customer.select(C("c_custkey").alias("gene"), (C("c_custkey") % 30).alias("annotated_offset"))
    return s.offset_decision(_offsets(t), ann, "gene").select("gene", F.round("delta", 6).alias("delta"), "agreement", "decision", "max_offset")


PERMISSIVE = ("contact_first", "permissive_background", "constitutively_permissive")
REFINED_SQL = "CASE WHEN timing = 'co_occurring' THEN CASE WHEN blosum >= 1 THEN 'permissive_background' ELSE 'co_adaptation' END WHEN timing = 'no_contact_change' AND blosum >= 1 THEN 'constitutively_permissive' ELSE timing END"


@query("a28_timing_rollup", f"""
WITH r AS (SELECT contact_type, {REFINED_SQL} AS refined FROM prx_tested), n AS (SELECT contact_type, refined, count(*) AS n FROM r GROUP BY 1, 2)
SELECT *, CAST(sum(n) OVER (PARTITION BY contact_type) AS BIGINT) AS n_events, round(n / sum(n) OVER (PARTITION BY contact_type), 6) AS share, round(sum(CASE WHEN refined IN {PERMISSIVE} THEN n ELSE 0 END) OVER (PARTITION BY contact_type) / sum(n) OVER (PARTITION BY contact_type), 6) AS permissive_share FROM n""")
def _(t):
    from ..functions.rules import refine_timing

    out = s.timing_rollup(t.tested.withColumn("refined", refine_timing("timing", "blosum")), "contact_type", PERMISSIVE)
    return out.select("contact_type", "refined", "n", "n_events", R6("share"), R6("permissive_share"))


@query("a29_header_manifest", """
SELECT gene, count(*) AS n_headers, 0 AS n_unresolved, string_agg(DISTINCT CASE WHEN is_ref THEN 'species_taxid_assembly_transcript' ELSE 'unclassified' END, ',' ORDER BY CASE WHEN is_ref THEN 'species_taxid_assembly_transcript' ELSE 'unclassified' END) AS schemas FROM prx_aln GROUP BY 1""")
def _(t):
    from ..sources.readers import parse_seq_header

    return s.header_manifest(parse_seq_header(t.aln), "gene")


@query("a30_alignment_integrity", """
WITH a AS (SELECT gene, count(*) AS n_aa, count(*) FILTER (is_ref) AS n_reference, count(*) FILTER (length(seq) = 0) AS n_empty, count(*) FILTER (regexp_matches(seq, '[BJOUXZ]')) AS n_foreign FROM prx_aln GROUP BY 1),
c AS (SELECT gene, count(*) AS n_codon, count(*) FILTER (length(seq) % 3 <> 0) AS n_bad_length FROM prx_codon WHERE species % 50 <> 1 GROUP BY 1), m AS (SELECT gene, count(*) FILTER (species % 50 = 1) AS only_aa FROM prx_aln GROUP BY 1)
SELECT a.*, n_codon, n_bad_length, only_aa, 0 AS only_codon, n_aa < 110 AS few_species FROM a JOIN c USING (gene) JOIN m USING (gene)""")
def _(t):
    return s.alignment_integrity(t.aln, t.codon.where("species % 50 <> 1"), "ACDEFGHIKLMNPQRSTVWY-", 110)


@query("a30b_character_inventory", "SELECT gene, ch, count(*) AS n FROM prx_cell GROUP BY 1, 2")
def _(t):
    return s.character_inventory(t.aln)


@query("a31_field_coverage", """
WITH c AS (SELECT count(*) AS n, count(pagel_fdr) AS a, count(branch_fdr) AS b, count(timing) AS c, count(fisher_p) AS d FROM prx_tested)
SELECT unnest(['pagel_fdr', 'branch_fdr', 'timing', 'fisher_p']) AS field, unnest([a, b, c, d]) AS n_present, round(unnest([a, b, c, d]) * 100.0 / n, 6) AS pct_present FROM c""")
def _(t):
    return s.field_coverage(t.tested.select("pagel_fdr", "branch_fdr", "timing", "fisher_p")).withColumn("pct_present", F.round("pct_present", 6))


@query("a32_source_stats", """
SELECT 'gene' AS dim, gene AS value, count(*) AS n FROM prx_variant GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM prx_variant GROUP BY 2 UNION ALL SELECT 'source_db', source_db, count(*) FROM prx_variant GROUP BY 2""")
def _(t):
    return s.source_stats(t.variant, ["gene", "priority", "source_db"])


@query("a33_shift_diagnosis", """
WITH r AS (SELECT gene, replace(seq, '-', '') AS seq FROM prx_codon WHERE is_ref), v AS (SELECT vid, pos, ref, ['en', 'de', 'fr', 'es'][CAST(1 + pkey % 4 AS INT)] AS gene FROM prx_variant)
SELECT CASE WHEN pos > length(seq) THEN 'out_of_bounds' WHEN substr(seq, pos, length(ref)) = ref THEN 'match' WHEN pos > 1 AND substr(seq, pos - 1, length(ref)) = ref THEN 'shift_minus_1' WHEN pos < length(seq) AND substr(seq, pos + 1, length(ref)) = ref THEN 'shift_plus_1' ELSE 'none' END AS shift, count(*) AS n FROM v JOIN r USING (gene) GROUP BY 1""")
def _(t):
    from .scalars import _on_reference

    return s.shift_diagnosis(_on_reference(t), "seq", "pos", "ref").groupBy("shift").agg(F.count(F.lit(1)).alias("n"))


@query("a34_metric_table", """
SELECT unnest(['n_pairs', 'n_genes', 'n_low_power', 'n_permissive']) AS metric, unnest([count(*)::DOUBLE, count(DISTINCT dar_gene)::DOUBLE, (count(*) FILTER (low_power))::DOUBLE, (count(*) FILTER (timing = 'contact_first'))::DOUBLE]) AS value FROM prx_tested""")
def _(t):
    return s.metric_table(t.tested, n_pairs=F.count(F.lit(1)), n_genes=F.count_distinct("dar_gene"), n_low_power=F.count_if("low_power"), n_permissive=F.count_if(C("timing") == "contact_first"))


@query("a35_cross_genome_species", """
WITH a AS (SELECT c_custkey % 1200 AS taxid, min(c_name) AS sp FROM customer GROUP BY 1), b AS (SELECT o_custkey AS taxid, min(c_name) AS sp FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT DISTINCT a.sp AS species FROM a JOIN b ON a.taxid = b.taxid AND a.sp = b.sp""")
def _(t):
    from ..operators.lookup import taxid_match

    a = t.customer.select((C("c_custkey") % 1200).alias("taxid"), C("c_name").alias("species_a"))
    b = t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).select(C("o_custkey").alias("taxid"), C("c_name").alias("species_b"))
    return taxid_match(a, b).where("match_type = 'exact'").select(C("species_a").alias("species")).distinct()


@query("a36_best_sequence", """
WITH r AS (SELECT gene, source, species, length(seq) AS n, length(seq) - length(translate(seq, '-X', '')) AS g FROM prx_aln), b AS (SELECT *, row_number() OVER (PARTITION BY gene, source ORDER BY g, species) AS rn FROM r), k AS (SELECT * FROM b WHERE rn = 1)
SELECT gene, source, species, n AS seq_length FROM k WHERE gene IN (SELECT gene FROM k GROUP BY 1 HAVING count(*) >= 20)""")
def _(t):
    return s.species_rule(s.best_sequence(t.aln, ["gene", "source"], "species")).select("gene", "source", "species", F.length("seq").alias("seq_length"))


@query("a37_reference_support", """
WITH a AS (SELECT DISTINCT c_custkey AS g FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS g FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT DISTINCT o_custkey AS g FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'targets' AS metric, count(*) AS value FROM a UNION ALL SELECT 'indexed', count(*) FROM b UNION ALL SELECT 'targets_indexed', count(*) FROM a JOIN b USING (g) UNION ALL SELECT 'targets_with_transcript', count(*) FROM a JOIN c USING (g)""")
def _(t):
    k = C("o_custkey").alias("gene")
    return s.reference_support(t.customer.where("c_acctbal > 0").select(C("c_custkey").alias("gene")), t.orders.where("o_orderstatus = 'F'").select(k), t.orders.where("o_orderpriority = '1-URGENT'").select(k))


@query("a38_anchor_policy", """
SELECT p_brand AS gene, COALESCE(bool_or(n_nationkey % 2 = 0), false) AS allow_extended, greatest(COALESCE(max(n_nationkey * 2), 10), 10) AS max_offset, CASE WHEN COALESCE(bool_or(n_nationkey % 2 = 0), false) THEN 'registry_enabled' ELSE 'default_only' END AS policy FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN nation ON p_brand = 'Brand#' || n_nationkey AND n_nationkey % 3 > 0 GROUP BY 1""")
def _(t):
    k = C("n_nationkey")
    reg = t.nation.where(k % 3 > 0).select(F.concat(F.lit("Brand#"), k.cast("string")).alias("gene"), F.when(k % 2 == 0, " TRUE").otherwise("no").alias("allow_extended_anchor"), (k * 2).cast("string").alias("max_offset"))
    return s.anchor_policy(t.part.select(C("p_brand").alias("gene")).distinct(), reg)


@query("a39_eligibility_projection", f"""
WITH {CLASSIFIED_SQL}, p AS (SELECT 'Brand#' || n_nationkey AS gene, n_regionkey AS complex_id FROM nation WHERE n_nationkey > 3), m AS (SELECT r_regionkey AS complex_id FROM region WHERE r_regionkey <> 2),
x AS (SELECT vid, CASE WHEN cs <> 'classified' THEN 'not_classified' WHEN p.complex_id IS NULL THEN 'gene_unknown' WHEN m.complex_id IS NULL THEN 'no_model' WHEN line = 4 THEN 'no_coordinate' ELSE '' END AS reason FROM cv LEFT JOIN p ON p.gene = brand LEFT JOIN m ON m.complex_id = p.complex_id) SELECT vid, reason, reason = '' AS is_eligible FROM x""")
def _(t):
    panel = t.nation.where("n_nationkey > 3").select(F.concat(F.lit("Brand#"), C("n_nationkey").cast("string")).alias("gene"), C("n_regionkey").alias("complex_id"))
    models = t.region.where("r_regionkey <> 2").select(C("r_regionkey").alias("complex_id"))
    v = _classified(t).withColumn("mapped_pos", F.when(C("line") != 4, C("pos")))
    return s.eligibility_projection(v, panel, models, "brand", "mapped_pos", "cs").select("vid", "reason", "is_eligible")


@query("a40_threshold_summary", """
WITH c AS (SELECT (count(*) FILTER (odds_ratio > 0.5))::DOUBLE AS a, (count(*) FILTER (odds_ratio > 1))::DOUBLE AS b, (count(*) FILTER (blosum > 0.5))::DOUBLE AS c, (count(*) FILTER (blosum > 1))::DOUBLE AS d, (count(*) FILTER (odds_ratio > 0.5 AND blosum > 0.5))::DOUBLE AS e, (count(*) FILTER (odds_ratio > 1 AND blosum > 1))::DOUBLE AS f FROM prx_tested)
SELECT unnest(['odds_ratio_gt_0.5', 'odds_ratio_gt_1.0', 'blosum_gt_0.5', 'blosum_gt_1.0', 'all_gt_0.5', 'all_gt_1.0']) AS metric, unnest([a, b, c, d, e, f]) AS value FROM c""")
def _(t):
    return s.threshold_summary(t.tested, ["odds_ratio", "blosum"])


@query("a41_registry_append", """
SELECT s_name AS gene, s_acctbal AS offset_value FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer WHERE c_name NOT IN (SELECT s_name FROM supplier)""")
def _(t):
    reg = t.supplier.select(C("s_name").alias("gene"), C("s_acctbal").alias("offset_value"))
    return s.registry_append(reg, t.customer.select(C("c_name").alias("gene"), C("c_acctbal").alias("offset_value"), "c_mktsegment"), "gene")


@query("a42_metrics_by_group", f"""
WITH {CLASSIFIED_SQL} SELECT genome, brand, count(*) AS n_classified, count(*) FILTER (aa) AS n_aa, count(*) FILTER (nt) AS n_nt, round(count(*) FILTER (aa) * 100.0 / count(*), 6) AS pct_aa, round(count(*) FILTER (nt) * 100.0 / count(*), 6) AS pct_nt FROM cv WHERE cs = 'classified' GROUP BY 1, 2""")
def _(t):
    return s.metrics_by_group(_classified(t).where("cs = 'classified'"), ["genome", "brand"], "aa", "nt").withColumns({c: F.round(c, 6) for c in ("pct_aa", "pct_nt")})
