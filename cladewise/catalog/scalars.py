"""P: projections, predicates and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import protein, rules, text
from ..functions.text import literal_map
from .registry import query

C = F.col

REVIEW = {"1-URGENT": "practice guideline", "2-HIGH": "reviewed by expert panel",
          "3-MEDIUM": "criteria provided, multiple submitters, no conflicts",
          "4-NOT SPECIFIED": "criteria provided, single submitter", "5-LOW": "no assertion"}
REVIEW_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REVIEW.items()) + " END"


@query("p01_first_scalar", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS scalar_value,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS list_value,
       CAST(NULL AS DOUBLE) AS bad_value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS int_value FROM events""")
def _(t):
    listed = F.regexp_replace("props", r"(\d+)", "[$1, 999]")
    return t.events.select(
        "event_id",
        text.to_float(text.first_scalar("props", "$.k")).alias("scalar_value"),
        text.to_float(text.first_scalar(listed, "$.k")).alias("list_value"),
        text.to_float(F.col("event_type")).alias("bad_value"),
        text.to_int(text.first_scalar("props", "$.k")).alias("int_value"),
    )


@query("p02_variant_flags", r"""
SELECT vid, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(ref) = length(alt) AND length(ref) > 1 THEN 'mnv'
            WHEN length(ref) <> length(alt) THEN 'indel' ELSE 'other' END AS variant_class,
       length(ref) = 1 AND length(alt) = 1 AS is_snv, length(ref) = length(alt) AND length(ref) > 1 AS is_mnv,
       length(ref) <> length(alt) AS is_indel, aa_change <> '' AND aa_change <> 'noncoding' AS is_coding,
       regexp_matches(aa_change, '^[A-Z]\d+[A-Z]$') AND substr(aa_change, 1, 1) <> right(aa_change, 1) AS is_missense,
       regexp_matches(aa_change, '^[A-Z]\d+[A-Z]$') AND substr(aa_change, 1, 1) = right(aa_change, 1) AS is_synonymous,
       contains(aa_change, '*') AS is_nonsense, aa_change = 'frameshift' AS is_frameshift
FROM prx_variant""")
def _(t):
    return t.variant.select("vid", rules.variant_flags("ref", "alt", "aa_change").alias("f")).select("vid", "f.*")


REASON_SQL = r"""CASE WHEN aa_change IN ('', 'noncoding') THEN 'noncoding'
 WHEN NOT (length(ref) = 1 AND length(alt) = 1) THEN 'non_snv' WHEN aa_change = 'frameshift' THEN 'frameshift'
 WHEN contains(aa_change, '*') THEN 'nonsense' WHEN linestatus = 'O' AND status = 'P' THEN 'unresolved'
 WHEN ref_aa = alt_aa THEN 'not_missense' ELSE '' END"""


def _reason():
    failure = F.when((C("linestatus") == "O") & (C("status") == "P"), "unresolved").otherwise("")
    return rules.exclusion_reason(rules.variant_flags("ref", "alt", "aa_change"), failure)


@query("p03_core_eligibility", f"SELECT vid, {REASON_SQL} AS reason, {REASON_SQL} = '' AS eligible FROM prx_variant")
def _(t):
    return t.variant.select("vid", _reason().alias("reason"), (_reason() == "").alias("eligible"))


@query("p04_eligibility_override", f"""
SELECT vid, CASE WHEN assembly <> 'GRCh38' THEN 'non_grch38' WHEN chromosome = 'MT' THEN 'mt_in_nuclear_branch'
  WHEN NOT (length(ref) = 1 AND length(alt) = 1) THEN 'non_snv' ELSE {REASON_SQL} END AS reason FROM prx_variant""")
def _(t):
    snv = (F.length("ref") == 1) & (F.length("alt") == 1)
    return t.variant.select("vid", rules.override_reason(_reason(), "assembly", "chromosome", snv).alias("reason"))


@query("p05_plasmy", """
WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' No ' WHEN 'O' THEN '+' END AS homo,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'NR' WHEN '2-HIGH' THEN 'nan' WHEN '3-MEDIUM' THEN '' ELSE '-' END AS hetero FROM orders),
f AS (SELECT *, COALESCE(lower(trim(homo)), '') NOT IN ('', 'no', 'nr', 'nan') AS a,
  COALESCE(lower(trim(hetero)), '') NOT IN ('', 'no', 'nr', 'nan') AS b FROM s)
SELECT o_orderkey, CASE WHEN a AND b THEN 'homo/hetero' WHEN a THEN 'homo' WHEN b THEN 'hetero' ELSE '' END AS plasmy FROM f""")
def _(t):
    homo = F.when(C("o_orderstatus") == "F", " No ").when(C("o_orderstatus") == "O", "+")
    p = C("o_orderpriority")
    hetero = F.when(p == "1-URGENT", "NR").when(p == "2-HIGH", "nan").when(p == "3-MEDIUM", "").otherwise("-")
    return t.orders.select("o_orderkey", text.plasmy(homo, hetero).alias("plasmy"))


@query("p06_count_list", """
SELECT doc_id, len(list_filter(string_split(trim(text), ','), lambda x: trim(x) <> '')) AS n FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.count_list("text").alias("n"))


@query("p07_dedupe_terms", """
WITH s AS (SELECT o_orderkey, o_orderpriority || '| ' || o_orderstatus || ';' || o_orderpriority || ';;' || o_orderstatus || '|x' AS raw FROM orders)
SELECT o_orderkey, o_orderpriority || '#' || o_orderstatus || '#x' AS terms FROM s JOIN orders USING (o_orderkey)""")
def _(t):
    raw = F.concat(C("o_orderpriority"), F.lit("| "), C("o_orderstatus"), F.lit(";"), C("o_orderpriority"), F.lit(";;"),
                   C("o_orderstatus"), F.lit("|x"))
    return t.orders.select("o_orderkey", F.array_join(text.dedupe_terms(raw), "#").alias("terms"))


@query("p08_parse_aa_change", r"""
SELECT vid, CASE WHEN regexp_matches(aa_change, '^[A-Za-z*]+\d+[A-Za-z*]+$') THEN upper(regexp_extract(aa_change, '^([A-Za-z*]+)(\d+)([A-Za-z*]+)$', 1)) END AS ref,
 CASE WHEN regexp_matches(aa_change, '^[A-Za-z*]+\d+[A-Za-z*]+$') THEN CAST(regexp_extract(aa_change, '^([A-Za-z*]+)(\d+)([A-Za-z*]+)$', 2) AS BIGINT) END AS pos,
 CASE WHEN regexp_matches(aa_change, '^[A-Za-z*]+\d+[A-Za-z*]+$') THEN upper(regexp_extract(aa_change, '^([A-Za-z*]+)(\d+)([A-Za-z*]+)$', 3)) END AS alt
FROM prx_variant""")
def _(t):
    return t.variant.select("vid", text.parse_aa_change("aa_change").alias("p")).select("vid", "p.*")


# A descriptive name as the nuclear source writes it, built from the keys of a line.
THREE = list(text.RESIDUE_CODES)
NAME_SQL = (
    "CASE WHEN line <= 5 THEN 'NM_' || (1000 + skey) || '.' || line || '(' || brand || '):' ELSE '' END || 'c.' || pos || "
    "substr(ref, 1, 1) || '>' || substr(alt, 1, 1) || ' (p.' || "
    f"[{', '.join(repr(x) for x in THREE)}, 'Ter'][CAST(1 + pkey % 21 AS INT)] || pos || CASE WHEN line = 3 THEN '*' ELSE "
    f"[{', '.join(repr(x) for x in THREE)}, 'Ter'][CAST(1 + skey % 21 AS INT)] END || ')'"
)


def _name():
    codes = F.array(*[F.lit(x) for x in [*THREE, "Ter"]])

    def code(key):
        return F.element_at(codes, (C(key) % 21 + 1).cast("int"))

    head = F.when(C("line") <= 5, F.concat(F.lit("NM_"), (C("skey") + 1000).cast("string"), F.lit("."), C("line").cast("string"),
                                          F.lit("("), C("brand"), F.lit("):"))).otherwise("")
    return F.concat(head, F.lit("c."), C("pos").cast("string"), F.substring("ref", 1, 1), F.lit(">"), F.substring("alt", 1, 1),
                    F.lit(" (p."), code("pkey"), C("pos").cast("string"), F.when(C("line") == 3, "*").otherwise(code("skey")), F.lit(")"))


LETTERS_SQL = f"[{', '.join(repr(x) for x in text.RESIDUE_CODES.values())}, 'X']"


@query("p09_parse_protein_hgvs", f"""
SELECT vid, {LETTERS_SQL}[CAST(1 + pkey % 21 AS INT)] AS ref, CAST(pos AS VARCHAR) AS pos,
  CASE WHEN line = 3 THEN 'X' ELSE {LETTERS_SQL}[CAST(1 + skey % 21 AS INT)] END AS alt, line <> 3 AS strict_ok FROM prx_variant""")
def _(t):
    return t.variant.select("vid", text.parse_protein_hgvs(_name()).alias("p"),
                            text.parse_protein_hgvs(_name(), allow_stop=False).isNotNull().alias("strict_ok")
                            ).select("vid", "p.*", "strict_ok")


@query("p10_extract_hgvs_c", """
SELECT vid, CASE WHEN line <= 5 THEN 'NM_' || (1000 + skey) || '.' || line || ':' ELSE '' END || 'c.' || pos || substr(ref, 1, 1) || '>' || substr(alt, 1, 1) AS hgvs,
  CASE WHEN line <= 5 THEN 'NM_' || (1000 + skey) || '.' || line ELSE '' END AS transcript, substr(ref, 1, 1) AS ref, substr(alt, 1, 1) AS alt FROM prx_variant""")
def _(t):
    return t.variant.select("vid", text.extract_hgvs_c(_name()).alias("h")).select("vid", "h.*")


@query("p11_extract_hgvs_p", f"""
WITH n AS (SELECT vid, {NAME_SQL} AS name FROM prx_variant)
SELECT vid, regexp_extract(name, '(p\\.[A-Za-z0-9*]+)', 1) AS curated, regexp_extract(name, '(p\\.[A-Za-z0-9]+)', 1) AS strict FROM n""")
def _(t):
    return t.variant.select("vid", text.extract_hgvs_p(_name()).alias("curated"),
                            text.extract_hgvs_p(_name(), allow_stop=False).alias("strict"))


@query("p12_review_stars", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2
  WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS stars FROM orders""")
def _(t):
    review = F.element_at(literal_map(REVIEW), C("o_orderpriority"))
    return t.orders.select("o_orderkey", text.review_stars(review).alias("stars"))


@query("p13_aa_position_from_text", f"""
WITH n AS (SELECT vid, aa_change, {NAME_SQL} AS name FROM prx_variant)
SELECT vid, CAST(nullif(regexp_extract(name, 'p\\.[A-Za-z*]+(\\d+)[A-Za-z*]+', 1), '') AS BIGINT) AS from_name,
  CAST(nullif(regexp_extract(aa_change, '[A-Za-z*]+(\\d+)[A-Za-z*]+', 1), '') AS BIGINT) AS from_change,
  CAST(nullif(regexp_extract(aa_change, '[A-Za-z]+(\\d+)[A-Za-z]+', 1), '') AS BIGINT) AS from_strict FROM n""")
def _(t):
    return t.variant.select("vid", text.aa_position_from_text(_name()).alias("from_name"),
                            text.aa_position_from_text("aa_change").alias("from_change"),
                            text.aa_position_from_text("aa_change", stops=False).alias("from_strict"))


@query("p14_resolve_coordinates", f"""
WITH n AS (SELECT *, {NAME_SQL} AS name FROM prx_variant)
SELECT vid, COALESCE(CASE WHEN line % 2 = 0 THEN skey END, CAST(nullif(regexp_extract(aa_change, '[A-Za-z*]+(\\d+)[A-Za-z*]+', 1), '') AS BIGINT)) AS aa_pos,
  CASE WHEN line = 5 THEN 'Z' ELSE ref_aa END AS wt, alt_aa AS mut,
  CASE WHEN genome = 'nucDNA' THEN pos ELSE 5000 - pos + 1 END AS nt_pos FROM n""")
def _(t):
    from ..plans.classify import resolve_coordinates

    src = t.variant.select(
        "*", _name().alias("hgvs_c"), F.when(C("line") % 2 == 0, C("skey")).alias("frame_codon_index"),
        F.when(C("line") == 5, "Z").alias("frame_ref_aa"), F.lit(None).cast("string").alias("frame_alt_aa"),
        F.lit(1).alias("gene_start"), F.lit(5000).alias("gene_end"), F.lit("-").alias("strand"),
    )
    return resolve_coordinates(src, text_fields=("aa_change",), nt_text="hgvs_c", genomic_pos="pos").select(
        "vid", "aa_pos", "wt", "mut", "nt_pos")


@query("p15_genomic_to_cds", """
SELECT l.l_orderkey, l.l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN l_partkey - 5 + 1 ELSE 3000 - l_partkey + 1 END AS cds_pos FROM lineitem l""")
def _(t):
    strand = F.when(C("l_linestatus") == "O", "+").otherwise("-")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             protein.genomic_to_cds("l_partkey", F.lit(5), F.lit(3000), strand).alias("cds_pos"))


@query("p16_complement_in_range", """
SELECT vid, CASE WHEN pos BETWEEN 500 AND 1200 THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS coding_ref,
  CASE WHEN pos BETWEEN 500 AND 1200 THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS coding_alt FROM prx_variant""")
def _(t):
    return t.variant.select("vid", protein.complement_in_range("ref", "pos", 500, 1200).alias("coding_ref"),
                            protein.complement_in_range("alt", "pos", 500, 1200).alias("coding_alt"))


MATRIX_SQL = """SELECT substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + p_partkey % 20 AS INT), 1) AS ref,
  substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + p_size % 20 AS INT), 1) AS alt, max(p_size - 20) AS score FROM part WHERE p_partkey % 20 <> 3 GROUP BY 1, 2"""
SCALE_SQL = """SELECT substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + p_size % 20 AS INT), 1) AS aa, max(p_retailprice) AS value FROM part WHERE p_size % 20 <> 7 GROUP BY 1"""


def _matrix(t):
    from .tables import AA, _pick

    return t.part.where(C("p_partkey") % 20 != 3).groupBy(_pick(AA, C("p_partkey")).alias("ref"), _pick(AA, C("p_size")).alias("alt")).agg(
        F.max(C("p_size") - 20).alias("score"))


def _scale(t):
    from .tables import AA, _pick

    return t.part.where(C("p_size") % 20 != 7).groupBy(_pick(AA, C("p_size")).alias("aa")).agg(F.max("p_retailprice").alias("value"))


@query("p17_substitution_properties", f"""
WITH m AS ({MATRIX_SQL}), s AS ({SCALE_SQL}), c(aa, q) AS (VALUES ('R', 1), ('K', 1), ('D', -1), ('E', -1))
SELECT vid, m.score AS matrix_score, COALESCE(c2.q, 0) - COALESCE(c1.q, 0) AS charge_change, round(s2.value - s1.value, 1) AS scale_change,
  'P' IN (v.ref_aa, v.alt_aa) AS has_proline, 'G' IN (v.ref_aa, v.alt_aa) AS has_glycine, 'C' IN (v.ref_aa, v.alt_aa) AS has_cysteine
FROM prx_variant v LEFT JOIN m ON m.ref = v.ref_aa AND m.alt = v.alt_aa LEFT JOIN s s1 ON s1.aa = v.ref_aa LEFT JOIN s s2 ON s2.aa = v.alt_aa
LEFT JOIN c c1 ON c1.aa = v.ref_aa LEFT JOIN c c2 ON c2.aa = v.alt_aa""")
def _(t):
    from ..operators.lookup import substitution_properties

    return substitution_properties(
        t.variant, "ref_aa", "alt_aa", matrices={"matrix_score": _matrix(t)}, scales={"scale_change": (_scale(t), 1)}
    ).select("vid", "matrix_score", "charge_change", "scale_change", "has_proline", "has_glycine", "has_cysteine")


@query("p18_gene_context", """
WITH g AS (SELECT 'Brand#' || n_nationkey AS gene, r_name AS complex_id, CASE WHEN n_nationkey % 3 = 0 THEN 'core' ELSE 'accessory' END AS role
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 4)
SELECT vid, complex_id, COALESCE(role, 'unknown') AS role, CASE WHEN v.gene LIKE 'MT-%' THEN 'mitochondrial' ELSE 'nuclear' END AS encoded_by,
  v.gene IN ('Brand#1', 'Brand#2') AS in_group FROM prx_variant v LEFT JOIN g ON g.gene = v.gene""")
def _(t):
    from ..operators.lookup import gene_context

    n = C("n_nationkey")
    panel = t.nation.where(n > 4).join(t.region, C("n_regionkey") == C("r_regionkey")).select(
        F.concat(F.lit("Brand#"), n.cast("string")).alias("gene"), C("r_name").alias("complex_id"),
        F.when(n % 3 == 0, "core").otherwise("accessory").alias("role"))
    return gene_context(t.variant, panel, group=("Brand#1", "Brand#2")).select("vid", "complex_id", "role", "encoded_by", "in_group")


def _nested(t):
    k = text.to_int(text.first_scalar("props", "$.k"))
    ty = C("event_type")
    pred = F.when(ty == "view", "LP").when(ty == "click", "b").when(ty == "error", "amb")
    score = F.when(k % 2 == 0, F.concat(F.lit("["), k.cast("string"), F.lit(", 5]"))).otherwise(k.cast("string"))
    pops = F.concat_ws(",", *[
        F.concat(F.lit(f'"af_{p}":'), F.format_string("%.4f", ((k * m) % 100) / 1000.0)) for p, m in (("afr", 3), ("eas", 7), ("fin", 11))
    ])
    return t.events.select(
        "event_id", k.alias("k"), ty.alias("ty"),
        F.concat(F.lit('{"dbnsfp":{"revel":{"score":'), score, F.lit('},"am":{"pred":"'), F.coalesce(pred, F.lit("")),
                 F.lit('"}},"'), F.when(ty == "signup", "gnomad_exome").otherwise("gnomad_genome"),
                 F.lit('":{"af":{"af":0.5,'), pops, F.lit('},"ac":{"ac":'), k.cast("string"), F.lit("}}}")).alias("doc"),
    )


@query("p19_nested_metrics", """
WITH e AS (SELECT event_id, event_type AS ty, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CAST(k AS DOUBLE) AS score, CASE ty WHEN 'view' THEN 'likely_pathogenic' WHEN 'click' THEN 'likely_benign' WHEN 'error' THEN 'ambiguous' END AS pred_class FROM e""")
def _(t):
    pred = text.blank_to_null(text.first_scalar("doc", "$.dbnsfp.am.pred"))
    return _nested(t).select("event_id", text.to_float(text.first_scalar("doc", "$.dbnsfp.revel.score")).alias("score"),
                             text.prediction_class(pred).alias("pred_class"))


@query("p20_popmax", """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
f AS (SELECT event_id, k, ((k * 3) % 100) / 1000.0 AS a, ((k * 7) % 100) / 1000.0 AS b, ((k * 11) % 100) / 1000.0 AS c FROM e)
SELECT event_id, CAST(greatest(a, b, c) AS DOUBLE) AS popmax_af, CASE WHEN a >= b AND a >= c THEN 'afr' WHEN b >= c THEN 'eas' ELSE 'fin' END AS popmax_pop,
  CAST(0.5 AS DOUBLE) AS af_global, k AS ac FROM f""")
def _(t):
    f = text.population_frequency("doc", order=("afr", "eas", "fin"))
    return _nested(t).select("event_id", f.alias("f")).select("event_id", "f.popmax_af", "f.popmax_pop", "f.af_global", "f.ac")


@query("p21_is_marker", """
WITH m AS (SELECT DISTINCT p_size * 40 AS pos, CASE WHEN p_size % 2 = 0 THEN substr('ACGT', CAST(1 + p_size % 4 AS INT), 1) END AS alt FROM part)
SELECT vid, COALESCE(bool_or(m.alt = v.alt OR (m.alt IS NULL AND m.pos IS NOT NULL AND v.alt = CASE v.ref WHEN 'A' THEN 'G' WHEN 'G' THEN 'A' WHEN 'C' THEN 'T' WHEN 'T' THEN 'C' END)), false) AS is_marker
FROM prx_variant v LEFT JOIN m ON m.pos = v.pos GROUP BY vid""")
def _(t):
    from ..operators.lookup import is_marker

    markers = t.part.select((C("p_size") * 40).cast("bigint").alias("pos"), F.when(
        C("p_size") % 2 == 0, F.substring(F.lit("ACGT"), (C("p_size") % 4 + 1).cast("int"), F.lit(1))).alias("alt"))
    return is_marker(t.variant, markers).select("vid", "is_marker")


@query("p22_support_level", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_quantity < 10 THEN 'none' WHEN l_quantity < 20 THEN 'single_species' ELSE 'multi_species' END AS level FROM lineitem""")
def _(t):
    n = F.when(C("l_returnflag") != "A", F.floor(C("l_quantity") / 10))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rules.support_level(n).alias("level"))


@query("p23_prefer_genomic_map", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN l_returnflag = 'A' THEN NULL ELSE 1 - l_discount END) IS NULL OR 1 - l_discount < 0.9 OR 1 - l_tax < 0.95 AS prefer FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rules.prefer_genomic_map(
        F.when(C("l_returnflag") != "A", 1 - C("l_discount")), 1 - C("l_tax")).alias("prefer"))


def codon_map_sql(table):
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in protein.codon_map(table).items()) + "}"


@query("p24_translate_codon", f"""
WITH c AS (SELECT gene, species, unnest(range(length(seq) // 3)) AS i, seq FROM prx_codon WHERE length(seq) >= 3),
d AS (SELECT gene, i, substr(seq, i * 3 + 1, 3) AS codon, count(*) AS n FROM c GROUP BY 1, 2, 3)
SELECT gene, i, codon, CASE WHEN codon = '---' THEN '-' ELSE COALESCE({codon_map_sql(1)}[codon], 'X') END AS aa_standard,
 CASE WHEN codon = '---' THEN '-' ELSE COALESCE({codon_map_sql(2)}[codon], 'X') END AS aa_mito, n FROM d""")
def _(t):
    from ..operators.alignment import explode_codons

    return explode_codons(t.codon).groupBy("gene", "i", "codon").agg(F.count(F.lit(1)).alias("n")).select(
        "gene", "i", "codon", protein.translate_codon("codon", 1).alias("aa_standard"),
        protein.translate_codon("codon", 2).alias("aa_mito"), "n")


@query("p25_translate_sequence", f"""
WITH c AS (SELECT species, unnest(range(length(seq) // 3)) AS i, seq FROM prx_codon WHERE length(seq) % 3 = 0 AND length(seq) > 0),
d AS (SELECT species, i, substr(seq, i * 3 + 1, 3) AS codon FROM c),
p AS (SELECT species, string_agg(CASE WHEN codon = '---' THEN '-' ELSE COALESCE({codon_map_sql(1)}[codon], 'X') END, '' ORDER BY i) AS protein FROM d GROUP BY 1)
SELECT a.species, a.gene, md5(p.protein) AS protein_md5, length(a.seq) % 3 = 0 AS ok FROM prx_codon a LEFT JOIN p USING (species)""")
def _(t):
    return t.codon.select("species", "gene", F.md5(protein.translate_sequence("seq")).alias("protein_md5"),
                          (F.length("seq") % 3 == 0).alias("ok"))


@query("p26_mutate_codon", """
WITH r AS (SELECT gene, replace(seq, '-', '') AS seq FROM prx_codon WHERE is_ref),
v AS (SELECT vid, pos, alt, ['en', 'de', 'fr', 'es'][CAST(1 + pkey % 4 AS INT)] AS gene, pos - (pos - 1) % 3 AS st FROM prx_variant)
SELECT vid, CASE WHEN length(alt) = 1 AND st + 2 <= length(seq) THEN substr(seq, st, pos - st) || alt || substr(seq, pos + 1, st + 2 - pos) END AS codon FROM v JOIN r USING (gene)""")
def _(t):
    return _on_reference(t).select("vid", protein.mutate_codon("seq", "pos", "alt").alias("codon"))


def _on_reference(t):
    """Variants beside the ungapped reference sequence of one of four genes."""
    ref = t.codon.where("is_ref").select(C("gene").alias("aln_gene"), F.translate("seq", "-", "").alias("seq"))
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    v = t.variant.withColumn("aln_gene", F.element_at(langs, (C("pkey") % 4 + 1).cast("int")))
    return v.join(ref, "aln_gene")


@query("p27_frame_consequence", f"""
WITH r AS (SELECT gene, replace(seq, '-', '') AS seq FROM prx_codon WHERE is_ref),
v AS (SELECT vid, pos, alt, ['en', 'de', 'fr', 'es'][CAST(1 + pkey % 4 AS INT)] AS gene, linestatus FROM prx_variant),
c AS (SELECT *, pos BETWEEN 100 AND 1500 AS inside, CASE WHEN linestatus = 'O' THEN pos - 100 + 1 ELSE 1500 - pos + 1 END AS cds FROM v JOIN r USING (gene)),
d AS (SELECT *, cds - (cds - 1) % 3 AS st FROM c),
e AS (SELECT *, CASE WHEN length(alt) <> 1 THEN 'not_single_base' WHEN NOT inside THEN 'position_outside_gene' WHEN cds > length(seq) THEN 'position_outside_sequence' WHEN st + 2 > length(seq) THEN 'partial_terminal_codon' END AS bad,
 substr(seq, st, 3) AS rc, substr(seq, st, cds - st) || alt || substr(seq, cds + 1, st + 2 - cds) AS ac FROM d),
f AS (SELECT *, CASE WHEN bad IS NULL THEN COALESCE({codon_map_sql(2)}[rc], 'X') ELSE '' END AS ref_aa, CASE WHEN bad IS NULL THEN COALESCE({codon_map_sql(2)}[ac], 'X') ELSE '' END AS alt_aa FROM e)
SELECT vid, COALESCE(bad, CASE WHEN ref_aa = 'X' OR alt_aa = 'X' THEN 'translation_failed' ELSE 'resolved' END) AS status,
 CASE WHEN bad IS NULL OR bad = 'partial_terminal_codon' THEN (cds - 1) // 3 + 1 END AS codon_index, ref_aa, alt_aa,
 CASE WHEN bad IS NULL THEN ref_aa || ((cds - 1) // 3 + 1) || alt_aa ELSE '' END AS aa_change,
 CASE WHEN bad IS NULL THEN ref_aa <> alt_aa AND alt_aa <> '*' END AS is_missense FROM f""")
def _(t):
    strand = F.when(C("linestatus") == "O", "+").otherwise("-")
    f = protein.frame_consequence("seq", "pos", F.lit(100), F.lit(1500), strand, "alt")
    return _on_reference(t).select("vid", f.alias("f")).select(
        "vid", "f.status", "f.codon_index", "f.ref_aa", "f.alt_aa", "f.aa_change", "f.is_missense")


CLASSES = ["electrostatic", "hbond", "hydrophobic", "vdw"]
MECHS = ["charge_reversal", "charge_rescue", "volume_swap", "polarity_swap", "same_direction", "unclassified"]


def _at(values, number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def at_sql(values, number):
    return f"[{', '.join(repr(v) for v in values)}][CAST(1 + ({number}) % {len(values)} AS INT)]"


SCORE_SQL = f"""(CASE WHEN best <= 0.01 THEN 3 WHEN best <= 0.05 THEN 2 WHEN best <= 0.10 THEN 1 ELSE 0 END
 + [3, 2, 1, 0][CAST(1 + ann_id % 4 AS INT)] + [3, 2, 1, 1, 0, 0][CAST(1 + pair_id % 6 AS INT)]
 + CASE timing WHEN 'contact_first' THEN 2 WHEN 'co_occurring' THEN 1 ELSE 0 END + CASE WHEN is_ancestral THEN 2 ELSE 0 END
 + CASE WHEN n_origins >= 10 THEN 2 WHEN n_origins >= 2 THEN 1 ELSE 0 END + CASE WHEN status = 'O' THEN 1 ELSE 0 END + CASE WHEN odds_ratio < 5.0 THEN 1 ELSE 0 END)"""
BEST_SQL = "SELECT *, COALESCE(CASE WHEN pagel_fdr IS NULL THEN branch_fdr WHEN branch_fdr IS NULL THEN pagel_fdr ELSE least(pagel_fdr, branch_fdr) END, fisher_fdr) AS best FROM prx_tested"


def _score():
    return rules.contact_score(
        "pagel_fdr", "branch_fdr", "fisher_fdr", _at(CLASSES, C("ann_id")), _at(MECHS, C("pair_id")), "timing", "is_ancestral",
        "n_origins", F.when(C("status") == "O", "high_confidence").otherwise("low"), "odds_ratio")


@query("p28_contact_score", f"WITH b AS ({BEST_SQL}) SELECT pair_id, {SCORE_SQL} AS score FROM b")
def _(t):
    return t.tested.select("pair_id", _score().alias("score"))


@query("p29_composite_score", f"""
WITH b AS ({BEST_SQL}), s AS (SELECT *, {SCORE_SQL} AS base, CASE WHEN status <> 'P' THEN odds_ratio END AS rescue, blosum AS dar, fisher_p * 100 AS pct, CASE WHEN pair_id % 3 = 0 THEN 'insufficient_meff' ELSE '' END AS note FROM b)
SELECT pair_id, base + CASE WHEN rescue > 1 AND dar > 1 THEN 2 ELSE 0 END + CASE WHEN pct > 75 AND note = '' THEN 1 ELSE 0 END AS composite,
 CASE WHEN rescue IS NULL THEN 'not_computed' WHEN rescue > 1 AND dar > 1 THEN 'strong' WHEN rescue > 0.5 OR dar > 0.5 THEN 'borderline' ELSE 'not_supported' END AS tier FROM s""")
def _(t):
    rescue, dar = F.when(C("status") != "P", C("odds_ratio")), C("blosum")
    note = F.when(C("pair_id") % 3 == 0, "insufficient_meff").otherwise("")
    return t.tested.select("pair_id", rules.composite_score(_score(), rescue, dar, C("fisher_p") * 100, note).alias("composite"),
                           rules.energy_tier(rescue, dar).alias("tier"))


@query("p30_epistasis", """
WITH s AS (SELECT pair_id, odds_ratio AS dar, blosum AS con, price / 30011 AS dbl, fisher_p AS s1, fisher_fdr AS s2, pagel_fdr AS s3 FROM prx_tested),
e AS (SELECT *, sqrt(s1 * s1 + s2 * s2 + s3 * s3) AS sd, dbl - (dar + con) AS epi FROM s)
SELECT pair_id, round(dar - dbl, 6) AS rescue, round(epi, 6) AS epistasis, round(sd, 6) AS sd, COALESCE(sd > 0 AND abs(epi) > 2 * sd, false) AS significant FROM e""")
def _(t):
    e = rules.epistasis("odds_ratio", "blosum", C("price") / 30011, "fisher_p", "fisher_fdr", "pagel_fdr")
    return t.tested.select("pair_id", e.alias("e")).select("pair_id", F.round("e.rescue", 6).alias("rescue"),
                                                           F.round("e.epistasis", 6).alias("epistasis"),
                                                           F.round("e.sd", 6).alias("sd"), "e.significant")


@query("p31_recommend", f"""
WITH s AS (SELECT *, {at_sql(CLASSES, 'ann_id')} AS cls, pair_id % 2 = 0 AS intra FROM prx_tested)
SELECT pair_id, CASE WHEN contact_type = 'mt-nuc' AND pagel_fdr IS NOT NULL THEN 'Co-IP pulldown + SDM + binding assay (mCSM-PPI2 validation recommended)'
 WHEN contact_type = 'mt-nuc' THEN 'Co-IP pulldown + SDM' WHEN intra AND cls IN ('electrostatic', 'hbond') THEN 'Thermal shift assay (DSF/nanoDSF) + SDM'
 WHEN NOT intra THEN 'SEC-MALS + SDM + thermal shift' ELSE 'SDM + functional assay (CI/III/IV/V activity)' END AS assay FROM s""")
def _(t):
    return t.tested.select("pair_id", rules.recommend("contact_type", _at(CLASSES, C("ann_id")), C("pair_id") % 2 == 0, "pagel_fdr").alias("assay"))


GROUP_SQL = "CASE WHEN {0} IN ('R','K','H') THEN 'positive' WHEN {0} IN ('D','E') THEN 'negative' WHEN {0} IN ('S','T','N','Q','Y','C') THEN 'polar' ELSE 'nonpolar' END"
VOL_SQL = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in protein.VOLUME.items()) + "}"


@query("p32_complementarity", f"""
WITH v AS (SELECT vid, ref_aa AS dr, alt_aa AS da, substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + okey % 20 AS INT), 1) AS cr, substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + (okey // 20) % 20 AS INT), 1) AS ca FROM prx_variant),
g AS (SELECT *, {GROUP_SQL.format('dr')} AS g1, {GROUP_SQL.format('da')} AS g2, {GROUP_SQL.format('cr')} AS g3, {GROUP_SQL.format('ca')} AS g4,
 {VOL_SQL}[da] - {VOL_SQL}[dr] AS v1, {VOL_SQL}[ca] - {VOL_SQL}[cr] AS v2 FROM v),
h AS (SELECT *, (g1 <> 'nonpolar') AS p1, (g2 <> 'nonpolar') AS p2, (g3 <> 'nonpolar') AS p3, (g4 <> 'nonpolar') AS p4 FROM g)
SELECT vid, g2 AS dar_group, CASE WHEN dr = da OR cr = ca THEN 'unclassified'
 WHEN g1 IN ('positive','negative') AND g2 IN ('positive','negative') AND g1 <> g2 AND g3 IN ('positive','negative') AND g4 IN ('positive','negative') AND g3 <> g4 AND g2 <> g4 THEN 'charge_reversal'
 WHEN g1 <> g2 AND g3 <> g4 THEN 'charge_rescue' WHEN abs(v1) > 20 AND abs(v2) > 20 AND v1 * v2 < 0 THEN 'volume_swap'
 WHEN p1 <> p2 AND p3 <> p4 AND p2 <> p4 THEN 'polarity_swap' WHEN p1 <> p2 AND p3 <> p4 THEN 'same_direction' ELSE 'unclassified' END AS mechanism FROM h""")
def _(t):
    from .tables import AA, _pick

    con = (_pick(AA, C("okey")), _pick(AA, F.floor(C("okey") / 20)))
    return t.variant.select("vid", protein.charge_group("alt_aa").alias("dar_group"),
                            protein.complementarity("ref_aa", "alt_aa", *con).alias("mechanism"))


@query("p33_refine_timing", """
WITH s AS (SELECT pair_id, timing, CASE WHEN status <> 'P' THEN blosum END AS b FROM prx_tested)
SELECT pair_id, CASE WHEN b IS NULL THEN timing WHEN timing = 'co_occurring' THEN CASE WHEN b >= 1 THEN 'permissive_background' ELSE 'co_adaptation' END
 WHEN timing = 'no_contact_change' AND b >= 1 THEN 'constitutively_permissive' ELSE timing END AS refined FROM s""")
def _(t):
    return t.tested.select("pair_id", rules.refine_timing("timing", F.when(C("status") != "P", C("blosum"))).alias("refined"))


@query("p34_phys_metrics", f"""
WITH m AS ({MATRIX_SQL}), v AS (SELECT vid, CASE WHEN line = 1 THEN '-' ELSE ref_aa END AS a, alt_aa AS b FROM prx_variant)
SELECT vid, CASE WHEN a = '-' THEN NULL WHEN a = b THEN COALESCE(m.score, 0) ELSE m.score END AS similarity,
 CASE WHEN a = '-' THEN NULL WHEN a = b THEN 0 ELSE m.score END AS distance FROM v LEFT JOIN m ON m.ref = a AND m.alt = b""")
def _(t):
    from ..operators.lookup import phys_metrics

    m = _matrix(t)
    src = t.variant.select("vid", F.when(C("line") == 1, "-").otherwise(C("ref_aa")).alias("a"), C("alt_aa").alias("b"))
    return phys_metrics(src, "a", "b", m, m).select("vid", "similarity", "distance")


@query("p35_directional_class", """
WITH s AS (SELECT ann_id, bool_or(is_ancestral) AS anc, count(*) FILTER (timing = 'contact_first' AND n_origins > 7) AS f, count(*) FILTER (timing = 'co_occurring' AND status = 'F') AS c,
 count(*) FILTER (timing = 'contact_after' AND status = 'P') AS a, count(*) FILTER (timing = 'no_contact_change') AS n FROM prx_tested GROUP BY 1)
SELECT ann_id, CASE WHEN anc THEN 'ancestral_cdav_not_directional' WHEN f + c + a = 0 THEN CASE WHEN n > 0 THEN 'no_detected_partner_change' ELSE 'ambiguous_no_origin' END
 WHEN f > 0 AND c = 0 AND a = 0 THEN 'permissive_background' WHEN a > 0 AND f = 0 AND c = 0 THEN 'responding_secondary'
 WHEN c > 0 AND f = 0 AND a = 0 THEN 'co_occurring_unresolved' ELSE 'mixed_timing' END AS direction FROM s""")
def _(t):
    tm = C("timing")
    s = t.tested.groupBy("ann_id").agg(
        F.bool_or("is_ancestral").alias("anc"), F.count_if((tm == "contact_first") & (C("n_origins") > 7)).alias("f"),
        F.count_if((tm == "co_occurring") & (C("status") == "F")).alias("c"),
        F.count_if((tm == "contact_after") & (C("status") == "P")).alias("a"), F.count_if(tm == "no_contact_change").alias("n"))
    return s.select("ann_id", rules.directional_class("anc", "f", "c", "a", "n").alias("direction"))


SIG_SQL = "NOT low_power AND COALESCE(best <= 0.10, false)"


@query("p36_is_significant", f"WITH b AS ({BEST_SQL}) SELECT pair_id, {SIG_SQL} AS significant FROM b")
def _(t):
    return t.tested.select("pair_id", rules.is_significant("low_power", "pagel_fdr", "branch_fdr", "fisher_fdr").alias("significant"))


@query("p37_evidence_flags", """
SELECT pair_id, NOT low_power AND pagel_fdr IS NULL AND branch_fdr IS NULL AND fisher_fdr <= 0.1 AS fisher_only,
 NOT low_power AND COALESCE(branch_fdr <= 0.1, false) AS branch_sig, NOT low_power AND COALESCE(pagel_fdr <= 0.1, false) AS pagel_sig,
 NOT low_power AND pagel_fdr IS NOT NULL AS pagel_tested, NOT low_power AND fisher_fdr <= 0.1 AS fisher_sig,
 NOT low_power AND (pagel_fdr IS NOT NULL OR branch_fdr IS NOT NULL) AS multi_origin FROM prx_tested""")
def _(t):
    return t.tested.select("pair_id", rules.evidence_flags("low_power", "pagel_fdr", "branch_fdr", "fisher_fdr").alias("e")).select("pair_id", "e.*")


STATUSES = ["structural_ineligible", "secondary_not_attempted_no_primary_support", "missing_structure_file", "position_not_in_enst",
            "no_chain_in_pdb", "anchor_window_exhausted", "large_offset_candidate_+12", "extended_offset_rescue_-3", "isoform_offset_2", "ok", "odd"]


@query("p38_status_category", f"""
WITH s AS (SELECT pair_id, {at_sql(STATUSES, 'pair_id')} AS st, CASE WHEN status = 'F' THEN 'proxy' ELSE '' END AS proxy, CASE WHEN status = 'O' THEN 'structurally_unrepresented' END AS elig FROM prx_tested)
SELECT pair_id, CASE WHEN st = 'structural_ineligible' THEN st WHEN st LIKE 'secondary%' THEN 'secondary_not_attempted' WHEN st = 'missing_structure_file' THEN 'missing_model_file'
 WHEN st = 'position_not_in_enst' THEN 'sequence_model_mismatch' WHEN st = 'no_chain_in_pdb' THEN CASE WHEN proxy <> '' THEN 'isoform_proxy_gap' WHEN elig IS NOT NULL THEN 'gene_unrepresented_in_panel' ELSE 'chain_assignment_or_model_gap' END
 WHEN st = 'anchor_window_exhausted' THEN 'residue_anchoring_failure' WHEN st LIKE 'large%' THEN 'mature_offset_candidate' WHEN st LIKE 'extended%' THEN 'mapped_with_extended_offset_rescue'
 WHEN st LIKE 'isoform%' THEN 'mapped_with_isoform_offset' WHEN st = 'ok' THEN 'mapped_direct' ELSE 'other' END AS category FROM s""")
def _(t):
    return t.tested.select("pair_id", rules.status_category(
        _at(STATUSES, C("pair_id")), F.when(C("status") == "F", "proxy").otherwise(""),
        F.when(C("status") == "O", "structurally_unrepresented")).alias("category"))


@query("p39_anchor_failure_class", """
WITH s AS (SELECT pair_id, pair_id AS pos, CASE WHEN status = 'F' THEN pair_id + 1 END AS d, CASE WHEN pair_id % 3 = 0 THEN pair_id - 12 + ann_id % 20 END AS e,
 a_mt AS mapped, ann_id % 60 AS near, dar_gene AS r, contact_gene AS f FROM prx_tested)
SELECT pair_id, CASE WHEN d IS NOT NULL THEN 'anchored_default_window' WHEN e IS NOT NULL THEN 'large_offset_candidate_' || CASE WHEN e >= pos THEN '+' ELSE '-' END || abs(e - pos)
 WHEN NOT mapped AND near <= 3 THEN 'unresolved_structure_segment_candidate' WHEN NOT mapped AND near <= 40 THEN 'possible_large_offset_or_gap' WHEN NOT mapped THEN 'unmapped_reference_position'
 WHEN left(r, 1) <> left(f, 1) THEN 'reference_sequence_conflict' ELSE 'anchor_window_exhausted' END AS failure FROM s""")
def _(t):
    pos = C("pair_id")
    return t.tested.select("pair_id", rules.anchor_failure_class(
        pos, F.left(C("dar_gene"), F.lit(1)), F.left(C("contact_gene"), F.lit(1)), "a_mt", F.when(C("status") == "F", pos + 1),
        F.when(pos % 3 == 0, pos - 12 + C("ann_id") % 20), C("ann_id") % 60, F.lit(40)).alias("failure"))


@query("p40_reconciliation_status", """
WITH s AS (SELECT pair_id AS id, NOT a_mt AS nuc, b_mt AS has_map, pair_id AS pos, CASE WHEN b_mt AND status = 'F' THEN pair_id WHEN b_mt AND status = 'O' THEN pair_id + 3 END AS m FROM prx_tested)
SELECT id AS pair_id, CASE WHEN NOT nuc THEN 'mt_native' WHEN NOT has_map THEN 'no_transcript_map' WHEN m IS NULL THEN 'position_not_in_enst' WHEN m = pos THEN 'transcript_identity' ELSE 'transcript_remapped' END AS status,
 CASE WHEN nuc AND has_map THEN m - pos WHEN nuc THEN 0 END AS delta FROM s""")
def _(t):
    pos = C("pair_id")
    m = F.when(C("b_mt") & (C("status") == "F"), pos).when(C("b_mt") & (C("status") == "O"), pos + 3)
    nuc = ~C("a_mt")
    mapped = F.when(C("b_mt"), m).otherwise(pos)
    return t.tested.select("pair_id", rules.reconciliation_status(nuc, C("b_mt"), pos, m).alias("status"),
                           F.when(nuc, mapped - pos).alias("delta"))


@query("p41_contact_type", """
SELECT pair_id, contact_type, CASE WHEN a_mt AND NOT b_mt THEN 'mt_dar_nuc_contact' WHEN b_mt AND NOT a_mt THEN 'nuc_dar_mt_contact' END AS direction,
 CASE contact_type WHEN 'mt-mt' THEN 'mtDNA' ELSE 'nucDNA' END AS contact_genome FROM prx_tested""")
def _(t):
    return t.tested.select("pair_id", rules.contact_type("a_mt", "b_mt").alias("contact_type"), rules.direction_label("a_mt", "b_mt").alias("direction"),
                           rules.infer_contact_genome(F.when(C("a_mt"), "mtDNA").otherwise("nucDNA"), "contact_type").alias("contact_genome"))


@query("p42_strip_tip_suffix", """
SELECT c_custkey, 'Genus_' || c_custkey || CASE WHEN c_nationkey % 3 = 0 THEN '_sub' ELSE '' END AS name FROM customer""")
def _(t):
    tip = F.concat(F.lit("Genus_"), C("c_custkey").cast("string"), F.when(C("c_nationkey") % 3 == 0, "_sub").otherwise(""),
                   F.when(C("c_nationkey") % 2 == 0, F.concat(F.lit("_FAM_"), C("c_mktsegment"))).otherwise(""))
    return t.customer.select("c_custkey", text.strip_tip_suffix(tip).alias("name"))


@query("p43_allele_consistency", """
SELECT vid, CASE WHEN line = 7 THEN NULL ELSE ref = CASE WHEN status = 'F' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END END AS ref_equal FROM prx_variant""")
def _(t):
    coding = F.when(C("status") == "F", F.translate("ref", "ACGT", "TGCA")).otherwise(C("ref"))
    return t.variant.select("vid", rules.allele_consistency(F.when(C("line") == 7, " ").otherwise(C("ref")), F.lower(coding)).alias("ref_equal"))


@query("p44_match_key", """
SELECT vid, CASE WHEN genome = 'mtDNA' AND line <> 7 THEN gene || '|' || pos || '|' || ref || '|' || alt END AS match_key FROM prx_variant""")
def _(t):
    alt = F.when(C("line") == 7, "").otherwise(C("alt"))
    return t.variant.select("vid", rules.match_key(rules.encoded_by("gene"), "gene", "pos", "ref", alt).alias("match_key"))


@query("p45_categorize_change", r"""
SELECT vid, CASE WHEN aa_change = '' THEN 'Missing' WHEN aa_change = 'noncoding' THEN 'Noncoding' WHEN aa_change = 'frameshift' THEN 'Frameshift' WHEN contains(aa_change, '*') THEN 'Nonsense'
 WHEN ref_aa = alt_aa THEN 'Synonymous' WHEN line = 7 THEN 'Other' ELSE 'Missense' END AS category FROM prx_variant""")
def _(t):
    raw = F.when((C("line") == 7) & (C("ref_aa") != C("alt_aa")), F.concat(F.lit("?"), C("aa_change"))).otherwise(C("aa_change"))
    return t.variant.select("vid", text.categorize_change(raw).alias("category"))


ORIGIN_BINS = [(1, 1, "1"), (2, 5, "2-5"), (6, 10, "6-10"), (11, None, ">10")]
MEFF_BINS = [(0, 0.2, "(0,0.2]"), (0.2, 0.6, "(0.2,0.6]"), (0.6, None, ">0.6")]


@query("p46_bin_label", """
SELECT pair_id, CASE WHEN n_origins = 1 THEN '1' WHEN n_origins BETWEEN 2 AND 5 THEN '2-5' WHEN n_origins BETWEEN 6 AND 10 THEN '6-10' WHEN n_origins >= 11 THEN '>10' END AS origin_bin,
 CASE WHEN fisher_p > 0 AND fisher_p <= 0.2 THEN '(0,0.2]' WHEN fisher_p > 0.2 AND fisher_p <= 0.6 THEN '(0.2,0.6]' WHEN fisher_p > 0.6 THEN '>0.6' END AS meff_bin FROM prx_tested""")
def _(t):
    return t.tested.select("pair_id", rules.bin_label("n_origins", ORIGIN_BINS).alias("origin_bin"),
                           rules.bin_label("fisher_p", MEFF_BINS, closed="right").alias("meff_bin"))


@query("p47_warning_reasons", """
SELECT pair_id, nullif(concat_ws('|', CASE WHEN a_mt THEN 'exception_applied' END, CASE WHEN b_mt THEN 'REF_ALLELE_MISMATCH' END), '') AS reasons FROM prx_tested""")
def _(t):
    return t.tested.select("pair_id", rules.warning_reasons(exception_applied="a_mt", REF_ALLELE_MISMATCH="b_mt").alias("reasons"))


@query("p48_normalize_coord_key", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS coord FROM orders")
def _(t):
    raw = F.when(C("o_orderkey") % 2 == 0, F.concat(C("o_orderkey").cast("string"), F.lit(".0"))).otherwise(C("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", text.coord_key(raw).alias("coord"))


@query("p49_sanitize_sequence", """
SELECT species, md5(translate(seq, 'XZQ', '---')) AS clean_md5, CASE WHEN is_ref THEN 'Homo_sapiens|9606|hs | ' || gene ELSE source || '|' || COALESCE(n_name, 'UNKNOWN') || '|' || species || ' | ' || gene END AS new_header
FROM prx_aln LEFT JOIN nation ON source = 'src' || n_nationkey AND n_nationkey % 3 <> 1""")
def _(t):
    from ..operators.alignment import rewrite_header

    ids = t.nation.where("n_nationkey % 3 <> 1").select(F.concat(F.lit("src"), "n_nationkey").alias("species"), C("n_name").alias("taxid"))
    src = t.aln.withColumns({"acc": F.when(C("is_ref"), "hs").otherwise(C("species").cast("string")), "seq_id": C("species"),
                             "species": F.when(C("is_ref"), "Homo_sapiens").otherwise(C("source"))})
    return rewrite_header(src, ids).select(C("seq_id").alias("species"), F.md5(text.sanitize_sequence("seq", "XZQ")).alias("clean_md5"), "new_header")


@query("p50_first_non_null", """
SELECT pair_id, COALESCE(CASE WHEN status = 'F' THEN dar_gene END, CASE WHEN a_mt THEN nullif(contact_gene, '') END, complex_id) AS value FROM prx_tested""")
def _(t):
    return t.tested.select("pair_id", text.first_non_null(F.when(C("status") == "F", C("dar_gene")).otherwise(""),
                                                         F.when(C("a_mt"), C("contact_gene")), "complex_id").alias("value"))


@query("p51_strip_version", "SELECT vid, CASE WHEN line <= 5 THEN 'NM_' || (1000 + skey) END AS tx FROM prx_variant")
def _(t):
    return t.variant.select("vid", text.transcript_from_name(_name()).alias("tx"))


@query("p52_feature_extract", """
WITH e AS (SELECT event_id, event_type AS ty, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE ty WHEN 'view' THEN 'Transit peptide' WHEN 'click' THEN 'Signal peptide' WHEN 'error' THEN 'Transit peptide' END AS feature_type,
 CASE ty WHEN 'view' THEN k WHEN 'click' THEN k + 1 WHEN 'error' THEN k END AS feature_end, CASE ty WHEN 'view' THEN k + 1 WHEN 'click' THEN k + 2 WHEN 'error' THEN k + 1 ELSE 1 END AS mature_start,
 CASE ty WHEN 'view' THEN k WHEN 'click' THEN k + 1 WHEN 'error' THEN k ELSE 0 END AS mature_offset,
 CASE ty WHEN 'view' THEN 'ECO:1|PubMed|' || k WHEN 'click' THEN 'ECO:2|' || 'text' WHEN 'error' THEN 'manual_no_code' END AS evidence FROM e""")
def _(t):
    k = F.coalesce(text.first_scalar("props", "$.k"), F.lit("0"))
    k1 = (k.cast("bigint") + 1).cast("string")

    def feat(kind, end, ev):
        return F.concat(F.lit('{"type":"' + kind + '","location":{"end":{"value":'), end, F.lit("}}"), F.lit(ev) if isinstance(ev, str) else ev, F.lit("}"))

    signal = feat("Signal peptide", k1, ',"evidences":[{"evidenceCode":"ECO:2","source":"text"}]')
    transit = feat("Transit peptide", k, F.concat(F.lit(',"evidences":[{"evidenceCode":"ECO:1","source":{"name":"PubMed","id":"'), k, F.lit('"}}]')))
    bare = feat("Transit peptide", k, "")
    ty = C("event_type")
    body = F.when(ty == "view", F.concat(signal, F.lit(","), transit)).when(ty == "click", signal).when(ty == "error", bare).otherwise("")
    doc = F.concat(F.lit('{"features":['), body, F.lit("]}"))
    return t.events.select("event_id", text.leader_feature(doc).alias("f")).select(
        "event_id", "f.feature_type", "f.feature_end", "f.mature_start", "f.mature_offset", "f.evidence")


@query("p53_resolve_name", """
WITH g AS (SELECT n_name AS symbol FROM nation), d AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'NATION_' || o_custkey % 30 END AS name,
 'chain of NATION_' || o_custkey % 12 || ' and NATION_' || o_orderkey % 40 || ' subunit' AS descr FROM orders),
w AS (SELECT o_orderkey, max_by(symbol, length(symbol) * 1000 - row_no) AS hit FROM (SELECT o_orderkey, symbol, rank() OVER (PARTITION BY o_orderkey ORDER BY symbol) AS row_no
 FROM d JOIN g ON symbol IN ('NATION_' || regexp_extract(descr, 'of NATION_(\\d+)', 1), 'NATION_' || regexp_extract(descr, 'and NATION_(\\d+)', 1))) GROUP BY 1)
SELECT d.o_orderkey, COALESCE(g.symbol, w.hit) AS symbol FROM d LEFT JOIN g ON g.symbol = d.name LEFT JOIN w ON w.o_orderkey = d.o_orderkey""")
def _(t):
    from ..operators.lookup import resolve_name

    cust, key = C("o_custkey"), C("o_orderkey")
    src = t.orders.select(
        "o_orderkey", F.when(C("o_orderstatus") == "F", F.concat(F.lit("NATION_"), (cust % 30).cast("string"))).alias("name"),
        F.concat(F.lit("chain of NATION_"), (cust % 12).cast("string"), F.lit(" and NATION_"), (key % 40).cast("string"), F.lit(" subunit")).alias("descr"))
    return resolve_name(src, "o_orderkey", "name", "descr", t.nation.select(C("n_name").alias("symbol")), "symbol").select("o_orderkey", C("resolved").alias("symbol"))


@query("p54_mutation_code", """
WITH s AS (SELECT vid, CASE WHEN line = 1 THEN '' ELSE '1abc' END AS pdb, CASE WHEN line = 2 THEN NULL ELSE left(gene, 1) END AS chain, CASE WHEN line = 3 THEN 'X' ELSE ref_aa END AS r, pos, alt_aa AS a FROM prx_variant)
SELECT vid, CASE WHEN pdb = '' THEN 'no_pdb' WHEN chain IS NULL THEN 'missing_coords' WHEN r = 'X' THEN 'invalid_aa' ELSE 'ok' END AS status, r || chain || pos || a AS single_code,
 r || chain || pos || a || ',' || a || chain || (pos + 1) || r AS double_code FROM s""")
def _(t):
    s = t.variant.select("vid", F.when(C("line") == 1, "").otherwise("1abc").alias("pdb"), F.when(C("line") != 2, F.left(C("gene"), F.lit(1))).alias("chain"),
                         F.when(C("line") == 3, "X").otherwise(C("ref_aa")).alias("r"), "pos", C("alt_aa").alias("a"))
    one, two = rules.mutation_code("r", "chain", "pos", "a"), rules.mutation_code("a", "chain", C("pos") + 1, "r")
    return s.select("vid", rules.mutation_status("pdb", "r", "chain", "pos", "a").alias("status"), one.alias("single_code"),
                    F.concat(one, F.lit(","), two).alias("double_code"))


@query("p55_strand_from_bounds", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey > l_suppkey * 20 THEN '-' ELSE '+' END AS strand, least(l_partkey, l_suppkey * 20) + 1 AS lo, greatest(l_partkey, l_suppkey * 20) AS hi FROM lineitem""")
def _(t):
    from ..sources.readers import strand_from_bounds

    src = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C("l_partkey").alias("start"), (C("l_suppkey") * 20).alias("end"))
    return strand_from_bounds(src, "start", "end", zero_based=True).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "strand", "lo", "hi")
