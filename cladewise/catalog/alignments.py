"""M: alignment columns, coordinate maps and co-variation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import ranking
from ..session import cut_lineage
from .registry import query

C = F.col


def cells(t):
    return al.explode_alignment(t.aln, "is_ref")


@query("m01_explode_alignment", "SELECT gene, species, count(*) AS n, CAST(sum(col * ascii(ch)) AS BIGINT) AS checksum FROM prx_cell GROUP BY 1, 2")
def _(t):
    return cells(t).groupBy("gene", "species").agg(F.count("*").alias("n"), F.sum(C("col").cast("bigint") * F.ascii("ch")).alias("checksum"))


@query("m02_position_map", """
SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY col) AS pos, col, ch FROM prx_cell WHERE is_ref AND ch NOT IN ('-', 'X', '!', '*')""")
def _(t):
    return al.position_map(al.reference_row(t.aln), "-X!*")


@query("m03_reference_row", "SELECT gene, species, header, md5(seq) AS seq_md5 FROM prx_aln WHERE is_ref")
def _(t):
    return al.reference_row(t.aln).select("gene", "species", "header", F.md5("seq").alias("seq_md5"))


GAPPED_SQL = """gp AS (SELECT a.species, r.seq AS a, a.seq AS b, unnest(range(least(length(r.seq), length(a.seq)))) AS i FROM prx_aln a JOIN prx_aln r ON r.gene = a.gene AND r.is_ref),
gc AS (SELECT species, i, substr(a, i + 1, 1) AS x, substr(b, i + 1, 1) AS y FROM gp),
gm AS (SELECT species, x, y, sum(CASE WHEN x <> '-' THEN 1 ELSE 0 END) OVER w AS f, sum(CASE WHEN y <> '-' THEN 1 ELSE 0 END) OVER w AS g FROM gc WINDOW w AS (PARTITION BY species ORDER BY i ROWS UNBOUNDED PRECEDING))"""


@query("m04_map_from_gapped_pair", f"""
WITH {GAPPED_SQL} SELECT species, count(*) AS n_positions, round(count(*) FILTER (x = y) / count(*), 6) AS identity_fraction, round(count(*) FILTER (y <> '-') / count(*), 6) AS coverage_fraction, CAST(COALESCE(sum(f * g) FILTER (y <> '-'), 0) AS BIGINT) AS checksum FROM gm WHERE x <> '-' GROUP BY 1""")
def _(t):
    ref = F.broadcast(al.reference_row(t.aln).select("gene", C("seq").alias("a")))
    m = al.map_from_gapped_pair(t.aln.join(ref, "gene").select("species", "a", C("seq").alias("b")), "species", "a", "b")
    out = al.map_quality(m, "species", checksum=F.coalesce(F.sum(C("pos_from") * C("pos_to")), F.lit(0)))
    return out.withColumns({c: F.round(c, 6) for c in ("identity_fraction", "coverage_fraction")})


@query("m05_cds_map", """
WITH e AS (SELECT gene, CASE WHEN CAST(substr(gene, 7) AS INT) % 2 = 0 THEN '+' ELSE '-' END AS strand, unnest(range(start_pos, start_pos + 31)) AS p FROM prx_interval),
n AS (SELECT gene, p, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN strand = '+' THEN p ELSE -p END) AS c FROM e WHERE p BETWEEN 512 AND 4510) SELECT gene, p AS genomic_pos, c AS cds_pos, (c - 1) // 3 + 1 AS aa_pos FROM n""")
def _(t):
    ex = t.interval.select("gene", F.when(F.substring("gene", 7, 9).cast("int") % 2 == 0, "+").otherwise("-").alias("strand"), C("start_pos").alias("start"),
                           (C("start_pos") + 30).alias("end"), F.lit(512).alias("cds_low"), F.lit(4510).alias("cds_high"))
    return al.cds_map(ex)


@query("m06_column_entropy", """
WITH n AS (SELECT gene, col, ch, count(*) AS n FROM prx_cell GROUP BY 1, 2, 3), t AS (SELECT gene, col, CAST(COALESCE(sum(n) FILTER (ch NOT IN ('-', 'X', '!', '*')), 0) AS BIGINT) AS t, sum(n * ln(n)) FILTER (ch NOT IN ('-', 'X', '!', '*')) AS s FROM n GROUP BY 1, 2)
SELECT gene, col, t AS n_residues, CASE WHEN t = 0 THEN 0.0 ELSE round((ln(t) - s / t) / ln(20), 6) + 0.0 END AS entropy FROM t""")
def _(t):
    return al.column_entropy(cells(t)).withColumn("entropy", F.round("entropy", 6) + 0.0)


def drawn_sql(length: str, key: str, seed: str) -> str:
    """Column pairs by the number a hash draws: i < j over a gene's whole length. ``key`` holds (gene, draw) and is joined to ``length``."""
    return f"""
SELECT gene, draw, CAST(r - j * (j - 1) // 2 AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM (SELECT gene, draw, r, g - CAST(g * (g - 1) // 2 > r AS BIGINT) + CAST(g * (g + 1) // 2 <= r AS BIGINT) AS j
FROM (SELECT gene, draw, r, CAST(floor((1 + sqrt(1 + 8 * r)) / 2) AS BIGINT) AS g FROM (SELECT gene, draw, ('0x' || substr(md5(gene || '|' || draw || '|{seed}'), 1, 12))::BIGINT % (length * (length - 1) // 2) AS r
FROM {key} JOIN {length} USING (gene) WHERE length > 1)))"""


STATE = "CASE WHEN {0} IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y') THEN {0} ELSE '-' END"


def mi_sql(aln: str, pairs: str, name: str = "mi") -> str:
    """Views that end in ``name`` (gene, i, j, mi) over the distinct ``pairs`` of an alignment."""
    n = name
    return f"""{n}_p AS (SELECT DISTINCT gene, i, j FROM {pairs}), {n}_c AS (SELECT s.gene, i, j, substr(seq, CAST(i + 1 AS INT), 1) AS x, substr(seq, CAST(j + 1 AS INT), 1) AS y FROM {aln} s JOIN {n}_p p ON p.gene = s.gene),
{n}_s AS (SELECT gene, i, j, {STATE.format('x')} AS a, {STATE.format('y')} AS b, count(*) AS n FROM {n}_c GROUP BY ALL),
{n}_a AS (SELECT gene, i, j, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT gene, i, j, a, sum(n) AS n FROM {n}_s GROUP BY ALL) GROUP BY ALL),
{n}_b AS (SELECT gene, i, j, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT gene, i, j, b, sum(n) AS n FROM {n}_s GROUP BY ALL) GROUP BY ALL),
{n}_j AS (SELECT gene, i, j, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM {n}_s GROUP BY ALL),
{n} AS (SELECT gene, i, j, greatest(0.0, x.h + y.h - z.h) AS mi FROM {n}_j z JOIN {n}_a x USING (gene, i, j) JOIN {n}_b y USING (gene, i, j))"""


LENGTH_SQL = "ln AS (SELECT gene, max(length(seq)) AS length FROM prx_aln GROUP BY 1)"
#: A pair of columns for every supplier, in one of the four genes, anywhere in it.
ASKED_SQL = f"""{LENGTH_SQL}, ak AS (SELECT ['en', 'de', 'fr', 'es'][CAST(1 + s_suppkey % 4 AS INT)] AS gene, s_suppkey AS draw FROM supplier), ask AS ({drawn_sql('ln', 'ak', 'asked')})"""
#: Five thousand drawn pairs a gene, and a background of five hundred, both over the genes' whole length.
MEANS_SQL = f"md AS (SELECT gene, unnest(range(5000)) AS draw FROM ln), mp AS ({drawn_sql('ln', 'md', 'means')})"
BACKGROUND_SQL = f"bd AS (SELECT gene, unnest(range(500)) AS draw FROM ln), bk AS ({drawn_sql('ln', 'bd', 'background')})"


def draws(t, n):
    return al.lengths(t.aln).select("gene", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))


def asked(t):
    """A column pair for every supplier, in one of the four genes."""
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    keys = t.supplier.select(F.element_at(langs, (C("s_suppkey") % 4 + 1).cast("int")).alias("gene"), C("s_suppkey").alias("draw"))
    return al.draw_pairs(al.lengths(t.aln), keys, "draw", "asked")


@query("m07_mutual_information", f"WITH {ASKED_SQL}, {mi_sql('prx_aln', 'ask')} SELECT gene, i, j, round(mi, 6) AS mi FROM mi")
def _(t):
    return al.mutual_information(t.aln, asked(t)).withColumn("mi", F.round("mi", 6))


def apc_sql(mi: str, name: str) -> str:
    n = name
    return f"{n}_e AS (SELECT gene, i AS col, mi FROM {mi} UNION ALL SELECT gene, j, mi FROM {mi}), {n}_r AS (SELECT gene, col, avg(mi) AS m FROM {n}_e GROUP BY 1, 2), {n}_g AS (SELECT gene, avg(mi) AS gm FROM {mi} GROUP BY 1)"


#: Every column pair of the short alignments: names, brands and types of parts, and addresses of pages.
EVERY_SQL = f"""wl AS (SELECT gene, max(length(seq)) AS length FROM prx_word GROUP BY 1), wi AS (SELECT gene, length, unnest(range(length)) AS i FROM wl), wp AS (SELECT gene, i, unnest(range(i + 1, length)) AS j FROM wi),
{mi_sql('prx_word', 'wp', 'wm')}, {apc_sql('wm', 'wa')}"""


@query("m08_apc_stats", f"WITH {EVERY_SQL} SELECT gene, col, round(m, 6) AS mean_mi, round(gm, 6) AS grand_mean FROM wa_r JOIN wa_g USING (gene)")
def _(t):
    row_means, grand = al.apc_stats(cut_lineage(al.all_information(t.word)))
    return row_means.join(grand, "gene").select("gene", "col", F.round("mean_mi", 6).alias("mean_mi"), F.round("grand_mean", 6).alias("grand_mean"))


@query("m08b_apc_stats_drawn", f"WITH {LENGTH_SQL}, {MEANS_SQL}, {mi_sql('prx_aln', 'mp')}, {apc_sql('mi', 'ma')} SELECT gene, col, round(m, 6) AS mean_mi, round(gm, 6) AS grand_mean FROM ma_r JOIN ma_g USING (gene)")
def _(t):
    row_means, grand = al.apc_stats(cut_lineage(_drawn(t)))
    return row_means.join(grand, "gene").select("gene", "col", F.round("mean_mi", 6).alias("mean_mi"), F.round("grand_mean", 6).alias("grand_mean"))


def _drawn(t):
    return al.mutual_information(t.aln, al.draw_pairs(al.lengths(t.aln), draws(t, 5000), "draw", "means"))


@query("m09_apc_correct", f"""
WITH {EVERY_SQL} SELECT wm.gene, i, j, round(CASE WHEN gm = 0 THEN mi ELSE mi - r1.m * r2.m / gm END, 6) + 0.0 AS mi_apc FROM wm JOIN wa_g USING (gene) JOIN wa_r r1 ON r1.gene = wm.gene AND r1.col = i JOIN wa_r r2 ON r2.gene = wm.gene AND r2.col = j""")
def _(t):
    mi = cut_lineage(al.all_information(t.word))
    return al.apc_correct(mi, *al.apc_stats(mi)).select("gene", "i", "j", (F.round("mi_apc", 6) + 0.0).alias("mi_apc"))


#: Every column of a part's name against every column of its brand and its type.
BETWEEN_SQL = f"""{EVERY_SQL}, xp AS (SELECT a.gene, a.i, b.gene AS gene_b, b.i AS j FROM wi a JOIN wi b ON a.gene = 'name' AND b.gene IN ('brand', 'type')),
xc AS (SELECT xp.*, {STATE.format('substr(s.seq, CAST(xp.i + 1 AS INT), 1)')} AS a, {STATE.format('substr(z.seq, CAST(xp.j + 1 AS INT), 1)')} AS b FROM xp JOIN prx_word s ON s.gene = xp.gene JOIN prx_word z ON z.gene = xp.gene_b AND z.species = s.species),
xs AS (SELECT gene, i, gene_b, j, a, b, count(*) AS n FROM xc GROUP BY ALL),
xa AS (SELECT gene, i, gene_b, j, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT gene, i, gene_b, j, a, sum(n) AS n FROM xs GROUP BY ALL) GROUP BY ALL),
xb AS (SELECT gene, i, gene_b, j, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT gene, i, gene_b, j, b, sum(n) AS n FROM xs GROUP BY ALL) GROUP BY ALL),
xj AS (SELECT gene, i, gene_b, j, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM xs GROUP BY ALL),
xm AS (SELECT gene, i, gene_b, j, greatest(0.0, xa.h + xb.h - xj.h) AS mi FROM xj JOIN xa USING (gene, i, gene_b, j) JOIN xb USING (gene, i, gene_b, j))"""


@query("m09b_apc_correct_between", f"""
WITH {BETWEEN_SQL} SELECT xm.gene, xm.i, gene_b, xm.j, round(mi, 6) + 0.0 AS mi, round(CASE WHEN g1.gm + g2.gm = 0 THEN mi ELSE mi - r1.m * r2.m / ((g1.gm + g2.gm) / 2) END, 6) + 0.0 AS mi_apc
FROM xm JOIN wa_g g1 ON g1.gene = xm.gene JOIN wa_g g2 ON g2.gene = gene_b JOIN wa_r r1 ON r1.gene = xm.gene AND r1.col = xm.i JOIN wa_r r2 ON r2.gene = gene_b AND r2.col = xm.j""")
def _(t):
    cols = al.lengths(t.word).select("gene", F.explode(F.sequence(F.lit(0).cast("bigint"), C("length") - 1)).alias("col"))
    other = cols.where("gene IN ('brand', 'type')").select(F.lit("name").alias("gene"), C("gene").alias("gene_b"), C("col").alias("j"))
    pairs = cols.where("gene = 'name'").withColumnRenamed("col", "i").join(other, "gene")
    mi = al.mutual_information_between(t.word, pairs)
    out = al.apc_correct(mi, *al.apc_stats(cut_lineage(al.all_information(t.word))))
    return out.select("gene", "i", "gene_b", "j", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mi", "mi_apc")])


@query("m10_background_mi", f"""
WITH {ASKED_SQL}, {BACKGROUND_SQL}, {mi_sql('prx_aln', 'ask')}, {mi_sql('prx_aln', 'bk', 'bm')}, v AS (SELECT gene, i, j, round(mi, 9) AS v FROM mi), w AS (SELECT gene, round(mi, 9) AS v FROM bk JOIN bm USING (gene, i, j))
SELECT v.gene, v.i, v.j, round(100.0::DOUBLE * count(*) FILTER (w.v < v.v) / count(*), 6) AS percentile FROM v JOIN w ON w.gene = v.gene GROUP BY ALL""")
def _(t):
    """Asked pairs ranked among a drawn background, which counts repeated draws as often as they come."""
    drawn = al.draw_pairs(al.lengths(t.aln), draws(t, 500), "draw", "background")
    value = F.round("mi", 9).alias("mi")
    ask, back = (cut_lineage(al.mutual_information(t.aln, p).select("gene", "i", "j", value)) for p in (asked(t), drawn))
    every = drawn.join(back, ["gene", "i", "j"])
    return ranking.percentile_strict(ask, "mi", every, "mi", ["gene"]).select("gene", "i", "j", F.round("percentile", 6).alias("percentile"))


#: Every pair of rows of the short alignments, by distinct rows with their copies.
PAIRS_SQL = """wq AS (SELECT gene, translate(seq, '0123456789#:/.?=&_', '------------------') AS seq FROM prx_word), wd AS (SELECT gene, seq, count(*) AS c, row_number() OVER (PARTITION BY gene ORDER BY seq) AS s FROM wq GROUP BY 1, 2),
bp AS (SELECT a.gene, a.s AS s1, b.s AS s2, a.c AS c1, b.c AS c2, a.seq AS q1, b.seq AS q2, unnest(range(1, least(length(a.seq), length(b.seq)) + 1)) AS k FROM wd a JOIN wd b ON a.gene = b.gene AND a.s < b.s),
bx AS (SELECT gene, s1, s2, c1, c2, substr(q1, CAST(k AS INT), 1) AS x, substr(q2, CAST(k AS INT), 1) AS y FROM bp),
bi AS (SELECT gene, s1, s2, c1, c2, COALESCE((count(*) FILTER (x = y AND x <> '-' AND y <> '-'))::DOUBLE / nullif(count(*) FILTER (x <> '-' AND y <> '-'), 0), 0) AS pid FROM bx GROUP BY ALL)"""


def _short(t):
    """The short alignments with digits and punctuation as gaps."""
    return t.word.withColumn("seq", F.translate("seq", "0123456789#:/.?=&_", "-" * 18))


@query("m11_pairwise_identity", f"""
WITH {PAIRS_SQL}, h AS (SELECT gene, pid, sum(c1 * c2)::BIGINT AS w FROM bi GROUP BY 1, 2 UNION ALL SELECT gene, CASE WHEN replace(seq, '-', '') = '' THEN 0.0 ELSE 1.0 END, c * (c - 1) // 2 FROM wd WHERE c > 1),
g AS (SELECT gene, pid, sum(w)::BIGINT AS w FROM h GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY gene ORDER BY pid) AS hi, sum(w) OVER (PARTITION BY gene) AS n FROM g),
q AS (SELECT gene, n, p, (n - 1) * p AS spot FROM (SELECT DISTINCT gene, n FROM r), (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS p)),
v AS (SELECT q.gene, q.n, p, spot, min(pid) FILTER (hi > floor(spot)) AS low, min(pid) FILTER (hi > ceil(spot)) AS up FROM q JOIN r ON r.gene = q.gene GROUP BY ALL), z AS (SELECT gene, n, p, low + (up - low) * (spot - floor(spot)) AS v FROM v), m AS (SELECT gene, sum(pid * w) / sum(w) AS mean FROM g GROUP BY 1)
SELECT gene, n::BIGINT AS n, round(any_value(mean), 6) AS mean, round(max(v) FILTER (p = 0.05), 6) AS p5, round(max(v) FILTER (p = 0.25), 6) AS p25, round(max(v) FILTER (p = 0.5), 6) AS median, round(max(v) FILTER (p = 0.75), 6) AS p75, round(max(v) FILTER (p = 0.95), 6) AS p95 FROM z JOIN m USING (gene) GROUP BY 1, 2""")
def _(t):
    return al.pairwise_identity(_short(t)).select("gene", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p5", "p25", "median", "p75", "p95")])


@query("m12_effective_count", f"""
WITH {PAIRS_SQL}, t AS (SELECT unnest([0.2, 0.5, 0.8, 0.9, 0.95])::DOUBLE AS threshold), e AS (SELECT gene, s1 AS s, pid, c2 AS c FROM bi UNION ALL SELECT gene, s2, pid, c1 FROM bi),
w AS (SELECT wd.gene, wd.s, wd.c, threshold, CASE WHEN replace(any_value(seq), '-', '') = '' THEN 1 ELSE wd.c END + COALESCE(sum(e.c) FILTER (e.pid >= threshold), 0) AS k FROM wd CROSS JOIN t LEFT JOIN e ON e.gene = wd.gene AND e.s = wd.s GROUP BY 1, 2, 3, 4)
SELECT gene, threshold, round(sum(c::DOUBLE / k), 6) AS m_eff, sum(c)::BIGINT AS n_rows FROM w GROUP BY 1, 2""")
def _(t):
    return al.effective_count(_short(t), [0.2, 0.5, 0.8, 0.9, 0.95]).select("gene", "threshold", F.round("m_eff", 6).alias("m_eff"), "n_rows")


@query("m12b_effective_count_documents")
def _(t):
    return al.effective_count(t.aln, [0.05, 0.06, 0.07, 0.08, 0.9])


M14_MW = """SELECT stratum, is_ancestral AS g, odds_ratio AS v FROM x"""


def _m14_sql():
    from .statistics import mw_sql

    return f"""
WITH x AS (SELECT *, unnest(list_filter(['all_pairs', CASE WHEN contact_type <> 'mt-nuc' THEN 'intra' END, CASE WHEN contact_type = 'mt-nuc' THEN 'inter' END, 'within_' || dar_gene], lambda z: z IS NOT NULL)) AS stratum FROM prx_tested),
q AS (SELECT stratum, quantile_cont(odds_ratio, 0.5) FILTER (is_ancestral) AS m1, quantile_cont(odds_ratio, 0.5) FILTER (NOT is_ancestral) AS m2, quantile_cont(odds_ratio, 0.75) FILTER (is_ancestral) AS q1, quantile_cont(odds_ratio, 0.75) FILTER (NOT is_ancestral) AS q2 FROM x GROUP BY 1), {mw_sql(M14_MW, ['stratum'], 'greater')}
SELECT stratum, CAST(n1 AS BIGINT) AS n_flag, CAST(n2 AS BIGINT) AS n_rest, round(m1, 6) AS median_flag, round(m2, 6) AS median_rest, round(q1, 6) AS p75_flag, round(q2, 6) AS p75_rest, round(p_value, 6) AS p_value FROM mp JOIN q USING (stratum)"""


@query("m14_compare_strata", _m14_sql())
def _(t):
    from ..operators.summaries import compare_strata

    strata = {"all_pairs": F.lit(True), "intra": C("contact_type") != "mt-nuc", "inter": C("contact_type") == "mt-nuc"}
    out = compare_strata(t.tested, "is_ancestral", "odds_ratio", strata, within="dar_gene")
    return out.select("stratum", "n_flag", "n_rest", *[F.round(c, 6).alias(c) for c in ("median_flag", "median_rest", "p75_flag", "p75_rest", "p_value")])


@query("m15_aa_frequencies", """
WITH n AS (SELECT gene, col, ch, count(*) AS n FROM prx_cell GROUP BY 1, 2, 3), t AS (SELECT gene, col, COALESCE(sum(n) FILTER (ch NOT IN ('-', 'B', 'J', 'O', 'U', 'X', 'Z')), 0) AS t FROM n GROUP BY 1, 2), l AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS ch)
SELECT t.gene, l.ch, count(*) AS n_cols, round(sum((COALESCE(n, 0) + 1) / (t + 20.0::DOUBLE)), 5) AS total FROM t CROSS JOIN l LEFT JOIN n ON n.gene = t.gene AND n.col = t.col AND n.ch = l.ch GROUP BY 1, 2""")
def _(t):
    return al.aa_frequencies(cells(t)).groupBy("gene", "ch").agg(F.count("*").alias("n_cols"), F.round(F.sum("frequency"), 5).alias("total"))


@query("m16_trait_tables", """
WITH s AS (SELECT DISTINCT l_partkey AS pair, l_suppkey AS sp FROM lineitem WHERE l_returnflag = 'A'), k AS (SELECT pair, count(*) AS n_species, string_agg(sp, ',' ORDER BY sp) AS key FROM s GROUP BY 1) SELECT pair, n_species, count(*) OVER (PARTITION BY key) AS n_same FROM k""")
def _(t):
    traits = t.lineitem.where("l_returnflag = 'A'").select(C("l_partkey").alias("pair"), C("l_suppkey").alias("species"))
    return ranking.group_size_attach(al.trait_tables(traits, ["pair"], "species"), ["set_key"], "n_same").select("pair", "n_species", "n_same")


CARRIER_SQL = """rp AS (SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY col) AS pos, col FROM prx_cell WHERE is_ref AND ch NOT IN ('-', 'X', '!', '*')),
va AS (SELECT vid, ['en', 'de', 'fr', 'es'][CAST(1 + pkey % 4 AS INT)] AS gene, pos, alt_aa FROM prx_variant), vc AS (SELECT vid, va.gene, col, alt_aa FROM va JOIN rp ON rp.gene = va.gene AND rp.pos = va.pos),
cn AS (SELECT gene, col, ch, count(*) AS n, sum(species) AS s FROM prx_cell WHERE NOT is_ref AND ch NOT IN ('-', 'X', '!', '*') GROUP BY 1, 2, 3)"""


@query("j10_carrier_scan", f"WITH {CARRIER_SQL} SELECT vid, n AS n_species, CAST(s AS BIGINT) AS species_sum FROM vc JOIN cn ON cn.gene = vc.gene AND cn.col = vc.col AND cn.ch = vc.alt_aa")
def _(t):
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    v = t.variant.select("vid", F.element_at(langs, (C("pkey") % 4 + 1).cast("int")).alias("gene"), "pos", "alt_aa")
    m = al.position_map(al.reference_row(t.aln), "-X!*").select("gene", "pos", "col")
    return al.carrier_counts(v.join(m, ["gene", "pos"]), cells(t), species_sum=F.sum("species"))
