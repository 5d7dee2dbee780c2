"""T and W: tests, ranks and false-discovery control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference, ranking
from .registry import query

C = F.col

# One-sided exact p-value of [[a, b], [c, d]] as a sum of hypergeometric terms.
LNC = "(lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - {1} + 1.0))"
TERM = f"exp({LNC.format('(a + c)', 'k')} + {LNC.format('(b + d)', '(a + b - k)')} - {LNC.format('(a + b + c + d)', '(a + b)')})"
FISHER_SQL = f"""
fk AS (SELECT gene, stratum, a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM prx_cell2x2),
ft AS (SELECT *, {TERM} AS t, max(CASE WHEN k = a THEN {TERM} END) OVER (PARTITION BY gene, stratum) AS own FROM fk),
fp AS (SELECT gene, stratum, least(1.0, sum(t) FILTER (k >= a)) AS p_greater, least(1.0, sum(t) FILTER (t <= own * (1 + 1e-7))) AS p_two FROM ft GROUP BY 1, 2)"""


@query("q00_contingency_fdr", f"""
WITH {FISHER_SQL.strip()}, r AS (SELECT *, row_number() OVER (ORDER BY p_greater) AS rk, count(*) OVER () AS n FROM fp),
q AS (SELECT *, min(p_greater * n / rk) OVER (ORDER BY p_greater DESC ROWS UNBOUNDED PRECEDING) AS fdr FROM r)
SELECT gene, stratum, a, b, c, d, round(p_greater, 6) AS p_value, round(least(1.0, fdr), 6) AS fdr,
 round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds_ratio FROM q JOIN prx_cell2x2 USING (gene, stratum)""")
def _(t):
    tested = inference.with_fisher(t.cell2x2)
    return ranking.bh_fdr(tested, "p_value").select(
        "gene", "stratum", "a", "b", "c", "d", F.round("p_value", 6).alias("p_value"), F.round("fdr", 6).alias("fdr"),
        F.round("odds_ratio", 6).alias("odds_ratio"))


ERFC_SQL = ("(CASE WHEN {z} >= 0 THEN 1 ELSE -1 END * ({t}) * exp(-({z}) * ({z}) - 1.26551223 + {t} * (1.00002368 + {t} * (0.37409196 + {t} * (0.09678418 + {t} * "
            "(-0.18628806 + {t} * (0.27886807 + {t} * (-1.13520398 + {t} * (1.48851587 + {t} * (-0.82215223 + {t} * 0.17087277))))))))) + CASE WHEN {z} >= 0 THEN 0 ELSE 2 END)")


def erfc_sql(z: str) -> str:
    return ERFC_SQL.format(z=f"({z})", t=f"(1.0 / (1.0 + 0.5 * abs({z})))")


@query("t01_fisher_exact", f"WITH {FISHER_SQL.strip()} SELECT gene, stratum, round(p_greater, 6) AS p_greater, round(p_two, 6) AS p_two FROM fp")
def _(t):
    from ..functions.special import fisher_exact

    return t.cell2x2.select("gene", "stratum", F.round(fisher_exact("a", "b", "c", "d"), 6).alias("p_greater"),
                            F.round(fisher_exact("a", "b", "c", "d", "two-sided"), 6).alias("p_two"))


@query("t02_odds_ratio_ci", """
WITH x AS (SELECT gene, stratum, a + 0.5::DOUBLE AS a, b + 0.5::DOUBLE AS b, c + 0.5::DOUBLE AS c, d + 0.5::DOUBLE AS d FROM prx_cell2x2), y AS (SELECT *, a * d / (b * c) AS r, 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS h FROM x)
SELECT gene, stratum, round(r, 6) AS odds_ratio, round(exp(ln(r) - h), 6) AS lo, round(exp(ln(r) + h), 6) AS hi FROM y""")
def _(t):
    from ..functions.special import odds_ratio_ci

    return t.cell2x2.select("gene", "stratum", odds_ratio_ci("a", "b", "c", "d").alias("o")).select(
        "gene", "stratum", *[F.round(f"o.{c}", 6).alias(c) for c in ("odds_ratio", "lo", "hi")])


@query("t03_odds_ratio_pseudo", "SELECT gene, stratum, round((a + 0.5::DOUBLE) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds_ratio FROM prx_cell2x2")
def _(t):
    from ..functions.special import odds_ratio_pseudo

    return t.cell2x2.select("gene", "stratum", F.round(odds_ratio_pseudo("a", "b", "c", "d"), 6).alias("odds_ratio"))


@query("t04_chi_square", f"""
WITH c AS (SELECT p_brand AS g, l_returnflag AS r, l_linestatus AS k, count(*)::DOUBLE AS o FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
e AS (SELECT *, sum(o) OVER (PARTITION BY g, r) * sum(o) OVER (PARTITION BY g, k) / sum(o) OVER (PARTITION BY g) AS e FROM c), s AS (SELECT g, sum((o - e) ** 2 / e) AS x, (count(DISTINCT r) - 1) * (count(DISTINCT k) - 1) AS dof FROM e GROUP BY 1)
SELECT g, round(x, 6) AS chi2, dof, round(exp(-x / 2), 6) AS p_value FROM s""")
def _(t):
    cells = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).groupBy(C("p_brand").alias("g"), C("l_returnflag").alias("r"), C("l_linestatus").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return inference.chi_square(cells, "r", "k", "n", ["g"]).select("g", F.round("chi2", 6).alias("chi2"), "dof", F.round("p_value", 6).alias("p_value"))


def mw_sql(source, keys, side):
    k = ", ".join(keys)
    z = "(u - n1 * n2 / 2 - 0.5) / s" if side == "greater" else "(abs(u - n1 * n2 / 2) - 0.5) / s"
    p = f"0.5 * {erfc_sql(f'({z}) / sqrt(2.0)')}" if side == "greater" else f"least(1.0, {erfc_sql(f'({z}) / sqrt(2.0)')})"
    return f"""mr AS (SELECT {k}, g, v, rank() OVER (PARTITION BY {k} ORDER BY v) + (count(*) OVER (PARTITION BY {k}, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {k}, v) AS tie FROM ({source})),
ma AS (SELECT {k}, sum(r) FILTER (g) AS r1, count(*) FILTER (g)::DOUBLE AS n1, count(*) FILTER (NOT g)::DOUBLE AS n2, sum(tie * tie - 1)::DOUBLE AS ties FROM mr GROUP BY {k}),
mu AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS s FROM ma WHERE n1 >= 3 AND n2 >= 3),
mp AS (SELECT *, {p} AS p_value FROM mu)"""


LQ = "SELECT l_returnflag, l_linestatus = 'F' AS g, l_quantity AS v FROM lineitem WHERE l_quantity IS NOT NULL"


@query("t05_mann_whitney", f"WITH {mw_sql(LQ, ['l_returnflag'], 'two-sided')} SELECT l_returnflag, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 3) AS u, round(p_value, 6) AS p_value FROM mp")
def _(t):
    out = inference.mann_whitney(t.lineitem, "l_quantity", C("l_linestatus") == "F", ["l_returnflag"])
    return out.select("l_returnflag", "n1", "n2", F.round("u", 3).alias("u"), F.round("p_value", 6).alias("p_value"))


#: Every order's lines: few rows a side, so the null distribution of U is spelled out by choosing the first side's ranks in all ways.
SMALL_SQL = f"""{mw_sql("SELECT l_orderkey, l_returnflag = 'N' AS g, l_extendedprice AS v FROM lineitem", ['l_orderkey'], 'two-sided').replace('>= 3', '>= 2')},
sz AS (SELECT DISTINCT n1, n2 FROM mp), ch AS (SELECT n1, n2, unnest(range(1 << CAST(n1 + n2 AS INT))) AS m FROM sz),
rk AS (SELECT n1, n2, list_filter(range(CAST(n1 + n2 AS BIGINT)), lambda i: (m >> i) & 1 = 1) AS s FROM ch), nu AS (SELECT n1, n2, list_sum(s) + n1 - n1 * (n1 + 1) / 2 AS w, count(*)::DOUBLE AS k FROM rk WHERE len(s) = n1 GROUP BY ALL),
ex AS (SELECT l_orderkey, sum(k) FILTER (w >= greatest(u, n1 * n2 - u)) / sum(k) AS tail FROM mp JOIN nu USING (n1, n2) GROUP BY l_orderkey)"""


@query("t05b_mann_whitney_exact", f"WITH {SMALL_SQL} SELECT l_orderkey, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 3) AS u, round(CASE WHEN ties = 0 THEN least(1.0, 2 * tail) ELSE p_value END, 6) AS p_value FROM mp JOIN ex USING (l_orderkey)")
def _(t):
    out = inference.mann_whitney(t.lineitem, "l_extendedprice", C("l_returnflag") == "N", ["l_orderkey"], min_n=2).where("p_value is not null")
    return out.select("l_orderkey", "n1", "n2", F.round("u", 3).alias("u"), F.round("p_value", 6).alias("p_value"))


@query("t06_spearman", """
WITH s AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0::DOUBLE AS ry FROM s)
SELECT g, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")
def _(t):
    s = t.lineitem.select(C("l_returnflag").alias("g"), C("l_quantity").alias("x"), C("l_extendedprice").alias("y"))
    return inference.spearman(s, "x", "y", ["g"]).select("g", "n", F.round("rho", 6).alias("rho"))


@query("t06b_spearman_p", """
WITH s AS (SELECT p_brand AS g, p_size AS x, p_retailprice AS y FROM part), r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0::DOUBLE AS ry FROM s),
c AS (SELECT g, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1), t AS (SELECT *, n - 2 AS v, atan(abs(rho) * sqrt((n - 2) / ((1 - rho) * (1 + rho))) / sqrt(n - 2)) AS th FROM c),
u AS (SELECT *, unnest(range(CASE WHEN v % 2 = 0 THEN v // 2 ELSE (v - 1) // 2 END)) AS j FROM t),
w AS (SELECT g, any_value(v) AS v, any_value(th) AS th, sum(CASE WHEN v % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(j + 1.0) - 0.5 * ln(pi())) * cos(th) ** (2 * j) ELSE exp(0.5 * ln(pi()) + lgamma(j + 1.0) - ln(2.0) - lgamma(j + 1.5)) * cos(th) ** (2 * j + 1) END) AS s FROM u GROUP BY 1)
SELECT g, round(1 - CASE WHEN v % 2 = 0 THEN sin(th) * s ELSE 2 / pi() * (th + sin(th) * s) END, 6) AS p_value FROM w""")
def _(t):
    s = t.part.select(C("p_brand").alias("g"), C("p_size").alias("x"), C("p_retailprice").alias("y"))
    return inference.spearman(s, "x", "y", ["g"]).select("g", F.round("p_value", 6).alias("p_value"))


@query("t07_binom_test", """
WITH s AS (SELECT p_brand AS g, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), u AS (SELECT *, unnest(range(n + 1)) AS j FROM s),
w AS (SELECT *, exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(0.33) + (n - j) * ln(0.67)) AS p FROM u), o AS (SELECT *, max(CASE WHEN j = k THEN p END) OVER (PARTITION BY g) AS own FROM w)
SELECT g, k, n, round(sum(p) FILTER (j >= k), 6) AS p_greater, round(least(1.0, sum(p) FILTER (p <= own * (1 + 1e-7))), 6) AS p_two FROM o GROUP BY 1, 2, 3""")
def _(t):
    from ..functions.special import binom_test

    s = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).groupBy(C("p_brand").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_if(C("l_returnflag") == "A").alias("k"))
    p = F.lit(0.33)
    return s.select("g", "k", "n", F.round(binom_test("k", "n", p, "greater"), 6).alias("p_greater"), F.round(binom_test("k", "n", p), 6).alias("p_two"))


@query("t08_cmh", f"""
WITH n AS (SELECT stratum, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, (a + b + c + d)::DOUBLE AS n FROM prx_cell2x2 WHERE a + b + c + d >= 2),
s AS (SELECT stratum, sum(a - (a + b) * (a + c) / n) ** 2 / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS x FROM n GROUP BY 1)
SELECT stratum, round(x, 6) AS chi2, round({erfc_sql('sqrt(x / 2)')}, 6) AS p_value FROM s""")
def _(t):
    return inference.cmh(t.cell2x2, "gene", ["stratum"]).select("stratum", F.round("chi2", 6).alias("chi2"), F.round("p_value", 6).alias("p_value"))


@query("t09_empirical_p", """
WITH o AS (SELECT o_custkey AS k, max(o_totalprice) / 2 AS obs FROM orders GROUP BY 1), q AS (SELECT k, any_value(obs) AS obs, avg(CASE WHEN o_totalprice >= obs THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.95) AS h FROM orders JOIN o ON k = o_custkey GROUP BY 1)
SELECT k, round(p, 6) AS p_emp, n AS n_completed, round(m, 4) AS null_median, round(h, 4) AS null_p95 FROM q""")
def _(t):
    obs = t.orders.groupBy(C("o_custkey").alias("k")).agg((F.max("o_totalprice") / 2).alias("obs"))
    null = t.orders.select(C("o_custkey").alias("k"), C("o_totalprice").alias("sim"))
    q = ranking.quantiles(null, "sim", {"null_median": 0.5, "null_p95": 0.95}, ["k"]).drop("n")
    return inference.empirical_p(obs, null, ["k"], "obs", "sim").join(q, "k").select(
        "k", F.round("p_emp", 6).alias("p_emp"), "n_completed", F.round("null_median", 4).alias("null_median"), F.round("null_p95", 4).alias("null_p95"))


@query("t10_permutation_inputs", """
SELECT pair_id, CASE WHEN is_ancestral THEN 'ancestral' WHEN timing IS DISTINCT FROM 'contact_first' THEN 'no_contact_first' WHEN pagel_fdr IS NULL THEN 'no_background' WHEN n_origins = 0 THEN 'no_carriers' ELSE 'testable' END AS reason FROM prx_tested""")
def _(t):
    r = inference.testable_reason({"ancestral": C("is_ancestral"), "no_contact_first": ~C("timing").eqNullSafe("contact_first"),
                                   "no_background": C("pagel_fdr").isNull(), "no_carriers": C("n_origins") == 0})
    return t.tested.select("pair_id", r.alias("reason"))


ORIGIN_SQL = """ms AS (SELECT dar_gene, contact_gene, ann_id, max(n_origins) AS n, arg_max(pair_id, n_origins * 100000000 - pair_id) AS rep FROM prx_tested GROUP BY 1, 2, 3),
mc AS (SELECT ms.*, least(n, rep % 4) AS k FROM ms WHERE n >= 2), mx AS (SELECT contact_gene, avg(CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END) AS rate FROM prx_tested GROUP BY 1)"""


@query("t11_multi_origin_binomial", f"""
WITH {ORIGIN_SQL}, u AS (SELECT dar_gene, contact_gene, ann_id, n, k, rate, unnest(range(n + 1)) AS j FROM mc JOIN mx USING (contact_gene) WHERE rate > 0)
SELECT dar_gene, contact_gene, ann_id, n AS n_gains, k AS n_first, round(rate, 4) AS expected_rate, round(least(1.0, sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(rate) + (n - j) * ln(1 - rate))) FILTER (j >= k)), 6) AS binom_p FROM u GROUP BY 1, 2, 3, 4, 5, rate""")
def _(t):
    src = t.tested.withColumn("n_first", F.least("n_origins", C("pair_id") % 4))
    seen = t.tested.select("contact_gene", F.when(C("status") == "F", 1.0).otherwise(0.0).alias("has_alt"))
    out = inference.multi_origin_binomial(src, seen, ["dar_gene", "contact_gene", "ann_id"], "n_origins", "n_first", ["contact_gene"], "has_alt", "pair_id")
    return out.select("dar_gene", "contact_gene", "ann_id", C("n_origins").alias("n_gains"), "n_first", F.round("expected_rate", 4).alias("expected_rate"), F.round("binom_p", 6).alias("binom_p"))


@query("t12_verdict", """
WITH s AS (SELECT contact_type, quantile_cont(odds_ratio, 0.5) AS m, avg(CASE WHEN fisher_p < 0.05 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM prx_tested GROUP BY 1)
SELECT contact_type, n, round(m, 6) AS median_or, round(share, 6) AS share_sig, CASE WHEN m > 5 AND share > 0.5 THEN 'strong' WHEN m >= 2 THEN 'moderate' ELSE 'weak' END AS verdict FROM s""")
def _(t):
    return inference.verdict(t.tested, "contact_type", "odds_ratio", "fisher_p").select(
        "contact_type", "n", F.round("median_or", 6).alias("median_or"), F.round("share_sig", 6).alias("share_sig"), "verdict")


STRATA_SQL = """sx AS (SELECT *, unnest(list_filter(['all', CASE WHEN contact_type = 'mt-mt' THEN 'mt-mt' END, CASE WHEN contact_type = 'nuc-nuc' THEN 'nuc-nuc' END, CASE WHEN contact_type = 'mt-nuc' THEN 'mt-nuc' END], lambda x: x IS NOT NULL)) AS stratum FROM {src}),
s2 AS (SELECT stratum, count(*) FILTER (f AND s) AS a, count(*) FILTER (f AND NOT s) AS b, count(*) FILTER (NOT f AND s) AS c, count(*) FILTER (NOT f AND NOT s) AS d FROM sx GROUP BY 1),
sk AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM s2), sp AS (SELECT stratum, a, b, c, d, least(1.0, sum({term}) FILTER (k >= a)) AS p FROM sk GROUP BY 1, 2, 3, 4, 5)"""


def strata():
    return {"all": F.lit(True), **{k: C("contact_type") == k for k in ("mt-mt", "nuc-nuc", "mt-nuc")}}


@query("t13_fisher_sensitivity", f"""
WITH src AS (SELECT contact_type, COALESCE(timing = 'contact_first', false) AS f, fisher_fdr <= 0.10 AS s FROM prx_tested WHERE NOT is_ancestral), {STRATA_SQL.format(src='src', term=TERM)}
SELECT stratum, a, b, c, d, round(p, 6) AS p_value FROM sp""")
def _(t):
    from ..operators.summaries import stratified_2x2

    derived = t.tested.where(~C("is_ancestral"))
    out = stratified_2x2(derived, F.coalesce(C("timing") == "contact_first", F.lit(False)), C("fisher_fdr") <= 0.10, strata())
    return out.select("stratum", "a", "b", "c", "d", F.round("p_value", 6).alias("p_value"))


@query("t15_significance_view", "SELECT pair_id FROM prx_tested WHERE NOT low_power AND COALESCE(least(pagel_fdr, branch_fdr), pagel_fdr, branch_fdr) <= 0.10")
def _(t):
    return inference.significance_view(t.tested, ["pagel_fdr", "branch_fdr"], "fisher_fdr", "low_power").select("pair_id")
