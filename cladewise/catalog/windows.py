"""W and U: ranks, dedup, top-k, sorting, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, sets
from .registry import query

C = F.col


@query("w01_bh_fdr", """
WITH r AS (SELECT pair_id, fisher_p AS p, row_number() OVER (ORDER BY fisher_p, pair_id) AS rk, count(*) OVER () AS n FROM prx_tested WHERE status <> 'P'),
q AS (SELECT pair_id, min(p * n / rk) OVER (ORDER BY p DESC, pair_id DESC ROWS UNBOUNDED PRECEDING) AS fdr FROM r)
SELECT pair_id, CASE WHEN fdr IS NOT NULL THEN round(least(1.0, fdr), 6) END AS fdr FROM prx_tested LEFT JOIN q USING (pair_id)""")
def _(t):
    p = t.tested.select("pair_id", F.when(C("status") != "P", C("fisher_p")).alias("p"))
    return ranking.bh_fdr(p, "p").select("pair_id", F.round("fdr", 6).alias("fdr"))


@query("w02_pct_rank_within", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rk, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS ties, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((rk + (ties - 1) / 2.0) / n * 100.0, 6) AS pct_rank FROM r""")
def _(t):
    return ranking.pct_rank_within(t.lineitem, "l_quantity", ["l_returnflag"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("pct_rank", 6).alias("pct_rank"))


@query("w03_percentile_strict", """
WITH n AS (SELECT p_partkey, (SELECT count(*) FROM supplier) AS t, (SELECT count(*) FROM supplier WHERE s_acctbal < p_retailprice * 4 - 3000) AS b FROM part)
SELECT p_partkey, round(b * 100.0 / t, 6) AS percentile FROM n""")
def _(t):
    asked = t.part.select("p_partkey", (C("p_retailprice") * 4 - 3000).alias("v"))
    return ranking.percentile_strict(asked, "v", t.supplier, "s_acctbal").select("p_partkey", F.round("percentile", 6).alias("percentile"))


@query("w04_rank_all", "SELECT pair_id, row_number() OVER (ORDER BY floor(price / 1000) DESC, pair_id) AS rank FROM prx_tested")
def _(t):
    return ranking.rank_all(t.tested.select("pair_id", F.floor(C("price") / 1000).alias("score")), "score", "pair_id").select("pair_id", "rank")


@query("w05_dedup_first", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_orderdate FROM r WHERE rn = 1""")
def _(t):
    src = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return ranking.dedup_first(src, ["o_custkey"], [-F.unix_micros(C("o_orderdate").cast("timestamp")), C("o_orderkey")])


@query("w06_group_size_attach", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_group FROM orders")
def _(t):
    return ranking.group_size_attach(t.orders, ["o_custkey"]).select("o_orderkey", "n_group")


@query("w07_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(t):
    return ranking.top_k(t.orders.select("o_orderkey", "o_totalprice"), 50, C("o_totalprice").desc(), C("o_orderkey"))


@query("w08_dominant_class", """
WITH n AS (SELECT ann_id, count(*) FILTER (timing = 'contact_first') AS a, count(*) FILTER (timing = 'co_occurring') AS b, count(*) FILTER (timing = 'contact_after') AS c, count(*) FILTER (timing = 'no_contact_change') AS d, bool_or(low_power) AS lc FROM prx_tested GROUP BY 1),
m AS (SELECT *, greatest(a, b, c, d) AS g, a + b + c + d AS s FROM n)
SELECT ann_id, CASE WHEN s = 0 THEN NULL WHEN a = g THEN 'contact_first' WHEN b = g THEN 'co_occurring' WHEN c = g THEN 'contact_after' ELSE 'no_contact_change' END AS dominant,
 CASE WHEN s = 0 THEN 'insufficient' WHEN g / s >= 0.7 AND NOT lc THEN 'high' ELSE 'low' END AS confidence FROM m""")
def _(t):
    from ..operators.tree import timing_counts

    n = timing_counts(t.tested, ["ann_id"])
    low = t.tested.groupBy("ann_id").agg(F.bool_or("low_power").alias("lc"))
    conf = F.when(C("majority_fraction").isNull(), "insufficient").when((C("majority_fraction") >= 0.7) & ~C("lc"), "high").otherwise("low")
    return n.join(low, "ann_id").select("ann_id", C("dominant_timing").alias("dominant"), conf.alias("confidence"))


@query("w09_multi_key_sort", """
SELECT pair_id, row_number() OVER (ORDER BY CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, pagel_fdr DESC NULLS LAST, pair_id) AS place FROM prx_tested""")
def _(t):
    tier = ranking.tier_order("status", ["F", "O", "P"])
    rows = t.tested.select("pair_id", "pagel_fdr", tier.alias("tier"))
    return ranking.positions(rows, C("tier").asc(), C("pagel_fdr").desc_nulls_last(), C("pair_id").asc()).select("pair_id", "place")


@query("w10_merge_results", """
SELECT contact_type, count(*) AS n, round(avg(CASE WHEN fisher_p < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share_05, round(avg(CASE WHEN fisher_p < 0.01 THEN 1.0 ELSE 0.0 END), 6) AS share_01, round(quantile_cont(odds_ratio, 0.5), 6) AS median_or FROM prx_tested GROUP BY 1""")
def _(t):
    from ..session import scratch_path

    path = scratch_path(t.spark, "chunks")
    for i in range(3):
        t.tested.where(C("pair_id") % 3 == i).write.parquet(f"{path}/chunk_{i}.parquet")
    return ranking.merge_summary(t.spark.read.parquet(f"{path}/chunk_*.parquet"), "contact_type", "fisher_p", "odds_ratio").select(
        "contact_type", "n", F.round("share_05", 6).alias("share_05"), F.round("share_01", 6).alias("share_01"), F.round("median_or", 6).alias("median_or"))


@query("u01_intersect_except", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48)
SELECT k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b USING (k)""")
def _(t):
    a = t.lineitem.where("l_returnflag = 'A'").select(C("l_partkey").alias("k"))
    b = t.lineitem.where("l_quantity > 48").select(C("l_partkey").alias("k"))
    return sets.set_sides(a, b)


@query("u02_union_tagged", """
SELECT 'A' AS tier, c_custkey AS k, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS name FROM customer UNION ALL SELECT 'B', s_suppkey, s_acctbal, s_name FROM supplier UNION ALL SELECT 'C', p_partkey, NULL, p_name FROM part""")
def _(t):
    return sets.union_tagged({"A": t.customer.select(C("c_custkey").alias("k"), C("c_acctbal").alias("bal")),
                              "B": t.supplier.select(C("s_suppkey").alias("k"), C("s_acctbal").alias("bal"), C("s_name").alias("name")),
                              "C": t.part.select(C("p_partkey").alias("k"), C("p_name").alias("name"))}, "tier")


@query("u03_split_views", """
WITH s AS (SELECT vid, CASE WHEN status = 'P' THEN NULL WHEN line = 7 OR status = 'F' THEN 'classified_warning' ELSE 'classified_clean' END AS subset FROM prx_variant)
SELECT 'all' AS view_name, count(*) AS n FROM s WHERE subset IS NOT NULL UNION ALL SELECT subset, count(*) FROM s WHERE subset IS NOT NULL GROUP BY 1""")
def _(t):
    st = F.when(C("status") == "P", "unresolved").otherwise("classified")
    marked = sets.classification_subset(t.variant.withColumn("cs", st), "cs", exception_applied=C("line") == 7, REF_ALLELE_MISMATCH=C("status") == "F")
    views = sets.split_views(marked, "subset", {"all": ["classified_clean", "classified_warning"], "classified_clean": ["classified_clean"], "classified_warning": ["classified_warning"]})
    return sets.union_tagged({k: v.agg(F.count(F.lit(1)).alias("n")) for k, v in views.items()}, "view_name")


@query("u04_species_sets", """
WITH c AS (SELECT DISTINCT l_partkey AS vid, l_suppkey AS sp FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS vid, l_suppkey AS sp FROM lineitem WHERE l_quantity > 10), x AS (SELECT s_suppkey AS sp FROM supplier WHERE s_acctbal > 0)
SELECT r.vid, count(*) FILTER (c.sp IS NOT NULL) AS n_carriers, count(*) FILTER (c.sp IS NULL) AS n_background, count(*) FILTER (x.sp IS NOT NULL) AS n_cross FROM r LEFT JOIN c ON c.vid = r.vid AND c.sp = r.sp LEFT JOIN x ON x.sp = r.sp GROUP BY 1""")
def _(t):
    def pairs(cond):
        return t.lineitem.where(cond).select(C("l_partkey").alias("vid"), C("l_suppkey").alias("species"))

    cross = t.supplier.where("s_acctbal > 0").select(C("s_suppkey").alias("species"))
    roles = sets.species_sets(pairs("l_returnflag = 'A'"), pairs("l_quantity > 10"), cross, "vid")
    return roles.groupBy("vid").agg(F.count_if("is_carrier").alias("n_carriers"), F.count_if(~C("is_carrier")).alias("n_background"), F.count_if("in_cross").alias("n_cross"))


@query("u05_parse_set", """
SELECT event_id, len(list_distinct([event_type, props, event_type])) AS n, 2 AS n_array FROM events""")
def _(t):
    from ..functions.text import parse_set

    doc = F.to_json(F.array("event_type", "props", "event_type"))
    return t.events.select("event_id", F.size(parse_set(doc)).alias("n"), F.size(F.array_distinct(F.array("event_type", "props", "event_type"))).alias("n_array"))
