"""Bucketed ranks, quantiles and sampling operators against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from cladewise.operators import alignment as al
from cladewise.operators import ranges, ranking


def test_bh_with_hot_value(spark):
    rng = random.Random(1)
    ps = [1.0] * 100 + [rng.random() ** 4 for _ in range(150)] + [1e-300, 0.0, 0.0, None]
    df = spark.createDataFrame(list(enumerate(ps)), "id long, p double")
    got = {r.id: r.fdr for r in ranking.bh_fdr(df, "p").collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    best, want = 1.0, {}
    for rank in range(len(known), 0, -1):
        p, i = known[rank - 1]
        best = min(best, p * len(known) / rank)
        want[i] = best
    assert got[len(ps) - 1] is None
    for i, v in want.items():
        assert abs(got[i] - v) < 1e-12


def test_rank_and_quantiles_with_hot_group(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else "g%d" % (i % 7), rng.choice([0.0, -5.5, 1e-9, rng.gauss(0, 1e6)])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    ranks = {r.id: r["rank"] for r in ranking.rank_all(df, "v", "id").collect()}
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), start=1)}
    assert ranks == want
    for r in ranking.quantiles(df, "v", {"q1": 0.25, "q2": 0.5}, ["g"]).collect():
        vals = [x[2] for x in rows if x[1] == r.g]
        assert np.allclose([r.q1, r.q2], np.quantile(vals, [0.25, 0.5]))


def test_nearest_positions_at_any_distance(spark):
    mapped = [("g", p) for p in (1, 4, 1000, 90000)] + [("h", 7)]
    asked = [("g", p) for p in (-3, 3, 4, 500, 50000, 99999)] + [("h", 8)]
    got = {}
    for r in ranges.nearest_positions(spark.createDataFrame(asked, "gene string, pos long"), spark.createDataFrame(mapped, "gene string, pos long"), "gene", "pos", 2).collect():
        got.setdefault((r.gene, r.pos), []).append((r.nth, r.near))
    for g, p in asked:
        cand = sorted((m for gg, m in mapped if gg == g), key=lambda m: (abs(m - p), m))[:2]
        assert [n for _, n in sorted(got[(g, p)])] == cand


def test_interval_hits_of_all_lengths(spark):
    rng = random.Random(3)
    iv = [(i, s, s + rng.choice([0, 5, 300, 70000, 10**7])) for i, s in enumerate(rng.randrange(0, 10**7) for _ in range(80))]
    pts = [(rng.randrange(0, 2 * 10**7),) for _ in range(200)] + [(iv[0][1],), (iv[0][2],)]
    got = {(r.p, r.i) for r in ranges.interval_hits(spark.createDataFrame(pts, "p long"), "p", spark.createDataFrame(iv, "i long, s long, e long"), "s", "e").collect()}
    assert got == {(p, i) for (p,) in pts for i, s, e in iv if s <= p <= e}


SEQS = ["ACDEFGHIK", "ACDEFGHIK", "ACDQFGH", "--DEFAHIKLM", "---", "WWWWWWWWWWWW"]


def _identity(a, b):
    both = [(x, y) for x, y in zip(a, b) if x != "-" and y != "-"]
    return sum(x == y for x, y in both) / len(both) if both else 0.0


def test_text_names(spark):
    names = ["Pan", "Mus", "Bos", "Canis", "Felis", "Sus"]
    df = spark.createDataFrame([("g", n, s) for n, s in zip(names, SEQS)], "gene string, species string, seq string")
    assert al.pairwise_identity(df, block=2).first().n == len(names[: len(SEQS)]) * (len(names[: len(SEQS)]) - 1) // 2
    assert al.effective_count(df, [0.5], block=2).first().n_rows == len(names[: len(SEQS)])


def test_parts_follow_the_data(spark):
    for values in (F.col("id") + 10**12, F.timestamp_seconds(F.col("id") % 86400).cast("double"), F.col("id") / 1e30):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        d = ranking.in_parts(spark.range(50_000).select(values.alias("v")).distinct(), "v")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        parts = sorted((r.a, r.b, r.n) for r in d.groupBy("_part").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).collect())
        n = sum(x[2] for x in parts)
        assert len(parts) == 4 and max(x[2] for x in parts) < 2 * n / 4 and all(x[1] < y[0] for x, y in zip(parts, parts[1:]))


def test_ranking_plans_are_small(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("v"), (F.col("id") % 3).alias("k"))
    for out in (ranking.bh_fdr(df.withColumn("v", F.col("v") / 10), "v"), ranking.pct_rank_within(df, "v", ["k"]), ranking.quantiles(df, "v", {"m": 0.5}, ["k"])):
        assert len(out._jdf.queryExecution().toString()) < 50_000


def test_closure_of_a_long_chain(spark):
    from cladewise.operators import tree

    edges = spark.createDataFrame([("t", f"n{i}", f"n{i + 1}") for i in range(9)], "tree string, parent string, child string")
    assert tree.closure(edges).count() == 45


def test_identity_and_effective_count(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(SEQS)], "gene string, species long, seq string")
    want = [_identity(a, b) for i, a in enumerate(SEQS) for b in SEQS[i + 1:]]
    r = al.pairwise_identity(df, block=2).first()
    assert r.n == len(want) and np.isclose(r["mean"], np.mean(want)) and np.isclose(r["median"], np.median(want)) and np.isclose(r.p95, np.quantile(want, 0.95))
    for strict in (False, True):
        for row in al.effective_count(df, [0.5, 0.8], strict=strict, block=2).collect():
            total = 0.0
            for i, a in enumerate(SEQS):
                near = sum(1 for j, b in enumerate(SEQS) if i != j and ((_identity(a, b) > row.threshold) if strict else (_identity(a, b) >= row.threshold)))
                total += 1 / (1 + near)
            assert np.isclose(row.m_eff, total), (strict, row)


def test_mutual_information(spark):
    rows = [("g", i, s) for i, s in enumerate(["AAC-", "AAD", "CGE-", "CGEB"])]
    aln = spark.createDataFrame(rows, "gene string, species long, seq string")
    pairs = spark.createDataFrame([("g", i, j) for i in range(4) for j in range(i + 1, 4)], "gene string, i long, j long")
    states = [[(s[c] if c < len(s) and s[c] in "ACDEFGHIKLMNPQRSTVWY" else "-") for _, _, s in rows] for c in range(4)]

    def h(xs):
        n = len(xs)
        return -sum(xs.count(v) / n * np.log(xs.count(v) / n) for v in set(xs))

    for found in (al.mutual_information(aln, pairs), al.all_information(aln), al.all_information(aln, block=3, rows=1)):
        got = found.collect()
        assert sorted((r.i, r.j) for r in got) == [(i, j) for i in range(4) for j in range(i + 1, 4)]
        for r in got:
            a, b = states[r.i], states[r.j]
            assert abs(r.mi - max(0, h(a) + h(b) - h(list(zip(a, b))))) < 1e-9


def test_drawn_pairs_cover_the_length(spark):
    sizes = spark.createDataFrame([("g", 5), ("h", 1), ("k", 3_000_000)], "gene string, length long")
    draws = spark.createDataFrame([(g, d) for g in "ghk" for d in range(300)], "gene string, draw long")
    got = al.draw_pairs(sizes, draws, "draw", "s").collect()
    small = [(r.i, r.j) for r in got if r.gene == "g"]
    assert len(small) == 300 and set(small) == {(i, j) for j in range(5) for i in range(j)} and not [r for r in got if r.gene == "h"]
    large = [(r.i, r.j) for r in got if r.gene == "k"]
    assert len(set(large)) == 300 and all(0 <= i < j < 3_000_000 for i, j in large) and max(j for _, j in large) > 2_900_000 and min(i for i, _ in large) < 100_000


def test_correction_between_genes(spark):
    mi = spark.createDataFrame([("a", 0, "b", 1, 0.5), ("a", 2, "b", 1, 0.5), ("a", 0, "z", 1, 0.5)], "gene string, i long, gene_b string, j long, mi double")
    means = spark.createDataFrame([("a", 0, 0.2), ("b", 1, 0.4)], "gene string, col long, mean_mi double")
    grand = spark.createDataFrame([("a", 0.1), ("b", 0.3)], "gene string, grand_mean double")
    got = {(r.i, r.gene_b): r.mi_apc for r in al.apc_correct(mi, means, grand).collect()}
    assert np.isclose(got[0, "b"], 0.5 - 0.2 * 0.4 / 0.2) and np.isclose(got[2, "b"], 0.5 - 0.2 * 0.4 / 0.2) and got[0, "z"] == 0.5


def test_rank_sum_is_exact_for_few_rows(spark):
    from itertools import combinations

    from cladewise.operators import inference

    r = np.random.default_rng(8)
    groups, rows = {}, []
    for g, (m, n) in enumerate([(3, 3), (1, 6), (8, 4), (5, 9), (2, 12), (9, 9)]):
        x = r.permutation(m + n)
        groups[g] = (m, n, sorted(int(v) for v in x[:m]))
        rows += [(g, float(v), i < m) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (9, 1.0, True), (9, 1.0, False), (9, 2.0, False)], "g long, v double, flag boolean")
    for side in ("greater", "less", "two-sided"):
        got = {x.g: x.p_value for x in inference.mann_whitney(df, "v", F.col("flag"), ["g"], side, 1).collect()}
        for g, (m, n, own) in groups.items():
            if m > 8 and n > 8:
                continue
            us = np.array([sum(c) - m * (m - 1) // 2 for c in combinations(range(m + n), m)])
            u = sum(own) - m * (m - 1) // 2
            up, down = (us >= u).mean(), (us <= u).mean()
            want = {"greater": up, "less": down, "two-sided": min(1.0, 2 * min(up, down))}[side]
            assert abs(got[g] - want) < 1e-12, (side, g)


def test_exact_tail_of_many_rows():
    """Against the whole table in whole numbers, beyond what 64 bits hold."""
    from math import comb

    import pandas as pd

    from cladewise.operators import inference

    m, n = 8, 1500
    ways = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for k in range(m * n, n + i - 1, -1):
            ways[k] -= ways[k - n - i]
        for k in range(i, m * n + 1):
            ways[k] += ways[k - i]
    assert sum(ways) == comb(m + n, m)
    points = [0, 1, 700, 5999, 6000, 6001, 9000, 11999, 12000]
    got = inference.exact_tail().func(pd.Series([m] * len(points)), pd.Series([n] * len(points)), pd.Series(points))
    assert all(abs(g - sum(ways[u:]) / comb(m + n, m)) <= 1e-12 for g, u in zip(got, points, strict=True))
