"""Tail probabilities against exact sums."""

from fractions import Fraction
from math import comb, erfc, exp, isclose, log, log1p, sqrt

import pytest
from pyspark.sql import functions as F

from cladewise.functions import special

TABLES = [(8, 2, 1, 5), (0, 5, 7, 3), (10, 0, 0, 10), (3, 3, 3, 3), (1, 20, 30, 2), (120, 80, 60, 140), (0, 0, 3, 4)]


def exact(a, b, c, d, side):
    r, m, n = a + b, a + c, a + b + c + d
    ks = range(max(0, m + r - n), min(r, m) + 1)
    p = {k: comb(m, k) * comb(n - m, r - k) / comb(n, r) for k in ks}
    if side == "greater":
        return min(1, sum(v for k, v in p.items() if k >= a))
    return min(1, sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))


@pytest.mark.parametrize("side", ["greater", "two-sided"])
def test_fisher(spark, side):
    df = spark.createDataFrame(TABLES, "a long, b long, c long, d long")
    for r in df.withColumn("p", special.fisher_exact("a", "b", "c", "d", side)).collect():
        assert isclose(r.p, exact(r.a, r.b, r.c, r.d, side), rel_tol=1e-9), r


FAR = [((12, 0, 0, 999988), 4.8e-64), ((14, 6, 6, 9999974), 1.3e-78)]


@pytest.mark.parametrize("side", ["greater", "two-sided"])
def test_far_tails(spark, side):
    tables = [t for t, _ in FAR] + [(40, 0, 0, 60), (3, 500, 400, 9), (0, 900, 1000, 3), (700, 300, 300, 700)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r in df.withColumn("p", special.fisher_exact("a", "b", "c", "d", side)).collect():
        m, n, k0 = r.a + r.c, r.a + r.b + r.c + r.d, r.a + r.b
        w = {k: comb(m, k) * comb(n - m, k0 - k) for k in range(max(0, m + k0 - n), min(k0, m) + 1)}
        hit = sum(v for k, v in w.items() if (k >= r.a if side == "greater" else v * 10**7 <= w[r.a] * (10**7 + 1)))
        assert isclose(r.p, float(Fraction(hit, comb(n, k0))), rel_tol=1e-9), r
    for (a, b, c, d), p in FAR:
        assert isclose(exact_log(a, b, c, d), log(p), rel_tol=1e-3)


def exact_log(a, b, c, d):
    m, n, r = a + c, a + b + c + d, a + b
    hit = sum(comb(m, k) * comb(n - m, r - k) for k in range(a, min(r, m) + 1))
    return log(hit) - log(comb(n, r))


def test_far_binomials_and_wide_margins(spark):
    row = spark.range(1).select(special.binom_log(F.lit(20), F.lit(10**6), F.lit(1e-9), "greater").alias("far"), special.fisher_exact(F.lit(10**10), F.lit(10**10), F.lit(10**10), F.lit(10**10)).alias("wide"),
                                special.fisher_log(F.lit(5000), F.lit(0), F.lit(0), F.lit(5000)).alias("log")).first()
    want = log(comb(10**6, 20)) + 20 * log(1e-9) + (10**6 - 20) * log1p(-1e-9)
    step = [(10**6 - i) / (i + 1) * 1e-9 / (1 - 1e-9) for i in (20, 21, 22, 23)]
    want += log1p(step[0] * (1 + step[1] * (1 + step[2] * (1 + step[3]))))
    assert isclose(row.far, want, rel_tol=1e-9) and 0.49 < row.wide < 0.51 and isclose(row.log, -log(comb(10000, 5000)), rel_tol=1e-12)


def test_fisher_huge_counts(spark):
    df = spark.createDataFrame([(10**9, 10**9, 10**9, 10**9)], "a long, b long, c long, d long")
    p = df.select(special.fisher_exact("a", "b", "c", "d").alias("p")).first().p
    assert 0.49 < p < 0.51


@pytest.mark.parametrize("side", ["greater", "less", "two-sided"])
def test_binomial(spark, side):
    rows = [(3, 10, 0.2), (0, 5, 0.5), (5, 5, 0.5), (7, 30, 0.4), (2, 4, 1.0), (0, 4, 0.0)]
    df = spark.createDataFrame(rows, "k long, n long, p double")
    for r in df.withColumn("v", special.binom_test("k", "n", F.col("p"), side)).collect():
        w = [comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.n + 1)]
        want = {"greater": sum(w[r.k:]), "less": sum(w[: r.k + 1]), "two-sided": sum(x for x in w if x <= w[r.k] * (1 + 1e-7))}[side]
        assert isclose(r.v, min(1, want), rel_tol=1e-9, abs_tol=1e-12), r


def test_chi2_and_t(spark):
    df = spark.range(1).select(
        special.chi2_sf(F.lit(3.0), F.lit(1)).alias("one"), special.chi2_sf(F.lit(3.0), F.lit(2)).alias("two"), special.chi2_sf(F.lit(7.0), F.lit(5)).alias("five"),
        special.chi2_sf(F.lit(7.0), F.lit(6)).alias("six"), special.t_two_sided(F.lit(2.0), F.lit(1)).alias("t1"), special.t_two_sided(F.lit(-2.0), F.lit(2)).alias("t2"),
        special.t_two_sided(F.lit(0.1), F.lit(50)).alias("t50"), special.lgamma(F.lit(10.0)).alias("lg"))
    r = df.first()
    assert isclose(r.one, erfc(sqrt(1.5)), rel_tol=1e-6) and isclose(r.two, exp(-1.5), rel_tol=1e-12)
    assert isclose(r.five, 0.2206402, rel_tol=1e-5) and isclose(r.six, exp(-3.5) * (1 + 3.5 + 3.5**2 / 2), rel_tol=1e-12)
    assert isclose(r.t1, 0.2951672, rel_tol=1e-6) and isclose(r.t2, 1 - 2 / sqrt(6), rel_tol=1e-9)
    assert isclose(r.t50, 0.9207448, rel_tol=1e-5) and isclose(r.lg, 12.801827480081469, rel_tol=1e-12)
