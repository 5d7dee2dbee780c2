"""Tail probabilities and exact tests as Column expressions.

Exact tests start at the observed value, whose probability comes from its deviance in
logarithms, and sum outwards from there until the terms no longer count: a tail is
exact to rounding however far out it lies, and nothing overflows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let

# Chebyshev coefficients of the complementary error function.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
# Lanczos coefficients of log-gamma (g = 7).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
           1.5056327351493116e-7]


def erfc(x) -> Column:
    x = _col(x).cast("double")
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def normal_sf(z) -> Column:
    return 0.5 * erfc(_col(z) / F.sqrt(F.lit(2.0)))


def lgamma(x) -> Column:
    """For x >= 0.5."""
    y = _col(x).cast("double") - 1.0
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        s = s + F.lit(c) / (y + float(i))
    t = y + 7.5
    return 0.9189385332046727 + (y + 0.5) * F.log(t) - t + F.log(s)


def chi2_sf(x, df) -> Column:
    """Closed-form upper tail: a finite sum for even and for odd degrees of freedom."""
    h, df = _col(x).cast("double") / 2.0, _col(df).cast("int")
    odd = df % 2 == 1
    first = F.when(odd, F.sqrt(h) * F.exp(-h) * 1.1283791670955126).otherwise(F.exp(-h))
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor(df / 2), F.lit(1)).cast("int")),
        F.struct(F.lit(0.0).alias("total"), first.alias("term")),
        lambda s, i: F.struct(
            (s["total"] + s["term"]).alias("total"), (s["term"] * h / (i + shift)).alias("term")
        ),
        lambda s: s["total"],
    )
    terms = F.when(df == 1, F.lit(0.0)).otherwise(terms)
    return F.when(odd, erfc(F.sqrt(h)) + terms).otherwise(terms)


def t_two_sided(t, df) -> Column:
    """Two-sided Student tail: incomplete beta by its continued fraction."""
    start = F.struct(_col(t).cast("double").alias("t"), _col(df).cast("double").alias("v"))

    def sides(x):
        z = x["v"] / (x["v"] + x["t"] * x["t"])
        a, b = x["v"] / 2.0, F.lit(0.5)
        swap = z > (a + 1.0) / (a + 1.5)
        front = F.exp(lgamma(a + 0.5) - lgamma(F.greatest(a, F.lit(0.5))) - 0.5723649429247001 + a * F.log(z) + 0.5 * F.log(1.0 - z))
        return F.struct(
            x["t"].alias("t"), z.alias("z0"), swap.alias("swap"), front.alias("front"),
            F.when(swap, b).otherwise(a).alias("p"), F.when(swap, a).otherwise(b).alias("q"), F.when(swap, 1.0 - z).otherwise(z).alias("z"),
        )

    def fraction(x):
        p, q, z = x["p"], x["q"], x["z"]
        first = 1.0 / (1.0 - (p + q) * z / (p + 1.0))

        def step(s, m):
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            half = F.struct((1.0 / (1.0 + even * s["d"])).alias("d"), (1.0 + even / s["c"]).alias("c"), s["f"].alias("f"))
            whole = let(half, lambda h: F.struct((1.0 + odd / h["c"]).alias("c"), (1.0 / (1.0 + odd * h["d"])).alias("d"), (h["f"] * h["d"] * h["c"]).alias("f")))
            return let(whole, lambda w: F.struct(w["c"].alias("c"), w["d"].alias("d"), (w["f"] * w["c"] * w["d"]).alias("f")))

        run = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f")), step, lambda s: s["f"])
        part = x["front"] / p * run
        return F.when(x["t"] == 0, F.lit(1.0)).when(x["z0"] == 0, F.lit(0.0)).otherwise(let(part, lambda v: F.when(x["swap"], 1.0 - v).otherwise(v)))

    return let(let(start, sides), fraction)


#: log(n!) less Stirling's formula for n = 0 to 15, by definition.
_SMALL = [0.0, *(math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16))]


def _stirling_error(n: Column) -> Column:
    """log(n!) less Stirling's formula, for whole n >= 0."""
    table = F.element_at(F.array(*[F.lit(v) for v in _SMALL]), F.least(n, F.lit(15.0)).cast("int") + 1)
    x = F.greatest(n, F.lit(1.0))
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - (1 / 1188) / (x * x)) / (x * x)) / (x * x)) / (x * x)) / x
    return F.when(n <= 15, table).otherwise(series)


def _deviance(x: Column, m: Column) -> Column:
    """x log(x / m) + m - x without cancellation where x is near m."""
    v = (x - m) / (x + m)

    def near(t):
        total = F.lit(0.0)
        for j in range(8, 0, -1):
            total = (total + 1.0 / (2 * j + 1)) * t["w"]
        return (x - m) * t["v"] + 2.0 * x * t["v"] * total

    return F.when(x == 0, m).when(F.abs(x - m) < 0.1 * (x + m), let(F.struct(v.alias("v"), (v * v).alias("w")), near)).otherwise(x * F.log(x / m) + m - x)


def _log_binomials(*asked: tuple[Column, Column, Column, Column]) -> Column:
    """Array of the log binomial probabilities of x in n, for (x, n, p, q) with 0 < p < 1 and q = 1 - p; one formula for all."""

    def one(t):
        x, n, p, q = t["x"], t["n"], t["p"], t["q"]
        pairs = F.array(*[F.struct(a.alias("x"), b.alias("m")) for a, b in ((x, n * p), (n - x, n * q), (n, n * q), (n, n * p))])
        at = F.struct(F.transform(pairs, lambda v: _deviance(v["x"], v["m"])).alias("d"), F.transform(F.array(n, x, n - x), _stirling_error).alias("s"))

        def whole(v):
            d, e = v["d"], v["s"]
            edge = lambda share, by, i: F.when(share < 0.1, -F.get(d, F.lit(i)) - n * share).otherwise(n * F.log(by))
            body = F.get(e, F.lit(0)) - F.get(e, F.lit(1)) - F.get(e, F.lit(2)) - F.get(d, F.lit(0)) - F.get(d, F.lit(1)) + 0.5 * F.log(n / (2 * math.pi * x * (n - x)))
            return F.when(n == 0, 0.0).when(x == 0, edge(p, q, 2)).when(x == n, edge(q, p, 3)).otherwise(body)

        return let(at, whole)

    return F.transform(F.array(*[F.struct(x.alias("x"), n.alias("n"), p.alias("p"), q.alias("q")) for x, n, p, q in asked]), one)


def _log_tail(k, lo, hi, mode, sd, log_p, up, down, side):
    """Log of the exact tail of k on lo..hi, for log-concave probabilities with log ``log_p``.

    A tail starts at its own first term, whose logarithm is exact to rounding, and sums outwards relative to it
    until the terms no longer count, so it never vanishes, however far it lies.
    """
    never = F.lit(float("-inf"))

    def tail(t):
        """Of struct(at, sign): the outcomes from ``at`` on, towards hi (1) or lo (-1); ``at`` is in range and beyond the mode."""
        at, sign = t["at"], t["sign"]
        end = F.when(sign > 0, hi).otherwise(lo)
        ratio = lambda i: F.when(i == end, 0.0).when(sign > 0, up(i)).otherwise(down(i))

        def steps(first):  # ratios fall away from the mode: the first bounds all; near the mode the spread does
            wide = F.ceil(10 * sd + 60)
            return F.least(F.abs(end - at), F.when(first < 0.999, F.least(F.ceil(F.lit(45.0) / -F.log(F.greatest(first, F.lit(1e-19)))), wide)).otherwise(wide))

        total = F.aggregate(F.sequence(F.lit(0), F.greatest(let(ratio(at), steps), F.lit(0)).cast("int")), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("all")),
                            lambda s, i: F.struct((s["w"] * ratio(at + sign * i)).alias("w"), (s["all"] + s["w"]).alias("all")), lambda s: s["all"])
        return log_p(at) + F.log(total)

    def spot(at, sign):
        return F.struct(at.cast("bigint").alias("at"), F.lit(sign).cast("int").alias("sign") if isinstance(sign, int) else sign.cast("int").alias("sign"))

    if side in ("greater", "less"):
        toward = 1 if side == "greater" else -1
        own = (k > mode) if side == "greater" else (k < mode)  # else the complement, from the other side
        start = spot(F.least(F.greatest(F.when(own, k).otherwise(k - toward), lo), hi), F.when(own, toward).otherwise(-toward))
        whole, none = (k <= lo, k > hi) if side == "greater" else (k >= hi, k < lo)
        value = let(let(start, tail), lambda x: F.when(own, x).otherwise(F.log1p(-F.least(F.exp(x), F.lit(1.0)))))
        return F.when(whole, 0.0).when(none, never).otherwise(value)

    # Outcomes as likely as k within rounding count, so equal tails of symmetric tables both do.
    right = k > mode
    far = F.when(right, lo).otherwise(hi)

    def both(v):
        own = v["k"] + 1e-7

        def halve(s, _):
            middle = s["near"] + F.floor((s["far"] - s["near"]) / 2).cast("bigint")
            step = lambda mid: F.when(log_p(mid) > own, F.struct(s["far"].alias("far"), mid.alias("near"))).otherwise(F.struct(mid.alias("far"), s["near"].alias("near")))
            return F.when(F.abs(s["far"] - s["near"]) <= 1, s).otherwise(let(middle, step))

        # On the other side probabilities fall monotonically: find the first that counts by halving.
        edge = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(far.alias("far"), mode.alias("near")), halve, lambda s: s["far"])
        sides = F.when(v["far"] > own, F.array(spot(k, F.when(right, 1).otherwise(-1)))).otherwise(F.array(spot(k, F.when(right, 1).otherwise(-1)), spot(edge, F.when(right, -1).otherwise(1))))
        logs = F.transform(sides, tail)
        return F.when(v["mode"] <= own, 0.0).otherwise(let(logs, lambda x: F.least(_log_sum(F.struct(F.get(x, F.lit(0)).alias("x"), F.coalesce(F.get(x, F.lit(1)), never).alias("y"))), F.lit(0.0))))

    points = F.transform(F.array(k, mode, far), log_p)
    named = let(points, lambda x: F.struct(F.get(x, F.lit(0)).alias("k"), F.get(x, F.lit(1)).alias("mode"), F.get(x, F.lit(2)).alias("far")))
    return F.when(k == mode, 0.0).otherwise(let(named, both))


def _log_sum(v: Column) -> Column:
    top, low = F.greatest(v["x"], v["y"]), F.least(v["x"], v["y"])
    return top + F.log1p(F.exp(low - top))


def fisher_exact(a, b, c, d, side: str = "greater") -> Column:
    """Exact p-value of the table [[a, b], [c, d]]."""
    return F.exp(fisher_log(a, b, c, d, side))


def fisher_log(a, b, c, d, side: str = "greater") -> Column:
    """Natural logarithm of the exact p-value; keeps what a double of p itself cannot hold."""
    cells = F.struct(*[_col(x).cast("bigint").alias(name) for x, name in zip((a, b, c, d), "abcd")])
    return let(cells, lambda t: _fisher(t["a"], t["b"], t["c"], t["d"], side))


def _fisher(a, b, c, d, side):
    r, m, n = a + b, a + c, a + b + c + d
    lo, hi = F.greatest(F.lit(0).cast("bigint"), m + r - n), F.least(r, m)
    wide = lambda x: x.cast("double")
    # Doubles: the product of two margins may pass a bigint.
    mode = F.greatest(lo, F.least(hi, F.floor((wide(r) + 1) * ((wide(m) + 1) / (wide(n) + 2))).cast("bigint")))
    sd = F.sqrt((wide(r) / n) * (wide(m) / n) * wide(n - r) * (wide(n - m) / F.greatest(n - 1, F.lit(1))))
    p, q = wide(m) / n, wide(n - m) / n

    def log_p(k):
        return let(_log_binomials((wide(k), wide(r), p, q), (wide(m - k), wide(n - r), p, q), (wide(m), wide(n), p, q)), lambda v: F.get(v, F.lit(0)) + F.get(v, F.lit(1)) - F.get(v, F.lit(2)))

    def up(k):
        return wide(r - k) / wide(k + 1) * (wide(m - k) / wide(n - r - m + k + 1))

    def down(k):
        return wide(k) / wide(r - k + 1) * (wide(n - r - m + k) / wide(m - k + 1))

    return F.when((n == 0) | (lo == hi), 0.0).otherwise(_log_tail(a, lo, hi, mode, sd, log_p, up, down, side))


def binom_test(k, n, p, side: str = "two-sided") -> Column:
    return F.exp(binom_log(k, n, p, side))


def binom_log(k, n, p, side: str = "two-sided") -> Column:
    """Natural logarithm of the exact binomial p-value."""
    k, n, p = _col(k).cast("bigint"), _col(n).cast("bigint"), _col(p).cast("double")
    q = 1.0 - p
    mode = F.least(F.floor((n + 1) * p).cast("bigint"), n)
    body = _log_tail(
        k, F.lit(0).cast("bigint"), n, mode, F.sqrt(n * p * q), lambda i: F.get(_log_binomials((i.cast("double"), n.cast("double"), p, q)), F.lit(0)),
        lambda i: (n - i).cast("double") / (i + 1) * (p / q),
        lambda i: i.cast("double") / (n - i + 1) * (q / p),
        side,
    )
    never = F.lit(float("-inf"))
    certain = {"greater": F.when((p >= 1) | (k <= 0), 0.0).otherwise(never), "less": F.when((p <= 0) | (k >= n), 0.0).otherwise(never)}
    edge = certain.get(side, F.when(((p <= 0) & (k == 0)) | ((p >= 1) & (k == n)), 0.0).otherwise(never))
    return F.when((p <= 0) | (p >= 1), edge).otherwise(body)


def odds_ratio_ci(a, b, c, d) -> Column:
    """struct(odds_ratio, lo, hi): half added to every cell, Wald interval on the log scale."""
    a, b, c, d = (_col(x) + 0.5 for x in (a, b, c, d))
    ratio = a * d / (b * c)
    half = 1.96 * F.sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)
    return F.struct(
        ratio.alias("odds_ratio"), F.exp(F.log(ratio) - half).alias("lo"), F.exp(F.log(ratio) + half).alias("hi")
    )


def odds_ratio_pseudo(a, b, c, d, add: float = 0.5) -> Column:
    a, b, c, d = (_col(x) + add for x in (a, b, c, d))
    return F.when(b * c == 0, F.lit(float("inf"))).otherwise(a * d / (b * c))
