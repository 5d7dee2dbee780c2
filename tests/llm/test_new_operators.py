"""Whitening, substring removal and the prefix trie: brute force, exact cases, odd rows, skew and empty tables."""

import random

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.llm import prefix_trie, substrings, whitening
from cladewise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
draw = random.Random(9)
WORDS = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 5))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


# 11
def whitened(rows, components=8):
    """By numpy: vec_id, component -> (n, deviation, |whitened|, explained)."""
    kept = [(i, [float(x) for x in v]) for i, v in rows if v and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    x = np.floor(1024 * np.array([v for _, v in kept])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [sum(int(n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x.tolist()]
    return {(kept[r][0], k + 1): (n, deviation[r], abs(c[r] @ axes[:, k] / np.sqrt(e[k])), e[k] / np.trace(c.T @ c / n)) for r in range(n) for k in range(len(e))}


def held(got, want):
    assert len(got) == len(want)
    for r in got:
        n, deviation, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - w) < 1e-6 and abs(r.explained - share) < 1e-9 and r.identity_error < 1e-9


def test_op11(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    held(QUERIES["op11_whitening"](spark, SF).collect(), whitened(rows))


def test_whitening_odd_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(5) * [9, 4, 2, 1, 0.1]).tolist()) for i in range(60)]
    odd = [(900, None), (901, [1.0, None, 2.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, []), (906, [1e300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1, 0.5) for a, b in rows + odd], "vec_id long, embedding array<double>, n int, whitened double")
    got = whitening.whiten(df.drop("n").withColumn("n", F.lit(3))).collect()
    held(got, whitened(rows))
    assert {r.component for r in got} == {1, 2, 3, 4, 5}
    twice = whitening.whiten(spark.createDataFrame(rows[:20] * 2 + [(None, rows[3][1])], "vec_id long, embedding array<double>"))
    assert twice.count() == 41 * 5


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i), 0.0]) for i in range(6)], schema)).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12  # one direction only


def test_large_deviations(spark):
    rows = [(0, [1e8, 0.0]), (1, [0.0, 3.0]), (2, [5.0, 1.0]), (3, [1e5, 7.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {k[0]: v[1] for k, v in whitened(rows).items()}
    assert got == {k: v if v < 1 << 63 else None for k, v in want.items()} and None in got.values()


@pytest.mark.parametrize("spectrum", [np.linspace(1.16, 0.84, 80), 0.7 ** np.arange(80), np.r_[np.ones(10), np.zeros(70)], np.r_[5.0, np.full(79, 1.0)]])
def test_chebyshev_iteration(spectrum):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((80, 80)))[0]
    v = q * spectrum @ q.T
    values, axes = whitening.leading(lambda b: v @ b, 80, 8)
    assert np.allclose(values, np.sort(spectrum)[::-1][: len(values)], atol=1e-9) and np.linalg.norm(v @ axes - axes * values) < 1e-9
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-10


# 12
def corpus(seed):
    r = random.Random(seed)
    shared = [prose(r.choice([13, 14, 20, 60]), seed * 50 + i) for i in range(6)]
    out = []
    for i in range(60):
        parts = [prose(r.randint(0, 40), seed * 1000 + i)]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), prose(r.randint(0, 15), r.randint(0, 20))]
        out.append((r.randint(0, 50), " \n\t".join(parts)))
    return out + [out[3], (None, out[4][1]), (51, None), (52, ""), (53, " \x0b\x0c "), (54, "one word"), (55, "x " * 200), (56, "x " * 15), (2, "x " * 14), (57, "\x00 é ü\x1cz " * 9), (58, "\x00 é ü\x1cz " * 9)]


def removed(spark, docs, **conf):
    df = spark.createDataFrame([(d, t, 5, "k", 1, 2) for d, t in docs], "doc_id long, text string, n int, anchor string, tag int, start int")
    return sorted(map(str, map(tuple, substrings.remove_repeats(df, **conf).collect())))


@pytest.mark.parametrize(("seed", "span", "k"), [(1, 13, 4), (2, 13, 4), (3, 5, 2)])
def test_repeats(spark, seed, span, k):
    assert removed(spark, corpus(seed), span=span, k=k) == sorted(map(str, brute.repeats(corpus(seed), span)))


def test_hot_anchors_and_many_shards(spark, monkeypatch):
    """Anchors beyond HEAVY documents are cut into windows; shards and the bit table are small; the answer stays."""
    for name, value in (("HEAVY", 2), ("SHARD_WORDS", 50), ("MOST_BITS", 1 << 16), ("BITS_A_KEY", 1 << 20)):
        monkeypatch.setattr(substrings, name, value)
    assert removed(spark, corpus(4)) == sorted(map(str, brute.repeats(corpus(4))))


def test_repeats_in_an_empty_table(spark):
    assert removed(spark, []) == []
    assert removed(spark, [(None, None), (1, None)]) == sorted(map(str, brute.repeats([(None, None), (1, None)])))


def test_automaton_matches_longest_suffixes():
    r = random.Random(2)
    texts = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 25))] for _ in range(30)]
    for span in (1, 3, 6):
        machine = substrings.Automaton()
        for owner, words in enumerate(texts):
            machine.add(words, owner)
        machine.settle()
        windows = lambda w: [tuple(w[i : i + span]) for i in range(len(w) - span + 1)]
        for probe in texts + [[r.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]]:
            want = [min((o for o, t in enumerate(texts) if w in windows(t)), default=None) for w in windows(probe)]
            assert machine.first_owners(probe, span) == want


def test_least_of():
    h = np.random.default_rng(5).integers(0, 9, 300).astype(np.uint64)
    for width in (1, 2, 3, 7, 10):
        got = substrings.least_of(h, width)
        for i in range(len(h) - width + 1):
            w = h[i : i + width]
            assert got[i] == i + max(np.flatnonzero(w == w.min()))


# 13
def talks(seed, long=0):
    r = random.Random(seed)
    rows = []
    for _ in range(40):
        c = r.choice([100, 200, 300]) + r.randint(0, 30) if r.random() < 0.8 else r.randint(-250, 900)
        for t in range(r.randint(1, 25 if long else 9)):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "user", None, ""]), r.choice(["hi", "hé", "", None, "ok then"])))
    rows += [(100, t, "user", "turn of the head") for t in range(4)] + [(c, t, "bot", f"t{t}") for c in (501, 502, 503) for t in range(40)]
    return rows + [(None, 1, "user", "x"), rows[0], rows[0]]


def nodes(df):
    return sorted(map(str, map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = talks(seed, seed - 1)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, a int, place int, block string")
    assert nodes(prefix_trie.prefix_trie(df)) == sorted(map(str, brute.trie(brute.rebuild(rows))))


def test_trie_of_one_long_conversation(spark):
    """A conversation that holds nearly all rows, in blocks of two turns, and packs of three ids."""
    rows = [(7, t, "user", str(t % 5)) for t in range(700)] + [(c, t, "user", str(t % 5)) for c in range(300, 312) for t in range(c % 4)]
    ids, turns = prefix_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes(prefix_trie.trie(ids, turns, width=2)) == sorted(map(str, brute.trie(brute.rebuild(rows))))


def test_trie_of_an_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0


def test_ends_are_packed_in_order():
    import pyarrow as pa

    ids = sorted(random.Random(3).sample(range(-10**6, 10**6), 25_000))
    batch = pa.RecordBatch.from_pydict({"a": [1] * len(ids) + [2], "b": [1] * len(ids) + [5], "conv_id": [*ids, 9]})
    packs = list(prefix_trie._pack([batch.slice(0, 9000), batch.slice(9000)]))
    assert max(len(p.column(3)[0].as_py().split(",")) for p in packs) == prefix_trie.PACK
    got = [x for b in prefix_trie._digest(packs) for x in b.column(2).to_pylist()]
    import hashlib

    assert got == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"9").hexdigest()]
