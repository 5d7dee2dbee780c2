"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns, and what each method promises."""

import collections
import itertools
import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladewise.llm import boosting, decontaminate, langid, licenses, line_templates, mixing, near_dups, neighbours, pii, quality, token_counts
from cladewise.llm.components import components
from cladewise.llm.wordhash import ALNUM_WORDS, word_hashes, word_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, id long, score double, n long, quality_score double"
draw = random.Random(5)
VOCABULARY = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG = prose(30_000, 1)
ODD = [None, "", " \n\t ", "one", "Été déjà 12 \x00 x", LONG, "same text stands here twice", "same text stands here twice", "mit license", "a@b.cd 1.2.3.4"]


@pytest.fixture(scope="module")
def odd(spark):
    """Ids with nulls and repeats; columns that are named as operators' own."""
    rows = [(None if i == 3 else i % 9, t, None if i % 3 else "en", None if i % 4 else "src0", None, "k", 7, 0.5, 1, 0.1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[7]], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (1, 0), (5, 1), (6, 0), (None, 1), (7, None), (8, 3), (6, 0)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(LONG.split()[500:540])), (None, "one"), (2, None), (3, ""), (4, "mit license"), (5, "mit license")], "item_id long, text string")


def operators(labels, benchmark):
    return {
        "quality": lambda d: quality.classify(d, labels), "licenses": licenses.scan, "near": near_dups.near_duplicates, "lines": line_templates.strip_templates,
        "clean": lambda d: decontaminate.decontaminate(d, benchmark), "tokens": token_counts.count_tokens, "pii": pii.find, "mixing": mixing.mix,
        "lang": lambda d: langid.identify(d, d),
    }


NAMES = ["quality", "licenses", "near", "lines", "clean", "tokens", "pii", "mixing", "lang"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, labels, benchmark, name):
    got = operators(labels, benchmark)[name](odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(odd, labels, benchmark, name):
    none = odd.where("false")
    assert operators(labels.where("false"), benchmark.where("false"))[name](none).count() == 0


def test_empty_side_tables(odd, labels, benchmark):
    assert {r.contaminated for r in decontaminate.decontaminate(odd, benchmark.where("false")).collect()} == {False}
    assert {r.score for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}
    assert {r.lang_pred for r in langid.identify(odd, odd.where("false")).collect()} == {"und"}


def test_word_hashes_do_not_depend_on_place():
    texts = ["Alpha beta", "x alpha  BETA", "", "beta,alpha"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    low, starts, ends, bounds = word_spans(data, offsets, ALNUM_WORDS)
    h = word_hashes(low, starts, ends)
    a, b, c, d = (h[bounds[i] : bounds[i + 1]] for i in range(4))
    assert len(a) == 2 and list(a) == list(b[1:]) and not len(c) and list(d) == list(a[::-1])


# 1
def test_quality_learns_and_scores_empty_texts(spark):
    rows = [(i, prose(30, i) if i % 2 else " ".join(w.upper() + "!!" for w in prose(30, i).split()), i % 2) for i in range(120)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(500, None), (501, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(a, c) for a, _, c in rows[:80]], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, marks).collect()}
    assert all(got[a].predicted == c for a, _, c in rows[80:])
    assert got[500].score == got[501].score


def test_quality_learns_from_copies(spark):
    """Few distinct texts on many rows, and a class that few texts have."""
    few = [(f"{prose(30, i)}" if i % 2 else prose(30, i).upper() + "!!", i % 2) for i in range(4)]
    model = quality.fit(spark.createDataFrame([few[i % 4] for i in range(2000)], "text string, quality int"), fit_rows=40)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(few)], "doc_id long, text string")
    assert np.abs(model.weights).any() and all((r.quality_score > 0.5) == few[r.doc_id][1] for r in quality.score(docs, model).collect())
    rare = [(prose(30, 100 + i), 1) for i in range(400)] + [(prose(30, i).upper() + "!!", 0) for i in range(4)]
    model = quality.fit(spark.createDataFrame(rare, "text string, quality int"), fit_rows=40)
    docs = spark.createDataFrame([(0, prose(30, 600).upper() + "!!"), (1, prose(30, 601))], "doc_id long, text string")
    low, high = [r.quality_score for r in quality.score(docs, model).orderBy("doc_id").collect()]
    assert np.abs(model.weights).any() and low < high and high > 0.5


def test_calibration_weights_count_as_repeats():
    margins, good = np.array([-2.0, -1.0, 0.5, 1.0, 2.0, -0.5]), np.array([False, False, False, True, True, True])
    even, heavy = quality.calibrate(margins, good), quality.calibrate(margins, good, np.where(good, 3.0, 1.0))
    assert np.allclose(even, quality.calibrate(margins, good, np.ones(6))) and heavy[1] > even[1]


def test_dual_descent_separates():
    found = [np.array([i % 2, 2 + i % 3]) for i in range(30)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(30)])
    w, b = quality.descend(found, y, np.array([-1.0, 1.0, 0.1, 0.1, 0.1]))
    assert all((w[f].sum() / np.sqrt(2) + b) * v > 0 for f, v in zip(found, y, strict=True))


# 2
def test_license_spans(spark):
    text = licenses.TEMPLATES[0][1]
    cut = text.replace("including without limitation the rights", "with the rights")  # words left out: two diagonals
    rows = [(1, prose(50, 2) + " " + text + " " + prose(20, 3)), (2, cut), (3, "the MIT, License. and gNu General  Public License mit license"), (4, "general public mit apache licenses"), (5, text[:150]), (6, "Licensed under CC BY-NC 4.0")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == got[2].labels == "mit" and got[1].base_labels == "" and got[1].score == 1 and 0.7 <= got[2].score < 1
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (3, 1, 8, "gpl,mit")
    assert (got[4].labels, got[5].labels, got[4].score) == ("", "", 0) and got[6].labels == "cc-by-nc"


# 3
def families(seed):
    r = random.Random(seed)
    docs = []
    for f in range(6):
        base = prose(r.choice([4, 8, 40, 90, 200]), seed * 100 + f).split()
        for _ in range(r.randint(2, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            docs.append(" ".join(w))
    shared = prose(60, seed)
    docs += [shared + " " + prose(r.choice([3, 6, 10, 40]), 900 + i) for i in range(30)]
    docs += docs[:5] + [None, "", "a b", "a  B"]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates(spark, seed):
    docs = families(seed)
    got = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).drop("_key")
    assert sorted(map(tuple, got.collect())) == sorted(brute.near_duplicates(docs))


def test_keep_one(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in families(4)] + [(0, families(4)[0][1], 0)], "doc_id long, text string, other long")
    want = [r for r in brute.near_duplicates(families(4)) if r[3]]
    got = near_dups.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in want)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (102, 103), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 103: 100}


# 4
def test_line_templates(spark):
    stamp = "This page was last changed on day {} by our editors here."
    passage = " ".join(prose(14, i).capitalize() + "." for i in (11, 12, 13, 14))
    rows = [(i, prose(40, 50 + i) + ".\n" + stamp.format(i) + "\n" + prose(30, 80 + i) + ".") for i in range(5)]
    rows += [(20 + i, prose(70, 120 + i) + ". " + passage + "\n" + prose(30, 140 + i) + ".") for i in range(4)]
    copy = "\n".join(prose(12, 200 + i) + "." for i in range(9))
    rows += [(40 + i, copy) for i in range(6)] + [(60, prose(90, 300))]
    got = {r.doc_id: r for r in line_templates.strip_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("last changed" not in got[i].text and got[i].n_dropped == 1 and prose(40, 50 + i) in got[i].text for i in range(5))
    assert all(passage.split(". ")[1] not in got[20 + i].text and got[20 + i].n_dropped == 4 for i in range(4))
    assert all(got[40 + i].text == copy for i in range(6)) and got[60].text == rows[-1][1]  # copies and clean texts stay whole


# 5
def test_winnowing_keeps_one_of_every_window():
    r = np.random.default_rng(3)
    h = r.integers(0, 50, 200).astype(np.uint64)
    text = np.repeat([0, 1, 2, 3], [120, 5, 3, 72])
    kept = set(decontaminate.winnow(h, text, 7).tolist())
    for t in range(4):
        at = np.flatnonzero(text == t)
        for i in range(max(len(at) - 6, 1)):
            window = at[i : i + 7]
            assert any(h[j] == h[window].min() and j in kept for j in window)


def test_contamination(spark):
    items = [(1, prose(60, 400)), (2, prose(13, 401)), (3, prose(5, 402)), (4, "solo"), (5, prose(5, 402)), (6, None), (7, prose(60, 400))]
    w = prose(60, 400).split()
    docs = [(1, prose(100, 500) + " " + " ".join(w[20:33]) + " " + prose(100, 501)), (2, " ".join(w[20:32])), (3, prose(13, 401).upper()), (4, "x, " + prose(5, 402) + " solo SOLO"), (5, prose(300, 502) + " solo"), (6, None), (7, " ".join(w) + " - " + " ".join(w)), (8, prose(12, 401))]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute.contamination(docs, items))


# 6
def test_token_counts_cut_safely():
    c = token_counts.counter("word_bpe_49k.json")
    plain = lambda t: len(c.tokenizer.encode(t, add_special_tokens=False).ids)
    texts = ["a<|endoftext|>b <|startoftext|>", "é ́x", "a\x0bb\x1cc\x85d e", "don't IT'S ΑΣ ΣΑΣ 12", "İẞ\r\n\t", "\x00a b", "", " ", LONG]
    assert c.count(texts) == list(map(plain, texts))
    assert [x for part in token_counts.balanced(texts, 10) for x in part] == texts


# 7
def test_personal_spans(spark):
    rows = [(i, f"x{i} call +1 (70{i % 10}) 555-01{i % 90 + 10} or u{i}@mail.example.com now") for i in range(60)]
    rows += [(100, "call (705) 555-0177 or 705-555-0188 now"), (101, "write to jane.doe [at] mail [dot] example [dot] com now"), (102, "in 1999 there were 12 of 300, page 7."), (103, "é 4111 1111 1111 1111, 4111-1111-1111-1112; 256.1.1.1 10.0.0.255"),
             (104, "a@b.cd_x@y.zz a@b..c @x.y +1 +12345678 +1234567890123456 1.2.3.4.5.6.7.8"), (105, "9" * 5000 + " " + "a." * 5000 + "@b.c"), (106, None)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        base = brute.personal(t)
        assert (got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert set(brute.spans(base).split(",")) - {""} <= set(got[d].spans.split(","))
    assert "phone:5:19" in got[100].spans.split(",") and got[102].spans == ""


def test_boosting():
    cells = [((a, b), 10, 9 if a > 1 and b == 0 else 1) for a in range(4) for b in range(2)]
    model = boosting.calibrate(boosting.fit(cells), cells, 0.85)
    assert all((model.score(x) >= model.threshold) == (y == 9) for x, _, y in cells)


# 8
def fill(budget, children):
    """Largest level with every child at min(capacity, level * weight), by bisection."""
    low, high = 0.0, max((c / w for c, w in children), default=0.0)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(c, level * w) for c, w in children) <= budget else (low, level)
    return [min(c, low * w) for c, w in children]


def test_budgets(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 1000), ("d0", "fr", "a", 10), ("d1", "en", "a", 50), ("d1", "de", "c", 5000), ("d2", "en", "z", 0)]
    sizes = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = ({"d0": 5, "d1": 1}, {"en": 2}, {"a": 3})
    for budget in (0, 77, 900, 3000, 10**6):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(sizes, F.lit(budget).cast("long"), 2, weights).collect()}
        want, tree = {}, {(): budget}
        for depth in (1, 2, 3):
            for parent, above in [x for x in tree.items() if len(x[0]) == depth - 1]:
                nodes = sorted({leaf[:depth] for leaf in leaves if leaf[: depth - 1] == parent})
                room = [(2 * sum(x[3] for x in leaves if x[:depth] == n), weights[depth - 1].get(n[-1], 1)) for n in nodes]
                tree.update(zip(nodes, fill(above, room), strict=True))
        want = {x[:3]: tree[x[:3]] for x in leaves}
        assert all(abs(got[k] - want[k]) <= 8 for k in want), (budget, got, want)
        assert sum(got.values()) <= budget


def test_prefixes(spark):
    rows = [(i, prose(3 + i % 17, i), "en", f"src{i % 3}") for i in range(300)] + [(7, prose(10, 7), "en", "src1")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, percent=150).collect()
    assert len(got) == len(rows) and max(r.copies for r in got) - min(r.copies for r in got if r.n_tokens) <= 4
    total = sum(r.n_tokens for r in got)
    assert 1.4 * total <= sum(r.n_tokens * r.copies for r in got) <= 1.5 * total


# 9
def test_forward_sums_all_segmentations():
    voc = langid.vocabulary("piece_bpe_32k.model")
    number = {p: i for i, p in enumerate(voc.pieces)}
    table = np.random.default_rng(1).random((len(voc.pieces) + 1, 2)) * 0.01
    words = ["a", "the", "nation", "ßñ", "qqq漢"]
    got = langid.forward(words, voc, table)
    for w, row in zip(words, got, strict=True):
        text = "▁" + w
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            parts = [text[a:b] for a, b in itertools.pairwise(at)]
            if all(p in number or len(p) == 1 for p in parts):
                total += np.prod([table[number.get(p, -1)] for p in parts], axis=0)
        assert np.allclose(row, np.log(total))
    assert np.isfinite(langid.forward(["ab" * 3000], voc, table)).all()


def test_languages_of_copies_and_long_words(spark):
    """A language with many rows of few texts is learned like one without copies, and words of any length count."""
    few = [prose(12, 700 + i) for i in range(3)]
    rows = [("en", f"the nation of people number {i}".replace(str(i), "abcdefghij"[i % 10])) for i in range(50)]
    plain, copied = ([(lang, t) for lang, t in rows] + [("xx", few[i % 3]) for i in range(n)] for n in (3, 3000))
    fitted = [sorted(map(tuple, langid.fit(spark.createDataFrame(x, "lang string, text string"), fit_rows=10).where("lang = 'xx'").collect())) for x in (plain, copied)]
    assert fitted[0] and fitted[0] == fitted[1]
    voc = langid.vocabulary("piece_bpe_32k.model")
    none, long = langid.fit_pieces({}, voc), langid.fit_pieces({"nation" * 40: 3}, voc)
    at = long[:-1].argmax()
    assert set(voc.pieces[at]) <= set("nation▁") and long[at] > 100 * none[at] and abs(long.sum() - 1) < 1e-9


# 10
def test_footrule():
    r = np.random.default_rng(2)
    orders = np.stack([r.permutation(12)[:5] for _ in range(40)])
    place = lambda o: {p: i for i, p in enumerate(o)}
    want = [sum(abs(place(a).get(p, 5) - place(orders[0]).get(p, 5)) for p in {*a, *orders[0]}) for a in orders]
    got = neighbours.footrules(neighbours._places(orders, 12), orders[0]).astype(int)
    assert len({g - w for g, w in zip(got, want, strict=True)}) == 1


@pytest.mark.parametrize(("n", "pivots"), [(80_000, 128), (440_000, 256)])
def test_files_read_hold_the_neighbours(n, pivots):
    """Where a number of pivots begins to hold, which is where the recall is lowest."""
    r = np.random.default_rng(2)
    x = r.standard_normal((n, 64), dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked, chosen = x[:40], x[r.choice(n, pivots, replace=False)]
    scores = asked @ x.T
    scores[np.arange(40), np.arange(40)] = -2
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    read = np.argsort(-(asked @ chosen.T), axis=1)[:, : neighbours.files_read(pivots)]
    hits = [bool(set(np.argsort(-(chosen @ x[b]))[: neighbours.POST]) & set(q)) for q, near in zip(read, best, strict=True) for b in near]
    assert np.mean(hits) >= 0.92


def test_more_files_than_compared_pivots(spark, monkeypatch):
    """Queries may read beyond the footrule's pivots: all files read and whole files ranked is the exact search."""
    monkeypatch.setattr(neighbours, "ORDER", 4)
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, F.col("vec_id") < 5, k=5, post=1, read=16, share=1.0).collect()
    for q in range(5):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert [v.vec_id for v in sorted((v for v in got if v.query_id == q), key=lambda v: v.rank)] == np.argsort(-scores)[:5].tolist()


def test_nearest_odd_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(-i)]) for i in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0]), (42, [1.0, None, 1.0]), (43, [float("nan"), 1.0, 1.0]), (44, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (45, [1.0]), (46, [])]
    rows += [(50 + i, [1.0, 1.0, 1.0]) for i in range(30)] + [(0, [0.0, 1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("file", F.lit("x")).withColumn("score", F.lit(1))
    got = neighbours.nearest(table, F.col("vec_id") % 10 == 0, k=5).collect()
    fine = {i: v for i, v in rows if i is not None and (i < 40 or i >= 50)}
    for q in [i for i in fine if i % 10 == 0]:
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        want = sorted(((-float(np.dot(v, fine[q])), i) for i, v in fine.items() if i != q))[:5]
        assert len(mine) == 5 and len({(i, round(-s, 9)) for s, i in want} & {(i, round(s, 9)) for _, i, s in mine}) >= 4
    assert neighbours.nearest(table.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    few = neighbours.nearest(table.where("vec_id < 3"), F.col("vec_id") == 0)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [1, 2]


def test_arrow_chunks_cover_slices():
    texts = pa.array(["drop", "a b c d e f", None, "a b c d e f", ""]).slice(1)
    one, none, two, empty = near_dups.shingle_sets(texts)
    assert list(one) == list(two) and not len(none) and not len(empty)


def test_numerals_are_no_language(spark):
    docs = spark.createDataFrame([(1, prose(60, 1), "xx"), (2, "² ½ Ⅷ", None), (3, "12 _ 7", None), (4, "½ a", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, docs).collect()}
    assert got[2] == got[3] == ("und", 0.0) and got[1][0] == got[4][0] == "xx"


def test_records_cut_once_and_with_any_blank(spark):
    """Tabs, runs of blanks and blanks at the ends give the tokens that a pattern gives; no record is cut a second time to leave out leaf 0."""
    texts = ["a b c d e f7 g. h i j k l m n", "a  b c d e f g", "a\tb c d e f\rg", " \x0ba b c d e f ", "a b c d e f g \n h\n", "\f", "x 1", "", "a b c d\x01 e f 2\n3 g. h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_key long, text string")
    cut = line_templates.parsed(docs)
    want = collections.Counter()
    for key, text in enumerate(texts):
        for i, unit in enumerate(re.split(line_templates.ENDS, text)):
            bare = re.sub(r"\S*[0-9]\S*", line_templates.MASK, unit.strip(" \n\t\r\f"))
            want[key, i, len(unit), len(text), len(re.split(r"[ \t\n\x0b\f\r]+", bare)), bare] += 1
    assert collections.Counter(map(tuple, cut.select("_key", "i", "size", "doc_size", "n", "masked").collect())) == want
    plan = line_templates.crowded(cut, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and ("split" in line or "posexplode" in line)]


@pytest.mark.parametrize("percent", [80, 85])
def test_group_of_near_copies_takes_few_tries(spark, monkeypatch, percent):
    """A hundred and fifty altered copies of one text, most of which only link through others: far fewer tries than pairs, no link lost."""
    r = random.Random(9)
    base = prose(90, 21).split()
    docs = []
    for i in range(150):
        w = list(base)
        for at in r.sample(range(90), r.randint(1, 3)):
            w[at] = f"{r.choice(VOCABULARY)}{r.randint(0, 5)}"
        docs.append((i, " ".join(w)))
    seen, plain = [], near_dups._tried
    monkeypatch.setattr(near_dups, "_tried", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    got = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).drop("_key")
    assert sorted(map(tuple, got.collect())) == sorted(brute.near_duplicates(docs, percent))
    print(seen)
    assert sum(seen) < 10 * len(docs)
