"""The pipeline on the smallest tables, stage by stage against brute force on the stage's own input."""

import brute

import corpus_pipeline
from cladewise.llm import quality
from cladewise.llm.columns import read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents").cache()
    names = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after) and set(after) <= set(before)
        if number < 4:
            assert out.columns == names
        if number == 0:
            model = quality.learn(docs, read(spark, SF, "labels"))
            scores = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
            assert set(after) == {d for d in before if scores[d] >= 0.7}
        if number == 2:
            assert set(after) == {r[0] for r in brute.near_duplicates([(d, r.text) for d, r in before.items()], 80) if r[3]}
        if number == 3:
            items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
            assert set(after) == {r[0] for r in brute.contamination([(d, r.text) for d, r in before.items()], items) if not r[5]}
        if number not in (1, 4):
            assert all(after[d].text == before[d].text for d in after)
        docs, before = out, after
    assert set(names) <= set(docs.columns) and all(r.copies > 0 for r in before.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicates_from_eighty_percent_on(spark):
    """Pairs between 0.80 and 0.85 go, pairs below 0.80 stay: 100 words have 96 shingles, and a word changed in the middle costs five."""
    words = [f"w{i}" for i in range(100)]
    close, apart = list(words), list(words)
    close[40] = close[42] = "other"  # 89 of 103 shingles shared would be 0.864; two places two apart share seven
    close[70] = "third"
    for i in (10, 30, 50):
        apart[i] = "other"
    docs = [(1, " ".join(words)), (2, " ".join(close)), (3, " ".join(apart)), (4, "a b"), (5, None)]
    rate = lambda x, y: len(x & y) / len(x | y)
    sets = {d: brute.shingles(t) for d, t in docs}
    assert 0.77 < rate(sets[1], sets[2]) < 0.80 and rate(sets[1], sets[3]) < 0.80
    close[70] = words[70]
    docs.append((6, " ".join(close) + " tail of it"))
    sets[6] = brute.shingles(docs[-1][1])
    assert 0.80 <= rate(sets[1], sets[6]) < 0.85
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, SF).collect()}
    assert got == {r[0] for r in brute.near_duplicates(docs, 80) if r[3]} and 6 not in got and 1 in got
