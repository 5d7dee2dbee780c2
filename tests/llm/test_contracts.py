"""The registered queries on the smallest tables against brute force, the libraries, SQL or held-out labels."""

import hashlib
import zlib

import brute
import duckdb
import numpy as np
import pytest

from cladewise.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.sql("SELECT doc_id, text, lang FROM documents").fetchall()


def rows(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SF).collect()]


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_op1(spark, con, docs):
    got = rows(spark, "op1_quality")
    assert sorted(r[0] for r in got) == sorted(d[0] for d in docs)
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.7) for r in got)
    labels = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    held = [(labels[r[0]], r[3]) for r in got if r[1] and r[0] in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_op2(spark, docs):
    got = sorted(rows(spark, "op2_licenses"))
    assert [r[:6] for r in got] == sorted(brute.licenses(d, t) for d, t, _ in docs)
    assert all(set(r[5].split(",")) <= set(r[6].split(",")) | {""} and 0 <= r[7] <= 1 for r in got)


def test_op3(spark, docs):
    assert sorted(rows(spark, "op3_near_duplicates")) == sorted(brute.near_duplicates([d[:2] for d in docs]))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, con, name):
    want = con.sql(ORACLES[name])
    key = lambda r: tuple(map(str, r))
    assert sorted(rows(spark, name), key=key) == sorted(want.fetchall(), key=key)
    assert want.columns == QUERIES[name](spark, SF).columns


def test_op5(spark, con, docs):
    benchmark = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    assert sorted(rows(spark, "op5_decontaminate")) == sorted(brute.contamination([d[:2] for d in docs], benchmark))


def test_op6(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for d, x, _ in docs]
    assert sorted(rows(spark, "op6_token_counts")) == sorted(want)


def test_op7(spark, docs):
    got = {r[0]: r for r in rows(spark, "op7_personal_data")}
    for d, t, _ in docs:
        base = brute.personal(t)
        assert got[d][1:5] == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert got[d][5] == hashlib.sha256(brute.spans(base).encode()).hexdigest()
        assert set(brute.spans(base).split(",")) <= set(got[d][6].split(",")) | {""}


def test_op9(spark, docs):
    langs = {d: lang for d, _, lang in docs}
    got = rows(spark, "op9_language")
    assert len(got) == len(docs) and all(0 <= r[3] <= 1 for r in got)
    held = [(langs[r[0]], r[2]) for r in got if r[1]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op10(spark, con):
    t = con.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, vectors = np.array([r[0] for r in t]), np.array([r[1] for r in t], dtype=float)
    got = {}
    for q, rank, v, score in rows(spark, "op10_nearest"):
        got.setdefault(q, []).append((rank, v, score))
    hits = 0
    for q in ids[ids % 20 == 0]:
        scores = vectors @ vectors[ids == q][0]
        scores[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and q not in {v for _, v, _ in mine}
        assert all(abs(s - scores[ids == v][0]) < 1e-9 for _, v, s in mine) and mine == sorted(mine, key=lambda x: (-x[2], x[1]))
        hits += len(best & {v for _, v, _ in mine})
    assert hits >= 0.9 * 20 * len(got)
