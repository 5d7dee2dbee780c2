"""File governance on local files: chunks, damage, and what a token-by-token check lets pass."""

import gzip
import hashlib
import json
import zipfile

import pytest

from cladewise.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("files")


def put(folder, name, data):
    (folder / name).write_bytes(data)


def test_hash_in_chunks(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 7)
    data = bytes(range(256)) * 5
    put(folder, "a b_2024-02-03.tsv.gz", data)
    r = files.register_files(spark, f"{folder}/a b_*").first()
    assert (r.size, r.sha256, r.date, r.kind) == (len(data), hashlib.sha256(data).hexdigest(), "2024-02-03", "tsv.gz")


def test_validation(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 11)
    whole = gzip.compress(b"header\trow\n" * 50)
    put(folder, "v1.gz", whole)
    put(folder, "v2.gz", whole[:-5])
    put(folder, "v3.gz", b"plain text")
    put(folder, "v4.gz", whole + gzip.compress(b"second member"))
    put(folder, "v5.tsv", b"")
    put(folder, "v6.tsv", b"x")
    put(folder, "v7.parquet", b"PAR1" + b"0" * 30 + b"PAR1")
    put(folder, "v8.parquet", b"PAR1" + b"0" * 30)
    with zipfile.ZipFile(folder / "v9.zip", "w") as z:
        z.writestr("in", "text" * 99)
    put(folder, "v10.zip", b"PK no")
    put(folder, "v11.bin", b"")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in files.validate_files(spark, f"{folder}/v*").collect()}
    assert got == {"v1.gz": "ok", "v2.gz": "invalid:truncated gzip file", "v3.gz": "invalid:not a gzip file", "v4.gz": "ok", "v5.tsv": "invalid:empty file", "v6.tsv": "ok",
                   "v7.parquet": "ok", "v8.parquet": "invalid:not a parquet file", "v9.zip": "ok", "v10.zip": "invalid:not a zip file", "v11.bin": "ok"}


DOCUMENTS = ["{}", "[]", " [1, -2.5e+3, 0, true, false, null, \"x\\u00e9\\n\", {\"a\": {\"b\": []}, \"c\": \"d\"}] \n", "3", "\"s\"", "12345678901234567890123", json.dumps({"é": ["ü" * 40] * 9}, ensure_ascii=False),
             "", "[1,]", "[1 2]", "{\"a\" 1}", "{\"a\":}", "{a:1}", "[1", "1]", "[}", "{\"a\":1,}", "01", "[1] 2", "\"open", "tru", "nul l", "[,1]", "{\"a\":1 \"b\":2}", "\"a\tb\"", "[1]]", "- 1", "1.", "{1:2}", "[:]"]


def test_json_tokens(spark, folder, monkeypatch):
    for size in (1, 5, 1 << 20):
        monkeypatch.setattr(files, "CHUNK", size)
        for i, text in enumerate(DOCUMENTS):
            put(folder, f"j{size}_{i}.json", text.encode())
        put(folder, f"j{size}_{len(DOCUMENTS)}.json", b'["\xff"]')
        got = {int(r.path.rsplit("_", 1)[1][:-5]): r.status for r in files.validate_files(spark, f"{folder}/j{size}_*").collect()}

        def whole(text):
            try:
                json.loads(text)
                return "ok"
            except ValueError:
                return "invalid:not JSON"

        assert got == {**{i: whole(t) for i, t in enumerate(DOCUMENTS)}, len(DOCUMENTS): "invalid:not JSON"}


def test_array_records_at_every_border(spark, folder):
    """Ranges of every small size cut texts, escapes, nested records and characters in two."""
    from cladewise.sources.arrays import read_array_records

    records = [{"a": 'x{[" }], \\', "b": {"c": [1, {"d": "é]"}]}}, {}, {"q": '\\\\"', "r": [[], {}]}, {"long": "y" * 90}, {"z": "] [ \n"}]
    put(folder, "one.arr", json.dumps(records, ensure_ascii=False).encode())
    put(folder, "two.arr", b" [ \n" + b" ,\n".join(json.dumps(r).encode() for r in records[:3]) + b" , null, 3 ]\n")
    put(folder, "none.arr", b"[]")
    put(folder, "empty.arr", b"")
    want = sorted(json.dumps(r) for r in records + records[:3])
    for size in (1, 2, 3, 7, 50, 1 << 20):
        got = [json.loads(r.record) for r in read_array_records(spark, f"{folder}/*.arr", size).collect()]
        assert sorted(map(json.dumps, got)) == want, size
