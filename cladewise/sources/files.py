"""File governance: manifests, checksums, validation and frozen artefacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_date


def upsert_manifest(old: DataFrame, new: DataFrame, resource: str = "resource", path: str = "path", date: str = "date") -> DataFrame:
    """New entries replace old ones of the same (resource, path); the newest dated one is active."""
    both = old.join(new, [resource, path], "left_anti").unionByName(new)
    order = F.struct(F.coalesce(F.col(date).cast("string"), F.lit("")) != "", F.col(date), F.col(path))
    newest = both.groupBy(resource).agg(F.max(order)[path].alias("_p"))
    return both.join(newest, resource).withColumn("active", F.col(path) == F.col("_p")).drop("_p")


#: Bytes of a file that a task holds at once.
CHUNK = 1 << 20


def listed(spark: SparkSession, glob: str) -> DataFrame:
    """(path, size) of the files of a glob, and of the folders it names; contents are not read. Spark's own file sources leave out empty files."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(glob)
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(system.globStatus(pattern) or [])
    found = [f for s in found for f in (system.listStatus(s.getPath()) if s.isDirectory() else [s])]
    rows = [(f.getPath().toString(), f.getLen()) for f in found if f.isFile()]
    return spark.createDataFrame(rows, "path string, size long")


def opener():
    """A function from a path to a function that opens the file as a seekable stream; closed over nothing, so that it travels with a plan."""

    def find(path: str):
        from pyarrow import fs

        if path.startswith("file:"):
            return lambda: fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
        system, inner = fs.FileSystem.from_uri(path)
        return lambda: system.open_input_file(inner)

    return find


def _file_reader(work: Callable[..., list], columns: list[str]):
    """A mapInPandas function over (path, size[, kind]): ``work(opened, *rest)`` for each file, one value a column."""
    find = opener()

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(*row, *work(find(row[0]), *row[2:])) for row in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*frame.columns, *columns])

    return run


def register_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, name, size, sha256, date, kind) of every file of a glob. A file of any size is hashed in chunks by one task."""
    chunk = CHUNK

    def digest(opened) -> list:
        import hashlib

        found = hashlib.sha256()
        with opened() as stream:
            while part := stream.read(chunk):
                found.update(part)
        return [found.hexdigest()]

    files = listed(spark, glob).mapInPandas(_file_reader(digest, ["sha256"]), "path string, size long, sha256 string")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.rlike(r"\.t(sv|xt)\.gz$"), "tsv.gz").otherwise(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select("path", name.alias("name"), "size", "sha256", file_date(name).alias("date"), kind.alias("kind"))


def validate_files(spark: SparkSession, glob: str, kind: str | None = None) -> DataFrame:
    """(path, kind, status): ok, or invalid: and the reason, by kind of file (its suffix unless ``kind`` is given).

    Files are read in chunks: gzip files are inflated to their end, members of a zip file are tested one by one, JSON is
    checked token by token, parquet files at both ends, text files for a first byte.
    """
    chunk = CHUNK

    def check(opened, kind: str) -> list:
        import re
        import zipfile
        import zlib

        def chunks(stream):
            while part := stream.read(chunk):
                yield part

        def gzip(stream):
            inflate, any_byte = zlib.decompressobj(31), False
            try:
                for part in chunks(stream):
                    any_byte = True
                    while part:
                        inflate.decompress(part)
                        part = inflate.unused_data
                        if inflate.eof and part:
                            inflate = zlib.decompressobj(31)
            except zlib.error:
                return "not a gzip file"
            return None if any_byte and inflate.eof else "truncated gzip file"

        def json(stream):
            """Tokens against a stack of open brackets; ``want`` says what may come next."""
            token = re.compile(r'\s*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[\[\]{},:])')
            decode, rest, stack, want, ended = __import__("codecs").getincrementaldecoder("utf-8")(), "", [], "value", False
            while not ended:
                part = stream.read(chunk)
                ended = not part
                try:
                    rest += decode.decode(part, ended)
                except UnicodeDecodeError:
                    return "not JSON"
                at = 0
                while found := token.match(rest, at):
                    t = found[1]
                    if not ended and t not in "[]{},:" and found.end() > len(rest) - 8:
                        break  # a number may go on in the next chunk
                    at = found.end()
                    if t in "]}" and stack and stack[-1] + t in ("[]", "{}") and (want == "next" or want == "first"):
                        stack.pop()
                        want = "next" if stack else "end"
                    elif t == "," and want == "next":
                        want = "value" if stack[-1] == "[" else "key"
                    elif t == ":" and want == "colon":
                        want = "value"
                    elif t[0] == '"' and (want == "key" or (want == "first" and stack[-1] == "{")):
                        want = "colon"
                    elif t not in "]},:" and (want == "value" or (want == "first" and stack[-1] == "[")):
                        if t in "[{":
                            stack.append(t)
                            want = "first"
                        else:
                            want = "next" if stack else "end"
                    else:
                        return "not JSON"
                rest = rest[at:]
                if len(rest) > 64 * chunk:
                    return "not JSON"
            return None if want == "end" and not rest.strip() else "not JSON"

        def parquet(stream):
            size = stream.size()
            head = stream.read(4)
            stream.seek(max(size - 4, 0))
            return None if size >= 12 and head == stream.read(4) == b"PAR1" else "not a parquet file"

        def archive(stream):
            try:
                with zipfile.ZipFile(stream) as members:
                    return "damaged zip member" if members.testzip() else None
            except (zipfile.BadZipFile, ValueError):  # a stream too short to seek in
                return "not a zip file"

        def lines(stream):
            return None if stream.read(1) else "empty file"

        checks = {"gz": gzip, "json": json, "parquet": parquet, "zip": archive, "tsv": lines, "csv": lines, "txt": lines}
        if kind not in checks:
            return ["ok"]
        with opened() as stream:
            bad = checks[kind](stream)
        return [f"invalid:{bad}" if bad else "ok"]

    suffix = F.regexp_extract("path", r"\.([^.]+)$", 1) if kind is None else F.lit(kind)
    rows = listed(spark, glob).withColumn("kind", suffix)
    return rows.mapInPandas(_file_reader(check, ["status"]), "path string, size long, kind string, status string").select("path", "kind", "status")


def check_freeze(registry: DataFrame, observed: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """Frozen artefacts against what is there; a list of failures and of warnings per artefact.

    ``registry`` holds (stage_id, path, frozen, byte_size, sha256, row_count), ``observed``
    (path, size, sha256, n_rows), n_rows null where rows cannot be counted.
    """
    rows = registry.where(F.lower("frozen") == "true")
    if stages:
        rows = rows.where(F.col("stage_id").isin(stages))
    j = rows.join(observed.select("path", "size", F.col("sha256").alias("seen_sha"), "n_rows"), ["path"], "left")
    there = F.col("size").isNotNull()
    counted = F.col("row_count").try_cast("bigint")
    fails = F.array_compact(F.array(
        F.when(~there, F.lit("missing artifact")),
        F.when(there & (F.col("size") != F.col("byte_size").cast("bigint")), F.format_string("byte_size %d != %s", "size", F.col("byte_size").cast("string"))),
        F.when(there & (F.col("seen_sha") != F.col("sha256")), F.lit("sha256 differs")),
        F.when(there & (F.col("n_rows") != counted), F.format_string("row_count %d != %d", "n_rows", counted)),
    ))
    warns = F.when(there & counted.isNotNull() & F.col("n_rows").isNull(), F.lit("row_count not checked"))
    return j.select("stage_id", "path", F.array_join(fails, "; ").alias("failures"), F.coalesce(warns, F.lit("")).alias("warnings"),
                    F.when(F.size(fails) == 0, "pass").otherwise("fail").alias("status"))


def count_lines(spark: SparkSession, glob: str, header: bool = True) -> DataFrame:
    """(path, n_rows) of line files, less the header line."""
    # The path of a text row is URL-encoded, that of a listing is not.
    lines = spark.read.text(glob).select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"))
    return lines.groupBy("path").agg(F.greatest(F.count(F.lit(1)) - (1 if header else 0), F.lit(0)).alias("n_rows"))
