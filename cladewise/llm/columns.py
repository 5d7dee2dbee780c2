"""Small helpers that several operators share: document keys, guarded broadcasts, lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

__all__ = ["cut_lineage", "guarded", "keyed", "learns", "map_arrow", "read", "share_of", "ship", "text_or_empty"]

#: Largest number of narrow rows that a hint may broadcast; above it the join is left to a shuffle.
BROADCAST_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a session; the driver serves the file."""
    if getattr(spark.sparkContext, "_llm_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / f"{package.name}_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted([*package.glob("*.py"), *(package / "llm").glob("*.py")]):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._llm_shipped = True


def map_arrow(rows: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with this package's code at hand in the workers."""
    ship(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text and the columns named, with ``_key``: a fingerprint of the row's id and text.

    Rows with the same id and text share a key and get the same results; an id that is null or
    stands on several texts is therefore no trouble. The key is the same in every scan.
    """
    text = text_or_empty()
    key = F.concat(F.hex(F.xxhash64(F.col("doc_id"), text)), F.hex(F.hash(text, F.col("doc_id"))))
    return docs.select("doc_id", text.alias("text"), *keep, key.alias("_key"))


def learns(modulus: int, held: int) -> Column:
    """True for rows whose crc32(doc_id as text) leaves another remainder than ``held``; a null id never learns."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held, F.lit(False))


def share_of(column: Column) -> Column:
    """A number in [0, 1) that depends on the column's value only."""
    return F.pmod(F.xxhash64(column, F.lit("share")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def guarded(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted rows of ``small`` are within the limit; else leave the join to a shuffle."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
