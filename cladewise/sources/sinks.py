"""Writers: the actions of a plan. Nothing comes to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_ready(df: DataFrame) -> DataFrame:
    """Not-a-number becomes null, so that a JSON reader sees no bare NaN."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def write_master(df: DataFrame, path: str, split: str = "genome") -> None:
    """Parquet, JSON lines, and JSON lines split by one column, compressed.

    The rows are made once: the text files are written from the Parquet ones.
    """
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    ready = json_ready(df.sparkSession.read.parquet(f"{path}/parquet"))
    fast = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    ready.write.mode("overwrite").options(**fast).json(f"{path}/jsonl")
    ready.write.mode("overwrite").options(**fast).partitionBy(split).json(f"{path}/by_{split}")


def format_for_text(df: DataFrame, order: Sequence[str], scientific: Sequence[str] = (), fixed: Sequence[str] = ()) -> DataFrame:
    """Fixed field order; three digits, scientific for p-values and plain for rates; null is empty."""
    def shown(c):
        if c in scientific:
            return F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.3e", F.col(c))), F.lit(""))
        if c in fixed:
            return F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))), F.lit(""))
        return F.col(c)

    return df.select(*[shown(c).alias(c) for c in order])


def write_text(df: DataFrame, path: str, order: Sequence[str], scientific: Sequence[str] = (), fixed: Sequence[str] = (),
               sep: str = "\t") -> None:
    format_for_text(df, order, scientific, fixed).write.mode("overwrite").csv(path, sep=sep, header=True)


def run_metadata(df: DataFrame, group: str, status: str) -> DataFrame:
    """One row per group with its row count and a JSON text of counts per status."""
    counts = df.groupBy(group, status).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(status), F.lit("null")).alias("status"), "n")))
    return counts.groupBy(group).agg(F.sum("n").alias("rows_total"), F.to_json(F.map_from_entries(listed)).alias("by_status"))
