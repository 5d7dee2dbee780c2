"""Set operations on keyed rows; sets are rows, never collected lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import warning_reasons

C = F.col


def set_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of two tables with the side they are on: both, left or right."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(b.select(*cols, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    agg = both.groupBy(*cols).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(C("_l") + C("_r") == 2, "both").when(C("_l") == 1, "left").otherwise("right")
    return agg.select(*cols, side.alias("side"))


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows under their tag; columns a part lacks are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)


def classification_subset(df: DataFrame, status: str, **warnings: Column) -> DataFrame:
    """clean or warning subset of classified rows, with the joined warning names."""
    ok = C(status) == "classified"
    reasons = F.when(ok, warning_reasons(**warnings))
    return df.withColumn("warning_reason", reasons).withColumn(
        "subset", F.when(ok & C("warning_reason").isNull(), "classified_clean").when(ok, "classified_warning"))


def split_views(df: DataFrame, column: str, views: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Named filters on one status column."""
    return {name: df.where(C(column).isin(list(values))) for name, values in views.items()}


def species_sets(carriers: DataFrame, readable: DataFrame, cross: DataFrame, key: str) -> DataFrame:
    """Readable (key, species) rows with whether they carry the residue and are cross-genome."""
    c = carriers.select(key, "species").distinct().withColumn("_c", F.lit(True))
    x = cross.select("species").distinct().withColumn("_x", F.lit(True))
    out = readable.select(key, "species").distinct().join(c, [key, "species"], "left").join(x, ["species"], "left")
    return out.select(key, "species", C("_c").isNotNull().alias("is_carrier"), C("_x").isNotNull().alias("in_cross"))
