"""Pipeline of training-data stages over ``documents``; each stage's output is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm import decontaminate, line_templates, mixing, near_dups, quality
from cladewise.llm.columns import read
from cladewise.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more stay; the model learns from the labels of ``docs``."""
    docs = docs.select(*COLUMNS)
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("quality_score") >= 0.7).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate records go; a document of which nothing else was there goes with them."""
    out = line_templates.strip_templates(docs, "lang", "source", "n_chars")
    left = F.col("text").rlike(r"\S")
    changed = F.col("n_dropped") > 0
    out = out.where(~changed | left).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays: the one with the smallest id."""
    return near_dups.keep_one(docs.select(*COLUMNS), percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark passages go."""
    return decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with the number of passes that hold them (copies)."""
    out = mixing.mix(docs, "text", "n_chars")
    return out.where("copies > 0").select(*COLUMNS, "domain", "n_tokens", "copies")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The classifier is fitted, which SQL cannot say; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    root = scratch_path(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{number}")
        docs = spark.read.parquet(f"{root}/{number}")
    return docs
