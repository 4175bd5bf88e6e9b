"""The corpus pipeline: stages that each read what the one before has kept.

Rows without a doc_id pass the stages that judge by id. Extra columns of the documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewise.llm.common import settled
from galewise.llm.decontaminate import contaminated
from galewise.llm.line_dedup import dedup_lines
from galewise.llm.minhash import near_duplicates
from galewise.llm.mixing import mix
from galewise.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.select(COLUMNS).join(gone.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents predicted toxic; of rows that share an id, all go if one does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, score_toxicity(docs, labels).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages of lines out of the texts; a document of nothing else goes."""
    left = dedup_lines(docs, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    left = left.where(~changed | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the document with the smallest id."""
    return _without(docs, near_duplicates(docs).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, copied or edited."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights; a document comes as often as the mix takes it."""
    return mix(docs.select(COLUMNS))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages leave of documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
