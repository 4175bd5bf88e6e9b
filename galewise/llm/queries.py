"""The registered corpus queries; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galewise.llm.collocations import collocations
from galewise.llm.decontaminate import contaminated
from galewise.llm.exact_dedup import exact_duplicates
from galewise.llm.line_dedup import dedup_lines
from galewise.llm.lm_scoring import score_language
from galewise.llm.minhash import near_duplicates
from galewise.llm.mixing import mix_report
from galewise.llm.pii import replace_pii
from galewise.llm.quality import classify_quality
from galewise.llm.suffix_dedup import without_repeats
from galewise.llm.topk import exact_topk
from galewise.llm.toxicity import score_toxicity
from galewise.llm.variants import damaged_words, spelling_groups


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return without_repeats(_table(spark, sf, "documents"))


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_report(_table(spark, sf, "documents"))


def op8_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return score_language(_table(spark, sf, "documents"))


def op9_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return exact_topk(_table(spark, sf, "embeddings"))


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels")).drop("segments")


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_lines(_table(spark, sf, "documents"))


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    return classify_quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    key = spark.conf.get("spark.galewise.pii.key", "a key that the caller keeps")
    return replace_pii(_table(spark, sf, "documents"), key.encode())


def op13_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf}/documents.parquet")


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(_table(spark, sf, "documents"))


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_groups(damaged_words(_table(spark, sf, "documents")))
