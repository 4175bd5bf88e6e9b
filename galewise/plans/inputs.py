"""Inputs that several registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewise.operators import catalog, forecast
from galewise.session import cut_lineage
from galewise.sources import tables as t


def catalogue(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.video_embedding(spark, sf), t.course_platform(spark, sf), t.course(spark, sf)


def towers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Query and search vectors with flags, as two published tables would hold them."""
    rows = cut_lineage(catalog.publishable(*catalogue(spark, sf)), "towers")
    queries = rows.select("video_id", F.col("embedding_query").alias("embedding"))
    items = rows.select(
        "video_id", F.col("embedding_search").alias("embedding"), "vip_status", "needbuy_status"
    )
    return queries, items


def features(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.forecast_features(t.forecast_grid(spark, sf))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.station_labels(t.station_obs(spark, sf))


def scored_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking rows with whole-number scores, so every engine orders them alike."""
    vec = t.table(spark, sf, "embeddings")
    return vec.select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("g_"), F.floor(F.col("vec_id") / 25).cast("string")).alias("group"),
        (F.col("label") % 3).alias("relevance"),
        F.floor(F.get("embedding", F.lit(0)).cast("double") * 1000).cast("double").alias("score"),
    )
