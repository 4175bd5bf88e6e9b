"""Reading and writing the file formats of the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The forecast file name pattern and the columns of a station file.
FILE_NAME_PATTERN = r"(ecfine)\.(.*)\.(\d+)\.(.*)\.(nc)"
STATION_COLUMNS = ["StationNum", "ObservTimes", "WindDirect10", "WindVelocity10", "ExMaxWindV"]
COMMENT_TOKENS = 3

STATION_SCHEMA = T.StructType(
    [
        T.StructField("StationNum", T.StringType()),
        T.StructField("ObservTimes", T.StringType()),
        T.StructField("WindDirect10", T.IntegerType()),
        T.StructField("WindVelocity10", T.IntegerType()),
        T.StructField("ExMaxWindV", T.IntegerType()),
    ]
)


def with_name_parts(df: DataFrame, name: str) -> DataFrame:
    """Add issue time, lead and valid time taken from the file name."""

    def part(group: int):
        return F.regexp_extract(F.col(name), FILE_NAME_PATTERN, group)

    return df.select(
        "*", part(2).alias("init"), part(3).alias("gap"), part(4).alias("F_time")
    )


def discover_forecasts(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Forecast files anywhere below the roots, with the parts of their names.

    Only paths are read, never the contents.
    """
    paths = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "ecfine.*.nc")
        .load(roots)
        .select("path")
    )
    named = paths.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return with_name_parts(named, "file_name")


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header line; empty fields and NaN are both missing."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(paths)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark sorts and compares NaN as the largest number; missing must be NULL instead."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def read_stations(spark: SparkSession, paths: list[str], schema: T.StructType = STATION_SCHEMA) -> DataFrame:
    """All station files as one table with the five columns the jobs use."""
    return read_csv(spark, paths, schema).select(*STATION_COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def parse_ranking_lines(lines: DataFrame, features: list[str], with_id: bool = False) -> DataFrame:
    """``rel qid:n k:v … # comment`` → ``relevance, group, f_k…``, and ``doc_id``, the comment's last token, if asked for.

    ``lines`` has a ``value`` column, as ``spark.read.text`` gives it.
    """
    tokens = F.split("value", " ")
    kept = F.slice(tokens, 1, F.size(tokens) - COMMENT_TOKENS)
    pairs = F.transform(F.slice(kept, 3, F.size(kept) - 2), lambda t: F.split(t, ":"))
    entries = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0], p[1])))
    parsed = lines.select(kept.alias("kept"), entries.alias("f"), F.element_at(tokens, -1).alias("doc_id"))
    return parsed.select(
        F.get("kept", F.lit(0)).cast("int").alias("relevance"),
        F.concat(F.lit("g_"), F.get(F.split(F.get("kept", F.lit(1)), ":"), F.lit(1))).alias("group"),
        *[F.try_element_at("f", F.lit(k)).cast("double").alias(f"f_{k}") for k in features],
        *(["doc_id"] if with_id else []),
    )


def read_ranking_text(spark: SparkSession, paths: str | list[str], features: list[str]) -> DataFrame:
    return parse_ranking_lines(spark.read.text(paths), features)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Store an intermediate table, nested columns included, and read it back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report(detail: DataFrame, summary: DataFrame, path: str) -> None:
    """Detail rows and summary rows as two CSV outputs under one path."""
    write_csv(detail, f"{path}/details")
    write_csv(summary, f"{path}/summary")
