"""Exact duplicates by stateful streaming: a digest-keyed state on disk, and full texts compared on every hit.

The documents are read as a stream. Its state has one entry for each digest of a normalised text, kept by RocksDB and never
expired: how many rows have met it, and of the row that stays the identifier and the locator (file and row in the file) of its content.
Tasks combine their own rows before the shuffle, so a text with a third of all rows reaches its entry as one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galewise.llm.common import settled
from galewise.session import scratch_path

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BATCH_BYTES = 1 << 40  # read by one micro-batch at most; what a restart has to do again
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would else take megabytes of disk each
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """``text`` without the characters of WHITE; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _prints(rows: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """doc_id, the normalised text and its digest, and ``place``: the order in which rows of equal texts stay, ending with the locator."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    size = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    meta = F.col("_metadata")
    place = F.struct((-size).alias("size"), doc.isNull().alias("nameless"), doc.alias("doc_id"), meta.file_path.alias("file"), meta.row_index.alias("row"))
    rows = rows.select(doc.alias("doc_id"), place.alias("place"), normalised(text).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    return rows.withColumn("digest", digest if digest_bytes == 32 else F.substring(digest, 1, digest_bytes))


def _pattern(path: str) -> str:
    """``path`` as a pattern that it alone matches: a stream takes a single file only by one."""
    path = path.rstrip("/")
    return path if set("{}[]*?\\") & set(path) else f"{path[:-1]}[{path[-1]}]"


def advance(
    spark: SparkSession, path: str, state: str, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Take the files of ``path`` that the state in the folder ``state`` has not seen, and return the state: digest, n, place.

    The folder belongs to one ``path``. A run that was broken off goes on with the batch that it had begun; files that were added since
    are taken by the next call.
    """
    both = spark.read.parquet(path).select(id_col, text_col).schema
    rows = spark.readStream.schema(both).option("maxBytesPerTrigger", str(batch_bytes)).parquet(_pattern(path))
    found = _prints(rows, id_col, text_col, digest_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    with _settings(spark, STATE):
        query = found.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        held = spark.read.format("statestore").load(state).select("key.digest", "value.*")
        return settled(held.toDF("digest", "n", "place"), "digests")


def exact_duplicates(
    spark: SparkSession, path: str, state: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after the deletion of ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the most code points stays, then the one
    with the smallest doc_id, a null one last, then the first by file and place in it, so exactly one row of a group is ``kept``, also where ids are
    repeated or missing. ``state`` names a folder of :func:`advance` to go on with; without it a new one is made in the shared folder.

    The digest (the first ``digest_bytes`` of a SHA-256) only proposes: each row of a digest met more than once is compared with the text at the locator,
    and where they differ, the rows of that digest are grouped by their full texts. Null and empty texts, and those of white space alone, are equal.
    Extra columns are never read; an empty table gives an empty result.
    """
    state = state or scratch_path(spark, "llm-exact-state")
    digests = advance(spark, path, state, id_col, text_col, digest_bytes, batch_bytes).withColumnRenamed("place", "first")
    rows = _prints(spark.read.parquet(path), id_col, text_col, digest_bytes)
    met = rows.withColumn("text_sha256", F.sha2("text", 256)).join(digests.hint("merge"), "digest")
    met = settled(met.withColumn("text", F.when(F.col("n") > 1, F.col("text"))), "exact-met")

    hits = met.where("n > 1").select("digest", "text", "place", "first")
    content = hits.where("place = first").select("digest", F.col("text").alias("content"))
    differ = hits.where("place <> first").select("digest", "text").join(content.hint("merge"), "digest").where("text <> content")
    # stored before the grouping: a grouping by the join's key would keep adaptive execution from splitting a hot digest
    differ = settled(differ.select("digest"), "exact-differ").distinct()
    if differ.isEmpty():
        return _report(met)
    apart = met.join(differ.hint("merge"), "digest", "left_semi").drop("n", "first")
    groups = apart.groupBy("digest", "text").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    apart = apart.join(settled(groups, "exact-apart").hint("merge"), ["digest", "text"])
    return _report(met.join(differ.hint("merge"), "digest", "left_anti").unionByName(apart))


def _report(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == F.col("first")).alias("kept"), "text_sha256")


def exact_duplicates_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """:func:`exact_duplicates` of any table of documents; it is written to the shared folder first, which gives its rows their locators."""
    spark = docs.sparkSession
    path = scratch_path(spark, "llm-exact-docs")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).write.parquet(path)
    return exact_duplicates(spark, path, **options)
