"""Quality by perplexity under a Kneser-Ney model of trusted texts, with a limit for each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galewise.llm.common import U64, bit_filter, map_slices, may_hold, mix, settled, signed
from galewise.llm.ngram import build_model, score_texts

MOST_BITS = 1 << 28  # of the filter of trusted ids: 32 MB


def exact_quantiles(rows: DataFrame, group: str, value: str, quantile: float) -> DataFrame:
    """(group, limit): the quantile of each group's values, interpolated between the two ranks around it.

    Equal values are counted first, the distinct ones sorted by ranges and numbered from the counts of the ranges before, so neither a large
    group nor a frequent value fills a task.
    """
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    counts = settled(counts.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()), "quantile-values")
    own, before = Window.partitionBy(group, "part").orderBy(value), Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(group, "part").agg(F.sum("n").alias("held"))
    parts = parts.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("total", F.sum("held").over(Window.partitionBy(group)))
    placed = counts.withColumn("upto", F.sum("n").over(own)).join(parts, [group, "part"]).withColumn("end", F.col("start") + F.col("upto"))
    at = F.lit(quantile) * (F.col("total") - 1)
    for name, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
        placed = placed.withColumn(name, F.when((rank < F.col("end")) & (rank >= F.col("end") - F.col("n")), F.col(value)))
    placed = placed.where("low is not null or high is not null").withColumn("share", at - F.floor(at))
    ends = placed.groupBy(group).agg(*[F.max(c).alias(c) for c in ("low", "high", "share")])
    return ends.select(group, (F.col("low") * (1 - F.col("share")) + F.col("high") * F.col("share")).alias("limit"))


def _trusted(rows: DataFrame, good: DataFrame) -> DataFrame:
    """The rows whose ids are in ``good``, a stored table. Most others are dropped by a bit filter before the join moves any text."""

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([signed(mix(batch.column(0).to_numpy().view(U64)))], names=["h"])

    held = rows.sparkSession.sparkContext.broadcast(bit_filter(settled(good.mapInArrow(hashed, "h long"), "trusted-ids"), MOST_BITS))

    def sift(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part.column("doc_id")
        known = may_hold(held.value, mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(U64))) & ~np.array(ids.is_null())
        return part.filter(pa.array(known))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_slices(rows, "text", kinds, sift).join(good.hint("merge"), "doc_id")


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = 0.98, folds: int = 5,
) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, n_tokens, perplexity, limit, keep.

    The model counts the texts labelled 1 in quality, but for those whose crc32(doc_id as text) mod ``folds`` is 0: their perplexities, unseen
    by the model, give each language's ``quantile``, up to which a text is kept. A language without such texts, or a null one, has the
    limit of all languages together; if there is none at all, every text is kept.

    A null or empty text is the end token alone and is judged like any other. Of repeated labels the largest holds; rows without an id have no label. Repeated rows
    are judged each. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    good = settled(good.where("quality = 1").select("doc_id"), "good")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0
    trusted = settled(_trusted(rows, good).withColumn("held_out", held_out), "trusted")
    model = build_model(trusted.where("not held_out").select("text"))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    judged = score_texts(trusted.where("held_out"), model, extra=("lang",)).select("lang", perplexity.alias("perplexity"))
    judged = settled(judged, "judged")
    limits = settled(exact_quantiles(judged.where("lang is not null"), "lang", "perplexity", quantile).withColumnRenamed("lang", "own"), "limits")
    every = exact_quantiles(judged.withColumn("all", F.lit(0)), "all", "perplexity", quantile).first()
    scored = score_texts(rows, model, extra=("lang",)).withColumn("perplexity", perplexity)
    scored = scored.join(limits, scored.lang == limits.own, "left").withColumn("limit", F.coalesce("limit", F.lit(every and every.limit).cast("double")))
    return scored.select("doc_id", "lang", "n_tokens", "perplexity", "limit", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True)).alias("keep"))
