"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galewise.llm.common import stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096  # slices of a source whose sizes are summed apart
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(id_col: str, seed: int) -> F.Column:
    """32 hexadecimal digits by which a source's documents are put in order."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))


def water_fill(sources: DataFrame, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, weight, source_size).

    The targets add up to the sum of all sizes. Sources whose share by weight is over ``epochs`` times their size
    stop there; what they leave is shared by weight among the others, until no share is too large.
    """
    full = sources.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * epochs, None, -1
    while True:
        held = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        n, taken, weight = sources.agg(
            F.count(F.when(held, 1)), F.coalesce(F.sum(F.when(held, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped or not weight:
            break
        capped, level = n, (full - taken) / weight
    share = cap.cast("double") if level is None else F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    return sources.withColumn("target", share)


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """For (draw, source, size): source, source_size, target, whole repetitions and the draw up to which one more is taken.

    A source's documents are taken in the order of their draws until the part beyond whole repetitions is nearest
    its size. Sizes are added up in ``buckets`` slices by draw first, so only the slice that holds the limit is walked.
    """
    slot = (F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long")
    cells = stored(sizes.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("cell")), "cells")
    ordered = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = stored(water_fill(stored(ordered.withColumn("weight", weight), "sources"), epochs), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(rate + 1e-12)).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))

    before = F.sum("cell").over(Window.partitionBy("source").orderBy("slot")) - F.col("cell")
    start = cells.withColumn("start", before).withColumnRenamed("source", "s")
    start = start.join(sources.select("source", "rest"), F.col("s").eqNullSafe(F.col("source"))).where("start <= rest and rest < start + cell")
    start = stored(start.select("s", F.col("slot").alias("at"), "start", "rest"), "limits")
    walked = sizes.join(start, F.col("source").eqNullSafe(F.col("s")) & (slot == F.col("at")))
    upto = F.sum("size").over(Window.partitionBy("s").orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    walked = walked.withColumn("upto", upto + F.col("start"))
    # one document across the limit is taken if that comes nearer to it
    own = F.sum("size").over(Window.partitionBy("s", "draw"))
    taken = walked.withColumn("own", own).where("upto - own / 2 <= rest").groupBy("s").agg(F.max("draw").alias("last"))
    low = start.select(F.col("s"), F.lpad(F.lower(F.hex(F.ceil(F.col("at") * F.lit(2**32) / buckets))), 8, "0").alias("floor"))
    low = low.join(taken.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").select("s", F.coalesce("last", "floor").alias("last"))
    return stored(sources.join(low, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", F.coalesce("last", F.lit("")).alias("last")), "plan")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17,
          weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The columns of ``docs`` and, behind them, how often the mix takes each row.

    Added: mix_size (words), mix_source_size, mix_target (words of its source) and mix_copies; a column of ``docs`` with
    such a name is replaced. Only the per-source plan is joined to the documents, so texts aren't moved.

    A null source is a source, the last. A null or empty text has no words; it is taken like any other but adds nothing. A source
    without words has the target 0 and no copies. A null id draws like an empty one. Rows that share an id
    draw alike and are taken together. An empty table gives an empty result.
    """
    names = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    docs = docs.drop(*names)
    sizes = stored(docs.select(_draw(id_col, seed).alias("draw"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    plan = mixing_plan(sizes, weights, epochs).withColumnsRenamed({"source": "mix_s", "source_size": "mix_source_size", "target": "mix_target", "whole": "mix_w", "last": "mix_l"})
    rows = docs.join(plan, F.col(source_col).eqNullSafe(F.col("mix_s")))
    copies = F.when(F.col("mix_source_size") > 0, F.col("mix_w") + (_draw(id_col, seed) <= F.col("mix_l")).cast("long")).otherwise(F.lit(0))
    copies = F.least(copies.cast("long"), F.lit(epochs).cast("long"))
    return rows.select(*docs.columns, word_count(F.col(text_col)).alias("mix_size"), "mix_source_size", "mix_target", copies.alias("mix_copies"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target and taken words, as :func:`mixed` takes them."""
    out = mixed(docs.select("doc_id", "source", "text"), **options)
    return out.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.round("mix_target", 6).alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in the columns of ``docs``."""
    rows = mixed(docs, **options).where("mix_copies > 0")
    return rows.withColumn("mix_copies", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int")))).select(docs.columns)
