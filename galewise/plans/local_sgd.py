"""Small networks trained by many local steps where the samples are, with averages between rounds.

Samples are dealt into pieces of bounded size once. In a round the task of a piece takes mini-batch steps on its own samples from the shared
weights, and the weights and optimizer states of a model's pieces are averaged by their samples. A model whose samples fit one piece
takes exactly the steps of a sequential loop, however many rounds they are spread over. A lost task repeats one round of its piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.functions import arrow, mlp
from galewise.functions.hashing import hash_bucket
from galewise.functions.vectors import sum_vectors

PIECE_ROWS = 32768

State = dict[int, np.ndarray]  # by model: weights and optimizer state, flat


def piece_counts(rows: DataFrame, group: str, most: int) -> dict:
    """In how many pieces of about ``most`` rows the rows of each group lie."""
    return {r[group]: -(-r["count"] // most) for r in rows.groupBy(group).count().collect()}  # a row per group of models


def dealt(rows: DataFrame, group: str, key: list[str], most: int, counts: dict | None = None) -> DataFrame:
    """``rows`` with a number ``piece``: the rows of each group in as many pieces as keep them at about ``most`` rows."""
    counts = piece_counts(rows, group, most) if counts is None else counts
    table = rows.sparkSession.createDataFrame(list(counts.items()), f"`{group}` {rows.schema[group].dataType.simpleString()}, pieces int")
    spread = F.pmod(hash_bucket(1 << 20, *[F.col(c) for c in key]), F.col("pieces")).cast("int")
    return rows.join(F.broadcast(table), group).withColumn("piece", spread).drop("pieces")


def kept(pieces: DataFrame, by: list[str], count: int) -> DataFrame:
    """The rows of ``count`` pieces, which ``by`` tells apart (no constants), moved to the tasks of their pieces once and kept there for all rounds; ``unpersist`` them after the last.

    They are kept on disks, so that memory does not grow with them. What is lost with an executor is made again from where ``pieces`` come from.
    """
    return pieces.repartition(max(1, count), *by).sortWithinPartitions(*by).persist(StorageLevel.DISK_ONLY)


def shuffled(count: int, *seeds: int) -> np.ndarray:
    """A permutation that a repeated task draws again."""
    return np.random.default_rng([abs(s) for s in seeds]).permutation(count)


def one_round(
    pieces: DataFrame, group: str, order: list[str], state: State, work: Callable[[int, int, pa.RecordBatch, State], Iterator[tuple[int, float, float, np.ndarray]]]
) -> tuple[State, dict[int, float]]:
    """The averaged states after a round, and each model's mean loss.

    ``work`` gets a group, a piece, its rows in ``order`` and the states, and gives (model, samples, summed loss, state) for each of the group's models.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(state)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order]).combine_chunks()
        batch = table.to_batches()[0]
        models, blocks, values, weights = [], [], [], []
        for model, samples, loss, flat in work(batch[group][0].as_py(), batch["piece"][0].as_py(), batch, shared.value):
            own = mlp.blocks_of(np.concatenate(([samples, loss], flat * samples)))
            models.append(np.full(len(own), model, np.int32))
            blocks.append(np.arange(len(own), dtype=np.int32))
            values.append(own)
            weights.append(samples)
        if not models:
            return pa.table({"model": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "sums": pa.array([], pa.list_(pa.float64()))})
        return pa.table({"model": np.concatenate(models), "block": np.concatenate(blocks), "sums": arrow.list_column(np.vstack(values))})

    summed = pieces.groupBy(group, "piece").applyInArrow(run, "model int, block int, sums array<double>")
    rows = summed.groupBy("model", "block").agg(sum_vectors(F.col("sums"), mlp.BLOCK).alias("sums")).collect()  # the size of the models
    shared.destroy()
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.model, r.block)):
        found.setdefault(r.model, []).append(r.sums)
    out, losses = dict(state), {}
    for model, parts in found.items():
        flat = np.concatenate(parts)
        if flat[0]:
            out[model] = flat[2 : 2 + len(state[model])] / flat[0]
            losses[model] = flat[1] / flat[0]
    return out, losses
