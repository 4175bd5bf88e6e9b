"""One regression network per lead time and repeat, all trained in the same passes.

A lead may hold any number of samples, so a model is not tied to one task: the samples of a lead
lie in pieces, whose tasks take many local steps and are averaged between rounds. The driver holds the
weights (their size is leads × repeats × one small network).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.functions import arrow, mlp
from galewise.operators.forecast import NEAREST_CELL
from galewise.operators.metrics import calibration_rmse
from galewise.operators.sampling import is_test
from galewise.plans.local_sgd import PIECE_ROWS, State, dealt, kept, one_round, piece_counts, shuffled
from galewise.session import cut_lineage

HIDDEN = [16, 4]
L2 = 1e-4
ACTIVITY_L2 = 1e-5


def _prepared(samples: DataFrame, repeats: int, test_ratio: float) -> DataFrame:
    """Samples with a 1 for every repeat that trains on them and a 0 where held out."""
    key = F.concat("gap", "F_time")
    per_mille = round(test_ratio * 1000)
    train = [F.when(is_test(key, r, per_mille), 0.0).otherwise(1.0) for r in range(1, repeats + 1)]
    return samples.select(
        F.col("gap").cast("int").alias("gap"), "F_time",
        F.col("input").alias("x"), F.col("label").cast("double").alias("y"),
        F.array(*train).alias("train"),
    ).where("y is not null and not exists(x, e -> e is null or isnan(e))")


def local_epochs(x: np.ndarray, y: np.ndarray, sizes: list[int], flat: np.ndarray, cache: np.ndarray, rate: float, batch: int, orders: list[np.ndarray]) -> tuple:
    """Mini-batch steps through ``x`` in each of ``orders``: weights, the optimizer's running squares and the last epoch's summed squared error."""
    optimizer = mlp.RmsProp(rate)
    optimizer.v, loss = cache, 0.0
    for order in orders:
        loss = 0.0
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            layers = mlp.unflatten(flat, sizes)
            steps = mlp.forward(x[at], layers)
            error = steps[-1][:, 0] - y[at]
            loss += (error**2).sum()
            flat = optimizer.update(flat, _backward(steps, layers, 2 * error[:, None])[0] / len(at) + 2 * L2 * flat)
    return flat, optimizer.v, loss


def _backward(steps, layers, d_out):
    """Backward pass with the penalty on the hidden outputs added to their gradients."""
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        if i + 1 < len(layers):
            d_out = (d_out + 2 * ACTIVITY_L2 * steps[i + 1]) * (steps[i + 1] > 0)
        grads.insert(0, (steps[i].T @ d_out, d_out.sum(axis=0)))
        d_out = d_out @ layers[i][0].T
    return mlp.flatten(grads), d_out


def train_calibration(
    samples: DataFrame, epochs: int = 256, repeats: int = 10, test_ratio: float = 0.2, rate: float = 1e-3, batch: int = 64, seed: int = 1,
    station: str = "K2962", round_epochs: int = 64, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Held-out predictions of all models: prediction, observation, raw forecast, gap, exp.

    ``samples`` is ``(gap, F_time, input, label)``; those with a missing label or input are left out. Each repeat holds out its own rows. A lead's samples
    lie in pieces of about ``piece_rows``; a task trains all repeats on its piece for ``round_epochs`` epochs of batches of ``batch``, then the pieces of a lead are averaged.
    """
    ready = _prepared(samples, repeats, test_ratio)
    counts = piece_counts(ready, "gap", piece_rows)
    rows = cut_lineage(dealt(ready, "gap", ["gap", "F_time"], piece_rows, counts), "calibration")
    # one small row per lead
    leads = rows.groupBy("gap").agg(F.max(F.size("x")).alias("width")).collect()
    if not leads:
        raise ValueError("no samples")
    sizes = [leads[0].width, *HIDDEN, 1]
    model_of = lambda gap, repeat: gap * repeats + repeat - 1
    state = {}
    for lead in leads:
        for repeat in range(1, repeats + 1):
            flat = mlp.flatten(mlp.start_layers(sizes, seed + 1000 * repeat + lead.gap, stddev=0.01))
            state[model_of(lead.gap, repeat)] = np.concatenate((flat, np.zeros_like(flat)))

    def work(first: int, count: int):
        def train(gap: int, piece: int, part: pa.RecordBatch, models: State):
            x, y, train = arrow.matrix(part["x"]), part["y"].to_numpy(), arrow.matrix(part["train"])
            for repeat in range(1, repeats + 1):
                own = np.flatnonzero(train[:, repeat - 1] > 0)
                if len(own):
                    flat, cache = np.split(models[model_of(gap, repeat)], 2)
                    orders = [shuffled(len(own), seed, gap, repeat, piece, e) for e in range(first, first + count)]
                    flat, cache, loss = local_epochs(x[own], y[own], sizes, flat, cache, rate, batch, orders)
                    yield model_of(gap, repeat), float(len(own)), loss, np.concatenate((flat, cache))

        return train

    pieces = kept(rows, ["gap", "piece"], sum(counts.values()))
    for first in range(0, epochs, round_epochs):
        state, _ = one_round(pieces, "gap", ["F_time", "y"], state, work(first, min(round_epochs, epochs - first)))
    pieces.unpersist()
    models = {(lead.gap, r): np.split(state[model_of(lead.gap, r)], 2)[0] for lead in leads for r in range(1, repeats + 1)}
    return _predict(rows, models, sizes, station)


def _predict(rows: DataFrame, models: dict, sizes: list[int], station: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(models)
    repeats = max(repeat for _, repeat in models)
    schema = "gap int, exp int, p double, o double, e double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            gaps, x, y, train = b["gap"].to_numpy(), arrow.matrix(b["x"]), b["y"].to_numpy(), arrow.matrix(b["train"])
            for gap in np.unique(gaps):
                for repeat in range(1, repeats + 1):
                    held = (gaps == gap) & (train[:, repeat - 1] == 0)
                    out = mlp.forward(x[held], mlp.unflatten(shared.value[int(gap), repeat], sizes))[-1][:, 0]
                    n = len(out)
                    yield arrow.batch(
                        gap=np.full(n, gap, np.int32), exp=np.full(n, repeat, np.int32),
                        p=out, o=y[held], e=x[held, NEAREST_CELL],
                    )

    names = {"p": "prediction", "o": "observing", "e": "ecf"}
    scored = rows.mapInArrow(run, schema)
    return scored.select("gap", "exp", *[F.col(c).alias(f"{station}_{n}") for c, n in names.items()])


def calibration_report(predictions: DataFrame, station: str = "K2962") -> tuple[DataFrame, DataFrame]:
    """Rows with a positive raw forecast, and their RMSE per lead and repeat."""
    raw = F.col(f"{station}_ecf")
    return predictions.where(~F.isnan(raw) & (raw > 0)), calibration_rmse(predictions, station)
