"""Gradient boosting on a stored table of bins: several classes with one softmax, and ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.functions import arrow
from galewise.operators import ranking
from galewise.operators.metrics import ndcg
from galewise.operators.ranking import lambda_gradients
from galewise.plans import hist_trees as ht
from galewise.session import Versions

REFRESH = 10  # rounds after which the stored scores are brought up to date
LEAST = 1e-15


@dataclass
class Boosted:
    """Trees by round and output, and the course of the training."""

    bins: ht.Binning
    rate: float
    outputs: int
    start: np.ndarray
    rounds: list[list[ht.Tree]] = field(default_factory=list)
    loss: list[float] = field(default_factory=list)
    valid_loss: list[float] = field(default_factory=list)
    accuracy: list[float] = field(default_factory=list)
    valid_accuracy: list[float] = field(default_factory=list)

    def added(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """What the rounds from ``first`` on add to the scores of rows of bins."""
        out = np.zeros((len(x), self.outputs))
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * np.array(tree.value)[tree.route(x)]
        return out

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """Add the raw scores of every row, a number if there is one output and an array otherwise; no shuffle."""
        model, width = self, len(self.bins.names)
        keep = rows.columns
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    f = model.start + model.added(ht.bins_of(b["bins"], width))
                    made = pa.array(f[:, 0]) if model.outputs == 1 else arrow.list_column(f)
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], made], [*keep, out])

        return ht.binned(rows, self.bins, *keep).mapInArrow(run, f"{fields}, `{out}` {'double' if self.outputs == 1 else 'array<double>'}")


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_softmax(
    rows: DataFrame, label: str, classes: int, numeric: list[str], categorical: list[str], held: str,
    rounds: int = 300, depth: int = 5, rate: float = 0.1, l2: float = 1.0, least: float = 5, patience: int = 30,
) -> Boosted:
    """Boosted trees for ``label`` in 0 … ``classes`` - 1, one tree for each class and round.

    Rows where ``held`` is true are the validation set: training ends when its loss has not fallen for ``patience`` rounds, and the model is cut back
    to its best round. Losses and accuracies of both sets come from the pass that begins the next round.
    """
    bins = ht.learn_bins(rows.where(~F.col(held)), numeric, categorical)
    tables = Versions(rows.sparkSession, "boost")
    zeros = F.array_repeat(F.lit(0.0), classes).alias("f")
    current = tables.store(ht.binned(rows, bins, F.col(label).cast("int").alias("y"), F.col(held).alias("held"), zeros), "rows")
    model, width, fresh = Boosted(bins, rate, classes, np.zeros(classes)), len(bins.names), 0
    score, rank, leaf = ht.newton(l2)

    def stats(b: pa.RecordBatch, x: np.ndarray):
        y, held_out = b["y"].to_numpy(), b["held"].to_numpy(zero_copy_only=False).astype(bool)
        p = softmax(arrow.matrix(b["f"]) + model.added(x, fresh))
        loss, hit = -np.log(np.maximum(p[np.arange(len(y)), y], LEAST)), p.argmax(axis=1) == y
        more = {name: [own.sum(), loss[own].sum(), hit[own].sum()] for name, own in (("train", ~held_out), ("valid", held_out))}
        use = (~held_out).astype(float)
        return [np.stack(((y == k) - p[:, k], p[:, k] * (1 - p[:, k]), np.ones(len(y))), axis=1) * use[:, None] for k in range(classes)], more

    def note(more: dict) -> None:
        for name, losses, hits in (("train", model.loss, model.accuracy), ("valid", model.valid_loss, model.valid_accuracy)):
            n, loss, hit = more[name][:3] if name in more else (0, 0, 0)
            losses.append(loss / n if n else float("nan"))
            hits.append(hit / n if n else float("nan"))

    while len(model.rounds) < rounds:
        trees = [ht.Tree() for _ in range(classes)]
        more, _ = ht.grow(current, trees, bins, 3, stats, score, rank, depth, least)
        note(more)
        best = int(np.nanargmin(model.valid_loss)) if np.isfinite(model.valid_loss).any() else len(model.rounds)
        if len(model.rounds) - best >= patience:
            break
        for tree in trees:
            tree.value = [leaf(s) for s in tree.stats]
        model.rounds.append(trees)
        if len(model.rounds) - fresh == REFRESH:
            current, fresh = tables.store(_refreshed(current, model, fresh, width), "rows"), len(model.rounds)
    else:
        note(ht.level_sums(current, [ht.Tree()] * classes, [[]] * classes, width, 3, stats)[1])
    # the first entry of the course belongs to the model without trees
    keep = int(np.nanargmin(model.valid_loss)) if np.isfinite(model.valid_loss).any() else len(model.rounds)
    model.rounds = model.rounds[:keep]
    return model


def _refreshed(current: DataFrame, model: Boosted, first: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = arrow.matrix(b["f"]) + model.added(ht.bins_of(b["bins"], width), first)
                yield pa.RecordBatch.from_arrays([b["y"], b["held"], arrow.list_column(f), b["bins"]], ["y", "held", "f", "bins"])

    return current.mapInArrow(run, "y int, held boolean, f array<double>, bins binary")


def train_ranking(
    rows: DataFrame, features: list[str], rounds: int = 50, depth: int = 5, rate: float = 0.1, l2: float = 1e-6, least: float = 5,
    group: str = "group", relevance: str = "relevance", row_id: str = "row_id", k: int = 5, validation: DataFrame | None = None,
) -> Boosted:
    """Trees that raise NDCG at ``k`` within query groups; each round's gradients come from its scores.

    ``accuracy`` and ``valid_accuracy`` hold the mean NDCG after each round, with ``validation`` for both sets.
    The rows are moved once, into blocks of whole groups; in a round a map adds the last tree to their scores and makes the gradients.
    Only rows of groups that a task might not hold, and rows without a group, meet their partners by joins.
    """
    bins = ht.learn_bins(rows, features, [])
    tables, model, width = Versions(rows.sparkSession, "rank"), Boosted(bins, rate, 1, np.zeros(1)), len(features)
    score, rank, leaf = ht.newton(l2)
    keep = [F.col(row_id).alias("id"), F.col(group).alias("grp"), F.col(relevance).alias("rel")]
    marked = lambda df, flag: ht.binned(df, bins, *keep, F.lit(flag).alias("held"))
    every = marked(rows, False) if validation is None else marked(rows, False).unionByName(marked(validation, True))
    whole, others = ranking.by_size(tables.store(every, "bins"))
    loose = tables.store(others.select("id", "grp", "rel", "held", "bins"), "loose")
    if loose.isEmpty():
        loose = None
    blocks = tables.store(ranking.blocks_of_groups(whole), "blocks")

    def stats(b: pa.RecordBatch, x: np.ndarray):
        return [np.stack((b["lambda"].flatten().to_numpy(), b["weight"].flatten().to_numpy(), np.ones(len(x))), axis=1)], {}

    for _ in range(rounds):
        blocks = tables.store(_advanced(blocks, model, k), "blocks")
        target = blocks.where("not held").select("bins", "lambda", "weight")
        if loose is not None:
            training = loose.where("not held")
            pulls = lambda_gradients(tables.store(_scored(training, model), "scores"), k, "grp", "rel", "score", "id", tables)
            pulled = training.select("id", "bins").join(pulls, "id").select("bins", F.array("lambda").alias("lambda"), F.array("weight").alias("weight"))
            target = target.unionByName(tables.store(pulled, "target"))
        trees = [ht.Tree()]
        ht.grow(target, trees, bins, 3, stats, score, rank, depth, least)
        trees[0].value = [leaf(s) for s in trees[0].stats]
        model.rounds.append(trees)
    _ranking_course(model, blocks, loose, k)
    return model


def _scored(rows: DataFrame, model: Boosted) -> DataFrame:
    width = len(model.bins.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(model.added(ht.bins_of(b["bins"], width))[:, 0])], [*b.schema.names[:4], "score"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "grp", "rel", "held"))
    return rows.mapInArrow(run, f"{kinds}, score double")


def _advanced(blocks: DataFrame, model: Boosted, k: int) -> DataFrame:
    """The blocks with the last tree added to their scores, and the gradients of these."""
    width, rate = len(model.bins.names), model.rate
    last = model.rounds[-1][0] if model.rounds else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = b.slice(i, 1)
                f = block["score"].flatten().to_numpy()
                if last is not None:
                    f = f + rate * np.array(last.value)[last.route(ht.bins_of(block["bins"], width))]
                pull, bend = ranking.Groups.of(block).gradients(f, k)
                yield pa.RecordBatch.from_arrays([*block.columns[:4], *[arrow.list_column(x[None]) for x in (f, pull, bend)]], block.schema.names)

    return blocks.mapInArrow(run, ranking.BLOCKS)


def _ranking_course(model: Boosted, blocks: DataFrame, loose: DataFrame | None, k: int) -> None:
    """The mean NDCG of both sets after each round, all in one pass."""
    width, count = len(model.bins.names), len(model.rounds)

    def totals(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros(len(x))
        for i, (tree,) in enumerate(model.rounds):
            total = total + model.rate * np.array(tree.value)[tree.route(x)]
            yield i, total

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, count, 2))
        for b in batches:
            for i in range(b.num_rows):
                block = b.slice(i, 1)
                groups, held = ranking.Groups.of(block), int(block["held"][0].as_py())
                for r, total in totals(ht.bins_of(block["bins"], width)):
                    own = groups.ndcg(total, k)
                    found[held, r] += own.sum(), len(own)
        held, rounds = np.indices((2, count)).reshape(2, -1)
        yield arrow.batch(held=held.astype(bool), round=rounds.astype(np.int32), total=found[..., 0].ravel(), n=found[..., 1].ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for i, total in totals(ht.bins_of(b["bins"], width)):
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.full(b.num_rows, i, np.int32)), pa.array(total)], [*b.schema.names[:4], "round", "score"])

    parts = blocks.select("held", "sizes", "rel", "bins").mapInArrow(sums, "held boolean, round int, total double, n double")
    if loose is not None:
        kinds = ", ".join(f"{c} {loose.schema[c].dataType.simpleString()}" for c in ("id", "grp", "rel", "held"))
        after = loose.mapInArrow(run, f"{kinds}, round int, score double").withColumn("grp", F.struct("round", "held", "grp"))
        means = ndcg(after, "grp", "rel", "score", "id", k).groupBy("grp.held", "grp.round")
        parts = parts.unionByName(means.agg(F.sum("ndcg").alias("total"), F.count("ndcg").cast("double").alias("n")))
    found = parts.groupBy("held", "round").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect()
    for held, out in ((False, model.accuracy), (True, model.valid_accuracy)):
        by_round = {r["round"]: r.total / r.n for r in found if r.held == held}
        out += [by_round.get(i, float("nan")) for i in range(count)]
