"""Evaluation figures as plain aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galewise.functions.vectors import softplus
from galewise.operators.topk import top_per_group

LEAST_SHARE = 1e-6  # a class without votes is scored as if it had this share


def logloss(logit: Column, label: Column) -> Column:
    """Logistic loss of one row from its logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def weighted_logloss(logit: Column, label: Column, pos_weight: Column) -> Column:
    """Logistic loss where ``pos_weight`` scales the positive rows."""
    return (1 - label) * logit + (1 + (pos_weight - 1) * label) * softplus(-logit)


def rmse(prediction: str, observed: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(prediction) - F.col(observed), F.lit(2.0))))


def mse_rmse(df: DataFrame, prediction: str, label: str) -> DataFrame:
    error = F.avg(F.pow(F.col(prediction) - F.col(label), F.lit(2.0)))
    return df.agg(error.alias("mse"), F.sqrt(error).alias("rmse"))


def accuracy(df: DataFrame, prediction: str, label: str) -> DataFrame:
    hit = F.when(F.col(prediction) == F.col(label), 1.0).otherwise(0.0)
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def calibration_rmse(df: DataFrame, station: str = "K2962", by: tuple[str, ...] = ("gap", "exp")) -> DataFrame:
    """RMSE of the calibrated and of the raw forecast per group.

    Rows whose raw forecast is not positive, or is missing, are left out.
    """
    raw = F.col(f"{station}_ecf")
    kept = df.where(~F.isnan(raw) & (raw > 0))
    return kept.groupBy(*by).agg(
        rmse(f"{station}_prediction", f"{station}_observing").alias(f"{station}_rmse_calibration"),
        rmse(f"{station}_ecf", f"{station}_observing").alias(f"{station}_rmse_ecf"),
    )


def column_counts(df: DataFrame) -> DataFrame:
    """Non-missing values per column in one pass; NaN counts as missing."""

    def present(name: str, dtype: str) -> Column:
        col = F.col(name)
        return F.count(F.when(~F.isnan(col), col) if dtype in ("double", "float") else col).alias(name)

    counts = df.agg(*[present(n, t) for n, t in df.dtypes])
    pairs = [F.struct(F.lit(n).alias("column_name"), F.col(n).alias("non_null")) for n in df.columns]
    return counts.select(F.inline(F.array(*pairs)))


def epoch_loss(losses: DataFrame) -> DataFrame:
    """Mean over the batches of an epoch of the mean loss of a batch."""
    batches = losses.groupBy("epoch", "batch_id").agg(F.avg("loss").alias("batch_loss"))
    return batches.groupBy("epoch").agg(
        F.avg("batch_loss").alias("loss"), F.count(F.lit(1)).alias("batches")
    )


def _gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance) - 1


def _discount(rank: Column) -> Column:
    return F.log2(rank + 1)


def top_ranked(scored: DataFrame, group: str, order: Column, row_id: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank."""
    return top_per_group(scored, group, [order, row_id], k, row_id, "rank")


def dcg(ranked: DataFrame, group: str, relevance: str, out: str) -> DataFrame:
    return ranked.groupBy(group).agg(
        F.sum(_gain(F.col(relevance)) / _discount(F.col("rank"))).alias(out)
    )


def ndcg(
    scored: DataFrame, group: str = "group", relevance: str = "relevance",
    score: str = "score", row_id: str = "row_id", k: int = 5,
) -> DataFrame:
    """NDCG at ``k`` per group; a group without any gain is left out."""
    got = dcg(top_ranked(scored, group, F.desc(score), row_id, k), group, relevance, "dcg")
    best = dcg(top_ranked(scored, group, F.desc(relevance), row_id, k), group, relevance, "ideal")
    return got.join(best.where("ideal > 0"), group).select(
        group, (F.col("dcg") / F.col("ideal")).alias("ndcg")
    )


def learning_curve(votes: DataFrame, classes: int) -> DataFrame:
    """Accuracy and log loss of the first 1, 2, … trees of a forest.

    ``votes`` has ``row_id, label, tree_no, vote``. Each row's votes are added up in
    tree order; a row has one vote per tree. The class with most votes wins, the smaller
    class on a tie.
    """
    so_far = Window.partitionBy("row_id").orderBy("tree_no")
    share = [
        (F.sum((F.col("vote") == c).cast("int")).over(so_far)).alias(f"n_{c}") for c in range(classes)
    ]
    counted = votes.select("row_id", "label", "tree_no", *share)
    counts = F.array(*[F.col(f"n_{c}") for c in range(classes)])
    winner = F.array_position(counts, F.array_max(counts)) - 1
    own = F.get(counts, F.col("label")) / (F.col("tree_no") + 1)
    return (
        counted.select(
            (F.col("tree_no") + 1).alias("trees"),
            (winner == F.col("label")).cast("double").alias("hit"),
            (-F.log(F.greatest(own, F.lit(LEAST_SHARE)))).alias("loss"),
        )
        .groupBy("trees")
        .agg(F.avg("hit").alias("accuracy"), F.avg("loss").alias("logloss"))
    )
