"""Tree models on tables: fitting, evaluation and inspection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galewise.functions import arrow
from galewise.functions.vectors import as_double
from galewise.operators.metrics import LEAST_SHARE
from galewise.operators.sampling import train_test_split
from galewise.session import scratch_path


def feature_stages(numeric: list[str], categorical: list[str]) -> list:
    """Stages that turn the named columns, and only those, into a feature vector.

    Trees here take no missing values: numbers get the median, and a missing category
    is a category of its own.
    """
    filled = [f"{c}__filled" for c in numeric]
    coded = [f"{c}__code" for c in categorical]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=filled)] if numeric else []
    stages += [
        StringIndexer(inputCol=c, outputCol=o, handleInvalid="keep", stringOrderType="alphabetAsc")
        for c, o in zip(categorical, coded)
    ]
    return [*stages, VectorAssembler(inputCols=filled + coded, outputCol="features")]


def _label_indexer(label: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")


def _as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Categories as text, whatever their stored type."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


PIECE_CELLS = 1 << 24  # numbers that a task of a forest's fit holds: how often each tree takes each of its rows


def _fit_in_pieces(train: DataFrame, stages: list, key: str) -> PipelineModel:
    """The fitted stages, of which the last is a forest.

    Spark keeps a row with a count for every tree, and does so in the partitions it is given, however few they are. So the rows of more than one
    piece are dealt by the hash of their key, and sorted, because the trees draw by a row's place.
    """
    prepared = Pipeline(stages=stages[:-1]).fit(train)
    ready, pieces = prepared.transform(train), -(-train.count() * stages[-1].getNumTrees() // PIECE_CELLS)
    if pieces > 1:
        ready = ready.select(key, "features", stages[-1].getLabelCol()).repartition(pieces, key).sortWithinPartitions(key)
    return PipelineModel([*prepared.stages, stages[-1].fit(ready)])


def fit_forest(
    rows: DataFrame, label: str, numeric: list[str], categorical: list[str],
    trees: int = 300, depth: int = 5, key: str = "row_id", seed: int = 3,
) -> tuple[PipelineModel, DataFrame]:
    """Random forest classifier and its predictions for the held-out 30 %."""
    train, test = train_test_split(_as_text(rows, categorical), key)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, leafCol="leaf")
    stages = [_label_indexer(label), *feature_stages(numeric, categorical), forest]
    model = _fit_in_pieces(train, stages, key)
    return model, model.transform(test)


def fit_regression_forest(
    rows: DataFrame, label: str, numeric: list[str], categorical: list[str],
    trees: int = 300, key: str = "row_id", seed: int = 3,
) -> tuple[PipelineModel, DataFrame]:
    train, test = train_test_split(_as_text(rows, categorical), key)
    forest = RandomForestRegressor(numTrees=trees, labelCol=label, seed=seed, maxBins=64)
    model = _fit_in_pieces(train, [*feature_stages(numeric, categorical), forest], key)
    return model, model.transform(test)


def fit_vector_classifier(
    rows: DataFrame, vec: str, label: str, hidden: tuple[int, ...] = (128,),
    iterations: int = 100, key: str = "row_id", seed: int = 3,
) -> tuple:
    """Network over whole vectors with softmax probabilities."""
    ready = rows.select(
        key, array_to_vector(as_double(F.col(vec))).alias("features"), F.col(label).cast("double").alias("label")
    )
    train, test = train_test_split(ready, key)
    shape = ready.agg(
        F.max(F.size(vector_to_array("features"))).alias("width"), F.max("label").alias("top")
    ).first()
    layers = [shape.width, *hidden, int(shape.top) + 1]
    model = MultilayerPerceptronClassifier(layers=layers, maxIter=iterations, seed=seed).fit(train)
    return model, model.transform(test)


def accuracy_of(predictions: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predictions)


def mse_of(predictions: DataFrame, label: str) -> float:
    return RegressionEvaluator(metricName="mse", labelCol=label).evaluate(predictions)


def importances(model: PipelineModel) -> DataFrame:
    """Importance per feature, one row per feature."""
    names = [c.split("__")[0] for c in model.stages[-2].getInputCols()]
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(x)) for n, x in zip(names, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def node_table(model: RandomForestClassificationModel, spark) -> DataFrame:
    """Nodes of every tree of a fitted forest in the layout of the tree operators.

    ``leaf_idx`` numbers the leaves of a tree from left to right, as the ``leaf`` column
    of the predictions does.
    """
    path = scratch_path(spark, "forest")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    is_leaf = F.col("leftChild") < 0
    nodes = stored.select(
        F.col("treeID").cast("long").alias("tree_id"),
        F.col("id").alias("node_id"),
        F.when(is_leaf, "leaf").otherwise("split").alias("kind"),
        F.when(~is_leaf, F.col("split.featureIndex")).alias("feature_index"),
        F.when(~is_leaf, F.col("rightChild")).alias("pos"),
        F.when(~is_leaf, F.col("leftChild")).alias("neg"),
        F.col("prediction").cast("int").alias("prediction"),
        F.when(~is_leaf & (F.col("split.numCategories") < 0), F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.lit(True).alias("strict"), F.lit(False).alias("missing_eval"),
        # the categories of the right branch, as their codes are written
        F.when(~is_leaf & (F.col("split.numCategories") >= 0), F.transform(F.array_except(
            F.transform(F.sequence(F.lit(0), F.greatest(F.col("split.numCategories"), F.lit(1)) - 1), lambda x: x.cast("double")),
            F.col("split.leftCategoriesOrThreshold")), lambda x: x.cast("string"))).alias("mask"),
        F.when(is_leaf, F.transform("impurityStats", lambda x: x / F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b))).alias("probability"),
    )
    # a tree has at most 2^(depth + 1) nodes
    left_to_right = Window.partitionBy("tree_id", "kind").orderBy("node_id")
    number = F.row_number().over(left_to_right) - 1
    return nodes.withColumn("leaf_idx", F.when(F.col("kind") == "leaf", number))


def named_nodes(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Feature names in place of feature numbers."""
    lookup = F.array(*[F.lit(n) for n in names])
    return nodes.withColumn("feature", F.get(lookup, F.col("feature_index")))


def forest_votes(predictions: DataFrame, nodes: DataFrame, key: str = "row_id") -> DataFrame:
    """The vote of each tree for each row, from the leaf the row reached."""
    reached = predictions.select(
        F.col(key).alias("row_id"), F.col("label").cast("int").alias("label"),
        F.posexplode(vector_to_array("leaf")).alias("tree_no", "leaf"),
    )
    leaves = nodes.where("kind = 'leaf'").select(
        F.col("tree_id").cast("int").alias("tree_no"), F.col("leaf_idx").alias("leaf_no"),
        F.col("prediction").alias("vote"),
    )
    return reached.withColumn("leaf_no", F.col("leaf").cast("int")).join(leaves, ["tree_no", "leaf_no"]).select(
        "row_id", "label", "tree_no", "vote"
    )


def forest_curve(predictions: DataFrame, nodes: DataFrame, classes: int) -> DataFrame:
    """Held-out accuracy and log loss as the forest grows.

    The same figures as ``learning_curve`` of :func:`forest_votes`, but every task adds up
    the votes of its own rows, so no row is repeated per tree or moved.
    """
    leaves = nodes.where("kind = 'leaf'").select("tree_id", "leaf_idx", "prediction").toArrow()
    tree, leaf = leaves["tree_id"].to_numpy(), leaves["leaf_idx"].to_numpy()
    vote = np.zeros((tree.max() + 1, leaf.max() + 1), int)  # trees × leaves of a tree
    vote[tree, leaf] = leaves["prediction"].to_numpy()
    count = len(vote)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, loss, rows = np.zeros(count), np.zeros(count), 0
        for b in batches:
            if not b.num_rows:
                continue
            label = b["label"].to_numpy()
            votes = vote[np.arange(count), arrow.matrix(b["leaf"]).astype(int)]
            counts = np.stack([np.cumsum(votes == c, axis=1) for c in range(classes)])
            own = counts[label, np.arange(len(label))] / np.arange(1, count + 1)
            hits += (counts.argmax(axis=0) == label[:, None]).sum(axis=0)
            loss -= np.log(np.maximum(own, LEAST_SHARE)).sum(axis=0)
            rows += len(label)
        yield arrow.batch(
            trees=np.arange(1, count + 1, dtype=np.int32), n=np.full(count, float(rows)), hits=hits, loss=loss
        )

    reached = predictions.select(F.col("label").cast("int").alias("label"), vector_to_array("leaf").alias("leaf"))
    sums = reached.mapInArrow(run, "trees int, n double, hits double, loss double").groupBy("trees")
    return sums.agg(
        (F.sum("hits") / F.sum("n")).alias("accuracy"), (F.sum("loss") / F.sum("n")).alias("logloss")
    )
