"""The registered queries that compute losses, train models or publish results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewise.functions.vectors import as_double, scale
from galewise.operators import catalog, forecast, gradients, metrics, ranking, retrieval, sampling, towers, trees
from galewise.plans import bagging, boosting, calibration, embeddings, forests, inputs, ranker
from galewise.plans import queries as base
from galewise.plans import vector_net as vector_net_plan
from galewise.session import cut_lineage, free_shuffles, scratch_path
from galewise.sources import files
from galewise.sources import tables as t


def _vectors(spark: SparkSession, sf: str, ids: DataFrame, first: int, width: int) -> DataFrame:
    """``(id, vec)`` for every id: a slice of the stored vector with number id modulo n."""
    vec = t.table(spark, sf, "embeddings")
    n = vec.agg(F.count(F.lit(1))).scalar()
    part = vec.select(
        F.col("vec_id").alias("slot"), F.slice(as_double(F.col("embedding")), first, width).alias("vec")
    )
    return ids.distinct().withColumn("slot", F.col("id") % n).join(part, "slot").select("id", "vec")


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    counted = t.triples(spark, sf).groupBy("t", "p", "n")
    stored = cut_lineage(counted.agg(F.count(F.lit(1)).cast("double").alias("weight")), "triples")
    free_shuffles(spark)
    return stored


def bpr_step(spark: SparkSession, sf: str) -> DataFrame:
    """One plain gradient step, rate 0.05, from the halves of the stored vectors."""
    rows = _triples(spark, sf)
    ids = rows.select(F.col("t").alias("id"))
    item_ids = rows.select(F.explode(F.array("p", "n")).alias("id"))
    # stored, because each is read in several steps
    targets = cut_lineage(_vectors(spark, sf, ids, 1, 32), "targets")
    items = cut_lineage(_vectors(spark, sf, item_ids, 33, 32), "items")
    grads = gradients.total(gradients.bpr_parts(rows, targets, items, 32), 32)
    start = targets.withColumn("side", F.lit("target")).unionByName(items.withColumn("side", F.lit("item")))
    moved = start.join(grads, ["side", "id"]).select(
        "side", "id", F.zip_with("vec", scale(F.col("grad"), F.lit(0.05)), lambda x, g: x - g).alias("vec")
    )
    return moved.select("side", "id", F.posexplode("vec").alias("pos", "value")).select(
        "side", "id", "pos", F.round("value", 6).alias("value")
    )


def _posneg_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Samples with a positive and two negatives, and all ids they mention."""
    rows = cut_lineage(t.triples(spark, sf), "triples")  # read in each round
    samples = rows.select(
        F.concat_ws("-", "t", "p").alias("sample_id"), "t", "p", F.array("n", "t").alias("negs")
    )
    return samples, rows.select(F.explode(F.array("t", "p", "n")).alias("id"))


def loss_pos_neg(spark: SparkSession, sf: str) -> DataFrame:
    samples, ids = _posneg_inputs(spark, sf)
    targets, items = (cut_lineage(_vectors(spark, sf, ids, first, 32), "vectors") for first in (1, 33))
    free_shuffles(spark)
    out = gradients.posneg_logits(samples, targets, items, 32, keep=("sample_id",))
    names = ["pos_logit", "neg_logit", "pos_loss", "neg_loss"]
    return out.select("sample_id", *[F.round(n, 6).alias(n) for n in names])


NCE_SLOTS = 16384


def nce_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Loss per context for vectors taken from the stored ones and drawn negatives."""
    nce, mapping = t.sim_matrix_nce(spark, sf)
    pairs = nce.select(F.col("c_idx").alias("c"), F.col("p_idx").alias("p"))
    classes = mapping.count()
    true = pairs.groupBy(F.col("c").alias("id")).agg(F.count(F.lit(1)).alias("num_true"))
    contexts = towers.fold_one(_vectors(spark, sf, true.select("id"), 1, 31), "vec", "vec").join(true, "id")
    contexts = cut_lineage(contexts, "contexts")
    items = cut_lineage(_vectors(spark, sf, mapping.select(F.col("p_idx").alias("id")), 33, 32), "items")
    negatives = gradients.draw_negatives(spark, classes, NCE_SLOTS, 5)
    parts = gradients.nce_parts(pairs, contexts, items, negatives, classes, NCE_SLOTS, 32)
    return parts.where("side = 'context'").groupBy(F.col("id").alias("c_idx")).agg(
        F.round(F.sum("loss"), 6).alias("loss")
    )


def lambda_gradients(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.scored_ranking(spark, sf).withColumn("score", F.col("score") / 100)
    out = ranking.lambda_gradients(rows)
    return out.select(
        "row_id", F.round("lambda", 6).alias("lambda"), F.round("weight", 6).alias("weight")
    )


def bpr_train(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of both towers after three epochs of pairwise training."""
    out = embeddings.train_bpr(t.triples(spark, sf), epochs=3)
    return out.query.withColumn("tower", F.lit("query")).unionByName(out.search.withColumn("tower", F.lit("search")))


def posneg_train(spark: SparkSession, sf: str) -> DataFrame:
    samples, ids = _posneg_inputs(spark, sf)
    return embeddings.train_posneg(samples, cut_lineage(_vectors(spark, sf, ids, 1, 32), "targets"), epochs=3, width=32).search


def nce_train(spark: SparkSession, sf: str) -> DataFrame:
    """Both towers of every video after two epochs, with biases folded in."""
    nce, targets = t.sim_matrix_nce(spark, sf)
    pairs = nce.select(F.col("c_idx").alias("c"), F.col("p_idx").alias("p"))
    out = embeddings.train_nce(pairs, targets.count(), epochs=2)
    return towers.tower_join(
        out.search.select(F.col("id").alias("idx"), F.col("vec").alias("embedding_search")),
        towers.id_index_map(nce, "left_video_id", "c_idx"),
        out.query.select(F.col("id").alias("idx"), F.col("vec").alias("embedding_query")),
        targets.select("video_id", F.col("p_idx").alias("idx")),
    )


def ranker_train(spark: SparkSession, sf: str) -> DataFrame:
    """Logits of all samples after ten epochs of 500 batches."""
    samples = t.sort_sample(spark, sf)
    return ranker.train_ranker(samples, epochs=10, batches=500).score(samples)


def _calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """24 leads, ten repeats, 256 epochs of batches of 64."""
    samples = forecast.samples_with_lag(inputs.features(spark, sf), inputs.labels(spark, sf), 1)
    return calibration.train_calibration(samples)


def calibration_train(spark: SparkSession, sf: str) -> DataFrame:
    """RMSE per lead and repeat of freshly trained models, read back from the report."""
    detail, summary = calibration.calibration_report(_calibrated(spark, sf))
    path = scratch_path(spark, "report")
    files.write_report(detail, summary, path)
    return files.read_csv(spark, f"{path}/summary", summary.schema)


MEASURES = ["bill_length_mm", "bill_depth_mm", "flipper_length_mm", "body_mass_g"]


def _forest(spark: SparkSession, sf: str):
    """300 trees on all measures and categories."""
    return forests.fit_forest(t.penguins(spark, sf), "species", MEASURES, ["island", "sex", "year"])


def forest_classify(spark: SparkSession, sf: str) -> DataFrame:
    _, predictions = _forest(spark, sf)
    return metrics.accuracy(predictions, "prediction", "label")


def forest_importances(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = _forest(spark, sf)
    names = [c.split("__")[0] for c in model.stages[-2].getInputCols()]
    nodes = forests.named_nodes(forests.node_table(model.stages[-1], spark), names)
    return forests.importances(model).join(trees.feature_use(nodes), "feature", "left").na.fill({"uses": 0})


def forest_learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    model, predictions = _forest(spark, sf)
    return forests.forest_curve(predictions, forests.node_table(model.stages[-1], spark), len(t.SPECIES))


def forest_inorder(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of every tree of a fitted forest in order."""
    model, _ = _forest(spark, sf)
    names = [c.split("__")[0] for c in model.stages[-2].getInputCols()]
    return trees.tree_inorder(forests.named_nodes(forests.node_table(model.stages[-1], spark), names))


def forest_table_score(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of a fitted forest on held-out rows, scored by Spark's model and by its node table."""
    model, predictions = _forest(spark, sf)
    names = [c.split("__")[0] for c in model.stages[-2].getInputCols()]
    nodes = forests.named_nodes(forests.node_table(model.stages[-1], spark), names)
    inputs_ = dict(zip(names, model.stages[-2].getInputCols()))
    rows = predictions.select("row_id", "label", *[F.col(c).alias(n) for n, c in inputs_.items()])
    won = F.array_position("probability", F.array_max("probability")) - 1
    table = trees.forest_score(rows, nodes).join(rows.select("row_id", "label"), "row_id").select("label", won.cast("double").alias("prediction"))
    one = lambda df, name: metrics.accuracy(df, "prediction", "label").withColumn("scored_by", F.lit(name))
    return one(predictions, "model").unionByName(one(table, "node_table"))


def tree_score_table(spark: SparkSession, sf: str) -> DataFrame:
    """The hand-authored tree, given as a node table."""
    return trees.tree_score(t.tree_inputs(spark, sf), trees.node_rows(spark, trees.COLOUR_TREE))


def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """What the hand-authored tree loses when one of its features is dealt anew."""
    rows = t.tree_inputs(spark, sf).withColumn("label", F.col("row_id") % 3)
    out = trees.permutation_importance(rows, trees.node_rows(spark, trees.COLOUR_TREE), ["f1", "f2"], "label")
    return out.select("feature", F.round("accuracy", 6).alias("accuracy"), F.round("drop", 6).alias("drop"))


def forest_oob_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and log loss out of bag for 1 to 300 trees."""
    rows = t.penguins(spark, sf)
    coded = rows.withColumn("y", F.array_position(F.array(*[F.lit(c) for c in sorted(t.SPECIES)]), F.col("species")) - 1)
    return bagging.oob_curve(bagging.train_forest(coded, "y", len(t.SPECIES), MEASURES, ["island", "sex", "year"]))


def boosted_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Loss and accuracy of three-class boosting after each round, on training and held-out rows; up to 300 rounds, ended by the held-out loss."""
    rows = t.penguins(spark, sf).withColumn("held", sampling.is_test(F.col("row_id"), 0, 300))
    coded = rows.withColumn("y", F.array_position(F.array(*[F.lit(c) for c in sorted(t.SPECIES)]), F.col("species")) - 1)
    model = boosting.train_softmax(coded, "y", len(t.SPECIES), ["bill_length_mm"], ["year", "sex"], "held")
    course = zip(range(len(model.loss)), model.loss, model.valid_loss, model.accuracy, model.valid_accuracy)
    return spark.createDataFrame([(i, *map(float, x)) for i, *x in course], "rounds int, loss double, valid_loss double, accuracy double, valid_accuracy double")


def forest_regress(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.abalone(spark, sf)
    _, predictions = forests.fit_regression_forest(
        rows, "Rings", ["LongestShell", "Diameter", "Height"], ["Type"]
    )
    return metrics.mse_rmse(predictions, "prediction", "Rings")


def prepared_forest(spark: SparkSession, sf: str) -> DataFrame:
    """A forest on derived inputs: body mass in kilograms beside bill length."""
    prepared = t.penguins(spark, sf).withColumn("body_mass_kg", F.col("body_mass_g") / 1000.0)
    _, predictions = forests.fit_forest(prepared, "species", ["body_mass_kg", "bill_length_mm"], [])
    return metrics.accuracy(predictions, "prediction", "label")


def vector_classify(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "embeddings")
    _, predictions = forests.fit_vector_classifier(rows, "embedding", "label", key="vec_id")
    return metrics.accuracy(predictions, "prediction", "label")


def vector_net(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out accuracy of a relu network with dropout and a softmax head, five epochs of batches of 32."""
    rows = t.table(spark, sf, "embeddings")
    train, test = sampling.train_test_split(rows, "vec_id")
    net = vector_net_plan.train_vector_net(train, "embedding", "label", "vec_id", rows.agg(F.max("label")).first()[0] + 1)
    return metrics.accuracy(net.predict(test, "embedding", "vec_id").join(test.select("vec_id", "label"), "vec_id"), "prediction", "label")


def rank_boost_train(spark: SparkSession, sf: str) -> DataFrame:
    """Mean NDCG of 50 ranking trees after each of them, on training groups and on a tenth held out."""
    rows = files.parse_ranking_lines(t.ranking_lines(spark, sf), base.FEATURES, with_id=True).withColumnRenamed("doc_id", "row_id")
    train, held = sampling.train_test_split(rows, "group", 0.1)
    model = boosting.train_ranking(train, [f"f_{k}" for k in base.FEATURES], validation=held)
    course = zip(range(1, len(model.rounds) + 1), model.accuracy, model.valid_accuracy)
    return spark.createDataFrame([(i, float(a), float(b)) for i, a, b in course], "trees int, ndcg double, valid_ndcg double")


def knn_exact_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship search with all items in one list, whose bound skips nothing."""
    queries, items = inputs.towers(spark, sf)
    return retrieval.knn_exact(queries, items, most_lists=1)


NLIST = 16  # lists of the index of the given tables


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, retrieval.IvfIndex]:
    queries, items = inputs.towers(spark, sf)
    return queries, retrieval.build_ivf(items, scratch_path(spark, "ivf"), NLIST)


def knn_ivf_full_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Search of every list of the index, which has to equal the exact search."""
    queries, index = _index(spark, sf)
    return retrieval.knn_ivf(queries, index, nprobe=NLIST)


def knn_ivf_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Search of a query's best lists until none is left whose bound reaches its last place."""
    queries, index = _index(spark, sf)
    return retrieval.knn_ivf(queries, index)


def knn_ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best beyond the offset, from as many lists as give a recall of 0.95 on a sample of queries."""
    queries, index = _index(spark, sf)
    return retrieval.knn_ivf(queries, index, limit=10, recall=0.95)


def knn_ivf_grown(spark: SparkSession, sf: str) -> DataFrame:
    """Proven search of an index that was built on a third of the items, then grew twice and split its larger lists."""
    queries, items = inputs.towers(spark, sf)
    third = [items.where(F.col("video_id") % 3 == k) for k in range(3)]
    index = retrieval.build_ivf(third[0], scratch_path(spark, "ivf"), 4)
    most = -(-items.count() // 8)
    for more in third[1:]:
        index = retrieval.extend_ivf(index, more, most)
    return retrieval.knn_ivf(queries, index)


def knn_ivf_towers(spark: SparkSession, sf: str) -> DataFrame:
    """Both towers indexed: the best items of either for the vectors of the other."""
    rows = cut_lineage(catalog.publishable(*inputs.catalogue(spark, sf)), "towers")
    flags = ["vip_status", "needbuy_status"]
    query, search = (rows.select("video_id", F.col(f"embedding_{t}").alias("embedding"), *flags) for t in catalog.TOWERS)
    found = []
    for name, wanted, items in (("search", query, search), ("query", search, query)):
        index = retrieval.build_ivf(items, scratch_path(spark, "ivf"), NLIST)
        found.append(retrieval.knn_ivf(wanted, index).withColumn("tower", F.lit(name)))
    return found[0].unionByName(found[1])


def publish_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Publish both towers twice and read the rows behind the pointer."""
    run = uuid.uuid4().hex[:8]
    rows = catalog.publishable(*inputs.catalogue(spark, sf))
    prefixes, pointer = [f"video_query_{run}_", f"video_search_{run}_"], f"video_{run}"
    for stamp in ("20240101000000", "20240102000000"):
        catalog.publish_pair(rows, *prefixes, pointer, stamp)
    both = [catalog.read_tower(spark, pointer, t).withColumn("tower", F.lit(t)) for t in catalog.TOWERS]
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    seen = both[0].unionByName(both[1]).select("tower", "video_id", "vip_status", "needbuy_status", F.round(total, 5).alias("total"))
    seen = cut_lineage(seen, "published")
    # the check leaves no tables behind
    spark.sql(f"DROP VIEW `{pointer}`")
    for prefix in prefixes:
        for row in spark.sql(f"SHOW TABLES LIKE '{prefix}*'").collect():
            spark.sql(f"DROP TABLE `{row.tableName}`")
    return seen
