"""Node tables as forests, hashed bootstrap samples and what a dealt column costs, against plain loops and Spark's own model."""

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from galewise.operators import sampling, trees
from galewise.plans import bagging, forests, hist_trees as ht, model_queries
from galewise.sources import tables as t


@pytest.fixture(scope="module")
def fitted(spark):
    rows = t.penguins(spark, SF).withColumn("hint", F.concat(F.lit("h"), (F.col("row_id") * 7 % 11).cast("string")))
    model, predictions = forests.fit_forest(rows, "species", model_queries.MEASURES, ["sex", "hint"], trees=300)
    names = [c.split("__")[0] for c in model.stages[-2].getInputCols()]
    return model, predictions, forests.named_nodes(forests.node_table(model.stages[-1], spark), names), names


def test_a_node_table_of_300_trees_scores_as_the_model(spark, fitted):
    model, predictions, nodes, names = fitted
    assert nodes.select("tree_id").distinct().count() == 300 and nodes.where("mask is not null").count() > 0
    rows = predictions.select("row_id", *[F.col(c).alias(n) for n, c in zip(names, model.stages[-2].getInputCols())])
    got = {r.row_id: (r.leaves, r.probability) for r in trees.forest_score(rows.repartition(3), nodes).collect()}
    want = {r.row_id: ([int(x) for x in r.leaf], list(r.probability)) for r in predictions.select("row_id", "leaf", "probability").collect()}
    assert got.keys() == want.keys()
    for i, (leaves, probability) in want.items():
        assert got[i][0] == leaves and got[i][1] == pytest.approx(probability)


def test_few_cells_at_a_time(spark, fitted, monkeypatch):
    model, predictions, nodes, names = fitted
    rows = predictions.select("row_id", *[F.col(c).alias(n) for n, c in zip(names, model.stages[-2].getInputCols())])
    want = sorted(trees.forest_score(rows, nodes).collect())
    monkeypatch.setattr(trees, "ROUTE_CELLS", 700)
    assert sorted(trees.forest_score(rows, nodes).collect()) == want


def test_hand_tree_as_a_table_equals_the_expression(spark):
    rows = spark.createDataFrame(
        [(i, f1, f2) for i, (f1, f2) in enumerate((x, y) for x in (None, float("nan"), 1.0, 1.5, 2.0) for y in (None, "cat", "dog", "bird", ""))],
        "row_id long, f1 double, f2 string",
    ).withColumn("f1", F.nanvl("f1", F.lit(None).cast("double")))
    for answer in (False, True):
        nodes = [{**n, **({"missing_eval": answer} if "feature" in n else {})} for n in trees.COLOUR_TREE]
        assert sorted(trees.tree_score(rows, trees.node_rows(spark, nodes)).collect()) == sorted(trees.tree_score(rows, nodes).collect())


def test_a_dealt_column_is_a_permutation_and_repeats(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    one, again, other = (dict(map(tuple, sampling.permuted(df, "k", "v", seed).collect())) for df, seed in ((rows, 1), (rows.repartition(7), 1), (rows, 2)))
    assert one == again != other and sorted(one.values()) == list(range(0, 15000, 3))
    plain = np.arange(5000) * 3
    assert abs(np.corrcoef(plain, [one[i] for i in range(5000)])[0, 1]) < 0.1


def test_dealing_a_useless_column_costs_nothing(spark):
    rows = t.tree_inputs(spark, SF).withColumn("label", F.col("row_id") % 3)
    nodes = trees.node_rows(spark, trees.COLOUR_TREE)
    own = trees.tree_score(rows, nodes).select("row_id", "leaf_idx")
    exact = rows.drop("label").join(own, "row_id").withColumn("label", F.element_at(F.array(F.lit(2), F.lit(1), F.lit(0)), F.col("leaf_idx") + 1))
    got = {r.feature: r for r in trees.permutation_importance(exact.withColumn("noise", F.col("row_id")), nodes, ["f1", "f2", "noise"], "label").collect()}
    assert got["noise"].drop == 0 and got["noise"].accuracy == 1 and got["f1"].drop > 0.1 and got["f2"].drop > 0.02


def test_bootstrap_weights_are_poisson_and_independent():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 40_000)
    a, b = bagging.bootstrap_weights(keys, 1, 3), bagging.bootstrap_weights(keys, 2, 3)
    for w in (a, b):
        for k in range(4):
            assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.01)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02 and (a == bagging.bootstrap_weights(keys[::-1], 1, 3)[::-1]).all()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), str(b), int(a > 0) if b in "pq" else 2) for i, (a, b) in enumerate(zip(rng.normal(size=500), rng.choice(list("pqrs"), 500)))]
    return spark.createDataFrame(rows, "row_id long, a double, b string, y int")


def test_out_of_bag_curve_equals_a_plain_loop(spark, labelled):
    forest = bagging.train_forest(labelled, "y", 3, ["a"], ["b"], trees=40, depth=4)
    got = {r.trees: r for r in bagging.oob_curve(forest).collect()}
    rows = forest.rows.collect()
    votes = np.zeros((len(rows), 3))
    for t_, tree in enumerate(forest.trees):
        for i, r in enumerate(rows):
            if bagging.bootstrap_weights(np.array([r.key]), t_, forest.seed)[0] == 0:
                votes[i, tree.value[int(tree.route(np.frombuffer(r.bins, np.uint8)[None])[0])]] += 1
        has = votes.sum(axis=1) > 0
        y = np.array([r.y for r in rows])
        assert got[t_ + 1].rows == has.sum()
        if has.any():
            assert got[t_ + 1].accuracy == pytest.approx((votes.argmax(axis=1) == y)[has].mean())
    assert got[40].accuracy > 0.9 and got[40].rows == 500


def test_forest_is_the_same_on_any_partitioning(spark, labelled):
    one, many = (bagging.train_forest(df, "y", 3, ["a"], ["b"], trees=5, depth=3) for df in (labelled.coalesce(1), labelled.repartition(9)))
    assert [(x.feature, x.value) for x in one.trees] == [(x.feature, x.value) for x in many.trees]
    # the tree's root holds exactly its sample
    keys = np.array([r.key for r in one.rows.collect()])
    assert [x.stats[0][-1] for x in one.trees] == [bagging.bootstrap_weights(keys, i, 3).sum() for i in range(5)]


def test_a_tree_splits_as_brute_force_does(spark, labelled):
    forest = bagging.train_forest(labelled, "y", 3, ["a"], [], trees=1, depth=1)
    rows, tree = forest.rows.collect(), forest.trees[0]
    x, y = np.array([r.bins[0] for r in rows]), np.eye(3)[[r.y for r in rows]]
    y *= bagging.bootstrap_weights(np.array([r.key for r in rows]), 0, 3)[:, None]
    purity = lambda m: (y[m].sum(axis=0) ** 2).sum() / max(y[m].sum(), 1e-12)
    best = max(purity(x > v) + purity(x <= v) for v in range(ht.BINS))
    assert purity(tree.mask[0][x]) + purity(~tree.mask[0][x]) == pytest.approx(best)


@pytest.mark.parametrize("fit, kind, label", [(forests.fit_forest, "RandomForestClassifier", "species"), (forests.fit_regression_forest, "RandomForestRegressor", "body_mass_g")])
def test_a_forest_is_fitted_on_pieces_of_bounded_size(spark, monkeypatch, fit, kind, label):
    rows, seen = t.penguins(spark, SF).coalesce(1), []
    plain = getattr(forests, kind).fit

    def noted(self, train):
        seen.append([r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()])
        return plain(self, train)

    monkeypatch.setattr(getattr(forests, kind), "fit", noted)
    monkeypatch.setattr(forests, "PIECE_CELLS", 700, raising=False)
    found = [sorted(fit(rows.repartition(n), label, ["bill_length_mm"], ["sex"], trees=10)[1].select("row_id", "prediction").collect()) for n in (1, 3)]
    total = rows.count() - len(found[0])
    assert found[0] == found[1]  # however the rows came
    assert all(sum(sizes) == total and len(sizes) > 3 and max(sizes) < 2 * 70 for sizes in seen)
