"""Training jobs: losses fall, results are whole, models beat a trivial guess."""

import os

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from galewise import session
from galewise.functions import mlp
from galewise.functions.hashing import hash_bucket
from galewise.functions.vectors import random_vector
from galewise.operators import forecast, metrics, sampling
from galewise.plans import batches, calibration, embeddings, forests, inputs, local_sgd, model_queries, queries, ranker, vector_net
from galewise.sources import files
from galewise.sources import tables as t


def falls(losses):
    return all(b < a for a, b in zip(losses, losses[1:]))


def test_bpr_with_and_without_tower(spark):
    rows = spark.range(300).select(
        (F.col("id") % 10).alias("t"), (F.col("id") % 7).alias("p"), (F.col("id") * 3 % 11 + 7).alias("n")
    )
    for tower in (True, False):
        out = embeddings.train_bpr(rows, epochs=3, rate=0.05, tower=tower)
        assert falls(out.losses) and out.losses[0] == pytest.approx(np.log(2))
        assert out.search.count() == len({r for x in rows.collect() for r in (x.p, x.n)})
        assert out.query.count() == 10


def test_equal_triples_count_as_often_as_they_occur(spark):
    one = spark.createDataFrame([(0, 1, 2)] * 3 + [(0, 2, 1)], "t long, p long, n long")
    out = embeddings.train_bpr(one, epochs=1, rate=0.1, tower=False)
    vec = {r.id: np.array(r.vec) for r in out.search.collect()}
    assert np.allclose(vec[1], -vec[2]) and np.abs(vec[1]).max() > 0


def test_posneg_moves_only_the_items(spark):
    targets = spark.range(6).select("id", random_vector(F.col("id"), 8, 2, 1.0).alias("vec"))
    samples = spark.range(60).select(
        F.col("id").cast("string").alias("sample_id"), (F.col("id") % 6).alias("t"), (F.col("id") % 6).alias("p"),
        F.array((F.col("id") + 1) % 6, (F.col("id") + 2) % 6).alias("negs"),
    )
    out = embeddings.train_posneg(samples, targets, epochs=4, rate=0.05)
    assert falls(out.losses) and out.losses[0] == pytest.approx(2 * np.log(2))
    assert out.query is targets


@pytest.mark.parametrize("train_context,parts", [(True, 1), (False, 2)])
def test_nce_learns_the_positives(spark, train_context, parts):
    pairs = spark.range(200).select((F.col("id") % 20).alias("c"), (F.col("id") % 20 % 5).alias("p")).distinct()
    out = embeddings.train_nce(pairs, classes=8, epochs=5, rate=0.03, slots=32, train_context=train_context, batches=parts)
    assert out.losses[-1] < out.losses[0]
    row = out.search.first()
    assert len(row.vec) == 32 and row.vec[-1] == 1.0
    assert out.query.count() == 8


def test_batches_are_whole_and_take_more_steps(spark):
    rows = spark.range(400).select((F.col("id") % 20).alias("t"), (F.col("id") % 7).alias("p"), (F.col("id") % 11 + 7).alias("n"))
    stored = batches.store_batches(rows, 4, "test", "t", "p", "n")
    parts = [(b.count(), w) for b, w in stored]
    assert len(parts) == 4 and sum(n for n, _ in parts) == 400 and all(n == w for n, w in parts)
    once = embeddings.train_bpr(rows, epochs=2, rate=0.02, tower=False)
    often = embeddings.train_bpr(rows, epochs=2, rate=0.02, tower=False, batches=3)
    assert often.losses[-1] < once.losses[-1] and often.search.count() == once.search.count()


def test_batches_read_only_their_files(spark):
    stored = batches.store_batches(spark.range(100), 5, "test", "id")
    rows, weight = next(iter(stored))
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in text and rows.count() == weight
    samples = t.sort_sample(spark, SF)
    stored = ranker.train_ranker(samples, epochs=2, batches=3)
    assert falls(stored.losses)


def test_only_the_newest_version_stays(spark):
    tables = session.Versions(spark, "versions")
    df = spark.range(3)
    for _ in range(4):
        df = tables.store(df.withColumn("id", F.col("id") + 1), "t")
    assert sorted(r.id for r in df.collect()) == [4, 5, 6]
    assert os.listdir(tables.root) == ["t-4"]


def test_l2_pulls_towards_zero(spark):
    params = embeddings.start_table(spark.range(1), 2, 4)
    none = spark.createDataFrame([], "id long, grad array<double>")
    before = np.abs(params.first().vec)
    assert (np.abs(embeddings.adam_table(params, none, 1, 0.001, 2, l2=0.1).first().vec) < before).all()
    assert np.allclose(np.abs(embeddings.adam_table(params, none, 1, 0.001, 2).first().vec), before)


def test_start_vectors_repeat(spark):
    vec = spark.range(3).repartition(3).select("id", random_vector(F.col("id"), 4, 1).alias("v"))
    a, b = ({r.id: r.v for r in vec.collect()} for _ in range(2))
    assert a == b and len({tuple(x) for x in a.values()}) == 3
    assert all(abs(x) <= 0.05 for v in a.values() for x in v)


def test_adam_table_equals_adam(spark):
    params = embeddings.start_table(spark.range(1), 3, 4)
    adam, x = mlp.Adam(0.01), np.array(params.first().vec)
    for step in (1, 2, 3):
        g = [0.1 * step, -1.0, 0.0]
        grads = spark.createDataFrame([(0, g)], "id long, grad array<double>")
        params = embeddings.adam_table(params, grads, step, 0.01, 3)
        x = adam.update(x, np.array(g))
    assert np.allclose(params.first().vec, x)


def test_ranker_loss_falls_and_does_not_depend_on_partitions(spark, tmp_path):
    samples = t.sort_sample(spark, SF)
    a = ranker.train_ranker(samples, epochs=4)
    b = ranker.train_ranker(samples.repartition(5), epochs=4)
    assert falls(a.losses) and np.allclose(a.losses, b.losses)
    assert a.score(samples).count() == samples.count()
    weights = a.weights_table(spark)
    assert weights.count() == sum(w.shape[0] + 1 for w, _ in a.layers)
    a.save(spark, str(tmp_path / "ranker"))
    again = ranker.Ranker.load(spark, str(tmp_path / "ranker"))
    assert again.sizes == a.sizes and np.array_equal(mlp.flatten(again.layers), mlp.flatten(a.layers))


def test_calibration_beats_no_model(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        x = rng.uniform(0, 2, 5).tolist()
        rows.append((f"{3 * (1 + i % 2):03d}", f"F{2024010100 + i}", x, 3.0 * x[4] + 1))
    samples = spark.createDataFrame(rows, "gap string, F_time string, input array<double>, label double")
    out = calibration.train_calibration(samples, epochs=60, repeats=2, rate=0.04)
    detail, summary = calibration.calibration_report(out)
    assert out.columns == ["gap", "exp", "K2962_prediction", "K2962_observing", "K2962_ecf"]
    got = summary.collect()
    assert {(r.gap, r.exp) for r in got} == {(g, e) for g in (3, 6) for e in (1, 2)}
    assert all(r.K2962_rmse_calibration < r.K2962_rmse_ecf for r in got)
    assert detail.count() == out.count()


def calibration_samples(spark, rows_per_lead):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(2 * rows_per_lead):
        x = rng.uniform(0, 2, 5).tolist()
        rows.append((f"{3 * (1 + i % 2):03d}", f"F{2024010100 + i}", x, 3.0 * x[4] + 1))
    return spark.createDataFrame(rows, "gap string, F_time string, input array<double>, label double")


def test_calibration_equals_a_loop_on_one_machine(spark):
    samples = calibration_samples(spark, 90)
    got = calibration.train_calibration(samples, epochs=7, repeats=3, rate=0.01, batch=16, round_epochs=3)
    got = {(r.gap, r.exp, r.K2962_observing): r.K2962_prediction for r in got.collect()}
    want, sizes = {}, [5, *calibration.HIDDEN, 1]
    for gap in (3, 6):
        rows = sorted(r for r in calibration._prepared(samples, 3, 0.2).where(F.col("gap") == gap).collect())
        x, y, train = (np.array([r[c] for r in rows]) for c in ("x", "y", "train"))
        for repeat in (1, 2, 3):
            own = np.flatnonzero(train[:, repeat - 1])
            flat, rms = mlp.flatten(mlp.start_layers(sizes, 1 + 1000 * repeat + gap, stddev=0.01)), mlp.RmsProp(0.01)
            for epoch in range(7):
                order = own[np.random.default_rng([1, gap, repeat, 0, epoch]).permutation(len(own))]
                for lo in range(0, len(order), 16):
                    at, layers = order[lo : lo + 16], mlp.unflatten(flat, sizes)
                    steps = mlp.forward(x[at], layers)
                    gradient, _ = calibration._backward(steps, layers, 2 * (steps[-1][:, 0] - y[at])[:, None])
                    flat = rms.update(flat, gradient / len(at) + 2 * calibration.L2 * flat)
            held = np.flatnonzero(train[:, repeat - 1] == 0)
            out = mlp.forward(x[held], mlp.unflatten(flat, sizes))[-1][:, 0]
            want.update({(gap, repeat, o): p for o, p in zip(y[held], out)})
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_large_lead_is_several_pieces(spark):
    samples = calibration_samples(spark, 300)
    dealt = local_sgd.dealt(calibration._prepared(samples, 2, 0.2), "gap", ["gap", "F_time"], 50)
    sizes = [r["count"] for r in dealt.groupBy("gap", "piece").count().collect()]
    assert len(sizes) == 12 and sum(sizes) == 600 and max(sizes) < 100
    out = calibration.train_calibration(samples, epochs=60, repeats=2, rate=0.02, batch=16, round_epochs=4, piece_rows=50)
    assert all(r.K2962_rmse_calibration < 0.7 * r.K2962_rmse_ecf for r in calibration.calibration_report(out)[1].collect())


def test_ranker_equals_a_loop_on_one_machine(spark):
    samples = t.sort_sample(spark, SF).limit(400).cache()
    model = ranker.train_ranker(samples, epochs=2, batches=20)
    rows = samples.withColumn("batch", hash_bucket(20, F.col("sample_id"))).orderBy("batch", "sample_id").collect()
    flat, adam, sizes = mlp.flatten(mlp.start_layers(ranker.SIZES, 1)), mlp.Adam(1e-3), ranker.SIZES
    losses = []
    for _ in range(2):
        means = []
        for k in sorted({r.batch for r in rows}):
            own = [r for r in rows if r.batch == k]
            x = np.array([[*r.embedding_query, *r.context] for r in own], dtype=float)
            q, y = (np.array([r[c] for r in own], dtype=float) for c in ("weight", "label"))
            loss, gradient = ranker.loss_and_gradient(x, q, y, mlp.unflatten(flat, sizes))
            flat = adam.update(flat, gradient / len(own))
            means.append(loss / len(own))
        losses.append(np.mean(means))
    assert np.allclose(model.losses, losses) and np.allclose(mlp.flatten(model.layers), flat, atol=1e-9)


def test_ranker_in_pieces_learns(spark):
    samples = t.sort_sample(spark, SF)
    model = ranker.train_ranker(samples, epochs=4, batches=40, piece_rows=500)
    assert falls(model.losses)


def test_held_out_rows_are_the_counted_ones(spark):
    samples = forecast.samples_with_lag(inputs.features(spark, SF), inputs.labels(spark, SF), 1)
    predicted = calibration.train_calibration(samples, epochs=1).groupBy("gap", "exp").count()
    want = {(r.gap, r.exp): r.n for r in queries.calib_rows(spark, SF).collect()}
    assert {(r.gap, r["exp"]): r["count"] for r in predicted.collect()} == want


@pytest.fixture(scope="module")
def forest(spark):
    return forests.fit_forest(
        t.penguins(spark, SF).withColumn("hint", F.col("species")), "species",
        model_queries.MEASURES, ["sex", "hint"], trees=12,
    )


def test_forest_learns_and_lists_itself(spark, forest):
    model, predictions = forest
    assert forests.accuracy_of(predictions) > 0.9
    nodes = forests.node_table(model.stages[-1], spark)
    assert nodes.select("tree_id").distinct().count() == 12
    assert nodes.count() == model.stages[-1].totalNumNodes
    assert forests.importances(model).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_votes_of_the_node_table_are_the_votes_of_the_trees(spark, forest):
    model, predictions = forest
    votes = forests.forest_votes(predictions, forests.node_table(model.stages[-1], spark))
    last = model.stages[-1].trees[5]
    last.setPredictionCol("one").setRawPredictionCol("r").setProbabilityCol("pr").setLeafCol("")
    direct = {r.row_id: int(r.one) for r in last.transform(predictions).select("row_id", "one").collect()}
    assert {r.row_id: r.vote for r in votes.where("tree_no = 5").collect()} == direct
    curve = forests.forest_curve(predictions, forests.node_table(model.stages[-1], spark), 3).orderBy("trees").collect()
    assert [r.trees for r in curve] == list(range(1, 13)) and curve[-1].accuracy > 0.85
    for a, b in zip(curve, metrics.learning_curve(votes, 3).orderBy("trees").collect()):
        assert a.accuracy == pytest.approx(b.accuracy) and a.logloss == pytest.approx(b.logloss)


def test_regression_forest_beats_the_mean(spark):
    rows = t.abalone(spark, SF)
    _, predictions = forests.fit_regression_forest(rows, "Rings", ["LongestShell", "Diameter", "Height"], ["Type"], 10)
    spread = predictions.agg(F.var_pop("Rings")).first()[0]
    assert forests.mse_of(predictions, "Rings") < spread


def test_vector_classifier(spark):
    rows = t.table(spark, SF, "embeddings").withColumn("label", (F.get("embedding", F.lit(0)) > 0).cast("int"))
    _, predictions = forests.fit_vector_classifier(rows, "embedding", "label", (8,), 40, "vec_id")
    assert forests.accuracy_of(predictions) > 0.8
    assert abs(sum(predictions.first().probability) - 1) < 1e-9


def test_vector_net_learns_and_repeats(spark):
    rows = t.table(spark, SF, "embeddings").withColumn("label", (F.get("embedding", F.lit(0)) > 0).cast("int"))
    net = vector_net.train_vector_net(rows, "embedding", "label", "vec_id", 2, epochs=30, rate=3e-3)
    assert net.losses[-1] < 0.5 * net.losses[0]
    got = net.predict(rows, "embedding", "vec_id").join(rows.select("vec_id", "label"), "vec_id")
    assert forests.accuracy_of(got.withColumn("label", F.col("label").cast("double"))) > 0.9
    again = vector_net.train_vector_net(rows.repartition(5), "embedding", "label", "vec_id", 2, epochs=2, rate=3e-3)
    assert np.allclose(again.losses, net.losses[:2])
    pieces = vector_net.train_vector_net(rows, "embedding", "label", "vec_id", 2, epochs=20, rate=3e-3, piece_rows=30)
    assert pieces.losses[-1] < pieces.losses[0]


def test_samples_move_to_their_pieces_once(spark, monkeypatch):
    """All rounds read the same kept rows, without another shuffle."""
    samples, plans, plain = t.sort_sample(spark, SF), [], local_sgd.one_round

    def noted(pieces, group, *more):
        counted = pieces.groupBy(group, "piece").count()
        counted.collect()
        plans.append(counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("InMemoryRelation")[0])
        return plain(pieces, group, *more)

    monkeypatch.setattr(ranker, "one_round", noted)
    model = ranker.train_ranker(samples, epochs=3, batches=40, piece_rows=200)
    assert falls(model.losses) and len(plans) == 3
    assert all("Exchange" not in p and "InMemoryTableScan" in p for p in plans)
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()
