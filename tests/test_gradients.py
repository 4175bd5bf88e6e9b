"""Gradients against finite differences, losses against numpy."""

import os
import time

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from galewise.functions import mlp
from galewise.operators import edges, gradients, metrics
from galewise.operators.ranking import lambda_gradients
from galewise.plans import model_queries, vector_net
from galewise.session import Versions

W = 4


def table(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<double>")


def summed(parts, width=W):
    return {(r.side, r.id): (np.array(r.grad), r.loss) for r in gradients.total(parts, width).collect()}


def softplus(x):
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def check(loss, params, side, got, eps=1e-5):
    for i in range(len(params)):
        for j in range(params.shape[1]):
            keep = params[i, j]
            params[i, j] = keep + eps
            up = loss()
            params[i, j] = keep - eps
            down = loss()
            params[i, j] = keep
            value = got[side, i][0][j] if (side, i) in got else 0.0
            assert value == pytest.approx((up - down) / (2 * eps), abs=1e-6)


@pytest.fixture
def vecs():
    rng = np.random.default_rng(2)
    return rng.normal(size=(5, W)), rng.normal(size=(6, W))


def test_bpr(spark, vecs):
    targets, items = vecs
    triples = [(0, 1, 2, 1.0), (0, 3, 2, 2.0), (4, 5, 0, 1.0), (1, 1, 3, 3.0)]
    rows = spark.createDataFrame(triples, "t long, p long, n long, weight double")
    got = summed(gradients.bpr_parts(rows, table(spark, targets), table(spark, items), W))

    def loss():
        return sum(w * softplus(-(targets[t] @ items[p] - targets[t] @ items[n])) for t, p, n, w in triples)

    assert sum(x[1] for x in got.values()) == pytest.approx(loss())
    check(loss, targets, "target", got)
    check(loss, items, "item", got)


def test_posneg(spark, vecs):
    targets, items = vecs
    samples = [("a", 0, 1, [2, 3, 3]), ("b", 2, 5, [1]), ("c", 0, 4, [1, 0])]
    rows = spark.createDataFrame(samples, "sample_id string, t long, p long, negs array<long>")
    got = summed(gradients.posneg_parts(rows, table(spark, targets), table(spark, items), W))

    def loss():
        return sum(
            softplus(-targets[t] @ items[p]) + softplus(sum(targets[t] @ items[n] for n in negs))
            for _, t, p, negs in samples
        )

    assert sum(x[1] for x in got.values()) == pytest.approx(loss())
    check(loss, items, "item", got)


@pytest.mark.parametrize("cells,rows", [(7, 2), (4 << 20, 16384)])
def test_nce(spark, vecs, monkeypatch, cells, rows):
    monkeypatch.setattr(gradients, "PRODUCT_CELLS", cells)
    monkeypatch.setattr(gradients, "SHARE_ROWS", rows)
    monkeypatch.setattr(gradients, "BLOCK_ROWS", rows)
    contexts, items = vecs
    pairs = [(0, 1), (0, 2), (0, 5), (3, 1), (4, 4)]
    slots, classes = 7, len(items)
    drawn = gradients.draw_negatives(spark, classes, slots, seed=9)
    ids = [(r.id, r.log_expected) for r in drawn.collect()]
    assert len(ids) == slots and all(0 <= k < classes for k, _ in ids)
    num_true = {c: sum(1 for a, _ in pairs if a == c) for c, _ in pairs}
    rows = table(spark, contexts).join(
        spark.createDataFrame(list(num_true.items()), "id long, num_true long"), "id"
    )
    got = summed(
        gradients.nce_parts(
            spark.createDataFrame(pairs, "c long, p long"), rows, table(spark, items), drawn, classes, slots, W
        )
    )

    def log_expected(k):
        return np.log((np.log(k + 2) - np.log(k + 1)) / np.log(classes + 1) * slots)

    def loss():
        out = 0.0
        for c, p in pairs:
            x = contexts[c] @ items[p] - log_expected(p)
            out += softplus(x) - x / num_true[c]
        return out + sum(softplus(contexts[c] @ items[k] - e) for c in num_true for k, e in ids)

    assert sum(x[1] for x in got.values()) == pytest.approx(loss())
    check(loss, contexts, "context", got)
    check(loss, items, "item", got)


def test_distinct_negatives(spark):
    drawn, tries = gradients.draw_distinct_negatives(spark, 40, 20, seed=3)
    rows = drawn.collect()
    assert len({r.id for r in rows}) == 20 <= tries and all(0 <= r.id < 40 for r in rows)
    p = [(np.log(r.id + 2) - np.log(r.id + 1)) / np.log(41) for r in rows]
    assert np.allclose([r.log_expected for r in rows], [np.log(1 - (1 - x) ** tries) for x in p])
    everything, _ = gradients.draw_distinct_negatives(spark, 6, 6, seed=1)
    assert sorted(r.id for r in everything.collect()) == list(range(6))
    with pytest.raises(ValueError):
        gradients.draw_distinct_negatives(spark, 3, 4, seed=1)


def test_sampler_probabilities_sum_to_one(spark):
    n = 50
    p = spark.range(n).select(gradients.log_uniform(F.col("id"), F.lit(float(n))).alias("p"))
    assert p.agg(F.sum("p")).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("relu_last", [False, True])
def test_mlp_backward(relu_last):
    rng = np.random.default_rng(3)
    sizes = [3, 5, 4, 2]
    flat = mlp.flatten(mlp.start_layers(sizes, 1)) + 0.05
    x = rng.normal(size=(6, 3))

    def loss(f, xs=x):
        return (mlp.forward(xs, mlp.unflatten(f, sizes), relu_last)[-1] ** 2).sum()

    layers = mlp.unflatten(flat, sizes)
    steps = mlp.forward(x, layers, relu_last)
    grad, d_in = mlp.backward(steps, layers, 2 * steps[-1], relu_last)
    for i in range(len(flat)):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        assert grad[i] == pytest.approx((loss(flat + e) - loss(flat - e)) / 2e-6, abs=1e-5)
    e = np.zeros_like(x)
    e[2, 1] = 1e-6
    assert d_in[2, 1] == pytest.approx((loss(flat, x + e) - loss(flat, x - e)) / 2e-6, abs=1e-5)


def _lambda_brute(rows, k):
    out = {r[0]: [0.0, 0.0] for r in rows}
    for g in {r[1] for r in rows}:
        grp = [r for r in rows if r[1] == g]
        by_score = sorted(grp, key=lambda r: (-r[3], r[0]))
        d = {r[0]: (1 / np.log2(i + 2) if i < k else 0.0) for i, r in enumerate(by_score)}
        best = sorted((r[2] for r in grp), reverse=True)[:k]
        ideal = sum((2**rel - 1) / np.log2(i + 2) for i, rel in enumerate(best))
        for a in grp:
            for b in grp:
                if a[2] > b[2]:
                    change = (2 ** a[2] - 2 ** b[2]) * abs(d[a[0]] - d[b[0]]) / ideal
                    rho = 1 / (1 + np.exp(a[3] - b[3]))
                    out[a[0]][0] += rho * change
                    out[b[0]][0] -= rho * change
                    for x in (a, b):
                        out[x[0]][1] += rho * (1 - rho) * change
    return out


def test_lambda_gradients_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "big" if i < 60 else f"g{i % 3}", int(rng.integers(0, 3)), float(rng.normal())) for i in range(90)]
    rows += [(100 + i, "flat", 0, float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "row_id long, group string, relevance int, score double")
    got = {r.row_id: [r["lambda"], r.weight] for r in lambda_gradients(df, 5).collect()}
    want = _lambda_brute(rows, 5)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-9)


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(5)
    z, y, q = rng.normal(size=50) * 20, rng.integers(0, 2, 50), rng.uniform(0.1, 9, 50)
    df = spark.createDataFrame(list(zip(z.tolist(), y.tolist(), q.tolist())), "z double, y int, q double")
    out = df.select(
        metrics.logloss(F.col("z"), F.col("y")).alias("l"),
        metrics.weighted_logloss(F.col("z"), F.col("y"), F.col("q")).alias("w"),
    ).toPandas()
    assert np.allclose(out["l"], softplus(z) - z * y)
    assert np.allclose(out["w"], q * y * softplus(-z) + (1 - y) * softplus(z))


def test_ndcg_against_numpy(spark):
    rows = [(1, "a", 2, 0.1), (2, "a", 0, 0.9), (3, "a", 1, 0.5), (4, "b", 0, 0.3)]
    df = spark.createDataFrame(rows, "row_id long, group string, relevance int, score double")
    got = {r.group: r.ndcg for r in metrics.ndcg(df).collect()}
    dcg, ideal = 1 / np.log2(3) + 3 / 2, 3 + 1 / np.log2(3)
    assert got == {"a": pytest.approx(dcg / ideal)}


def test_softmax_with_dropout():
    rng = np.random.default_rng(6)
    sizes, x, y = [5, 7, 3], rng.normal(size=(9, 5)), rng.integers(0, 3, 9)
    flat = mlp.flatten(mlp.start_layers(sizes, 2)) + 0.03
    mask = vector_net.dropout_mask(np.arange(9), 7, 4, 0.3, 1)
    loss = lambda f: vector_net.softmax_loss(x, y, mask, mlp.unflatten(f, sizes))[0]
    _, grad, p = vector_net.softmax_loss(x, y, mask, mlp.unflatten(flat, sizes))
    assert np.allclose(p.sum(axis=1), 1) and set(np.unique(mask)) <= {0.0, 1 / 0.7} and 0 < (mask == 0).mean() < 0.6
    for i in range(len(flat)):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        assert grad[i] == pytest.approx((loss(flat + e) - loss(flat - e)) / 2e-6, abs=1e-5)


def test_dropout_masks_repeat_and_differ_by_step():
    keys = np.random.default_rng(1).integers(-(2**60), 2**60, 3000)
    a, b = (vector_net.dropout_mask(keys, 16, step, 0.2, 1) for step in (1, 2))
    assert (a == 0).mean() == pytest.approx(0.2, abs=0.01) and abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.02
    assert (vector_net.dropout_mask(keys[::-1], 16, 1, 0.2, 1)[::-1] == a).all()


def test_edges_in_blocks_equal_joins(spark, monkeypatch):
    """Blocks of few vectors, blocks and ids with many edges, and edges without a vector at an end give what the joins give."""
    rng = np.random.default_rng(3)
    first, second = rng.normal(size=(40, W)), rng.normal(size=(50, W))
    left, right = table(spark, first), table(spark, second)
    t, p, n = np.where(rng.random(900) < 0.4, 3, rng.integers(0, 42, 900)), rng.integers(0, 52, 900), rng.integers(0, 50, 900)
    triples = spark.createDataFrame([(int(a), int(b), int(c), 1.5) for a, b, c in zip(t, p, n)], "t long, p long, n long, weight double")
    samples = spark.createDataFrame([(str(i), int(a % 40), int(b % 50), [int(c), int(a)]) for i, (a, b, c) in enumerate(zip(t, p, n))], "sample_id string, t long, p long, negs array<long>")
    pairs = triples.where("t < 40 and p < 50").select(F.col("t").alias("c"), "p").distinct()
    contexts = left.join(pairs.groupBy(F.col("c").alias("id")).agg(F.count("*").alias("num_true")), "id")
    negatives = gradients.draw_negatives(spark, 50, 30, 4)
    names = ["sample_id", "pos_logit", "neg_logit", "pos_loss", "neg_loss"]

    def everything():
        parts = (
            gradients.bpr_parts(triples, left, right, W), gradients.posneg_parts(samples, left, right, W),
            gradients.nce_parts(pairs, contexts, right, negatives, 50, 30, W),
        )
        return [summed(x) for x in parts], sorted(map(tuple, gradients.posneg_logits(samples, left, right, W).select(*names).collect()))

    want, logits = everything()
    for name, x in (("LEAST_ROWS", 1), ("BLOCK_CELLS", 12 * W), ("SHARE_EDGES", 100)):
        monkeypatch.setattr(gradients.edges, name, x)
    plan = gradients.bpr_parts(triples, left, right, W)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    got, blocked = everything()
    for a, b in zip(want, got):
        assert set(a) == set(b)
        for key in a:
            assert np.allclose(a[key][0], b[key][0]) and np.isclose(a[key][1], b[key][1])
    assert [r[0] for r in logits] == [r[0] for r in blocked]
    assert np.allclose([r[1:] for r in logits], [r[1:] for r in blocked])


def test_rounds_of_edges_add_up(spark, monkeypatch):
    """Edges that are moved in several rounds give what the joins give, and leave only the sums."""
    rng = np.random.default_rng(4)
    left, right = table(spark, rng.normal(size=(40, W))), table(spark, rng.normal(size=(50, W)))
    t, p, n = rng.integers(0, 40, 300), rng.integers(0, 50, 300), rng.integers(0, 50, 300)
    triples = spark.createDataFrame([(int(a), int(b), int(c), 1.5) for a, b, c in zip(t, p, n)], "t long, p long, n long, weight double")
    samples = spark.createDataFrame([(str(i), int(a), int(b), [int(c), int(a)]) for i, (a, b, c) in enumerate(zip(t, p, n))], "sample_id string, t long, p long, negs array<long>")
    names = ["sample_id", "pos_logit", "neg_logit", "pos_loss", "neg_loss"]

    def everything(*tables):
        parts = [summed(gradients.bpr_parts(triples, left, right, W, *tables)), summed(gradients.posneg_parts(samples, left, right, W, *tables))]
        return parts, sorted(map(tuple, gradients.posneg_logits(samples, left, right, W, keep=("sample_id",)).select(*names).collect()))

    want, logits = everything()
    made, plain = [], edges.layout
    for name, x in (("LEAST_ROWS", 1), ("ROUND_EDGES", 200), ("ROUND_DEGREE", 0)):
        monkeypatch.setattr(edges, name, x)
    monkeypatch.setattr(edges, "layout", lambda *a: (made.append(a), plain(*a))[1])
    tables = Versions(spark, "rounds")
    got, found = everything(tables)
    assert len(made) == 3 + 5 + 5 and os.listdir(tables.root) == [f"edge-sums-{3 + 5}"]
    for a, b in zip(want, got):
        assert set(a) == set(b)
        assert all(np.allclose(a[key][0], b[key][0]) and np.isclose(a[key][1], b[key][1]) for key in a)
    assert [r[0] for r in logits] == [r[0] for r in found] and np.allclose([r[1:] for r in logits], [r[1:] for r in found])


def test_shuffle_files_of_stored_triples_are_dropped(spark):
    """What a step has written holds no shuffle files while the next one moves its edges."""
    def kept():
        return {int(k) for k in spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(",") if k}

    spark.range(5).groupBy("id").count().collect()
    most = max(kept(), default=-1)
    rows = model_queries._triples(spark, SF)
    for _ in range(40):  # the driver drops them in a thread of its own
        if not any(k > most for k in kept()):
            break
        time.sleep(0.25)
    assert not any(k > most for k in kept()) and rows.count()
