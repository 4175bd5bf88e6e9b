"""Histogram trees: split choice, sibling subtraction and losses against brute force; boosted models learn."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from galewise.operators import metrics, ranking, sampling
from galewise.plans import boosting, hist_trees as ht, queries
from galewise.sources import files
from galewise.sources import tables as t


def brute_split(x, category, g, h, l2, least):
    """The best gain over all thresholds, and over all sets of categories."""
    rate = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    best = 0.0
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if category[f]:
            sides = [np.isin(x[:, f], [v for i, v in enumerate(values) if bits >> i & 1]) for bits in range(1, 2 ** len(values) - 1)]
        else:
            sides = [x[:, f] > v for v in values[:-1]]
        for m in sides:
            if min(m.sum(), (~m).sum()) >= least:
                best = max(best, rate(m) + rate(~m) - rate(np.ones(len(g), bool)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_best_split_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 7, (80, 4)).astype(np.uint8)
    category = np.array([False, True, False, True])
    g, h = rng.normal(size=80), rng.uniform(0.5, 1, 80)
    sums = np.zeros((4, ht.BINS, 3))
    for f in range(4):
        for s, w in enumerate((g, h, np.ones(80))):
            sums[f, :, s] = np.bincount(x[:, f], weights=w, minlength=ht.BINS)
    score, rank, _ = ht.newton(0.0)
    gain, f, mask = ht.best_split(sums, category, score, rank, 3)
    side = mask[x[:, f]]
    rate = lambda m: g[m].sum() ** 2 / h[m].sum()
    assert gain == pytest.approx(rate(side) + rate(~side) - rate(np.ones(80, bool)))
    assert min(side.sum(), (~side).sum()) >= 3
    assert gain <= brute_split(x, category, g, h, 0.0, 3) + 1e-9
    if f in (0, 2) or True:  # sorted categories are optimal but for the least number of rows of a side
        assert gain >= brute_split(x, category, g, h, 0.0, 3) - 1e-9 or category[f]


@pytest.fixture(scope="module")
def shapes(spark):
    """Three classes that depend on a number, a category and a missing value."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        a, b, c = rng.normal(), str(rng.choice(list("pqrs"))), None if rng.random() < 0.2 else float(rng.normal())
        y = 2 if c is None else int(a > 0) if b in "pq" else int(a < 0.5)
        rows.append((i, a, b, c, y if rng.random() > 0.02 else 0, i % 4 == 0))
    return spark.createDataFrame(rows, "row_id long, a double, b string, c double, y int, held boolean")


def test_level_sums_and_subtraction_equal_direct_counts(spark, shapes):
    bins = ht.learn_bins(shapes, ["a", "c"], ["b"])
    rows = ht.binned(shapes.repartition(5), bins, "row_id", "y").cache()
    stats = lambda b, x: ([np.stack(((b["y"].to_numpy() == 1) - 0.3, np.full(b.num_rows, 0.2), np.ones(b.num_rows)), axis=1)], {})
    tree, (score, rank, _) = ht.Tree(), ht.newton()
    _, counted = ht.grow(rows, [tree], bins, 3, stats, score, rank, 3, 5)
    local = rows.collect()
    x = np.array([list(r.bins) for r in local], dtype=np.uint8)
    y = np.array([r.y for r in local])
    at, leaves = tree.route(x), [n for n, f in enumerate(tree.feature) if f < 0]
    assert set(at) <= set(leaves)
    for n in leaves:
        own = at == n
        assert np.allclose(tree.stats[n], [((y[own] == 1) - 0.3).sum(), 0.2 * own.sum(), own.sum()])
    # of the nodes of a level half are counted
    assert counted[0] == 1 and counted[1] == 1 and counted[2] <= 2
    assert (x[:, 1] == 0).sum() == shapes.where("c is null").count()


def test_softmax_boosting(spark, shapes):
    model = boosting.train_softmax(shapes, "y", 3, ["a", "c"], ["b"], "held", rounds=14, rate=0.3)
    assert model.loss[0] == pytest.approx(np.log(3)) and all(b < a for a, b in zip(model.loss, model.loss[1:]))
    assert model.valid_accuracy[-1] > 0.93
    scored = model.score(shapes).collect()
    f, y, held = (np.array([r[c] for r in scored]) for c in ("score", "y", "held"))
    p = boosting.softmax(f)[np.arange(len(y)), y]
    best = len(model.rounds)
    assert -np.log(p[held]).mean() == pytest.approx(model.valid_loss[best]) and -np.log(p[~held]).mean() == pytest.approx(model.loss[best])
    again = boosting.train_softmax(shapes.repartition(9), "y", 3, ["a", "c"], ["b"], "held", rounds=3, rate=0.3)
    assert np.allclose(again.loss, model.loss[:4])


def test_boosting_stops_when_the_held_out_loss_rises(spark, shapes):
    noise = shapes.withColumn("y", (F.xxhash64("row_id") % 3 + 3).cast("int") % 3)
    model = boosting.train_softmax(noise, "y", 3, ["a", "c"], ["b"], "held", rounds=40, rate=0.5, patience=4)
    assert len(model.valid_loss) < 30 and len(model.rounds) == int(np.argmin(model.valid_loss))


def test_many_categories_share_a_bin(spark):
    rows = spark.range(1000).select(F.concat(F.lit("c"), F.col("id") % 200).alias("c"), F.lit(None).cast("double").alias("x"))
    bins = ht.learn_bins(rows, ["x"], ["c"])
    made = {r.bins for r in ht.binned(rows, bins, "c").collect()}
    assert len({b[1] for b in made}) == ht.BINS - 1 and {b[0] for b in made} == {0}


def test_ranking_raises_ndcg(spark):
    rows = files.parse_ranking_lines(t.ranking_lines(spark, SF), queries.FEATURES)
    rows = rows.withColumn("row_id", F.xxhash64(*rows.columns)).withColumn("f_1", F.col("f_1") + 40 * F.col("relevance"))
    train, held = sampling.train_test_split(rows, "group", 0.3)
    model = boosting.train_ranking(train, ["f_1", "f_2", "f_3"], rounds=4, rate=0.3, validation=held)
    before = metrics.ndcg(rows.withColumn("score", F.lit(0.0))).agg(F.avg("ndcg")).first()[0]
    assert model.accuracy[-1] > before + 0.05 and model.valid_accuracy[-1] > before
    for part, logged in ((train, model.accuracy), (held, model.valid_accuracy)):
        assert metrics.ndcg(model.score(part)).agg(F.avg("ndcg")).first()[0] == pytest.approx(logged[-1])


def grouped(spark):
    """Groups of many sizes with equal scores, missing relevances and groups, a group without gain, and one in both sets."""
    rng = np.random.default_rng(8)
    rows = [(f"r{i}", f"g{int(rng.integers(0, 30) ** 2 // 30)}", int(rng.integers(0, 4)), bool(i % 7 == 0), float(rng.integers(-3, 4)), float(rng.normal())) for i in range(600)]
    rows += [(f"z{i}", "none", 0, False, 1.0, 0.0) for i in range(7)] + [(f"n{i}", None, i % 3, False, 0.0, float(i)) for i in range(9)]
    rows = [(i, g, None if n % 13 == 0 else rel, *rest) for n, (i, g, rel, *rest) in enumerate(rows)]
    return spark.createDataFrame(rows, "id string, grp string, rel int, held boolean, f_1 double, f_2 double").repartition(5)


def one_tree(values):
    """A model whose only tree gives ``values`` to the bins of its only feature."""
    tree = ht.Tree()
    at = 0
    for i in range(len(values) - 1):
        mask = np.arange(ht.BINS) > i
        neg, pos = tree.split(at, 0, mask)
        tree.value[neg], at = values[i], pos
    tree.value[at] = values[-1]
    return boosting.Boosted(ht.Binning(["f_1"], []), 1.0, 1, np.zeros(1), [[tree]])


def test_blocks_of_groups_equal_the_joins(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 50)
    values = [0.3, -1.0, 0.3, 2.0, -0.5, 1.5, -1.0]
    made = grouped(spark).withColumn("bin", (F.col("f_1") + 3).cast("int"))
    made = made.withColumn("bins", F.unhex(F.lpad(F.hex("bin"), 2, "0"))).withColumn("score", F.get(F.array(*map(F.lit, values)), "bin")).cache()
    whole, others = ranking.by_size(made.select("id", "grp", "rel", "held", "bins"))
    assert whole.count() == 607 and others.count() == 9
    blocks = boosting._advanced(ranking.blocks_of_groups(whole), one_tree(values), 5).collect()
    assert len(blocks) > 8 and sum(map(sum, (b.sizes for b in blocks))) == 607
    for held in (False, True):
        part = made.where(F.col("held") == held).where("grp is not null")
        # a group is known again by its rows, which lie in the order of their ids
        want, known = {}, lambda rows: tuple((-1 if r is None or np.isnan(r) else r, s) for r, s in rows)
        pulls = ranking.lambda_gradients(part, 5, "grp", "rel", "score", "id").withColumnRenamed("id", "of")
        rows = part.join(pulls, F.col("id") == F.col("of")).orderBy("grp", "id").collect()
        for g in {r.grp for r in rows}:
            own = [r for r in rows if r.grp == g]
            want[known((r.rel, r.score) for r in own)] = [(r["lambda"], r.weight) for r in own]
        seen = 0
        for b in (b for b in blocks if b.held == held):
            assert b.score == [values[i] for i in b.bins]
            for lo, n in zip(np.cumsum([0, *b.sizes]), b.sizes):
                own = slice(lo, lo + n)
                found = want[known(zip(b.rel[own], b.score[own]))]
                assert list(zip(b["lambda"][own], b.weight[own])) == [pytest.approx(w, abs=1e-12) for w in found]
                seen += n
        assert seen == len(rows)
        got = np.concatenate([ranking.Groups(np.array(b.sizes), np.array(b.rel, float)).ndcg(np.array(b.score), 5) for b in blocks if b.held == held])
        means = [r.ndcg for r in metrics.ndcg(part, "grp", "rel", "score", "id").collect()]
        assert sorted(got) == [pytest.approx(m) for m in sorted(means)]


def train_grouped(spark, rounds):
    rows = grouped(spark)
    parts = rows.where("not held"), rows.where("held")
    return boosting.train_ranking(parts[0], ["f_1", "f_2"], rounds=rounds, depth=3, rate=0.3, group="grp", relevance="rel", row_id="id", validation=parts[1])


def test_large_groups_are_ranked_by_joins(spark, monkeypatch):
    plain = train_grouped(spark, 3)
    monkeypatch.setattr(ranking, "GROUP_ROWS", 20)
    rest = ranking.by_size(grouped(spark))[1]
    assert 60 < rest.count() < 616
    model = train_grouped(spark, 3)
    assert model.accuracy == pytest.approx(plain.accuracy) and model.valid_accuracy == pytest.approx(plain.valid_accuracy)
    assert [t.feature for (t,) in model.rounds] == [t.feature for (t,) in plain.rounds]


def test_a_round_of_ranking_is_a_map_and_its_levels(spark):
    rows = grouped(spark).where("grp is not null")

    def jobs(rounds):
        name = f"rank-{rounds}"
        spark.sparkContext.setJobGroup(name, name)
        boosting.train_ranking(rows, ["f_1", "f_2"], rounds=rounds, depth=3, group="grp", relevance="rel", row_id="id")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    # the map that writes the gradients, and a map and a sum for each of three levels
    assert 0 < jobs(3) - jobs(1) <= 2 * 7
