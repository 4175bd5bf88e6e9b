"""Worked examples with known answers."""

import random
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from galewise.functions import timefns as tf
from galewise.functions import vectors as v
from galewise.operators import forecast, trees
from galewise.sources import tables as t
from galewise.sources.files import with_name_parts


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_file_name(spark):
    df = spark.createDataFrame([("ecfine.I2022093000.048.F2022100200.nc",)], "file_name string")
    row = with_name_parts(df, "file_name").first()
    assert (row.init, row.gap, row.F_time) == ("I2022093000", "048", "F2022100200")


def test_station_hour_to_utc(spark):
    assert one(spark, tf.station_to_forecast_time(F.lit("21093021")))[0] == "F2021093013"


def test_station_hour_crosses_the_year(spark):
    assert one(spark, tf.station_to_forecast_time(F.lit("22010103")))[0] == "F2021123119"


def test_shift(spark):
    assert one(spark, tf.shift_forecast_time(F.lit("F2021090106"), F.lit("006").cast("int")))[0] == "F2021090100"


def test_epoch_and_zone(spark):
    utc = tf.parse_forecast_time(F.lit("F2021093013"))
    row = one(spark, tf.epoch_seconds(utc), tf.render_in_zone(utc, "Asia/Shanghai"))
    assert tuple(row) == (1633006800, "202109302100")


def test_times_do_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        utc = tf.parse_forecast_time(F.lit("F2021093013"))
        row = one(
            spark, tf.epoch_seconds(utc), tf.render_in_zone(utc, "Asia/Shanghai"),
            tf.station_to_forecast_time(F.lit("21093021")), tf.shift_forecast_time(F.lit("F2021093013"), F.lit(72)),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert tuple(row) == (1633006800, "202109302100", "F2021093013", "F2021092713")


def test_sum_of_dots(spark):
    total = v.sum_of_dots(F.array(F.lit(1.0), F.lit(2.0)), F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((1.0, 0.0), (2.0, 3.0))]))
    assert one(spark, total)[0] == 9.0


def test_grid_box():
    assert forecast.lon_cells() == range(495, 498)
    assert forecast.lat_cells() == range(243, 247)


def test_lead_labels(spark):
    labels = one(spark, tf.lead_labels())[0]
    assert labels[0] == "003" and labels[-1] == "072" and len(labels) == 24


def test_endpoint_means(spark):
    matrix = np.arange(1, 13).reshape(3, 4).astype(float)
    df = spark.createDataFrame([(r.tolist(),) for r in matrix], "e array<double>")
    assert sorted(r[0] for r in df.select(v.endpoint_mean(F.col("e"))).collect()) == [2.5, 6.5, 10.5]


def test_features_are_row_major_and_complete(spark):
    cells = [
        ("ecfine.I2022093000.048.F2022100200.nc", c, la, lo, 1000.0 * i + 10 * (la - 243) + lo - 495)
        for i, c in enumerate(forecast.CHANNELS)
        for la in range(242, 249)
        for lo in range(494, 500)
    ]
    grid = spark.createDataFrame(cells, "file_name string, variable string, lat_idx int, lon_idx int, value double")
    row = forecast.forecast_features(grid).first()
    want = [1000.0 * i + 10 * a + o for i in range(6) for a in range(4) for o in range(3)]
    assert row.input == want
    assert row.input[forecast.NEAREST_CELL] == 11.0
    compat = forecast.forecast_features(grid, compat_10m=True).first().input
    assert compat[48:72] == want[24:48]


def test_copies_of_cells_change_nothing(spark):
    cells = [("ecfine.I2022093000.048.F2022100200.nc", "t2", 244, 496, 3.0)] * 50
    grid = spark.createDataFrame(cells, "file_name string, variable string, lat_idx int, lon_idx int, value double")
    values = forecast.forecast_features(grid).first().input
    assert [x for x in values if x is not None] == [3.0] and len(values) == 72


def test_tree_in_order(spark):
    rows = [
        (1, n["node_id"], "split" if "feature" in n else "leaf", n.get("feature"), n.get("pos"), n.get("neg"), n.get("leaf_idx"))
        for n in trees.COLOUR_TREE
    ]
    nodes = spark.createDataFrame(
        rows, "tree_id long, node_id int, kind string, feature string, pos int, neg int, leaf_idx int"
    )
    assert [r.node for r in trees.tree_inorder(nodes).collect()] == ["0", "f1", "1", "f2", "2"]


def test_deep_tree_in_order(spark):
    depth = 9
    rows = [(1, 2 * i, "split", f"s{i}", 2 * i + 2, 2 * i + 1, None) for i in range(depth)]
    rows += [(1, 2 * i + 1, "leaf", None, None, None, i) for i in range(depth)]
    rows += [(1, 2 * depth, "leaf", None, None, None, depth)]
    nodes = spark.createDataFrame(
        rows, "tree_id long, node_id int, kind string, feature string, pos int, neg int, leaf_idx int"
    )
    want = [x for i in range(depth) for x in (str(i), f"s{i}")] + [str(depth)]
    assert [r.node for r in trees.tree_inorder(nodes).collect()] == want


def test_tree_score_routes_missing_values(spark):
    rows = spark.createDataFrame(
        [(1, 2.0, "cat"), (2, 1.5, "bird"), (3, 1.4, "cat"), (4, None, "cat"), (5, 3.0, None)],
        "row_id long, f1 double, f2 string",
    )
    got = {r.row_id: (r.leaf_idx, r.p_red, r.p_blue, r.p_green) for r in trees.tree_score(rows).collect()}
    assert got == {
        1: (2, 0.8, 0.1, 0.1), 2: (1, 0.1, 0.8, 0.1), 3: (0, 0.1, 0.1, 0.8),
        4: (0, 0.1, 0.1, 0.8), 5: (1, 0.1, 0.8, 0.1),
    }


def test_labels_use_the_highest_station_present(spark):
    obs = spark.createDataFrame(
        [("K2962", "21093021", 0, 0, 120), ("K2931", "21093021", 0, 0, 80), ("K2942", "21093022", 0, 0, 70),
         ("K2931", "21093022", 0, 0, 60), ("K9999", "21093022", 0, 0, 900), ("K2962", "21093021", 0, 0, 90)],
        "StationNum string, ObservTimes string, WindDirect10 int, WindVelocity10 int, ExMaxWindV int",
    )

    def read(labels):
        rows = labels.withColumn("last", forecast.last_reading(F.col("label"))).collect()
        return {r.F_time: ([x.StationNum for x in r.label], round(r.last, 6)) for r in rows}

    first = (["K2931", "K2962", "K2962"], 12.0)
    assert read(forecast.station_labels(obs)) == {"F2021093013": first, "F2021093014": (["K2931", "K2942", "K9999"], 90.0)}
    some = forecast.station_labels(obs, forecast.STATIONS)
    assert read(some) == {"F2021093013": first, "F2021093014": (["K2931", "K2942"], 7.0)}


@pytest.fixture
def odd_forest(spark):
    """Trees of all depths and shapes, with a node that has two parents, a child that is missing and a node without a parent."""
    rng, rows = random.Random(5), []
    for tree in range(60):
        leaves, n = [0], 1
        for _ in range(rng.choice([0, 1, 2, 5, 40])):
            node = leaves.pop(rng.choice([0, -1]))
            rows.append((tree, node, "split", f"s{node}", n, n + 1, None))
            leaves += [n, n + 1]
            n += 2
        rows += [(tree, x, "leaf", None, None, None, x) for x in leaves]
    rows += [(100, 0, "split", "a", 1, 2, None), (100, 1, "split", "b", 3, 9, None), (100, 2, "split", "c", 3, 4, None)]
    rows += [(100, 3, "leaf", None, None, None, 0), (100, 4, "leaf", None, 3, 3, 1), (100, 7, "leaf", None, None, None, 2), (None, 1, "leaf", None, None, None, 3)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "tree_id long, node_id int, kind string, feature string, pos int, neg int, leaf_idx int")


def _walked(rows):
    nodes = {(r[0], r[1]): r for r in rows if r[0] is not None}
    children = {(r[0], c) for r in nodes.values() if r[2] == "split" for c in r[4:6]}
    out, todo = [], [(k, "") for k in nodes if k not in children]
    while todo:
        (tree, node), path = todo.pop()
        r = nodes[tree, node]
        out.append((tree, path + "1", r[3] if r[2] == "split" else str(r[6])))
        if r[2] == "split":
            todo += [((tree, c), path + step) for c, step in ((r[5], "0"), (r[4], "2")) if (tree, c) in nodes]
    return sorted(out)


@pytest.mark.parametrize("most", [4096, 9, 0])
def test_odd_trees_in_order(odd_forest, monkeypatch, most):
    rows, nodes = odd_forest
    monkeypatch.setattr(trees, "TREE_NODES", most, raising=False)
    monkeypatch.setattr(trees, "LISTED_NODES", 50, raising=False)
    got = [tuple(r) for r in trees.tree_inorder(nodes.repartition(3)).collect()]
    assert sorted(got) == _walked(rows)
    assert [r[:2] for r in got] == sorted(r[:2] for r in got)


def test_nodes_in_a_cycle_are_refused(spark):
    rows = [(1, 0, "split", "a", 1, 2, None), (1, 1, "split", "b", 0, 3, None)]
    nodes = spark.createDataFrame(rows, "tree_id long, node_id int, kind string, feature string, pos int, neg int, leaf_idx int")
    with pytest.raises(Exception, match="the nodes form a cycle"):
        trees.tree_inorder(nodes).collect()


def test_small_trees_are_moved_once_and_not_joined(spark):
    listing = trees.tree_inorder(t.order_chains(spark, SF))
    text = listing._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Join" not in text and text.count("Exchange") == 2  # the orders of a customer, the nodes by tree


def test_a_forest_of_small_trees_is_not_sent_to_the_driver(spark):
    """The paths are so alike that a file of them is tiny, and Spark broadcast it whatever its rows."""
    listing = trees.tree_inorder(t.tree_nodes(spark, SF))
    listing.collect()
    text = listing._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Broadcast" not in text and "rangepartitioning(tree_id" in text


def test_paths_of_large_trees_are_not_sampled(spark, odd_forest, monkeypatch):
    """The driver sampled whole paths for the ranges of the order, and a path is as long as its tree is deep."""
    monkeypatch.setattr(trees, "TREE_NODES", 9)
    rows, nodes = odd_forest
    listing = trees.tree_inorder(nodes)
    assert [tuple(r)[:2] for r in listing.collect()] == [r[:2] for r in _walked(rows)]
    ranges = re.findall(r"rangepartitioning\(.*", listing._jdf.queryExecution().executedPlan().toString())
    assert ranges and not any(re.search(r"\bpath#\d+ ASC", r) for r in ranges)


@pytest.mark.parametrize("sides", ["2", "20", "0220002"])
def test_a_large_tree_is_sorted_by_many_tasks(spark, sides):
    """Of any shape; of stems, whole or changing sides, all paths begin alike."""
    depth, rows = 600, []
    for i in range(depth):
        on, off = 2 * i + 2, 2 * i + 1
        pos, neg = (on, off) if sides[i % len(sides)] == "2" else (off, on)
        rows += [(1, 2 * i, "split", f"s{i}", pos, neg, None), (1, off, "leaf", None, None, None, i)]
    rows.append((1, 2 * depth, "leaf", None, None, None, depth))
    nodes = spark.createDataFrame(rows, "tree_id long, node_id long, kind string, feature string, pos long, neg long, leaf_idx int")
    placed = trees._listed_by_joins(nodes.selectExpr("tree_id", "node_id", "neg", "pos", "coalesce(feature, cast(leaf_idx as string)) as node")).collect()
    assert sorted((r.tree_id, r.path, r.node) for r in placed) == _walked(rows)
    places = [r.place for r in sorted(placed, key=lambda r: r.path)]
    assert places == sorted(places)
    assert len(set(places)) > 128 and max(map(places.count, set(places))) < len(places) / 16
