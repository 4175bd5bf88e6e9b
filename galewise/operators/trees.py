"""Decision trees held as node tables: scoring, listing and counting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galewise.functions import arrow
from galewise.operators.sampling import permuted
from galewise.session import Versions, cut_lineage

# The hand-authored colour tree.
COLOUR_CLASSES = ["red", "blue", "green"]
COLOUR_TREE = [
    {"node_id": 0, "feature": "f1", "threshold": 1.5, "missing_eval": False, "pos": 1, "neg": 2},
    {"node_id": 1, "feature": "f2", "mask": ["cat", "dog"], "missing_eval": False, "pos": 3, "neg": 4},
    {"node_id": 2, "probability": [0.1, 0.1, 0.8], "num_examples": 30, "leaf_idx": 0},
    {"node_id": 3, "probability": [0.8, 0.1, 0.1], "num_examples": 10, "leaf_idx": 2},
    {"node_id": 4, "probability": [0.1, 0.8, 0.1], "num_examples": 20, "leaf_idx": 1},
]


def _condition(node: dict) -> Column:
    """Test of a split node; a missing value takes the answer the node prescribes."""
    value = F.col(node["feature"])
    test = value.isin(node["mask"]) if node.get("mask") else value >= node["threshold"]
    return F.coalesce(test, F.lit(node["missing_eval"]))


def tree_expression(nodes: list[dict], leaf_value, root: int = 0) -> Column:
    """One tree as a nested conditional, so scoring stays in generated code."""
    by_id = {n["node_id"]: n for n in nodes}

    def build(node_id: int) -> Column:
        node = by_id[node_id]
        if "feature" not in node:
            return leaf_value(node)
        return F.when(_condition(node), build(node["pos"])).otherwise(build(node["neg"]))

    return build(root)


NODES = (
    "tree_id long, node_id int, feature string, threshold double, strict boolean, mask array<string>, missing_eval boolean, "
    "pos int, neg int, probability array<double>, leaf_idx int"
)


def node_rows(spark: SparkSession, nodes: list[dict], tree_id: int = 0) -> DataFrame:
    """A tree given as a list in the layout of a node table."""
    columns = [c.split()[0] for c in NODES.split(", ")]
    rows = [tuple({"tree_id": tree_id, "strict": False, **n}.get(c) for c in columns) for n in nodes]
    return spark.createDataFrame(rows, NODES)


@dataclass
class PackedForest:
    """The trees of a node table as arrays behind each other, and the sets of categories as rows of bits.

    A split sends a row to ``pos`` if its value is in the mask, at least the threshold, or above it where the node is ``strict``; a missing value takes the answer the
    node prescribes, and a category that no mask names is in none.
    """

    numeric: list[str]
    categories: dict[str, dict[str, int]]
    roots: np.ndarray
    column: np.ndarray  # of a split; -1 for a leaf
    threshold: np.ndarray
    strict: np.ndarray
    mask: np.ndarray  # row of ``bits``, -1 for a number
    missing: np.ndarray
    pos: np.ndarray
    neg: np.ndarray
    leaf: np.ndarray
    values: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(nodes: DataFrame) -> PackedForest:
        """Pack a node table; its size is the model's."""
        rows = sorted(nodes.select(*[c.split()[0] for c in NODES.split(", ")]).collect(), key=lambda r: (r.tree_id, r.node_id))
        place = {(r.tree_id, r.node_id): i for i, r in enumerate(rows)}
        splits = [r for r in rows if r.feature is not None]
        named = sorted({r.feature for r in splits if r["mask"] is not None})
        numeric = sorted({r.feature for r in splits if r["mask"] is None})
        categories = {f: {v: i for i, v in enumerate(sorted({v for r in splits if r.feature == f for v in r["mask"] or []}))} for f in named}
        columns = {f: i for i, f in enumerate([*numeric, *named])}
        wide = max([len(c) for c in categories.values()], default=0) + 1
        masks, at = [], np.full(len(rows), -1)
        for i, r in enumerate(rows):
            if r.feature is not None and r["mask"] is not None:
                own = np.zeros(wide, dtype=bool)
                own[[categories[r.feature][v] for v in r["mask"]]] = True
                at[i] = len(masks)
                masks.append(np.packbits(own))
        width = max((len(r.probability) for r in rows if r.probability), default=1)
        child = lambda c: np.array([place[r.tree_id, r[c]] if r.feature is not None else 0 for r in rows])
        return PackedForest(
            numeric, categories, np.array([i for i, r in enumerate(rows) if not i or rows[i - 1].tree_id != r.tree_id]),
            np.array([-1 if r.feature is None else columns[r.feature] for r in rows]),
            np.array([r.threshold if r.threshold is not None else 0.0 for r in rows]), np.array([bool(r.strict) for r in rows]), at,
            np.array([bool(r.missing_eval) for r in rows]), child("pos"), child("neg"), np.array([r.leaf_idx if r.leaf_idx is not None else -1 for r in rows]),
            np.array([r.probability or [0.0] * width for r in rows], dtype=float), np.array(masks, dtype=np.uint8).reshape(len(masks), -(-wide // 8)),
        )

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """One column for each feature: numbers, and the places of categories; missing ones are NaN."""
        out = [batch[c].to_numpy(zero_copy_only=False).astype(float) for c in self.numeric]
        for name, codes in self.categories.items():
            out.append(np.array([np.nan if v is None else codes.get(v, len(codes)) for v in batch[name].to_pylist()], dtype=float))
        return np.stack(out, axis=1) if out else np.zeros((batch.num_rows, 0))

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree; all trees go down a level at a time."""
        at = np.repeat(self.roots[None], len(x), axis=0)
        row, tree = np.nonzero(self.column[at] >= 0)
        while len(row):
            node = at[row, tree]
            value = x[row, self.column[node]]
            hit = np.where(self.strict[node], value > self.threshold[node], value >= self.threshold[node])
            named = np.flatnonzero(self.mask[node] >= 0)
            place = np.nan_to_num(value[named]).astype(np.int64)
            hit[named] = (self.bits[self.mask[node[named]], place >> 3] >> (7 - (place & 7))) & 1
            hit = np.where(np.isnan(value), self.missing[node], hit)
            at[row, tree] = np.where(hit, self.pos[node], self.neg[node])
            open_ = self.column[at[row, tree]] >= 0
            row, tree = row[open_], tree[open_]
        return at


ROUTE_CELLS = 1 << 20  # rows times trees on their way at a time


def forest_score(rows: DataFrame, nodes: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``(row_id, leaves, probability)``: the leaf number in every tree, and the mean of the leaves' probabilities."""
    forest = PackedForest.of(nodes)
    kind = rows.schema[row_id].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        step = max(1, ROUTE_CELLS // len(forest.roots))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                at = forest.route(forest.matrix(b))
                probability = np.zeros((len(at), forest.values.shape[1]))
                for t in range(at.shape[1]):
                    probability += forest.values[at[:, t]]
                leaves = pa.array(forest.leaf[at].astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b[row_id], leaves, arrow.list_column(probability / at.shape[1])], [row_id, "leaves", "probability"])

    columns = [F.col(c).cast("double").alias(c) for c in forest.numeric] + [F.col(c).cast("string").alias(c) for c in forest.categories]
    return rows.select(row_id, *columns).mapInArrow(run, f"`{row_id}` {kind}, leaves array<int>, probability array<double>")


def tree_score(rows: DataFrame, nodes: list[dict] | DataFrame | None = None, classes: list[str] | None = None) -> DataFrame:
    """Class probabilities and leaf of every row by one tree, given as a list or as a node table."""
    nodes, classes = COLOUR_TREE if nodes is None else nodes, classes or COLOUR_CLASSES
    if isinstance(nodes, DataFrame):
        scored = forest_score(rows, nodes).select("row_id", F.get("leaves", F.lit(0)).alias("leaf_idx"), F.col("probability").alias("p"))
    else:
        leaf = tree_expression(nodes, lambda n: F.lit(n["leaf_idx"]))
        probability = tree_expression(nodes, lambda n: F.array(*[F.lit(p) for p in n["probability"]]))
        scored = rows.select("row_id", leaf.alias("leaf_idx"), probability.alias("p"))
    return scored.select(
        "row_id", "leaf_idx", *[F.get("p", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(classes)]
    )


def permutation_importance(rows: DataFrame, nodes: DataFrame, features: list[str], label: str, row_id: str = "row_id", seed: int = 1) -> DataFrame:
    """``(feature, accuracy, drop)``: how much accuracy a forest loses when a feature's values are dealt anew.

    ``label`` is the number of a row's class; the first of equally probable classes wins.
    """

    def hits(table: DataFrame, name: str) -> DataFrame:
        won = F.array_position("probability", F.array_max("probability")) - 1
        scored = forest_score(table, nodes, row_id).join(rows.select(row_id, F.col(label).alias("__label")), row_id)
        return scored.agg(F.lit(name).alias("feature"), F.avg((won == F.col("__label")).cast("double")).alias("accuracy"))

    plain = hits(rows, "").select(F.col("accuracy").alias("__plain"))
    found = [hits(rows.drop(f).join(permuted(rows, row_id, f, seed), row_id), f) for f in features]
    return reduce(DataFrame.unionByName, found).join(F.broadcast(plain)).select("feature", "accuracy", (F.col("__plain") - F.col("accuracy")).alias("drop"))


TREE_NODES = 4096  # a tree of more nodes is listed by joins
LISTED_NODES = 1 << 16  # nodes of whole trees that a task lists at a time
BOUNDS, BOUND_CHARS = 256, 1 << 24  # about as many paths, of so many characters in all, bound the ranges of the nodes of large trees


def tree_inorder(nodes: DataFrame) -> DataFrame:
    """Nodes of every tree of a table with a path that sorts them in order.

    The path is a 0 for each negative and a 2 for each positive branch from the root,
    then a 1 for the node itself. Paths double in length each round until all have reached
    their root, so the number of rounds is the logarithm of the depth, whatever it is.

    The table is moved once, by ranges of trees, and each task lists many whole trees at a time. Only trees of more than
    ``TREE_NODES`` nodes, which a task might not hold, are joined with themselves.
    """
    label = F.when(F.col("kind") == "split", F.col("feature")).otherwise(F.col("leaf_idx").cast("string"))
    child = lambda c: F.when(F.col("kind") == "split", F.col(c)).cast("long").alias(c)
    ready = nodes.where("tree_id is not null and node_id is not null").select("tree_id", F.col("node_id").cast("long").alias("node_id"), child("neg"), child("pos"), label.alias("node"))
    # a row for TREE_NODES nodes at most
    large = cut_lineage(ready.groupBy("tree_id").count().where(F.col("count") > TREE_NODES).select("tree_id"), "large-trees")
    if large.isEmpty():
        return _listed_whole(ready)
    both = _listed_whole(ready.join(large, "tree_id", "left_anti")).withColumn("place", F.lit(0)).unionByName(_listed_by_joins(ready.join(large, "tree_id", "left_semi")))
    # not orderBy: it samples tens of thousands of rows on the driver, and a path is as long as its tree is deep
    return both.repartitionByRange("tree_id", "place").sortWithinPartitions("tree_id", "path").drop("place")


def _listed_whole(nodes: DataFrame) -> DataFrame:
    """The listing of trees of bounded size, in order."""
    kind = nodes.schema["tree_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < LISTED_NODES:
                continue
            whole = arrow.joined(held)
            ends = np.flatnonzero(_starts(whole))
            if len(ends) > 1:
                yield from _listing(whole.slice(0, ends[-1]))
                held, rows = [whole.slice(ends[-1])], whole.num_rows - ends[-1]
        if rows:
            yield from _listing(arrow.joined(held))

    # ranges of trees, so that the order inside the tasks is the order of the table
    dealt = nodes.repartitionByRange("tree_id").sortWithinPartitions("tree_id")
    return dealt.mapInArrow(run, f"tree_id {kind}, path string, node string").sortWithinPartitions("tree_id", "path")


def _starts(part: pa.RecordBatch) -> np.ndarray:
    tree = part["tree_id"].to_numpy(zero_copy_only=False)
    return np.concatenate(([True], tree[1:] != tree[:-1]))


def _met(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of equal numbers, as a left join gives them: -1 for the right one where there is none."""
    order = np.argsort(right, kind="stable")
    first, last = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    many = np.maximum(last - first, 1)
    at = np.repeat(np.arange(len(left)), many)
    place = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return at, np.where((last > first)[at], np.append(order, -1)[np.minimum(place, len(order))], -1)


def _listing(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The paths of some whole trees' nodes, by the steps of :func:`_listed_by_joins`."""
    start = _starts(part)
    tree, longest = np.cumsum(start) - 1, int(np.diff(np.flatnonzero(np.append(start, True))).max())
    numbers = [part[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("node_id", "neg", "pos")]
    known, codes = np.unique(np.concatenate(numbers), return_inverse=True)
    own, neg, pos = tree * len(known) + codes.reshape(3, -1)
    has = [part[c].is_valid().to_numpy(zero_copy_only=False) for c in ("neg", "pos")]
    parent, child = np.concatenate((own[has[0]], own[has[1]])), np.concatenate((neg[has[0]], pos[has[1]]))
    at, edge = _met(own, child)
    node, above = own[at], np.where(edge < 0, -1, np.append(parent, -1)[edge])
    path = pa.array(["", "0", "2"]).take(pa.array(np.where(edge < 0, 0, np.where(edge < has[0].sum(), 1, 2))))
    rounds = 0
    while (above >= 0).any():
        if rounds > longest.bit_length():
            raise ValueError("the nodes form a cycle")
        rounds += 1
        at, upper = _met(above, node)
        path = pc.binary_join_element_wise(path.take(pa.array(upper, mask=upper < 0)).fill_null(""), path.take(pa.array(at)), "")
        node, above = node[at], np.where(upper < 0, -1, above[upper])
    at, found = _met(own, node)
    for lo in range(0, len(at), 8192):
        rows, paths = pa.array(at[lo : lo + 8192]), path.take(pa.array(found[lo : lo + 8192]))
        yield arrow.batch(tree_id=part["tree_id"].take(rows), path=pc.binary_join_element_wise(paths, "1", ""), node=part["node"].take(rows))


def _listed_by_joins(nodes: DataFrame) -> DataFrame:
    """The listing of trees of any size, with the place of each path among a few of its tree's, by which the order is dealt.

    Paths shrink a lot in a file, so its size says nothing of a broadcast's.
    """
    edge = F.explode(
        F.array(
            F.struct(F.col("neg").alias("node_id"), F.lit("0").alias("step")),
            F.struct(F.col("pos").alias("node_id"), F.lit("2").alias("step")),
        )
    ).alias("e")
    edges = nodes.select("tree_id", F.col("node_id").alias("parent"), edge).select(
        "tree_id", F.col("e.node_id").alias("node_id"), "parent", "e.step"
    )
    reach = nodes.select("tree_id", "node_id").join(edges.hint("merge"), ["tree_id", "node_id"], "left").select(
        "tree_id", "node_id", F.col("parent").alias("above"), F.coalesce("step", F.lit("")).alias("path")
    )
    tables = Versions(nodes.sparkSession, "tree")
    reach, rounds = tables.store(reach, "paths"), 0
    while not reach.where("above is not null").isEmpty():
        if rounds == 62:
            raise ValueError("the nodes form a cycle")
        rounds += 1
        upper = reach.select(
            "tree_id", F.col("node_id").alias("above"), F.col("above").alias("__above"),
            F.col("path").alias("__path"),
        )
        longer = reach.join(upper.hint("merge"), ["tree_id", "above"], "left").select(
            "tree_id", "node_id", F.col("__above").alias("above"),
            F.concat(F.coalesce("__path", F.lit("")), "path").alias("path"),
        )
        reach = tables.store(longer, "paths")
    rows, chars = reach.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("path")), F.lit(0))).first()
    share = min(BOUNDS / max(rows, 1), BOUND_CHARS / max(chars, 1))
    some = reach.where(F.pmod(F.xxhash64("tree_id", "node_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    bounds = some.groupBy("tree_id").agg(F.collect_list("path").alias("bounds"))
    listed = nodes.select("tree_id", "node_id", "node").join(reach.hint("merge"), ["tree_id", "node_id"]).select(
        "tree_id", F.concat("path", F.lit("1")).alias("path"), "node"
    )
    below = F.size(F.filter("bounds", lambda b: b <= F.col("path")))
    return listed.join(F.broadcast(bounds), "tree_id", "left").select("tree_id", "path", "node", F.when(F.col("bounds").isNull(), 0).otherwise(below).alias("place"))


def feature_use(nodes: DataFrame) -> DataFrame:
    """Number of split nodes that test each feature."""
    return nodes.where("kind = 'split'").groupBy("feature").agg(F.count(F.lit(1)).alias("uses"))
