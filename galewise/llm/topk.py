"""Exact inner-product search over norm-sorted blocks with rotated partial sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galewise.llm.common import stored

ITEM_ROWS, QUERY_ROWS = 4096, 1024  # rows of a block
HEAD = 16  # rotated elements that are summed before the bound is looked at
SLACK = 1e-6  # share of the norms' product by which rounding may change a bound
LOWEST = np.iinfo(np.int64).min


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, norm): each vector's elements as whole numbers floor(scale * x), as int64 bytes, and its length."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            usable = [i for i, x in enumerate(lists.to_pylist()) if x is not None and ids[i].is_valid and all(e is not None and np.isfinite(e) for e in x)]
            rows = [np.floor(scale * np.array(lists[i].as_py(), dtype=np.float64)) for i in usable]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(usable, pa.int64())).cast(pa.int64()), pa.array([r.astype(np.int64).tobytes() for r in rows], pa.binary()),
                 pa.array([float(np.sqrt((r * r).sum())) for r in rows], pa.float64()), pa.array([len(r) for r in rows], pa.int32())],
                names=["vec_id", "v", "norm", "width"],
            )

    return table.select(F.col(id_col), F.col(vector_col)).mapInArrow(run, "vec_id long, v binary, norm double, width int")


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, x in enumerate(column.to_pylist()):
        own = np.frombuffer(x, np.int64)
        out[i, : len(own)] = own
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, the largest first, from the sum of their outer products."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(np.float64)
            total += m.T @ m
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["at", "x"])

    sums = vectors.select("v").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    gram = np.zeros(width * width)
    for row in sums.collect():  # width * width numbers at most
        gram[row["at"]] = row["x"]
    return np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1]


def _blocks(rows: DataFrame, size: int, width: int, turn: np.ndarray) -> DataFrame:
    """Rows (vec_id, v, norm, least) packed into blocks with their rotated heads and what the heads leave out."""
    head = min(HEAD, width)

    def pack(table: pa.Table, place: int) -> pa.RecordBatch:
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        whole = _matrix(table.column("v"), width)
        first = whole.astype(np.float64) @ turn[:, :head]
        norm, least = table.column("norm").to_numpy(), table.column("least").to_numpy()
        rest = np.sqrt(np.maximum(norm**2 - (first**2).sum(axis=1), 0))
        data = [table.column("vec_id").to_numpy(), whole, first, rest, norm, least]
        return pa.RecordBatch.from_arrays(
            [pa.array([place]), pa.array([float(norm.max())]), pa.array([int(least.min())]), *(pa.array([x.tobytes()], pa.binary()) for x in data)],
            names=["block", "top", "low", "ids", "whole", "head", "rest", "norm", "least"],
        )

    def run(batches):
        from pyspark import TaskContext

        part, count, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows >= size:
                yield pack(held.slice(0, size), (part << 32) + count)
                held, count = held.slice(size), count + 1
        if held is not None and held.num_rows:
            yield pack(held, (part << 32) + count)

    schema = "block long, top double, low long, ids binary, whole binary, head binary, rest binary, norm binary, least binary"
    return rows.select("vec_id", "v", "norm", "least").mapInArrow(run, schema)


def _best(pairs: DataFrame, queries: DataFrame, items: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each pair of blocks (q, i) each query's best ``k`` rows that reach its bound."""
    head = min(HEAD, width)
    names = ["ids", "whole", "head", "rest", "norm", "least"]
    rows = pairs.join(items.select(F.col("block").alias("i"), *(F.col(c).alias(f"i_{c}") for c in names[:-1])), "i")
    rows = rows.join(queries.select(F.col("block").alias("q"), *(F.col(c).alias(f"q_{c}") for c in names)), "q").drop("q", "i")

    def one(row: dict) -> pa.RecordBatch | None:
        get = lambda c, kind=np.float64: np.frombuffer(row[c], kind)
        qid, iid, least = get("q_ids", np.int64), get("i_ids", np.int64), get("q_least", np.int64)
        bound = get("q_head").reshape(-1, head) @ get("i_head").reshape(-1, head).T
        bound += np.outer(get("q_rest"), get("i_rest")) + SLACK * np.outer(get("q_norm"), get("i_norm"))
        reach = bound >= least[:, None]
        at = np.flatnonzero(reach.any(axis=0))
        if not len(at):
            return None
        q, items = get("q_whole", np.int64).reshape(-1, width), get("i_whole", np.int64).reshape(-1, width)[at]
        if float(np.abs(q).max()) * float(np.abs(items).max()) * width < 2**53:
            score = (q.astype(np.float64) @ items.astype(np.float64).T).astype(np.int64)
        else:
            score = q @ items.T
        ids = iid[at]
        score[(qid[:, None] == ids[None, :]) | ~reach[:, at]] = LOWEST
        limit = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(qid), LOWEST)
        r, c = np.nonzero((score >= limit[:, None]) & (score > LOWEST) & (score >= least[:, None]))
        order = np.lexsort((ids[c], -score[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[place < k], c[place < k]
        return pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[c]), pa.array(score[r, c])], names=["query_id", "vec_id", "score"])

    def run(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                made = one({name: batch.column(name)[j].as_py() for name in batch.schema.names})
                if made is not None:
                    yield made

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_topk(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """Per query its ``k`` best other rows by inner product: query_id, rank, vec_id, score; ties go to the smaller id.

    Vectors are turned into whole numbers floor(scale * x). Queries are the rows whose id is divisible by ``every``. Rows are sorted
    by length and packed in blocks. The longest block gives each query a first bound for its last place. A pair of
    blocks is only formed if the product of their lengths reaches the bound; in it the first rotated elements are multiplied
    and, by Cauchy-Schwarz, what the others can add; only rows that still reach the bound are scored, exactly.

    Vectors that are null or hold null, NaN or infinity and rows without an id take no part; an empty vector scores 0. Shorter vectors count
    as padded with zeros. Rows with the query's id, its own and repeats of it, are no candidates; other repeated rows each are. A score must fit a
    long. Extra columns are ignored; an empty table gives an empty result.
    """
    vectors = stored(whole_vectors(table, id_col, vector_col, scale), "vectors")
    rows, width = vectors.agg(F.count("*"), F.max("width")).first()
    width = max(width or 0, 1)
    turn = rotation(vectors, width)
    unbound = vectors.withColumn("least", F.lit(LOWEST + 1))
    by_length = unbound.repartitionByRange(max(1, -(-rows // ITEM_ROWS)), F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id")
    items = stored(_blocks(by_length, ITEM_ROWS, width, turn), "items")
    asked = unbound.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    parts = max(1, -(-rows // (every * QUERY_ROWS)))
    first = stored(_blocks(asked.repartition(parts), QUERY_ROWS, width, turn), "asked")

    longest = items.select(F.col("block").alias("i")).orderBy(items.top.desc(), "block").limit(1)
    start = longest.join(first.select(F.col("block").alias("q")), F.lit(True))
    found = stored(_best(start, first, items, width, k), "found")
    least = found.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k)
    bound = asked.drop("least").join(least, asked.vec_id == least.query_id, "left").withColumn("least", F.coalesce("s", F.lit(LOWEST + 1)))
    queries = stored(_blocks(bound.repartition(parts), QUERY_ROWS, width, turn), "bound")
    ahead = items.select(F.col("block").alias("i"), F.col("top").alias("t")).join(longest, "i", "left_anti")
    pairs = ahead.join(queries.select(F.col("block").alias("q"), "top", "low"), F.col("t") * F.col("top") * (1 + SLACK) >= F.col("low")).select("q", "i")
    more = _best(stored(pairs, "pairs"), queries, items, width, k)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
