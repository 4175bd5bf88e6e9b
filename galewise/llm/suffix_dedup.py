"""Removal of long repeated byte strings by distributed prefix doubling over the positions that can repeat."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galewise.llm.common import U64, map_slices, mix, prefix_hashes, signed, slices, settled, span_hashes, stored, text_arrays, text_key

STEP = 1 << 20  # windows looked at together
NO_BYTES = pa.binary()
CELL = 8  # windows of a cell
LIST = 64  # occurrences in a list
CLASS = ["pk", "run", "doc", "packed", "several", "others"]


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text, …), and one row for each document, with ``doc``, a long in the order of (doc_id, nulls last; a hash of the text).

    Usually that is the id. Where ids repeat or are null, distinct (id, text) pairs are sorted by ranges and numbered, so
    rows equal in both stay one document.
    """
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        docs = docs.withColumn("doc", F.col("doc_id"))
        return docs, docs
    keyed = docs.withColumn("k", text_key())
    order = [F.col("doc_id").asc_nulls_last(), F.col("k")]
    parts = stored(keyed.select("doc_id", "k").distinct().repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "order")
    sizes = dict(parts.groupBy("p").count().collect())
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("p"))
    numbers = parts.withColumn("doc", start + F.row_number().over(Window.partitionBy("p").orderBy(*order)))
    numbers = stored(numbers.select(F.col("doc_id").alias("i"), F.col("k").alias("t"), F.col("doc").cast("long")), "numbers")
    docs = keyed.join(numbers, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("t"))).drop("i", "t", "k")
    return docs, docs.dropDuplicates(["doc"])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``length`` bytes that select the same ``gram``-byte string, their leftmost smallest by hash.

    Equal windows select equal strings at the same place wherever they stand, so a window can repeat only
    if its string does. Returns per run: text, first window in the text, windows beyond the first, place of the
    string behind the first window, hash of the string and hash of all bytes of the run.
    """
    width, out = length - gram + 1, []
    lengths = np.diff(offsets)
    for begin in range(0, max(len(data) - length + 1, 0), STEP):
        end = min(begin + STEP, len(data) - length + 1)
        sums = prefix_hashes(data[begin : end + length - 1])
        at = np.arange(len(sums) - gram)
        low = ((span_hashes(sums, at, at + gram) >> U64(23)) << U64(23)) | at.astype(U64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        pick = (low & U64((1 << 23) - 1)).astype(np.int64)
        windows = np.arange(begin, end)
        text = np.searchsorted(offsets, windows, side="right") - 1
        inside = windows - offsets[text] + length <= lengths[text]
        new = np.ones(len(windows), dtype=bool)
        new[1:] = (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new & inside)
        # windows that reach over the end of their text close a run
        last = np.flatnonzero(inside & np.concatenate((new[1:] | ~inside[1:], [True])))
        key = span_hashes(sums, pick[first], pick[first] + gram)
        run = span_hashes(sums, first, last + length)
        more, place = last - first, pick[first] - first
        run = mix(run + (more.astype(U64) << U64(40)) + (place.astype(U64) << U64(50)))
        out.append((text[first], first + begin - offsets[text[first]], more, place, key, run))
    if not out:
        return tuple(np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, U64, U64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _class_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(pk, run, doc, at, more, open, others): for each batch one row for each distinct run of windows.

    The batch's later occurrences surely repeat an earlier one; they travel as lists in rows of their own, dealt apart
    from their string. A batch that has several runs for one string sends one of them to
    the string's partition and deals the others by their own hash, so a very common string fills no task.
    """

    def combine(batches):
        for batch in batches:
            parts = []
            for part in slices(batch, "text"):
                text, at, more, place, key, run = window_runs(*text_arrays(part.column("text")), length, gram)
                doc = part.column("doc").to_numpy(zero_copy_only=False)
                parts.append((doc[text], at << 16 | more << 8 | place, key, run))
            if not parts or not sum(len(p[0]) for p in parts):
                continue
            doc, packed, key, run = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((packed, doc, run, key))
            doc, packed, key, run = (x[order] for x in (doc, packed, key, run))
            new_key = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.flatnonzero(new_key | np.concatenate(([True], run[1:] != run[:-1])))
            ends = np.concatenate((first[1:], [len(key)]))
            lead = new_key[first]
            several = np.concatenate((~lead[1:], [False])) | ~lead
            later = np.ones(len(key), dtype=bool)
            later[first] = False
            owner = np.repeat(np.arange(len(first)), ends - first)[later]
            place = np.flatnonzero(later) - first[owner] - 1
            cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] % LIST == 0)))) if len(owner) else []
            pairs = np.stack((doc[later], packed[later]), axis=1).astype(np.int64)
            lists = [pairs[lo:hi].tobytes() for lo, hi in zip(cut, [*cut[1:], len(pairs)])]
            pk = np.where(lead, key[first], mix(key[first] ^ run[first]))
            heads = [signed(pk), signed(run[first]), pa.array(doc[first]), pa.array(packed[first]), pa.array(several), pa.nulls(len(first), NO_BYTES)]
            yield pa.RecordBatch.from_arrays(heads, names=CLASS)
            if lists:
                begin = pairs[cut]
                apart = mix(mix(begin[:, 0].view(U64)) ^ begin[:, 1].view(U64))
                none = np.zeros(len(lists), np.int64)
                tails = [signed(apart), pa.array(none), pa.array(none), pa.array(none), pa.array(none.astype(bool)), pa.array(lists, NO_BYTES)]
                yield pa.RecordBatch.from_arrays(tails, names=CLASS)

    return docs.select("doc", "text").mapInArrow(combine, "pk long, run long, doc long, packed long, several boolean, others binary")


def _judged(rows: DataFrame, length: int) -> DataFrame:
    """(doc, s, e, a, open): spans that surely repeat, and runs of windows [s, e) around a string at ``a`` that must be compared.

    Of equal runs all but the first repeat an earlier one whole. The first of them is open if its string has other runs.
    """

    def judge(table: pa.Table):
        pk, run, doc, packed = (table.column(c).to_numpy() for c in ("pk", "run", "doc", "packed"))
        new_key = np.concatenate(([True], pk[1:] != pk[:-1]))
        new = new_key | np.concatenate(([True], run[1:] != run[:-1]))
        groups = np.flatnonzero(new_key)
        kinds = np.add.reduceat(new.astype(np.int64), groups)
        several = np.maximum.reduceat(table.column("several").to_numpy(zero_copy_only=False).astype(np.int8), groups)
        undecided = np.repeat((kinds > 1) | (several > 0), np.diff(np.append(groups, len(pk))))
        extra = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("others").drop_null().to_pylist()]
        extra = np.concatenate(extra) if extra else np.empty((0, 2), np.int64)
        classes = np.array(table.column("others").is_null())
        later, first = np.flatnonzero(~new & classes), np.flatnonzero(new & undecided & classes)
        docs = np.concatenate((doc[later], extra[:, 0], doc[first]))
        at = np.concatenate((packed[later], extra[:, 1], packed[first]))
        open_ = np.concatenate((np.zeros(len(later) + len(extra), bool), np.ones(len(first), bool)))
        start, more = at >> 16, at >> 8 & 255
        end = start + more + np.where(open_, 1, length)
        columns = [docs, start, end, start + (at & 255), open_]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc", "s", "e", "a", "open"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            pk = table.column("pk").to_numpy()
            ends = np.flatnonzero(pk[1:] != pk[:-1])
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield judge(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield judge(rest)

    dealt = rows.repartition("pk").sortWithinPartitions("pk", "run", "doc", "packed")
    return dealt.mapInArrow(run, "doc long, s long, e long, a long, open boolean")


def _cells(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(doc, a, low, high, outer, inner): the open runs cut at fixed distances from their strings.

    A cell is the windows that start ``low`` to ``high`` bytes before the string. ``outer`` is a hash of all their bytes, ``inner`` of
    those that every window of the whole cell holds: equal outer bytes mean that all windows are equal, and windows can only
    be equal if their inner bytes are.
    """
    lists = runs.groupBy("doc").agg(F.collect_list(F.struct("s", "e", "a")).alias("runs"))

    def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = text_arrays(part.column("text"))
        lists, made = part.column("runs"), []
        flat, cuts = lists.flatten(), lists.offsets.to_numpy()
        cuts = cuts - cuts[0]
        s, e, a = (flat.field(c).to_numpy() for c in ("s", "e", "a"))
        for i in range(part.num_rows):
            own = slice(cuts[i], cuts[i + 1])
            near, far = a[own] - e[own] + 1, a[own] - s[own]
            count = far // CELL - near // CELL + 1
            which = np.repeat(np.arange(len(count)), count)
            cell = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + (near // CELL)[which]
            low, high = np.maximum(cell * CELL, near[which]), np.minimum(cell * CELL + CELL - 1, far[which])
            at = a[own][which]
            sums = prefix_hashes(data[offsets[i] : offsets[i + 1]])
            outer = mix(span_hashes(sums, at - high, at - low + length) + (low * 256 + high).astype(U64))
            inner = mix(span_hashes(sums, at - cell * CELL, at - cell * CELL - CELL + 1 + length) + cell.astype(U64))
            made.append((np.full(len(at), i), at, low, high, outer, inner))
        who, at, low, high, outer, inner = (np.concatenate(x) for x in zip(*made))
        return pa.RecordBatch.from_arrays(
            [part.column("doc").take(pa.array(who)), pa.array(at), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16)), signed(outer), signed(inner)],
            names=["doc", "a", "low", "high", "outer", "inner"],
        )

    return map_slices(docs.select("doc", "text").join(lists.hint("merge"), "doc"), "text", "doc long, a long, low short, high short, outer long, inner long", work)


def _positions(docs: DataFrame, spans: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc, p, r, t): the open windows' starts and those ``length / 2`` behind them, with the ranks of their first and
    next ``seed`` bytes."""
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = text_arrays(part.column("text"))
        rows, spans = [], part.column("spans")
        flat = spans.flatten()
        starts, ends = (flat.field(c).to_numpy() for c in ("s", "e"))
        owner = np.repeat(np.arange(part.num_rows), np.diff(spans.offsets.to_numpy()))
        for i in range(part.num_rows):
            own = slice(*np.searchsorted(owner, [i, i + 1]))
            counts = ends[own] - starts[own]
            p = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            p = np.unique(np.concatenate((p, p + length // 2)))
            sums = prefix_hashes(data[offsets[i] : offsets[i + 1]])
            rows.append((np.full(len(p), i), p, span_hashes(sums, p, p + seed), span_hashes(sums, p + seed, p + 2 * seed)))
        who, p, r, t = (np.concatenate(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(who)), pa.array(p), signed(r), signed(t)], names=["doc", "p", "r", "t"])

    return map_slices(docs.select("doc", "text").join(lists.hint("merge"), "doc"), "text", "doc long, p long, r long, t long", work)


def _reranked(pairs: DataFrame, label: str) -> DataFrame:
    """(r, t, rank, doc, p) of the rank pairs that more than one position has, in their order; p is the first position."""
    place = F.min(F.struct("doc", "p")).alias("first")
    groups = pairs.groupBy("r", "t").agg(F.count("*").alias("n"), place).where("n > 1")
    ordered = groups.repartitionByRange("r", "t").sortWithinPartitions("r", "t")
    return settled(ordered.select("r", "t", F.monotonically_increasing_id().alias("rank"), F.col("first.doc").alias("first_doc"), F.col("first.p").alias("first_p")), label)


def _merged(spans: DataFrame) -> DataFrame:
    """(doc, spans): the maximal covered runs of each document."""

    def run(batches):
        rest = None
        for batch in batches:
            doc, s, e = (batch.column(c).to_numpy() for c in ("doc", "s", "e"))
            if not len(doc):
                continue
            if rest is not None:
                doc, s, e = (np.concatenate(([x], y)) for x, y in zip(rest, (doc, s, e)))
            group = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
            reach = np.maximum.accumulate(e + (group << 40)) - (group << 40)
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (s[1:] > reach[:-1])))
            first = np.flatnonzero(new)
            doc, s, e = doc[first], s[first], reach[np.concatenate((first[1:] - 1, [len(reach) - 1]))]
            rest = (doc[-1], s[-1], e[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in (doc, s, e)], names=["doc", "s", "e"])
        if rest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in rest], names=["doc", "s", "e"])

    made = spans.repartition("doc").sortWithinPartitions("doc", "s").mapInArrow(run, "doc long, s long, e long")
    return made.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = 50) -> DataFrame:
    """(doc, spans) for ``docs`` (doc, text): the maximal runs of bytes covered by a ``length``-byte string that starts earlier.

    ``length`` must be a multiple of 4. Positions are first reduced without loss: windows are gathered in runs that select one
    string of ``gram`` bytes; a string that occurs once can't be part of a repeat, and equal runs need one comparison. Runs that differ
    are cut in cells, and cells compared whole. What is left, where repeats begin and end, goes through prefix doubling:
    the ranks of length / 4 bytes are paired at that offset, sorted and reranked, positions whose pair is unique
    drop out, and the new ranks are paired at length / 2.
    """
    judged = settled(_judged(_class_rows(docs, length, gram), length), "judged")
    cells = settled(_cells(docs, judged.where("open").select("doc", "s", "e", "a"), length), "cells")
    firsts = cells.groupBy("outer").agg(F.count("*").alias("n"), F.min(F.struct("doc", "a")).alias("first")).where("n > 1")
    firsts = settled(firsts.select("outer", F.col("first.doc").alias("first_doc"), F.col("first.a").alias("first_a")), "firsts")
    cells = cells.join(firsts, "outer", "left").withColumn("again", F.expr("first_doc is not null and (doc <> first_doc or a <> first_a)"))
    cells = settled(cells.select("doc", (F.col("a") - F.col("high")).alias("s"), (F.col("a") - F.col("low") + 1).alias("e"), "inner", "again"), "placed")
    shared = settled(cells.where("not again").groupBy("inner").count().where("count > 1").select("inner"), "shared")
    windows = cells.where("not again").join(shared, "inner", "left_semi").select("doc", "s", "e")

    quarter = settled(_positions(docs, windows, length, length // 4), "quarter")
    half = _reranked(quarter, "half")
    ranked = settled(quarter.join(half.select("r", "t", "rank"), ["r", "t"]).select("doc", "p", "rank"), "ranked")
    ahead = ranked.select("doc", (F.col("p") - length // 2).alias("p"), F.col("rank").alias("t"))
    pairs = settled(ranked.withColumnRenamed("rank", "r").join(ahead, ["doc", "p"]).select("doc", "p", "r", "t"), "pairs")
    full = _reranked(pairs, "full")
    later = pairs.join(full, ["r", "t"]).where("doc <> first_doc or p <> first_p").select("doc", F.col("p").alias("s"), (F.col("p") + length).alias("e"))
    whole = judged.where("not open").select("doc", "s", "e")
    whole = whole.unionByName(cells.where("again").select("doc", "s", (F.col("e") - 1 + length).alias("e")))
    return _merged(whole.unionByName(later))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_bytes: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept, the bytes that remain.

    A byte goes if a ``length``-byte string that covers it starts earlier: in a smaller id, or before in the same text. Strings are
    judged on the texts as they came and never reach over two of them. A null text is empty, loses nothing and keeps the hash of no bytes.
    Rows equal in id and text count as one document, so repeats of a row don't make each other go; rows that share an
    id alone are taken in the order of a hash of their texts. Null ids come last. Extra columns are ignored.
    """
    rows, single = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    spans = settled(repeated_spans(single.select("doc", "text"), length), "spans")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_arrays(part.column("text"))
        lists = part.column("spans").to_pylist()
        size, removed, count, digest, kept = [], [], [], [], []
        for i, spans in enumerate(lists):
            own, at, pieces = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
            for span in sorted(spans or [], key=lambda x: x["s"]):
                pieces.append(own[at : span["s"]])
                at = span["e"]
            rest = b"".join([*pieces, own[at:]])
            size.append(len(own)), removed.append(len(own) - len(rest)), count.append(len(spans or []))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if with_bytes else None)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(digest, pa.string()), pa.array(kept, NO_BYTES)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    joined = rows.join(spans.hint("merge"), "doc", "left").select("doc_id", "text", "spans")
    out = map_slices(joined, "text", "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", work)
    return out if with_bytes else out.drop("kept")
