"""Near-duplicates: universal hash minima, banding, verification and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import U64, map_slices, mix, shingles_of, signed, stored, streams, text_arrays, words_of
from galewise.llm.components import connected

ROWS, BANDS = 5, 28  # a pair at the threshold 0.85 shares no band once in 10^7
BRIEF = 4096  # sets up to this size travel as 32-bit shingles to where a bucket is compared
CHUNK = 512  # members of a bucket that are compared at a time
SLACK = 6.0  # standard deviations by which an estimate may fall short of the threshold


def signature_rows(bands: int, rows: int, shingle: int, id_col: str, text_col: str):
    """Arrow function: per row the size of its shingle set, a 128-bit key of the set and its minima."""
    mult, add = streams(bands * rows, 31) | U64(1), streams(bands * rows, 37)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = words_of(*text_arrays(batch.column(text_col)))
        hashes, at = shingles_of(words, bounds, shingle)
        count = batch.num_rows
        sizes, first, second = np.zeros(count, np.int64), np.zeros(count, U64), np.zeros(count, U64)
        for i in range(count):
            own = np.unique(hashes[at[i] : at[i + 1]])
            sizes[i] = len(own)
            first[i], second[i] = own.sum(dtype=U64), mix(own ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
        full = np.flatnonzero(sizes)
        minima = np.zeros((count, bands * rows), dtype=np.uint32)
        if len(full):
            starts = at[:-1][full]
            for k in range(bands * rows):
                minima[full, k] = np.minimum.reduceat(hashes * mult[k] + add[k], starts) >> U64(32)
        size = 4 * bands * rows
        signs = pa.Array.from_buffers(
            pa.binary(), count,
            [None, pa.py_buffer(np.arange(0, (count + 1) * size, size, dtype=np.int32)), pa.py_buffer(minima.tobytes())],
        )
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col).cast(pa.int64()), pa.array(sizes), signed(mix(first)), signed(mix(second)), signs],
            names=["doc_id", "n_shingles", "h1", "h2", "minima"],
        )

    return work


def _minima(column: pa.Array, width: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint32, count=len(column) * width, offset=start).reshape(-1, width)


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each row of minima."""
    minima = minima.astype(U64).reshape(-1, bands, rows)
    keys = np.broadcast_to(streams(bands, 41), (len(minima), bands)).copy()
    for r in range(rows):
        keys = mix(keys * U64(0xD1342543DE82EF95) + minima[:, :, r])
    return keys


def band_rows(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, rep): one row for each band of every class."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = band_keys(_minima(batch.column(1), bands * rows), bands, rows)
            reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([signed(keys.reshape(-1)), pa.array(reps)], names=["key", "rep"])

    return classes.select("rep", "minima").mapInArrow(run, "key long, rep long")


def _agreeing(pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``pairs`` (a, b) with the number of minima in which they agree."""
    signs = classes.select("rep", "minima")
    both = pairs.join(signs.withColumnsRenamed({"rep": "a", "minima": "x"}), "a")
    both = both.join(signs.withColumnsRenamed({"rep": "b", "minima": "y"}), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = (_minima(batch.column(2), width) == _minima(batch.column(3), width)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same.astype(np.int32))], names=["a", "b", "same"])

    return both.mapInArrow(run, "a long, b long, same int")


def _across(members: DataFrame, classes: DataFrame, sets: DataFrame, bands: int, rows: int, least: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members (key, rep, comp, n) in different components that may reach the threshold.

    A bucket is dealt into parts of about CHUNK members, and a task compares two parts at a time, so the largest
    group has about 2 * CHUNK rows however large the bucket. A pair is looked at in the first bucket it shares:
    it must agree in ``least`` minima and then, unless the sets are large, reach the threshold on shortened shingles.
    """
    parts, width = F.ceil(F.col("n") / CHUNK), bands * rows
    dealt = members.join(classes.select("rep", "minima"), "rep").join(sets.select("rep", "brief"), "rep")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep", "key"), parts))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.select("key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "rep", "comp", "part", "minima", "brief")

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        rep, comp, part = (table.column(c).to_numpy() for c in ("rep", "comp", "part"))
        minima = _minima(table.column("minima").combine_chunks(), width)
        keys, key = band_keys(minima, bands, rows), table.column("key")[0].as_py()
        brief = [x if x is None else np.frombuffer(x, np.uint32) for x in table.column("brief").to_pylist()]
        same_part = table.column("i")[0] == table.column("j")[0]
        left, right = [], []
        for r in range(len(rep)):
            near = (comp != comp[r]) & (rep > rep[r])
            if not same_part:
                near &= part != part[r]
            near = np.flatnonzero(near)
            near = near[(minima[near] == minima[r]).sum(axis=1) >= least]
            if not len(near):
                continue
            shared = keys[near] == keys[r]
            near = near[keys[r][shared.argmax(axis=1)].view(np.int64) == key]
            if brief[r] is not None and len(near):
                sized = np.array([i for i in near if brief[i] is not None], dtype=np.int64)
                if len(sized):
                    flat, own = np.concatenate([brief[i] for i in sized]), brief[r]
                    sizes = np.array([len(brief[i]) for i in sized])
                    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                    both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
                    far = 100 * (both + 2) < percent * (sizes + len(own) - both - 2)
                    near = np.setdiff1d(near, sized[far])
            left.append(np.full(len(near), rep[r]))
            right.append(rep[near])
        if not left:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            group = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            ends = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends):
                if (made := compare(table.slice(lo, hi - lo))) is not None:
                    yield made
            rest = table.slice(ends[-1]) if len(ends) else table
        if rest is not None and rest.num_rows and (made := compare(rest)) is not None:
            yield made

    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "shingles": "x"}), "a")
    both = both.join(sets.withColumnsRenamed({"rep": "b", "shingles": "y"}), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = words_of(*text_arrays(batch.column("text")))
        hashes, at = shingles_of(words, bounds, shingle)
        own = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
        first = np.array([x.sum(dtype=U64) for x in own], dtype=U64)
        flat = np.concatenate(own) if own else np.empty(0, U64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))), pa.int32()), signed(flat))
        brief = pa.array([np.unique((x >> U64(32)).astype(np.uint32)).tobytes() if len(x) <= BRIEF else None for x in own], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("h1"), signed(mix(first)), lists, brief], names=["rep", "h1", "got", "shingles", "brief"])

    rows = docs.join(wanted.select("rep", "h1", "first_id").hint("merge"), F.col("doc_id") == F.col("first_id")).select("rep", "h1", "text")
    made = map_slices(rows, "text", "rep long, h1 long, got long, shingles array<long>, brief binary", work)
    return made.where("h1 = got").select("rep", "shingles", "brief").dropDuplicates(["rep"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, shingle: int = 5,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows with equal shingle sets form a class, so a group of copies of any size is one node. Classes that share
    a band are candidates: first each class against the leaders of its buckets, of which the best agreeing one is
    verified on full sets; then, only in buckets that still hold several components, all pairs across components.
    Candidates whose minima agree too seldom to reach the threshold are dropped before the sets are compared.

    A null or empty text, or one without words, has size 0 and is a component of its own. Rows without an id take no
    part: their component is null and they are kept. Rows that share an id are judged by their texts; ``kept`` says that
    the id is the smallest of its component, so exact repeats of a row are kept or dropped together. Extra columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    work = signature_rows(bands, rows, shingle, "doc_id", "text")
    signed_rows = stored(map_slices(docs, "text", "doc_id long, n_shingles long, h1 long, h2 long, minima binary", work), "minima")
    linked = signed_rows.where("doc_id is not null and n_shingles > 0")
    # a class has a number of its own, given once as the table is written: different texts may share an id
    classes = linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.first("minima").alias("minima"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    keys = stored(band_rows(classes, bands, rows), "bands")
    lead = F.min(F.col("rep").bitwiseXOR(F.col("key")))
    buckets = stored(
        keys.groupBy("key").agg(F.count("*").alias("n"), lead.alias("lead")).where("n > 1")
        .select("key", F.col("lead").bitwiseXOR(F.col("key")).alias("lead")), "buckets",
    )
    members = stored(keys.join(buckets, "key").select("key", "rep", "lead"), "members")
    wanted = members.select("rep").distinct().join(classes.select("rep", "h1", "first_id"), "rep")
    sets = stored(_shingle_sets(docs, wanted, shingle), "sets")

    width = bands * rows
    least = int(width * percent / 100 - SLACK * np.sqrt(width * percent / 100 * (1 - percent / 100)))
    stars = members.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    stars = stored(_agreeing(stars, classes, width).where(F.col("same") >= least), "stars")
    links = stored(_verified(stars.select("a", "b"), sets, percent), "links")
    found = stored(connected(links), "found")

    placed = members.join(found, members.rep == found.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    mixed = stored(mixed.where("lo < hi").select("key", "n"), "mixed")
    open_rows = stored(placed.join(mixed, "key"), "open")
    across = _across(open_rows, classes, sets, bands, rows, least, percent).distinct()
    more = stored(_verified(across, sets, percent), "more")
    star = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = connected(star.unionByName(more))

    placed = classes.join(final, classes.rep == final.node, "left").select("h1", "h2", "first_id", "component")
    placed = stored(placed, "placed-classes")
    least_ids = stored(placed.where("component is not null").groupBy("component").agg(F.min("first_id").alias("least_id")), "least-ids")
    known = placed.join(least_ids, "component", "left").select("h1", "h2", F.coalesce("least_id", "first_id").alias("component_id"))
    known = stored(known, "known")
    out = signed_rows.select("doc_id", "n_shingles", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
