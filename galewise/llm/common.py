"""Helpers the corpus operators share: words and hashes of Arrow text columns, stored tables.

Texts are handled as UTF-8 bytes. Words are the runs ``[^\\x20\\x09-\\x0D]+`` after A-Z were lowered.
All helpers work on slices of bounded size, so a batch of long texts never multiplies in memory.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galewise.session import cut_lineage

U64 = np.uint64
PIECE = 1 << 20  # bytes hashed at a time
LONG_RUN = 256  # bytes of a word from which on it is hashed by itself
_BASE = 0x9E3779B97F4A7C15 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def streams(count: int, seed: int) -> np.ndarray:
    """``count`` pseudo-random 64-bit values for ``seed``."""
    start = (seed * 0x9E3779B97F4A7C15) & (2**64 - 1)
    return mix(np.arange(1, count + 1, dtype=U64) * U64(_BASE) + U64(start))


_BYTE_VALUES = streams(256, 11)
_POWERS: dict[str, np.ndarray] = {}


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < count:
        count = max(count, PIECE + 1)
        inverse = pow(_BASE, -1, 2**64)
        ones = np.full(count, U64(_BASE))
        ones[0] = 1
        _POWERS["up"] = np.cumprod(ones, dtype=U64)
        ones[1:] = U64(inverse)
        _POWERS["down"] = np.cumprod(ones, dtype=U64)
        _POWERS["n"] = count
    return _POWERS["up"], _POWERS["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums of ``value(byte) * base ** position``, with a leading 0.

    Modulo 2^64 such sums of long strings can be made to collide, so use them for windows of up to some hundred bytes, not for words or lines.
    """
    up, _ = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], dtype=U64, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings ``[start, end)`` under :func:`prefix_hashes`; equal strings agree."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def _cuts(mask: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE bytes that end at a text's end or behind a separator."""
    at, total = 0, len(mask)
    while at < total:
        end = min(at + PIECE, total)
        if end < total and mask[end - 1] and mask[end] and not firsts[end]:
            back = np.flatnonzero(~mask[at:end] | np.append(firsts[at + 1 : end], False))
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(~mask[end:] | firsts[end:-1])
                end = end + int(ahead[0]) if len(ahead) else total
        yield at, end
        at = end


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings ``data[start:end]``, eight bytes a step; long ones by BLAKE2.

    No step is linear in the bytes, so strings can't be built that collide for every choice of the constants.
    """
    sizes = ends - starts
    out = mix(sizes.astype(U64) + U64(_BASE))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    rest = np.flatnonzero((sizes > 0) & (sizes <= LONG_RUN))
    at = starts[rest]
    while len(rest):
        left = np.minimum(ends[rest] - at, 8)
        # the bytes beyond the end are shifted out
        out[rest] = mix(out[rest] ^ (eight[at] << (U64(64) - left.astype(U64) * U64(8))))
        more = np.flatnonzero(ends[rest] - at > 8)
        rest, at = rest[more], at[more] + 8
    for i in np.flatnonzero(sizes > LONG_RUN):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = IS_WORD, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of all words of the texts ``data[offsets[i]:offsets[i + 1]]`` and each text's first word index.

    ``table`` says which bytes words are made of. For each number in ``stems`` the hashes of the words' first so many bytes, up to a whole letter, follow.
    """
    mask = table[data]
    firsts = np.zeros(len(data) + 1, dtype=bool)
    firsts[offsets] = True
    hashes, starts_at, begun = [], [], [[] for _ in stems]
    for lo, hi in _cuts(mask, firsts):
        inside, first = mask[lo:hi], firsts[lo : hi + 1].copy()
        first[0] = True
        begin = inside & (first[:-1] | ~np.concatenate(([False], inside[:-1])))
        end = inside & (first[1:] | ~np.concatenate((inside[1:], [False])))
        begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        low = LOWER[data[lo:hi]]
        hashes.append(run_hashes(low, begins, ends))
        starts_at.append(begins + lo)
        for size, out in zip(stems, begun):
            stem_ends = np.minimum(begins + size, ends)
            for _ in range(3):  # a letter of several bytes is not cut
                inner = np.flatnonzero(stem_ends < ends)
                stem_ends[inner] += (low[stem_ends[inner]] & 0xC0) == 0x80
            out.append(run_hashes(low, begins, stem_ends))
    if not hashes:
        hashes, starts_at, begun = [np.empty(0, U64)], [np.empty(0, np.int64)], [[np.empty(0, U64)] for _ in stems]
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offsets), *(np.concatenate(x) for x in begun)


def shingles_of(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text, and where each text's begin.

    A text of fewer words has its whole sequence as its only shingle, one without words has none.
    """
    counts = np.diff(bounds)
    mult = streams(size, 23) | U64(1)
    n = len(words)
    rolled = np.zeros(max(n, 1), dtype=U64)
    span = max(n - size + 1, 0)
    for k in range(size):
        rolled[:span] += words[k : k + span] * mult[k]
    rolled = mix(rolled + U64(size))
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(made)))
    keep = np.ones(n, dtype=bool)
    tails = np.minimum(counts, size - 1)
    if n:
        # the last size - 1 words of a text start no shingle, but for a short text's first word
        marks = np.zeros(n + 1, dtype=np.int64)
        np.add.at(marks, bounds[1:] - tails, 1)
        np.add.at(marks, bounds[1:], -1)
        keep = np.cumsum(marks[:-1]) == 0
        short = np.flatnonzero((counts > 0) & (counts < size))
        keep[bounds[short]] = True
        for i in short:
            own = words[bounds[i] : bounds[i + 1]]
            rolled[bounds[i]] = mix(np.array([(own * mult[: len(own)]).sum(dtype=U64) + U64(len(own))]))[0]
    return rolled[:n][keep], out_bounds


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets, from 0; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` whose texts hold about ``limit`` bytes; a longer text comes alone."""
    lengths = np.diff(text_arrays(batch.column(column))[1]) if batch.num_rows else np.empty(0)
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(lengths[at:])
        count = max(1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(at, count)
        at += count


def map_slices(df: DataFrame, text: str, schema: StructType | str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """Apply ``work`` to slices of bounded text size of every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = work(part)
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(run, schema)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return cut_lineage(df, f"llm-{label}")


def settled(df: DataFrame, label: str) -> DataFrame:
    """Like :func:`stored`, and let the driver drop the shuffle files of what was written.

    Spark removes them once the driver's JVM has collected the plans; a job of many steps would hold all of them till then.
    """
    made, spark = stored(df, label), df.sparkSession
    del df  # else the plan just run is held until the next call
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return made


def text_key(column: str = "text") -> F.Column:
    """A 128-bit key of a text as one string; null and empty agree."""
    return F.md5(F.coalesce(F.col(column), F.lit("")))


def bit_places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter of ``size`` bits, a power of two."""
    return keys & U64(size - 1), (keys >> U64(32)) & U64(size - 1)


def bit_filter(keys: DataFrame, most_bits: int, least_bits: int = 1 << 16) -> np.ndarray:
    """A bit filter of the 64-bit hashes in the only column of ``keys``, a stored table: about 16 bits a key, at most ``most_bits`` in all.

    Where there are more keys it passes more of others, never fewer of its own. Bits are combined in Spark; the driver gets the filter's words.
    """
    size, wanted = least_bits, 16 * keys.count()
    while size < min(wanted, most_bits):
        size *= 2

    def places(batches):
        for batch in batches:
            at = np.concatenate(bit_places(batch.column(0).to_numpy().view(U64), size))
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), signed(U64(1) << (at & U64(63)))], names=["at", "bits"])

    words = keys.mapInArrow(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(size >> 6, dtype=U64)
    held[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(U64)
    return held


def may_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash."""
    out = np.ones(len(keys), dtype=bool)
    for at in bit_places(keys, 64 * len(held)):
        out &= (held[at >> U64(6)] >> (at & U64(63))) & U64(1) == 1
    return out


FILTER_BITS = 1 << 28  # of a filter of ids: 32 MB


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, …) joined to ``ids``, a stored table with doc_id, none of them null.

    A bit filter of the ids drops most other rows before the join moves any text.
    """

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([signed(mix(batch.column(0).to_numpy().view(U64)))], names=["h"])

    held = rows.sparkSession.sparkContext.broadcast(bit_filter(settled(ids.select("doc_id").mapInArrow(hashed, "h long"), "wanted-ids"), FILTER_BITS))

    def sift(part: pa.RecordBatch) -> pa.RecordBatch:
        own = part.column("doc_id")
        known = may_hold(held.value, mix(own.fill_null(0).to_numpy(zero_copy_only=False).view(U64))) & ~np.array(own.is_null())
        return part.filter(pa.array(known))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_slices(rows, "text", kinds, sift).join(ids.hint("merge"), "doc_id")
