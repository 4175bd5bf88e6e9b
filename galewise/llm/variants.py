"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary.

The vocabulary is cut by length, and a long one by hash, into shards of a blocked Bloom filter each. Tasks generate the edits of their words and
probe them in the filter of the edit's length; only the positives are shuffled to an exact join with the vocabulary, which drops the false ones.
Filters are broadcast in rounds of at most ROUND_BYTES, so what a worker holds doesn't grow with the vocabulary; more words mean more rounds.

An insertion is a deletion seen from the longer word, and of two words that differ in one letter either is the replacement of the other.
So each word generates its deletions and the replacements by greater letters, and every pair is met exactly once.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import LOWER, U64, map_slices, mix, settled, signed, stored, text_arrays

SHARD_WORDS = 1 << 19
ROUND_BYTES = 64 << 20
KEY_BITS = 16  # of a filter for each word
TESTS = 6  # bits set for each word, within one block of 512
EDITS = 1 << 20  # probed at a time

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


# --- words of texts ---

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else


def _shifts(longest: int) -> np.ndarray:
    """[n, k, b]: what the byte b at place k of a CRC-32 becomes when n zero bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = np.empty((longest + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(longest):
        out[n + 1] = (out[n] >> 8) ^ table[out[n] & 0xFF]
    return out


_SHIFTS = _shifts(64)


def checksums(heads: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of strings joined from two parts, from those of the parts and the bytes of the second, at most 64."""
    out = tails.copy()
    for k in range(4):
        out ^= _SHIFTS[sizes, k, (heads >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered, and each one's text."""
    lead = data == _LEAD
    mask = _LETTER[data] | lead | np.concatenate(([False], lead[:-1]))
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(mask & (cut[:-1] | ~np.concatenate(([False], mask[:-1]))))
    ends = np.flatnonzero(mask & (cut[1:] | ~np.concatenate((mask[1:], [False])))) + 1
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    runs = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(LOWER[data[mask]])])
    return runs.dictionary_encode(), np.searchsorted(offsets, starts, side="right") - 1


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 31, least_size: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n): runs of letters, some of them with a letter lost, that have ``least_size`` code points and occur ``least_count`` times.

    A run loses its code point ``h mod length`` if ``one_in`` divides h, the unsigned CRC-32 of ``<doc_id>:<run>``; a null id counts as empty.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("head"), F.col(text_col).alias("text"))

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        runs, owner = _runs(*text_arrays(part.column("text")))
        if not len(runs):
            return None
        values, code = runs.dictionary.to_pylist(), runs.indices.to_numpy()
        raw = [v.encode() for v in values]
        sizes, letters = np.array([len(b) for b in raw]), np.array([len(v) for v in values])
        heads = np.array([zlib.crc32(f"{i}:".encode()) for i in part.column("head").to_pylist()], dtype=np.uint32)
        tails = np.array([zlib.crc32(b) for b in raw], dtype=np.uint32)
        h = checksums(heads[owner], tails[code], np.minimum(sizes, 64)[code])
        for i in np.flatnonzero(sizes[code] > 64):
            h[i] = zlib.crc32(raw[code[i]], int(heads[owner[i]]))
        hit = h % one_in == 0
        n = np.bincount(code[~hit], minlength=len(values))
        whole = np.flatnonzero((n > 0) & (letters >= least_size))
        code, at = code[hit].astype(np.int64), (h[hit] % letters[code[hit]]).astype(np.int64)
        long = letters[code] > least_size
        wide = int(letters.max())
        lost, times = np.unique(code[long] * wide + at[long], return_counts=True)
        shorter = [values[c][:k] + values[c][k + 1 :] for c, k in zip((lost // wide).tolist(), (lost % wide).tolist())]
        return pa.RecordBatch.from_arrays([pa.array([values[i] for i in whole.tolist()] + shorter, pa.string()), pa.array(np.concatenate((n[whole], times)))], names=["word", "n"])

    found = map_slices(rows, "text", "word string, n long", count).groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least_count)


# --- filters ---


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of strings behind each other, and where each string's begin."""
    data, offsets = text_arrays(words)
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32), starts[offsets]


def _value(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(U64) + U64(_BASE))


def _powers(size: int) -> np.ndarray:
    out = np.full(size + 1, U64(_BASE))
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def _sums(points: np.ndarray) -> np.ndarray:
    """Running polynomial hashes along the rows of a matrix of code points, with a leading 0."""
    sums = np.zeros((len(points), points.shape[1] + 1), dtype=U64)
    np.cumsum(_value(points) * _powers(points.shape[1])[:-1], axis=1, dtype=U64, out=sums[:, 1:])
    return sums


def by_size(words: pa.Array):
    """(indices, matrix of code points) of the strings of each length, in pieces of bounded size."""
    points, starts = _points(words)
    sizes = np.diff(starts)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        size = int(sizes[order[at]])
        own = order[at : at + max(1, EDITS // max(size, 1))]
        own = own[sizes[own] == size]
        yield own, points[starts[own][:, None] + np.arange(size)]
        at += len(own)


def _within(hashes: np.ndarray, parts) -> np.ndarray:
    """Which of ``parts`` equal ranges of 64-bit values a hash is in."""
    return ((hashes >> U64(32)) * np.asarray(parts, dtype=U64)) >> U64(32)


def _places(hashes: np.ndarray, blocks: int):
    """For each test the words of a filter of ``blocks`` blocks that hashes look at, and the bits in them."""
    block = _within(mix(hashes + U64(1)), blocks) << U64(3)
    bits = mix(hashes + U64(2))
    for k in range(TESTS):
        nine = (bits >> U64(9 * k)) & U64(511)
        yield block + (nine >> U64(6)), U64(1) << (nine & U64(63))


class Filters:
    """The filters of one round: for each length and part the bits, and for each length the letters of its words."""

    def __init__(self, rows: list[dict], parts: dict[int, int], letters: dict[int, np.ndarray]):
        self.parts = parts
        self.bits = {(r["size"], r["part"]): np.frombuffer(r["bits"], dtype=U64) for r in rows}
        self.letters = {size: letters[size] for size, _ in self.bits}

    def hold(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes of strings of ``size`` letters that may be words."""
        parts, found = _within(hashes, self.parts[size]), []
        for part in range(self.parts[size]):
            bits = self.bits.get((size, part))
            if bits is None:
                continue
            own = np.flatnonzero(parts == part) if self.parts[size] > 1 else np.arange(len(hashes))
            rest = hashes[own]
            block = _within(mix(rest + U64(1)), len(bits) >> 3) << U64(3)
            drawn = mix(rest + U64(2))
            for k in range(TESTS):
                nine = (drawn >> U64(9 * k)) & U64(511)
                ok = np.flatnonzero((bits[block + (nine >> U64(6))] >> (nine & U64(63))) & U64(1))
                own, block, drawn = own[ok], block[ok], drawn[ok]
            found.append(own)
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def _blocks_for(words: int) -> int:
    return max(8, -(-words * KEY_BITS // 512))


def filter_table(vocabulary: DataFrame, sizes: dict[int, int], shard_words: int) -> DataFrame:
    """One row (size, part, bits) for each shard of the vocabulary; a shard's words meet in one task as 64-bit hashes."""
    parts = {size: -(-n // shard_words) for size, n in sizes.items()}

    def hashed(batches):
        for batch in batches:
            for own, points in by_size(batch.column("word")):
                size = points.shape[1]
                hashes = mix(_sums(points)[:, -1])
                rows = [pa.array(np.full(len(own), size)), pa.array(_within(hashes, parts[size]).astype(np.int64)), signed(hashes)]
                yield pa.RecordBatch.from_arrays(rows, names=["size", "part", "h"])

    def build(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        bits = np.zeros(8 * _blocks_for(min(sizes[size], shard_words)), dtype=U64)
        for at, bit in _places(table.column("h").to_numpy().view(U64), len(bits) >> 3):
            np.bitwise_or.at(bits, at, bit)
        return pa.table({"size": [size], "part": table.column("part")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = vocabulary.mapInArrow(hashed, "size long, part long, h long")
    return rows.groupBy("size", "part").applyInArrow(build, "size long, part long, bits binary")


def letters_of(vocabulary: DataFrame) -> dict[int, np.ndarray]:
    """For each length of words the code points in them: no more than lengths times letters of the alphabet."""

    def met(batches):
        for batch in batches:
            for _, points in by_size(batch.column("word")):
                letters = np.unique(points)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(letters), points.shape[1])), pa.array(letters.astype(np.int64))], names=["size", "letter"])

    found = defaultdict(list)
    for row in vocabulary.mapInArrow(met, "size long, letter long").distinct().collect():
        found[row.size].append(row.letter)
    return {size: np.array(sorted(letters), dtype=np.uint32) for size, letters in found.items()}


# --- probing ---


def edits_held(words: pa.Array, filters: Filters):
    """(word index, place, letter) of the edits that may be words; the letter 0 stands for a deletion."""
    for own, points in by_size(words):
        size = points.shape[1]
        up = _powers(size)
        if size - 1 in filters.letters:
            sums = _sums(points)
            made = mix(sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * U64(_INVERSE))
            new = np.ones(points.shape, dtype=bool)  # of equal letters in a row the first one goes
            new[:, 1:] = points[:, 1:] != points[:, :-1]
            row, at = np.nonzero(new)
            hit = filters.hold(size - 1, made[row, at])
            yield own[row[hit]], at[hit], np.zeros(len(hit), dtype=np.uint32)
        if size in filters.letters:
            letters = filters.letters[size]
            values, old, total = _value(letters), _value(points), _sums(points)[:, -1]
            step = max(1, EDITS // (size * len(letters)))
            wide = max(1, EDITS // len(letters))
            for lo in range(0, len(own), step):
                for first in range(0, size, wide):
                    part = points[lo : lo + step, first : first + wide]
                    row, at, letter = np.nonzero(part[:, :, None] < letters)
                    at += first
                    made = total[lo + row] + (values[letter] - old[lo + row, at]) * up[at]
                    hit = filters.hold(size, mix(made))
                    yield own[lo + row[hit]], at[hit], letters[letter[hit]]


def _positives(vocabulary: DataFrame, filters: Filters) -> DataFrame:
    """(word, n, edit): the edits of words that the filters hold."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)

    def probe(batches):
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n")
            for own, at, letter in edits_held(batch.column("word"), shared.value):
                if len(own):
                    edits = [words[i][:k] + (chr(c) if c else "") + words[i][k + 1 :] for i, k, c in zip(own.tolist(), at.tolist(), letter.tolist())]
                    own = pa.array(own)
                    yield pa.RecordBatch.from_arrays([batch.column("word").take(own), n.take(own), pa.array(edits, pa.string())], names=["word", "n", "edit"])

    made = settled(vocabulary.select("word", "n").mapInArrow(probe, "word string, n long, edit string"), "variant-edits")
    shared.destroy()
    return made


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, near, near_n) for all pairs of words of ``vocabulary`` (word, n; words distinct) one edit apart, in both directions."""
    spark = vocabulary.sparkSession
    vocabulary = vocabulary.withColumn("size", F.char_length("word").cast("long"))
    sizes = {r["size"]: r["count"] for r in vocabulary.groupBy("size").count().collect()}
    parts = {size: -(-n // shard_words) for size, n in sizes.items()}
    table = stored(filter_table(vocabulary.select("word"), sizes, shard_words), "variant-filters")
    letters = letters_of(vocabulary.select("word"))
    rounds, full = [[]], 0
    for size in sorted(sizes):
        cost = 64 * _blocks_for(min(sizes[size], shard_words))
        for part in range(parts[size]):
            if full + cost > round_bytes and rounds[-1]:
                rounds.append([])
                full = 0
            rounds[-1].append((size, part))
            full += cost
    found = []
    for shards in rounds:
        of = defaultdict(list)
        for size, part in shards:
            of[size].append(part)
        if not of:
            continue
        wanted = reduce(lambda x, y: x | y, [(F.col("size") == size) & F.col("part").between(min(p), max(p)) for size, p in of.items()])
        filters = Filters([r.asDict() for r in table.where(wanted).collect()], parts, letters)
        found.append(_positives(vocabulary.where(F.col("size").isin(sorted({*of, *(s + 1 for s in of)}))), filters))
    if not found:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    edits = reduce(DataFrame.unionByName, found)
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pairs = edits.join(known.hint("merge"), "edit")
    both = F.array(*[F.struct(F.col(a).alias("word"), F.col(b).alias("n"), F.col(c).alias("near"), F.col(d).alias("near_n"))
                     for a, b, c, d in (("word", "n", "edit", "edit_n"), ("edit", "edit_n", "word", "n"))])
    return pairs.select(F.explode(both).alias("x")).select("x.*")


def spelling_groups(vocabulary: DataFrame, ratio: int = 10, **limits: int) -> DataFrame:
    """Per word of ``vocabulary`` (word, n; words distinct and not null): word, form, root, n, n_near, form_n.

    Near words are one inserted, deleted or replaced code point apart. A word's form is its near word of largest n, ties going to the first in code-point order, if
    that n is ``ratio`` times its own; its root is where the forms end, the word itself if it has none. Extra columns are ignored; an empty table gives an empty result.
    """
    words = settled(vocabulary.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    best = F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form")))
    links = near_words(words, **limits).groupBy("word").agg(F.count("*").alias("n_near"), F.min(best).alias("best"))
    links = settled(links.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n")), "variant-links")
    roots = settled(links.where("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    most = words.agg(F.max("n")).first()[0] or 1
    steps, reach = 1, ratio  # a chain of forms has at least ratio ** steps occurrences at its end
    while reach <= most:
        steps, reach = steps + 1, reach * ratio
    done = 1
    while done < steps:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = settled(roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
        done *= 2
    out = words.join(links.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
