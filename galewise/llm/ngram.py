"""Interpolated modified Kneser-Ney model: counted in Spark, stored as sorted arrays, mapped by the workers.

The model has word pairs and single words; the files are laid out so that no task and no worker holds a table
whole. Words are sorted by hash, a word's place is its number, and the pairs of a word lie together, sorted by
the second word's number. Counts travel as sorted blocks, one per task batch and shard, merged once per shard.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import U64, map_slices, slices, stored, text_arrays, words_of
from galewise.session import scratch_path

END = U64(0x6A09E667F3BCC909)  # the token that closes a text
SHARD_BYTES = 16 << 20  # bytes of text behind one shard of the counts
LEAST_SHARDS = 16
HALF, LOW = U64(32), U64(0xFFFFFFFF)
UNKNOWN = 0xFFFFFFFF  # number of an unknown word as the first of a pair

_OPEN: dict[str, np.ndarray] = {}


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_arrays(root: str, name: str, **arrays: np.ndarray) -> dict:
    """Write arrays behind each other into a new file; a task that is run again writes another one."""
    fs, folder = _fs(root)
    path, layout, at = f"{name}-{uuid.uuid4().hex}.bin", {}, 0
    with fs.open_output_stream(f"{folder}/{path}") as out:
        for key, values in arrays.items():
            data = np.ascontiguousarray(values)
            out.write(data.tobytes() + b"\0" * (-data.nbytes % 8))
            layout[key] = [str(data.dtype), at, len(data)]
            at += data.nbytes + -data.nbytes % 8
    return {"file": path, "layout": layout}


def mapped(root: str, entry: dict) -> dict[str, np.ndarray]:
    """Memory maps of the arrays of one file; a file of a remote store is fetched once per worker first."""
    where = f"{root}/{entry['file']}"
    if where not in _OPEN:
        fs, path = _fs(where)
        if isinstance(fs, pafs.LocalFileSystem):
            _OPEN[where] = np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.empty(0, np.uint8)
        else:
            with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(path) as data:
                while block := data.read(8 << 20):
                    copy.write(block)
                copy.flush()
                _OPEN[where] = np.memmap(copy.name, dtype=np.uint8, mode="r") if copy.tell() else np.empty(0, np.uint8)
    raw = _OPEN[where]
    return {k: raw[at : at + np.dtype(kind).itemsize * n].view(kind) for k, (kind, at, n) in entry["layout"].items()}


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _blocks(shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per shard with the parts of the columns; ``shard`` doesn't fall.

    The first column rises within a shard and travels as steps, which compress well.
    """
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    ends = np.concatenate((first[1:], [len(shard)]))
    steps = columns[0].copy()
    steps[1:] -= columns[0][:-1]
    steps[first] = columns[0][first]
    arrays = [pa.array(shard[first].astype(np.int64))]
    for values in (steps, *columns[1:]):
        arrays.append(pa.array([values[lo:hi].tobytes() for lo, hi in zip(first, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["shard", *"xyz"[: len(columns)]])


def _rising(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The first column of :func:`_blocks` again."""
    return np.concatenate([np.cumsum(np.frombuffer(x, kind), dtype=kind) for x in column.to_pylist()] or [np.empty(0, kind)])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()] or [np.empty(0, kind)])


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Which of ``shards`` equal ranges of 64-bit values a hash is in."""
    return ((hashes >> HALF) * U64(shards)) >> HALF


def with_ends(words: np.ndarray, bounds: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The token rows of texts: their words and one end each."""
    texts = len(bounds) - 1
    out = np.empty(len(words) + texts, dtype=words.dtype)
    own = np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(bounds))
    out[own] = words
    at = bounds + np.arange(texts + 1)
    out[at[1:] - 1] = end
    return out, at


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many entries have a count of 1, 2, 3 and 4; 0 stands for too few entries."""
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    made = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(made, 1))


@dataclass
class Model:
    """Where the arrays lie and the few totals that scoring needs."""

    root: str
    tokens: int = 0
    types: int = 0
    words: list[dict] = field(default_factory=list)  # by shard of the hash: h, c
    starts: list[int] = field(default_factory=list)  # number of each shard's first word
    pairs: dict[int, dict] = field(default_factory=dict)  # by shard of the first word: lo, at, v, c, sums
    hot: dict[int, tuple[int, int]] = field(default_factory=dict)  # frequent first words: first shard, shards
    hot_sums: dict[int, list[int]] = field(default_factory=dict)
    follows: list[dict] = field(default_factory=list)  # by shard of the second word: number of first words
    d1: tuple[float, float, float] = (0.5, 0.5, 0.5)
    d2: tuple[float, float, float] = (0.5, 0.5, 0.5)
    kinds: int = 0
    gamma: float = 1.0

    @property
    def bos(self) -> int:
        return self.types

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted hashes; unknown ones get number types + 1 and count 0."""
        ids, counts = np.full(len(hashes), self.types + 1, dtype=np.int64), np.zeros(len(hashes), np.int64)
        shard = shard_of(hashes, len(self.words))
        cut = np.searchsorted(shard, np.arange(len(self.words) + 1))
        for s in range(len(self.words)):
            lo, hi = cut[s], cut[s + 1]
            if hi > lo and self.words[s]:
                arrays = mapped(self.root, self.words[s])
                at = np.searchsorted(arrays["h"], hashes[lo:hi])
                inside = np.minimum(at, len(arrays["h"]) - 1)
                known = arrays["h"][inside] == hashes[lo:hi]
                ids[lo:hi][known] = at[known] + self.starts[s]
                counts[lo:hi][known] = arrays["c"][inside[known]]
        return ids, counts

    def places(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The shard of each pair of word numbers."""
        shards = len(self.words)
        place = u * shards // (self.types + 1)
        if self.hot:
            frequent = np.array(sorted(self.hot))
            at = np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)
            own = np.flatnonzero(frequent[at] == u)
            first, count = np.array([self.hot[w] for w in frequent.tolist()]).T
            place[own] = first[at[own]] + v[own] * count[at[own]] // (self.types + 1)
        return place

    def _lower(self, v: np.ndarray) -> np.ndarray:
        """Probability of each word number behind an unknown word."""
        kinds = np.zeros(len(v))
        place = np.minimum(v * len(self.follows) // (self.types + 1), len(self.follows) - 1)
        for s in np.unique(place[v < self.types]):
            entry = self.follows[s]
            own = np.flatnonzero((place == s) & (v < self.types))
            if entry:
                kinds[own] = mapped(self.root, entry)["n"][v[own] - entry["lo"]]
        cut = np.array([0.0, *self.d1])[np.minimum(kinds, 3).astype(int)]
        return (kinds - cut) / max(self.kinds, 1) + self.gamma / (self.types + 1)

    def probabilities(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """P(v | u) of word numbers; the pairs are distinct and sorted by (u, v)."""
        seen, totals, backs = np.zeros(len(u)), np.zeros(len(u)), np.ones(len(u))
        ok = np.flatnonzero(u <= self.types)
        place = self.places(u[ok], v[ok])
        order = np.argsort(place, kind="stable")
        ok, place = ok[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else []
        for lo, hi in zip(first, [*first[1:], len(place)]):
            entry = self.pairs.get(int(place[lo]))
            if not entry:
                continue
            own, arrays = ok[lo:hi], mapped(self.root, entry)
            row = u[own] - entry["lo"]
            inside = np.flatnonzero((row >= 0) & (row < len(arrays["at"]) - 1))
            own, row = own[inside], row[inside]
            low, high = arrays["at"][row].astype(np.int64), arrays["at"][row + 1].astype(np.int64)
            end, want = high.copy(), v[own]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                less = arrays["v"][mid] < want[open_]
                low[open_[less]], high[open_[~less]] = mid[less] + 1, mid[~less]
            hit = np.flatnonzero(low < end)
            hit = hit[arrays["v"][low[hit]] == want[hit]]
            seen[own[hit]] = arrays["c"][low[hit]]
            sums = arrays["sums"].reshape(-1, 4)[row]
            totals[own] = sums[:, 0]
            backs[own] = sums[:, 1:] @ np.array(self.d2)
        for word, (total, *n) in self.hot_sums.items():
            lo, hi = np.searchsorted(u, [word, word + 1])
            totals[lo:hi], backs[lo:hi] = total, np.dot(n, self.d2)
        cut = np.array([0.0, *self.d2])[np.minimum(seen, 3).astype(int)]
        lower = self._lower(v)
        known = totals > 0
        safe = np.where(known, totals, 1)
        return np.where(known, (seen - cut) / safe + backs / safe * lower, lower)


def token_ids(model: Model, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of all tokens."""
    distinct, back = np.unique(tokens, return_inverse=True)
    ids, counts = model.ids(distinct)
    return ids[back], counts[back]


def build_model(train: DataFrame, text_col: str = "text") -> Model:
    """Count the texts of ``train`` and store the model in the shared folder.

    The number of shards follows the bytes of text. A word that begins more than one shard's share of all pairs is
    dealt over shards of its own. Words may number up to 2^32. The driver sees the files' names and totals, never the counts.
    """
    spark = train.sparkSession
    texts = train.select(F.col(text_col).alias("text"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-volume // SHARD_BYTES))
    model = Model(scratch_path(spark, "llm-ngrams"))
    fs, folder = _fs(model.root)
    fs.create_dir(folder, recursive=True)
    _count_words(texts, model, shards)
    _count_pairs(texts, model)
    return model


def _count_words(texts: DataFrame, model: Model, shards: int) -> None:
    root = model.root

    def blocks(batches):
        for batch in batches:
            found, count = [], 0
            for part in slices(batch, "text"):
                found.append(words_of(*text_arrays(part.column("text")))[0])
                count += part.num_rows
            if count:
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                hashes, counts = summed(np.append(hashes, END), np.append(counts, count))
                yield _blocks(shard_of(hashes, shards).astype(np.int64), hashes, counts.astype(np.uint32))

    def merge(table: pa.Table) -> pa.Table:
        hashes, counts = summed(_rising(table.column("x"), U64), _joined(table.column("y"), np.uint32).astype(np.int64))
        entry = write_arrays(root, "words", h=hashes, c=counts)
        total = int(counts.sum())
        big = np.flatnonzero(counts * 256 >= total)
        lists = pa.list_(pa.int64())
        return pa.table({
            "shard": table.column("shard")[:1], "entry": [json.dumps(entry)], "n": [len(hashes)], "total": [total],
            "big": pa.array([big.tolist()], lists), "big_count": pa.array([counts[big].tolist()], lists),
        })

    made = texts.mapInArrow(blocks, "shard long, x binary, y binary").groupBy("shard")
    made = made.applyInArrow(merge, "shard long, entry string, n long, total long, big array<long>, big_count array<long>").collect()
    by_shard, counts = {r.shard: r for r in made}, {}
    for s in range(shards):
        row = by_shard.get(s)
        model.starts.append(model.types)
        model.words.append(json.loads(row.entry) if row else {})
        if row:
            counts.update({model.types + i: c for i, c in zip(row.big, row.big_count)})
            model.types += row.n
            model.tokens += row.total
    counts[model.bos] = texts.count()
    at = shards
    for word, count in sorted(counts.items()):
        if count * shards > model.tokens:
            share = -(-count * shards // model.tokens)
            model.hot[word] = (at, share)
            at += share


def _count_pairs(texts: DataFrame, model: Model) -> None:
    root, shards, types = model.root, len(model.words), model.types

    def blocks(batches):
        for batch in batches:
            found = []
            for part in slices(batch, "text"):
                tokens, at = with_ends(*words_of(*text_arrays(part.column("text"))), END)
                ids, _ = token_ids(model, tokens)
                before = np.concatenate(([0], ids[:-1]))
                before[at[:-1]] = model.bos
                found.append((before.astype(U64) << HALF) | ids.astype(U64))
            if found:
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                u, v = (keys >> HALF).astype(np.int64), (keys & LOW).astype(np.int64)
                place = model.places(u, v)
                order = np.argsort(place, kind="stable")
                yield _blocks(place[order], u[order].astype(np.uint32), v[order].astype(np.uint32), counts[order].astype(np.uint32))

    def merge(table: pa.Table) -> pa.Table:
        place = table.column("shard")[0].as_py()
        keys = (_rising(table.column("x"), np.uint32).astype(U64) << HALF) | _joined(table.column("y"), np.uint32)
        keys, counts = summed(keys, _joined(table.column("z"), np.uint32).astype(np.int64))
        u, v = (keys >> HALF).astype(np.int64), (keys & LOW).astype(np.uint32)
        lo, rows = int(u[0]), int(u[-1] - u[0] + 1)
        sums = np.zeros((rows, 4), dtype=np.int64)
        sums[:, 0] = np.bincount(u - lo, weights=counts, minlength=rows)
        for k in (1, 2, 3):
            sums[:, k] = np.bincount((u - lo)[counts == k if k < 3 else counts >= 3], minlength=rows)
        at = np.searchsorted(u, np.arange(lo, lo + rows + 1)).astype(np.uint32)
        entry = write_arrays(root, "pairs", at=at, v=v, c=counts.astype(np.float32), sums=sums.reshape(-1).astype(np.uint32)) | {"lo": lo}
        kinds, n = np.unique(v, return_counts=True)
        out = _blocks(kinds.astype(np.int64) * shards // (types + 1), kinds, n.astype(np.uint32))
        only_first = lambda x: pa.array([x] + [None] * (out.num_rows - 1))
        return pa.table({
            "place": pa.array([place] * out.num_rows), "entry": only_first(json.dumps(entry)),
            "stats": only_first([int((counts == k).sum()) for k in (1, 2, 3, 4)]), "sums": only_first(sums[0].tolist()),
            "shard": out.column("shard"), "x": out.column("x"), "y": out.column("y"),
        })

    def follow(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        v, n = summed(_rising(table.column("x"), np.uint32).astype(np.int64), _joined(table.column("y"), np.uint32).astype(np.int64))
        lo, hi = -(-shard * (types + 1) // shards), -(-(shard + 1) * (types + 1) // shards)
        dense = np.zeros(hi - lo, dtype=np.float32)
        dense[v - lo] = n
        entry = write_arrays(root, "follows", n=dense) | {"lo": lo}
        stats = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n), int(n.sum())]
        return pa.table({"shard": [shard], "entry": [json.dumps(entry)], "stats": [stats]})

    made = texts.mapInArrow(blocks, "shard long, x binary, y binary, z binary").groupBy("shard")
    schema = "place long, entry string, stats array<long>, sums array<long>, shard long, x binary, y binary"
    made = stored(made.applyInArrow(merge, schema), "pairs")
    totals = np.zeros(4, dtype=np.int64)
    owners = {place: word for word, (first, count) in model.hot.items() for place in range(first, first + count)}
    for row in made.where("entry is not null").select("place", "entry", "stats", "sums").collect():
        model.pairs[row.place] = json.loads(row.entry)
        totals += np.array(row.stats)
        if row.place in owners:
            before = model.hot_sums.get(owners[row.place], [0, 0, 0, 0])
            model.hot_sums[owners[row.place]] = [x + y for x, y in zip(before, row.sums)]
    model.d2 = discounts(totals.tolist())
    model.follows = [{}] * shards
    totals = np.zeros(6, dtype=np.int64)
    for row in made.select("shard", "x", "y").groupBy("shard").applyInArrow(follow, "shard long, entry string, stats array<long>").collect():
        model.follows[row.shard] = json.loads(row.entry)
        totals += np.array(row.stats)
    ones, twos, _, _, every, model.kinds = totals.tolist()
    model.d1 = discounts(totals[:4].tolist())
    if model.kinds:
        model.gamma = float(np.dot(model.d1, [ones, twos, every - ones - twos])) / model.kinds


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, ``extra`` columns, n_tokens, n_known, base_score and score (log10 of the text's probability)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        tokens, at = with_ends(*words_of(*text_arrays(part.column(text_col))), END)
        ids, counts = token_ids(model, tokens)
        base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
        before = np.concatenate(([0], ids[:-1]))
        before[at[:-1]] = model.bos
        before[before == model.types + 1] = UNKNOWN
        keys, back = np.unique((before.astype(U64) << HALF) | ids.astype(U64), return_inverse=True)
        logs = np.log10(model.probabilities((keys >> HALF).astype(np.int64), (keys & LOW).astype(np.int64)))[back]
        starts = at[:-1]
        return pa.RecordBatch.from_arrays(
            [part.column(id_col).cast(pa.int64()), *(part.column(c) for c in extra), pa.array(np.diff(at)),
             pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))],
            names=["doc_id", *extra, "n_tokens", "n_known", "base_score", "score"],
        )

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in extra)
    return map_slices(docs.select(id_col, text_col, *extra), text_col, f"doc_id long, {kinds}n_tokens long, n_known long, base_score double, score double", work)
