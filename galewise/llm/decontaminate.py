"""Benchmark passages in training texts: rare seeds, then local alignment of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import U64, map_slices, mix, settled, slices, stored, streams, text_arrays, words_of
from galewise.llm.toxicity import TOKEN

BLOCK_ITEMS = 5000  # benchmark items handled in one pass over the texts
PASSAGE, STRIDE = 200, 100  # words of a passage, and from one to the next of a long item
PAIR, SHORT, LONG = 2, 3, 5  # words of a seed; longer where fewer words are too common
SMALL = 12  # words up to which an item also has seeds of two words and one of its seeds is enough
RARE = 1.0  # most occurrences of a seed expected by chance
MATCH, OTHER, GAP = 2, -1, -1


def _words(texts: list[str | None]) -> list[np.ndarray]:
    words, bounds = words_of(*text_arrays(pa.array(texts, pa.string())), table=TOKEN)
    return [words[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words from each place; the last ones are left out."""
    count = max(len(words) - size + 1, 0)
    out = np.zeros(count, dtype=U64)
    for k, m in enumerate(streams(size, 53 + size) | U64(1)):
        out += words[k : k + count] * m
    return mix(out)


def align(passage: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and where in ``window`` it ends (Smith-Waterman, one row of the table at a time)."""
    best, end, above = 0, 0, np.zeros(len(window) + 1, dtype=np.int64)
    slope = GAP * np.arange(len(window) + 1)
    for word in passage:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(window == word, MATCH, OTHER))
        row = np.maximum.accumulate(row - slope) + slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def _word_counts(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of the sorted words occurs in all texts, and the number of all words."""

    def run(batches):
        total = np.zeros(len(known) + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words, _ = words_of(*text_arrays(part.column("text")), table=TOKEN)
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                total[:-1] += np.bincount(at[known[at] == words], minlength=len(known))
                total[-1] += len(words)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    counts = np.zeros(len(known) + 1, dtype=np.int64)
    for row in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row["at"]] = row["n"]
    return counts[:-1], int(counts[-1])


def _seeds(passages: list[np.ndarray], known: np.ndarray, counts: np.ndarray, total: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each seed length: sorted hashes, the passage and the place in it. A seed is as short as it can be and still rare."""
    out = {}
    logs = np.log((counts + 0.5) / max(total, 1))
    taken = [np.zeros(len(p), dtype=bool) for p in passages]
    for size in (PAIR, SHORT, LONG):
        rows = []
        for i, words in enumerate(passages):
            grams = _grams(words, size)
            if len(grams) and (size > PAIR or len(words) <= SMALL):
                own = np.concatenate(([0], np.cumsum(logs[np.searchsorted(known, words)])))
                rare = own[size:] - own[:-size] + np.log(max(total, 1)) < np.log(RARE)
                use = np.flatnonzero((rare | (size == LONG)) & ~taken[i][: len(grams)])
                taken[i][use] = True
                rows.append((grams[use], np.full(len(use), i), use))
        if rows:
            grams, who, place = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(grams, kind="stable")
            out[size] = grams[order], who[order], place[order]
    return out


def _passes(docs: DataFrame, items: list[tuple[int, str]], least: float) -> DataFrame:
    ids, passages = [], []
    for (item, _), words in zip(items, _words([t for _, t in items])):
        for at in range(0, max(len(words) - STRIDE, 1), STRIDE):
            if len(words[at : at + PASSAGE]):
                ids.append(item)
                passages.append(words[at : at + PASSAGE])
    known = np.unique(np.concatenate([*passages, np.zeros(1, U64)]))
    seeds = _seeds(passages, known, *_word_counts(docs, known))
    sizes = np.array([len(p) for p in passages] or [0])
    seeded = np.zeros(len(sizes), dtype=np.int64)
    for _, who, _ in seeds.values():
        seeded += np.bincount(who, minlength=len(sizes))

    def hits(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the text, passage and place in it of every seed met."""
        found = []
        for size, (grams, who, place) in seeds.items():
            own = _grams(words, size)
            lo = np.searchsorted(grams, own)
            met = np.flatnonzero(grams[np.minimum(lo, len(grams) - 1)] == own) if len(grams) else []
            if len(met):
                lo, hi = lo[met], np.searchsorted(grams, own[met], side="right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append((np.repeat(met, n), who[at], place[at]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3

    def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
        words, bounds = words_of(*text_arrays(part.column("text")), table=TOKEN)
        where, who, place = hits(words)
        if not len(where):
            return None
        text = np.searchsorted(bounds, where, side="right") - 1
        start = where - place
        order = np.lexsort((start, who, text))
        text, who, start, where, place = text[order], who[order], start[order], where[order], place[order]
        # seeds of one passage whose places agree but for half its length belong together
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (who[1:] != who[:-1]) | (start[1:] - start[:-1] > sizes[who[1:]] // 2 + 8)
        first = np.flatnonzero(new)
        made = []
        for lo, hi in zip(first, [*first[1:], len(text)]):
            i, passage = int(text[lo]), int(who[lo])
            if sizes[passage] > SMALL and len(np.unique(place[lo:hi])) < min(2, seeded[passage]):
                continue
            pad = int(sizes[passage]) // 2 + 8
            left = max(int(bounds[i]), int(start[lo]) - pad)
            right = min(int(bounds[i + 1]), int(where[lo:hi].max()) + int(sizes[passage]) + pad)
            step = 4 * PASSAGE  # a repetitive text may hold many seeds in a row
            for at in range(left, max(right - 2 * PASSAGE, left + 1), step):
                score, end = align(passages[passage], words[at : min(at + step + 2 * PASSAGE, right)])
                score = score / (MATCH * int(sizes[passage]))
                if score >= least:
                    made.append((i, ids[passage], score, at + end - int(bounds[i])))
        if not made:
            return None
        rows, item, score, end = zip(*made)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(rows)), pa.array(item, pa.int64()), pa.array(score), pa.array(end, pa.int64())],
            names=["doc_id", "item_id", "score", "ends_at"],
        )

    return map_slices(docs, "text", "doc_id long, item_id long, score double, ends_at long", work)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    least: float = 0.5, block: int = BLOCK_ITEMS,
) -> DataFrame:
    """(doc_id, item_id, score, ends_at) of the texts that hold a benchmark item, copied or edited.

    Words are runs of letters and digits with A-Z lowered. Seeds are the item's runs of three words that chance would give less
    than once in all texts, else of five. Two seeds that agree on where the item begins call for an alignment, whose score is the share
    of what an exact copy would get; from ``least`` on the text counts. Items of up to SMALL words have seeds of two words too, and one calls for it. Items longer than 200 words are aligned in overlapping
    passages. ``block`` items are taken at a time, so what is sent to the tasks is bounded; each block reads the texts again.

    Null and empty texts and items match nothing. A null item id takes no part; a row without a doc_id is reported with null. An item of under
    two words has no seed. Repeated rows are reported once per id; repeated items count once each id. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    blocks = max(1, -(-items.count() // block))
    items = stored(items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "items")
    out = None
    for part in range(blocks):
        own = [tuple(r) for r in items.where(F.col("part") == part).select("item", "text").orderBy("item", "text").collect()]
        found = _passes(rows, own, least)
        out = found if out is None else settled(out.unionByName(found), "found")
    best = F.max(F.struct("score", "ends_at")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.score", "m.ends_at")
