"""Phrases whose words keep together: one window per word, counted once, and summed to its shorter prefixes by ROLLUP.

Each word of a text leads one window: itself and the words behind it, at most ``longest``, padded with null at the end of its
piece. Only these top-order windows are counted. The counts of all shorter phrases are marginal sums of them: a phrase occurs
as often as it is the prefix of a window, so no other n-grams are ever made.

A phrase that is frequent enough consists of pairs that are. A first pass therefore counts the pairs by hash, and windows are padded
from a pair on that is too rare: this changes no count of at least ``least``, and most windows of rare words become equal. What the
tasks get of that pass is a bit filter of bounded size, whose false positives only leave some windows longer than they need be.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import LOWER, U64, bit_filter, map_slices, may_hold, mix, run_hashes, settled, signed, streams, text_arrays
from galewise.operators.topk import top_per_group

ENDS = np.zeros(256, dtype=bool)  # bytes that end a piece
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
IN_WORD = ~ENDS
IN_WORD[[0x20, 0x09]] = False
MOST_BITS = 1 << 28  # size of the filter of frequent pairs: 32 MB
NO_LANG = "und"
SCALE = 2_000_000


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of texts with A-Z lowered, each one's text, and whether the next word follows in the same piece."""
    mask = IN_WORD[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(mask & (cut[:-1] | ~np.concatenate(([False], mask[:-1]))))
    ends = np.flatnonzero(mask & (cut[1:] | ~np.concatenate((mask[1:], [False])))) + 1
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    letters = pa.py_buffer(LOWER[data[mask]])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), letters]).dictionary_encode()
    owner = np.searchsorted(offsets, starts, side="right") - 1
    ended = np.cumsum(ENDS[data])
    follows = np.zeros(len(starts), dtype=bool)
    if len(starts):
        follows[:-1] = (owner[1:] == owner[:-1]) & (ended[starts[1:]] == ended[ends[:-1] - 1])
    return words, owner, follows


def _hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    data, offsets = text_arrays(values)
    return run_hashes(data, offsets[:-1], offsets[1:])


def _pairs(words: pa.DictionaryArray, lang: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash of each word but the last, the next one and the language."""
    m = streams(3, 41) | U64(1)
    own = _hashes(words.dictionary)[words.indices.to_numpy()]
    return mix(own[:-1] * m[0] + own[1:] * m[1] + lang[owner[:-1]] * m[2])


def _langs(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The distinct languages of a batch and each text's number among them."""
    lang = part.column("lang").cast(pa.large_string()).dictionary_encode()
    return lang.dictionary, lang.indices.to_numpy()


def frequent_pairs(texts: DataFrame, least: int) -> np.ndarray:
    """A bit filter that holds every pair of words that stand together ``least`` times or more in a language."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        words, owner, follows = words_in(*text_arrays(part.column("text")))
        names, lang = _langs(part)
        pairs, n = np.unique(_pairs(words, _hashes(names)[lang], owner)[follows[:-1]], return_counts=True)
        return pa.RecordBatch.from_arrays([signed(pairs), pa.array(n)], names=["pair", "n"])

    found = map_slices(texts, "text", "pair long, n long", count).groupBy("pair").agg(F.sum("n").alias("n"))
    found = settled(found.where(F.col("n") >= least).select("pair"), "phrase-pairs")
    return bit_filter(found, MOST_BITS)


def windows(texts: DataFrame, held: np.ndarray, longest: int) -> DataFrame:
    """lang, w1 … and n: the windows of each task's slices, counted there; null pads a piece's end and all from a rare pair on."""
    names = [f"w{k + 1}" for k in range(longest)]
    filter_ = texts.sparkSession.sparkContext.broadcast(held)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        words, owner, follows = words_in(*text_arrays(part.column("text")))
        if not len(words):
            return None
        langs, lang = _langs(part)
        follows[:-1] &= may_hold(filter_.value, _pairs(words, _hashes(langs)[lang], owner))
        code = words.indices.to_numpy().astype(np.int64)
        wide, n = len(words.dictionary) + 1, len(code)
        # number the distinct windows column by column; 0 stands for padding
        key, open_ = lang[owner].astype(np.int64) * wide + code + 1, np.ones(n, dtype=bool)
        for k in range(1, longest):
            open_[: n - k + 1] &= follows[k - 1 :]
            open_[n - k :] = False
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: n - k] = np.where(open_[: n - k], code[k:] + 1, 0)
            key = np.unique(key, return_inverse=True)[1] * wide + nxt
        _, first, total = np.unique(key, return_index=True, return_counts=True)
        columns, inside = [langs.take(pa.array(lang[owner[first]]))], np.ones(len(first), dtype=bool)
        for k in range(longest):
            at = np.minimum(first + k, n - 1)
            columns.append(words.dictionary.take(pa.array(code[at], mask=~inside)))
            inside &= follows[at]
        columns = [c.cast(pa.string()) for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(total)], names=["lang", *names, "n"])

    return map_slices(texts, "text", "lang string, " + "".join(f"{c} string, " for c in names) + "n long", count)


def phrase_counts(texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n) of all words."""
    names = [f"w{k + 1}" for k in range(longest)]
    full = windows(texts, frequent_pairs(texts, least), longest).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    full = settled(full, "phrase-windows")
    shorter = full.rollup("lang", *names[:-1]).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    shorter = settled(shorter.where((F.col("f") >= least) | F.col(names[0]).isNull()), "phrase-prefixes")

    def sized(rows: DataFrame, size: int, f: str) -> DataFrame:
        return rows.where(F.col(names[size - 1]).isNotNull() & (F.col(f) >= least)).select(
            "lang", F.concat_ws(" ", *names[:size]).alias("phrase"), F.lit(size).alias("size"), F.col(f).alias("f")
        )

    made = [sized(shorter.where(F.col("rolled") == (1 << (longest - 1 - k)) - 1), k, "f") for k in range(1, longest)]
    counts = reduce(DataFrame.unionByName, [*made, sized(full, longest, "n")])
    totals = shorter.where(F.col("rolled") == (1 << (longest - 1)) - 1).select("lang", F.col("f").alias("n"))
    return settled(counts, "phrase-counts"), totals


def _wide(value) -> F.Column:
    return F.col(value).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, inside: tuple[int, int] = (80, 100), top: int = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language by score, a and phrase.

    A-Z are lowered, texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``. A phrase of 2 to ``longest`` words counts with
    ``a >= least`` occurrences. It is cut in two where floor(2000000 * a / (l + r)) is lowest, then first, l and r being the occurrences of the parts; n counts
    all words of the language. A phrase inside a longer one with ``inside[1] * f(longer) >= inside[0] * a`` is dropped. All is exact, in decimals beyond 64 bits.

    A null language is ``und``; null and empty texts have no words. Repeated rows count each. Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    counts, totals = phrase_counts(texts, longest, least)
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("own"))
    found = counts.where("size > 1").withColumnRenamed("f", "a")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    for side, words in (("l", F.expr("substring_index(phrase, ' ', cut)")), ("r", F.expr("substring_index(phrase, ' ', cut - size)"))):
        cuts = cuts.withColumn("part", words).join(parts.hint("merge"), ["lang", "part"]).drop("part").withColumnRenamed("own", side)
    # l + r is at least 2 a, so the quotient of the decimals is at most half of SCALE
    score = F.expr(f"cast({SCALE} * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    best = F.min(F.struct(score.alias("score"), "cut", "a", "l", "r")).alias("best")
    scored = cuts.groupBy("lang", "phrase").agg(best).select("lang", "phrase", "best.score", "best.a", "best.l", "best.r")

    words = F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), F.col("size") - 1)
    inner = F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda at: F.concat_ws(" ", F.slice(words, at, k))))
    longer = found.where("size > 2").select("lang", F.explode(F.flatten(inner)).alias("phrase"), "a")
    longer = settled(longer.groupBy("lang", "phrase").agg(F.max("a").alias("most")), "phrase-longer")
    kept = settled(scored, "phrase-scored").join(longer.hint("merge"), ["lang", "phrase"], "left")
    kept = kept.where(F.col("most").isNull() | (inside[1] * _wide("most") < inside[0] * _wide("a"))).drop("most")

    ranked = top_per_group(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase", "rank")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
