"""Toxic passages: maximal-scoring segments of signed token log-odds, judged by fitted extreme-value statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import IS_WORD, U64, map_slices, mix, rows_of, settled, signed, slices, stored, text_arrays, words_of
from galewise.llm.ngram import _fs, mapped, shard_of, write_arrays
from galewise.session import scratch_path

STEMS = (4, 7)  # bytes; a token also counts under its beginnings, which inflected forms share
HELD = 1 << 21  # counts a task holds before it passes them on
SHARD = 1 << 18  # tokens with evidence behind one shard of the model
PRIOR = 0.1  # weight of the Dirichlet prior, as a share of all counts
SURE = 2.5  # standard deviations by which log-odds of either sign are brought nearer to 0
DRIFT = 0.3  # what every token costs besides
FOLDS = 5  # of the training texts; each is judged without its own
FINE = 0.05  # width of the bins in which token scores are counted
TAIL = 2.0  # segment score from which on the law of extreme values holds; below it clean texts are counted
BINS = 40
TOKEN = IS_WORD & np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def _tokens(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of tokens and of their beginnings (values of other kinds), and each text's first token."""
    words, bounds, *begun = words_of(*text_arrays(column), table=TOKEN, stems=STEMS)
    return [words, *(mix(x + U64(7 + i)) for i, x in enumerate(begun))], bounds


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(token, counts) with each token once, in order; counts has a column for each fold and label."""
    tokens, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
    return tokens[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _named(counts: np.ndarray) -> list[pa.Array]:
    return [pa.array(counts[:, i].astype(np.int32)) for i in range(2 * FOLDS)]


COUNTS = [f"{kind}_{fold}" for fold in range(FOLDS) for kind in ("clean", "toxic")]


def _counts(train: DataFrame) -> DataFrame:
    """(token, clean_0, toxic_0, …): in how many texts of each fold and kind every token occurs, by its 64-bit hash.

    A task sums its texts' counts first and passes them on whenever it holds HELD of them.
    """

    def count(part: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        kinds, bounds = _tokens(part.column("text"))
        place = 2 * part.column("fold").to_numpy().astype(np.int64) + part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(part.num_rows), np.diff(bounds))
        made = []
        for values in kinds:
            order = np.lexsort((text, values))
            values, who = values[order], text[order]
            if len(values):
                once = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (who[1:] != who[:-1]))))
                ones = np.zeros((len(once), 2 * FOLDS), dtype=np.int32)
                ones[np.arange(len(once)), place[who[once]]] = 1
                made.append(_summed([(values[once], ones)]))
        return made

    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tokens, counts = _summed(parts)
        return pa.RecordBatch.from_arrays([signed(tokens), *_named(counts)], names=["token", *COUNTS])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                held += count(part)
                if sum(len(x[0]) for x in held) > HELD:
                    held = [_summed(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(held)
                        held = []
        if held:
            yield rows(held)

    made = train.mapInArrow(run, "token long, " + ", ".join(f"{c} int" for c in COUNTS))
    return made.groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS])


def log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of tokens under a Dirichlet prior in proportion to all counts, and their standard deviations."""
    prior = PRIOR * (toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.log((all_clean + PRIOR * (all_toxic + all_clean)) / (all_toxic + PRIOR * (all_toxic + all_clean)))
        delta = np.log((toxic + prior) / (clean + prior)) + scale
        spread = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    met = toxic + clean > 0
    return np.where(met, delta, 0.0), np.where(met, spread, np.inf)


def token_scores(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The score of each token (row) in the model of all folds and, behind it, in those without one fold each.

    A score is the log-odds brought nearer to 0 by SURE standard deviations, so of either sign, and 0 where chance explains them.
    """
    out = []
    for without in [None, *range(FOLDS)]:
        use = [f for f in range(FOLDS) if f != without]
        clean, toxic = counts[:, [2 * f for f in use]].sum(axis=1), counts[:, [2 * f + 1 for f in use]].sum(axis=1)
        every = totals[[2 * f for f in use]].sum(), totals[[2 * f + 1 for f in use]].sum()
        delta, spread = log_odds(toxic.astype(float), clean.astype(float), float(every[1]), float(every[0]))
        known = every[0] > 0 and every[1] > 0
        out.append(np.sign(delta) * np.maximum(np.abs(delta) - SURE * np.where(np.isfinite(spread), spread, 1e9), 0) if known else np.zeros(len(counts)))
    return np.stack(out, axis=1)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a text's token scores.

    Linear time: a stack of disjoint candidates with the running sums before and behind them, merged while a later one
    ends higher than an earlier one whose left sum is lower. Only tokens with a gain begin or end a segment; what lies between them is in the running sums.
    """
    stack: list[tuple[int, int, float, float]] = []
    upto = np.concatenate(([0.0], np.cumsum(scores)))
    gains = np.flatnonzero(scores > 0)
    for place, before, behind in zip(gains.tolist(), upto[gains].tolist(), upto[gains + 1].tolist()):
        new = (place, place, before, behind)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right in stack]


@dataclass
class ToxicModel:
    """Where the scores of the tokens lie, the fitted law of chance and the steps from a text's evidence to a probability."""

    root: str
    shards: list[dict]  # by range of the hash: tokens in order, and their scores in the model of all folds and in those without one
    decay: float
    tail: np.ndarray  # for each multiple of FINE up to TAIL how many segments of that score or more a clean token has
    edges: np.ndarray
    levels: np.ndarray

    def scores(self, values: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The score of each token in the model of its ``column``; 0 for those not counted."""
        distinct, back = np.unique(values, return_inverse=True)
        out = np.zeros((len(distinct), FOLDS + 1))
        cut = np.searchsorted(shard_of(distinct, max(len(self.shards), 1)), np.arange(len(self.shards) + 1))
        for s, entry in enumerate(self.shards):
            lo, hi = cut[s], cut[s + 1]
            if hi > lo and entry:
                arrays = mapped(self.root, entry)
                tokens, own = arrays["tokens"], arrays["scores"].reshape(-1, FOLDS + 1)
                at = np.minimum(np.searchsorted(tokens, distinct[lo:hi]), len(tokens) - 1)
                out[lo:hi] = np.where((tokens[at] == distinct[lo:hi])[:, None], own[at], 0)
        return out[back, column]

    def walk(self, part: pa.RecordBatch, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Every token's score less DRIFT, each text's first token, and each text's segments. ``column`` names each text's model.

        A token has the score of its whole word or that of a beginning: the highest of them if one is a gain, else the lowest.
        """
        kinds, bounds = _tokens(part.column("text"))
        own = np.repeat(column, np.diff(bounds))
        found = [self.scores(values, own) for values in kinds]
        high = np.maximum.reduce(found)
        score = np.where(high > 0, high, np.minimum.reduce(found)) - DRIFT
        some = np.concatenate(([0], np.cumsum(score > 0)))
        has = some[bounds[1:]] > some[bounds[:-1]]
        return score, bounds, [segments(score[bounds[i] : bounds[i + 1]]) if has[i] else [] for i in range(part.num_rows)]

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """How many segments of that score or more a token of a clean text has: as counted, and from the last score counted on by the fitted decay."""
        if not len(self.tail):
            return np.ones(len(scores))
        last = len(self.tail) - 1
        at = np.minimum((scores / FINE + 1e-9).astype(np.int64), last)
        return self.tail[at] * np.exp(-self.decay * np.maximum(scores - last * FINE, 0))

    def evidence(self, part: pa.RecordBatch, column: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Per text the largest -log P over its r best segments, P being the chance that a clean text of its length has r segments as high as the r-th."""
        _, bounds, spans = self.walk(part, column)
        total = np.zeros(part.num_rows)
        for i, found in enumerate(spans):
            if found:
                scores = np.sort([x for *_, x in found])[::-1]
                total[i] = poisson_tails(self.expected(scores) * (bounds[i + 1] - bounds[i])).max(initial=0)
        return total, spans

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return np.interp(evidence, self.edges, self.levels) if len(self.edges) else np.full(len(evidence), 0.0)


def poisson_tails(means: np.ndarray) -> np.ndarray:
    """-log of the chance of r events or more, r = 1, 2, …, where the r-th of ``means`` are expected; 0 where at least r are."""
    r = np.arange(1, len(means) + 1)
    means = np.maximum(means, 1e-300)
    ratio, term, series = np.minimum(means, r), np.ones(len(r)), np.ones(len(r))
    for j in range(1, 60):
        term = term * ratio / (r + j)
        series += term
    logs = -means + r * np.log(means) - np.cumsum(np.log(r)) + np.log(series)
    return np.where(means < r, np.maximum(-logs, 0), 0)


def fitted_decay(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive number at which the mean of exp(decay * score) is 1, or a large one if no score is positive or the mean score isn't negative."""
    total = counts.sum()
    if not total or scores.max(initial=0) <= 0 or (scores * counts).sum() >= 0:
        return 1.0
    mean = lambda t: (counts * np.exp(np.minimum(t * scores, 700))).sum() / total
    low, high = 0.0, 1.0
    while mean(high) < 1:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def _chance(train: DataFrame, model: ToxicModel) -> tuple[float, np.ndarray]:
    """Decay and tail of the segment scores of clean texts, from texts judged without their own fold.

    One pass counts their token scores and their segment scores in bins. As in the log-odds, the Dirichlet prior adds PRIOR of all texts to the clean ones,
    so a gain that no clean text happens to hold is rare but not impossible. The driver gets the bins, whose number doesn't grow with the texts.
    """
    last = round(TAIL / FINE)

    def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
        score, bounds, spans = model.walk(part, part.column("fold").to_numpy().astype(np.int64) + 1)
        toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        made = []
        for label in (0, 1):
            own = np.repeat(toxic, np.diff(bounds)) == label
            tops = np.array([x for found, mark in zip(spans, toxic) if mark == label for _, _, x in found])
            for segment, values in ((False, np.rint(score[own] / FINE)), (True, np.minimum(np.floor(tops / FINE + 1e-9), last))):
                bins, n = np.unique(values.astype(np.int64), return_counts=True)
                made += [(segment, label, int(b), int(c)) for b, c in zip(bins, n)]
        if not made:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["segment", "toxic", "bin", "n"])

    rows = map_slices(train, "text", "segment boolean, toxic long, bin long, n long", work).groupBy("segment", "bin")
    weight = F.sum(F.col("n") * F.when(F.col("toxic") == 0, 1 + PRIOR).otherwise(PRIOR)).alias("n")
    rows = sorted(rows.agg(weight).collect())
    tokens = np.array([(r.bin * FINE, r.n) for r in rows if not r.segment] or [(0.0, 0)], dtype=float)
    tops = np.zeros(last + 1)
    for r in rows:
        if r.segment:
            tops[r.bin] += r.n
    tail = np.cumsum(tops[::-1])[::-1]
    return fitted_decay(tokens[:, 0], tokens[:, 1]), (tail[tail > 0] / max(tokens[:, 1].sum(), 1))


def _shards(counts: DataFrame, root: str, totals: np.ndarray) -> list[dict]:
    """Write the scores of all tokens that have one as sorted arrays, one file per range of the hash."""
    count = max(1, -(-counts.count() // SHARD))
    fs, folder = _fs(root)
    fs.create_dir(folder, recursive=True)

    def write(table: pa.Table) -> pa.Table:
        tokens = table.column("token").to_numpy().view(U64)
        scores = token_scores(np.stack([table.column(c).to_numpy() for c in COUNTS], axis=1), totals)
        keep = np.flatnonzero(scores.any(axis=1))
        keep = keep[np.argsort(tokens[keep])]
        entry = write_arrays(root, "tokens", tokens=tokens[keep], scores=scores[keep].astype(np.float32).ravel()) if len(keep) else {}
        return pa.table({"shard": table.column("shard")[:1], "entry": [json.dumps(entry)]})

    shard = F.shiftrightunsigned(F.shiftrightunsigned("token", 32) * F.lit(count), 32)
    entries = {r.shard: json.loads(r.entry) for r in counts.withColumn("shard", shard).groupBy("shard").applyInArrow(write, "shard long, entry string").collect()}
    return [entries.get(s, {}) for s in range(count)]


def train_toxicity(train: DataFrame) -> ToxicModel:
    """Learn from (text, toxic, fold); every row and every token counts. The driver sees totals, the names of the model's files and some bins.

    Law and probabilities are fitted on texts judged by the counts of the other folds, the final scores come from all.
    """
    counts = settled(_counts(train), "counts")
    totals = np.array([x or 0 for x in counts.agg(*[F.sum(c) for c in COUNTS]).first()], dtype=float)
    root = scratch_path(train.sparkSession, "llm-toxicity")
    if not totals[0::2].sum() or not totals[1::2].sum():
        return ToxicModel(root, [], 1.0, np.empty(0), np.empty(0), np.empty(0))
    model = ToxicModel(root, _shards(counts, root, totals), 1.0, np.empty(0), np.empty(0), np.empty(0))
    model.decay, model.tail = _chance(train, model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        total, _ = model.evidence(part, part.column("fold").to_numpy().astype(np.int64) + 1)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum((total * 4).astype(np.int64), BINS - 1)), part.column("toxic").cast(pa.int64())], names=["bin", "toxic"])

    bins = map_slices(train, "text", "bin long, toxic long", work).groupBy("bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    rows = sorted(bins.collect())
    # pool neighbours until the share of toxic texts rises with the evidence
    pools: list[list[float]] = []
    for b, n, t in rows:
        pools.append([b * n, n, t])
        while len(pools) > 1 and pools[-1][2] * pools[-2][1] <= pools[-2][2] * pools[-1][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    model.edges = np.array([(p[0] / p[1] + 0.5) / 4 for p in pools])
    model.levels = np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools])
    if len(pools):
        model.edges[0] = min(model.edges[0], 0.25)
    return model


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fold) for the rows with a label, equal texts once, with the label of the smallest id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    once = docs.where("doc_id is not null and text is not null").select("doc_id", F.md5("text").alias("k")).join(known, "doc_id")
    fold = F.pmod(F.crc32(F.col("k").cast("binary")), F.lit(FOLDS)).alias("fold")
    once = stored(once.groupBy("k").agg(F.min(F.struct("doc_id", "toxic")).alias("m")).select("m.doc_id", "m.toxic", fold), "labelled")
    return rows_of(docs.select("doc_id", "text"), once).select("text", "toxic", "fold")


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, threshold: float = 0.3,
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted and segments (first token, last token, score).

    Learns from labelled rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out``; a score depends on the text alone. A
    null or empty text has no evidence and gets the score of such texts. A null id counts as the empty text when folds are
    dealt and has no label; of repeated labels the largest holds. Repeated rows are scored each. Without toxic or
    without clean labelled rows every score is 0. Extra columns are ignored; an empty table gives an empty result.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (fold == held_out).alias("held_out"))
    train = settled(labelled(rows.where(~F.col("held_out")), labels.select("doc_id", "toxic")), "train")
    model = train_toxicity(train)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        total, spans = model.evidence(part, np.zeros(part.num_rows, dtype=np.int64))
        score = model.probability(total)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        lists = pa.array([[{"first": a, "last": b, "score": x} for a, b, x in own] for own in spans], kind)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), lists],
            names=["doc_id", "held_out", "score", "predicted", "segments"],
        )

    schema = "doc_id long, held_out boolean, score double, predicted int, segments array<struct<first: long, last: long, score: double>>"
    return map_slices(rows, "text", schema, work)
