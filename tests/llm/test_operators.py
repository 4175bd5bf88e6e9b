"""Every operator against a brute-force version, planted cases or held-out rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from llm_fixtures import SF, make_docs  # noqa: F401
from pyspark.sql import functions as F

from galewise.llm.common import words_of
from galewise.llm.components import connected
from galewise.llm import decontaminate, toxicity
from galewise.llm.decontaminate import contaminated
from galewise.llm.line_dedup import dedup_lines
from galewise.llm.lm_scoring import score_language
from galewise.llm.minhash import near_duplicates
from galewise.llm.mixing import MAX_EPOCHS, WEIGHTS, mix, mix_report
from galewise.llm.pii import FEMALE, MALE, MAY_HOLD, find, found_in, laid_out, mentions, replace_pii, surrogate, surrogate_table, units
from galewise.llm.quality import classify_quality, exact_quantiles
from galewise.llm.suffix_dedup import without_repeats
from galewise.llm.topk import exact_topk
from galewise.llm.toxicity import score_toxicity, segments


def sentence(rng, words, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(words))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())


def brute_components(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = text.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(rng, text, share):
    return " ".join(f"x{rng.random():.6f}" if rng.random() < share else w for w in text.split(" "))


def test_near_duplicates_against_brute_force(make_docs):
    rng = random.Random(1)
    texts = []
    for _ in range(25):
        base = sentence(rng, rng.choice([3, 40, 200]), 5000)
        texts += [base] * rng.choice([1, 1, 3]) + [edited(rng, base, rng.choice([0.003, 0.01, 0.02])) for _ in range(rng.choice([0, 2, 6]))]
    # a chain of copies of copies: neighbours are near, the ends are not
    link = sentence(rng, 300, 5000)
    for _ in range(8):
        link = edited(rng, link, 0.008)
        texts.append(link)
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_near_duplicates_of_the_table(documents, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents).collect()}
    assert got == brute_components(texts)


def test_large_bucket_is_compared_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr("galewise.llm.minhash.CHUNK", 8)
    rng = random.Random(5)
    base = sentence(rng, 150, 5000)
    texts = [edited(rng, base, rng.choice([0.008, 0.02])) for _ in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, text in rows:
        b = text.encode()
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                covered[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest())
    return out


def test_suffix_dedup_of_the_table(documents, texts):
    got = {r.doc_id: tuple(r)[1:] for r in without_repeats(documents).collect()}
    assert got == brute_repeats(texts)


def test_suffix_dedup_of_hard_texts(make_docs):
    rng = random.Random(2)
    passage = sentence(rng, 40)
    texts = ["ab" * 200, "a" * 99, "a" * 100, "a" * 101, "a" * 350, passage, passage + passage, "é" * 120]
    for _ in range(40):
        cut = sorted(rng.sample(range(len(passage)), 2))
        texts.append(sentence(rng, 5) + passage[cut[0] : cut[1]] + sentence(rng, 5))
    texts += [edited(rng, passage * 3, 0.05) for _ in range(20)]
    got = {r.doc_id: tuple(r)[1:] for r in without_repeats(make_docs(texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_kept_bytes(make_docs):
    text = sentence(random.Random(4), 40)
    got = {r.doc_id: bytes(r.kept) for r in without_repeats(make_docs([text, "before " + text + " after"]), with_bytes=True).collect()}
    assert got == {0: text.encode(), 1: b"before  after"}


def test_segments_are_the_maximal_ones():
    def brute(scores, at=0):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 1e-9:
            return []
        _, _, i, j = best
        return brute(scores[:i], at) + [(at + i, at + j - 1, best[0])] + brute(scores[j:], at + j)

    rng = random.Random(9)
    for _ in range(80):
        scores = [rng.choice([-0.3, -0.3, -0.3, -1.7, 0.7, 1.9, 3.3]) + rng.random() / 100 for _ in range(30)]
        want, got = brute(scores), segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_toxic_counts_and_log_odds_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"{sentence(rng, 30, 60)} {'vile' if i % 6 == 0 and i % 4 else 'kind'} 語語語", int(i % 6 == 0), i % toxicity.FOLDS) for i in range(150)]
    train = spark.createDataFrame(rows, "text string, toxic int, fold int")
    got = {r.token: r for r in toxicity._counts(train).collect()}
    want = collections.defaultdict(lambda: np.zeros(2 * toxicity.FOLDS))
    for text, toxic, fold in rows:
        for word in set(text.split()):
            want[word][2 * fold + toxic] += 1
    totals = sum(np.array([r[c] for c in toxicity.COUNTS]) for r in got.values()).astype(float)
    for word, counts in want.items():
        token = int(words_of(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0].view(np.int64)[0])
        assert [got[token][c] for c in toxicity.COUNTS] == counts.tolist()
        scores = toxicity.token_scores(counts[None].astype(int), totals)[0]
        for without, score in zip([None, *range(toxicity.FOLDS)], scores):
            use = [f for f in range(toxicity.FOLDS) if f != without]
            clean, bad = (sum(counts[2 * f + k] for f in use) for k in (0, 1))
            every = [sum(totals[2 * f + k] for f in use) for k in (0, 1)]
            if not clean + bad:
                assert score == 0
                continue
            prior = 0.1 * (clean + bad)
            odds = [(n + prior) / (t + 0.1 * sum(every)) for n, t in ((bad, every[1]), (clean, every[0]))]
            delta, sd = math.log(odds[0] / odds[1]), math.sqrt(1 / (bad + prior) + 1 / (clean + prior))
            assert score == pytest.approx(math.copysign(max(abs(delta) - toxicity.SURE * sd, 0), delta))
    vile, kind = (toxicity.token_scores(want[w][None].astype(int), totals)[0] for w in ("vile", "kind"))
    assert vile[0] > 1 and kind[0] <= 0
    # a token of many clean texts alone costs more than others
    often = toxicity.token_scores(np.array([[400, 0] * toxicity.FOLDS]), np.array([10_000.0, 10_000.0] * toxicity.FOLDS))
    assert (often < -1).all()


def test_decay_and_volume_describe_clean_texts(spark):
    scores, counts = np.array([-0.3, 1.7]), np.array([97, 3])
    decay = toxicity.fitted_decay(scores, counts)
    assert (counts * np.exp(decay * scores)).sum() / 100 == pytest.approx(1) and decay > 0
    assert toxicity.fitted_decay(np.array([-1.0]), np.array([5])) == 1.0
    for means in ([0.3, 0.9, 2.5], [1e-9, 1e-3, 0.1], [5.0, 5.0, 0.5]):
        for r, (mean, got) in enumerate(zip(means, toxicity.poisson_tails(np.array(means))), 1):
            want = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(r, r + 60))
            assert got == pytest.approx(-math.log(want) if mean < r else 0, abs=1e-9)
    model = toxicity.ToxicModel("", [], 2.0, np.array([0.1, 0.04, 0.01]), np.empty(0), np.empty(0))
    last = 2 * toxicity.FINE
    assert model.expected(np.array([0.0, toxicity.FINE, last, last + 1])) == pytest.approx([0.1, 0.04, 0.01, 0.01 * math.exp(-2)])


def test_calibrated_scores_are_probabilities(spark, make_docs):
    """On held-out texts the mean score is near the share of toxic ones, also where toxic words occur in clean texts."""
    rng = random.Random(5)
    texts, marks = [], []
    for i in range(1500):
        words, toxic = sentence(rng, 60).split(), rng.random() < 0.2
        for word in ("vile", "rotter", "scoundrel"):
            if rng.random() < (0.5 if toxic else 0.03):
                words.insert(rng.randrange(len(words)), word)
        texts.append(" ".join(words))
        marks.append((i, 1, int(toxic)))
    got = score_toxicity(make_docs(texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).where("held_out").collect()
    truth = np.array([marks[r.doc_id][2] for r in got])
    scores = np.array([r.score for r in got])
    assert abs(scores.mean() - truth.mean()) < 0.05
    high = scores >= 0.3
    assert truth[high].mean() > 0.6 and high[truth == 1].mean() > 0.6


def test_beginnings_hold_whole_letters():
    data = "привет привод 語語語 ab".encode()
    _, _, stems, _ = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), stems=(4, 7))
    whole, _ = words_of(np.frombuffer("пр 語語".encode(), np.uint8), np.array([0, len("пр 語語".encode())]))
    assert stems[0] == stems[1] == whole[0] and stems[2] == whole[1]


def test_toxicity_of_held_out_texts(spark, make_docs):
    rng = random.Random(6)
    texts, marks = [], []
    for i in range(800):
        words = sentence(rng, rng.choice([20, 80, 300])).split()
        toxic = i % 8 == 0
        for _ in range(rng.choice([1, 3]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotter", "Rotters,", "scoundrel."]))
        texts.append(" ".join(words))
        marks.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = score_toxicity(make_docs(texts), labels).collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [(r.predicted, marks[r.doc_id][2]) for r in got if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    worst = max((r for r in got), key=lambda r: r.score)
    words = [w.lower().strip(".,") for w in texts[worst.doc_id].split()]
    assert any({"vile", "rotter", "rotters", "scoundrel"} & set(words[s.first : s.last + 1]) for s in worst.segments)


def test_toxic_token_counts_apart_from_tokens_of_like_hash(spark, make_docs):
    """A token in 40 of 200 toxic texts whose first 18 bits of the hash are those of words in every text; the beginning tells nothing."""
    data = " ".join(["wordbad", *(f"word{i}" for i in range(3_000_000))]).encode()
    words, _ = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    mates = [f"word{i - 1}" for i in np.flatnonzero(words >> np.uint64(46) == words[0] >> np.uint64(46))[1:6]]
    assert len(mates) == 5
    bad, own = [i % 10 == 0 for i in range(2000)], [i % 50 == 0 for i in range(2000)]
    docs = make_docs([f"text {i} {' '.join(mates)}" + " wordbad" * x for i, x in enumerate(own)])
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == own[r.doc_id] for r in score_toxicity(docs, labels).collect())


def test_toxicity_keeps_every_token_with_evidence(spark, make_docs, monkeypatch):
    """Many shards give the scores of one."""
    rng = random.Random(8)
    bad = [i % 8 == 0 for i in range(400)]
    docs = make_docs([sentence(rng, 40) + f" vile{rng.randrange(30)} {rng.randrange(30)}rotten" * b for b in bad])
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    one = {r.doc_id: (r.score, r.segments) for r in score_toxicity(docs, labels).collect()}
    monkeypatch.setattr("galewise.llm.toxicity.SHARD", 3)
    monkeypatch.setattr("galewise.llm.toxicity.HELD", 10)
    many = {r.doc_id: (r.score, r.segments) for r in score_toxicity(docs, labels).collect()}
    assert {k: v[0] for k, v in one.items()} == pytest.approx({k: v[0] for k, v in many.items()})
    assert len({v[0] for v in many.values()}) > 1


def test_line_dedup_against_brute_force(make_docs):
    rng = random.Random(8)
    block = [sentence(rng, 4) for _ in range(6)]
    texts = ["\n".join(rng.choice([block[:4], block, [rng.choice(block)], [sentence(rng, 3)], ["", ""]])[0:] + ["x"] * rng.choice([0, 5])) for _ in range(60)]
    texts = ["\n".join([a, b]) for a, b in zip(texts, reversed(texts))]
    seen, want = set(), {}
    for i, text in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if any(x.strip() for x in window):
                if window in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(window)
        want[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    assert {r.doc_id: tuple(r)[1:] for r in dedup_lines(make_docs(texts)).collect()} == want


def test_mixing_with_capped_sources(make_docs):
    rng = random.Random(10)
    sources = [rng.choice(["big"] * 30 + ["b", "c", "d", None]) for _ in range(1500)]
    docs = make_docs([sentence(rng, rng.choice([1, 5, 20])) for _ in sources], sources=sources)
    got = mix_report(docs).collect()
    size = collections.Counter()
    for r in got:
        size[sources[r.doc_id]] += r.size
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    free, target = set(names), {}
    while True:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > MAX_EPOCHS * size[s]}
        if not over:
            break
        target.update({s: MAX_EPOCHS * size[s] for s in over})
        free -= over
    target.update({s: weight[s] * level for s in free})
    assert 0 < len(free) < len(names)
    taken = collections.Counter()
    for r in got:
        s = sources[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, target[s], abs_tol=1e-5) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 20 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_report(docs.repartition(7)).collect()))
    rows = collections.Counter(r.doc_id for r in mix(docs).select("doc_id").collect())
    assert all(rows[r.doc_id] * r.size == r.taken for r in got)


def test_quality_of_held_out_texts(spark, make_docs):
    rng = random.Random(12)
    good = [i % 3 != 0 for i in range(300)]
    texts = [sentence(rng, 60) if g else " ".join(f"{rng.choice('#$%&')}{rng.random():.5f}" for _ in range(60)) for g in good]
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good) if i % 2], "doc_id long, quality int, toxic int")
    got = [r for r in classify_quality(make_docs(texts), labels).collect() if r.doc_id % 2 == 0]
    assert sum(r.keep == good[r.doc_id] for r in got) / len(got) > 0.95


def test_decontamination_finds_edited_copies_alone(spark, make_docs):
    rng = random.Random(13)
    items = [sentence(rng, 40, 5000) for _ in range(20)] + [sentence(rng, 500, 5000)]
    texts, want = [], set()
    for i in range(200):
        text = sentence(rng, rng.choice([10, 200, 800]), 5000)
        if i % 4 == 0:
            n = rng.randrange(len(items))
            copy = items[n] if n < 20 else " ".join(items[n].split()[100:350])
            text += "\n" + edited(rng, copy.upper() if i % 8 else copy, 0.1 if i % 3 else 0) + ". " + sentence(rng, 30, 5000)
            want.add((i, n))
        texts.append(text)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = contaminated(make_docs(texts), benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert sorted(map(tuple, got.select("doc_id", "item_id").collect())) == sorted(
        map(tuple, contaminated(make_docs(texts), benchmark, block=4).select("doc_id", "item_id").collect())
    )


@pytest.mark.parametrize("size", [5, 8, 12, 20, 40])
def test_decontamination_recall_at_every_item_length(spark, make_docs, size):
    """Of the texts that score 0.5 or more when aligned whole, at least 0.9 are found, and no others."""
    rng = random.Random(size)
    items = [sentence(rng, size, 5000) for _ in range(40)]
    texts = []
    for i in range(160):
        words = [w if rng.random() > 0.25 else f"x{rng.randrange(10**6)}" for w in items[i % 40].split()]
        texts.append(" ".join([sentence(rng, 60, 5000), *words, sentence(rng, 60, 5000)]))
    plain = decontaminate._words(items), decontaminate._words(texts)
    truth = {(i, j) for i, text in enumerate(plain[1]) for j in [i % 40] if decontaminate.align(plain[0][j], text)[0] >= 0.5 * 2 * size}
    got = {(r.doc_id, r.item_id) for r in contaminated(make_docs(texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(truth) > 100 and len(got & truth) >= 0.9 * len(truth)
    assert all(decontaminate.align(plain[0][j], plain[1][i])[0] >= size for i, j in got)


def brute_language_model(train):
    """(token counts, chance of b behind a) of an interpolated modified Kneser-Ney model of pairs."""
    count, pairs = collections.Counter(), collections.Counter()
    for w in train:
        count.update(w[1:])
        pairs.update(zip(w, w[1:]))
    types = len(count)

    def cuts(counter):
        n = [sum(1 for v in counter.values() if v == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))]

    follows = collections.Counter(b for _, b in pairs)
    d1, d2 = cuts(follows), cuts(pairs)
    kinds, used, back = len(pairs), collections.Counter(), collections.Counter()
    for (a, _), n in pairs.items():
        used[a] += n
        back[a] += d2[min(n, 3)]
    gamma = sum(d1[min(n, 3)] for n in follows.values()) / kinds

    def chance(a, b):
        low = (follows[b] - d1[min(follows[b], 3)]) / kinds + gamma / (types + 1)
        return (pairs[a, b] - d2[min(pairs[a, b], 3)] + back[a] * low) / used[a] if used[a] else low

    return count, chance


def tokens_of(text):
    return ["<s>", *(text or "").encode().lower().split(), "</s>"]


def test_language_scores_against_brute_force(documents, texts):
    tokens = {i: tokens_of(t) for i, t in texts}
    count, chance = brute_language_model([w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 10])
    total, types = sum(count.values()), len(count)

    # the model is a distribution over all known words and the unknown one
    assert math.isclose(sum(chance("<s>", b) for b in [*count, "?"]), 1)
    for r in score_language(documents).collect():
        w = tokens[r.doc_id]
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w[1:])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) - 1, sum(count[x] > 0 for x in w[1:]), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(chance(a, b)) for a, b in zip(w, w[1:])), rel_tol=1e-9)


def test_quality_against_brute_force(spark, documents):
    rows = documents.select("doc_id", "text", "lang").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    unseen = {i for i in good if zlib.crc32(str(i).encode()) % 5 == 0}
    _, chance = brute_language_model([tokens_of(r.text) for r in rows if r.doc_id in good - unseen])

    def perplexity(text):
        w = tokens_of(text)
        return 10 ** (-sum(math.log10(chance(a, b)) for a, b in zip(w, w[1:])) / (len(w) - 1))

    own = {r.doc_id: perplexity(r.text) for r in rows}
    by_lang = collections.defaultdict(list)
    for r in rows:
        if r.doc_id in unseen:
            by_lang[r.lang].append(own[r.doc_id])
    limits = {lang: float(np.quantile(x, 0.98)) for lang, x in by_lang.items()}
    every = float(np.quantile([own[i] for i in own if i in unseen], 0.98))
    for r in classify_quality(documents, labels).collect():
        assert math.isclose(r.perplexity, own[r.doc_id], rel_tol=1e-9)
        assert math.isclose(r.limit, limits.get(r.lang, every), rel_tol=1e-9)
        assert r.keep == (r.perplexity <= r.limit)


def test_exact_quantiles(spark):
    rng = random.Random(6)
    rows = [(g, float(rng.choice([1, 1, 1, 2, 5, rng.random()]))) for g in "abbcccc" * 60] + [("d", 3.0)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for q in (0, 0.3, 0.5, 0.98, 1):
        got = {r.g: r.limit for r in exact_quantiles(table, "g", "x", q).collect()}
        assert got == {g: pytest.approx(np.quantile([x for h, x in rows if h == g], q)) for g in "abcd"}


def test_near_copies_of_two_texts_under_one_id(spark):
    rng = random.Random(9)
    a, b = sentence(rng, 300, 5000), sentence(rng, 300, 5000)
    rows = [(7, a), (7, b), (9, a + " end"), (10, b + " end"), (11, sentence(rng, 300, 5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()) == [
        (7, 7, True), (7, 7, True), (9, 7, False), (10, 7, False), (11, 11, True)
    ]


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out[:n]


def test_strings_that_collide_in_polynomial_hashes(make_docs):
    x = thue_morse(4096)
    y = x.translate(str.maketrans("ab", "ba"))
    got = dedup_lines(make_docs([f"head\n{x}\ntail", f"head\n{y}\ntail", f"head\n{x}\ntail"])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 0, 2: 3}
    for n in (8, 255, 256, 257, 1024, 4096):
        data = f"{x[:n]} {y[:n]} {x[:n]}".encode()
        words, _ = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert words[0] == words[2] != words[1]


def test_word_hashes_are_those_of_the_bytes():
    rng = random.Random(1)
    pool = ["", "a", "b", "ab", "ba", "é", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "y" * 256, "y" * 257, "abcdefgh", "abcdefghi", "\0", "\0\0"]
    words = [rng.choice(pool[1:]) + rng.choice(pool) for _ in range(3000)]
    data = " ".join(words).encode()
    found, _ = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(found) == len(words) and len(set(found.tolist())) == len(set(words)) == len(set(zip(words, found.tolist())))


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("galewise.llm.topk.ITEM_ROWS", 64)
    monkeypatch.setattr("galewise.llm.topk.QUERY_ROWS", 8)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 24)) * rng.lognormal(size=(700, 1)) * np.linspace(1, 0.05, 24)
    vectors[300:340] = vectors[300]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = sorted(map(tuple, exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)).collect()))
    whole = np.floor(256 * vectors).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:5]
        want += [(q, k + 1, int(i), int(score[i])) for k, i in enumerate(order)]
    assert got == want


def test_surrogates_keep_type_and_format(spark):
    values = [("email", "jo.doe@mail.example.com"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (988) 555-2485"), ("ip", "8.8.4.4"),
              ("secret", "b7db7aa4a5fcc78305"), ("ssn", "123-45-6789"), ("male", "Иванов"), ("female", "Anna")]
    for kind, value in values:
        new = surrogate(kind, value, b"key")
        assert new != value and new == surrogate(kind, value, b"key") != surrogate(kind, value, b"other")
        if kind not in ("male", "female", "secret"):
            assert find(new)[0][2:] == (kind, new) or kind == "ssn"
        if kind != "ip":
            assert [c.isalpha() + 2 * c.isdigit() for c in new] == [c.isalpha() + 2 * c.isdigit() for c in value] or kind == "secret"
    assert surrogate("female", "Anna", b"key").endswith("a") and surrogate("female", "Anna", b"key")[0].isupper()
    assert all("а" <= c.lower() <= "я" for c in surrogate("male", "Иванов", b"key"))


def test_surrogates_are_distinct_and_no_real_values(spark):
    # of 900 forms 600 are in use: drawing alone would collide
    values = [("ssn", f"1{i:02d}-0{j}-0000"[:3]) for i in range(20) for j in range(1)]
    table = surrogate_table(spark.createDataFrame(values, "type string, value string").distinct(), b"key").collect()
    assert len({r.surrogate for r in table}) == len(table) == len(set(values))
    assert not {r.surrogate for r in table} & {v for _, v in values}


def test_surrogates_where_a_format_has_too_few_forms(spark):
    names = ["Đỗ", "Łęż", "Հայկ", *(a + b for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "ai")]
    table = surrogate_table(spark.createDataFrame([("male", n) for n in names], "type string, value string"), b"key").collect()
    assert sorted(r.value for r in table) == sorted(names)
    assert len({r.surrogate for r in table}) == len(names) and not {r.surrogate for r in table} & set(names)
    assert all(not set(r.surrogate) & set(r.value) for r in table if not r.value.isascii())
    assert all(r.surrogate[-1] == r.value[-1] for r in table if r.value.isascii())


def test_replaced_entities_refer_alike(make_docs):
    texts = ["write to a.b@x.example.com or call +1 (988) 555-2485", "again a.b@x.example.com and Mrs. Anna Smith, c.d@x.example.com", "nothing here"]
    got = {r.doc_id: r for r in replace_pii(make_docs(texts), b"key").collect()}
    assert [got[i].n_entities for i in range(3)] == [2, 3, 0] and got[2].text == texts[2]
    mails = [[v for _, _, k, v in find(got[i].text) if k == "email"] for i in range(2)]
    assert mails[0][0] == mails[1][0] != mails[1][1]
    assert not {v for t in texts for *_, v in find(t)} & {v for r in got.values() for *_, v in find(r.text)}


def test_mentions_of_an_entity_refer_alike(make_docs):
    texts = ["Mr John Quincy Adams met Mrs Smith. Adams spoke, SMITH's answer came.", "Mr. John Smith, Mr Adams", "call +1 555 123 4567", "call +1-555-123-4567 or +1-555-123-4568"]
    got = {r.doc_id: r for r in replace_pii(make_docs(texts), b"key").collect()}
    assert [got[i].n_entities for i in range(4)] == [4, 2, 1, 2]
    words = {i: [w.strip(".,").removesuffix("'s") for w in got[i].text.split()] for i in range(4)}
    _, john, quincy, adams, _, _, smith, again, _, upper, *_ = words[0]
    assert again == adams and upper == smith.upper() and words[1][1:3] == [john, smith] and words[1][4] == adams
    assert len({john, quincy, adams, smith, "John", "Quincy", "Adams", "Smith"}) == 8
    digits = [[c for c in w if c.isdigit()] for w in (got[2].text, words[3][1], words[3][3])]
    assert digits[0] == digits[1] != digits[2]


def test_screen_passes_whatever_is_found(spark):
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    draw = lambda n, pool=letters: "".join(rng.choice(pool) for _ in range(n))
    texts = [f"x AKIA{draw(16)} y", *(f"x {m}{draw(20)} y" for m in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"))]
    for zero in (0x30, 0x660, 0x966, 0xFF10, 0x1D7CE, 0x11F50):
        digits = "".join(map(chr, range(zero, zero + 10)))
        texts += [f"x +{draw(11, digits)} y", f"x {draw(16, digits)} y", f"x {draw(3, digits)}-{draw(2, digits)}-{draw(4, digits)} y"]
    texts += [f"{w}{e}{draw(9)}" for w in ("password", "PassWd", "pwd", "token", "SECRET", "apikey", "Access_Key", "pa\u017f\u017fword", "to\u212aen") for e in ("=", ": ", ' = "')]
    texts += [f"{t}{d} {n}" for t in MALE + FEMALE for d in ("", ".") for n in ("Li", "Đỗ", "J. Li", "O'Hara")] + ["a@b.cd", "ö@ü.äß"]
    hold = [t for t in texts if find(t)]
    assert len(hold) > 0.9 * len(texts)
    assert pc.all(pc.match_substring_regex(pa.array(hold), MAY_HOLD)).as_py()
    # searching by lines finds what searching whole texts does
    for _ in range(30):
        text = "".join(rng.choice(hold) + rng.choice(["\n", " ", "\n\n", "\r\n", ". "]) for _ in range(20))
        assert found_in(pa.array([text]))[0] == find(text)


def test_replacement_against_a_plain_loop(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    names = ["Mr John Smith", "Mrs Maria Smith", "Frau Anna-Lena Vogel", "Señor Ivan", "Mr Li"]
    rows = [(r.doc_id, r.text + (f"\n{names[r.doc_id % 5]} wrote, said {names[r.doc_id % 5].split()[-1]}." if r.doc_id % 3 == 0 else "")) for r in rows]
    rows += [(None, "a.b@c.example.com"), (None, "x"), (None, None), (None, "Mr John Smith"), (5, "one 10.20.30.40"), (5, "two 10.20.30.40")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spans = {t: mentions(find(t), t) if find(t) else [] for _, t in rows if t is not None}
    parts = sorted({u for own in spans.values() for _, _, k, v in own for u in units(k, v)})
    table = spark.createDataFrame(parts, "type string, value string")
    known = {(r.type, r.value): r.surrogate for r in surrogate_table(table, b"key").collect()}
    assert len(set(known.values())) == len(known) and not set(known.values()) & {v for _, v in known}

    def plain(text):
        out, at = "", 0
        for start, end, kind, value in spans[text]:
            out, at = out + text[at:start] + laid_out(kind, value, known), end
        return out + text[at:]

    want = collections.Counter((i, len(spans.get(t, [])), None if t is None else plain(t)) for i, t in rows)
    assert collections.Counter(map(tuple, replace_pii(docs, b"key").collect())) == want
    men, women = ({s for (k, _), s in known.items() if k == own} for own in ("man", "woman"))
    assert men and women and all(s[-1] in "bdklmnrst" for s in men) and all(s.endswith("a") for s in women)


def test_replacement_of_many_rows_without_an_id(spark):
    rows = [(None, f"call +1 555 {i % 50:03d} 4567") for i in range(4000)]
    got = replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect()
    assert len(got) == 4000 and len({r.text for r in got}) == 50 and all(r.n_entities == 1 for r in got)


def test_a_surrogate_is_no_real_value_of_another_type(spark):
    values = [("phone", f"555{i}") for i in range(40)] + [("ssn", f"5{i:03d}") for i in range(400)]
    table = surrogate_table(spark.createDataFrame(values, "type string, value string"), b"key").collect()
    made = [r.surrogate for r in table]
    assert len(set(made)) == len(made) == len(values) and not set(made) & {v for _, v in values}
