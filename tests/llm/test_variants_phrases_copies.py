"""Spelling variants, collocations and exact duplicates against brute force, on messy tables and with small limits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_fixtures import make_docs, messy  # noqa: F401
from pyspark.sql import functions as F

from galewise.llm.collocations import collocations
from galewise.llm.exact_dedup import exact_duplicates, exact_duplicates_of
from galewise.llm.variants import damaged_words, spelling_groups

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def damaged(doc_id, text):
    for run in RUN.findall(text or ""):
        run = run.translate(LOW)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        yield run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    short, long = sorted((x, y), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def groups(counts, ratio=10):
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    best = {w: min(links[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: b if b and counts[b] >= ratio * counts[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), counts[w], len(links[w]), counts.get(form[w])) for w in counts}


def test_damaged_words(spark, make_docs, messy):
    rng = random.Random(5)
    letters = "abcÀéÿÖ"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.choice([3, 7, 8, 9, 80]))) * rng.choice([1, 1, 2]) for _ in range(300)) for _ in range(20)]
    for docs in (make_docs([t + ". " + t.upper() for t in texts]), messy):
        want = Counter(w for r in docs.collect() for w in damaged(r.doc_id, r.text))
        got = {r.word: r.n for r in damaged_words(docs).collect()}
        assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert damaged_words(messy.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"shard_words": 7, "round_bytes": 2000}])
def test_spelling_groups(spark, limits):
    rng = random.Random(7)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([7, 8, 9]))) for _ in range(250)} | {"a" * 400, "a" * 399, "b" + "a" * 399, "語" * 7, "語" * 8}
    counts = {w: 10 ** rng.randrange(5) for w in words}
    table = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int")
    assert {tuple(r) for r in spelling_groups(table, **limits).collect()} == groups(counts)


def test_spelling_groups_of_nothing(spark):
    assert spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def test_chain_of_forms_ends_at_its_root(spark):
    counts = {"a" * (7 + k): 10**k for k in range(9)}
    assert {r.root for r in spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()} == {"a" * 15}


def phrases(rows, longest, least, inside, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        made = []
        for p, a in found.items():
            if any(len(q) > len(p) and inside[1] * b >= inside[0] * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            made.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(made)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,least,top", [(4, 5, 2000), (4, 3, 10), (2, 4, 2000), (5, 4, 70)])
def test_collocations(make_docs, longest, least, top):
    rng = random.Random(longest * least)
    words = ["A", "b", "É", "c d", "語", "e'f", "g-", "H"]
    texts = [None, "", " ,. ", "x"] + ["".join(rng.choice(words) + rng.choice([" ", " ", " \t", ". ", "\n", ",", " ? "]) for _ in range(60)) for _ in range(40)]
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    got = collocations(make_docs(texts, langs=langs), longest=longest, least=least, top=top)
    want = phrases(zip(langs, texts), longest, least, (80, 100), top)
    assert want and sorted(map(tuple, got.collect())) == want


def test_collocations_of_messy_tables(messy):
    want = phrases([(r.lang, r.text) for r in messy.collect()], 4, 30, (80, 100), 2000)
    assert sorted(map(tuple, collocations(messy).collect())) == want
    assert collocations(messy.limit(0)).count() == 0


def test_a_hot_phrase_and_one_lang_of_all_rows(make_docs):
    texts = ["the hot phrase" for _ in range(500)] + [f"the w{i} of all" for i in range(200)]
    want = phrases([("en", t) for t in texts], 4, 30, (80, 100), 2000)
    assert sorted(map(tuple, collocations(make_docs(texts).repartition(16)).collect())) == want


def squeeze(text):
    return re.sub("[ \t-\r]", "", text or "")


def check_copies(rows, got):
    """Groups, sizes, digests and exactly one kept row a group, with the id that the contract asks for."""
    assert len(rows) == len(got)
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[squeeze(text)].append((-len(text or ""), doc_id is None, doc_id or 0))
    want = Counter()
    for key, members in groups.items():
        _, nameless, keep = min(members)
        for _, missing, doc_id in members:
            want[None if missing else doc_id, None if nameless else keep, len(members), hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_duplicates(messy, digest_bytes):
    got = exact_duplicates_of(messy, digest_bytes=digest_bytes)
    check_copies([(r.doc_id, r.text) for r in messy.collect()], got.collect())
    assert exact_duplicates_of(messy.limit(0)).count() == 0


def test_colliding_digests_of_many_copies(make_docs):
    rng = random.Random(2)
    texts = ["one text" + " " * rng.randrange(3) for _ in range(400)] + [f"t{rng.randrange(90)}" + "\n" * rng.randrange(2) for _ in range(600)]
    docs = make_docs(texts).repartition(7)
    check_copies(list(enumerate(texts)), exact_duplicates_of(docs, digest_bytes=1).collect())


def test_state_goes_on_with_new_files(spark, make_docs, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    first, second = ["a b", "ab", None, "c"], ["a  b", "c", "", "d"]
    make_docs(first).write.parquet(path)
    check_copies(list(enumerate(first)), exact_duplicates(spark, path, state).collect())
    make_docs(second, ids=[9, 8, 7, 6]).write.mode("append").parquet(path)
    rows = [*enumerate(first), *zip([9, 8, 7, 6], second)]
    # one file a batch: the entries of earlier batches and of the earlier call are met again
    check_copies(rows, exact_duplicates(spark, path, state, batch_bytes=1).collect())


def test_state_is_keyed_on_disk_and_never_expires(spark, make_docs, tmp_path):
    make_docs(["a", "b", "a"]).write.parquet(str(tmp_path / "docs"))
    exact_duplicates(spark, str(tmp_path / "docs"), str(tmp_path / "state")).count()
    from galewise.llm.exact_dedup import STATE

    assert "RocksDB" in STATE["spark.sql.streaming.stateStore.providerClass"]
    meta = spark.read.format("state-metadata").load(str(tmp_path / "state")).collect()
    assert [m.operatorName for m in meta] == ["stateStoreSave"]
    provider = "spark.sql.streaming.stateStore.providerClass"
    assert "RocksDB" not in (spark.conf.get(provider, None) or "")  # the session's own setting is back
    before = spark.conf.get(provider)
    spark.conf.set(provider, STATE[provider])
    held = spark.read.format("statestore").load(str(tmp_path / "state"))
    assert held.count() == 2 and held.select(F.sum("value.count")).first()[0] == 3
    spark.conf.set(provider, before)
