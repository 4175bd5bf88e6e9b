"""Every operator takes messy and empty tables and gives each row its defined result."""

import hashlib

import corpus_pipeline
import pytest
from llm_fixtures import labels, messy  # noqa: F401

from galewise.llm.decontaminate import contaminated
from galewise.llm.line_dedup import dedup_lines
from galewise.llm.lm_scoring import score_language
from galewise.llm.minhash import near_duplicates
from galewise.llm.mixing import mix, mix_report
from galewise.llm.pii import replace_pii
from galewise.llm.quality import classify_quality
from galewise.llm.suffix_dedup import without_repeats
from galewise.llm.topk import exact_topk
from galewise.llm.toxicity import score_toxicity


def rows_by_text(docs, out):
    assert out.count() == docs.count()
    return out.collect()


def test_near_duplicates(messy):
    got = rows_by_text(messy, near_duplicates(messy))
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id in (5, 6)} == {(5, 5, True), (6, 5, False)}
    assert {(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id in (2, 3, 4)} == {(0, 2, True), (0, 3, True), (0, 4, True)}
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    assert [r.kept for r in got if r.doc_id == 1] == [True, True]


def test_suffix_dedup(messy):
    got = rows_by_text(messy, without_repeats(messy))
    none = hashlib.sha256(b"").hexdigest()
    assert {(r.n_bytes, r.n_removed, r.kept_sha256) for r in got if r.doc_id in (2, 3)} == {(0, 0, none)}
    five, six = (next(r for r in got if r.doc_id == i) for i in (5, 6))
    assert five.n_removed == 0 and (six.n_removed, six.n_spans, six.kept_sha256) == (six.n_bytes, 1, none)
    assert [r.n_removed for r in got if r.doc_id == 9] == [598]
    assert {r.n_removed for r in got if r.doc_id in (1, 7)} == {0}


def test_toxicity(messy, labels):
    got = rows_by_text(messy, score_toxicity(messy, labels))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.score == 0 for r in score_toxicity(messy, labels.where("toxic = 0")).collect())


def test_line_dedup(messy):
    got = rows_by_text(messy, dedup_lines(messy))
    assert {(r.n_lines, r.n_removed, r.text) for r in got if r.doc_id == 2} == {(0, 0, None)}
    assert {(r.n_lines, r.n_removed, r.text) for r in got if r.doc_id == 3} == {(1, 0, "")}
    assert {(r.doc_id, r.n_removed) for r in got if r.doc_id in (1, 5, 6)} == {(1, 0), (5, 0), (6, 2000)}


def test_mixing(messy):
    got = rows_by_text(messy, mix_report(messy))
    assert sum({r.target for r in got if r.doc_id in (5, 6)}) <= sum(r.size for r in got)
    assert {(r.size, r.taken) for r in got if r.doc_id in (2, 3, 4)} == {(0, 0)}
    assert all(r.taken <= 3 * r.size for r in got)
    assert mix(messy).columns == messy.columns


def test_quality(messy, labels):
    got = rows_by_text(messy, classify_quality(messy, labels))
    assert all(r.perplexity > 0 for r in got)
    assert all(r.keep for r in classify_quality(messy, labels.limit(0)).collect())


def test_decontamination(spark, messy):
    items = spark.createDataFrame([(1, "one two three four five six line more"), (2, None), (3, ""), (None, "word"), (4, "ab")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in contaminated(messy, items).collect()] == [(1, 1, 1.0)]
    assert contaminated(messy, items.limit(0)).count() == 0


def test_language_scores(messy):
    got = rows_by_text(messy, score_language(messy))
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert all(r.score < 0 and r.base_score < 0 for r in got)


def test_topk(spark):
    rows = [(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1),
            (4, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1), (5, [1.0], 1), (6, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, norm int")
    got = sorted(map(tuple, exact_topk(table).collect()))
    assert got == [(0, 1, 5, 65536), (0, 2, 50, 65536), (0, 3, 50, 65536), (0, 4, 6, 0), (50, 1, 0, 65536), (50, 2, 5, 65536), (50, 3, 6, 0)]
    assert exact_topk(table.limit(0)).count() == 0


def test_pii(messy):
    got = rows_by_text(messy, replace_pii(messy, b"k"))
    assert {(r.n_entities, r.text) for r in got if r.doc_id == 2} == {(0, None)}
    eight = next(r for r in got if r.doc_id == 8)
    assert eight.n_entities == 2 and "ab.1@" not in eight.text and "10.20.30.40" not in eight.text


@pytest.mark.parametrize("work", [near_duplicates, without_repeats, dedup_lines, mix_report, score_language, lambda d: replace_pii(d, b"k")])
def test_empty_table(messy, work):
    assert work(messy.limit(0)).count() == 0


def test_empty_tables_with_labels(messy, labels):
    empty = messy.limit(0)
    assert score_toxicity(empty, labels).count() == 0
    assert classify_quality(empty, labels).count() == 0
    assert contaminated(empty, empty.selectExpr("doc_id as item_id", "text")).count() == 0


def test_stages_take_messy_tables(spark, messy, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "quite another text of no document here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (messy, messy.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.settled(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == corpus_pipeline.COLUMNS
