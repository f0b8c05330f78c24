"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib

import pytest

from orthant.llm.queries import QUERIES

PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"tok{i % 5000}x{i // 5000}" for i in range(120_000))
DOCUMENTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, PASSAGE), (5, PASSAGE), (5, PASSAGE), (None, PASSAGE + " tail"), (None, None), (6, LONG), (7, "one"), (8, "one"), (9, "!!!"),
    (10, "Ünïcode wörds — 日本語 \U0001f600 " * 30), (11, "a" * 5000), (12, "x", None, None, None), (13, "Was " * 200), (14, None, None, None, None),
]
BENCHMARK = [(1, PASSAGE[:200]), (None, "gone"), (2, None), (3, ""), (4, "one"), (4, "one")]
LABELS = [(4, 1, 0), (5, 1, None), (5, 0, 1), (None, 1, 1), (7, None, 0), (13, 0, 1), (99, 1, 1), (10, 1, 0)]
CONVERSATIONS = [(1, 0, "user", "hi there"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "assistant", "y"), (2, 0, None, "z"), (3, 0, "assistant", "first")]
#: Names that the operators use themselves.
CLASHING = [(n, "'x'") for n in ("n_words", "score", "ids", "decoded", "spans", "_text", "_k", "_x", "n", "anchor", "component_id", "kept", "hit_items", "label", "_rest", "set", "block", "_key", "_stratum", "_id", "_rows", "_score", "_row", "rows", "n_hit")]
PER_DOCUMENT = [q for q in QUERIES if q.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op9")]


@pytest.fixture(scope="module")
def odd(make):
    return make(DOCUMENTS, BENCHMARK, LABELS, CONVERSATIONS)


@pytest.fixture(scope="module")
def clashing(make):
    return make(DOCUMENTS, BENCHMARK, LABELS, CONVERSATIONS, CLASHING)


@pytest.fixture(scope="module")
def empty(make):
    return make()


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows_and_clashing_columns(spark, odd, clashing, name):
    plain = QUERIES[name](spark, odd)
    found = rows(plain)
    assert found == rows(QUERIES[name](spark, clashing))
    if name in PER_DOCUMENT:
        assert len(found) == len(DOCUMENTS)


def test_null_and_empty_texts(spark, odd):
    none = hashlib.sha256(b"").hexdigest()
    bpe = {r.doc_id: r for r in QUERIES["op7_byte_bpe"](spark, odd).collect()}
    assert all((bpe[i].n_tokens, bpe[i].ids_sha256, bpe[i].decoded_sha256) == (0, none, none) for i in (1, 2, 14))
    hits = {r.doc_id: r for r in QUERIES["op2_decontaminate"](spark, odd).collect()}
    assert (hits[1].n_words, hits[1].n_hit, hits[1].n_items, hits[1].items_sha256, hits[1].contaminated) == (0, 0, 0, none, False)
    assert (hits[7].n_hit, hits[7].n_items, hits[7].contaminated) == (1, 1, True)
    sets = {r.doc_id: r for r in QUERIES["op3_ngram_join"](spark, odd).collect()}
    assert (sets[1].n_shingles, sets[1].component_id, sets[2].n_shingles, sets[3].component_id) == (0, 1, 0, 3)
    assert (sets[8].component_id, sets[7].component_id, sets[5].component_id) == (7, 7, 4)
    cut = {r.doc_id: r for r in QUERIES["op5_suffix_dedup"](spark, odd).collect()}
    assert (cut[1].n_bytes, cut[1].n_removed, cut[1].kept_sha256) == (0, 0, none)
    assert cut[11].n_removed == 5000 and cut[4].n_removed == len(PASSAGE) and cut[7].n_removed == 0


@pytest.mark.parametrize("name", ["op4_toxicity", "op9_quality_mil"])
def test_scores_of_any_text(spark, odd, empty, name):
    found = QUERIES[name](spark, odd).collect()
    assert all(r.score is not None and 0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 5}) == 1


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, clashing):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
    found = corpus_pipeline.run(spark, odd).collect()
    ids = [r.doc_id for r in found]
    assert rows(corpus_pipeline.run(spark, odd)) == rows(corpus_pipeline.run(spark, clashing))
    import os

    docs = spark.read.parquet(os.path.join(clashing, "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, clashing)
        assert all(r[n] == "x" for r in docs.collect() for n, _ in CLASHING)
    assert ids.count(5) <= 1 and len(ids) == len(set(ids) - {None}) + ids.count(None)
