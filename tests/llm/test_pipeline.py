"""The pipeline's stages against plain code, and every query against its SQL."""

import collections
import re

import pytest

import corpus_pipeline
from catalog import compare
from mailsieve.llm import queries

pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf, con, name):
    assert compare.differences(queries.QUERIES[name](spark, sf), con, queries.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_return_every_row(spark, sf, name):
    frame = queries.QUERIES[name](spark, sf)
    key = "page_id" if "page_id" in frame.columns else "doc_id"  # the others are compared with SQL
    source = "pages" if key == "page_id" else "documents"
    want = sorted(r[0] for r in spark.read.parquet(f"{sf}/{source}.parquet").select(key).collect())
    got = [r[0] for r in frame.select(key).collect()]
    assert sorted(set(got)) == want and (name == "op6_packing" or len(got) == len(want))


def test_stages_do_what_their_operators_say(spark, sf):
    docs = queries.table(spark, sf, "documents")
    kept = [r.doc_id for r in queries.op9_quality(spark, sf).where("kept").collect()]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == sorted(kept)
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in queries.op2_toxicity(spark, sf).where("predicted = 0").collect())
    single = stages["n-gram Jaccard join"](spark, docs, sf)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r in queries.op3_jaccard_join(spark, sf).where("doc_id = class_id").collect())


def test_run_equals_the_stages_in_a_row(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    parts = collections.defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.start, r.length))
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    kept = {r.doc_id for r in queries.op9_quality(spark, sf).where("kept").collect()}
    assert set(parts) <= kept
    shingled = [frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (re.split(r"[\x20\x09-\x0D]+", docs[d].lower().strip()) for d in parts)]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(shingled) for b in shingled[:i])
    for spans in parts.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:])) and min(spans)[0] == 0


def test_stages_take_missing_values_and_empty_tables(spark, sf):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None, None, None, None), (None, words, None, "s", 1), (None, words, "en", None, 1), (3, words, "en", "s", 1), (3, words, "en", "s", 1),
            (4, words.upper(), "de", "s", None), (5, "", "en", "s", 0), (6, "é" * 200_000 + " x" * 60, "en", "s", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    counts = {name: collections.Counter(r.doc_id for r in stage(spark, frame, sf).select("doc_id").collect()) for name, stage in corpus_pipeline.STAGES}
    assert counts["quality rules"] == {None: 2, 3: 2, 4: 1}
    assert sum(counts["toxicity"].values()) == len(rows)
    assert counts["n-gram Jaccard join"] == {1: 1, None: 2, 3: 1, 5: 1, 6: 1}
    assert set(counts["packing"]) == {1, None, 3, 4, 5, 6}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), sf).collect() == []


def test_stages_keep_own_columns_and_judge_shared_ids_by_text(spark, sf):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(5, a, 7.5, 1, "p"), (5, b, 7.5, 0, "q"), (3, b + " end", 7.5, 1, "r"), (5, a, 7.5, 1, "p"), (9, "", 7.5, 1, "s"), (9, b, 7.5, 1, "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, _score string").selectExpr(
        "*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, frame, sf)
    assert clean.columns == frame.columns and sorted(map(str, clean.collect())) == sorted(map(str, frame.collect()))
    kept = stages["n-gram Jaccard join"](spark, frame, sf)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (3, b + " end"), (9, "")])


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "packing"]
