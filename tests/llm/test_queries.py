"""The registered queries on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from galeledger.llm import queries
from tests.llm import brute
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not mounted")


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query_equals_sql(spark, name):
    con = connect(SF_DIR)
    assert compare(spark, con, SF_DIR, queries.QUERIES[name], queries.ORACLE[name]) is None


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def test_near_duplicates(spark, rows):
    got = sorted(map(tuple, queries.op3_dart_minhash(spark, SF_DIR).collect()))
    assert got == brute.near_classes(rows)


def test_decontamination(spark, rows):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, SF_DIR).collect()}
    assert got == brute.contained(rows, [(r.item_id, r.text) for r in items]) and got


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_every_document_has_a_row(spark, rows, name):
    if name == "op9_decontamination":
        pytest.skip("has rows for pairs only")
    got = sorted(r.doc_id for r in queries.QUERIES[name](spark, SF_DIR).select("doc_id").collect())
    assert got == sorted(i for i, _ in rows)


def test_pipeline_stages(spark, rows):
    """Each stage's decision against plain code on what it was given."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    schema = docs.schema
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name == "token_files":
            start = 0
            for r in sorted(out.collect(), key=lambda r: r.start):
                assert r.start == start and r.doc_id in given
                start += r.n_tokens
            assert out.count() == docs.count()
            break
        assert out.schema.names == schema.names
        left = sorted(r.doc_id for r in out.collect())
        pairs = [(i, r.text) for i, r in given.items()]
        if name == "quality":
            scored = queries.quality.score_quality(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
            assert left == sorted(r.doc_id for r in scored.collect() if r.predicted == 1)
            assert 0.7 * len(given) < len(left) < len(given)
        elif name == "near_duplicates":
            assert left == sorted({c for _, c in brute.near_classes(pairs)})
        elif name == "decontamination":
            items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
            bad = {i for i, _ in brute.contained(pairs, [(r.item_id, r.text) for r in items])}
            assert left == sorted(set(given) - bad)
        elif name == "mixing":
            assert set(left) <= set(given) and max(left.count(i) for i in set(left)) <= 2
        docs = spark.createDataFrame(out.collect(), schema)
        given = {r.doc_id: r for r in docs.collect()}


def test_pipeline_runs_whole(spark):
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert [r.start for r in sorted(got, key=lambda r: r.start)][0] == 0
