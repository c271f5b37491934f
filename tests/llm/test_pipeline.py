"""The corpus pipeline against plain code for every stage, over the smallest driver tables."""

from __future__ import annotations

import os
import sys

import pytest
from brute import components

import corpus_pipeline
from lonja.llm import queries

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from check_oracle import compare, open_duck  # noqa: E402

from lonja.llm import oracle  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark, tmp_path):
    duck = open_duck(FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    before = texts(docs)
    for number, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if name != "bpe":
            assert docs.columns == names
            after = texts(docs)
        duck.execute(f"CREATE VIEW v{number} AS SELECT * FROM read_parquet('{tmp_path}/{number}/*.parquet')")
        if name == "language_id":
            lettered = {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
            assert set(after) <= lettered and len(after) >= 0.99 * len(lettered)
        elif name == "line_dedup":
            plain = duck.execute("WITH " + oracle._lines("v0") + " SELECT doc_id, text FROM t").fetchall()
            assert after == dict(plain)
        elif name == "ngram_jaccard_join":
            assert set(after) == {low for _, low in components(before).values()}
        elif name == "decontamination":
            judged = duck.execute(f"SELECT doc_id FROM ({oracle.decontamination('v2')}) WHERE contaminated").fetchall()
            assert set(after) == set(before) - {i for (i,) in judged}
        else:
            assert {r["doc_id"] for r in docs.collect()} == set(before)
        before = after


def test_run_equals_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.count() == rows.select("doc_id").distinct().count() > 0


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, open_duck(FOLDER), queries.QUERIES[name], oracle.SQL[name], FOLDER) is None
