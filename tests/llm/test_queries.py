import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from convoy.llm import queries
from convoy.llm.quality import quality_scores
from tests_helpers import same_rows


def test_registered():
    names = entry.queries()
    assert sorted(int(m[1]) for m in (re.match(r"op(\d+)_", k) for k in names) if m) == list(range(1, 14))
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.sql(queries.ORACLES[name])
    same_rows(queries.QUERIES[name](spark, sf), result.columns, result.fetchall())


def test_pipeline_stage_by_stage(spark, sf, documents):
    """Each stage against its operator's own decisions, the last one against the ids it got."""
    from test_exact_dedup import brute as exact
    from test_ngram_join import brute as near
    from test_packing import check as packed

    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = corpus_pipeline.staged(stage(spark, docs, sf), f"test-{name}")
        if name != "packing":
            assert docs.columns == documents.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert ids(seen["exact_dedup"]) == ids(quality_scores(documents, labels).filter("predicted = 1"))
    assert ids(seen["near_dedup"]) == sorted(i for i, _, _, kept, _ in exact(rows(seen["exact_dedup"])) if kept)
    assert ids(seen["decontamination"]) == sorted(i for i, _, c in near(rows(seen["near_dedup"]), 80, 5) if i == c)
    packed(rows(seen["packing"]), docs.collect(), queries.CAPACITY)
    assert 0 < len(ids(seen["packing"])) < len(ids(documents))
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_on_an_empty_table(spark, sf, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, sf), "test-empty")
    assert docs.count() == 0
