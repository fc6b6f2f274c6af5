"""Registered queries against their SQL, and the pipeline against a plain version of itself."""

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from mirrorleaf.llm.queries import ORACLES, QUERIES
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import brute as deduplicated
from tests.llm.test_near_duplicates import brute as grouped

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    theirs = con.sql(ORACLES[name])
    ours = QUERIES[name](spark, SF).select(*theirs.columns)
    assert sorted(map(str, map(tuple, ours.collect()))) == sorted(map(str, theirs.fetchall()))


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert {labels.get(d) for d, _ in rows} <= {None, 1} and len(rows) >= sum(q == 1 for q in labels.values())
    rows = [(d, t) for d, t, _, _ in deduplicated(rows, 10, "first")]
    alive = {d for d, c, _ in grouped(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in alive]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not contaminated(t, items)[2]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    found = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids) for r in found.collect()) == sorted((d, library.encode(t)) for d, t in rows)
    assert found.where("exact").count() == len(rows)


def test_stages_keep_the_columns(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
