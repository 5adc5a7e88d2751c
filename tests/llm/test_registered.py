"""The registered queries of the corpus operators and the pipeline on the driver's smallest tables."""

import duckdb
import pytest

from sievelake.llm import bpe, queries
from tests.test_queries import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, small).toPandas()) == rows(c.sql(queries.oracle_sql()[name]).df())


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_held_out_accuracy(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    q = queries.queries()["op1_quality"](spark, small).join(labels, "doc_id").filter("held_out")
    assert q.filter("predicted = quality").count() >= 0.9 * q.count() > 0
    p = queries.queries()["op7_language"](spark, small).join(docs, "doc_id").filter("held_out")
    assert p.filter("lang = lang_pred").count() >= 0.95 * p.count() > 0


def test_pipeline_stages_take_effect(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in p.STAGES:
        out = p.staged(stage(spark, docs, small))
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert out.columns == docs.columns and out.select("doc_id").distinct().count() == out.count()
            sizes.append(out.count())
        if name == "mixing":
            assert out.columns == docs.columns
            mixed = out
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    assert docs.count() == mixed.count() and docs.filter("NOT exact").isEmpty()
    e = bpe.encoder(bpe.public_path(), bpe.public_pattern())
    want = {(r.doc_id, e.count(r.text)) for r in mixed.collect()}
    assert {(r.doc_id, r.n_tokens) for r in docs.collect()} == want
