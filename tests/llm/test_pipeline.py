"""The registered queries and the pipeline on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from findmill.llm import queries
from findmill.llm.common import materialise, read_table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_covers_its_table(spark, name):
    df = queries.queries()[name](spark, SF)
    # a search answers every item of the benchmark
    table = {"op3_embedding_dedup": "embeddings", "op6_html_extraction": "pages", "op12_ranked_search": "benchmark"}.get(name, "documents")
    key = {"embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}.get(table, "doc_id")
    ids = {r[0] for r in df.select(key).collect()}
    every = {r[0] for r in read_table(spark, SF, table).select(key).collect()}
    assert ids <= every if name == "op2_decontamination" else ids == every


def test_stages_keep_columns_and_decide(spark):
    start = read_table(spark, SF, "documents")
    docs = start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, SF), name)
        assert docs.columns == start.columns and docs.join(before, "doc_id", "left_anti").count() == 0
    labels = read_table(spark, SF, "labels")
    kept = docs.join(labels, "doc_id")
    assert kept.filter("quality = 0").count() <= 0.1 * labels.filter("quality = 0").count()
    assert docs.count() >= 0.5 * start.count()
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert placed.select("doc_id").distinct().count() == docs.count()


def test_stages_take_nulls_and_empty_tables(spark):
    odd = spark.createDataFrame(
        [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "some words here", "en", "s", 15, "y"), (3, "w " * 50_000, "en", "s", 100_000, "z")],
        "doc_id long, text string, lang string, source string, n_chars int, keep string")
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, table, SF)
            if name != "packed":
                assert rows.columns == table.columns
            rows.collect()
    masked = corpus_pipeline.without_secrets(spark, odd.withColumn("text", F.lit("token = abcdefghijklmnop")), SF).first()
    assert masked.text == "[secret]" and masked.n_chars == 8


def test_rows_without_an_id_are_kept(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, words), (None, words), (None, words + " more"), (None, "quite another text of some length stands here"), (None, "quite another text of some length stands here"),
            (None, None), (None, ""), (None, " "), (2, None), (3, "a lone text")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, text_key string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == [(0, ""), (0, ""), (0, " "), (0, "quite another text of some length stands here"), (1, words), (2, ""), (3, "a lone text")]
