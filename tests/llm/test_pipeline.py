import os

import pytest

import corpus_pipeline
from barloom.llm import novelty, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert out.columns == columns, name
        if name.startswith(("quality", "SimHash")):
            assert 0.5 * kept < out.count() <= kept
            kept = out.count()
        if name.startswith("secret"):
            assert out.count() == kept
            assert not [r for r in out.collect() if novelty.all_spans(r["text"])[0]]
        docs = out


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:2] == ["doc_id", "sample"] and rows.count() > 100
    first = sorted((r["doc_id"], r["sample"], r["n_pieces"]) for r in rows.collect())
    assert first == sorted((r["doc_id"], r["sample"], r["n_pieces"]) for r in corpus_pipeline.run(spark, SF).collect())


def test_stages_handle_odd_rows(spark, docs, corpus):
    odd = [(500, None), (501, ""), (502, " \n\t "), (None, None), (None, "no id " * 30), (500, None)]
    frame = docs([*corpus, *odd])
    for rows, least in ((frame, 1), (docs([]), 0), (docs(odd), 0)):
        own = rows
        for name, stage in corpus_pipeline.STAGES:
            # Each stage alone on all rows, and in turn on what the one before it left.
            alone = stage(spark, rows, SF)
            own = spark.createDataFrame(stage(spark, own, SF).collect(), alone.schema)
            if not name.startswith("SentencePiece"):
                assert alone.columns == own.columns == rows.columns, name
                assert own.count() <= alone.count(), name
        assert own.count() >= least


TABLES = {"op2": "pages", "op12": "conversations", "op13": "embeddings"}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_cover_their_table(spark, name):
    rows = queries.QUERIES[name](spark, SF).count()
    table = spark.read.parquet(f"{SF}/{TABLES.get(name.split('_')[0], 'documents')}.parquet")
    whole = table.select("conv_id").distinct().count() + 1 if name.startswith("op12_") else table.count()
    assert rows == whole if not name.startswith("op5_") else whole <= rows <= 2 * whole
