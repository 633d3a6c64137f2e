import os

import corpus_pipeline
import pytest
from tests.conftest import SF_SMALL
from tests.llm.helpers import AWKWARD, docs_of


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables with cases that each stage must catch, among clean documents."""
    folder = str(tmp_path_factory.mktemp("tables"))
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    item = " ".join(f"question{k}" for k in range(30))
    clean = " ".join(f"clean{k}" for k in range(80))
    extra = [(9001, clean), (9002, clean.upper()), (9003, clean + " more"), (9004, item), (9005, 'token = "' + "0a1b2c3d4e" * 4 + '" stays')]
    rows = [*((r.doc_id, r.text) for r in base), *extra]
    docs_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{SF_SMALL}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows)


def test_stages_in_turn(spark, planted):
    folder, texts = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.dtypes == docs.dtypes, name
            path = os.path.join(folder, f"stage{k}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        counts.append(out.count())
        docs = out
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if k >= 1:
            assert 9001 in ids and 9002 not in ids and 9003 not in ids
        if k >= 2:
            assert 9004 not in ids
        if k == 3:
            assert docs.where("doc_id = 9005").first().text == 'token = "[SECRET]" stays'
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[3] == counts[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == ids


def test_stages_on_awkward_and_empty_tables(spark, planted):
    folder, _ = planted
    for rows in (AWKWARD, []):
        docs = docs_of(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, folder).collect()
