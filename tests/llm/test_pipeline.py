"""The pipeline's stages: what each keeps, and that decisions of one reach the next."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftlog.llm import bpe, catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.when(F.col("doc_id") % 2 == 0, "123 ---")})
    docs = docs.unionByName(extra)
    seen = {"start": {r["doc_id"] for r in docs.collect()}}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns
        seen[name] = {r["doc_id"] for r in at.select("doc_id").collect()}
    order = ["start", "language_id", "exact_dedup", "ngram_jaccard", "source_mixing"]
    assert all(seen[a] >= seen[b] for a, b in zip(order, order[1:]))
    assert seen["start"] - seen["language_id"] == {r["doc_id"] for r in extra.collect()}
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["text"] or "", []).append(r["doc_id"])
    assert seen["exact_dedup"] == {max(ids) for t, ids in texts.items()} & seen["language_id"]
    last = corpus_pipeline.STAGES[4][1](spark, at, SF)
    assert last.count() == at.count()
    assert last.exceptAll(bpe.bpe_table(at)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_catalogue_names_each_operator_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalogue.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and set(catalogue.oracle_sql()) <= set(catalogue.queries())
