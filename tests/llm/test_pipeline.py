"""The pipeline's stages on a small corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import awkward, brute
from sigloom.llm.minhash_dedup import shingles
from sigloom.llm.storage import Workspace, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = table(spark, SF, "documents")
    good = table(spark, SF, "labels").where("quality = 1").select("doc_id")
    columns, space = docs.columns, Workspace(spark, "stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = space.cut(stage(spark, docs, SF), str(k))
        assert out.columns == columns and 0 < out.count() <= docs.count(), name
        gone = docs.join(out.select("doc_id"), "doc_id", "left_anti")
        if k == 0:
            assert gone.join(good, "doc_id", "left_semi").count() == 0
        if k == 2:
            want = brute({r.doc_id: set(shingles(r.text, 5).tolist()) for r in docs.collect()}, 80)
            assert {r.doc_id for r in out.select("doc_id").collect()} == {a for a, b in want.items() if a == b}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).agg(F.max("length")).first()[0] <= 2048
