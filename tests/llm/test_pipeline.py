"""The pipeline's stages on the smallest tables, each against what its own input says."""

from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns
        if name != "mixing":
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
            assert docs.count() == docs.select("doc_id").distinct().count()
        seen[name] = docs.count()
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    got = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert got.where("n > 4096 or n <> end").isEmpty()
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows, an empty table: no stage fails, and rows stay as the docstrings say."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "", None, None, 0), (3, "a b c d e f", None, "t", None), (4, None, "de", "s", None)]
    for given, last in ((rows, 4), ([], 0)):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF), name)
            ids = sorted(str(r["doc_id"]) for r in docs.collect())
            if given and name in ("toxicity", "line_dedup"):
                assert ids == ["1", "1", "2", "3", "4", "None"]
            if given and name == "near_dedup":
                assert ids == ["1", "1", "2", "4", "None"]
        assert given or ids == []
