"""The corpus pipeline: toxicity, line dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Labels are used for training alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import line_dedup, mixing, near_dedup, packing, toxicity
from wordloom.llm.common import fold, labels, materialise, split_marked
from wordloom.llm.pieces import default_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts score 0 and stay, repeated rows share their fate;
    with no labels, or none left to learn from, every document stays."""
    weights = toxicity.train(docs, labels(spark, sf_dir).where(fold("doc_id", 5) != 0))
    return toxicity.filter_toxic(docs, weights)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from later documents; a document that is nothing but repeated goes.
    Null and empty texts stay as they are; rows with a null id are neither changed nor first."""
    out = line_dedup.dedup_lines(docs, counts=("n_lines__", "n_deleted__"))
    out = out.where((F.col("n_deleted__") == 0) | (F.coalesce("text", F.lit("")) != ""))
    changed = F.when(F.col("n_deleted__") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. Rows go by
    id: all rows that have the id of a document to drop go, rows with a null id stay, and so do texts without words."""
    groups = near_dedup.near_duplicates(docs, threshold=0.8)
    gone = materialise(groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone__")), "gone")
    maybe, kept = split_marked(docs, "doc_id", gone, "gone__")  # texts that certainly stay aren't shuffled
    return maybe.join(gone, F.col("doc_id") == F.col("gone__"), "left_anti").unionByName(kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece; null and empty texts have the end id alone, copies are packed each."""
    return packing.pack(docs, default_path("word_bpe_49k.json"), end_id=1, room=4096, lean=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the trained classifier, the alignment or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
