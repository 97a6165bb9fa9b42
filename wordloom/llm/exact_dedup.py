"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary (Spark's ``freqItems``: the Karp-Schenker-Papadimitriou
form of it, 1/support counters a task) finds digests that may be frequent.
Their exact counts and winners are verified over all rows; those are at most
1/support rows, so they are broadcast and their copies are settled map-side.
All other digests take the ordinary shuffle, where no group is large.

Only DataFrame functions run here. Cases: a null text is an empty text; all
empty texts are equal; of rows with equal ids and texts each is its group's
row, and ``kept`` is true for every row that has the largest id; null ids never
win over others, and a group of null ids alone has a null ``keep_id`` and keeps
none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``support``: share of all rows from which a digest counts as frequent; the
    broadcast holds at most 1/support rows.
    """
    keyed = materialise(docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256).alias("text_sha256")), "digests")
    stats = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    summary = keyed.stat.freqItems(["text_sha256"], support)
    maybe = materialise(summary.select(F.explode("text_sha256_freqItems").alias("text_sha256")), "candidates")
    total = keyed.agg(F.count(F.lit(1)).alias("n"))
    verified = keyed.join(F.broadcast(maybe), "text_sha256").groupBy("text_sha256").agg(*stats)
    heavy = materialise(verified.join(F.broadcast(total), F.col("group_size") > F.col("n") * support).drop("n"), "heavy")
    frequent = keyed.join(F.broadcast(heavy), "text_sha256")
    rest = keyed.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    ordinary = rest.join(rest.groupBy("text_sha256").agg(*stats), "text_sha256")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept")
    columns = (F.col("doc_id").alias(id_col), "keep_id", "group_size", kept, "text_sha256")
    return frequent.select(*columns).unionByName(ordinary.select(*columns))
