"""The operators' queries over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, line_dedup, media, mixing, near_dedup, packing, token_count, token_orc, toxicity
from .common import documents, fold, labels, new_path
from .pieces import default_path


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), threshold=0.85)


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens-orc")
    token_orc.write_tokens(documents(spark, sf_dir), path, default_path("byte_bpe_50k.json"), end_id=2)
    return token_orc.token_table(spark, path)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(documents(spark, sf_dir), new_path(spark, "media"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rated = documents(spark, sf_dir), labels(spark, sf_dir)
    weights = toxicity.train(docs, rated.where(fold("doc_id", 5) != 0))
    out = toxicity.score(docs, weights)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir), counts=("n_lines", "n_deleted"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_deleted", F.char_length(text).cast("long").alias("n_chars_left"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(fold("doc_id", 4) != 2))
    out = langid.predict(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), default_path("word_bpe_49k.json"), end_id=1, room=4096)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), default_path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_token_orc, op3_exact_dedup, op4_media, op5_toxicity, op6_line_dedup, op7_langid, op8_packing, op9_mixing, op10_token_count)}

ORACLE = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, s.sh""",
    "op3_exact_dedup": """
WITH k AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM k WINDOW g AS (PARTITION BY text_sha256)""",
}
