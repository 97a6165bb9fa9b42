"""Word graphs made of the driver's tables by fixed arithmetic.

DOC: documents are vertices (first word, language), each a child of document
(d - 1) div 3, with shortcuts from grandparents and great-grandparents, some back
edges and some repeated tuples; every 37th document has no edge to a parent.
HANDOFF: the user of an event to the user of the next, in blocks of 20 consecutive events; a vertex is a
user in a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def doc_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    word = F.split(F.coalesce("text", F.lit("")), r"[ \n]")[0]
    return d.select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("v_id"), word.alias("word"), F.coalesce("lang", F.lit("und")).alias("lang"))


def doc_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("d")).where("d > 0 and d % 37 <> 0")
    d = d.withColumn("p", F.expr("(d - 1) div 3"))
    d = d.withColumn("g", F.expr("case when p > 0 then (p - 1) div 3 end")).withColumn("gg", F.expr("case when g > 0 then (g - 1) div 3 end"))
    edges = F.array(
        F.struct(F.lit(0).alias("k"), F.col("p").alias("s"), F.col("d").alias("t")),
        F.when(F.expr("d % 5 = 0 and g is not null"), F.struct(F.lit(1).alias("k"), F.col("g").alias("s"), F.col("d").alias("t"))),
        F.when(F.expr("d % 7 = 0 and gg is not null"), F.struct(F.lit(2).alias("k"), F.col("gg").alias("s"), F.col("d").alias("t"))),
        F.when(F.expr("d % 50 = 0"), F.struct(F.lit(3).alias("k"), F.col("d").alias("s"), F.coalesce("g", F.lit(0).cast("long")).alias("t"))),
        F.when(F.expr("d % 6 = 0"), F.struct(F.lit(4).alias("k"), F.col("p").alias("s"), F.col("d").alias("t"))),
    )
    e = d.select("d", F.explode(F.filter(edges, lambda x: x.isNotNull())).alias("e"))
    flag = F.col("d") % 4 == 0
    return e.select((F.col("d") * 8 + F.col("e.k")).alias("pos"), F.when(flag, F.col("e.s")).otherwise(F.col("e.t")).alias("e_id"), F.when(flag, F.col("e.t")).otherwise(F.col("e.s")).alias("n_id"), flag.alias("is_p"))


def handoffs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). The event before has the id less by one, so this is a join, not a global window."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.expr("event_id div 20").alias("block"))
    e = e.withColumn("id", F.concat_ws("@", F.col("user_id").cast("string"), F.col("block").cast("string")))
    before = e.select((F.col("event_id") + 1).alias("event_id"), "block", F.col("id").alias("source"))
    edges = e.join(before, ["event_id", "block"]).where("source <> id").select("source", F.col("id").alias("target"), F.col("event_id").alias("pos"))
    return e.select("id").distinct(), edges


#: First letters of the parts graph's vertices: order, part, supplier.
PART_KINDS = "ops"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges: order to part (first line only), part to supplier, order to supplier. A vertex is one long, its key
    times 4 and its kind's place; as text the edges would take three times the disk. Keys must be below 2^61."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    o, p, s = (F.col(k).cast("long") * 4 + i for i, k in enumerate(("l_orderkey", "l_partkey", "l_suppkey")))
    edges = l.where("l_linenumber = 1").select(o.alias("source"), p.alias("target")).union(l.select(p, s)).union(l.select(o, s))
    return edges.repartition("source").distinct().sortWithinPartitions("source", "target")  # a source's edges lie together, which packs well


def part_name(vertex: str) -> Column:
    """The vertex as text: "o", "p" or "s" and the key."""
    kind = F.substring(F.lit(PART_KINDS), F.col(vertex).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))
    return F.concat(kind, F.shiftright(vertex, 2).cast("string"))


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, word, lang: each event's user clicks the node of document (event_id div 30) modulo the number of documents."""
    v = doc_vertices(spark, sf_dir)
    n = F.broadcast(v.agg(F.count(F.lit(1)).alias("n")))  # one row
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id").join(n)
    e = e.select("event_id", "user_id", F.expr("(event_id div 30) % n").alias("v_id"))
    return e.join(v.select("v_id", "word", "lang"), "v_id")


DOC_SQL = r"""
v AS (SELECT doc_id AS v_id, regexp_extract(coalesce(text, ''), '^([^ \n]*)', 1) AS word, coalesce(lang, 'und') AS lang FROM documents),
d0 AS (SELECT doc_id AS d, (doc_id - 1) // 3 AS p FROM documents WHERE doc_id > 0 AND doc_id % 37 <> 0),
d1 AS (SELECT d, p, CASE WHEN p > 0 THEN (p - 1) // 3 END AS g FROM d0),
d2 AS (SELECT d, p, g, CASE WHEN g > 0 THEN (g - 1) // 3 END AS gg FROM d1),
o AS (
  SELECT d * 8 AS pos, p AS s, d AS t FROM d2
  UNION ALL SELECT d * 8 + 1, g, d FROM d2 WHERE d % 5 = 0 AND g IS NOT NULL
  UNION ALL SELECT d * 8 + 2, gg, d FROM d2 WHERE d % 7 = 0 AND gg IS NOT NULL
  UNION ALL SELECT d * 8 + 3, d, coalesce(g, 0) FROM d2 WHERE d % 50 = 0
  UNION ALL SELECT d * 8 + 4, p, d FROM d2 WHERE d % 6 = 0),
nodes AS (SELECT v_id::VARCHAR AS id, word || ' (' || lang || ')' AS label, word, lang, v_id = 0 AS root FROM v),
oriented AS (SELECT s::VARCHAR AS source, t::VARCHAR AS target, pos FROM o),
dedup AS (SELECT source, target, min(pos) AS pos FROM oriented GROUP BY ALL)
"""
HANDOFF_SQL = """
h AS (SELECT event_id, event_id // 20 AS block, user_id || '@' || (event_id // 20) AS id FROM events),
oriented AS (SELECT b.id AS source, e.id AS target, e.event_id AS pos
  FROM h e JOIN h b ON b.event_id = e.event_id - 1 AND b.block = e.block WHERE b.id <> e.id),
nodes AS (SELECT DISTINCT id FROM h)
"""
PARTS_SQL = """
l AS (SELECT 'o' || l_orderkey AS o, 'p' || l_partkey AS p, 's' || l_suppkey AS s, l_linenumber AS n FROM lineitem),
oriented AS (SELECT o AS source, p AS target FROM l WHERE n = 1 UNION SELECT p, s FROM l UNION SELECT o, s FROM l),
nodes AS (SELECT source AS id FROM oriented UNION SELECT target FROM oriented)
"""
