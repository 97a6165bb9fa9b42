"""Sources and sinks: JSON responses, literal responses, neighbourhoods of tables, element tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGE_TUPLE, LANGUAGES, RESPONSE_JSON, VERTEX, GraphInputError
from ..storage import materialise


def decode_vertices(responses: DataFrame, body: str = "body") -> DataFrame:
    """pos, v_id, word, lang: the vertices of a JSON response, in their order."""
    parsed = responses.select(F.from_json(body, RESPONSE_JSON).alias("r"))
    at = parsed.select(F.posexplode("r.vertices").alias("pos", "v"))
    return at.select(F.col("pos").cast("long").alias("pos"), F.col("v")[0].cast("long").alias("v_id"), F.col("v")[1].alias("word"), F.col("v")[2].alias("lang"))


def decode_edges(responses: DataFrame, body: str = "body") -> DataFrame:
    """pos, e_id, n_id, is_p of a JSON response."""
    parsed = responses.select(F.from_json(body, RESPONSE_JSON).alias("r"))
    at = parsed.select(F.posexplode("r.edges").alias("pos", "e"))
    return at.select(F.col("pos").cast("long").alias("pos"), F.col("e")[0].cast("long").alias("e_id"), F.col("e")[1].cast("long").alias("n_id"), F.col("e")[2].cast("boolean").alias("is_p"))


def encode_request(word: Column, lang: Column, n: Column) -> Column:
    return F.to_json(F.struct(word.alias("word"), lang.alias("lang"), n.alias("n")))


def encode_response(vertices: DataFrame, edges: DataFrame, key: str | None = None) -> DataFrame:
    """One row with a JSON body; for graphs of the size of one response only. With ``key``, a
    column of both, a row for each of its values, with ``key`` and the body of its vertices and edges."""
    by = [key] if key else []
    v = vertices.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", F.array(F.col("v_id").cast("string"), "word", "lang").alias("x")))).alias("v"))
    e = edges.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", F.array(F.col("e_id").cast("string"), F.col("n_id").cast("string"), F.col("is_p").cast("string")).alias("x")))).alias("e"))
    both = v.join(e, key, "full") if key else v.crossJoin(e)
    return both.select(*by, F.to_json(F.struct(F.col("v.x").alias("vertices"), F.col("e.x").alias("edges"))).alias("body"))


def literal_response(spark: SparkSession, vertices, edges) -> tuple[DataFrame, DataFrame]:
    """A response given in the program: lists of (id, word, lang) and (e, n, is_p)."""
    v = spark.createDataFrame([(i, *x) for i, x in enumerate(vertices)], VERTEX)
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], EDGE_TUPLE)
    return v, e


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES.items()), "code string, name string")


def neighborhood(vertices: DataFrame, edges: DataFrame, word: str, lang: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The vertices at most ``n`` undirected steps from (word, lang), with ``hop``, and the edge tuples among them."""
    both = edges.select(F.col("e_id").alias("a"), F.col("n_id").alias("b")).unionByName(edges.select(F.col("n_id").alias("a"), F.col("e_id").alias("b"))).distinct()
    seen = front = vertices.where((F.col("word") == word) & (F.col("lang") == lang)).select("v_id", F.lit(0).alias("hop"))
    for hop in range(1, n + 1):
        step = front.join(both, F.col("v_id") == F.col("a")).select(F.col("b").alias("v_id")).distinct()
        front = materialise(step.join(seen, "v_id", "left_anti").withColumn("hop", F.lit(hop)), "front")
        seen = seen.unionByName(front)
    seen = materialise(seen, "seen")
    near = vertices.join(seen, "v_id")
    ids = seen.select("v_id")
    kept = edges.join(ids.withColumnRenamed("v_id", "e_id"), "e_id", "left_semi").join(ids.withColumnRenamed("v_id", "n_id"), "n_id", "left_semi")
    return near, kept


def validate(vertices: DataFrame, edges: DataFrame) -> None:
    """Raise GraphInputError unless vertices are there, unique and named, and every edge's ends are listed."""
    if vertices.isEmpty():
        raise GraphInputError("no vertices")
    if not vertices.where("v_id is null or word is null or lang is null").isEmpty():
        raise GraphInputError("a vertex lacks its id, word or language")
    if not vertices.groupBy("v_id").count().where("count > 1").isEmpty():
        raise GraphInputError("a vertex id is listed twice")
    ends = edges.select(F.col("e_id").alias("v_id")).union(edges.select("n_id"))
    if not ends.join(vertices, "v_id", "left_anti").isEmpty():
        raise GraphInputError("an edge ends in a vertex that isn't listed")


def write_elements(elements: DataFrame, path: str, replace: bool = False) -> None:
    """The element table as Parquet, nodes before edges, each in the order of its ids: created, or put in the place of what is there."""
    elements.orderBy(F.col("kind").desc(), "id", "source", "target").write.mode("overwrite" if replace else "errorifexists").parquet(path)
