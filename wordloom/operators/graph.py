"""Relational graph operators: orientation, degrees, adjacency, depths, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.present import label
from ..storage import materialise


def project_nodes(vertices: DataFrame) -> DataFrame:
    """id, label, word, lang, root (the vertex at position 0)."""
    return vertices.select(F.col("v_id").cast("string").alias("id"), label(F.col("word"), F.col("lang")).alias("label"), "word", "lang", (F.col("pos") == 0).alias("root"))


def orient_edges(tuples: DataFrame) -> DataFrame:
    """source, target, pos; a multiset. A null flag counts as false."""
    flag = F.coalesce(F.col("is_p"), F.lit(False))
    e, n = F.col("e_id").cast("string"), F.col("n_id").cast("string")
    return tuples.select(F.when(flag, e).otherwise(n).alias("source"), F.when(flag, n).otherwise(e).alias("target"), "pos")


def dedup_edges(edges: DataFrame, concat_key: bool = False) -> DataFrame:
    """One row per pair with its first position, or, with ``concat_key``, the first edge of
    each concatenation of source and target."""
    if not concat_key:
        return edges.groupBy("source", "target").agg(F.min("pos").alias("pos"))
    first = F.row_number().over(Window.partitionBy(F.concat("source", "target")).orderBy("pos"))
    return edges.withColumn("rank", first).where("rank = 1").drop("rank")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def adjacency(nodes: DataFrame, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """id, neighbours: sorted, with repetitions, empty for isolated nodes."""
    a, b = ("target", "source") if reverse else ("source", "target")
    lists = edges.groupBy(F.col(a).alias("id")).agg(F.sort_array(F.collect_list(b)).alias("neighbours"))
    return nodes.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))


def flatten_adjacency(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("id").alias("source"), F.explode("neighbours").alias("target"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbour pairs (a, b) in both directions."""
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).distinct()


def bfs_depths(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """``nodes`` with depth: steps from the root along edges of either direction, null where
    unreached. Each round expands the frontier only; ids alone travel. ``most`` stops early."""
    both = materialise(undirected(edges), "both")
    front = nodes.where("root").select("id")
    levels = front.withColumn("depth", F.lit(0))
    depth = 0
    while most is None or depth < most:
        depth += 1
        step = front.join(both, front["id"] == both["a"]).select(F.col("b").alias("id")).distinct()
        front = materialise(step.join(levels, "id", "left_anti"), "front")
        if front.isEmpty():
            break
        levels = levels.unionByName(front.withColumn("depth", F.lit(depth)))
    return nodes.drop("depth").join(levels, "id", "left")


def depth_overrun(nodes: DataFrame, expected: int = 4) -> DataFrame:
    return nodes.where(F.col("depth") > expected)


def within_depth(depth: Column, most: int) -> Column:
    """Unreached nodes and the root always pass."""
    return depth.isNull() | (depth == 0) | (depth <= most)


def restrict_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def _thin(nodes: DataFrame, collect_lang: str) -> DataFrame:
    """id, safe: what pruning has to know of a node; rounds carry nothing else."""
    return nodes.select("id", F.coalesce(F.col("root") | (F.col("lang") == collect_lang), F.lit(False)).alias("safe"))


def _round(thin: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    degree = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    keep = F.col("safe") | (F.coalesce("o", F.lit(0)) > 0) | (F.coalesce("i", F.lit(0)) > 1)
    kept = materialise(thin.join(degree, "id", "left").where(keep).select("id", "safe"), "kept")
    return kept, materialise(restrict_edges(edges, kept), "edges")


def prune(nodes: DataFrame, edges: DataFrame, collect_lang: str, rounds: int) -> tuple[DataFrame, DataFrame]:
    """``rounds`` rounds; without any, edges are still restricted to the nodes. A round keeps the root,
    the collected language, what has an outgoing edge, and what has two incoming ones or more; degrees
    are those of the edges as they come."""
    if rounds == 0:
        return nodes, restrict_edges(edges, nodes)
    thin = _thin(nodes, collect_lang)
    for _ in range(rounds):
        thin, edges = _round(thin, edges)
    return nodes.join(thin.select("id"), "id", "left_semi").select(nodes.columns), edges


def prune_fixpoint(nodes: DataFrame, edges: DataFrame, collect_lang: str) -> tuple[DataFrame, DataFrame]:
    """Rounds until nothing goes any more; pruning is monotone, so counts tell. The first round may
    leave the nodes and still restrict the edges, so both are counted."""
    thin, before = _thin(nodes, collect_lang), None
    while True:
        thin, edges = _round(thin, edges)
        now = (thin.count(), edges.count())
        if now == before:
            return nodes.join(thin.select("id"), "id", "left_semi").select(nodes.columns), edges
        before = now
