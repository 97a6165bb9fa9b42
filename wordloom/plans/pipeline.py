"""The two steps of a query: normalise a response, refine the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import bfs_depths, dedup_edges, orient_edges, project_nodes, prune, within_depth
from ..operators.reduction import transitive_reduction
from ..schema import Graph, GraphQuery
from ..sources.responses import neighborhood, validate
from ..storage import materialise


def normalize(vertices: DataFrame, tuples: DataFrame, check: bool = True) -> Graph:
    """Nodes with labels and depths; oriented edges as a multiset."""
    if check:
        validate(vertices, tuples)
    edges = materialise(orient_edges(tuples), "oriented")
    return Graph(materialise(bfs_depths(project_nodes(vertices), edges), "nodes"), edges)


def search(vertices: DataFrame, tuples: DataFrame, query: GraphQuery) -> Graph:
    """The normalised neighbourhood of the query's word; the word's vertex is the root, as it comes first."""
    query.checked()
    near, kept = neighborhood(vertices, tuples, query.word, query.lang, query.branching)
    near = near.withColumn("pos", F.when(F.col("hop") == 0, 0).otherwise(F.col("pos") + 1)).drop("hop")
    return normalize(materialise(near, "vertices"), materialise(kept, "tuples"))


def refine(graph: Graph, query: GraphQuery, mode: str = "two_hop", concat_key: bool = False) -> Graph:
    """Depth filter, edge dedup and pruning, all skipped where no node has the collected language; then reduction."""
    query.bounded()
    nodes, edges = graph.nodes, graph.edges
    if not nodes.where(F.col("lang") == query.collect_lang).isEmpty():
        nodes = nodes.where(within_depth(F.col("depth"), query.branching))
        nodes, edges = prune(nodes, dedup_edges(edges, concat_key), query.collect_lang, query.pruning)
    if query.do_tr:
        edges = transitive_reduction(nodes, edges, mode)
    return Graph(nodes, edges)
