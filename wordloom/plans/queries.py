"""Queries for every operator over the bound graphs, with DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import present
from ..operators import graph as g
from ..operators import reduction as r
from ..schema import LANGUAGES, Graph, GraphQuery
from ..sources import responses
from ..storage import materialise
from . import bindings as b
from .pipeline import normalize, refine

BRANCHING, COLLECT = 4, "es"
#: Raw values of a number field.
PARAMETERS = ("3", " 4 ", "", "  ", "x", None, "3.5", "1e1", "-2", ".5", "5.", "0x1F", "3d", "1 2")


def _doc(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return g.project_nodes(b.doc_vertices(spark, sf)), g.orient_edges(b.doc_tuples(spark, sf))


def _normal(spark: SparkSession, sf: str) -> Graph:
    return normalize(b.doc_vertices(spark, sf), b.doc_tuples(spark, sf))


def _depths(spark: SparkSession, sf: str) -> DataFrame:
    return g.bfs_depths(*_doc(spark, sf))


def _near(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _doc(spark, sf)
    nodes = materialise(g.bfs_depths(nodes, edges).where(g.within_depth(F.col("depth"), BRANCHING)), "near")
    return nodes, g.dedup_edges(edges)


def _pruned(rounds: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        nodes, edges = _near(spark, sf)
        nodes, edges = g.prune(nodes, edges, COLLECT, rounds) if rounds >= 0 else g.prune_fixpoint(nodes, edges, COLLECT)
        return _rows(nodes, edges)

    return run


def _rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).union(edges.select(F.lit("edge"), "source", "target"))


def _handoff_scc(spark: SparkSession, sf: str):
    nodes, edges = b.handoffs(spark, sf)
    edges = materialise(edges, "handoffs")
    nodes = materialise(nodes, "users")
    return nodes, edges, materialise(r.scc(nodes, edges), "scc")


def _doc_scc(spark: SparkSession, sf: str):
    nodes, edges = _doc(spark, sf)
    edges = materialise(g.dedup_edges(edges), "edges")
    return nodes, edges, materialise(r.scc(nodes, edges), "scc")


def _tr(binding, mode: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        nodes, edges = binding(spark, sf)
        return r.transitive_reduction(nodes, edges, mode)

    return run


def _doc_dedup(spark, sf):
    nodes, edges = _doc(spark, sf)
    return nodes, materialise(g.dedup_edges(edges), "edges")


def refine_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    out = refine(_normal(spark, sf), GraphQuery(collect_lang=COLLECT, branching=BRANCHING, pruning=2))
    return _rows(out.nodes, out.edges)


def guard_absent_lang(spark: SparkSession, sf: str) -> DataFrame:
    out = refine(Graph(*_doc(spark, sf)), GraphQuery(collect_lang="xx", branching=BRANCHING, do_tr=False))
    return _rows(out.nodes, out.edges)


def neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    v, e = b.doc_vertices(spark, sf), b.doc_tuples(spark, sf)
    seed = v.where("v_id = 40").first()
    near, kept = responses.neighborhood(v.where((F.col("word") != seed["word"]) | (F.col("lang") != seed["lang"]) | (F.col("v_id") == 40)), e, seed["word"], seed["lang"], 2)
    return near.select("v_id", "hop")


def doc_responses(spark: SparkSession, sf: str) -> DataFrame:
    """A response for each document: the edge tuples made of it, their ends and itself."""
    v, e = b.doc_vertices(spark, sf), b.doc_tuples(spark, sf).withColumn("of", F.expr("pos div 8"))
    ends = v.select(F.col("v_id").alias("of"), "v_id").union(e.select("of", "e_id")).union(e.select("of", "n_id")).distinct()
    return responses.encode_response(v.join(ends, "v_id"), e, "of")


def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return responses.decode_edges(doc_responses(spark, sf))


def conversations_requests(spark: SparkSession, sf: str) -> DataFrame:
    body = responses.encode_request(F.col("word"), F.col("lang"), F.lit(2))
    return b.doc_vertices(spark, sf).select("v_id", body.alias("body"))


def param_parse(spark: SparkSession, sf: str) -> DataFrame:
    """n is null where the field is no number."""
    t = spark.createDataFrame([(x,) for x in PARAMETERS], "raw string")
    return t.select("raw", F.nanvl(present.parse_number(F.col("raw")), F.lit(None).cast("double")).alias("n"))


def search_enabled(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame([("joy", False), ("joy", True), ("", False), (None, False)], "word string, loading boolean")
    return t.select("word", "loading", present.search_enabled(F.col("word"), F.col("loading")).alias("enabled"))


def refetch_needed(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame([(1, None), (2, 2), (3, 2), (1, 4)], "requested int, fetched int")
    return t.select("requested", "fetched", present.refetch_needed(F.col("requested"), F.col("fetched")).alias("refetch"))


def graph_elements(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _doc(spark, sf)
    return present.elements(g.bfs_depths(nodes, edges), edges)


def adjacency_flat(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _doc(spark, sf)
    return g.flatten_adjacency(g.adjacency(nodes, edges))


def handoff_scc_sizes(spark, sf):
    return _handoff_scc(spark, sf)[2].groupBy("scc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def condensed_edges(spark, sf):
    _, edges, labels = _doc_scc(spark, sf)
    return r.condensed_pairs(r.condense(edges, labels))


def condensed_edge_provenance(spark, sf):
    _, edges, labels = _doc_scc(spark, sf)
    return r.condense(edges, labels).where("scc_from <> scc_to").groupBy("scc_from", "scc_to").agg(F.count(F.lit(1)).alias("n_edges"))


def condensed_edge_originals(spark, sf):
    _, edges, labels = _doc_scc(spark, sf)
    return r.originals(r.condense(edges, labels)).select("scc_from", "scc_to", F.array_join("originals", ",").alias("originals"))


def intra_scc_edges(spark, sf):
    _, edges, labels = _handoff_scc(spark, sf)
    large = labels.groupBy(F.col("scc_id").alias("scc_from")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return r.condense(edges, labels).where("scc_from = scc_to").join(large, "scc_from", "left_semi").select("source", "target")


def scc_members(spark, sf):
    labels = _handoff_scc(spark, sf)[2]
    return labels.groupBy("scc_id").agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("members")).where("members like '%,%'")


def topo_level(spark, sf):
    _, edges, labels = _doc_scc(spark, sf)
    return r.topo_levels(materialise(r.condensed_pairs(r.condense(edges, labels)), "dag"), labels)


def url_change_log(spark, sf):
    return present.url_changes(present.with_urls(b.click_log(spark, sf)), "event_id", "user_id").select("event_id", "user_id", "url")


def tr_two_hop_parts(spark: SparkSession, sf: str) -> DataFrame:
    edges = materialise(b.parts(spark, sf), "edges", clean=True)
    loose = edges.where("source is null or target is null")  # no path has them, so they stay
    out = r.transitive_reduction(None, edges, "two_hop").unionByName(loose)
    return out.select(*(b.part_name(end).alias(end) for end in ("source", "target")))


QUERIES = {
    "node_projection": lambda s, d: _doc(s, d)[0],
    "edge_orientation": lambda s, d: _doc(s, d)[1].select("source", "target"),
    "edge_dedup": lambda s, d: g.dedup_edges(_doc(s, d)[1]),
    "edge_dedup_concat_key": lambda s, d: g.dedup_edges(_doc(s, d)[1], concat_key=True),
    "in_degree": lambda s, d: g.in_degree(g.dedup_edges(_doc(s, d)[1])),
    "out_degree": lambda s, d: g.out_degree(g.dedup_edges(_doc(s, d)[1])),
    "adjacency_forward": lambda s, d: g.adjacency(*_doc(s, d)).select("id", F.array_join("neighbours", ",").alias("neighbours")),
    "adjacency_reverse": lambda s, d: g.adjacency(*_doc(s, d), reverse=True).select("id", F.array_join("neighbours", ",").alias("neighbours")),
    "adjacency_flat": adjacency_flat,
    "collect_lang_count": lambda s, d: _doc(s, d)[0].agg(F.count_if(F.col("lang") == COLLECT).alias("n")),
    "bfs_depth": lambda s, d: _depths(s, d).select("id", "depth"),
    "depth_overrun": lambda s, d: g.depth_overrun(_depths(s, d)).select("id", "depth"),
    "depth_filter": lambda s, d: _near(s, d)[0].select("id", "depth"),
    "edge_restriction": _pruned(0),
    "prune_round_1": _pruned(1),
    "prune_round_2": _pruned(2),
    "prune_fixpoint": _pruned(-1),
    "prune_guard_absent_lang": guard_absent_lang,
    "scc_labels": lambda s, d: _doc_scc(s, d)[2],
    "scc_sizes": handoff_scc_sizes,
    "scc_members": scc_members,
    "condensed_edges": condensed_edges,
    "condensed_edge_provenance": condensed_edge_provenance,
    "topo_level": topo_level,
    "intra_scc_edges": intra_scc_edges,
    "tr_two_hop": _tr(_doc_dedup, "two_hop"),
    "tr_full": _tr(_doc_dedup, "full"),
    "tr_two_hop_handoff": _tr(b.handoffs, "two_hop"),
    "tr_full_handoff": _tr(b.handoffs, "full"),
    "tr_two_hop_parts": tr_two_hop_parts,
    "refine_pipeline": refine_pipeline,
    "neighborhood": neighborhood,
    "node_url": lambda s, d: present.with_urls(_doc(s, d)[0]).select("id", "name", "url"),
    "node_color": lambda s, d: _doc(s, d)[0].select("id", present.colour(F.col("root"), F.col("lang")).alias("colour")),
    "url_change_log": url_change_log,
    "graph_elements": graph_elements,
    "json_roundtrip": json_roundtrip,
    "json_request": conversations_requests,
    "refetch_needed": refetch_needed,
    "param_parse": param_parse,
    "search_enabled": search_enabled,
    "condensed_edge_originals": condensed_edge_originals,
    "proxy_path_rewrite": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", present.proxy_path(F.concat(F.lit("/api"), F.col("url"))).alias("path")),
}


def _sql(body: str, base: str = b.DOC_SQL) -> str:
    return f"WITH RECURSIVE {base}{body}"


_BFS = """,
und AS (SELECT source AS a, target AS b FROM oriented UNION SELECT target, source FROM oriented),
walk AS (SELECT id, 0 AS depth FROM nodes WHERE root UNION SELECT und.b, walk.depth + 1 FROM walk JOIN und ON und.a = walk.id WHERE walk.depth < 16),
depths AS (SELECT n.id, min(w.depth)::INTEGER AS depth FROM nodes n LEFT JOIN walk w ON w.id = n.id GROUP BY n.id)"""
_NEAR = f"""{_BFS},
n0 AS (SELECT n.* FROM nodes n JOIN depths d ON d.id = n.id WHERE d.depth IS NULL OR d.depth <= {BRANCHING}),
e0 AS (SELECT source, target FROM dedup)"""


def _round(i: int) -> str:
    return f""",
n{i} AS (SELECT * FROM n{i - 1} n WHERE root OR lang = '{COLLECT}' OR id IN (SELECT source FROM e{i - 1}) OR id IN (SELECT target FROM e{i - 1} GROUP BY target HAVING count(*) > 1)),
e{i} AS (SELECT * FROM e{i - 1} WHERE source IN (SELECT id FROM n{i}) AND target IN (SELECT id FROM n{i}))"""


def _rows_sql(n: str, e: str) -> str:
    return f" SELECT 'node' AS kind, id AS a, NULL::VARCHAR AS b FROM {n} UNION ALL SELECT 'edge', source, target FROM {e}"


def _scc_sql(edges: str, nodes: str = "nodes") -> str:
    return f""",
reach AS (SELECT source AS a, target AS b FROM {edges} UNION SELECT reach.a, e.target FROM reach JOIN {edges} e ON e.source = reach.b),
scc AS (SELECT n.id, least(n.id, coalesce(min(x.b), n.id)) AS scc_id FROM {nodes} n
  LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a) x ON x.a = n.id GROUP BY n.id),
sized AS (SELECT scc_id, count(*) AS n FROM scc GROUP BY scc_id),
cond AS (SELECT s.scc_id AS scc_from, t.scc_id AS scc_to, e.source, e.target FROM {edges} e JOIN scc s ON s.id = e.source JOIN scc t ON t.id = e.target),
dag AS (SELECT DISTINCT scc_from, scc_to FROM cond WHERE scc_from <> scc_to)"""


_TWO = ",\nfar AS (SELECT DISTINCT x.scc_from, y.scc_to FROM dag x JOIN dag y ON y.scc_from = x.scc_to)"
_FULL = ",\nfar AS (SELECT x.scc_from, y.scc_to FROM dag x JOIN dag y ON y.scc_from = x.scc_to UNION SELECT f.scc_from, y.scc_to FROM far f JOIN dag y ON y.scc_from = f.scc_to)"
_TR = """ SELECT source, target FROM cond JOIN sized ON sized.scc_id = scc_from WHERE scc_from = scc_to AND n > 1
UNION ALL SELECT source, target FROM cond c WHERE scc_from <> scc_to AND NOT EXISTS (SELECT 1 FROM far f WHERE f.scc_from = c.scc_from AND f.scc_to = c.scc_to)"""
_NAMES = "names(code, name) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in LANGUAGES.items()) + ")"
_URL = "CASE WHEN contains(name, 'Proto') THEN 'https://en.wiktionary.org/wiki/Reconstruction:' || name || '/' || word ELSE 'https://en.wiktionary.org/wiki/' || word || '#' || name END"
_LEVEL = ",\nlev AS (SELECT scc_id, 0 AS level FROM sized UNION SELECT d.scc_to, lev.level + 1 FROM lev JOIN dag d ON d.scc_from = lev.scc_id)"
_ELEMENTS = " SELECT 'node' AS kind, n.id, label, word, lang, root, depth, NULL::VARCHAR AS source, NULL::VARCHAR AS target FROM nodes n JOIN depths d ON d.id = n.id UNION ALL SELECT 'edge', NULL, NULL, NULL, NULL, NULL, NULL, source, target FROM oriented"

ORACLE = {
    "node_projection": _sql(" SELECT id, label, word, lang, root FROM nodes"),
    "edge_orientation": _sql(" SELECT source, target FROM oriented"),
    "edge_dedup": _sql(" SELECT source, target, pos FROM dedup"),
    "edge_dedup_concat_key": _sql(" SELECT source, target, pos FROM oriented QUALIFY row_number() OVER (PARTITION BY source || target ORDER BY pos) = 1"),
    "in_degree": _sql(" SELECT target AS id, count(*) AS in_degree FROM dedup GROUP BY target"),
    "out_degree": _sql(" SELECT source AS id, count(*) AS out_degree FROM dedup GROUP BY source"),
    "adjacency_forward": _sql(" SELECT id, coalesce(string_agg(target, ',' ORDER BY target), '') AS neighbours FROM nodes LEFT JOIN oriented ON source = id GROUP BY id"),
    "adjacency_reverse": _sql(" SELECT id, coalesce(string_agg(source, ',' ORDER BY source), '') AS neighbours FROM nodes LEFT JOIN oriented ON target = id GROUP BY id"),
    "adjacency_flat": _sql(" SELECT source, target FROM oriented"),
    "collect_lang_count": f"SELECT count(*) FILTER (lang = '{COLLECT}') AS n FROM documents",
    "bfs_depth": _sql(_BFS + " SELECT id, depth FROM depths"),
    "depth_overrun": _sql(_BFS + " SELECT id, depth FROM depths WHERE depth > 4"),
    "depth_filter": _sql(_NEAR + " SELECT n0.id, depth FROM n0 JOIN depths ON depths.id = n0.id"),
    "edge_restriction": _sql(_NEAR + ", e1 AS (SELECT * FROM e0 WHERE source IN (SELECT id FROM n0) AND target IN (SELECT id FROM n0))" + _rows_sql("n0", "e1")),
    "prune_round_1": _sql(_NEAR + _round(1) + _rows_sql("n1", "e1")),
    "prune_round_2": _sql(_NEAR + _round(1) + _round(2) + _rows_sql("n2", "e2")),
    "prune_fixpoint": _sql(_NEAR + "".join(_round(i) for i in range(1, 9)) + _rows_sql("n8", "e8")),
    "prune_guard_absent_lang": _sql(_rows_sql("nodes", "oriented")),
    "scc_labels": _sql(_scc_sql("dedup") + " SELECT id, scc_id FROM scc"),
    "scc_sizes": _sql(_scc_sql("oriented") + " SELECT scc_id, n FROM sized WHERE n > 1", b.HANDOFF_SQL),
    "scc_members": _sql(_scc_sql("oriented") + " SELECT scc_id, string_agg(id, ',' ORDER BY id) AS members FROM scc GROUP BY scc_id HAVING count(*) > 1", b.HANDOFF_SQL),
    "condensed_edges": _sql(_scc_sql("dedup") + " SELECT scc_from, scc_to FROM dag"),
    "condensed_edge_provenance": _sql(_scc_sql("dedup") + " SELECT scc_from, scc_to, count(*) AS n_edges FROM cond WHERE scc_from <> scc_to GROUP BY ALL"),
    "topo_level": _sql(_scc_sql("dedup") + _LEVEL + " SELECT scc_id, max(level)::INTEGER AS level FROM lev GROUP BY scc_id"),
    "intra_scc_edges": _sql(_scc_sql("oriented") + " SELECT source, target FROM cond JOIN sized ON sized.scc_id = scc_from WHERE scc_from = scc_to AND n > 1", b.HANDOFF_SQL),
    "tr_two_hop": _sql(_scc_sql("dedup") + _TWO + _TR),
    "tr_full": _sql(_scc_sql("dedup") + _FULL + _TR),
    "tr_two_hop_handoff": _sql(_scc_sql("oriented") + _TWO + _TR, b.HANDOFF_SQL),
    "tr_full_handoff": _sql(_scc_sql("oriented") + _FULL + _TR, b.HANDOFF_SQL),
    "tr_two_hop_parts": _sql(" SELECT source, target FROM oriented e WHERE NOT EXISTS (SELECT 1 FROM oriented x JOIN oriented y ON y.source = x.target WHERE x.source = e.source AND y.target = e.target)", b.PARTS_SQL),
    "refine_pipeline": _sql(_NEAR + _round(1) + _round(2) + _scc_sql("e2", "n2") + _TWO + f", kept AS ({_TR})" + _rows_sql("n2", "kept")),
    "neighborhood": _sql(""", und AS (SELECT s AS a, t AS b FROM o UNION SELECT t, s FROM o),
hops AS (SELECT 40::BIGINT AS v_id, 0 AS hop UNION SELECT und.b, hops.hop + 1 FROM hops JOIN und ON und.a = hops.v_id WHERE hops.hop < 2),
seed AS (SELECT * FROM v WHERE v_id = 40)
SELECT hops.v_id, min(hop)::INTEGER AS hop FROM hops JOIN v ON v.v_id = hops.v_id, seed WHERE hops.v_id = 40 OR v.word <> seed.word OR v.lang <> seed.lang GROUP BY hops.v_id"""),
    "node_url": _sql(f", {_NAMES} SELECT id, name, {_URL} AS url FROM nodes LEFT JOIN names ON code = lang"),
    "node_color": _sql(" SELECT id, CASE WHEN root THEN 'red' WHEN lang = 'en' THEN 'lightgreen' ELSE 'lightblue' END AS colour FROM nodes"),
    "url_change_log": _sql(f""", {_NAMES}, c AS (SELECT event_id, user_id, {_URL} AS url FROM events JOIN v ON v.v_id = (event_id // 30) % (SELECT count(*) FROM documents) JOIN names ON code = lang)
SELECT event_id, user_id, url FROM c QUALIFY url IS DISTINCT FROM lag(url) OVER (PARTITION BY user_id ORDER BY event_id)"""),
    "graph_elements": _sql(_BFS + _ELEMENTS),
    "json_request": _sql(r""" SELECT v_id, '{"word":' || to_json(word) || ',"lang":"' || lang || '","n":2}' AS body FROM v"""),
    "refetch_needed": "SELECT requested::INTEGER AS requested, fetched::INTEGER AS fetched, coalesce(fetched IS NOT NULL AND requested > fetched, false) AS refetch FROM (VALUES (1, NULL), (2, 2), (3, 2), (1, 4)) t(requested, fetched)",
    # written out by hand: what JavaScript's Number gives
    "param_parse": """SELECT raw, n::DOUBLE AS n FROM (VALUES ('3', 3), (' 4 ', 4), ('', 0), ('  ', 0), ('x', NULL), (NULL, 0), ('3.5', 3.5),
  ('1e1', 10), ('-2', -2), ('.5', 0.5), ('5.', 5), ('0x1F', 31), ('3d', NULL), ('1 2', NULL)) t(raw, n)""",
    "search_enabled": "SELECT * FROM (VALUES ('joy', false, true), ('joy', true, false), ('', false, false), (NULL, false, false)) t(word, loading, enabled)",
    "condensed_edge_originals": _sql(_scc_sql("dedup") + " SELECT scc_from, scc_to, string_agg(source || '>' || target, ',' ORDER BY source || '>' || target) AS originals FROM cond WHERE scc_from <> scc_to GROUP BY ALL"),
    "json_roundtrip": _sql(""" SELECT row_number() OVER (PARTITION BY pos // 8 ORDER BY pos) - 1 AS pos, CASE WHEN f THEN s ELSE t END AS e_id, CASE WHEN f THEN t ELSE s END AS n_id, f AS is_p
FROM (SELECT *, (pos // 8) % 4 = 0 AS f FROM o)"""),
    "proxy_path_rewrite": "SELECT page_id, regexp_replace('/api' || url, '^/api', '') AS path FROM pages",
}
