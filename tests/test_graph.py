"""Operators on hand-checked micro graphs, and properties on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions import present
from wordloom.operators import graph as g
from wordloom.operators import reduction as r
from wordloom.plans.pipeline import normalize, refine, search
from wordloom.schema import Graph, GraphInputError, GraphQuery
from wordloom.sources import responses
from wordloom.streaming import clicks


def edges_of(spark, pairs):
    return spark.createDataFrame([(str(a), str(b), i) for i, (a, b) in enumerate(pairs)], "source string, target string, pos long")


def nodes_of(spark, ids, root=None, langs=None):
    rows = [(str(i), str(i), "w", (langs or {}).get(i, "la"), i == root) for i in ids]
    return spark.createDataFrame(rows, "id string, label string, word string, lang string, root boolean")


def pairs(df):
    return sorted((x["source"], x["target"]) for x in df.collect())


def reduce(spark, given, mode="two_hop"):
    ids = sorted({x for p in given for x in p})
    return pairs(r.transitive_reduction(nodes_of(spark, ids), edges_of(spark, given), mode))


def text(given):
    return sorted((str(a), str(b)) for a, b in given)


@pytest.mark.parametrize(
    "given, want",
    [
        ([(1, 2), (2, 3), (1, 3)], [(1, 2), (2, 3)]),
        ([(1, 2), (2, 3), (3, 4), (1, 4)], [(1, 2), (2, 3), (3, 4), (1, 4)]),
        ([(1, 2), (2, 3), (3, 4), (1, 4), (1, 3)], [(1, 2), (2, 3), (3, 4)]),
        ([(1, 2), (2, 1), (1, 3), (2, 3)], [(1, 2), (2, 1), (1, 3), (2, 3)]),
        ([(1, 1), (1, 2)], [(1, 2)]),
        ([(1, 1), (1, 2), (2, 1)], [(1, 1), (1, 2), (2, 1)]),
        ([(1, 2), (1, 2)], [(1, 2), (1, 2)]),
    ],
)
def test_two_hop(spark, given, want):
    assert reduce(spark, given) == text(want)


def test_full(spark):
    assert reduce(spark, [(1, 2), (2, 3), (3, 4), (1, 4)], "full") == text([(1, 2), (2, 3), (3, 4)])


def test_dedup_keys(spark):
    e = edges_of(spark, [(1, 23), (12, 3)])
    assert pairs(g.dedup_edges(e, concat_key=True)) == [("1", "23")]
    assert pairs(g.dedup_edges(e)) == [("1", "23"), ("12", "3")]


def test_orientation(spark):
    t = spark.createDataFrame([(0, 5, 6, True), (1, 5, 6, False), (2, 7, 8, None)], "pos long, e_id long, n_id long, is_p boolean")
    assert pairs(g.orient_edges(t)) == [("5", "6"), ("6", "5"), ("8", "7")]


def test_depths_and_filter(spark):
    n, e = nodes_of(spark, [1, 2, 3, 4], root=1), edges_of(spark, [(2, 1), (2, 3)])
    got = g.bfs_depths(n, e)
    assert {x["id"]: x["depth"] for x in got.collect()} == {"1": 0, "2": 1, "3": 2, "4": None}
    assert sorted(x["id"] for x in got.where(g.within_depth(F.col("depth"), 1)).collect()) == ["1", "2", "4"]


def test_refine(spark):
    n = nodes_of(spark, [1, 2, 3, 4], root=1, langs={1: "es", 3: "en"})
    e = edges_of(spark, [(1, 2), (1, 3), (1, 4), (3, 4)])
    graph = Graph(g.bfs_depths(n, e), e)
    out = refine(graph, GraphQuery(branching=4, pruning=1, do_tr=False))
    assert sorted(x["id"] for x in out.nodes.collect()) == ["1", "3", "4"]
    assert pairs(out.edges) == text([(1, 3), (1, 4), (3, 4)])
    assert pairs(refine(graph, GraphQuery(branching=4, pruning=1)).edges) == text([(1, 3), (3, 4)])


def test_guard_keeps_repetitions(spark):
    n, e = nodes_of(spark, [1, 2], root=1), edges_of(spark, [(1, 2), (1, 2)])
    out = refine(Graph(g.bfs_depths(n, e), e), GraphQuery(collect_lang="xx"))
    assert pairs(out.edges) == text([(1, 2), (1, 2)])


def test_adjacency(spark):
    n, e = nodes_of(spark, [1, 2, 3]), edges_of(spark, [(1, 2), (1, 2)])
    assert {x["id"]: x["neighbours"] for x in g.adjacency(n, e).collect()} == {"1": ["2", "2"], "2": [], "3": []}
    assert {x["id"]: x["neighbours"] for x in g.adjacency(n, e, reverse=True).collect()} == {"1": [], "2": ["1", "1"], "3": []}


@pytest.mark.parametrize("v, e", [([], []), ([(1, "a", "en")], [(1, 2, True)]), ([(1, "a", "en"), (1, "b", "en")], []), ([(1, None, "en")], [])])
def test_validate(spark, v, e):
    with pytest.raises(GraphInputError):
        normalize(*responses.literal_response(spark, v, e))


def test_json(spark):
    v, e = responses.literal_response(spark, [(7, "joy", "en"), (9, "joie", "fr")], [(9, 7, True)])
    body = responses.encode_response(v, e)
    assert [tuple(x) for x in responses.decode_vertices(body).orderBy("pos").collect()] == [(0, 7, "joy", "en"), (1, 9, "joie", "fr")]
    assert [tuple(x) for x in responses.decode_edges(body).collect()] == [(0, 9, 7, True)]
    graph = normalize(v, e)
    assert {x["id"]: x["depth"] for x in graph.nodes.collect()} == {"7": 0, "9": 1}


def test_present(spark):
    n = spark.createDataFrame([("1", "geh₂w-", "ine-pro", True), ("2", "joy", "en", True), ("3", "x", "frm", False), ("4", "y", "en", False)], "id string, word string, lang string, root boolean")
    got = {x["id"]: (x["url"], x["c"]) for x in present.with_urls(n).withColumn("c", present.colour(F.col("root"), F.col("lang"))).collect()}
    assert got["1"] == ("https://en.wiktionary.org/wiki/Reconstruction:Proto-Indo-European/geh₂w-", "red")
    assert got["2"] == ("https://en.wiktionary.org/wiki/joy#English", "red")
    assert got["3"] == (None, "lightblue") and got["4"][1] == "lightgreen"


def test_query_parameters():
    with pytest.raises(GraphInputError):
        GraphQuery().checked()
    with pytest.raises(GraphInputError):
        GraphQuery(word="a", branching=5).checked()
    with pytest.raises(GraphInputError):
        GraphQuery(word="a", lang="la").checked()
    with pytest.raises(GraphInputError):
        refine(Graph(None, None), GraphQuery(pruning=6))
    assert GraphQuery(word="a").checked().branching == 2


def test_search(spark):
    v, e = responses.literal_response(spark, [(1, "far", "es"), (2, "joya", "es"), (3, "joie", "fr"), (4, "x", "la")], [(2, 3, True), (3, 4, False), (4, 1, True)])
    graph = search(v, e, GraphQuery(word="joya", lang="es", branching=2))
    assert {x["id"]: (x["root"], x["depth"]) for x in graph.nodes.collect()} == {"2": (True, 0), "3": (False, 1), "4": (False, 2)}
    assert pairs(graph.edges) == text([(2, 3), (4, 3)])


def test_elements_are_created_and_replaced(spark, tmp_path):
    n, e = nodes_of(spark, [2, 1], root=1), edges_of(spark, [(2, 1), (1, 2)])
    shown, path = present.elements(g.bfs_depths(n, e), e), f"file://{tmp_path}/elements"
    responses.write_elements(shown, path)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        responses.write_elements(shown, path)
    responses.write_elements(shown.where("kind = 'node' or source = '1'"), path, replace=True)
    got = [(x["kind"], x["id"], x["source"]) for x in spark.read.parquet(path).coalesce(1).collect()]
    assert sorted(got, key=str) == sorted([("node", "1", None), ("node", "2", None), ("edge", None, "1")], key=str)


def test_page_stream(spark, tmp_path):
    folder = f"file://{tmp_path}/clicks"
    spark.createDataFrame([("joy", "en"), ("x", "frm")], "word string, lang string").write.parquet(folder)
    stream = clicks.page_stream(spark.readStream.schema("word string, lang string").parquet(folder))
    stream.writeStream.format("memory").queryName("pages_seen").trigger(availableNow=True).start().awaitTermination(60)
    assert {(x["word"], x["url"]) for x in spark.table("pages_seen").collect()} == {("joy", "https://en.wiktionary.org/wiki/joy#English"), ("x", None)}


def test_a_hub_does_not_multiply(spark):
    star = [(f"a{i}", "hub") for i in range(3000)] + [("hub", f"c{i}") for i in range(3000)] + [("a7", "c9")]
    got = r.bypassed(spark.createDataFrame(star, "scc_from string, scc_to string"), False)
    assert [tuple(x) for x in got.collect()] == [("a7", "c9")]


@pytest.mark.parametrize("seed, cycles", [(1, False), (2, False), (3, True)])
def test_two_hop_without_nodes_is_the_same(spark, seed, cycles, monkeypatch):
    monkeypatch.setattr(r, "FEW_STEPS", 2)  # both ways of expanding
    rng = random.Random(seed)
    given = [(rng.randrange(16), rng.randrange(16)) for _ in range(60)]
    given = given if cycles else [(min(p), max(p)) for p in given]  # repeated edges and self-loops stay among them
    longs = spark.createDataFrame(given, "source long, target long")
    got = [(str(a), str(b)) for a, b in pairs(r.transitive_reduction(None, longs))]
    assert sorted(got) == reduce(spark, given)


@pytest.mark.parametrize("seed", [1, 2])
def test_properties_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    given = sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(45)})
    ids = sorted({x for p in given for x in p})

    def reach(edges):
        out = {i: {i} for i in ids}
        for _ in ids:
            for a, b in edges:
                out[int(a)] |= out[int(b)]
        for _ in ids:
            for a, b in edges:
                out[int(a)] |= out[int(b)]
        return out

    two, full = reduce(spark, given), reduce(spark, given, "full")
    assert set(full) <= set(two) and reach(full) == reach(given) == reach(two)
    n, e = nodes_of(spark, ids), edges_of(spark, given)
    far = reach(given)
    want = {str(i): min(str(j) for j in ids if j in far[i] and i in far[j]) for i in ids}
    assert {x["id"]: x["scc_id"] for x in r.scc(n, e).collect()} == want
    assert {x["id"]: x["scc_id"] for x in r.scc(n, e, core_edges=0).collect()} == want
