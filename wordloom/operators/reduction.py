"""Strongly connected components, condensation and shortcut removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..marks import with_mark
from ..storage import materialise

#: A trimmed core of at most so many distinct edges is labelled on the driver (about 30 MB); a larger one by rounds.
CORE_EDGES = 200_000
#: A start with at most so many steps has its edges expanded ahead, whatever the other end's degree.
FEW_STEPS = 8


def _core_labels(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(id, least id of its component) by an iterative depth-first search with low links."""
    after: dict[str, list[str]] = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack, on, out = [], set(), []
    for start in after:
        if start in index:
            continue
        work = [(start, iter(after[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    own = []
                    while True:
                        own.append(stack.pop())
                        on.discard(own[-1])
                        if own[-1] == v:
                            break
                    out += [(x, min(own)) for x in own]
    return out


def _trim(pairs: DataFrame, rounds: int = 3) -> DataFrame:
    """Drop edges of vertices without an in- or an out-edge, for some rounds; they can't be on a cycle. A long
    chain would take a round for each of its layers, so the rest is left to colouring."""
    n = pairs.count()
    while n and rounds:
        pairs = pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        pairs = pairs.join(pairs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        pairs = materialise(pairs, "core")
        m, n = n, pairs.count()
        rounds = rounds - 1 if n < m else 0
    return pairs


def _spread(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label: the least label that reaches each vertex along the edges."""
    total = F.sum(F.xxhash64("id", "label").cast("decimal(38,0)"))
    mark = labels.agg(total).first()
    while True:
        sent = pairs.join(labels, pairs["a"] == labels["id"]).select(F.col("b").alias("id"), "label")
        labels = materialise(labels.unionByName(sent).groupBy("id").agg(F.min("label").alias("label")), "labels")
        if (now := labels.agg(total).first()) == mark:
            return labels
        mark = now


def cyclic(edges: DataFrame, core_edges: int = CORE_EDGES) -> DataFrame | None:
    """id, scc_id (the least id of the component) of all vertices on cycles and perhaps of some others; None if no edge is
    left. What is left of the edges is labelled on the
    driver if its size allows, else it is trimmed and coloured: the least label spreads forward, then backward from
    each colour's root inside the colour; what is reached is a component, and the rest goes on."""
    spark = edges.sparkSession
    pairs = edges.where("source != target").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    kind = pairs.schema["a"].dataType.simpleString()
    found = None
    while not pairs.isEmpty():
        if pairs.limit(core_edges + 1).count() <= core_edges:
            new = spark.createDataFrame(_core_labels([tuple(r) for r in pairs.collect()]), f"id {kind}, scc_id {kind}")
            found = new if found is None else found.unionByName(new)
            break
        pairs = _trim(pairs)
        if pairs.isEmpty():
            break
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        colour = _spread(pairs, ids.withColumn("label", F.col("id")))
        ca, cb = colour.select(F.col("id").alias("a"), F.col("label").alias("la")), colour.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        inside = materialise(pairs.join(ca, "a").join(cb, "b").where("la = lb").select(F.col("b").alias("a"), F.col("a").alias("b")), "inside")
        back = _spread(inside, colour.where("id = label"))
        found = back.withColumnRenamed("label", "scc_id") if found is None else found.unionByName(back.withColumnRenamed("label", "scc_id"))
        gone = back.select("id")
        pairs = pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        pairs = materialise(pairs, "pairs")
    return found


def scc(nodes: DataFrame, edges: DataFrame, core_edges: int = CORE_EDGES) -> DataFrame:
    """id, scc_id (the least id of the component)."""
    found = cyclic(edges, core_edges)
    if found is None:
        return nodes.select("id", F.col("id").alias("scc_id"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("scc_id", "id").alias("scc_id"))


def condense(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Every edge with the components of its ends: scc_from, scc_to, source, target."""
    of = lambda end, name: labels.select(F.col("id").alias(end), F.col("scc_id").alias(name))
    return edges.join(of("source", "scc_from"), "source").join(of("target", "scc_to"), "target").select("scc_from", "scc_to", "source", "target")


def condensed_pairs(condensed: DataFrame) -> DataFrame:
    return condensed.where("scc_from != scc_to").select("scc_from", "scc_to").distinct()


def originals(condensed: DataFrame) -> DataFrame:
    """scc_from, scc_to, originals: the sorted edges ("source>target") behind each condensed pair. A pair's list is as long
    as its edges are many; ``condense`` has the same as rows."""
    edge = F.concat_ws(">", "source", "target")
    return condensed.where("scc_from != scc_to").groupBy("scc_from", "scc_to").agg(F.sort_array(F.collect_list(edge)).alias("originals"))


def topo_levels(dag: DataFrame, labels: DataFrame) -> DataFrame:
    """scc_id, level: the longest path from a component without predecessors."""
    levels = materialise(labels.select("scc_id").distinct().withColumn("level", F.lit(0)), "levels")
    front = levels
    while True:
        front = front.join(dag, front["scc_id"] == dag["scc_from"]).groupBy(F.col("scc_to").alias("scc_id")).agg((F.max("level") + 1).alias("level"))
        front = materialise(front, "front")
        if front.isEmpty():
            return levels
        levels = materialise(levels.unionByName(front).groupBy("scc_id").agg(F.max("level").alias("level")), "levels")


def _by_one_step(pairs: DataFrame, dag: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, c) that dag paths of exactly two steps join. Each pair is expanded from its end of
    lower degree, so that a hub's in- and out-edges don't multiply; what is written are pairs, not paths."""
    out = dag.groupBy(F.col("scc_from").alias("a")).agg(F.count(F.lit(1)).alias("n_out"))
    into = dag.groupBy(F.col("scc_to").alias("c")).agg(F.count(F.lit(1)).alias("n_in"))
    sized = pairs.join(out, "a").join(into, "c")
    step, last = dag.select(F.col("scc_from").alias("a"), F.col("scc_to").alias("b")), dag.select(F.col("scc_from").alias("b"), F.col("scc_to").alias("c"))
    ahead = sized.where("n_out <= n_in").join(step, "a").join(last, ["b", "c"], "left_semi")
    behind = sized.where("n_out > n_in").join(last, "c").join(step, ["a", "b"], "left_semi")
    return ahead.select("a", "c").unionByName(behind.select("a", "c")).distinct()


def bypassed(dag: DataFrame, full: bool) -> DataFrame:
    """Condensed pairs that a longer path replaces: one of exactly two steps, or, if ``full``, of any length.

    Only an edge whose start has other out-edges and whose end has other in-edges can be replaced. ``full``
    searches on from the starts of such edges, as long as one of a start's edges isn't replaced yet."""
    names = (F.col("a").alias("scc_from"), F.col("c").alias("scc_to"))
    forks = dag.groupBy(F.col("scc_from").alias("a")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    joins = dag.groupBy(F.col("scc_to").alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
    open_ = dag.select(F.col("scc_from").alias("a"), F.col("scc_to").alias("c")).join(forks, "a", "left_semi").join(joins, "c", "left_semi")
    open_ = materialise(open_, "candidates")
    gone = materialise(_by_one_step(open_, dag), "bypassed")
    if not full:
        return gone.select(*names)
    open_ = materialise(open_.join(gone, ["a", "c"], "left_anti"), "candidates")
    step = dag.select(F.col("scc_from").alias("b"), F.col("scc_to").alias("c"))
    front = materialise(dag.select(F.col("scc_from").alias("a"), F.col("scc_to").alias("c")).join(open_.select("a").distinct(), "a", "left_semi"), "far")
    seen = None  # what two steps or more reach
    while not open_.isEmpty():
        front = front.join(open_.select("a").distinct(), "a", "left_semi").withColumnRenamed("c", "b").join(step, "b").select("a", "c").distinct()
        front = materialise(front if seen is None else front.join(seen, ["a", "c"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = front if seen is None else seen.unionByName(front)
        hit = materialise(open_.join(front, ["a", "c"], "left_semi"), "bypassed")
        gone = gone.unionByName(hit)
        open_ = materialise(open_.join(hit, ["a", "c"], "left_anti"), "candidates")
    return gone.select(*names)


def _acyclic_two_hop(edges: DataFrame) -> DataFrame | None:
    """source, target: the edges without those that a path of exactly two steps replaces; None if the graph has cycles.

    A path's middle has an in- and an out-edge. Bitmaps choose the edges that end in a middle, start in one or could be
    replaced, so what is shuffled is those and not every edge for every join; exact joins decide."""
    edges = edges.where("source != target")
    ends = edges.select(F.col("source").alias("v")).distinct(), edges.select(F.col("target").alias("v")).distinct()
    middles = materialise(ends[0].join(ends[1], "v", "left_semi"), "middles", clean=True)
    of = lambda end: middles.select(F.col("v").alias(end))
    first = with_mark(edges, ("target",), of("target"), "hit__").where("hit__").drop("hit__")
    first = materialise(first.join(of("target"), "target", "left_semi").select("source", "target"), "first", clean=True)
    last = with_mark(edges, ("source",), of("source"), "hit__").where("hit__").drop("hit__")
    found = cyclic(first.join(of("source"), "source", "left_semi"))
    if found is not None and not found.where("id != scc_id").isEmpty():
        return None
    step, last = first.distinct().select(F.col("source").alias("a"), F.col("target").alias("b")), materialise(last, "last", clean=True)
    open_ = with_mark(edges, ("source",), first.select("source"), "hit__").where("hit__").drop("hit__")
    open_ = with_mark(open_, ("target",), last.select("target"), "hit__").where("hit__").select(F.col("source").alias("a"), F.col("target").alias("c"))
    last = last.select(F.col("source").alias("b"), F.col("target").alias("c"))
    steps = step.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    few = step.join(steps.where(F.col("n") <= FEW_STEPS), "a", "left_semi")
    gone = materialise(open_.join(few, "a").join(last, ["b", "c"], "left_semi").select("a", "c").distinct(), "bypassed", clean=True)
    many = materialise(steps.where(F.col("n") > FEW_STEPS).select("a"), "many", clean=True)
    if not many.isEmpty():  # these from the end of lower degree
        rest = _by_one_step(open_.join(many, "a", "left_semi").distinct(), step.select(F.col("a").alias("scc_from"), F.col("b").alias("scc_to")).union(last).distinct())
        gone = gone.unionByName(materialise(rest, "bypassed", clean=True))
    gone = gone.select(F.col("a").alias("source"), F.col("c").alias("target"))
    parted = with_mark(edges, ("source", "target"), gone, "hit__")
    return parted.where("hit__").drop("hit__").join(gone, ["source", "target"], "left_anti").unionByName(parted.where("not hit__").drop("hit__"))


def transitive_reduction(nodes: DataFrame | None, edges: DataFrame, mode: str = "two_hop", labels: DataFrame | None = None) -> DataFrame:
    """source, target: all edges inside components of two nodes or more, and all edges between
    components whose condensed pair isn't bypassed. ``two_hop`` looks at paths of two condensed
    steps only; ``full`` at paths of any length. Repetitions stay; self-loops of single nodes go.
    ``nodes`` None: the ends of the edges; then give edges that are cheap to read more than once."""
    if mode not in ("two_hop", "full"):
        raise ValueError(mode)
    edges = edges.select("source", "target")
    if nodes is None:
        if mode == "two_hop" and labels is None and (out := _acyclic_two_hop(edges)) is not None:
            return out
        nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    labels = materialise(labels if labels is not None else scc(nodes, edges), "scc")
    condensed = materialise(condense(edges, labels), "condensed")
    large = labels.groupBy("scc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("scc_id").alias("scc_from"))
    inner = condensed.where("scc_from = scc_to").join(large, "scc_from", "left_semi")
    outer = condensed.where("scc_from != scc_to").join(bypassed(condensed_pairs(condensed), mode == "full"), ["scc_from", "scc_to"], "left_anti")
    return inner.select("source", "target").unionByName(outer.select("source", "target"))
