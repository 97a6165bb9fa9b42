"""Mixing sources to target weights by entropy balancing.

Targets: sources share the total by weight, capped at ``cap`` times their own
size, the excess being shared again by weight (water filling, in closed form
over sources ordered by capacity per weight).

Rates: among all document rates r of at most ``cap`` whose words, sum(r * size), meet
each source's target, those that are closest to 1 for every document in relative entropy
(sum of r ln r - r + 1 over documents) are exponentially tilted: r = min(cap, exp(lambda *
size / mean size of the source)). The dual of each source is convex in its lambda. Newton
iterations solve it for all sources at once; each is one aggregation of sum(size * r) and of its
derivative over all documents (grouped beforehand by source and size, which loses nothing, as
a document enters by these alone), in a bracket that a step out of it halves. Sums are exact
decimals, so runs agree to the last digit.

Copies: a document is taken floor(rate) times (cap - 1 at most), and once more where a hash of its id,
a number from 0 to 1, less the rest of its rate is below the source's cutoff. That expected words are met
makes the cutoff about 0; it is moved to where the words are met in fact. It is found
from sums of words over ranges of that difference: at most 4,096 ranges a source first,
then, inside the one where the target is reached, ranges of about a thousand
documents. In the last range single documents are chosen by error diffusion of the rest of their rates from
the largest to the smallest, so that a source is off by no more than the smallest of them, unless
they are few. What a document gets thus follows from its id, its size and a few rows
a source (sources and at most a range of documents each): texts aren't shuffled
where those rows are at most BROADCAST_ROWS (beyond it they are joined by shuffles), and a hot source
is no hot spot. Runs agree.

Cases: null texts have size 0 and are taken 0 times; null sources are one
source, last in order; a source of size 0 has target 0; rows with equal ids and
sizes of a source are taken equally often (so a source that is nothing but such rows may be off by
half of them); rows with a null id count as rows with equal ids; an empty table
gives no rows; other columns are ignored (``mixed`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

NEAR_ROWS = 1024
BROADCAST_ROWS = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """One row per source: k, source, rows, source_size, least (smallest size above 0), filled (documents above 0), target. ``sizes``: source, size, n."""
    some = F.col("size") > 0
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"), F.min(F.when(some, F.col("size"))).alias("least"), F.sum(F.when(some, F.col("n")).otherwise(0)).alias("filled"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # water filling: with capacity per weight ascending, the first sources are full, the others share the rest by weight
    full = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("rest", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    rows = rows.withColumn("rest_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("rest") / F.col("rest_w")).withColumn("open", F.col("level") * F.col("w") <= F.col("most"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("w"), F.col("level")))).over(all_rows)["level"]
    rows = rows.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("w"), F.col("most"))))
    return rows.select(place.alias("k"), "source", "rows", "source_size", "least", "filled", "target")


def _rate(cap: float) -> Column:
    """The rate of a document of ``size`` in a source with ``lambda`` and ``mean``; a null lambda means all at the cap, or nothing to take."""
    tilted = F.least(F.exp(F.col("lambda") * F.col("size") / F.col("mean")), F.lit(float(cap)))
    return F.when(F.col("target") <= 0, 0.0).when(F.col("lambda").isNull(), F.lit(float(cap))).otherwise(tilted)


def tilts(sizes: DataFrame, sources: DataFrame, cap: float = 3.0, tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """``sources`` with mean and lambda. ``sizes``: source, size, n (documents of that size).

    A round is one aggregation over ``sizes`` for all sources that aren't within ``tolerance`` of their target yet."""
    mean = F.try_divide(F.col("source_size").cast("double"), F.col("filled"))
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(float(cap)) * (1 - 1e-12))
    widest = mean / F.col("least")  # the smallest document is the last to come to the cap
    low = F.least(F.log(F.try_divide("target", "source_size")), F.lit(0.0)) * widest
    state = sources.withColumn("mean", mean).withColumn("open", F.coalesce(free, F.lit(False)))
    state = state.withColumn("lambda", F.when(F.col("open"), F.lit(0.0))).withColumn("low", low).withColumn("high", F.log(F.lit(float(cap))) * widest)
    state = materialise(state, "tilts")
    names = state.columns
    for _ in range(rounds):
        if state.where("open").isEmpty():
            return state.drop("open", "low", "high")
        left = _small(state.where("open").select("k", F.col("source").alias("s"), "target", "mean", "lambda"))
        at = sizes.join(left, F.col("source").eqNullSafe(F.col("s"))).where("size > 0").withColumn("rate", _rate(cap))
        # at the cap a document no longer moves with lambda
        words = F.col("rate") * F.col("size")
        slope = F.when(F.col("rate") < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
        exact = lambda x: F.sum((x * F.col("n")).cast("decimal(38,9)")).cast("double")
        sums = at.groupBy("k").agg(exact(words).alias("words"), exact(slope).alias("slope"))
        new = state.join(_small(materialise(sums, "sums")), "k", "left")
        new = new.withColumn("ratio", F.try_divide("words", "target")).withColumn("off", F.col("ratio") - 1)
        low = F.when(F.col("off") < 0, F.col("lambda")).otherwise(F.col("low"))
        high = F.when(F.col("off") > 0, F.col("lambda")).otherwise(F.col("high"))
        # Newton on the logarithm of the words, which is nearly straight
        step = F.col("lambda") - F.log("ratio") * F.col("words") / F.nullif(F.col("slope"), F.lit(0.0))
        new = new.withColumn("low", low).withColumn("high", high).withColumn("step", step)
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        new = new.withColumn("met", ~F.col("open") | (F.abs("off") <= tolerance))
        new = new.withColumn("lambda", F.when(F.col("met"), F.col("lambda")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2))
        state = materialise(new.withColumn("open", ~F.col("met")).select(*names), "tilts")
    return state.drop("open", "low", "high")


def _small(rows: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most BROADCAST_ROWS; else Spark shuffles to join it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


KEY_BITS = 50


def _chance(cap: int) -> tuple[Column, Column]:
    """(copies for certain, key of KEY_BITS bits) of a document with id, size and its source's columns. The key is a hash
    of id and size as a number from 0 to 1, less the part of the rate that isn't certain, put between 0 and 1."""
    rate = _rate(cap)
    base = F.least(F.floor(rate), F.lit(cap - 1))
    uniform = F.shiftrightunsigned(F.xxhash64("id", "size"), 64 - KEY_BITS) / F.lit(float(1 << KEY_BITS))
    key = F.floor((uniform - (rate - base) + 1) / 2 * F.lit(float((1 << KEY_BITS) - 1)))
    return base, key


def _top(bits: str) -> Column:
    """The first ``bits`` (a column, may be 0) bits of the key."""
    return F.expr(f"shiftright(key, cast({KEY_BITS} - {bits} as int))")


def _reached(cells: DataFrame, cell: str, floor: Column) -> DataFrame:
    """Of each source the cell in which the words from ``floor`` on reach ``extra``: k, cell, before."""
    order = Window.partitionBy("k").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", floor + F.coalesce(F.sum("words").over(order), F.lit(0)))
    return cells.where((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("words"))).select("k", cell, "before")


def decisions(sized: DataFrame, weights=(5, 2, 1), cap: int = 3) -> tuple[DataFrame, DataFrame]:
    """What decides on every document. ``sized``: id, source, size.

    A row per source: k, source, source_size, target, mean, lambda, bits, cut (null: all are taken once more than for certain);
    and k, id, size of those in the cutoff's range that are taken once more than for certain."""
    sizes = materialise(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = source_targets(sizes, weights, cap)
    # a source's documents lie in the middle of the key's range at worst: half of its ranges
    bits = F.greatest(F.ceil(F.log2(F.col("rows") / F.lit(NEAR_ROWS))) + 1, F.lit(0)).cast("int")
    sources = tilts(sizes, materialise(sources.withColumn("bits", bits), "sources"), cap)

    certain, key = _chance(cap)
    known = _small(sources.select("k", F.col("source").alias("s"), "bits", "target", "mean", "lambda"))
    keyed = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).where("size > 0")
    keyed = keyed.withColumn("base", certain).withColumn("key", key).withColumn("part", (_rate(cap) - F.col("base")) * F.col("size")).select("k", "id", "size", "bits", "target", "base", "part", "key")
    keyed = materialise(keyed.withColumn("coarse", _top("least(bits, 12)")).withColumn("fine", _top("bits")), "keys")
    taken = keyed.groupBy("k").agg(F.sum(F.col("base") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    extra = _small(materialise(taken.select("k", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0)).alias("extra")), "extra"))
    keyed = keyed.join(extra, "k")
    coarse = keyed.groupBy("k", "coarse").agg(F.sum("size").alias("words"), F.first("extra").alias("extra"))
    coarse = materialise(_reached(coarse, "coarse", F.lit(0)).withColumnRenamed("before", "floor"), "coarse")
    inside = keyed.join(_small(coarse), ["k", "coarse"])
    fine = inside.groupBy("k", "fine").agg(F.sum("size").alias("words"), F.first("extra").alias("extra"), F.first("floor").alias("floor"))
    fine = materialise(_reached(fine, "fine", F.col("floor")), "fine")

    near = keyed.join(_small(fine), ["k", "fine"]).withColumn("want", F.col("extra") - F.col("before"))
    near = near.groupBy("k", "id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("want").alias("want"), F.first("part").alias("part"))
    # a range has about NEAR_ROWS ids, whatever the source's size; equal rows are one entry
    entry = F.struct(-F.col("size"), "id", "size", (F.col("n") * F.col("size")).alias("words"), (F.col("n") * F.col("part")).alias("part"))
    near = near.groupBy("k").agg(F.sort_array(F.collect_list(entry)).alias("row"), F.first("want").alias("want"), F.sum(F.col("n") * F.col("size")).alias("all"))

    def diffuse(state, row):
        """Error diffusion; a document goes the other way where its words would be missed, or be too many, for the ones after it."""
        words, left = row["words"], state["left"]
        rest = state["rest"] - words
        due = F.col("want") / F.col("parts") * row["part"] + state["off"]
        missed, over = left - rest, words - left
        take = F.when(missed > 0, missed >= over).otherwise((due * 2 >= words) & (over * 2 <= words))
        used = F.when(take, words).otherwise(F.lit(0))
        return F.struct((due - used).alias("off"), (left - used).alias("left"), rest.alias("rest"), F.concat(state["taken"], F.array(take)).alias("taken"))

    start = F.struct(F.lit(0.0).alias("off"), F.col("want").alias("left"), F.col("all").alias("rest"), F.array().cast("array<boolean>").alias("taken"))
    near = near.withColumn("parts", F.aggregate("row", F.lit(0.0), lambda t, row: t + row["part"])).where("parts > 0")
    near = near.withColumn("taken", F.aggregate("row", start, diffuse)["taken"])
    near = near.select("k", F.explode(F.arrays_zip("row", "taken")).alias("x")).where("x.taken").select("k", "x.row.id", "x.row.size")
    sources = sources.join(fine.select("k", F.col("fine").alias("cut")), "k", "left")
    sources = sources.select("k", "source", "source_size", "target", "mean", "lambda", "bits", "cut")
    return _small(materialise(sources, "cuts")), _small(materialise(near, "near"))


def _copied(sized: DataFrame, sources: DataFrame, near: DataFrame, cap: int) -> DataFrame:
    """``sized`` (id, source, size and others) with source_size, target, rate, copies."""
    out = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    certain, key = _chance(cap)
    out = out.withColumn("rate", _rate(cap)).withColumn("base", certain).withColumn("key", key).withColumn("fine", _top("bits"))
    n = near.select(F.col("k").alias("k__"), F.col("id").alias("id__"), F.col("size").alias("size__"))
    out = out.join(n, (F.col("k") == F.col("k__")) & (F.col("size") == F.col("size__")) & F.col("id").eqNullSafe(F.col("id__")), "left")
    more = F.col("cut").isNull() | (F.col("fine") < F.col("cut")) | F.col("k__").isNotNull()
    copies = F.when(F.col("size") > 0, F.col("base") + F.when(more, 1).otherwise(0)).otherwise(0)
    return out.withColumn("copies", copies.cast("int")).drop("k", "key", "fine", "bits", "cut", "base", "mean", "lambda", "k__", "id__", "size__")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), *more)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """id, size, source_size, target, taken (= copies * size), copies, rate."""
    sized = materialise(_sized(docs, id_col, text_col, source_col), "sizes")
    out = _copied(sized, *decisions(sized, weights, cap), cap)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    sized = materialise(_sized(docs, id_col, text_col, source_col), "sizes")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _copied(_sized(docs, id_col, text_col, source_col, row), *decisions(sized, weights, cap), cap).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
