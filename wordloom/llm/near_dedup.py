"""Near-dedup by MinHash bands, verified by Odd sketches and then by full sets.

1. Each document's set of word shingles is hashed (64 bits); equal sets are
   collapsed by a fingerprint, so exact copies cost one representative.
2. ``rows`` x ``bands`` MinHash samples of each representative are folded into
   an Odd sketch (a parity bitmap of SKETCH_BITS); bands are hashed to buckets.
3. Buckets of at most ``small`` representatives give all their pairs. A larger
   bucket gives the pairs of a leader (the member that sits in most large
   buckets) with its other members. The XOR population count of two sketches
   estimates how many samples differ, and with them the similarity; a pair goes
   before it is emitted if its estimate is so low that a pair at the threshold
   has it with a probability below 1e-9 (of the samples and of collisions in the
   sketch together).
4. Pairs that remain are confirmed on the full sets and merged into components
   by alternating large-star and small-star steps.
5. Members of large buckets that are not all of one component then are joined by
   an exact prefix filter: of each set the rarest shingles, as many that two sets
   of different components at the threshold share one, name groups. Families that share much but not
   enough have rare shingles of their own and fall apart there, so work grows with
   members. Small groups give pairs as before.
6. Groups that are still large and of several components are joined into
   crowds. In each crowd the members outside its main component meet all members,
   in blocks of bounded size; a block compares sketches, confirms on full sets in
   order of likeness and emits just the links that join components. So no
   candidate is lost, and what is emitted grows with members, not with pairs.

Bands are chosen so that a pair at the threshold is missed with a probability of
at most ``miss``.

Cases: a null text, an empty one or one without words has an empty set and is
linked with nothing; fewer words than a shingle are one shingle; ties go to the
smallest id; rows with equal ids and texts give equal rows; rows with a null id
belong to their group but never name it; an empty table gives no rows; other
columns are ignored; whole texts are used.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, bitmap, bitmap_slot, marked, materialise, slices
from .pieces import _Cache

SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64


def bands_for(threshold: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def estimated_similarity(count, samples: int, bits: int = SKETCH_BITS):
    """The similarity that an XOR population count of two Odd sketches speaks for: samples that
    differ put two marks each into the XOR, of which -(bits / 2) ln(1 - 2 count / bits) are expected."""
    marks = -bits / 2 * math.log1p(-2 * min(count, bits // 2 - 1) / bits)
    return 1 - marks / (2 * samples)


def highest_count(samples: int, threshold: float, bits: int = SKETCH_BITS, chance: float = 1e-9) -> int:
    """The smallest count that a pair at the threshold exceeds with a probability of at most ``chance``: the
    number of samples that differ is binomial, and their marks fall into the sketch one after another."""
    import numpy as np

    odd = np.zeros(bits + 1)
    odd[0] = 1.0  # the distribution of odd cells after no mark
    total, up = np.zeros(bits + 1), 1 - np.arange(bits + 1) / bits
    for differ in range(samples + 1):
        total += math.comb(samples, differ) * (1 - threshold) ** differ * threshold ** (samples - differ) * odd
        for _ in range(2):
            step = odd * up
            odd = np.append(odd[1:] * (1 - up[1:]), 0.0) + np.append(0.0, step[:-1])
    above = np.cumsum(total[::-1])[::-1]  # P(count >= c)
    return int(np.flatnonzero(np.append(above[1:], 0.0) <= chance)[0])


def _word_hash(word: bytes) -> int:
    return zlib.crc32(word) | zlib.crc32(word, 0x9E3779B9) << 32


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """text -> sorted distinct 64-bit hashes of its word shingles."""

    def __init__(self, words: int):
        self.words = words
        self.cache = _Cache(_word_hash, 50_000)

    def __call__(self, text: str | None):
        import numpy as np

        cache = self.cache
        # bytes.lower and bytes.split know just A-Z and the white space \x20 and \x09-\x0D
        w = np.array([cache[x] for x in (text or "").encode("utf-8", "surrogatepass").lower().split()], np.uint64)
        if not len(w):
            return w
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i])
        return np.unique(h)


class Signer:
    """Sets -> MinHash samples, band hashes, Odd sketch."""

    def __init__(self, bands: int, rows: int):
        import numpy as np

        rng = np.random.default_rng(20_240)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 31, bands * rows, np.uint32) * 2 + 1).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)

    def __call__(self, h):
        import numpy as np

        low = ((h >> np.uint64(32)) ^ h).astype(np.uint32)
        best = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 256):  # blocks that stay in the cache
            x = low[at : at + 256]
            z = x[None, :] * self.a[:, None]
            z += self.b[:, None]
            np.minimum(best, z.min(1), out=best)
        keys = _mixed(best.astype(np.uint64) + (np.arange(len(best), dtype=np.uint64) << np.uint64(32)))
        parity = np.bincount((keys % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
        sketch = np.packbits(parity.astype(np.uint8)).view(np.int64)
        bands = keys.reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            out = _mixed(out * np.uint64(0xD6E8FEB86659FD93) + bands[:, i])
        return out.view(np.int64), sketch


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, fp (two longs of the set), buckets, sketch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingle, sign = Shingler(words), Signer(bands, rows)
        seen: dict = {}  # signatures of sets met lately in this task: copies are signed once
        for part in slices(batches, 256, chars=4_000_000):
            n, hi, lo, buckets, sketches = [], [], [], [], []
            for text in part.column("text").to_pylist():
                h = shingle(text)
                n.append(len(h))
                key = (int(np.bitwise_xor.reduce(_mixed(h))) if len(h) else 0, int(_mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) if len(h) else 0)
                hi.append(key[0] - (1 << 64) if key[0] >> 63 else key[0])
                lo.append(key[1] - (1 << 64) if key[1] >> 63 else key[1])
                if not len(h):
                    buckets.append(None)
                    sketches.append(None)
                    continue
                if (got := seen.get(key)) is None:
                    got = sign(h)
                    if len(seen) >= 4_000:
                        seen.clear()
                    seen[key] = got
                buckets.append(got[0])
                sketches.append(got[1])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(buckets, longs), pa.array(sketches, longs)], ["id", "n_shingles", "fp1", "fp2", "buckets", "sketch"])

    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return batched(thin).mapInArrow(run, "id long, n_shingles long, fp1 long, fp2 long, buckets array<long>, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, set array<long> of the documents in ``ids`` and perhaps of some others: they are
    chosen by a bitmap of bounded size, so that texts aren't shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids, "id"))

    def run(batches):
        import pyarrow as pa

        bits, shingle = shared.value, Shingler(words)
        for part in slices(batches, 256, chars=4_000_000):
            part = part.filter(pa.array(marked(bits, part.column("slot"))))
            sets = [shingle(t).view("int64") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return batched(own.withColumn("slot", bitmap_slot("id"))).mapInArrow(run, "id long, set array<long>")


def odd_distance(a, b):
    """Population count of the XOR of two Odd sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of all ids in ``edges`` (a, b), by alternating
    large-star and small-star until the edges are stars."""
    current = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours link to the least one
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: smaller neighbours and the node itself link to the least one
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        step = materialise(small.where("a != b").distinct(), "edges")
        mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        if tuple(current.agg(*mark).first()) == tuple(step.agg(*mark).first()):
            return step.select(F.col("a").alias("id"), F.col("b").alias("component"))
        current = step


def joining_links(table, percent: int, far: int):
    """The links of one block that join components: ``table`` has rep, at (component), n, sketch,
    set and outer (whether the member is to meet all others)."""
    import numpy as np
    import pyarrow as pa

    rep, at, n = (table.column(c).to_numpy() for c in ("rep", "at", "n"))
    outer = np.flatnonzero(table.column("outer").to_numpy(zero_copy_only=False))
    sketch = np.array(table.column("sketch").to_pylist(), np.int64).view(np.uint64)
    lists = table.column("set").combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    sets: dict[int, frozenset] = {}

    def full(i: int) -> frozenset:
        if i not in sets:
            sets[i] = frozenset(values[offsets[i] : offsets[i + 1]].tolist())
        return sets[i]

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    found_a, found_b, pairs = [], [], []
    for i in outer:
        away = np.bitwise_count(sketch ^ sketch[i]).sum(1)
        fits = (at != at[i]) & (away <= far) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
        pairs += [(int(away[j]), int(i), int(j)) for j in np.flatnonzero(fits)]
    for _, i, j in sorted(pairs):
        x, y = find(int(at[i])), find(int(at[j]))
        if x == y:
            continue
        same = len(full(i) & full(j))
        if 100 * same >= percent * (len(full(i)) + len(full(j)) - same):
            root[max(x, y)] = min(x, y)
            found_a.append(max(rep[i], rep[j]))
            found_b.append(min(rep[i], rep[j]))
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def counted(own: DataFrame, room: int = 1 << 19) -> DataFrame:
    """g, n, lo, hi: the shingles of ``own`` (at, set) with their number and their least and largest component, summed
    over about ``room`` shingles at a time, so that what a family shares is one row for many members."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def table():
            g, at = np.concatenate(shingles), np.concatenate(places)
            order = np.lexsort((at, g))
            g, at = g[order], at[order]
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            end = np.append(begin[1:], len(g))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (g[begin], end - begin, at[begin], at[end - 1])], ["g", "n", "lo", "hi"])

        shingles, places, held = [], [], 0
        for batch in batches:
            sets = batch.column("set")
            shingles.append(sets.flatten().to_numpy())
            places.append(np.repeat(batch.column("at").to_numpy(), sets.value_lengths().to_numpy()))
            held += len(shingles[-1])
            if held >= room:
                yield table()
                shingles, places, held = [], [], 0
        if held:
            yield table()

    return batched(own.select("at", "set")).mapInArrow(run, "g long, n long, lo long, hi long")


def rarest(members: DataFrame, sets: DataFrame, percent: int, top: int = 1024) -> DataFrame:
    """rep, at, bucket: of each member's set the shingles that are rarest among the members, as many that two
    sets of different components that meet the threshold have one of them in common.

    The order is the same for all sets: first the shingles of one component alone, which join nothing and just take
    their places; then by frequency. The ``top`` most frequent ones, which are most of a large family's rows, are
    found in each set by one short list, so that only the rows of the others are joined with their frequencies."""
    own = members.join(sets, F.col("rep") == F.col("id")).select("rep", "at", "set", F.xxhash64("set").alias("k"))
    own = own.dropDuplicates(["rep", "k"])  # rows with equal ids may have different sets
    often = counted(own).groupBy("g").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    often = materialise(often.where("lo != hi").select("g", "n"), "often")
    by_rank = F.sort_array(F.collect_list(F.struct("n", "g")))["g"]
    last = often.orderBy(F.desc("n"), F.desc("g")).limit(top).agg(by_rank.alias("last"))
    own = own.crossJoin(F.broadcast(last))  # one row
    rest = own.select("rep", "k", F.explode(F.array_except("set", "last")).alias("g"))
    rest = rest.join(often, "g").groupBy("rep", "k").agg(by_rank.alias("ranked"))
    ranked = F.concat(F.coalesce("ranked", F.array().cast("array<long>")), F.array_intersect("last", "set"))
    own = own.join(rest, ["rep", "k"], "left").select("rep", "at", F.size("set").alias("n"), ranked.alias("ranked"))
    needed = F.size("ranked") - F.ceil(F.col("n") * F.lit(percent) / 100).cast("int") + 1  # the others of n come before
    return own.select("rep", "at", F.explode(F.slice("ranked", F.lit(1), F.greatest(F.lit(0), needed))).alias("bucket")).distinct()


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", threshold: float = 0.8, words: int = 5, rows: int = 5, miss: float = 1e-7, small: int = 24, block: int = 256, room: int = 4000) -> DataFrame:
    """id, n_shingles, component_id, kept: one row per document; ``threshold`` is met when
    100 * intersection >= 100 * threshold * union (to whole percent)."""
    percent = round(100 * threshold)
    bands = bands_for(threshold, rows, miss)
    samples = bands * rows
    far = highest_count(samples, threshold)  # as an estimate: estimated_similarity(far, samples)

    prints = materialise(fingerprints(docs, id_col, text_col, words, bands, rows), "prints")
    filled = prints.where("n_shingles > 0")
    classes = filled.where("id is not null").groupBy("fp1", "fp2").agg(F.min(F.struct("id", "n_shingles", "sketch", "buckets")).alias("x"))
    reps = materialise(classes.select("fp1", "fp2", F.col("x.id").alias("rep"), F.col("x.n_shingles").alias("n"), "x.sketch", "x.buckets"), "reps")

    member = reps.select("rep", F.explode("buckets").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = materialise(member.join(sizes, "bucket"), "members")
    few = member.where(F.col("size") <= small).select("bucket", "rep")
    many = member.where(F.col("size") > small).select("bucket", "rep")
    sketches = reps.select("rep", "sketch", "n")

    found = few.alias("x").join(few.alias("y"), "bucket").where(F.col("x.rep") < F.col("y.rep"))
    found = found.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    crowded = many.select("rep").distinct()
    central = many.join(many.groupBy("rep").agg(F.count(F.lit(1)).alias("degree")), "rep")
    leader = central.groupBy("bucket").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("l"))
    star = many.join(leader, "bucket").where("rep != l").select(F.least("rep", "l").alias("a"), F.greatest("rep", "l").alias("b"))
    pairs = found.unionByName(star).distinct()

    def screened(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.rep")).join(sketches.alias("y"), F.col("b") == F.col("y.rep"))
        sizes_fit = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
        return both.where(sizes_fit & (odd_distance(F.col("x.sketch"), F.col("y.sketch")) <= far)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        two = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        same = F.size(F.array_intersect("sa", "sb"))
        return two.where(100 * same >= percent * (F.size("sa") + F.size("sb") - same)).select("a", "b")

    def unsettled(groups: DataFrame) -> DataFrame:
        """bucket, rep, at (component), first (least rep of the bucket) of the buckets that have several components."""
        now = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("at"))
        mixed = now.groupBy("bucket").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("rep").alias("first")).where("lo != hi").select("bucket", "first")
        return materialise(now.join(mixed, "bucket"), "open")

    pairs = materialise(screened(pairs), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowded).distinct()
    sets = materialise(full_sets(docs, ids, id_col, text_col, words), "sets")
    links = materialise(confirmed(pairs), "links")
    labels = components(links)

    open_ = unsettled(many)
    if not open_.isEmpty():
        prefixes = materialise(rarest(open_.select("rep", "at").distinct(), sets, percent), "prefixes")
        sizes = prefixes.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        prefixes = materialise(prefixes.join(sizes, "bucket"), "prefixes")
        few = prefixes.where(F.col("size") <= small)
        found = few.alias("x").join(few.alias("y"), "bucket").where("x.rep < y.rep and x.at != y.at")
        pairs = materialise(screened(found.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()), "pairs")
        links = materialise(links.unionByName(confirmed(pairs)), "links")
        labels = components(links)
        open_ = unsettled(prefixes.where(F.col("size") > small))
    if not open_.isEmpty():
        crowds = components(open_.select(F.col("rep").alias("a"), F.col("first").alias("b")))
        own = open_.select("rep", "at").distinct().join(crowds.withColumnRenamed("id", "rep"), "rep", "left")
        own = own.join(sketches.select("rep", F.col("n").alias("weight")), "rep")
        own = materialise(own.select("rep", "at", "weight", F.coalesce("component", "rep").alias("crowd")), "crowds")
        # blocks are bounded by members and by shingles: ``room`` of them stand for one member
        share = F.greatest(F.lit(1.0), F.col("weight") / F.lit(float(room)))
        parts = own.groupBy("crowd", "at").agg(F.sum(share).alias("k"))
        shape = parts.groupBy("crowd").agg(F.max_by("at", F.struct("k", "at")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("all"))
        shape = shape.select("crowd", "main", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / block)).alias("outer_blocks"), F.ceil(F.col("all") / (4 * block)).alias("segments"))
        own = own.join(shape, "crowd").withColumn("h", F.xxhash64(F.lit(3), "rep"))
        is_outer = F.col("at") != F.col("main")
        outer = own.where(is_outer).withColumn("o", F.pmod("h", F.col("outer_blocks"))).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
        # every member once for each block of outer members; an outer member isn't doubled in its own block
        every = own.withColumn("s", F.pmod("h", F.col("segments"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)))
        every = every.where(~is_outer | (F.pmod("h", F.col("outer_blocks")) != F.col("o")))
        keep = ("crowd", "o", F.col("s").cast("long").alias("s"), "rep", "at")
        dealt = outer.select(*keep, F.lit(True).alias("outer")).unionByName(every.select(*keep, F.lit(False).alias("outer")))
        thick = reps.select("rep", "n", "sketch").join(sets.select(F.col("id").alias("rep"), "set"), "rep")
        dealt = dealt.join(thick, "rep")
        more = dealt.groupBy("crowd", "o", "s").applyInArrow(lambda table: joining_links(table, percent, far), "a long, b long")
        labels = components(links.unionByName(more))

    of_rep = reps.select("fp1", "fp2", "rep").join(labels, F.col("rep") == F.col("id"), "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component_id"))
    own = filled.select("id", "n_shingles", "fp1", "fp2").join(of_rep, ["fp1", "fp2"], "left").select("id", "n_shingles", "component_id")
    empty = prints.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = own.unionByName(empty)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
