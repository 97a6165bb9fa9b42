"""Best-fit packing with exact-complement hashing.

Documents are tokenised and cut into pieces of at most ``room`` tokens. The plan
is made over lengths, not pieces: with the number of pieces of each of the at
most ``room`` lengths, the longest length with pieces left looks up what fills
its gap exactly: one length, then a pair, then a triple, from an index of length
sums; as many sequences of that pattern are made as the counts allow. What has
no exact complement is packed best-fit, longest first. The plan has a few rows
for each length and is the same size at any scale; pieces then find their place
by their rank within their length.

Ranks are two-level (a count for each length and hash bucket, then a rank within
it), so a length that a third of all pieces have is no hot spot.

Cases: a null or empty text has the end id alone; rows with equal ids are
packed each (their order among themselves is by the crc, then arbitrary but
they are equal); null ids are packed too; an empty table gives no rows; other
columns are ignored; only documents longer than ``room`` are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, give_back, materialise, slices
from .pieces import WordIds, made

SALTS = 64


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int, id_col: str, text_col: str, lean: bool = False) -> DataFrame:
    def run(batches):
        import zlib

        import pyarrow as pa

        encoder, end = made(WordIds, tokenizer), end_id.to_bytes(4, "little")
        encode = encoder.many
        for part in slices(batches, 1000, chars=4_000_000):
            rows = []
            for d, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * room)):
                    own = ids[a : a + 4 * room]
                    rows.append((d, k, a // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if lean:
            encoder.forget()
            give_back()

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return batched(thin).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts, room: int):
    """Patterns (lengths, copies) that use up ``counts`` (pieces by length, index 0 unused)."""
    import numpy as np

    left = np.asarray(counts, np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        times = int(min(left[x] // n for x, n in need.items()))
        for x, n in need.items():
            left[x] -= times * n
        patterns.append((pattern, times))

    def pair(total: int, x: int):
        """(a, b) with a + b = total, both there beside one piece of length x; a is the longest possible."""
        a = np.arange(max(1, (total + 1) // 2), total)
        b = total - a
        ok = (left[a] - (a == x) > (a == b)) & (left[b] - (b == x) > 0)
        at = np.flatnonzero(ok)
        return (int(a[at[-1]]), int(b[at[-1]])) if len(at) else None

    def exact(x: int):
        gap = room - x
        if gap == 0:
            return (x,)
        if left[gap] > (gap == x):
            return (x, gap)
        if p := pair(gap, x):
            return (x, *p)
        for a in range(gap - 2, (gap - 1) // 3, -1):  # the longest of a triple first
            if a < x and left[a] and (p := pair(gap - a, x)) and p[0] <= a:
                if (x, a, *p).count(a) <= left[a] and (x, a, *p).count(p[1]) <= left[p[1]]:
                    return (x, a, *p)
        return None

    residual = np.zeros_like(left)
    for x in range(room, 0, -1):
        while left[x]:
            found = exact(x)
            if found is None:
                # best fit later; one piece at a time only while complements may appear for the rest: none can, counts only fall
                residual[x], left[x] = left[x], 0
            else:
                take(found)
    # best fit decreasing over what is left: open sequences by free room, as counts of equal contents
    free: dict[int, list[list]] = {}  # room left -> [[pattern, copies]]
    for x in range(room, 0, -1):
        n = int(residual[x])
        while n:
            fit = next((r for r in sorted(free) if r >= x), None)
            if fit is None:
                each = room // x
                if n >= each:
                    made_, pattern = n // each, (x,) * each
                else:
                    made_, pattern = 1, (x,) * n
                n -= made_ * len(pattern)
                rest = room - x * len(pattern)
            else:
                group = free[fit][-1]
                made_ = min(n, group[1])
                group[1] -= made_
                pattern, rest = (*group[0], x), fit - x
                n -= made_
                if not group[1]:
                    free[fit].pop()
                    if not free[fit]:
                        del free[fit]
            free.setdefault(rest, []).append([pattern, made_])
    return patterns + [(p, c) for groups in free.values() for p, c in groups if c]


def slots(patterns):
    """The plan as arrays sorted by (length, first rank): length, rank, first sequence, offset; each slot holds consecutive ranks."""
    import numpy as np

    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, copies in patterns:
        offset = 0
        for x in pattern:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + copies
            offset += x
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = 4096, id_col="doc_id", text_col="text", lean: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.
    ``lean``: workers empty their caches of pieces after each task, for jobs that go on with other work."""
    import numpy as np

    spark = docs.sparkSession
    pieces = tokenised_pieces(docs, tokenizer, end_id, room, id_col, text_col, lean)
    pieces = materialise(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")), "pieces")
    # at most room * SALTS rows
    cells = materialise(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "cells")
    counts = np.zeros(room + 1, np.int64)
    for length, n in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[length] = n
    shared = spark.sparkContext.broadcast(slots(plan(counts, room)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("inside", F.row_number().over(inside) - 1).join(F.broadcast(cells), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank"))

    def place(batches):
        import pyarrow as pa

        table = shared.value
        wide = np.int64(1) << 40
        keys = table[:, 0] * wide + table[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(table[at, 3])], [*b.schema.names[:5], "sequence_id", "offset"])

    out = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
