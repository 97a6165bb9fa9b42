"""Line dedup by pairwise alignment with earlier documents.

A passage is a run of consecutive lines of at least ``min_words`` words; lines
without words don't count, neither as lines nor as breaks. A passage that stands
in an earlier document (smaller id) too is deleted, wherever it stands there.

1. Single lines may be common, so what is looked up are rare runs of them: each
   document's minimal blocks, that is from each line on the shortest run that has
   ``min_words`` words, and the shortest such run that ends with each line. Equal
   passages have equal minimal blocks, and these cover all lines of the passage.
2. A block's partner is the document with the smallest id that has it (one
   aggregation with map-side sums). So each block names at most one pair of
   documents, whatever number of documents share it, and work is linear.
3. The lines of a later document's blocks meet the lines of its partner's shared
   blocks and are aligned by patience diff: lines unique on both sides, their
   longest increasing run, and what lies between again. Aligned runs that hold a
   whole block are deleted from the later document. Blocks that stand in another
   order there are aligned in further rounds; where only repeated lines are left,
   a block is taken where its hash says it stands.

Hashes that more than 1/HEAVY of all blocks have (at most HEAVY of them) are
settled by a broadcast, and documents that are partner to more than 1/HEAVY of all
pairs are dealt out over salts, so no key is hot.

Cases: a null text stays null; a passage repeated inside one document alone stays;
lines without words go when the lines with words on both sides go, or when all lines
with words go; documents with equal ids count as one document for matching, and
each gets the deletions of its own text; rows with a null id are never changed and
never first; a document whose lines are all deleted becomes an empty text; an empty
table gives no rows; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialise, slices, split_marked

HEAVY = 2000


def longest_run(values):
    """Indexes of a longest strictly increasing subsequence."""
    from bisect import bisect_left

    tails, at, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(own, other):
    """Patience alignment of two lists of lines: sorted pairs of places that match, rising on both sides."""
    from collections import Counter

    out, regions = [], [(0, len(own), 0, len(other))]
    while regions:
        a, a_end, b, b_end = regions.pop()
        while a < a_end and b < b_end and own[a] == other[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and own[a_end - 1] == other[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        there = Counter(other[b:b_end])
        at = {x: k for k, x in enumerate(other[b:b_end], b) if there[x] == 1}
        here = Counter(own[a:a_end])
        once = [(k, at[x]) for k, x in enumerate(own[a:a_end], a) if here[x] == 1 and x in at]
        anchors = [once[k] for k in longest_run([y for _, y in once])]
        out += anchors
        if anchors:
            for x, y in [*anchors, (a_end, b_end)]:
                regions.append((a, x, b, y))
                a, b = x + 1, y + 1
    return sorted(out)


def struck(own: dict, other: dict, blocks) -> set:
    """Places of the lines to delete from the later document. ``own``, ``other``: place -> line of
    both documents; ``blocks``: (first, last) places of the blocks known to stand in the other one."""
    there = sorted(other)
    gone: set = set()
    left = set(blocks)
    while left:
        here = sorted({k for first, last in left for k in range(first, last + 1)})
        pairs = aligned([own[k] for k in here], [other[k] for k in there])
        run_of, run, before = {}, 0, None  # places that go on together on both sides are one run
        for x, y in pairs:
            x, y = here[x], there[y]
            if before != (x - 1, y - 1):
                run += 1
            run_of[x], before = run, (x, y)
        hit = {(i, j) for i, j in left if i in run_of and run_of[i] == run_of.get(j)}
        if not hit:
            break
        whole = {run_of[i] for i, _ in hit}
        gone.update(k for k, r in run_of.items() if r in whole)
        left -= hit
    for i, j in left:  # lines that repeat on a side and have no anchor beside them
        gone.update(range(i, j + 1))
    return gone


def blocks(text: bytes, min_words: int):
    """(hash of 8 bytes, place of the first line, line hashes, line numbers, lines) of each minimal block. Places count
    lines with words; ``line numbers`` has one more, of the next line with words; ``lines``: how many have words."""
    from hashlib import blake2b

    lines = text.split(b"\n")
    at, upto, marks = [], [0], []
    for i, line in enumerate(lines):
        if n := len(line.split()):  # of bytes: cut at ASCII white space
            at.append(i)
            upto.append(upto[-1] + n)
            marks.append(blake2b(line.strip(b" "), digest_size=16).digest())
    at.append(len(lines))
    last, i = len(marks), 0

    def block(i, j):
        h = marks[i][:8] if j == i + 1 else blake2b(b"".join(marks[i:j]), digest_size=8).digest()
        return h, i, b"".join([m[:8] for m in marks[i:j]]), at[i : j + 1], last

    for j in range(1, last + 1):
        before = i
        while upto[j] - upto[i] >= min_words:  # line i's first end is j
            yield block(i, j)
            i += 1
        if i == before and i:  # line j ends no such block: the shortest one that ends with it
            yield block(i - 1, j)


def spans(gone: set, number: dict, lines: int):
    """(first, last, next, ends) of runs of places: line numbers, and ``ends``: 1 if no line with words is before, plus 2 if none is after."""
    out, run = [], []
    for k in [*sorted(gone), None]:
        if run and k != run[-1] + 1:
            out.append((number[run[0]], number[run[-1]], number[run[-1] + 1], (run[0] == 0) + 2 * (run[-1] + 1 == lines)))
            run = []
        run.append(k)
    return out


def doomed_lines(found) -> list[int]:
    """Line numbers of one document to delete. ``found``: (first, last, next, ends) of its runs to delete."""
    out, first, last, follow, ends = [], 0, -1, -1, 0
    for a, b, c, e in sorted(found):
        if a > follow:
            out += range(first, last + 1)
            first, last, follow, ends = a, b, c, e
        elif b > last:
            last, follow, ends = b, c, ends & 1 | e & 2
        else:
            ends |= e
    return [*range(follow)] if ends == 3 else [*out, *range(first, last + 1)]


def find_blocks(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """id, body (hash of the text), h, place, marks (line hashes, 8 bytes each), numbers, lines: a row for each minimal block."""
    docs = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("body"), F.encode(text_col, "UTF-8").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.binary(8), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int32())

        def table():
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            columns[2] = pa.array(np.frombuffer(b"".join([r[2] for r in rows]), "<i8"))
            return pa.RecordBatch.from_arrays(columns, ["id", "body", "h", "place", "marks", "numbers", "lines"])

        rows: list = []
        for part in slices(batches, 256, chars=4_000_000):
            for id_, body, text in zip(*(part.column(c).to_pylist() for c in ("id", "body", "text")), strict=True):
                for found in blocks(text, min_words):
                    rows.append((id_, body, *found))
                    if len(rows) >= 20_000:
                        yield table()
                        rows = []
        yield table()

    return batched(thin).mapInArrow(run, "id long, body long, h long, place int, marks binary, numbers array<int>, lines int")


def partnered(found: DataFrame) -> DataFrame:
    """The blocks that several documents have, with their partner (pid, pbody): the first document that has them."""
    first = found.groupBy("h").agg(F.min(F.struct("id", "body")).alias("x"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"))
    first = materialise(first.where("x.id < most").select("h", F.col("x.id").alias("pid"), F.col("x.body").alias("pbody"), "n"), "firsts")
    heavy = F.broadcast(first.where(F.col("n") * HEAVY > found.count()))  # fewer than HEAVY rows
    settled = found.join(heavy, "h").drop("n")
    rest = found.join(heavy.select("h"), "h", "left_anti").join(first.drop("n"), "h")
    return settled.unionByName(rest)


def deletions(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = 15) -> DataFrame:
    """id, body (hash of the text), doomed array<int>: the line numbers to delete, for documents that have some."""
    found = materialise(find_blocks(docs, id_col, text_col, min_words), "blocks")
    shared = materialise(partnered(found).where("id > pid or id = pid and body = pbody"), "shared")
    one = F.struct("place", "marks", "numbers", "lines")
    later = shared.where("id > pid").groupBy("pid", "pbody", "id", "body").agg(F.collect_set(one).alias("own"))
    later = materialise(later, "later")
    first = shared.where("id = pid").groupBy("pid", "pbody").agg(F.collect_set(F.struct("place", "marks")).alias("other"))
    most = later.count() / HEAVY
    crowded = later.groupBy("pid", "pbody").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    crowded = F.broadcast(crowded.select("pid", "pbody", F.ceil(F.col("n") / F.lit(max(most, 1.0))).alias("salts")))  # fewer than HEAVY rows
    many = F.coalesce("salts", F.lit(1))
    later = later.join(crowded, ["pid", "pbody"], "left").withColumn("salt", F.pmod(F.xxhash64("id", "body"), many)).drop("salts")
    first = first.join(crowded, ["pid", "pbody"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("salts")
    pairs = later.join(first, ["pid", "pbody", "salt"]).select("id", "body", "own", "other")

    def lines_of(rows):
        return {r["place"] + k: r["marks"][8 * k : 8 * k + 8] for r in rows for k in range(len(r["marks"]) // 8)}

    def align(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("id", "body", "own", "other")]
            for k in range(batch.num_rows):  # one pair at a time
                id_, body, own, other = (c[k].as_py() for c in columns)
                at = [(r["place"], r["place"] + len(r["marks"]) // 8 - 1) for r in own]
                number = {r["place"] + k: x for r in own for k, x in enumerate(r["numbers"])}
                rows += [(id_, body, *x) for x in spans(struck(lines_of(own), lines_of(other), at), number, own[0]["lines"])]
            kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
            out = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], ["id", "body", "first", "last", "next", "ends"])

    fields = ("first", "last", "next", "ends")
    runs = batched(pairs).mapInArrow(align, "id long, body long, first int, last int, next int, ends int")
    grouped = runs.groupBy("id", "body").agg(F.collect_set(F.struct(*fields)).alias("rows"))  # one document's runs

    def of_docs(batches):
        import pyarrow as pa

        for batch in batches:
            lists = [doomed_lines([tuple(r[f] for f in fields) for r in rows]) for rows in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("body"), pa.array(lists, pa.list_(pa.int32()))], ["id", "body", "doomed"])

    return batched(grouped).mapInArrow(of_docs, "id long, body long, doomed array<int>")


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = 15, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the deletions applied to the text; ``counts`` names two more
    columns for the number of lines before and of those deleted."""
    doomed = materialise(deletions(docs, id_col, text_col, min_words), "doomed")
    touched, whole = split_marked(docs, id_col, doomed, "id")
    same = (F.col(f"d.`{id_col}`").cast("long") == F.col("x.id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("x.body"))
    joined = touched.alias("d").join(doomed.alias("x"), same, "left")
    listed = F.col("x.doomed")
    #: deleted lines are struck by index in one pass: map lookups stay constant-time for long documents
    mask = F.map_from_arrays(listed, listed)

    def columns(new, gone):
        text = F.col(f"d.`{text_col}`")
        out = [new(text).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
        if counts:
            out += [F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("int").alias(counts[0]), gone.cast("int").alias(counts[1])]
        return out

    def struck(text):
        left = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.map_contains_key(mask, i)), "\n")
        return F.when(listed.isNull(), text).otherwise(left)

    changed = joined.select(*columns(struck, F.coalesce(F.size(listed), F.lit(0))))
    return changed.unionByName(whole.alias("d").select(*columns(lambda text: text, F.lit(0))))
