"""Document operators against brute force on small tables, with the odd cases: nulls, empty
and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wordloom.llm import exact_dedup, langid, line_dedup, media, mixing, near_dedup, packing, pieces, token_count, token_orc, toxicity
from wordloom.llm.common import new_path

BYTE, WORD = pieces.default_path("byte_bpe_50k.json"), pieces.default_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id int, size string"


def table(spark, texts, lang="en", source="s"):
    """Documents 0, 1, ... with columns whose names clash with the operators' own."""
    rows = [(i, t, lang, source, None, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentences(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "Sigma", "été", "tau"]) + str(rng.randrange(60)) for _ in range(n))


ODD = [None, "", " ", "one", "a b c d e", "A B c D e", "a  b\n\nc", "x" * 30_000, "<|endoftext|> inside", "naïve — “quoted” 日本", "tail\n", " lead", "one"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [sentences(rng, 120) for _ in range(8)]
    out = list(ODD)
    for b in base:
        words = b.split()
        out.append(b)
        for k in (1, 3, 6):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = "new"
            out.append(" ".join(w))
    out += [base[0]] * 4
    hub = sentences(rng, 150).split()  # a crowd of near copies that are not all alike
    for _ in range(40):
        w = list(hub)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_exact_dedup(spark, texts):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(table(spark, texts), support=0.03).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        assert tuple(got[i])[:4] == (i, max(g), len(g), i == max(g))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(table(spark, [])).collect() == []


@pytest.mark.parametrize("small", [24, 2])
def test_near_duplicates(spark, texts, small):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(table(spark, texts), threshold=0.85, small=small, block=8).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(table(spark, [])).collect() == []


def test_token_orc(spark, texts):
    from tokenizers import Tokenizer

    path = new_path(spark, "t")
    token_orc.write_tokens(table(spark, texts), path, BYTE, end_id=2)
    library, start = Tokenizer.from_file(BYTE), 0
    got = {r["doc_id"]: r for r in token_orc.token_table(spark, path).collect()}
    stored = {r["doc_id"]: r["ids"] for r in token_orc.read_tokens(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert stored[i] == ids
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(pieces.pack(ids)))
        start += len(ids)


def test_byte_ids_of_many_words_at_a_time():
    from tokenizers import Tokenizer

    library, encoder, calls = Tokenizer.from_file(BYTE), pieces.ByteIds(BYTE), []
    model = encoder.model

    class Counted:
        def tokenize(self, text):
            calls.append(text)
            return model.tokenize(text)

    encoder.model = Counted()
    texts = [" ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzéßàÿ'[i // 100 % 10]}{'.' * (i % 3)}" for i in range(a, a + 500)) for a in (0, 250, 500)]
    assert encoder.many(texts) == [pieces.pack(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(calls) < 30  # of 1,000 words


def test_byte_ids_when_most_pieces_are_forgotten():
    from tokenizers import Tokenizer

    rnd, library = random.Random(3), Tokenizer.from_file(BYTE)
    signs = [*"abstTS''.,%-(31éàß", "'s", "'ll", " ", " ", "\n", " the", "\x00", "日", "×", "  ", "<|endoftext|>"]
    texts = [None, "", *("".join(rnd.choices(signs, k=rnd.randint(1, 25))) for _ in range(3000))]
    wanted = [pieces.pack(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for together in (1, 7):
        encoder = pieces.ByteIds(BYTE, limit=200, together=together)
        assert [x for a in range(0, len(texts), 100) for x in encoder.many(texts[a : a + 100])] == wanted
        assert len(encoder.known) <= 200
    encoder.apart = None  # a vocabulary without a byte that no merge has
    assert encoder.many(texts) == wanted


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    for r in token_count.count_tokens(table(spark, texts), BYTE).collect():
        t = texts[r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)


def test_media_round_trip(spark, texts):
    folder = new_path(spark, "m")
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in media.media_columns(docs, folder, shard_bytes=20_000).collect()}
    fs, root = media.open_fs(folder)
    for i, t in enumerate(texts):
        r, p = got[i], media.padded((t or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        stored = fs.open_input_file(f"{root}/{r['shard']}").read_at(r["length"], r["offset"])
        assert media.decode_png(stored) == p and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
    assert len({(r["shard"], r["offset"]) for r in got.values()}) == len({t or "" for t in texts})


def test_media_headers_and_odd_tables(spark, monkeypatch):
    texts = ["a" * 70_000, "b" * 64 * 1031, "c" * 64 * 1024 * 3, "", None] + ["hot"] * 40
    monkeypatch.setattr(media, "HEAVY", 4)  # a fourth of the rows is frequent
    folder = new_path(spark, "m")
    index, again = media.write_shards(table(spark, texts), folder, shard_bytes=20_000)
    assert {r["n"] for r in again.collect()} == {2, 40}
    heads = {r["digest"]: r for r in media.header_columns(index, folder).collect()}
    docs = table(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 2, F.col("doc_id")))
    got = media.media_columns(docs, new_path(spark, "m")).collect()
    assert len(got) == len(texts) and [r["doc_id"] for r in got].count(None) == 1
    for r in got:
        t = texts[2 if r["doc_id"] is None else r["doc_id"]] or ""
        assert r["payload_sha256"] == hashlib.sha256(media.padded(t.encode())).hexdigest()
        assert (r["width"], r["height"], r["bits"]) == tuple(heads[r["digest"]][c] for c in ("width", "height", "bits")) and r["width"] * r["height"] == r["payload_bytes"] and r["width"] <= 65_536
    assert media.media_columns(table(spark, []), new_path(spark, "m")).collect() == []


def test_header_columns_read_headers_alone(spark, tmp_path):
    """Payload bytes that are destroyed after writing don't matter to metadata."""
    folder = f"file://{tmp_path}/shards"
    index, _ = media.write_shards(table(spark, ["some text", "x" * 500]), folder)
    rows = index.collect()
    for r in rows:
        with open(f"{tmp_path}/shards/{r['shard']}", "r+b") as f:
            f.seek(r["offset"] + media.HEADER)
            f.write(b"\xff" * (r["length"] - media.HEADER))
    assert sorted(r["width"] * r["height"] for r in media.header_columns(index, folder).collect()) == [64, 512]


def test_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    bands = near_dedup.bands_for(0.85, 5, 1e-7)
    sign, samples = near_dedup.Signer(bands, 5), 5 * bands
    cut, off, low = near_dedup.highest_count(samples, 0.85), [], 0
    for _ in range(200):
        common = rng.integers(0, 1 << 63, 850, np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 75, np.uint64)])) for _ in "ab")
        (x, s), (y, t) = sign(a), sign(b)
        count = int(np.bitwise_count(s.view(np.uint64) ^ t.view(np.uint64)).sum())
        assert (x == y).any() and count <= cut  # in a common bucket, and not cut
        off.append(near_dedup.estimated_similarity(count, samples) - 0.85)
        far = np.unique(np.concatenate([common[:500], rng.integers(0, 1 << 63, 400, np.uint64)]))
        low += int(np.bitwise_count(s.view(np.uint64) ^ sign(far)[1].view(np.uint64)).sum()) > cut  # similarity about 0.38
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05 and low == 200


def test_near_duplicates_of_a_family_that_shares_much(spark):
    """Documents at a similarity of about 0.6 to each other, some with a near copy: only the copies are linked."""
    rng = random.Random(9)
    core = sentences(rng, 150).split()
    texts = []
    for i in range(60):
        own = core + [f"own{i}x{k}" for k in range(45)]
        texts.append(" ".join(own))
        if i % 10 == 0:
            texts.append(" ".join([*own, "end"]))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, texts), threshold=0.85, small=2, block=8).collect()}
    want = {i: i - 1 if t.endswith(" end") else i for i, t in enumerate(texts)}
    assert got == want


def test_rare_shingles_name_every_link_between_components(spark):
    rng = random.Random(5)
    base, rows = list(range(60)), []
    for i in range(120):  # component 0 has ten members, and shingles of its own that they share
        own = rng.sample(base, rng.randrange(50, 60)) + [1000 + i] + ([900, 901] if i < 10 else [])
        rows.append((i, 0 if i < 10 else i, own))
    members = spark.createDataFrame([r[:2] for r in rows], "rep long, at long")
    sets = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, set array<long>")
    links = {(a, b) for a, x, s in rows for b, y, t in rows if x < y and 100 * len({*s} & {*t}) >= 85 * len({*s} | {*t})}
    assert len(links) > 100
    for top in (8, 1024):  # some frequent shingles are joined with their frequency, or none
        got = [tuple(r) for r in near_dedup.rarest(members, sets, 85, top).collect()]
        names: dict = {}
        for rep, at, bucket in got:
            assert at == rows[rep][1]
            names.setdefault(bucket, set()).add(rep)
        assert all(any(a in g and b in g for g in names.values()) for a, b in links)
        assert all(bucket < 900 for bucket in names)  # what one component has alone joins nothing and isn't returned


def test_frequent_shingles_are_not_joined(spark):
    """Rows that a join on shingles makes in a family: those of rare shingles, not of all."""
    members = spark.range(400).selectExpr("id as rep", "id as at")
    sets = spark.range(400).selectExpr("id", "concat(sequence(0L, 99L), array(1000 + id div 2)) as set")
    found = near_dedup.rarest(members, sets, 85, 100)
    assert {tuple(r)[2] for r in found.collect()} >= {1000, 1199}
    as_java = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    made, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif "Join [g#" in node.simpleString(99):
            made.append(node.metrics().apply("numOutputRows").value())
        todo.extend(list(as_java(node.children())))
    assert made == [400]


def test_shingles_of_a_family_are_summed_before_they_are_rows(spark, monkeypatch):
    """Counting makes a row for each shingle and run of members, not one for each member that has it."""
    members = spark.range(0, 400, 1, 2).selectExpr("id as rep", "id as at")
    sets = spark.range(0, 400, 1, 2).selectExpr("id", "concat(sequence(0L, 99L), array(1000 + id div 2)) as set")
    written, real = {}, near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, tag: real(written.setdefault(tag, df), tag))
    near_dedup.rarest(members, sets, 85, 100).collect()
    often = written["often"]
    assert {tuple(r) for r in often.collect()} == {(g, 400) for g in range(100)} | {(1000 + k, 2) for k in range(200)}
    as_java = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    made, todo = 0, [often._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind in ("GenerateExec", "MapInArrowExec"):
            made += node.metrics().apply("numOutputRows" if kind == "GenerateExec" else "pythonNumRowsReceived").value()
        todo.extend(list(as_java(node.children())))
    assert 300 <= made < 400 * 101 / 5


def test_near_duplicates_of_odd_rows(spark):
    """Null and equal ids: rows with a null id belong to their group and never name it."""
    a, b = (sentences(random.Random(k), 30) for k in (1, 2))
    rows = [(None, a), (4, a), (4, b), (9, b), (None, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", 1, "y") for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (9, 4, False), (None, None, False), (7, 7, True)], key=str)


def odd_docs(spark):
    rows = [(None, "one two"), (3, "same"), (3, "same"), (3, "other"), (8, None), (9, "")]
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, "y") for i, t in rows], SCHEMA)


def test_tokens_of_odd_tables(spark):
    for docs, n in ((odd_docs(spark), 6), (table(spark, []), 0)):
        path = new_path(spark, "t")
        token_orc.write_tokens(docs, path, BYTE, end_id=2)
        got = sorted(token_orc.token_table(spark, path).collect(), key=lambda r: r["start"])
        assert len(got) == n and [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(n)]
        assert [r["doc_id"] for r in got] == [None, 3, 3, 3, 8, 9][:n]
        assert token_count.count_tokens(docs, BYTE).count() == n
        packed = packing.pack(docs, WORD, room=2).collect()
        assert sorted(str(r["doc_id"]) for r in packed if r["piece"] == 0) == ["3", "3", "3", "8", "9", "None"][:n]
        spots = [(r["sequence_id"], r["offset"] + k) for r in packed for k in range(r["length"])]
        assert len(spots) == len(set(spots))


def test_orc_files_beyond_five_digits(spark):
    names = ["part-99999-u-c000.zstd.orc", "part-100000-u-c000.zstd.orc", "part-00007-u-c001.zstd.orc", "part-00007-u-c000.zstd.orc"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in frame.orderBy(token_orc.file_number(F.col("name"))).collect()] == [names[3], names[2], names[0], names[1]]


def test_orc_metadata_and_lookup(spark):
    """Several stripes, a row index and Bloom filters are there; a lookup reads few rows of many."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    path = new_path(spark, "t")
    token_orc.write_tokens(docs, path, BYTE, end_id=2, stripe_bytes=1 << 17)
    found = token_orc.lookup(spark, path, [5, 39_999, 70_000])
    assert sorted(r["doc_id"] for r in found.collect()) == [5, 39_999]
    plan = found._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [In(doc_id, [" in plan.toString()
    read = [m for m in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found._jdf.queryExecution().executedPlan().collectLeaves())]
    rows = sum(x.metrics().apply("numOutputRows").value() for x in read)
    assert 2 <= rows <= 8_000
    conf = spark._jsc.hadoopConfiguration()
    orc, fs_path = spark._jvm.org.apache.orc, spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    stripes = indexes = 0
    for status in root.getFileSystem(conf).listStatus(root):
        if status.getPath().getName().endswith(".orc"):
            reader = orc.OrcFile.createReader(status.getPath(), orc.OrcFile.readerOptions(conf))
            stripes += reader.getStripes().size()
            indexes += sum(reader.getStripes().get(k).getIndexLength() > 0 for k in range(reader.getStripes().size()))
            assert reader.getRowIndexStride() == 1000
    assert stripes > 4 and indexes == stripes


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    library, room = Tokenizer.from_file(WORD), 700
    rows = packing.pack(table(spark, texts), WORD, room=room).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        total += len(ids)
        assert [r["length"] for r in own] == [len(ids[a : a + room]) for a in range(0, len(ids), room)]
        assert all(r["ids_crc32"] == zlib.crc32(pieces.pack(ids[r["start"] : r["start"] + r["length"]])) for r in own)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= room
    free: list[int] = []  # plain best fit, longest first
    for n in sorted((r["length"] for r in rows), reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else room) - n)
    assert -(-total // room) <= len(by_sequence) <= len(free)


def test_plan_uses_every_piece():
    rng = random.Random(3)
    for _ in range(60):
        room = rng.randrange(1, 30)
        counts = [0, *(rng.randrange(6) for _ in range(room))]
        used = Counter()
        for pattern, copies in packing.plan(counts, room):
            assert sum(pattern) <= room and copies > 0
            for x in pattern:
                used[x] += copies
        assert [used[x] for x in range(room + 1)] == counts


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, sentences(rng, rng.randrange(1, 90)), None if i % 7 == 0 else f"s{i % 5}") for i in range(800)] + [(900, None, "s1"), (901, "", "zero"), (902, "one", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3)).collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    total, whole = Counter(), sum(size.values())
    for i, _, s in rows:
        total[s] += size[i]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = whole - sum(3 * total[s] for s in full)
        share = {s: rest * w[s] / sum(w[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 3 * total[s]}
        if not over:
            target = share | {s: 3.0 * total[s] for s in full}
            break
        full |= over
    taken, source = Counter(), {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == again[r["doc_id"]]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 5 for s in names)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_mixing_rates_are_the_balanced_ones(spark):
    """Rates equal those of a plain bisection of each source's dual, meet the targets, and differ inside a source."""
    import math

    rng = random.Random(12)
    rows = [(i, "w " * min(300, int(3 * rng.paretovariate(1.2))), f"s{i % 4}") for i in range(1200)] + [(2000 + i, "w " * 9, "tiny") for i in range(3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    for name in ("s0", "s1", "s2", "s3", "tiny"):
        own = [r for r in got if source[r["doc_id"]] == name]
        sizes, target = [r["size"] for r in own], own[0]["target"]
        mean = sum(sizes) / len(sizes)

        def words(x):
            return sum(n * (3.0 if x * n / mean > 2 else min(3.0, math.exp(x * n / mean))) for n in sizes)

        low, high = -1e4, 1e4
        for _ in range(200):
            low, high = ((low + high) / 2, high) if words((low + high) / 2) < target else (low, (low + high) / 2)
        for r in own:
            assert r["rate"] == pytest.approx(min(3.0, math.exp(min(2, high * r["size"] / mean))), rel=1e-4)
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(target, rel=1e-6)
        if name != "tiny":
            assert len({round(r["rate"], 6) for r in own}) > 5
            assert abs(sum(r["taken"] for r in own) - target) <= 0.002 * target + 10
        assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) or r["copies"] == r["rate"] == 3 for r in own)


def test_mixed_rows(spark):
    """Clashing columns, null ids, repeated rows and null texts: rows come as often as ``mix`` says."""
    rows = [(i // 2 if i % 5 else None, f"{'w ' * (i % 11)}", "en", f"s{i % 3}", None, "x", 1, "y") for i in range(120)] + [(7, None, "en", None, 0, "x", 1, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and mixing.mixed(docs.limit(0)).collect() == []
    want, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    for r in out.collect():
        got[r["doc_id"], len(r["text"].split())] += 1
    assert got == +want and sum(got.values())


def test_line_dedup(spark):
    rng = random.Random(2)
    passage, boiler = sentences(rng, 60), "short common line"
    own = [sentences(rng, 20) for _ in range(40)]
    texts = [f"{own[3 * i]}\n{boiler}\n{own[3 * i + 1]}" for i in range(5)]
    texts[2] = f"{own[30]}\n{passage}\n{own[31]}"
    texts += [f"{own[32]}\n{boiler}\n{passage}", texts[0], None, "", "\n", f"{own[33]}\n{own[33]}"]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table(spark, texts), counts=("n", "gone")).collect()}
    for i in (0, 1, 2, 3, 4, 7, 8, 9, 10):
        assert got[i]["text"] == texts[i] and got[i]["gone"] == 0
    assert got[5]["text"] == f"{own[32]}\n{boiler}" and got[6]["text"] == "" and got[6]["gone"] == 3
    assert got[0]["kept"] == "x"
    assert line_dedup.dedup_lines(table(spark, [])).collect() == []


def test_toxicity_sample_passes_over_texts_that_do_not_fit(spark):
    order = [r["id"] for r in spark.range(10).orderBy(F.xxhash64("id"), "id").collect()]
    sizes = dict(zip(order, [5000, 900, 200, *[50] * 7], strict=True))
    docs = table(spark, ["t" * sizes[i] for i in range(10)] + ["clean"] * 5)
    rated = spark.createDataFrame([(i, int(i < 10)) for i in range(15)], "id long, toxic int")

    def sampled(labels):
        got = toxicity.sample_features(docs, labels, "doc_id", "text", "toxic", 90, 3000)
        return sorted(r["label"] for r in got.collect())

    rated = rated.withColumnRenamed("id", "doc_id")
    assert sampled(rated) == [0] * 5 + [1] * 3  # 900 + 50 + 50 of 1,000 bytes
    with pytest.raises(ValueError):
        sampled(rated.where((F.col("toxic") == 0) | (F.col("doc_id") == order[0])))


def short_lines(tag: str, n: int) -> list[str]:
    return [" ".join(f"{tag}{i}w{k}" for k in range(10)) for i in range(n)]


def lines_left(spark, texts) -> list[str]:
    return [r["text"] for r in line_dedup.dedup_lines(table(spark, texts)).orderBy("doc_id").collect()]


def test_line_dedup_of_a_passage_in_many_documents(spark):
    passage = "\n".join(short_lines("p", 6))
    own = short_lines("own", 1001)
    assert lines_left(spark, [f"{line}\n{passage}" for line in own]) == [f"{own[0]}\n{passage}", *own[1:]]


def test_line_dedup_of_repeated_lines(spark):
    a, b, c = short_lines("p", 3)
    text = "\n".join([a, b, a, a, c, b])
    assert lines_left(spark, [text, text]) == [text, ""]
    long = f"{a} {b}"  # deleted at each of its places, and not in the first document
    assert lines_left(spark, [f"{long}\n{c}\n{long}", f"{long}\n{long}\nend"]) == [f"{long}\n{c}\n{long}", "end"]


def test_line_dedup_of_lines_with_other_first_documents(spark):
    p = short_lines("p", 6)
    passage = "\n".join(p)
    assert lines_left(spark, [p[1], p[3], p[5], passage, passage]) == [p[1], p[3], p[5], passage, ""]


def test_line_dedup_over_blank_lines(spark):
    p = short_lines("p", 6)
    spaced, end = "\n\n".join(p), "an own end"
    got = lines_left(spark, [spaced, f"\n{spaced}\n \n", f"top\n\n{spaced}\n\n{end}", "\n".join(p)])
    assert got == [spaced, "", f"top\n\n\n{end}", ""]
    whole = "\n\n".join(f"{x} {x}" for x in p)  # each line a block of its own
    assert lines_left(spark, [whole, whole]) == [whole, ""]


def test_alignment_keeps_order():
    assert line_dedup.aligned("abcd", "xabyd") == [(0, 1), (1, 2), (3, 4)]
    assert line_dedup.aligned("abcdef", "defabc") in ([(0, 3), (1, 4), (2, 5)], [(3, 0), (4, 1), (5, 2)])
    assert line_dedup.aligned("abaacb", "abaacb") == [(k, k) for k in range(6)]
    assert line_dedup.aligned("", "a") == line_dedup.aligned("a", "b") == []
    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcdefgh"[: rng.randrange(2, 9)]) for _ in range(rng.randrange(9))) for _ in "12")
        got = line_dedup.aligned(a, b)
        assert all(a[x] == b[y] for x, y in got)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:]))


def test_line_dedup_against_brute_force(spark):
    """Random documents of lines of all sizes, many shared, moved and repeated: what stands in an earlier
    document as a run of at least 15 words goes, found by comparing all runs of all pairs."""
    rng = random.Random(11)
    pool = [" ".join(f"v{i}w{k}" for k in range(rng.choice([1, 3, 5, 8, 14, 15, 20]))) for i in range(25)]
    texts = []
    for _ in range(60):
        lines: list[str] = []
        while len(lines) < rng.randrange(1, 14):
            if texts and rng.random() < 0.5:
                other = rng.choice(texts).split("\n")
                a = rng.randrange(len(other))
                lines += other[a : a + rng.randrange(1, 6)]
            else:
                lines.append(rng.choice([*pool, "", " ", sentences(rng, rng.randrange(1, 20))]))
        texts.append("\n".join(lines))
    worded = [[(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    want = []
    for d, own in enumerate(worded):
        gone = set()
        runs = {tuple(x for _, x in w[a:b]) for w in worded[:d] for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                part = tuple(x for _, x in own[a:b])
                if part in runs and sum(len(x.split()) for x in part) >= 15:
                    gone |= {k for k, _ in own[a:b]}
        want.append(sorted(gone))
    got = {r["id"]: r["doomed"] for r in line_dedup.deletions(table(spark, texts)).collect()}
    blank = lambda d, k: not texts[d].split("\n")[k].split()
    assert [[k for k in got.get(d, []) if not blank(d, k)] for d in range(len(texts))] == want
    assert sum(map(bool, want)) > 20


def test_line_dedup_of_odd_rows(spark):
    """Null and repeated ids, repeated rows, a very long text."""
    a, b = ("\n".join(short_lines(x, 4)) for x in "ab")
    long = "\n".join(short_lines("l", 3000))
    rows = [(None, a), (None, a), (5, a), (5, b), (5, a), (6, f"{b}\n{a}"), (7, None), (8, long), (9, f"{a}\n{long}\nown")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", 1, "y") for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(None, a), (None, a), (5, a), (5, b), (5, a), (6, ""), (7, None), (8, long), (9, "own")], key=str)


def test_langid(spark):
    rng = random.Random(4)
    kinds = {"en": "the of and thing with was".split(), "de": "der und die nicht schön über".split(), "fr": "le et que était où ça".split()}
    rows = [(i, " ".join(rng.choice(kinds[x]) for _ in range(30)), x) for i in range(150) for x in [("en", "de", "fr")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 90"))
    test = docs.where("doc_id >= 90").union(spark.createDataFrame([(200, None, "en"), (201, "", None), (202, "12 !?", "de"), (203, "ü", "de")], docs.schema))
    got = {r["doc_id"]: r for r in langid.predict(test, model).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows if i >= 90)
    assert all(tuple(got[i])[1:] == ("und", 0.0) for i in (200, 201, 202)) and 0 < got[203]["score"] <= 1
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_langid_against_brute_force(spark, monkeypatch):
    """Log-probabilities, priors and posteriors as counted one n-gram at a time."""
    import math

    rows = [(0, "ab", "x"), (1, "Ab cc", "x"), (2, "bca", "y"), (3, "q", None), (4, "zz top", "z"), (5, "abc", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(t, buckets):
        pair, triple, _, _ = langid._grams([t], buckets)
        return [*pair.tolist(), *triple.tolist()]

    for buckets, most in ((langid.BUCKETS, langid.MOST_CELLS), (8, 24)):  # the second: fewer buckets for want of cells
        monkeypatch.setattr(langid, "MOST_CELLS", most)
        langs, logp, priors = langid.train(docs)
        assert langs == ["x", "y", "z"] and logp.shape == (buckets, 3)
        count = {k: Counter(g for _, t, x in rows if x == k for g in grams(t, buckets)) for k in langs}
        assert priors == pytest.approx([math.log(3 / 5), math.log(1 / 5), math.log(1 / 5)])
        for k, c in enumerate(count.values()):
            for g in range(min(buckets, 300)):
                assert logp[g, k] == pytest.approx(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * buckets)), rel=1e-5)
        got = {r["doc_id"]: r for r in langid.predict(docs, (langs, logp, priors)).collect()}
        for i, t, _ in rows:
            z = [p + sum(float(logp[g, k]) for g in grams(t, buckets)) for k, p in enumerate(priors)]
            best = max(range(3), key=z.__getitem__)
            assert got[i]["lang_pred"] == langs[best]
            assert got[i]["score"] == pytest.approx(1 / sum(math.exp(v - z[best]) for v in z), rel=1e-6)


def test_gram_counts(spark):
    docs = spark.createDataFrame([(0, "ab", "x"), (1, "ab c", "x"), (2, None, "x"), (3, "q", None)], "doc_id long, text string, lang string")
    want = Counter()
    for t in ("ab", "ab c"):
        pair, triple, _, _ = langid._grams([t], langid.BUCKETS)
        want.update([*pair.tolist(), *triple.tolist()])
    assert {r["bucket"]: r["n"] for r in langid.count_grams(docs).collect()} == dict(want)


def test_toxicity_gradient_and_noisy_or():
    """On tiny bags the fit lowers the loss that is summed sentence by sentence, to where no single weight lowers it further; scores are that noisy-or."""
    import math

    import numpy as np

    docs = [[[1, 2], [3]], [[2], [4, 4]], [[3, 1], [2]], [[4], [1]], [[2, 3]], [[4, 3], [2]]]
    labels = [0, 1, 0, 1, 0, 1]
    flat, offsets = [], [0]
    for d in docs:
        for k, sentence in enumerate(d):
            flat += ([-2] if k else []) + sentence
        offsets.append(len(flat))

    def loss(w):
        total = 0.0
        for d, y in zip(docs, labels, strict=True):
            clean = math.prod(1 - 1 / (1 + math.exp(-(w[-1] + sum(w[x] for x in s)))) for s in d)
            total -= math.log(1 - clean if y else clean) / len(docs)
        return total + 0.01 * sum(abs(w[x]) for x in range(1, 5))

    w = toxicity.fit(np.array(labels, bool), np.array(flat, np.int32), np.array(offsets, np.int64), l1=0.01, rounds=4000, rate=0.05, least_docs=1).astype(float)
    best = loss(w)
    for x in (1, 2, 3, 4, -1):
        for step in (0.05, -0.05):
            v = w.copy()
            v[x] += step
            assert loss(v) > best - 1e-3
    scorer = toxicity.Scorer(w)
    z = scorer.sentences("Bad word. good\nend")[0]
    assert scorer.score("Bad word. good\nend") == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z))


def test_toxicity_of_empty_tables(spark):
    nothing, rated = table(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    weights = toxicity.train(nothing, rated)
    assert toxicity.score(nothing, weights).collect() == [] and toxicity.filter_toxic(nothing, weights).collect() == []
    assert [r["predicted"] for r in toxicity.score(odd_docs(spark), weights).collect()] == [0] * 6


def test_toxicity(spark):
    rng = random.Random(6)
    texts, rated = [], []
    for i in range(400):
        s = [" ".join(rng.choice(["sun", "road", "tree", "cup", "door"]) for _ in range(8)) + "." for _ in range(4)]
        if i % 4 == 0:
            s[2] = "you vile fool go away."
        texts.append(" ".join(s[:2]) + "\n" + " ".join(s[2:]))
        rated.append((i, int(i % 4 == 0)))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([*rated, (9999, 1), (3, None)], "doc_id long, toxic int")
    weights = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, weights).collect()}
    assert all(got[i]["predicted"] == y for i, y in rated)
    assert got[400]["score"] == got[401]["score"] == 0
    span = got[0]["offending"][0]
    assert "vile" in texts[0][span["start"] : span["start"] + span["length"]] and len(got[0]["offending"]) == 1
    left = toxicity.filter_toxic(docs, weights)
    assert left.columns == docs.columns and left.count() == 302
    assert toxicity.train(docs, labels.where("toxic is null"))[-1] < 0
