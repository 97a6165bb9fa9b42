"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut after . ! ? and at line ends). A sentence
has the probability p = sigmoid(b + sum of its words' weights); a document is
toxic with 1 - prod(1 - p), the noisy-or of its sentences. The weights of hashed
lower-case words are trained from document labels alone by the gradient of that
likelihood with an L1 penalty, so that few words carry weight; sentences with
p >= 0.5 are then the offending ones.

Training takes a bounded sample: of each label at most ``max_docs`` documents (a
third as many toxic ones) and ``max_bytes`` of their text (a third for toxic ones),
in order of a hash of the id. A text that no longer fits is passed over, and smaller
ones that follow are taken; if no text of a label fits, training fails. The labels'
shares among all labelled documents are kept by weights. Scoring reads every whole text.

Cases: null and empty texts have no sentence and get the score of an empty bag,
0; null labels teach nothing; several label rows of one document all count; with
no labels all scores are 0; rows repeat as they come; other columns are ignored
(``filter_toxic`` passes them through).
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, slices, utf8
from .pieces import _Cache

BITS = 18
EDGE = ".,;:!?\"'()[]{}*_-…«»“”‘’"


def word_slot(piece: str) -> int:
    """The hashed feature of a word, or -1 for what has no word in it."""
    word = piece.strip(EDGE).lower()
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) if word else -1


def _is_end(piece: str) -> bool:
    return piece == "\n" or piece.rstrip("\"')]}»”’")[-1:] in (".", "!", "?")


def sample_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int, max_bytes: int) -> DataFrame:
    """Per sampled document: label, slots array<int> (sentences end with -2)."""
    rated = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("label"))
    sized = docs.select(F.col(id_col).alias("id"), F.octet_length(utf8(text_col)).alias("bytes")).join(rated, "id").withColumn("h", F.xxhash64("id"))
    picked = []  # at most max_docs + max_docs // 3 rows
    for label, most, room in ((1, max_docs // 3, max_bytes // 3), (0, max_docs, max_bytes)):
        own, left = sized.where(F.col("label") == label), room
        fitting = own.where(F.col("bytes") <= room).orderBy("h", "id").limit(most).collect()
        if not fitting and not own.isEmpty():
            raise ValueError(f"no text with label {label} has at most {room} bytes to train on")
        for r in fitting:
            if r["bytes"] <= left:
                picked.append((r["id"], label))
                left -= r["bytes"]
    chosen = docs.sparkSession.createDataFrame(picked, sized.select("id", "label").schema)

    def run(batches):
        import pyarrow as pa

        slot = _Cache(word_slot, 50_000)
        for part in slices(batches, 64, chars=2_000_000):
            rows = []
            for t in part.column("text").to_pylist():
                row = []
                for p in (t or "").replace("\n", " \n ").split(" "):
                    if (s := slot[p]) >= 0:
                        row.append(s)
                    if _is_end(p):
                        row.append(-2)
                rows.append(row)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(rows, pa.list_(pa.int32()))], ["label", "slots"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return batched(texts.join(F.broadcast(chosen), "id").select("label", "text")).mapInArrow(run, "label int, slots array<int>")


def fit(labels, flat, offsets, shares=None, l1: float = 5e-5, rounds: int = 120, rate: float = 0.25, least_docs: int = 4):
    """Weights (2**BITS float32 and the bias as last cell). ``labels``: one bool a document;
    ``flat``: the documents' slots one after another (-2 ends a sentence), document i from
    ``offsets[i]`` on. ``shares``: how many labelled documents there are of label 0 and 1; None: as
    sampled. About 15 bytes a word are used, and the rounds go over blocks of the words."""
    import numpy as np

    size = 1 << BITS
    y, n = np.asarray(labels, bool), len(labels)
    if not n or not y.any() or y.all():
        return np.append(np.zeros(size, np.float32), np.float32(30.0 if n and y.all() else -50.0))
    took = np.bincount(y, minlength=2)
    each = (np.array(shares, float) / np.maximum(took, 1))[y.astype(int)] if shares else np.ones(n)
    each /= each.sum()
    # sentences: a new one begins with a document and after each end mark
    new = np.zeros(len(flat), bool)
    new[1:] = flat[:-1] == -2
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    sent = np.cumsum(new, dtype=np.int32) - 1
    sent_doc = (np.searchsorted(offsets, np.flatnonzero(new), "right") - 1).astype(np.int32)
    del new
    seen = np.zeros(size, np.int32)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        seen[np.unique(flat[a:b][flat[a:b] >= 0])] += 1
    names = np.flatnonzero(seen >= least_docs)
    place = np.full(size, -1, np.int32)
    place[names] = np.arange(len(names))
    keep = flat >= 0
    keep[keep] = place[flat[keep]] >= 0
    flat, sent, n_sent = place[flat[keep]], sent[keep], len(sent_doc)
    del keep
    parts = [slice(a, a + 500_000) for a in range(0, len(flat), 500_000)]
    x = np.zeros(len(names) + 1)
    base = min(max(float(each[y].sum()), 1e-3), 1 - 1e-3)
    x[-1] = np.log(base / max(1.0, n_sent / n)) - 1
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        z = np.full(n_sent, x[-1])
        for part in parts:
            first, last = sent[part][0], sent[part][-1] + 1
            z[first:last] += np.bincount(sent[part] - first, x[flat[part]])
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(sent_doc, -np.logaddexp(0, z), n)  # log of prod(1 - p)
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        pull = (np.where(y, np.exp(clean) / toxic, -1.0) * each)[sent_doc] * p
        grad = np.append(np.zeros(len(names)), -pull.sum())
        for part in parts:
            grad[:-1] -= np.bincount(flat[part], pull[sent[part]], len(names))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * min(1, 2 * (1 - k / (rounds + 1))) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        x -= step * m / (1 - 0.9**k)
        x[:-1] = np.sign(x[:-1]) * np.maximum(np.abs(x[:-1]) - step[:-1] * l1, 0)
    out = np.zeros(size + 1, np.float32)
    out[names] = x[:-1]
    out[-1] = x[-1]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", max_docs: int = 9000, max_bytes: int = 30_000_000):
    import numpy as np

    rows = sample_features(docs, labels, id_col, text_col, label_col, max_docs, max_bytes).toArrow().combine_chunks()
    slots = rows.column("slots").combine_chunks()
    flat, offsets = slots.values.to_numpy(), slots.offsets.to_numpy()
    rated = np.array(rows.column("label").to_numpy(), bool)
    counts = labels.where(F.col(label_col).isNotNull()).agg(F.count_if(F.col(label_col) == 0), F.count_if(F.col(label_col) != 0)).first()
    return fit(rated, flat, offsets, tuple(counts))


class Scorer:
    """Scores texts in a worker; a piece's weight is cached."""

    def __init__(self, weights):
        w = weights.tolist()
        self.bias = w[-1]
        self.weight = _Cache(lambda p: w[s] if (s := word_slot(p)) >= 0 else 0.0, 50_000)
        self.ends = _Cache(_is_end, 20_000)

    def sentences(self, text: str):
        """(logits, number of pieces in each sentence)"""
        import numpy as np

        pieces = text.replace("\n", " \n ").split(" ")
        weight, ends = self.weight, self.ends
        w = np.array([weight[p] for p in pieces])
        last = np.flatnonzero(np.fromiter([ends[p] for p in pieces], bool, len(pieces)))
        begins = np.concatenate([[0], last + 1])
        begins = begins[begins < len(pieces)]
        return np.add.reduceat(w, begins) + self.bias, pieces, begins

    def score(self, text: str | None) -> float:
        import numpy as np

        if not text:
            return 0.0
        z = np.clip(self.sentences(text)[0], -30, 30)
        return float(-np.expm1(-np.logaddexp(0, z).sum()))

    def offending(self, text: str | None, least: float = 0.5):
        """(first character, length, p) of each sentence with p >= least."""
        import numpy as np

        if not text:
            return []
        z, pieces, begins = self.sentences(text)
        ends, found = [*begins[1:], len(pieces)], []
        raw = text.replace("\n", " \n ")
        at, shift, k = 0, 0, 0
        starts = []  # of each piece in the text itself: a line end was given two spaces
        for p in pieces:
            starts.append(max(0, at - shift - (p == "\n")))
            at += len(p) + 1
            shift += 2 * (p == "\n")
        assert at == len(raw) + 1
        for k in np.flatnonzero(z >= np.log(least / (1 - least))):
            a, b = starts[begins[k]], starts[ends[k] - 1] + len(pieces[ends[k] - 1])
            found.append((a, b - a, float(1 / (1 + np.exp(-z[k])))))
        return found


def score(docs: DataFrame, weights, id_col="doc_id", text_col="text", threshold: float = 0.5) -> DataFrame:
    """id, score, predicted, offending array<struct<start, length, p>> (of predicted documents)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    span = "array<struct<start:int,length:int,p:double>>"

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("p", pa.float64())]))
        for part in slices(batches, 256, chars=4_000_000):
            texts = part.column("text").to_pylist()
            scores = [scorer.score(t) for t in texts]
            spans = [[dict(zip(("start", "length", "p"), x, strict=True)) for x in scorer.offending(t)] if s >= threshold else [] for t, s in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, kind)], ["id", "score", "predicted", "offending"])

    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return batched(thin).mapInArrow(run, f"id long, score double, predicted int, offending {span}").withColumnRenamed("id", id_col)


def filter_toxic(docs: DataFrame, weights, text_col="text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for part in slices(batches, 256, text_col, 4_000_000):
            keep = pa.array([scorer.score(t) < threshold for t in part.column(text_col).to_pylist()], pa.bool_())
            yield part.filter(keep)

    return batched(docs).mapInArrow(run, docs.schema)
