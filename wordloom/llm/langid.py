"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the hashed 2- and 3-grams of each language are sums over all labelled
documents; the log-probability matrix (buckets x languages) and the log-priors
(shares of the labelled documents) are broadcast. A batch of texts is a sparse matrix of
counts (text, bucket), sorted by text; its product with the matrix is made for a few languages
at a time. Texts are lower-cased and edged with a space. The more languages there are, the
fewer buckets: the matrix never has more than MOST_CELLS cells.

Cases: a text that is null or has no letter gets ``und`` with score 0; documents
without a language are scored but teach nothing; with no labelled document at
all every text is ``und``; ties go to the first language in code-point order;
rows repeat as they come; other columns are ignored; whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BUCKETS = 1 << 16
#: The broadcast matrix must not have more cells than this (8 bytes each while it is made).
MOST_CELLS = 1 << 24


def _grams(texts: list[str], buckets: int):
    """Hashed n-grams of all texts, one after another, and where each text's begin."""
    import numpy as np

    coded = [(" " + t.lower() + " ").encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(c) // 4 for c in coded])
    c = np.frombuffer(b"".join(coded), np.uint32)
    mix = np.uint32(2654435761)
    pair = (c[:-1] * np.uint32(0x85EBCA6B) ^ c[1:]) * mix
    triple = (pair[:-1] * np.uint32(0xC2B2AE35) ^ c[2:]) * mix
    shift = np.uint32(32 - (buckets - 1).bit_length())
    ends = np.cumsum(size)
    return pair >> shift, triple >> shift, ends - size, ends


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def count_grams(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", buckets: int = BUCKETS) -> DataFrame:
    """lang, bucket, n over all documents whose language isn't null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for part in slices(batches, 256, chars=4_000_000):
            texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang and _has_letter(t)]
                if not own:
                    continue
                pair, triple, begins, ends = _grams(own, buckets)
                count = np.bincount(pair, minlength=buckets) + np.bincount(triple, minlength=buckets)
                for e in ends[:-1]:  # n-grams that run over into the next text
                    for g in (pair[e - 1], triple[e - 2], triple[e - 1]):
                        count[g] -= 1
                total[lang] = total.get(lang, 0) + count
        for lang, count in total.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(count[at], pa.int64())], ["lang", "bucket", "n"])

    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return own.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", buckets: int = BUCKETS, alpha: float = 0.5):
    """(languages, log-probabilities [bucket, language], log-priors). What reaches the driver are a row for
    each language and at most MOST_CELLS counts."""
    import numpy as np

    rated = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = sorted(tuple(r) for r in rated.groupBy(F.col(lang_col).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator())
    langs = [r[0] for r in rows]
    while buckets > 2 and len(langs) * buckets > MOST_CELLS:
        buckets //= 2
    table = count_grams(docs, id_col, text_col, lang_col, buckets).toPandas()
    counts = np.zeros((buckets, len(langs)))
    counts[table["bucket"].to_numpy(int), np.searchsorted(langs, table["lang"].to_numpy(str))] = table["n"].to_numpy(float) if len(table) else 0
    seen = np.array([r[1] for r in rows], float)
    return langs, np.log((counts + alpha) / (counts.sum(0) + alpha * buckets)).astype(np.float32), np.log(seen / max(seen.sum(), 1))


def scores(texts: list[str], logp, priors, columns: int = 16):
    """Log-likelihoods plus log-priors [text, language]: a sparse product over the whole batch."""
    import numpy as np

    buckets = logp.shape[0]
    pair, triple, begins, ends = _grams(texts, buckets)
    text = np.repeat(np.arange(len(texts)), ends - begins)
    in_pair, in_triple = np.ones(len(pair), bool), np.ones(len(triple), bool)
    in_pair[ends[:-1] - 1] = False  # n-grams that run over into the next text
    in_triple[ends[:-1] - 1] = in_triple[ends[:-1] - 2] = False
    keys = np.concatenate([(text[:-1] * buckets + pair)[in_pair], (text[:-2] * buckets + triple)[in_triple]])
    keys, times = np.unique(keys, return_counts=True)
    row, at = keys // buckets, keys % buckets
    first = np.flatnonzero(np.diff(row, prepend=-1))  # every text has n-grams, so rows are the texts
    out = np.empty((len(texts), logp.shape[1]))
    for a in range(0, logp.shape[1], columns):
        part = slice(a, a + columns)
        out[:, part] = np.add.reduceat(logp[at, part] * times[:, None].astype(np.float64), first)
    return out + priors


def predict(docs: DataFrame, model, id_col="doc_id", text_col="text") -> DataFrame:
    """All columns of ``docs`` that are named in id_col, with lang_pred and score (the posterior of the
    predicted language)."""
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        langs, logp, priors = shared.value
        for part in slices(batches, 256, chars=1_000_000):
            texts = part.column("text").to_pylist()
            own = [i for i, t in enumerate(texts) if langs and _has_letter(t)]
            pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if own:
                z = scores([texts[i] for i in own], logp, priors)
                z = np.exp(z - z.max(1, keepdims=True))
                best = z.argmax(1)
                pred[own], score[own] = np.array(langs, object)[best], z.max(1) / z.sum(1)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)

