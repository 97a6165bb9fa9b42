"""What the operators share: folds, batches, bitmaps for map-side choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..marks import BITMAP_BITS, bitmap_slot, bitmap_words
from ..storage import materialise, new_path

__all__ = ["batched", "bitmap", "bitmap_slot", "documents", "fold", "give_back", "labels", "marked", "materialise", "new_path", "slices", "split_marked", "utf8"]


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def utf8(text_col: str) -> Column:
    return F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


BATCH_ROWS = 1000


def batched(df: DataFrame) -> DataFrame:
    """``df``, for mapInArrow: Spark hands over batches of at most BATCH_ROWS rows, which bounds
    the Arrow memory of the JVM and of the workers. It lowers the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return memory that is free in this worker to the system, so that idle workers hold little."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def slices(batches, rows: int = 512, chars_col: str = "text", chars: int = 16_000_000):
    """Cut Arrow batches into slices of at most ``rows`` rows and about ``chars``
    bytes of text, so that a worker's memory doesn't grow with the batch."""
    import pyarrow.compute as pc

    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, rows)
            while part.num_rows > 1 and (pc.sum(pc.binary_length(part.column(chars_col))).as_py() or 0) > chars:
                part = part.slice(0, part.num_rows // 2)
            yield part
            start += part.num_rows
    give_back()


def bitmap(keys: DataFrame, column: str):
    """A bitmap (4 MB, whatever the size of ``keys``) of the hashed values of a column, for
    map-side choices that may let too much through but never too little."""
    import numpy as np

    marks = bitmap_words(keys, column).toPandas()
    out = np.zeros(BITMAP_BITS // 32, np.uint32)
    out[marks["word"].to_numpy(np.int64)] = marks["mask"].to_numpy(np.int64).astype(np.uint32)
    return out


def split_marked(docs: DataFrame, id_col: str, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in ``keys``, rows whose id isn't), so that a join with ``keys`` needn't
    shuffle the texts of the others. The bitmap's words are broadcast: at most BITMAP_BITS / 32 rows
    of two longs, whatever the size of ``keys``. Both columns must be long once cast; null ids may be in either."""
    slot = F.pmod(F.xxhash64(F.col(f"d.`{id_col}`").cast("long")), F.lit(BITMAP_BITS))
    words = F.broadcast(bitmap_words(keys, column)).alias("m")
    both = docs.alias("d").join(words, F.col("m.word") == F.floor(slot / 32), "left")
    bit = F.coalesce(F.getbit("m.mask", F.pmod(slot, F.lit(32)).cast("int")), F.lit(0)) == 1
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    return both.where(bit).select(*own), both.where(~bit).select(*own)


def marked(bits, slots):
    """Which of the slots (an Arrow column) are set, as a numpy array."""
    import numpy as np

    at = slots.to_numpy()
    return (bits[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)
