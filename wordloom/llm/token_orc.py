"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on ids.

Rows are range-partitioned and sorted by id, so the files hold ascending ranges;
stripe and row-group statistics and the Bloom filters let a reader that looks
for some ids skip the rest from metadata, and Spark reads the stripes of a file
in parallel. ``seq`` is a row's place in its file.

Cases: null and empty texts have the end id alone; null ids come first; rows
with equal ids are all written, next to each other, and their order is that of
the files; an empty table gives no rows; other columns are ignored; whole texts
are encoded, in slices of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices
from .pieces import ByteIds, made

SCHEMA = "doc_id long, seq long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, row_index_stride: int = 1000) -> None:
    """Encode whole texts and write them as ORC under ``path``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode, end, seq = made(ByteIds, tokenizer).many, end_id.to_bytes(4, "little"), 0
        for part in slices(batches, 1000, chars=4_000_000):
            ids = [x + end for x in encode(part.column("text").to_pylist())]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            numbers = pa.array(np.arange(seq, seq + len(ids)), pa.int64())
            seq += len(ids)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), numbers, pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "seq", "ids"])

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = thin.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    writer = ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
    writer = writer.option("orc.row.index.stride", row_index_stride).option("orc.create.index", "true")
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def file_number(name: Column) -> Column:
    """A file's place among the ranges: its task's number, then its number in the task. As text, 100000 would sort before 99999."""
    part = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    return part(r"^part-(\d+)") * 1_000_000 + part(r"-c(\d+)\.")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of a bounded list of ids. The filter is pushed down: files, stripes and row groups whose
    statistics or Bloom filters exclude all ids aren't read."""
    return read_tokens(spark, path).where(F.col("doc_id").isin([int(i) for i in ids]))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32. ``start`` is a two-level
    prefix sum: within each file, and over one row for each file."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("ids")
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq"), batch.column("file"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "seq", "file", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "seq", file_number(F.col("_metadata.file_name")).alias("file"), "ids")
    thin = materialise(rows.mapInArrow(run, "doc_id long, seq long, file long, n_tokens long, ids_crc32 long"), "tokens")
    files = thin.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = files.select("file", (F.sum("file_tokens").over(Window.orderBy("file")) - F.col("file_tokens")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("seq")) - F.col("n_tokens")
    return thin.withColumn("inside", inside).join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
