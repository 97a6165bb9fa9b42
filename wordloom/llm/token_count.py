"""Token counts by heap-and-linked-list byte-pair merging.

The lowest-rank adjacent pair is popped and merged until none is left; a
pre-token's count is its first symbols minus its merges, and no ids are made.
Counts of recurring pieces are cached in each worker (bounded, see pieces.py).

Cases: null and empty texts have 0 tokens; special strings inside a text count
as the library's default counts them (one each); every row gives one row, so
repeated rows repeat; other columns are ignored; very long texts are counted
whole, one at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import MergeCounter, made


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). ``tokenizer``: path of the .json file."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        count = made(MergeCounter, tokenizer).many
        for part in slices(batches, 1000, chars=4_000_000):
            texts = part.column("text")
            n = pa.array(count(texts.to_pylist()))
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), size, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = thin.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
