"""Media columns: content-addressed payloads in tar shards.

A payload (a text's bytes, padded with zero bytes to a positive multiple of 64)
is stored as a lossless 8-bit grey PNG image in as few rows of equal length as may be. Images go to tar
shards once for each content: rows carry digest, shard, offset and length.
Metadata columns come from range reads of the 33 header bytes alone; features
are computed from the stored bytes read back.

Shards are written in Python through pyarrow's file systems, to the shared
folder; each attempt of a task writes files of its own name, and the index is a
written table, so only files of committed attempts are ever referred to. Files of
attempts that were lost are removed after the index is complete.

Cases: null and empty texts are 64 zero bytes; equal texts share one stored
payload and so have equal values; rows repeat as they come; an empty table
writes no shard; other columns are ignored; a very long text is one payload.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, bitmap, bitmap_slot, marked, materialise, slices, utf8

WIDTH = 64  # payloads are multiples of it
ROW = 1 << 16  # samples in a row of an image at most
HEAVY = 1000  # what more than 1/HEAVY of all documents have is settled by a broadcast
HEADER = 33  # signature and IHDR chunk
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the PNG format


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey image of the payload's bytes, in the least number of rows that WIDTH divides; filter type 0 in each row."""
    import numpy as np

    height = -(-len(payload) // ROW)
    while len(payload) // WIDTH % height:
        height += 1
    rows = np.frombuffer(payload, np.uint8).reshape(height, -1)
    lines = np.zeros((height, rows.shape[1] + 1), np.uint8)
    lines[:, 1:] = rows
    size = rows.shape[1].to_bytes(4, "big") + height.to_bytes(4, "big")
    return SIGNATURE + _chunk(b"IHDR", size + bytes((8, 0, 0, 0, 0))) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return int.from_bytes(first[16:20], "big"), int.from_bytes(first[20:24], "big"), first[24]


def decode_png(media: bytes) -> bytes:
    import numpy as np

    width, height, _ = header(media[:HEADER])
    data, at = b"", 8
    while at < len(media):
        n = int.from_bytes(media[at : at + 4], "big")
        if media[at + 4 : at + 8] == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Byte mean and entropy, the share of zero bytes, and the heaviest bytes."""
    import numpy as np

    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = count[count > 0] / len(payload)
    top = np.argsort(-count, kind="stable")[:4]
    return f"mean={(count @ np.arange(256)) / len(payload):.4f};entropy={-(share * np.log2(share)).sum():.4f};zero={count[0] / len(payload):.4f};top={'-'.join(f'{t:02x}' for t in top)}"


def open_fs(url: str):
    """(pyarrow file system, path) of a folder that Spark names."""
    from pyarrow import fs

    url = url.replace("s3a://", "s3://", 1) if url.startswith("s3a://") else url
    if url.startswith("file:"):
        url = "file:///" + url[5:].lstrip("/")
    return fs.FileSystem.from_uri(url)


class Shards:
    """Writes tar shards of about ``limit`` bytes under names of its own, and keeps their index rows."""

    def __init__(self, folder: str, limit: int):
        self.fs, self.root = open_fs(folder)
        self.limit, self.out, self.rows = limit, None, []

    def add(self, digest: str, media: bytes) -> None:
        import tarfile

        if self.out is None:
            self.fs.create_dir(self.root, recursive=True)
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.GNU_FORMAT)
        for x in (head, media, bytes(-len(media) % 512)):
            self.out.write(x)
        self.rows.append((digest, self.name, self.at + len(head), len(media), None))
        self.at += len(head) + len(media) + (-len(media) % 512)
        if self.at >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None

    def taken(self, *more):
        """The index rows since the last call, and rows with media that aren't stored yet."""
        import pyarrow as pa

        rows, self.rows = [*self.rows, *more], []
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["digest", "shard", "offset", "length", "media"])


def payload_digest(text_col: str):
    """The sha256 of the padded payload, in the JVM."""
    raw = utf8(text_col)
    room = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(WIDTH))) * WIDTH
    return F.sha2(F.rpad(raw, room.cast("int"), F.unhex(F.lit("00"))), 256)


def write_shards(docs: DataFrame, folder: str, text_col: str = "text", shard_bytes: int = 64 << 20, level: int = 6) -> tuple[DataFrame, DataFrame]:
    """Write every distinct payload once; the index: digest, shard, offset, length, and the hashed digests
    (key) that occur more than once: key, n.

    A bitmap of bounded size marks digests that occur more than once. What isn't
    marked is stored where it is read; only marked payloads are shuffled by
    digest, once for each task that has them, and stored there."""
    keyed = docs.select(F.col(text_col).alias("text"), payload_digest(text_col).alias("digest"))
    counted = keyed.groupBy(F.xxhash64("digest").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    again = materialise(counted.where("n > 1"), "again")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(again, "key"))
    schema = "digest string, shard string, offset long, length long, media binary"

    def first(batches):
        bits, shards = shared.value, Shards(folder, shard_bytes)
        seen: set[bytes] = set()  # marked digests (32 bytes) of this task
        for part in slices(batches, 256, chars=4_000_000):
            kept = []
            rows = zip(part.column("text").to_pylist(), part.column("digest").to_pylist(), marked(bits, part.column("slot")), strict=True)
            for text, digest, repeated in rows:
                if repeated:
                    if (key := bytes.fromhex(digest)) in seen:
                        continue
                    seen.add(key)
                media = encode_png(padded((text or "").encode("utf-8", "surrogatepass")), level)
                if repeated:
                    kept.append((digest, None, None, None, media))
                else:
                    shards.add(digest, media)
            yield shards.taken(*kept)
        shards.close()

    def second(batches):
        shards = Shards(folder, shard_bytes)
        seen: set[bytes] = set()
        for batch in batches:
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                if (key := bytes.fromhex(digest)) not in seen:
                    seen.add(key)
                    shards.add(digest, media.as_py())
            yield shards.taken()
        shards.close()

    stored = materialise(batched(keyed.withColumn("key", F.xxhash64("digest")).withColumn("slot", bitmap_slot("key")).drop("key")).mapInArrow(first, schema), "stored-first")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = batched(stored.where("media is not null").repartition(parts, "digest")).mapInArrow(second, schema)
    columns = ("digest", "shard", "offset", "length")
    index = materialise(stored.where("media is null").select(*columns).unionByName(rest.select(*columns)), "index")
    drop_strays(folder, index)
    return index, again


def drop_strays(folder: str, index: DataFrame) -> None:
    """Remove shards of attempts whose index rows weren't committed. Only names are listed, one for each shard."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = open_fs(folder)
    if fs.get_file_info(root).type == FileType.NotFound:
        return
    used = {r[0] for r in index.select("shard").distinct().toLocalIterator()}
    for info in fs.get_file_info(FileSelector(root)):
        if info.base_name not in used:
            fs.delete_file(info.path)


INDEX = "digest string, shard string, offset long, length long"
HEADS = f"{INDEX}, width int, height int, bits int"
STORED = f"{HEADS}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _reader(folder: str, columns, kinds):
    """For mapInArrow over index rows that are sorted by place: adds what ``columns`` gives for (open file, offset, length)."""

    def read(batches):
        import pyarrow as pa

        fs, root = open_fs(folder)
        name = source = None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    name, source = shard, fs.open_input_file(f"{root}/{shard}")
                rows.append(columns(source, offset, length))
            added = list(zip(*rows, strict=True)) or [()] * len(kinds)
            arrays = [pa.array(c, getattr(pa, kind)()) for c, kind in zip(added, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *kinds])

    return read


def header_columns(index: DataFrame, folder: str, block: int = 1 << 18) -> DataFrame:
    """The index with width, height, bits, from range reads of the headers alone. Rows are dealt by blocks
    of a shard, so that a large shard isn't one task's, and sorted by place."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(parts, "shard", F.floor(F.col("offset") / block)).sortWithinPartitions("shard", "offset")
    read = _reader(folder, lambda source, offset, length: header(source.read_at(HEADER, offset)), {"width": "int32", "height": "int32", "bits": "int32"})
    return batched(dealt).mapInArrow(read, HEADS)


def stored_columns(heads: DataFrame, folder: str) -> DataFrame:
    """``header_columns`` with what the stored bytes, read back, give: sums of payload and stored form, feature."""

    def sums(source, offset: int, length: int):
        import hashlib

        media = source.read_at(length, offset)
        payload = decode_png(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), length, hashlib.sha256(media).hexdigest(), feature(payload)

    kinds = {"payload_bytes": "int64", "payload_sha256": "string", "tail_crc32": "int64", "media_bytes": "int64", "media_sha256": "string", "feature": "string"}
    return batched(heads).mapInArrow(_reader(folder, sums, kinds), STORED)


def media_columns(docs: DataFrame, folder: str, id_col="doc_id", text_col="text", shard_bytes: int = 64 << 20) -> DataFrame:
    """id, n_bytes, digest, shard, offset, length, the columns of ``header_columns`` (from range reads of headers alone)
    and those of ``stored_columns``, one row per document."""
    index, again = write_shards(docs, folder, text_col, shard_bytes)
    stored = materialise(stored_columns(header_columns(index, folder), folder), "stored")
    keyed = docs.select(F.col(id_col).cast("long").alias(id_col), F.octet_length(utf8(text_col)).cast("long").alias("n_bytes"), F.unhex(payload_digest(text_col)).alias("raw"))
    stored = stored.withColumn("raw", F.unhex("digest"))
    often = F.broadcast(again.where(F.col("n") * HEAVY > docs.count()).select("key"))  # fewer than HEAVY rows
    heavy = materialise(stored.join(often, F.xxhash64("digest") == F.col("key"), "left_semi"), "heavy")
    frequent = keyed.join(F.broadcast(heavy), "raw")
    rest = keyed.join(F.broadcast(heavy.select("raw")), "raw", "left_anti").join(stored, "raw")
    return frequent.unionByName(rest).drop("raw")
