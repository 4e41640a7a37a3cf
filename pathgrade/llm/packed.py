"""Token-id files of fixed-width bit packing.

A file holds the ids of consecutive documents in ascending doc_id order. Each id takes the fewest bits that hold the
vocabulary's largest id. Ids lie in blocks of BLOCK; the offsets of the blocks and of the documents stand behind them, so
one block, or one document, can be read without the rest.

Layout, little-endian: the blocks; for each document u8 (1: it has a number), i64 doc_id, u64 first id; for each block
u64 first byte; at the end u16 width, u32 ids in a block, u64 documents, u64 ids, ``PGIDS2``. Blocks are written as they
fill, and a task goes on in a new file after FILE_IDS ids or FILE_DOCS documents, so its memory does not grow with what
it writes.

Null texts count as empty, so a document has at least its end id. Null doc_ids come first, then equal doc_ids in the
order of their texts. Empty tables make no file and no rows. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, files
from .common import materialize, ship, tidy, work_path

MAGIC = b"PGIDS2"
TAIL = struct.Struct("<HIQQ6s")
DOC = np.dtype([("has", "u1"), ("id", "<i8"), ("first", "<u8")])
BLOCK = 65_536
END_ID = 2
#: A file ends after so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20
#: The part of a text by which equal doc_ids are dealt; whole texts order them.
DEALT_CHARS = 64
MANIFEST = "shard int, nth int, path string, n_docs long, n_ids long"


def width_of(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive bits, the lowest first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Packs documents' ids as they come into one file; it keeps an open block, the offsets and the documents' starts."""

    def __init__(self, path: str, width: int, block: int = BLOCK):
        self.width, self.block = width, block
        self.docs: list[np.ndarray] = []
        self.offsets: list[int] = []
        self.n_docs = self.n_ids = 0
        self.open = np.zeros(0, np.uint32)
        self.out = files.open_out(path)

    def _put(self, ids: np.ndarray) -> None:
        self.offsets.append(self.out.tell())
        self.out.write(pack(ids, self.width))

    def add(self, keys: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> None:
        rows = np.zeros(len(keys), DOC)
        rows["has"] = [k is not None for k in keys]
        rows["id"] = [k or 0 for k in keys]
        rows["first"] = bounds[:-1] + self.n_ids
        self.docs.append(rows)
        self.n_docs += len(keys)
        self.n_ids += len(ids)
        self.open = np.concatenate([self.open, ids])
        full = len(self.open) // self.block * self.block
        for k in range(0, full, self.block):
            self._put(self.open[k : k + self.block])
        self.open = self.open[full:]

    def close(self) -> None:
        if len(self.open):
            self._put(self.open)
        self.out.write(np.concatenate([np.zeros(0, DOC), *self.docs]).tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(TAIL.pack(self.width, self.block, self.n_docs, self.n_ids, MAGIC))
        self.out.close()


class Reader:
    """Blocks and documents of one file, by byte ranges."""

    def __init__(self, path: str):
        self.file = files.open_in(path)
        end = self.file.size() - TAIL.size
        self.width, self.block, n_docs, self.n_ids, magic = TAIL.unpack(self.file.read_at(TAIL.size, max(0, end)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.file.read_at(8 * n_blocks, end - 8 * n_blocks), "<u8")
        self.docs = np.frombuffer(self.file.read_at(n_docs * DOC.itemsize, end - 8 * n_blocks - n_docs * DOC.itemsize), DOC)
        self.lasts = np.append(self.docs["first"][1:], np.uint64(self.n_ids)).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last (not included), from the blocks that hold them."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        out = []
        for k in range(a, b + 1):
            n = min(self.block, self.n_ids - k * self.block)
            out.append(unpack(self.file.read_at(-(-n * self.width // 8), int(self.offsets[k])), self.width, n))
        return np.concatenate(out)[first - a * self.block : last - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.docs["first"][k]), int(self.lasts[k]))


def write(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, block: int = BLOCK, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write doc_id, text as files in ascending order; the manifest (MANIFEST and first: ids in all files before)."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = vocabulary or bpe.vocabulary_path()
    path = path or work_path(spark, "ids")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = bpe.encoder(vocabulary), TaskContext.get().partitionId()
        width, nth, out, name = width_of(enc.size), 0, None, ""
        kinds = pa.schema([("shard", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        line = lambda: pa.RecordBatch.from_pylist([{"shard": shard, "nth": nth, "path": name, "n_docs": out.n_docs, "n_ids": out.n_ids}], kinds)
        for batch in bpe.batches(source, "text", min(bpe.BATCH_BYTES, file_ids)):
            if out is None:
                name = f"{path}/{shard:07d}-{nth:05d}-{uuid.uuid4().hex}.ids"
                out = Writer(name, width, block)
            ids, at = enc.column(batch.column("text"))
            n = len(at) - 1
            out.add(batch.column("doc_id").to_pylist(), np.insert(ids, at[1:], end_id), at + np.arange(n + 1))
            if out.n_ids >= file_ids or out.n_docs >= file_docs:
                out.close()
                yield line()
                nth, out = nth + 1, None
        if out is not None:
            out.close()
            yield line()
        tidy()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by_id = F.col("doc_id").asc_nulls_first()
    # equal and null doc_ids are dealt by the beginnings of their texts
    ordered = rows.repartitionByRange(parts, by_id, F.substring("text", 1, DEALT_CHARS)).sortWithinPartitions(by_id, "text")
    manifest = materialize(ordered.mapInArrow(run, MANIFEST), "ids-manifest")
    # a row for each file, not for each document
    before = Window.orderBy("shard", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                r = Reader(name)
                step = 4096
                for k in range(0, len(r.docs), step):
                    d, last = r.docs[k : k + step], r.lasts[k : k + step]
                    first = d["first"].astype(np.int64)
                    crc, cut, m = [], int(first[0]), 0
                    while m < len(d):  # about 16 blocks of ids at a time, or one document
                        to = max(m + 1, int(np.searchsorted(last, cut + 16 * r.block, "right")))
                        ids = r.ids(cut, int(last[to - 1])).astype("<u4")
                        crc += [zlib.crc32(ids[first[j] - cut : last[j] - cut]) for j in range(m, to)]
                        cut, m = int(last[to - 1]), to
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d["id"].astype(np.int64), mask=d["has"] == 0), pa.array(first + base), pa.array(last - first), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    ship(manifest.sparkSession)
    n = max(1, min(manifest.count(), 10_000))
    return manifest.repartition(n, "shard", "nth").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
