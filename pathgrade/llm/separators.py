"""Token counts of the documents in flat token files that have no index: a scan for end-of-document ids.

A token file is bare little-endian ids of one width. Spark deals fixed blocks of the files over tasks; each task reads
its byte range and finds the end ids with one vectorised comparison. A document may begin in any earlier block: the
last end id before a block, and the number of end ids before it, are a prefix scan over the blocks' summaries (within
files, then over files).

What follows the last end id of a file is counted as a document that is not closed. Empty files have no documents.
Null texts count as empty; then a document is its end id alone and has 0 tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, files
from .common import materialize, ship, tidy, work_path

#: <|endoftext|> of the vocabulary; the string itself is ordinary text when documents are encoded.
END_ID = 49_407
WIDTH = 2
BLOCK_BYTES = 1 << 20
#: Blocks whose summaries one task scans.
GROUP_BLOCKS = 1024


def write_flat(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Write doc_id, text as a flat file for each partition, in the rows' order: the files, and file, nth, doc_id.

    The second table says which document was written where in the order, not where its tokens are.
    """
    ship(docs.sparkSession)
    vocabulary = vocabulary or bpe.vocabulary_path()
    path = path or work_path(docs.sparkSession, "flat")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(vocabulary, plain_specials=True)
        name, out, nth = f"{path}/{uuid.uuid4().hex}.tokens", None, 0
        for batch in bpe.batches(source, "text"):
            ids, at = enc.column(batch.column("text"))
            if len(ids) and int(ids.max()) >= 1 << 8 * width or (ids == end_id).any():
                raise ValueError("an id does not fit, or is the end id")
            out = out or files.open_out(name)
            out.write(np.insert(ids, at[1:], end_id).astype(f"<u{width}").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(nth, nth + n)), batch.column("doc_id")], ["file", "nth", "doc_id"])
            nth += n
        if out:
            out.close()
        tidy()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = materialize(rows.mapInArrow(run, f"file string, nth long, doc_id {dict(rows.dtypes)['doc_id']}"), "flat-order")
    return order.select("file").distinct(), order


def count_tokens(paths: DataFrame, end_id: int = END_ID, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """file, nth (from 0), start (in ids from the file's first), n_tokens (without the end id), closed."""
    ship(paths.sparkSession)
    if block_bytes % width:
        raise ValueError("block_bytes must be a multiple of width")

    def sizes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name in batch.column("file").to_pylist():
                n = -(-files.size_of(name) // block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n))], ["file", "block"])

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with files.open_in(name) as f:
                    data = f.read_at(block_bytes, block * block_bytes)
                ids = np.frombuffer(data, f"<u{width}", len(data) // width)
                base = block * (block_bytes // width)
                ends = np.flatnonzero(ids == end_id) + base
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block]), pa.array([base + len(ids)]), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "block", "stop", "ends"]
                )

    blocks = paths.select("file").distinct().mapInArrow(sizes, "file string, block long")
    found = materialize(blocks.repartition("file", "block").mapInArrow(scan, "file string, block long, stop long, ends array<long>"), "flat-blocks")
    # the prefix scan: how many end ids, and which was the last, before each block of its file. Only summaries are
    # scanned, over groups of blocks and then within them, so a large file is no single task.
    short = found.select("file", "block", F.size("ends").cast("long").alias("n"), F.coalesce(F.array_max("ends"), F.lit(-1)).alias("last"), F.floor(F.col("block") / group_blocks).alias("grp"))
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda w: (F.coalesce(F.sum("n").over(w), F.lit(0)).alias("nth0"), F.coalesce(F.max("last").over(w), F.lit(-1)).alias("last0"))
    groups = short.groupBy("file", "grp").agg(F.sum("n").alias("n"), F.max("last").alias("last")).select("file", "grp", *earlier(before(["file"], "grp")))
    groups = groups.withColumnsRenamed({"nth0": "gn", "last0": "gl"})
    within = short.select("file", "block", "grp", *earlier(before(["file", "grp"], "block"))).join(groups, ["file", "grp"])
    within = within.select("file", "block", (F.col("nth0") + F.col("gn")).alias("nth0"), F.greatest("last0", "gl").alias("last0"))
    prefix = found.join(within, ["file", "block"])
    inner = prefix.select("file", "nth0", "last0", "ends").where(F.size("ends") > 0)
    closed = inner.select(
        "file",
        F.posexplode(F.arrays_zip(F.concat(F.array("last0"), F.slice("ends", 1, F.size("ends") - 1)).alias("a"), F.col("ends").alias("b"))).alias("k", "z"),
        "nth0",
    ).select("file", (F.col("nth0") + F.col("k")).alias("nth"), (F.col("z.a") + 1).alias("start"), (F.col("z.b") - F.col("z.a") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = (
        found.groupBy("file")
        .agg(F.sum(F.size("ends")).alias("nth"), F.max(F.array_max("ends")).alias("last"), F.max("stop").alias("stop"))
        .select("file", F.col("nth").cast("long"), (F.coalesce("last", F.lit(-1)) + 1).alias("start"), F.col("stop"))
        .where("stop > start")
        .select("file", "nth", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    )
    return closed.unionByName(tail)


def document_token_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, file_nth, start, n_tokens: documents written to flat files and counted from the files alone."""
    paths, order = write_flat(docs, **options)
    counted = count_tokens(paths)
    return order.join(counted, ["file", "nth"], "left").select("doc_id", F.col("nth").alias("file_nth"), "start", "n_tokens")
