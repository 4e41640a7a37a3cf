"""WARC archives of pages, as a table of chunks.

Writing: a page's payload is cut into chunk rows (record, chunk number, bytes), which a task streams into its archive
in order; no task puts a record together. Reading: an archive is streamed; each chunk is a row with the bytes so far
and the digest so far, so that a record's last chunk carries the digest of its whole payload. Of records with equal
payloads of at least ``revisit_from`` bytes the one with the smallest page_id is a response and the others revisit it.

Null html counts as empty. Null page_ids are kept, and are never what others revisit unless all equal payloads have
none. Rows that repeat the smallest page_id are all responses. Columns but page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import join_dimension, materialize, ship, work_path

CHUNK_BYTES = 256 << 10
REVISIT_FROM = 0
LONGEST_HEADER = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(state) -> str:
    return base64.b32encode(state.digest()).decode()


def _urn(page_id: int | None) -> str:
    return "<urn:x-page:none>" if page_id is None else f"<urn:x-page:{page_id}>"


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def decide(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, html, payload_bytes, sha1 (hex), refers_to (null: a response)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # of each payload that more than one row has, the first page; a payload of one row needs no partner
    first = rows.where(F.col("payload_bytes") >= revisit_from).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "warc-first")
    out = join_dimension(rows, first, ["sha1"], "left")  # pages of one payload, however many, stay or are dealt
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return out.select("page_id", "url", "html", "payload_bytes", "sha1", refers.alias("refers_to"))


def _header(kind: str, page: dict, length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page['page_id'])}"]
    if page["url"]:
        lines.append("WARC-Target-URI: " + page["url"].replace("\r", "%0D").replace("\n", "%0A"))
    digest = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {page['payload_bytes']}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(page['refers_to'])}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def chunks(decided: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table: a row for each chunk of a response (a row without bytes for a revisit or an empty payload)."""
    body = F.when(F.col("refers_to").isNull(), F.col("html").cast("binary")).otherwise(F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.length(body) / chunk_bytes)).cast("int")
    key = decided.withColumn("record", F.monotonically_increasing_id())
    long = key.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    piece = F.substring(body, F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    return long.select("record", "chunk", "page_id", "url", "payload_bytes", "sha1", "refers_to", piece.alias("bytes"))


def write(pages: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write archives; returns the table of their paths."""
    ship(pages.sparkSession)
    path = path or work_path(pages.sparkSession, "warc")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = f"{path}/{uuid.uuid4().hex}.warc", None
        for batch in source:
            for page in batch.to_pylist():
                out = out or files.open_out(name)
                if page["chunk"] == 0:
                    if out.tell():
                        out.write(b"\r\n\r\n")
                    revisit = page["refers_to"] is not None
                    out.write(_header("revisit" if revisit else "response", page, 0 if revisit else page["payload_bytes"]))
                out.write(page["bytes"])
        if out:
            out.write(b"\r\n\r\n")
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["path"])

    # a page's chunks are made, in order, by the task that holds the page, and stay there
    return materialize(chunks(decide(pages, revisit_from), chunk_bytes).mapInArrow(run, "path string"), "warc-paths")


class _Stream:
    """Reads lines and at most so many bytes from a stream."""

    def __init__(self, path: str, size: int):
        self.file, self.size, self.at, self.buffer = files.open_in(path), size, 0, b""
        self.total = self.file.size()

    def _more(self) -> bool:
        if self.at >= self.total:
            return False
        data = self.file.read_at(min(self.size, self.total - self.at), self.at)
        self.at += len(data)
        self.buffer += data
        return bool(data)

    def head(self) -> list[str] | None:
        """The lines before the next empty line; None at the end."""
        while (k := self.buffer.find(b"\r\n\r\n")) < 0:
            if len(self.buffer) > LONGEST_HEADER:
                raise ValueError("a header does not end")
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a header")
                return None
        lines, self.buffer = self.buffer[:k].decode().split("\r\n"), self.buffer[k + 4 :]
        return lines

    def take(self, most: int) -> bytes:
        while not self.buffer:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def read_chunks(paths: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_bytes: bool = False) -> DataFrame:
    """Rows of path, record (nth in the archive), chunk, page_id, url, record_type, refers_to, bytes_so_far, digest_so_far, last, bytes."""

    ship(paths.sparkSession)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in source:
            for path in batch.column("path").to_pylist():
                stream, nth = _Stream(path, chunk_bytes), 0
                while (lines := stream.head()) is not None:
                    if not lines[0].startswith("WARC/"):
                        raise ValueError(f"{path}: no record where one should begin")
                    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                    revisit = head["warc-type"] == "revisit"
                    left, state, so_far, chunk = int(head["content-length"]), hashlib.sha1(), 0, 0
                    named = head["warc-payload-digest"].partition(":")[2]
                    while True:
                        data = stream.take(min(left, chunk_bytes)) if left else b""
                        left -= len(data)
                        state.update(data)
                        so_far += len(data)
                        rows.append(
                            {
                                "path": path, "record": nth, "chunk": chunk, "page_id": _page(head["warc-record-id"]), "url": head.get("warc-target-uri"),
                                "record_type": head["warc-type"], "refers_to": _page(head["warc-refers-to"]) if revisit else None,
                                "bytes_so_far": int(head["warc-payload-length"]) if revisit else so_far,
                                "digest_so_far": named if revisit else base32_sha1(state), "last": not left, "bytes": data if with_bytes else None,
                            }
                        )
                        chunk += 1
                        if not left:
                            break
                    if not revisit and rows[-1]["digest_so_far"] != named:
                        raise ValueError(f"{path}: record {nth} has another digest than its header says")
                    if stream.head() not in ([""], None):
                        raise ValueError(f"{path}: record {nth} is longer than its header says")
                    nth += 1
                    if len(rows) >= (16 if with_bytes else 2000):
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    kind = pa.schema(
        [("path", pa.string()), ("record", pa.int64()), ("chunk", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("bytes", pa.binary())]
    )
    n = max(1, min(paths.count(), 10_000))
    return paths.select("path").repartition(n, "path").mapInArrow(
        run, "path string, record long, chunk int, page_id long, url string, record_type string, refers_to long, bytes_so_far long, digest_so_far string, last boolean, bytes binary"
    )


def page_records(pages: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archives written and read back."""
    got = read_chunks(write(pages, **options)).where("last")
    return got.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
