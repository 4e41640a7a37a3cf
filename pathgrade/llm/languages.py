"""Language by hyperdimensional profiles.

Each letter, and the edge of a word, has a random vector of DIM signs (from its code point, so all tasks agree). The
vector of three neighbours binds them: the product of the first turned by two places, the second turned by one and the
third. A text's vector is the sum (bundle) of those of all its neighbour triples within words; a language's prototype
is the bundle of its texts, each counting by its length's root so that long ones do not outweigh the rest. A document
gets the language whose prototype has the largest cosine with its own vector; equal cosines go to the first language by
name.

Learning reads all documents with a language that are not held out; a task bundles what it reads and hands over one
vector for each language, in whole numbers, so sums do not depend on their order. Prototypes are as many rows of DIM
numbers as there are values of lang (4 KB each), which must fit a task; the number of documents does not matter.

Letters are what Unicode calls so, in lower case; all else is an edge. Null texts and texts without a letter are
``und`` with a score of 0, and so are all where there is nothing to learn from. Scores are cosines, negative ones 0.
Null doc_ids are not held out. Repeated rows count each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

DIM = 1024
UNKNOWN = "und"
#: Characters that are worked on at once, texts whose vectors are made together, triples whose vectors are held.
PIECE, TOGETHER, HELD = 1 << 20, 256, 8192
#: Letters whose vectors a worker keeps.
LETTERS_KEPT = 4096
#: A text's counts are scaled to this length before they are rounded.
UNIT = float(1 << 16)

_is_letter: list[np.ndarray] = []
_letters: dict[int, np.ndarray] = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def triples(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct triples of neighbours in words (three code points of 21 bits, 0 for an edge) and their counts."""
    if not _is_letter:
        _is_letter.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    found, before = [], np.zeros(1, np.int64)
    for at in range(0, len(text), PIECE):
        piece = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        piece[~_is_letter[0][piece]] = 0
        end = np.zeros(int(at + PIECE >= len(text)), np.int64)
        row = np.concatenate([before, piece, end])
        row = row[np.r_[True, (row[1:] != 0) | (row[:-1] != 0)]]
        middle = np.flatnonzero(row[1:-1] != 0)
        found.append((row[middle] << 42) | (row[middle + 1] << 21) | row[middle + 2])
        before = row[-2:]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _letter(code: int) -> np.ndarray:
    if code not in _letters:
        if len(_letters) >= LETTERS_KEPT:
            _letters.clear()
        signs = np.unpackbits(np.frombuffer(hashlib.shake_128(b"letter %d" % code).digest(DIM // 8), np.uint8))
        _letters[code] = (2 * signs.astype(np.int8) - 1).astype(np.int8)
    return _letters[code]


def vectors(found: np.ndarray) -> np.ndarray:
    """The bound vectors of triples."""
    out = None
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        codes, which = np.unique((found >> shift) & 0x1FFFFF, return_inverse=True)
        part = np.stack([np.roll(_letter(c), turn) for c in codes.tolist()])[which]
        out = part if out is None else out * part
    return out


def bundle(counts: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Rows of counts of triples -> rows of bundled vectors. Sums of whole numbers, exact in either precision."""
    kind = np.float32 if counts.sum(axis=1).max(initial=0) < (1 << 24) else np.float64
    out = np.zeros((len(counts), DIM), kind)
    for at in range(0, len(found), HELD):
        out += counts[:, at : at + HELD].astype(kind) @ vectors(found[at : at + HELD]).astype(kind)
    return out


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages' names, in order, and their prototypes as unit vectors."""

    def learn(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}

        def settle() -> None:
            for lang, weights in held.items():
                found, counts = np.fromiter(weights.keys(), np.int64), np.fromiter(weights.values(), np.float64)
                sums[lang] = sums.get(lang, np.zeros(DIM, np.int64)) + bundle(counts[None, :], found)[0].astype(np.int64)
            held.clear()

        for batch in source:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                found, counts = triples(text.as_py())
                if len(found):
                    counts = np.rint(counts * (UNIT / np.sqrt((counts.astype(np.float64) ** 2).sum()))).astype(np.int64)
                    own = held.setdefault(lang, {})
                    for g, c in zip(found.tolist(), counts.tolist(), strict=True):
                        own[g] = own.get(g, 0) + c
                    if sum(map(len, held.values())) > 1 << 18:
                        settle()
        settle()
        for lang, v in sums.items():
            yield pa.record_batch({"lang": pa.array([lang]), "v": pa.array([v.tolist()], pa.list_(pa.int64()))})
        tidy()

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", F.col("lang").cast("string").alias("lang"))
    rows = known.mapInArrow(learn, "lang string, v array<long>").select("lang", F.posexplode("v").alias("k", "x"))
    rows = rows.groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
    got = rows.select("lang", "v.x").orderBy("lang").collect()  # a row for each language
    made = np.array([r["x"] for r in got], np.float64).reshape(len(got), DIM)
    return [r["lang"] for r in got], made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-300)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    names, made = prototypes(docs)
    shared = docs.sparkSession.sparkContext.broadcast((names, made))

    def compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, made = shared.value
        for batch in source:
            texts = batch.column("text")
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows if names else 0, TOGETHER):
                rows = [(k, *triples(t.as_py())) for k, t in enumerate(texts[at : at + TOGETHER], at) if t.is_valid]
                rows = [r for r in rows if len(r[1])]
                for own in _some(rows):
                    found, which = np.unique(np.concatenate([r[1] for r in own]), return_inverse=True)
                    counts = np.zeros((len(own), len(found)))
                    counts[np.repeat(np.arange(len(own)), [len(r[1]) for r in own]), which] = np.concatenate([r[2] for r in own])
                    v = bundle(counts, found).astype(np.float64)
                    near = v @ made.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    at_rows = [r[0] for r in own]
                    best[at_rows] = np.argmax(np.round(near, 12), axis=1)
                    score[at_rows] = near[np.arange(len(own)), best[at_rows]]
            said = pa.array([names[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": said, "score": pa.array(np.clip(score, 0.0, 1.0))})
        tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(compare, "doc_id long, held_out boolean, lang_pred string, score double")


def _some(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of texts whose counts fit a small table together."""
    own, n = [], 0
    for r in rows:
        if own and (n + len(r[1])) * (len(own) + 1) > 1 << 23:
            yield own
            own, n = [], 0
        own.append(r)
        n += len(r[1])
    if own:
        yield own
