"""Phrase collocations: Rabin-Karp fingerprints of all n-grams, and the text of the frequent ones only.

Fingerprints. A text's bytes are classed at once (word, gap, end of a piece). Prefix sums of ``byte * BASE^place`` in
wrapping 64-bit arithmetic give a fingerprint of each word from two of them, and prefix sums over the words' mixed
fingerprints give one of each n-gram; n and the language are mixed in.

Passes over the texts, each a count of fingerprints that tasks combine in blocks before they are shuffled:
  1. words; 2. phrases of two frequent words; 3. longer phrases whose pairs are all frequent. An n-gram is no more
     frequent than its parts, so what the filter of the pass before lets through holds all frequent ones.
  4. For each frequent fingerprint a block points at its first occurrence, and every other occurrence is compared with
     it: words byte by byte, phrases word by word; where they differ, each gets its own count. Only then are the
     pointers' texts made, and counted by text.

The filters are bit arrays of BITS_EACH bits for each frequent fingerprint, MOST_BITS at most; beyond, more infrequent
phrases pass and cost time, and no result changes.

Scores are computed from the table of counts in decimal arithmetic. Null texts are empty, null languages are ``und``;
repeated rows count each; an empty table gives no rows. Other columns are not read. A word may be as long as it likes:
those over CHUNK bytes are fingerprinted by BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_uneven, materialize, tidy

LEAST = 30
LONGEST = 4
KEPT_PERCENT = 80
MOST = 2000
UNKNOWN = "und"

#: Bytes, and words, that one table of powers serves.
CHUNK = 1 << 18
#: Occurrences that a task gathers before it counts them.
GATHERED = 1 << 21
#: A filter has so many bits for each fingerprint in it, within these bounds (32 MB at most).
BITS_EACH, FEWEST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28
#: The first rows of a language are found in so many parts first.
PARTS = 16

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64."""
    up, down = np.full(CHUNK + LONGEST, base, U), np.full(CHUNK + LONGEST, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _tables:
        _tables[base] = _powers(base)
    return _tables[base]


BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """The words of a batch of texts: bytes, starts, ends, pieces, languages, fingerprints."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.bytes = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        edge = np.unique(offsets[:-1][np.diff(offsets) > 0])  # where a text begins
        kind = _KIND[self.bytes]
        inside = np.zeros(len(kind) + 1, bool)
        np.equal(kind, 0, out=inside[:-1])
        first = inside[:-1].copy()
        first[1:] &= ~inside[:-2]
        first[edge] = inside[edge]
        last = inside[:-1].copy()
        last &= ~inside[1:]
        ends_text = edge[1:] - 1
        last[ends_text] = inside[ends_text]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        breaks = np.union1d(np.flatnonzero(kind == 2), edge)
        self.piece = np.searchsorted(breaks, self.start, "right").astype(np.int32)
        doc = np.searchsorted(offsets, self.start, "right") - 1
        names = langs.dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        self.lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int32)[doc] if len(doc) else np.zeros(0, np.int32)
        self.print = self._prints()

    def __len__(self) -> int:
        return len(self.start)

    def _prints(self) -> np.ndarray:
        up, down = _table(BYTE_BASE)
        out, n = np.empty(len(self), U), len(self)
        size = self.end - self.start
        at = 0
        while at < n:
            base = self.start[at]
            to = int(np.searchsorted(self.end, base + CHUNK, "right"))
            if to <= at:  # one word that is longer than a chunk
                out[at] = int.from_bytes(hashlib.blake2b(self.bytes[base : self.end[at]].tobytes(), digest_size=8).digest(), "little")
                at += 1
                continue
            part = self.bytes[base : self.end[to - 1]].astype(U) + U(1)
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            s, e = self.start[at:to] - base, self.end[at:to] - base
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return _mix(out + size.astype(U) * U(0xA24BAED4963EE407))

    def grams(self, n: int, weak: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams within a piece start, and their fingerprints (``weak``: of so many bits only)."""
        up, down = _table(WORD_BASE)
        seeds = np.array([int.from_bytes(hashlib.blake2b(f"{n}:{x}".encode(), digest_size=8).digest(), "little") for x in self.langs] or [0], U)
        count = len(self) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        prints = np.empty(count, U)
        for at in range(0, count, CHUNK):
            to = min(at + CHUNK, count)
            sums = np.zeros(to - at + n, U)
            np.cumsum(self.print[at : to + n - 1] * up[: to - at + n - 1], out=sums[1:])
            prints[at:to] = (sums[n : n + to - at] - sums[: to - at]) * down[: to - at]
        whole = np.flatnonzero(self.piece[:count] == self.piece[n - 1 :])
        prints = _mix(prints[whole] + seeds[self.lang[whole]])
        return whole, prints >> U(64 - weak) if weak < 64 else prints

    def word(self, k: int) -> bytes:
        return self.bytes[self.start[k] : self.end[k]].tobytes()

    def texts(self, at: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array]:
        """The phrases of ``n`` words that start at these words, joined by spaces: which of them first, then their texts.

        Where a phrase stands with single spaces its bytes are taken as they are; the others are joined one by one.
        """
        plain = np.ones(len(at), bool)
        for k in range(n - 1):
            gap = self.end[at + k]
            plain &= (self.start[at + k + 1] == gap + 1) & (self.bytes[gap] == 0x20)
        first, last = self.start[at[plain]], self.end[at[plain] + n - 1]
        offsets = np.zeros(len(first) + 1, np.int32)
        np.cumsum(last - first, out=offsets[1:])
        data = self.bytes[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], last - first)]
        whole = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        odd = pa.array([b" ".join(self.word(p + k) for k in range(n)) for p in at[~plain].tolist()], pa.binary()).view(pa.string())
        return np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), pa.concat_arrays([whole, odd])

    def numbers(self, weak: int) -> np.ndarray:
        """A number for each word: equal if and only if the bytes are."""
        prints = self.print >> U(64 - weak) if weak < 64 else self.print
        _, first, number = np.unique(prints, return_index=True, return_inverse=True)
        size = self.end - self.start
        same = size == size[first[number]]
        if same.all():
            at = 0
            while same.all() and at < len(self):  # some CHUNK bytes at a time
                to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + CHUNK, "right")))
                if to == at + 1 and size[at] > CHUNK:
                    same[at] = self.word(at) == self.word(first[number[at]])
                else:
                    inside = np.arange(size[at:to].sum()) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
                    here = np.repeat(self.start[at:to], size[at:to]) + inside
                    there = np.repeat(self.start[first[number[at:to]]], size[at:to]) + inside
                    if not np.array_equal(self.bytes[here], self.bytes[there]):
                        same[at] = False
                at = to
        if same.all():
            return number
        known: dict[bytes, int] = {}  # two words share a fingerprint
        return np.array([known.setdefault(self.word(k), len(known)) for k in range(len(self))], np.int64)


def _allowed(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slot = prints & U(len(bits) * 8 - 1)
    return (bits[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 > 0


def _batches(source: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in source:
        if batch.num_rows:
            yield Words(batch.column("text"), batch.column("lang"))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _frequent(docs: DataFrame, sizes: tuple[int, ...], before, least: int, weak: int) -> DataFrame:
    """print: those of the n-grams of these sizes that are frequent; ``before``, a broadcast filter, has all frequent shorter ones."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = (None if before is None else before.value), [], 0
        for words in _batches(source):
            part = None
            if bits is not None:
                shorter = 1 if sizes[0] == 2 else 2
                where, prints = words.grams(shorter, weak)
                part = np.zeros(len(words), bool)
                part[where[_allowed(bits, prints)]] = True
            for n in sizes:
                where, prints = words.grams(n, weak)
                if part is not None:
                    for k in range(n - shorter + 1):
                        ok = part[where + k]
                        where, prints = where[ok], prints[ok]
                held.append(prints)
                size += len(prints)
            if size >= GATHERED:
                yield _counted(held)
                held, size = [], 0
        if size:
            yield _counted(held)
        tidy()

    rows = _input(docs).mapInArrow(count, "print long, n long")
    return rows.groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("print")


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    prints, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.record_batch({"print": pa.array(prints.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def _filter(prints: DataFrame) -> np.ndarray:
    """The bit array of fingerprints; its size is bounded, so it may be collected and broadcast."""
    count, bits = prints.count(), FEWEST_BITS
    while bits < min(count * BITS_EACH, MOST_BITS):
        bits *= 2
    slot = prints.select(F.col("print").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(slot & 63)))").alias("v")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out.view(np.uint8)


def _joined(*filters: np.ndarray) -> np.ndarray:
    """One filter that lets through what any of these do: a smaller one is repeated."""
    size = max(map(len, filters))
    out = np.zeros(size, np.uint8)
    for f in filters:
        out |= np.tile(f, size // len(f))
    return out


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, weak: int = 64) -> DataFrame:
    """lang, phrase (1 to ``longest`` words), words, n: all that occur ``least`` times; and for each language a row with
    a null phrase and all its words' number."""
    context = docs.sparkSession.sparkContext
    filters = []
    for sizes in ((1,), (2,), tuple(range(3, longest + 1))):
        if not sizes or sizes[0] > longest:
            break
        before = context.broadcast(filters[-1]) if filters else None
        filters.append(_filter(materialize(_frequent(docs, sizes, before, least, weak), "phrase-prints")))
    shared = context.broadcast(_joined(*filters))

    def verify(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for words in _batches(source):
            number = words.numbers(weak)
            totals = np.bincount(words.lang, minlength=len(words.langs))
            yield _table_of(pa.array(words.langs, pa.string()), pa.nulls(len(totals), pa.string()), 0, totals)
            for n in range(1, longest + 1):
                where, prints = words.grams(n, weak)
                ok = _allowed(bits, prints)
                where, prints = where[ok], prints[ok]
                if not len(where):
                    continue
                _, first, own = np.unique(prints, return_index=True, return_inverse=True)
                pointer = where[first]
                same = words.lang[where] == words.lang[pointer[own]]
                for k in range(n):
                    same &= number[where + k] == number[pointer[own] + k]
                if not same.all():  # phrases that share a fingerprint part here
                    what = np.stack([words.lang[where].astype(np.int64), *[number[where + k] for k in range(n)]], axis=1)
                    _, first, own = np.unique(what, axis=0, return_index=True, return_inverse=True)
                    pointer, own = where[first], own.reshape(-1)
                counts = np.bincount(own, minlength=len(pointer))
                order, texts = words.texts(pointer, n)
                langs = pa.array(words.langs, pa.string()).take(pa.array(words.lang[pointer[order]]))
                yield _table_of(langs, texts, n, counts[order])
        tidy()

    rows = _input(docs).mapInArrow(verify, "lang string, phrase string, words int, n long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull())


def _table_of(langs: pa.Array, texts: pa.Array, words: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"lang": langs, "phrase": texts, "words": pa.array(np.full(len(langs), words, np.int32)), "n": pa.array(counts.astype(np.int64))})


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _with_frequency(cuts: DataFrame, known: DataFrame, part: str, name: str) -> DataFrame:
    """The part's frequency; a word that begins very many phrases is no hot key."""
    uses = cuts.groupBy("lang", part).agg(F.count("*").alias("uses"))
    dim = known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)).join(uses, ["lang", part])
    return join_uneven(cuts, dim, ["lang", part], "uses", F.lit(True))


def scored(known: DataFrame, least: int = LEAST, kept_percent: int = KEPT_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that no longer phrase takes in."""
    known = known.where(F.col("phrase").isNotNull())
    phrases = known.where((F.col("words") >= 2) & (F.col("n") >= least))
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    cuts = _with_frequency(_with_frequency(cuts, known, "left", "l"), known, "right", "r")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"), F.first("a").alias("a"))
    # the parts of two words and more of each longer phrase
    w = F.split("phrase", " ", -1)
    longer = phrases.where("words >= 3").select("lang", "n", "words", w.alias("w"))
    longer = longer.select("lang", "n", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    longer = longer.select("lang", "n", F.explode(F.expr("transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))")).alias("phrase"))
    around = longer.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    taken = F.lit(100) * _exact("around") >= F.lit(kept_percent) * _exact("a")
    out = best.join(around, ["lang", "phrase"], "left").where(~F.coalesce(taken, F.lit(False)))
    return out.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").cast("long").alias("score"))


def ranked(known: DataFrame, least: int = LEAST, most: int = MOST, kept_percent: int = KEPT_PERCENT) -> DataFrame:
    """Each language's first phrases. The first of a part are taken before those of the language, so that no task sorts them all."""
    best = scored(known, least, kept_percent)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    top = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    totals = known.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("n"))
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, kept_percent: int = KEPT_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    return ranked(materialize(frequencies(docs, least, longest), "phrases"), least, most, kept_percent)
