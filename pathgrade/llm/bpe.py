"""Encoding and decoding with a public BPE vocabulary: tree concatenation for long texts.

Texts of up to ``long_chars`` characters are encoded where they are read. A longer one is cut into pieces that Spark
deals over tasks; its halves' ids are then joined in a binary tree. Around each join a window of text is encoded
again and grows until its tokens agree with the tokens of both sides at equal places; what lies between is taken from
the window. If the window reaches both ends it is the exact encoding of the two sides. Tokens are an encoding if every
two neighbours are the encoding of their own text, so one token at which both sides agree would be enough to join them;
RUN of them are asked for. Where white space stands at the join no run is needed.

Nulls count as empty texts. Empty texts have no ids. Repeated rows each give a row. Columns but doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

VOCABULARY = "word_bpe_49k.json"
LONG_CHARS = 32_768
PIECE_CHARS = 16_384
#: Tokens in a row that must agree where no white space proves that a token begins a word.
RUN = 16
#: Characters on each side of a join in the first window.
WINDOW = 128
#: Text encoded at once in a task.
BATCH_BYTES = 2 << 20
#: Words of only these letters, then only these signs, have one or two words of the vocabulary; lower case and NFC
#: keep the letters' number.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", "!,.;:?"
PLAIN = f"^[{LETTERS}]+[{SIGNS}]*$"
#: Words that a task's process keeps with their ids, some 200 bytes each.
KNOWN = 200_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    return Encoder(path, plain_specials)


class Encoder:
    """A tokenizers vocabulary and an encoder for columns of texts."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        if plain_specials:
            self.tok.encode_special_tokens = True
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        names = [self.tok.id_to_token(i) or "" for i in range(self.size)]
        self.ends = np.array([x.endswith("</w>") for x in names])
        self.known: dict[str, int] = {"": 0}
        self.ids, self.starts = np.zeros(0, np.uint32), np.array([0, 0])
        self.text_of_id = [str(i) for i in range(self.size)]
        #: White space only separates words in these vocabularies, so each distinct word is encoded once a batch.
        self.by_word = bool(self.ends.any()) and self._spaceless()

    def _spaceless(self) -> bool:
        ids = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        return ids("ab \n\t cd, e") == ids("ab") + ids("cd,") + ids("e") and not ids(" \t\n\v\f\r ")

    def one(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def placed(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the characters where their tokens start."""
        e = self.tok.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.array([a for a, _ in e.offsets], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, and each text's bounds in them (one more than there are texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            each = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        parts, ids, starts = self._parts(coded.dictionary)
        which = parts[coded.indices.to_numpy(zero_copy_only=False)]
        n = np.where(which < 0, 0, np.diff(starts)[which])
        words = np.concatenate([[0], np.cumsum(n.sum(axis=1))])
        which, n = which.ravel(), n.ravel()
        at = np.cumsum(n) - n
        out = ids[np.arange(words[-1], dtype=np.int64) + np.repeat(starts[which] - at, n)]
        return out, words[bounds - bounds[0]]

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct word two parts (letters, signs; -1: none) that are encoded apart; the parts' ids and bounds."""
        plain = pc.match_substring_regex(words, PLAIN)
        base = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, SIGNS)), words).dictionary_encode()
        rest = pc.if_else(plain, pc.replace_substring_regex(words, "^[^" + SIGNS + "]+", ""), "").dictionary_encode()
        values = [*_strings(base.dictionary), *_strings(rest.dictionary)]
        known = self.known
        at = np.fromiter((known.get(x, -1) for x in values), np.int64, len(values))
        fresh = np.flatnonzero(at < 0)
        sizes, got = self._encode([values[k] for k in fresh])
        ids = np.concatenate([self.ids, got])
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        at[fresh] = np.arange(len(fresh)) + len(self.starts) - 1
        if len(known) + len(fresh) <= KNOWN:
            known.update((values[k], int(at[k])) for k in fresh)
            self.ids, self.starts = ids, starts
        n = len(base.dictionary)
        two = np.stack([at[:n][base.indices.to_numpy(zero_copy_only=False)], at[n:][rest.indices.to_numpy(zero_copy_only=False)]], axis=1)
        return two, ids, starts

    def _encode(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the values, and these ids."""
        easy = pc.match_substring_regex(pa.array(values, pa.string()), "^[" + LETTERS + "]+$").to_numpy(zero_copy_only=False).astype(bool)
        sizes = np.zeros(len(values), np.int64)
        order, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        some = np.flatnonzero(easy)
        for k in range(0, len(some), 4096):  # one id with a word's end each
            own = some[k : k + 4096]
            got = self.one(" ".join([values[i] for i in own]))
            sizes[own] = np.diff(np.flatnonzero(self.ends[got]), prepend=-1)
            order.append(own)
            ids.append(got)
        some = np.flatnonzero(~easy)
        for k in range(0, len(some), 4096):
            got = [e.ids for e in self.tok.encode_batch_fast([values[i] for i in some[k : k + 4096]], add_special_tokens=False)]
            sizes[some[k : k + 4096]] = [len(x) for x in got]
            order.append(some[k : k + 4096])
            ids.append(np.array([i for x in got for i in x], np.uint32))
        seq, flat = np.concatenate(order), np.concatenate(ids)
        first = np.zeros(len(values), np.int64)
        first[seq] = np.cumsum(sizes[seq]) - sizes[seq]
        to = np.cumsum(sizes) - sizes
        return sizes, flat[np.arange(len(flat)) + np.repeat(first - to, sizes)] if len(flat) else flat


def _strings(words: pa.Array) -> list[str]:
    """to_pylist() of strings without white space, several times as fast."""
    if not len(words):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return pc.binary_join(one, " ")[0].as_py().split(" ")


def batches(source: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of the column, or one row."""
    for batch in source:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def _agree(a_ids, a_at, b_ids, b_at, text: str, base: int, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """A place in [low, high) where two encodings have the same tokens: indexes into both. last: the latest such place."""
    both, ia, ib = np.intersect1d(a_at, b_at, return_indices=True)
    keep = (both >= low) & (both < high)
    both, ia, ib = both[keep], ia[keep], ib[keep]
    same = a_ids[ia] == b_ids[ib]
    # a place counts if white space stands before it (a word begins in both), or RUN tokens around it agree
    for k in (range(len(both) - 1, -1, -1) if last else range(len(both))):
        if not same[k]:
            continue
        p = both[k] - base
        if p > 0 and text[p - 1].isspace() and text[p - 1] in " \t\n\v\f\r":
            return int(ia[k]), int(ib[k])
        x, y = int(ia[k]), int(ib[k])
        lo, hi = (x - RUN + 1, x + 1) if last else (x, x + RUN)
        if lo >= 0 and hi <= len(a_ids) and y + lo - x >= 0 and y + hi - x <= len(b_ids):
            if (a_ids[lo:hi] == b_ids[y + lo - x : y + hi - x]).all() and (a_at[lo:hi] == b_at[y + lo - x : y + hi - x]).all():
                return x, y
    return None


def concatenate(enc: Encoder, left, right):
    """Join two encoded neighbours (text, first character, ids, places) into one."""
    (lt, la, lids, lat), (rt, ra, rids, rat) = left, right
    w = WINDOW
    while True:
        wl, wr = min(w, len(lt)), min(w, len(rt))
        a, text = ra - wl, lt[len(lt) - wl :] + rt[:wr]
        ids, at = enc.placed(text)
        at = at + a
        whole_left, whole_right = wl == len(lt), wr == len(rt)
        # nothing of the outer quarter of the window, where its own ends show, and nothing beside the join counts
        start = (0, 0) if whole_left else _agree(lids, lat, ids, at, text, a, a + wl // 4, ra - wl // 4, True)
        stop = (len(rids), len(ids)) if whole_right else _agree(rids, rat, ids, at, text, a, ra + wr // 4, ra + wr - wr // 4, False)
        if start is not None and stop is not None and start[1] <= stop[1]:
            return (
                lt + rt,
                la,
                np.concatenate([lids[: start[0]], ids[start[1] : stop[1]], rids[stop[0] :]]),
                np.concatenate([lat[: start[0]], at[start[1] : stop[1]], rat[stop[0] :]]),
            )
        w *= 2


def encode_tree(enc: Encoder, pieces: list[tuple]) -> np.ndarray:
    """Join encoded pieces in text order, neighbours first, then pairs of pairs."""
    level = pieces
    while len(level) > 1:
        level = [concatenate(enc, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0][2] if level else np.zeros(0, np.uint32)


def encoded(
    docs: DataFrame,
    schema: str,
    out: Callable[[Encoder, list, np.ndarray, np.ndarray], pa.RecordBatch],
    path: str | None = None,
    long_chars: int = LONG_CHARS,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Encode doc_id, text; ``out`` makes rows from an encoder, doc_ids, all ids and the texts' bounds in them."""
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if long_chars < 4 * WINDOW or piece_chars < 2 * WINDOW:
        raise ValueError("long_chars and piece_chars are too small for the windows")

    def here(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches(source, "text"):
            yield out(enc, batch.column("doc_id"), *enc.column(batch.column("text")))
        tidy()

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text", 1):
            key, doc, text = (batch.column(c)[0].as_py() for c in ("key", "doc_id", "text"))
            for no, k in enumerate(range(0, len(text), piece_chars)):
                yield pa.RecordBatch.from_pylist(
                    [{"key": key, "doc_id": doc, "no": no, "at": k, "text": text[k : k + piece_chars]}],
                    pa.schema([("key", pa.int64()), ("doc_id", batch.column("doc_id").type), ("no", pa.int32()), ("at", pa.int64()), ("text", pa.string())]),
                )

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches(source, "text"):
            done = [enc.placed(x) for x in batch.column("text").to_pylist()]
            yield batch.append_column("ids", pa.array([i.astype("<u4").tobytes() for i, _ in done], pa.binary())).append_column(
                "places", pa.array([p.astype("<u4").tobytes() for _, p in done], pa.binary())
            )
        tidy()

    def join(table: pa.Table) -> pa.Table:
        enc = encoder(path)
        table = table.sort_by("no")
        pieces = [
            (r["text"], r["at"], np.frombuffer(r["ids"], "<u4"), r["at"] + np.frombuffer(r["places"], "<u4").astype(np.int64))
            for r in table.to_pylist()
        ]
        ids = encode_tree(enc, pieces)
        return pa.Table.from_batches([out(enc, table.column("doc_id").combine_chunks()[:1], ids, np.array([0, len(ids)]))])

    kind = dict(rows.dtypes)["doc_id"]
    fields = f"key long, doc_id {kind}, no int, at long, text string"
    short = rows.where(F.length("text") <= long_chars).mapInArrow(here, schema)
    long = rows.where(F.length("text") > long_chars).withColumn("key", F.monotonically_increasing_id())
    joined = (
        long.mapInArrow(cut, fields)
        .repartition("key", "no")
        .mapInArrow(encode, f"{fields}, ids binary, places binary")
        .groupBy("key")
        .applyInArrow(join, schema)
    )
    return short.unionByName(joined)


def _digests(enc: Encoder, docs: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    names, n, a, b = enc.text_of_id, [], [], []
    for k in range(len(at) - 1):
        own = ids[at[k] : at[k + 1]].tolist()
        n.append(len(own))
        a.append(sha(" ".join([names[i] for i in own])))
        b.append(sha(enc.tok.decode(own, skip_special_tokens=False)))
    return pa.RecordBatch.from_arrays([docs, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them."""
    kind = dict(docs.dtypes)["doc_id"]
    return encoded(docs, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, **options)


def encode_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, ids: the ids themselves."""

    def rows(enc, keys, ids, at):
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([keys, lists], ["doc_id", "ids"])

    return encoded(docs, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>", rows, **options)


def decode_documents(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: ids decoded, special tokens kept."""
    ship(rows.sparkSession)
    path = path or vocabulary_path()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in source:
            texts = [enc.tok.decode(x or [], skip_special_tokens=False) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
