"""Toxicity: a learnt lexicon, found through Levenshtein automata, and scores of the context of each find.

Learning (labelled rows only; at most TRAIN_ROWS documents, those with the smallest hashes):
  1. Beginnings of words that toxic documents have far more often than others become the lexicon. Uses in toxic
     documents count once for each word before them, so that copies of a text are one use; of nested beginnings the one
     that tells the classes apart best is taken. A term that is a whole word says so.
  2. The terms form a trie. Its intersection with the Levenshtein automata of all words (one edit from LONG letters
     on) is built once as a table of states, so that a word costs a lookup for each letter.
  3. Each find has its term's weight (the log of how many times as often toxic documents have it) and is weighed in
     its context: inside quotation marks or not, and how many finds stand near it. A logistic regression on these sums
     and on the text's length gives the score.

Scoring: each task runs its distinct words through the table, and only texts with finds look at contexts. Labels, lang,
source and doc_id are no inputs of a score. Null and empty texts have no finds and get the score of such texts.
A label other than 0 marks a text as toxic. Without labelled rows of both kinds every score is 0. Repeated rows each give a row; of repeated labels the highest
counts. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, ship, tidy

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
SHORTEST, LONGEST = 3, 24
#: A beginning becomes a term if it is so many times as frequent in toxic documents, and in so many of them.
LIFT, SUPPORT = 8.0, 0.02
MOST_WEIGHT = 8.0
#: Terms of so many letters may be misspelled by one edit.
LONG = 5
#: Words on each side of a find.
WINDOW = 8
QUOTES = "\"'“”„‟‘’‚«»‹›`"
N_FEATURES = 7
RIDGE = 1e-2
WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of at most ``most`` labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(most)  # so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("text", "toxic")


def _beginnings_of(w: str) -> Iterator[str]:
    """Of a word with its end mark those beginnings that may be terms: of SHORTEST to LONGEST letters, and the whole word, however long."""
    if len(w) > SHORTEST:
        yield from (w[:k] for k in range(SHORTEST, min(len(w) - 1, LONGEST) + 1))
        yield w


def _beginnings(rows: DataFrame, toxic: int) -> tuple[dict[str, tuple[int, int, int]], int, int]:
    """Beginnings of words ($: and their end) -> uses in toxic documents, most documents of one use, uses in others; all uses.

    Only those frequent enough for the lexicon come to the driver: each is in SUPPORT of the toxic documents' uses.

    A use is a word and the word before it, once in a document; toxic documents that repeat one have one use of it.
    """

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other, toxic = Counter(), Counter()
        for batch in bpe.batches(source, "text"):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = [f"{w}$" for w in WORD.findall((text or "").lower())]
                uses = set(zip(words, ["", *words], strict=False))
                if label:
                    toxic.update(uses)
                else:
                    other.update(w for w, _ in uses)
        begin, bare = Counter(), Counter({"": sum(other.values())})
        for (w, v), n in toxic.items():
            begin["", f"{w} {v}"] += n
            for b in _beginnings_of(w):
                begin[b, v] = max(begin[b, v], n)
        for w, n in other.items():
            for b in _beginnings_of(w):
                bare[b] += n
        other.clear()
        toxic.clear()
        rows = chain(((w, v, n, 0) for (w, v), n in begin.items()), ((w, None, 0, n) for w, n in bare.items()))
        while some := list(islice(rows, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["word", "before", "docs", "other"])
        begin.clear()
        bare.clear()
        tidy()

    each = rows.mapInArrow(count, "word string, before string, docs long, other long").groupBy("word", "before").agg(F.sum("docs").alias("docs"), F.sum("other").alias("other"))
    by = each.groupBy("word").agg(F.count("before").alias("uses"), F.max("docs").alias("docs"), F.sum("other").alias("other")).where("uses >= 4 or word = ''")
    by = materialize(by, "toxicity-words")
    total = by.where("word = ''").first()
    if total is None or not total.uses or not total.other:
        return {}, 0, 0
    lift = (F.col("uses") + 0.5) / total.uses / ((F.col("other") + 0.5) / total.other)
    good = by.where((F.col("word") != "") & (F.col("uses") >= least_uses(toxic)) & (lift >= LIFT))
    return {r["word"]: (r["uses"], r["docs"], r["other"]) for r in good.collect()}, total.uses, total.other


def least_uses(toxic: int) -> float:
    return max(4, SUPPORT * toxic)


def lexicon(found: dict[str, tuple[int, int, int]], uses: int, other: int, toxic: int) -> dict[str, float]:
    """Terms, $ at the end of whole words, and their weights."""
    least = least_uses(toxic)
    lift = lambda w: (found[w][0] + 0.5) / uses / ((found[w][2] + 0.5) / other)
    good = {w: lift(w) for w, (a, _, _) in found.items() if a >= least and lift(w) >= LIFT}
    gain = {w: found[w][0] * float(np.log(x)) for w, x in good.items()}
    inside: dict[str, list[str]] = {}
    for w in good:
        for k in range(1, len(w) + 1):
            inside.setdefault(w[:k], []).append(w)
    terms: dict[str, float] = {}
    gone: set[str] = set()
    for w in sorted(good, key=lambda w: (-round(gain[w], 6), -len(w), w)):
        if w not in gone:
            terms[w] = min(MOST_WEIGHT, float(np.log(good[w])))
            gone.update(inside[w], (w[:k] for k in range(1, len(w))))
    return terms


class Automaton:
    """The trie of terms met with Levenshtein automata, as a table: state, letter -> state."""

    def __init__(self, terms: dict[str, float]):
        children: list[dict[str, int]] = [{}]
        ends: list[int] = [0]  # 1: a whole word ends here, 2: a beginning
        edits = [0]
        weight = [0.0]
        for term, value in terms.items():
            letters = term.rstrip("$")
            most = int(len(letters) >= LONG)
            node = 0
            edits[0] = max(edits[0], most)
            for c in letters:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(0)
                    edits.append(0)
                    weight.append(0.0)
                node = children[node][c]
                edits[node] = max(edits[node], most)
            ends[node] |= 1 if term.endswith("$") else 2
            weight[node] = max(weight[node], value)
        allowed = edits
        self.letters = {c: k + 1 for k, c in enumerate(sorted({c for t in children for c in t}))}

        def close(state: dict[int, int]) -> frozenset:
            queue = list(state.items())
            while queue:
                v, e = queue.pop()
                if state.get(v, 9) < e:
                    continue
                for u in children[v].values():
                    if e + 1 <= allowed[u] and state.get(u, 9) > e + 1:
                        state[u] = e + 1
                        queue.append((u, e + 1))
            return frozenset(state.items())

        def step(state: frozenset, c: str) -> frozenset:
            to: dict[int, int] = {}

            def put(v: int, e: int) -> None:
                if e <= allowed[v] and to.get(v, 9) > e:
                    to[v] = e

            for v, e in state:
                put(v, e + 1)
                for x, u in children[v].items():
                    put(u, e if x == c else e + 1)
            return close(to)

        first = close({0: 0})
        names, order = {first: 0}, [first]
        table: list[list[int]] = []
        for state in order:
            row = []
            for c in ["\0", *self.letters]:
                to = step(state, c)
                if to not in names:
                    names[to] = len(order)
                    order.append(to)
                row.append(names[to])
            table.append(row)
        self.table = np.array(table, np.int32)
        self.at_end, self.end_weight = self._grades(order, ends, weight, 1)
        self.on_way, self.way_weight = self._grades(order, ends, weight, 2)

    @staticmethod
    def _grades(order: list[frozenset], ends: list[int], weight: list[float], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each state the edits of the best term that ends there (9: none), and its weight."""
        best = [min(((e, -weight[v]) for v, e in s if ends[v] & kind), default=(9, 0.0)) for s in order]
        return np.array([e for e, _ in best], np.int8), np.array([-w for _, w in best])

    def edits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word (lower case) the edits from the nearest term (0, 1, or 9 for none), and that term's weight."""
        out, value = np.full(len(words), 9, np.int8), np.zeros(len(words))
        if not words:
            return out, value
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lookup = np.zeros(0x110000, np.int16)
        for c, k in self.letters.items():
            lookup[ord(c)] = k
        letters, start = lookup[codes], np.cumsum(sizes) - sizes
        state, live, dead = np.zeros(len(words), np.int32), np.arange(len(words)), self.dead

        def better(at: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> None:
            now = grade[state[at]]
            some = at[now < out[at]]
            out[some], value[some] = grade[state[some]], weight[state[some]]

        for k in range(int(sizes.max()) + 1):
            better(live[sizes[live] == k], self.at_end, self.end_weight)
            live = live[sizes[live] > k]
            if not len(live):
                break
            state[live] = self.table[state[live], letters[start[live] + k]]
            better(live, self.on_way, self.way_weight)
            live = live[(state[live] != dead) & (out[live] > 0)]
        return out, value

    @property
    def dead(self) -> int:
        still = np.flatnonzero((self.table == np.arange(len(self.table))[:, None]).all(axis=1))
        return int(still[0]) if len(still) else -1


def features(automaton: Automaton, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the features, its finds and its finds inside quotation marks."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = lists.flatten().dictionary_encode()
    tokens = pc.utf8_lower(coded.dictionary)
    plain = pc.utf8_trim(tokens, "!,.;:?()[]{}*_-" + QUOTES)
    words = bpe._strings(plain)
    grade, weight = automaton.edits(words)
    # tokens of several words, and what the trimming did not reach: word by word
    odd = np.flatnonzero(~pc.match_substring_regex(plain, r"^[\pL\pN]*$").to_numpy(zero_copy_only=False).astype(bool))
    parts = [WORD.findall(words[k]) for k in odd]
    each, values = automaton.edits([w for p in parts for w in p])
    at = 0
    for k, p in zip(odd, parts, strict=True):
        best = min(range(at, at + len(p)), key=lambda i: (each[i], -values[i]), default=None)
        grade[k], weight[k] = (9, 0.0) if best is None else (each[best], values[best])
        at += len(p)
    marks = "[" + re.escape(QUOTES) + "]"
    opens = pc.match_substring_regex(tokens, f"^[(\\[]?{marks}").to_numpy(zero_copy_only=False).astype(np.int64)
    closes = pc.match_substring_regex(tokens, f"{marks}[!,.;:?)\\]]*$").to_numpy(zero_copy_only=False).astype(np.int64)
    which = coded.indices.to_numpy(zero_copy_only=False)
    edits = grade[which]
    hits = np.flatnonzero(edits < 9)
    n = len(bounds) - 1
    out, count, inside = np.zeros((n, N_FEATURES)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    out[:, 6] = np.log(np.diff(bounds) + 10)
    if not len(hits):
        return out, count, inside
    doc = np.searchsorted(bounds, hits, "right") - 1
    lo, hi = np.maximum(bounds[doc], hits - WINDOW), np.minimum(bounds[doc + 1], hits + WINDOW + 1)
    op, cl = (np.concatenate([[0], np.cumsum(x[which])]) for x in (opens, closes))
    # a mark opens before the find (or with it) that does not close before it, and one closes after it (or with it)
    quoted = (op[hits + 1] - op[lo] > cl[hits] - cl[lo]) & (cl[hi] - cl[hits] > 0)
    near = np.searchsorted(hits, hi) - np.searchsorted(hits, lo)
    exact, worth = edits[hits] == 0, weight[which[hits]]
    for k, some in enumerate((exact & ~quoted, ~exact & ~quoted, exact & quoted, ~exact & quoted)):
        out[:, k] = np.log1p(np.bincount(doc[some], worth[some], n))
    free = ~quoted & exact
    most = np.zeros(n)
    np.maximum.at(most, doc[free], near[free])
    out[:, 4] = np.log1p(most)
    out[:, 5] = np.sqrt(100 * np.bincount(doc[free], worth[free], n) / (np.diff(bounds) + 10))
    return out, np.bincount(doc, minlength=n), np.bincount(doc[quoted], minlength=n)


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method; the constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(h, g)
        w -= move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Automaton, np.ndarray] | None:
    """The automaton and the weights; None without labelled rows of both kinds."""
    ship(docs.sparkSession)
    rows = training_rows(docs, labels)
    kinds = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if set(kinds) != {0, 1}:
        return None
    found, uses, other = _beginnings(rows, kinds[1])
    if not uses or not other:
        return None
    automaton = Automaton(lexicon(found, uses, other, kinds[1]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.batches(source, "text"):
            x = features(automaton, batch.column("text"))[0]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(N_FEATURES)] + [batch.column("toxic")], [*(f"x{k}" for k in range(N_FEATURES)), "toxic"])
        tidy()

    names = ", ".join(f"x{k} double" for k in range(N_FEATURES))
    got = rows.mapInArrow(run, f"{names}, toxic int").toPandas()  # TRAIN_ROWS rows at most
    got = got.sort_values(list(got.columns))
    return automaton, _regression(got[[f"x{k}" for k in range(N_FEATURES)]].to_numpy(), got["toxic"].to_numpy(float))


def _scores(model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if model is None:
        none = np.zeros(len(texts), np.int64)
        return np.zeros(len(texts)), none, none
    automaton, w = model
    x, n, quoted = features(automaton, texts)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))), n, quoted


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, finds, quoted_finds."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.batches(source, "text"):
            p, n, quoted = _scores(model.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(n), pa.array(quoted)], ["doc_id", "score", "predicted", "finds", "quoted_finds"])
        tidy()

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, finds long, quoted_finds long")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "finds", "quoted_finds")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not predicted toxic, with their own columns, in place."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            named = batch.rename_columns([f"c{k}" for k in range(batch.num_columns)])
            for part in bpe.batches(iter([named]), f"c{at}"):
                p, _, _ = _scores(model.value, part.column(at))
                yield part.filter(pa.array(p < threshold)).rename_columns(batch.schema.names)
        tidy()

    return docs.mapInArrow(run, docs.schema)
