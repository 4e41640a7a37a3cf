"""Near copies of texts: an exact join of shingle sets by their prefixes, in column expressions.

A text's set is its distinct shingles of ``words`` words (fewer words: all as one; none: no set, and no copies). Equal
sets are one class, so exact copies cost nothing below. Every two classes of at least the given Jaccard similarity are a
link; groups are the connected components.

  * Prefixes: in one order of all shingles, two sets of n shingles and of similarity s share one of their first
    n - ceil(n * s) + 1. Hashes in order, but those that more than OFTEN prefixes have come last, the rarer of them
    first (`_heads`). The order decides cost, not results.
  * Partners: all pairs of classes that share such a shingle, if sizes and places allow a link (`partners`). No cap.
  * Centres: MinHash signatures of classes with more than PAIRED partners (each shingle's hash falls into one of
    BANDS * ROWS bins, the smallest of each stands for it; an empty bin takes the next filled one's) and banded buckets:
    up to PAIRED classes all pairs, in a larger bucket each with the first, and again with the next band's bins, up to
    SPLITS times (`candidates`). A class's centre is the first class that it so meets. It decides cost, not results.
  * Overlaps: of partners with one centre from what they lack of it and have beside it, as members of a family differ in
    little; of others from their whole sets, if the parities of their numbers of shingles in cells, a bound of the
    difference that never exceeds it, allow a link. Both are exact.

Null texts are empty. Repeated rows and ids are copies of each other if their texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected, kept

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
PAIRED, SPLITS = 12, 3
#: Shingles of more prefixes come last in the order of prefixes; rounds in which they are looked for.
OFTEN, ROUNDS = 16, 5
#: Words of 64 cells in which whole sets are compared beforehand (a power of two).
CELLS = 16
#: Tables of at most so many words of 8 bytes are sent to all tasks, so that the sets stay where they are.
FEW = 4_000_000
#: What rounding may take from a bound.
SLACK = 1e-6


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def shingles(list_: str, words: int = WORDS) -> Column:
    """The sorted distinct 64-bit hashes of the shingles of a column of words."""
    w = F.col(list_)  # a column: a lambda would compute an expression for each shingle
    long = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
    hashes = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < words, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(long)
    return F.sort_array(F.array_distinct(hashes))  # sort_array compares no elements by a lambda


def _placed(hashes: Column, size: int) -> Column:
    """The hashes in the order of their bins (at most 127), the bin in the upper bits."""
    placed = F.transform(hashes, lambda x: F.shiftleft(F.pmod(x, F.lit(size)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(x, 8)))
    return F.sort_array(placed)


def _first_of_bins(placed: Column) -> Column:
    bin_ = lambda x: F.shiftright(x, 56)
    return F.filter(placed, lambda x, i: (i == 0) | (bin_(x) != bin_(F.get(placed, i - 1))))


def _filled(firsts: Column, size: int) -> Column:
    """A value for each bin: an empty one has the next filled bin's, after the last the first's."""
    borrowed = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.coalesce(F.get(F.filter(firsts, lambda x: F.shiftright(x, 56) >= j), F.lit(0)), F.get(firsts, F.lit(0))))
    return F.when(F.size(firsts) == size, firsts).otherwise(borrowed)


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key, row, class (of equal sets; null without words), hashes."""
    rows = docs.select(F.col(key).alias("key"), word_list(F.col(text)).alias("list")).select("key", shingles("list", words).alias("hashes"))
    class_ = F.when(F.size("hashes") > 0, F.concat(F.hex(F.xxhash64("hashes")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "hashes"))))
    return rows.select("key", F.monotonically_increasing_id().alias("row"), class_.alias("class"), "hashes")


def banded(sets: DataFrame) -> DataFrame:
    """class (the row's number), bands of its set."""
    size = BANDS * ROWS
    rows = sets.select(F.col("row").alias("class"), _placed(F.col("hashes"), size).alias("bins"))
    rows = rows.withColumn("bins", _first_of_bins(F.col("bins"))).withColumn("bins", _filled(F.col("bins"), size))
    band = lambda b: F.xxhash64(*[F.get("bins", F.lit(b * ROWS + r)) for r in range(ROWS)])
    return rows.select("class", F.array(*[band(b) for b in range(BANDS)]).alias("bands"))


def candidates(classes: DataFrame) -> DataFrame:
    """a, b (a before b): classes (class, bands) that meet in buckets, each pair once; of a large family along its branches, not pair by pair."""
    level = classes.select("class", "bands", F.posexplode("bands").alias("band", "bucket"))
    found = []
    for split in range(SPLITS + 1):
        sizes = level.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("class").alias("first")).where("n > 1")
        level = kept(level.join(sizes, ["band", "bucket"]))
        small = level.where(F.col("n") <= PAIRED).select("band", "bucket", "class")
        other = small.withColumnRenamed("class", "b")
        found.append(small.withColumnRenamed("class", "a").join(other, ["band", "bucket"]).where("a < b").select("a", "b"))
        large = level.where(F.col("n") > PAIRED)
        found.append(large.where(F.col("first") < F.col("class")).select(F.col("first").alias("a"), F.col("class").alias("b")))
        if split < SPLITS:
            finer = F.xxhash64("bucket", F.get("bands", F.pmod(F.col("band") + split + 1, F.lit(BANDS))))
            level = large.select("class", "bands", "band", finer.alias("bucket"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _length(n: Column, similarity: float) -> Column:
    """How many of n shingles, in whatever order, one at least of which is in each set so similar."""
    return (n - F.ceil(n * similarity - SLACK) + 1).cast("int")


def _few(rows: DataFrame, words: Column | None = None) -> bool:
    """Whether the rows, of so many words each, can be sent to all tasks."""
    return (rows.agg(F.sum(F.lit(4) if words is None else words)).first()[0] or 0) <= FEW


def _picked(signs: DataFrame, rows: DataFrame, how: str = "inner", words: Column | None = None) -> DataFrame:
    """signs joined to rows (a checkpoint): sets are read anew at each use, or moved and kept once where rows are many."""
    return signs.join(F.broadcast(rows), "row", how) if _few(rows, words) else kept(signs.join(rows, "row", how))


def _heads(signs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """row, n, head: the prefixes of the rows in reps."""
    n = F.size("hashes")
    of = lambda hashes: F.slice(hashes, 1, _length(n, similarity)).alias("head")
    among = lambda roots, often: roots.join(F.broadcast(often) if _few(often) else often, "shingle", "left_semi")
    heads = _picked(signs.where("class is not null").select("row", n.alias("n"), of("hashes")), reps, "left_semi")
    roots = heads.select("row", F.explode_outer("head").alias("shingle"))  # outer: no filter that computes the array again
    sets = signs.select("row", "hashes")
    # shingles that many prefixes have, and many of what then moves up in their place, and so on
    often, parts, reach = None, roots, heads.select("row", F.size("head").alias("reach"))
    for _ in range(ROUNDS):
        new = parts.groupBy("shingle").agg(F.count("*").alias("often")).where(F.col("often") > OFTEN)
        often = kept(often.union(new).groupBy("shingle").agg(F.sum("often").alias("often")) if often else new)
        more = among(parts, often.select("shingle")).groupBy("row").agg(F.count("*").cast("int").alias("more"))
        reach = kept(reach.select("row", "reach").join(more, "row").select("row", F.col("reach").alias("from"), "more", (F.col("reach") + F.col("more")).alias("reach")))
        if reach.isEmpty():
            break
        parts = sets.join(F.broadcast(reach) if _few(reach) else reach, "row")
        parts = kept(parts.select("row", F.explode(F.slice("hashes", F.col("from") + 1, F.col("more"))).alias("shingle")))
    # all sets whose prefix that changes
    moved = kept(among(roots, often.select("shingle")).select("row").distinct())
    whole = _picked(sets, moved, "left_semi")
    last = whole.select("row", F.explode_outer("hashes").alias("shingle")).join(F.broadcast(often) if _few(often) else often, "shingle")
    last = last.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("last"))
    last = kept(last.select("row", F.col("last.shingle").alias("last")))
    late = _picked(whole, last, words=F.size("last") + 4).select("row", n.alias("n"), of(F.concat(F.array_except("hashes", "last"), "last")))
    return heads.join(F.broadcast(moved) if _few(moved) else moved, "row", "left_anti").union(late)


def partners(signs: DataFrame, reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b (a before b): all pairs of rows in reps that may be so similar, each once."""
    index = _heads(signs, reps, similarity).select("row", "n", F.posexplode_outer("head").alias("place", "shingle"))
    side = lambda c: index.select("shingle", F.col("row").alias(c), F.col("n").alias(f"n_{c}"), (F.col("n") - F.col("place")).alias(f"rest_{c}"))
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - SLACK)
    pairs = side("a").join(side("b"), "shingle").where(F.col("a") < F.col("b"))
    # from the first shingle that both have on they share no more than the rest of the smaller one
    return pairs.where(F.least("rest_a", "rest_b") >= needed).select("a", "b").distinct()


def _centred(sets: DataFrame) -> DataFrame:
    """row, centre, size of the centre's set, less and more than it; of rows that differ from a centre in less than they have."""
    met = candidates(kept(banded(sets))).groupBy(F.col("b").alias("row")).agg(F.min("a").alias("centre"))
    rows = sets.select("row", "hashes").join(met, "row", "left").withColumn("centre", F.coalesce("centre", "row"))
    rows = rows.join(sets.select(F.col("row").alias("centre"), F.col("hashes").alias("c")), "centre")
    less, more = F.array_except("c", "hashes"), F.array_except("hashes", "c")
    rows = rows.select("row", "centre", F.size("c").alias("size"), F.size("hashes").alias("n"), less.alias("less"), more.alias("more"))
    return rows.where(F.size("less") + F.size("more") < F.col("n")).drop("n")


def _parities(sets: DataFrame) -> DataFrame:
    """row, parity: whether an odd number of its shingles falls into each of 64 * CELLS cells. Two sets differ in as many shingles at least as in cells."""
    rows = sets.select("row", F.explode_outer("hashes").alias("x"))
    word, bit = F.shiftright("x", 6).bitwiseAND(F.lit(CELLS - 1)), F.expr("shiftleft(1L, cast(x & 63 as int))")
    return rows.groupBy("row").agg(F.array(*[F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0).cast("long")) for k in range(CELLS)]).alias("parity"))


def links(signs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, similarity of all classes whose sets are at least so similar."""
    reps = kept(signs.where("class is not null").groupBy("class").agg(F.min("row").alias("row")))
    pairs = kept(partners(signs, reps.select("row"), similarity))
    used = kept(pairs.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count("*").alias("partners")))
    sets = _picked(signs.select("row", "class", "hashes"), used)
    centred = kept(_centred(sets.where(F.col("partners") > PAIRED)))

    def both(pairs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
        for c in ("a", "b"):
            pairs = pairs.join(rows.select(F.col("row").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in rows.columns if x != "row"]), c, how)
        return pairs

    parts = int(signs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are small rows, but much work
    of = both(pairs, sets.select("row", F.size("hashes").alias("n")).join(centred.select("row", "centre"), "row", "left"))
    of = kept(of.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), F.coalesce(F.col("centre_a") == F.col("centre_b"), F.lit(False)).alias("one")).repartition(parts, "a", "b"))
    common = lambda x: F.size(F.array_intersect(f"{x}_a", f"{x}_b"))
    near = both(of.where("one"), centred.drop("centre"))
    near = near.select("a", "b", "n", (F.col("size_a") - F.size("less_a") - F.size("less_b") + common("less") + common("more")).alias("shared"))
    differ = sum((F.bit_count(F.get("parity_a", F.lit(k)).bitwiseXOR(F.get("parity_b", F.lit(k)))) for k in range(CELLS)), F.lit(0))
    may = differ <= F.col("n") - 2 * F.ceil(F.col("n") * (similarity / (1 + similarity)) - SLACK)
    far = kept(both(of.where("not one"), kept(_parities(sets))).where(may).select("a", "b", "n").repartition(parts, "a", "b"))
    wanted = kept(far.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    far = both(far, _picked(signs.select("row", "hashes"), wanted, "left_semi")).select("a", "b", "n", common("hashes").alias("shared"))
    share = F.col("shared") / (F.col("n") - F.col("shared"))
    found = near.union(far).select("a", "b", share.alias("similarity")).where(F.col("similarity") >= similarity)
    return both(found, sets.select("row", "class")).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "similarity")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """key, n_shingles, n_links (of its class to other classes), copies (rows of its group), first (the group's smallest key)."""
    signs = kept(signed(docs, key, text, words))
    found = kept(links(signs, similarity))
    group = connected(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    classes = signs.where("class is not null").groupBy("class").agg(F.count("*").alias("rows"), F.min("key").alias("least"))
    classes = classes.join(group.withColumnRenamed("id", "class"), "class", "left").join(degree, "class", "left")
    classes = classes.withColumn("component", F.coalesce("component", "class"))
    groups = classes.groupBy("component").agg(F.sum("rows").alias("copies"), F.min("least").alias("first"))
    classes = classes.join(groups, "component").select("class", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies", "first")
    out = signs.select("key", "class", F.size("hashes").cast("long").alias("n_shingles")).join(classes, "class", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("first", "key").alias("first"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows without those that have a near copy with a smaller key. Rows that repeat a key and its set all stay; exact_copies finds them."""
    drop = near_copies(docs, key, text, words, similarity).where(F.col(key) > F.col("first")).select(key).distinct()
    return docs.join(drop, key, "left_anti")
