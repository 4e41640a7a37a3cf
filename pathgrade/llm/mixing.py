"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame operations only.

1. Sizes (words) are summed by source; targets follow by filling up to the caps (``most`` times a source's size).
2. Each source's documents are dealt by hash into blocks of about ``block_words`` words. A source's quota is the blocks,
   in their permuted order and over as many passes as needed, that make up its target.
3. The quotas of all sources are split over 2**levels output shards by a tree: at each node half of the node's blocks
   go left, and how many of them each source gives is drawn from the multivariate hypergeometric distribution, source
   after source. A shard takes the next blocks of each source's permuted order: no block is drawn twice in a pass.
4. Within a shard, documents are in the order of a hash (``place``).

All draws are functions of a seed and of the rows' values, so reruns agree. The last block of a source is drawn in
part: the last document's first words (``whole_documents``: the whole document or none of it, whichever comes nearer).

Null texts have size 0 and are never taken; a null source is a source, the last one. Repeated rows are documents of
their own: equal rows (doc_id, source, text) are counted and numbered, and the numbers spread them over the blocks. Only
``mixture`` with repeats, whose other columns may differ, numbers those of one hash in one task. An empty table gives no
rows. Sources are held in one array at each node of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, join_dimension, materialize, packed_rows, unpacked_rows

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 4096
#: Blocks whose sizes one task adds up.
GROUP_BLOCKS = 1024
LEVELS = 4
SEED = 20_011


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows, with their size and their hash; only whole repeats of doc_id and text share a hash."""
    size = words_of(F.col("text"))
    return docs.withColumn("__size", size).withColumn("__hash", F.xxhash64(F.lit(seed), "doc_id", "text"))


def numbered(narrow: DataFrame) -> DataFrame:
    """Rows (doc_id, source, __size, __hash) with __nth, the number of a repeat: equal rows are counted and made anew, so
    that however many there are no task gathers them."""
    counted = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("__n"))
    return counted.select(*narrow.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__nth"))


def spread() -> Column:
    """A row's own hash: repeats go to blocks of their own."""
    return F.when(F.col("__nth") == 0, F.col("__hash")).otherwise(F.xxhash64("__hash", "__nth"))


def _log_factorial(x: str) -> str:
    """ln x! for x >= 0: Stirling's series at x + 8."""
    y = f"({x} + 8D)"
    series = f"({y} * ln({y}) - {y} + 0.5D * ln(6.283185307179586D * {y}) + 1D / (12D * {y}) - 1D / (360D * {y} * {y} * {y}))"
    return f"({series} - ln({' * '.join(f'({x} + {k}D)' for k in range(1, 9))}))"


def _let(bindings: str, name: str, body: str) -> str:
    return f"element_at(transform(array({bindings}), {name} -> {body}), 1)"


def _hypergeometric(good: str, total: str, draws: str, u: str) -> str:
    """SQL for a hypergeometric number by the inverse of its distribution function; 12 deviations are enough for a double."""
    first = (
        f"named_struct('good', {good}, 'all', {total}, 'taken', {draws}, 'u', {u}, "
        f"'lo', greatest(0L, {draws} - ({total} - {good})), 'hi', least({draws}, {good}), "
        f"'m', {draws} * 1D * {good} / greatest({total}, 1L))"
    )
    spread = "12D * sqrt(p.m * (1D - p.good / greatest(p.all, 1L)) + 1D) + 8D"
    second = f"named_struct('p', p, 'a', greatest(p.lo, cast(floor(p.m - {spread}) as bigint)), 'b', least(p.hi, cast(ceil(p.m + {spread}) as bigint)), 'c', least(p.hi, greatest(p.lo, cast(floor(p.m) as bigint))))"
    log_weight = lambda k: "-(" + " + ".join(_log_factorial(f"cast({x} as double)") for x in (k, f"(q.p.good - {k})", f"(q.p.taken - {k})", f"(q.p.all - q.p.good - q.p.taken + {k})")) + ")"
    weights = f"transform(sequence(q.a, q.b), k -> exp({log_weight('k')} - ({log_weight('q.c')})))"
    third = f"named_struct('q', q, 'w', {weights})"
    total_w = "aggregate(r.w, 0D, (s, x) -> s + x)"
    fourth = f"named_struct('r', r, 't', r.q.p.u * {total_w})"
    pick = "aggregate(v.r.w, named_struct('c', 0D, 'i', 0), (s, x) -> named_struct('c', s.c + x, 'i', s.i + if(s.c + x <= v.t, 1, 0))).i"
    value = f"least(v.r.q.b, v.r.q.a + {pick})"
    return _let(first, "p", _let(second, "q", _let(third, "r", _let(fourth, "v", value))))


def split_quotas(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """source_no, quota -> shard, source_no, quota: the tree. Shards' sums differ by one block at most at each level."""
    item = "struct<source_no:bigint,quota:bigint>"
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("source_no").cast("long").alias("source_no"), F.col("quota").cast("long").alias("quota")))).alias("own"))
    node = node.withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        u = f"(cast(xxhash64({seed}, {level}, node, x.source_no) & 9007199254740991L as double) / 9007199254740992D)"
        draw = _hypergeometric("x.quota", "s.rest", "s.left", u)
        step = _let(
            f"named_struct('k', {draw}, 's', s, 'x', x)",
            "d",
            "named_struct('left', d.s.left - d.k, 'rest', d.s.rest - d.x.quota, 'out', concat(d.s.out, array(named_struct('source_no', d.x.source_no, 'quota', d.k))))",
        )
        total = "aggregate(own, 0L, (s, x) -> s + x.quota)"
        start = f"named_struct('left', {total} div 2, 'rest', {total}, 'out', cast(array() as array<{item}>))"
        node = node.withColumn("low", F.expr(f"aggregate(own, {start}, (s, x) -> {step}, s -> s.out)"))
        node = node.withColumn("high", F.expr("zip_with(own, low, (x, y) -> named_struct('source_no', x.source_no, 'quota', x.quota - y.quota))"))
        both = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("low").alias("own")), F.struct((F.col("node") * 2 + 1).alias("node"), F.col("high").alias("own"))))
        node = node.select(both.alias("z")).select("z.node", "z.own")
    return node.select(F.col("node").alias("shard"), F.explode("own").alias("x")).select("shard", "x.source_no", "x.quota")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, words -> with source_no, weight, target. Windows over a row for each source."""
    ranked = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("full", F.col("words") * float(most) / F.col("weight"))
    order = Window.orderBy("full", "source_no")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    caps = F.coalesce(F.sum(F.col("words") * float(most)).over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("words").over(everything) * share - caps) / left
    filled = ranked.withColumn("level", level).withColumn("at", F.row_number().over(order))
    final = F.min(F.when(F.col("full") >= F.col("level"), F.struct("at", "level"))).over(everything)["level"]
    target = F.least(F.col("words") * float(most), F.coalesce(final, F.lit(0.0)) * F.col("weight"))
    return filled.withColumn("target", target).select("source", "source_no", "words", "target")


def plan(sized: DataFrame, block_words: int = BLOCK_WORDS, levels: int = LEVELS, seed: int = SEED, **options) -> tuple[DataFrame, DataFrame]:
    """The sources (what they give, how their draws fall on shards) and the blocks (which words of them are drawn)."""
    sources = sized.groupBy("source").agg(F.sum("__size").alias("words"))
    sources = targets(sources, **options)
    take = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.floor(F.col("words") * options.get("most", MOST)).cast("long"))
    sources = sources.withColumn("passes", F.when(F.col("words") > 0, F.floor(take / F.col("words"))).otherwise(0).cast("long"))
    sources = sources.withColumn("part", take - F.col("passes") * F.col("words")).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)).cast("long"))
    sources = materialize(sources, "mix-sources")
    rows = join_dimension(sized.where("__size > 0").select("source", "__size", spread().alias("__own")), sources.select("source", "source_no", "n_blocks", "part"), ["source"])
    blocks = rows.groupBy("source", "source_no", F.pmod("__own", "n_blocks").alias("block")).agg(F.sum("__size").alias("block_words"), F.first("part").alias("part"))
    # prefix sums over a source's blocks, in groups of blocks so that no task gets a whole source
    blocks = blocks.withColumn("grp", F.floor(F.col("block") / GROUP_BLOCKS))
    blocks = materialize(blocks, "mix-blocks")
    groups = blocks.groupBy("source", "grp").agg(F.sum("block_words").alias("gw"), F.count("*").alias("gn"))
    over = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source", "grp", F.coalesce(F.sum("gw").over(over), F.lit(0)).alias("w0"), F.coalesce(F.sum("gn").over(over), F.lit(0)).alias("n0"))
    own = Window.partitionBy("source", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        join_dimension(blocks, groups, ["source", "grp"])
        .withColumn("before", F.col("w0") + F.coalesce(F.sum("block_words").over(own), F.lit(0)))
        .withColumn("position", F.col("n0") + F.coalesce(F.count("block").over(own), F.lit(0)))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("block_words"), F.col("part") - F.col("before"))))
        .select("source", "source_no", "block", "position", "part")
    )
    blocks = materialize(blocks, "mix-drawn")
    counted = blocks.groupBy("source").agg(F.count("*").alias("live"), F.sum((F.col("part") > 0).cast("long")).alias("parts"))
    sources = join_dimension(sources, counted, ["source"], "left").fillna(0, ["live", "parts"])
    sources = materialize(sources.withColumn("quota", F.col("passes") * F.col("live") + F.col("parts")), "mix-quotas")
    shards = split_quotas(sources.select("source_no", "quota"), levels, seed)
    # a source's draws fall on shards in turn: where each shard's run of them ends
    run = Window.partitionBy("source_no").orderBy("shard")
    ends = shards.withColumn("end", F.sum("quota").over(run)).groupBy("source_no").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    sources = materialize(join_dimension(sources, ends, ["source_no"], "left"), "mix-plan")
    return sources, blocks


def draw(sized: DataFrame, sources: DataFrame, blocks: DataFrame, whole_documents: bool = False, seed: int = SEED) -> DataFrame:
    """The rows with __source_size, __target and __draws: copy, shard, words, place for each time the mix takes one."""
    dim = sources.select("source", F.col("source_no").alias("__no"), F.col("words").alias("__source_size"), F.col("target").alias("__target"), F.col("parts").alias("__parts"), F.col("n_blocks").alias("__n"), F.col("live").alias("__live"), F.col("ends").alias("__ends"))
    none = sized.where("__size = 0")
    rows = join_dimension(sized.where("__size > 0").withColumn("__own", spread()), dim, ["source"]).withColumn("__block", F.pmod("__own", "__n"))
    # the blocks' key is the window's too, and never null: rows are shuffled once
    at = blocks.select(F.col("source_no").alias("__no"), F.col("block").alias("__block"), F.col("position").alias("__position"), F.col("part").alias("__part"))
    rows = rows.join(at, ["__no", "__block"], "left")
    own = Window.partitionBy("__no", "__block").orderBy("__own", "doc_id", "__size")
    before = F.coalesce(F.sum("__size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__before", before)
    some = F.greatest(F.lit(0), F.least(F.col("__size"), F.coalesce("__part", F.lit(0)) - F.col("__before")))
    if whole_documents:
        some = F.when(some * 2 >= F.col("__size"), F.col("__size")).otherwise(0)
    rows = rows.withColumn("__some", some.cast("long"))
    place = lambda copy: F.xxhash64(F.lit(seed + 1), "doc_id", "__own", copy)
    # a block's draws are those of its turns (pass, place) that a shard's run of the source's turns covers
    drawn = F.coalesce(F.element_at("__ends", -1), F.lit(0))
    passes = F.floor((drawn - 1 - F.col("__position")) / F.greatest(F.col("__live"), F.lit(1)))  # of the block's last draw; -1: none
    whole = F.floor((drawn - F.col("__parts")) / F.greatest(F.col("__live"), F.lit(1)))  # passes before the last, which takes parts
    turns = F.when(F.col("__position").isNotNull() & (passes >= 0), F.sequence(F.lit(0).cast("long"), passes)).otherwise(F.array().cast("array<bigint>"))
    draws = F.transform(
        turns,
        lambda c: F.struct(
            c.cast("int").alias("copy"),
            F.size(F.filter("__ends", lambda e: e <= c * F.col("__live") + F.col("__position"))).alias("shard"),
            F.when(c < whole, F.col("__size")).otherwise(F.col("__some")).alias("words"),
            place(c).alias("place"),
        ),
    )
    rows = rows.withColumn("__draws", F.filter(draws, lambda d: d["words"] > 0))
    rows = rows.drop("__parts", "__no", "__n", "__live", "__ends", "__block", "__position", "__part", "__before", "__some", "__own")
    # rows without words are in no block
    none = join_dimension(none, dim.select("source", "__source_size", "__target"), ["source"])
    return rows.unionByName(none.withColumn("__draws", F.array().cast(dict(rows.dtypes)["__draws"])))


def _told_apart(sized: DataFrame, narrow: DataFrame) -> DataFrame:
    """The whole rows with __nth. Where no two are equal none is moved; else those that are repeats are numbered by a window, each hash by itself."""
    twice = narrow.groupBy("doc_id", "source", "__hash").agg(F.count("*").alias("__k")).where("__k > 1").select("__hash").distinct()
    twice = materialize(twice, "mix-twice")
    if twice.isEmpty():
        return sized.withColumn("__nth", F.lit(0).cast("long"))
    own = Window.partitionBy("doc_id", "source", "__hash").orderBy(F.xxhash64(ROW))
    again = join_dimension(sized, twice, ["__hash"], "left_semi").withColumn("__nth", (F.row_number().over(own) - 1).cast("long"))
    return join_dimension(sized, twice, ["__hash"], "left_anti").withColumn("__nth", F.lit(0).cast("long")).unionByName(again)


def mixture(docs: DataFrame, whole_documents: bool = False, labels: bool = True, **options) -> DataFrame:
    """A row for each draw: the document's columns and, with ``labels``, __copy, __shard, __words, __place. Shard after shard, each in the order of its places.

    The rows are dealt by ranges of shard and place, so a large shard is cut over tasks.
    """
    whole, names = packed_rows(docs)
    sized = with_sizes(docs.select(whole, "doc_id", "source", "text")).drop("text")
    narrow = materialize(sized.select("doc_id", "source", "__size", "__hash"), "mix-sizes")
    sources, blocks = plan(numbered(narrow), **options)
    sized = _told_apart(sized, narrow)
    rows = draw(sized, sources, blocks, whole_documents).select(ROW, F.explode("__draws").alias("__d"))
    order = ["__d.shard", "__d.place"]
    more = [F.col("__d")[c].alias(f"__{c}") for c in ("copy", "shard", "words", "place")] if labels else []
    return unpacked_rows(rows.repartitionByRange(*order).sortWithinPartitions(*order), names, *more)


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the draws' shards."""
    narrow = materialize(numbered(with_sizes(docs.select("doc_id", "text", "source")).drop("text")), "mix-sizes")
    sources, blocks = plan(narrow, **options)
    rows = draw(narrow, sources, blocks)
    total = F.aggregate("__draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), total.alias("taken"), F.col("__draws.shard").alias("shards"))
