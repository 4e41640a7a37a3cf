import math
import re
import struct

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pathgrade.llm import mixing


def fill(words, weights, share=1.5, most=2):
    """Reshare what is over the caps until nothing is."""
    total, capped, out = share * sum(words), set(), [0.0] * len(words)
    while True:
        free = [k for k in range(len(words)) if k not in capped]
        left = total - sum(most * words[k] for k in capped)
        for k in free:
            out[k] = left * weights[k] / sum(weights[j] for j in free)
        over = [k for k in free if out[k] > most * words[k] + 1e-12]
        if not over:
            return out
        for k in over:
            out[k] = most * words[k]
            capped.add(k)


def test_targets(spark):
    words = [10, 5000, 300, 0, 70, 900, 20]
    rows = spark.createDataFrame([(None if k == 6 else f"s{k}", w) for k, w in enumerate(words)], "source string, words long")
    got = [r.target for r in mixing.targets(rows).orderBy("source_no").collect()]
    want = fill(words, [(3, 1, 2)[k % 3] for k in range(7)])
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, want))


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 37), (3, 0), (4, 1)], "source_no long, quota long")
    rows = mixing.split_quotas(quotas, levels=3).collect()
    by_source, by_shard = {}, {}
    for r in rows:
        by_source[r.source_no] = by_source.get(r.source_no, 0) + r.quota
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.quota
    assert by_source == {1: 1000, 2: 37, 3: 0, 4: 1} and len(by_shard) == 8
    assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_hypergeometric_mean(spark):
    rows = spark.range(4000).selectExpr(f"{mixing._hypergeometric('30L', '100L', '40L', '(id + 0.5D) / 4000')} AS k").groupBy("k").count().collect()
    mean = sum(r.k * r["count"] for r in rows) / 4000
    assert abs(mean - 12) < 0.02 and min(r.k for r in rows) >= 0 and max(r.k for r in rows) <= 30


def test_taken(spark, edges):
    more = spark.range(200).selectExpr("id + 100 as doc_id", "repeat('w ', int(1 + id % 37)) as text", "'en' as lang", "concat('s', id % 4) as source", "0L as n_chars", "'' as size", "'' as score", "'' as n")
    docs = edges.unionByName(more)
    rows = mixing.taken(docs, block_words=64).collect()
    again = mixing.taken(docs.repartition(3), block_words=64).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == docs.count()
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    by = {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size
        by.setdefault(source[r.doc_id], [0, r.target])[0] += r.taken
    assert all(abs(t - target) <= 0.5 for t, target in by.values())
    assert abs(sum(t for t, _ in by.values()) - 1.5 * sum(r.size for r in rows)) <= len(by)


def test_whole_documents_and_nothing(spark, edges, nothing):
    rows = mixing.mixture(edges, whole_documents=True).collect()
    assert all(r["__words"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert mixing.taken(nothing).count() == 0


def test_mixture_is_in_shards_and_places(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', int(1 + id % 37)) as text", "concat('s', id % 4) as source")
    rows = mixing.mixture(docs, whole_documents=True, block_words=64).collect()
    order = [(r["__shard"], r["__place"]) for r in rows]
    assert order == sorted(order) and len({shard for shard, _ in order}) == 2**mixing.LEVELS
    # the pipeline's stage drops the labels and keeps the order
    stage = corpus_pipeline.materialize(corpus_pipeline.mix(spark, docs, ""), "test")
    whole = mixing.mixture(docs, whole_documents=True)
    file = F.input_file_name()
    at = {}
    for r in stage.select("doc_id", file.alias("file")).collect():
        at.setdefault(r.file, []).append(r.doc_id)
    want = [r.doc_id for r in whole.collect()]
    assert [x for f in sorted(at) for x in at[f]] == want


def hashed(*values):
    """Spark's xxhash64: values one after the other, ints by 4 bytes, ("long", x) by 8; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[1]) if isinstance(v, tuple) else struct.pack("<i", v)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def hypergeometric(good, total, draws, u):
    low, high = max(0, draws - (total - good)), min(draws, good)
    ways = [math.comb(good, k) * math.comb(total - good, draws - k) for k in range(low, high + 1)]
    at, k = u * sum(ways), low
    for w in ways:
        at -= w
        if at < 0:
            return k
        k += 1
    return high


def model(rows, block_words, levels=mixing.LEVELS, seed=mixing.SEED):
    """(doc_id, source, text) -> (doc_id, taken, shards) of each row: targets, blocks, the tree and the draws, one by one."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    words = [sum(n for (_, s, _), n in zip(rows, sizes) if s == name) for name in names]
    target = fill(words, [(3, 1, 2)[k % 3] for k in range(len(names))])
    seen, own = {}, []
    for doc_id, source, text in rows:
        nth = seen[doc_id, source, text] = seen.get((doc_id, source, text), -1) + 1
        h = hashed(seed, None if doc_id is None else ("long", doc_id), text)
        own.append(h if nth == 0 else hashed(("long", h), ("long", nth)))
    out, quota, plans = [None] * len(rows), [], []
    for k, name in enumerate(names):
        take = min(math.floor(target[k] + 0.5), 2 * words[k])
        passes = take // words[k] if words[k] else 0
        left, blocks = take - passes * words[k], {}
        for r in (r for r in range(len(rows)) if rows[r][1] == name and sizes[r]):
            blocks.setdefault(own[r] % max(1, -(-words[k] // block_words)), []).append(r)
        parts = 0
        for position, b in enumerate(sorted(blocks)):
            blocks[b].sort(key=lambda r: own[r])
            part = max(0, min(sum(sizes[r] for r in blocks[b]), left))
            left -= part
            parts += part > 0
            for r in blocks[b]:
                some = max(0, min(sizes[r], part))
                part -= some
                plans.append((r, k, position, passes, some, len(blocks)))
        quota.append(passes * len(blocks) + parts)
    nodes = {0: quota}
    for level in range(levels):
        below = {}
        for node, have in nodes.items():
            rest, left, low = sum(have), sum(have) // 2, []
            for k, q in enumerate(have):
                u = (hashed(seed, level, ("long", node), ("long", k + 1)) & ((1 << 53) - 1)) / (1 << 53)
                low.append(hypergeometric(q, rest, left, u))
                left, rest = left - low[-1], rest - q
            below[2 * node], below[2 * node + 1] = low, [q - x for q, x in zip(have, low)]
        nodes = below
    for r, k, position, passes, some, live in plans:
        ends = [sum(nodes[n][k] for n in range(m + 1)) for m in range(len(nodes))]
        turns = [(c * live + position, sizes[r] if c < passes else some) for c in range(passes + 1)]
        got = [(sum(e <= t for e in ends), n) for t, n in turns if n and t < ends[-1]]
        out[r] = (sum(n for _, n in got), [s for s, _ in got])
    return sorted((str(rows[r][0]), *(out[r] or (0, []))) for r in range(len(rows)))


def test_equals_a_model_row_by_row(spark):
    """Sources of many sizes, one null, one without words; rows that repeat, thousands of one of them."""
    rows = [(k, f"s{k % 5}", "w " * (1 + k * 7 % 90)) for k in range(300)] + [(k, None, "x y") for k in range(300, 330)]
    rows += [(400, "s1", "again and again")] * 1500 + [(None, "s2", "no id")] * 3 + [(500, "s9", None), (501, "s9", ""), (502, "s7", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = sorted((str(r.doc_id), r.taken, list(r.shards)) for r in mixing.taken(docs, block_words=64).collect())
    assert got == model(rows, 64)


def test_repeated_rows_are_spread(spark):
    """20,000 equal rows: no block is much larger than it should be."""
    rows = spark.range(20_000).selectExpr("7L as doc_id", "'a b c d' as text", "'s' as source")
    narrow = mixing.numbered(mixing.with_sizes(rows).drop("text"))
    blocks = mixing.plan(narrow, block_words=400)[1]
    assert blocks.count() == 200
    sizes = narrow.groupBy(F.pmod(mixing.spread(), F.lit(200))).count().agg(F.max("count")).first()[0]
    assert sizes < 200
    whole = mixing.mixture(rows.unionByName(spark.createDataFrame([(8, "z", "t")], "doc_id long, text string, source string")), whole_documents=True, block_words=400)
    assert abs(whole.where("doc_id = 7").count() - 1.5 * 20_000) < 300
