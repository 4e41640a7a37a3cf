import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathgrade.llm import bpe, mixing, quality, registry, toxicity
from pathgrade.llm.common import materialize, table

from .test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_every_stage_against_its_input(spark):
    """Each stage's rows from what it was given: the operators' own verdicts for the models, plain Python for the rest."""
    docs = table(spark, SF, "documents")
    columns, inputs = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs.append(materialize(stage(spark, inputs[-1], SF), "test"))
        assert inputs[-1].columns == columns and inputs[-1].count() > 0, name
    rows = [[tuple(r) for r in df.collect()] for df in inputs]
    by = lambda k: {r[0]: r for r in rows[k]}
    assert len(by(0)) == len(rows[0])  # the table's ids are distinct
    verdict = {r.doc_id: r.predicted for r in toxicity.score(docs, table(spark, SF, "labels")).collect()}
    assert sorted(map(str, rows[1])) == sorted(str(r) for r in rows[0] if not verdict[r[0]])
    verdict = {r.doc_id: r.kept for r in quality.quality(inputs[1]).collect()}
    assert sorted(map(str, rows[2])) == sorted(str(r) for r in rows[1] if verdict[r[0]])
    groups = brute([(r[0], r[columns.index("text")]) for r in rows[2]], 80, 5)
    assert sorted(map(str, rows[3])) == sorted(str(by(2)[int(a)]) for a, _, b in groups if a == b)
    # whole documents, near their sources' shares, none more than twice
    at, source = columns.index("text"), columns.index("source")
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    drawn, size = Counter(r[0] for r in rows[4]), {r[0]: words(r[at]) for r in rows[3]}
    assert set(map(str, rows[4])) <= set(map(str, rows[3])) and max(drawn.values()) <= 2
    sizes = Counter()
    for r in rows[3]:
        sizes[r[source]] += size[r[0]]
    order = sorted(sizes, key=lambda x: (x is None, x))
    frame = spark.createDataFrame([(s, sizes[s]) for s in order], "source string, words long")
    target = {r.source: r.target for r in mixing.targets(frame).collect()}
    for s in order:
        took = sum(n * size[d] for d, n in drawn.items() if by(3)[d][source] == s)
        longest = max(size[d] for d in size if by(3)[d][source] == s)
        assert abs(took - target[s]) <= longest
    enc, sha = bpe.encoder(bpe.vocabulary_path()), lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in rows[4]:
        ids = enc.tok.encode(r[at] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(enc.tok.decode(ids, skip_special_tokens=False))))
    assert sorted(want) == sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, inputs[4], SF).collect())


NAMES = ["scale", "m0", "__w", "__size", "word", "__shard", "__kept", "component", "c0"]


@pytest.fixture(scope="module")
def awkward(spark, edges):
    """The edge rows, ids that stand on different texts, and columns of names that operators use, each with the row's own value."""
    more = spark.createDataFrame([(8, " ".join(f"{x}{i}" for i in range(90))) for x in "ab"], "doc_id long, text string")
    docs = edges.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more, allowMissingColumns=True)
    own = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("none"))))
    return materialize(docs.withColumns({n: F.concat(F.lit(n), own) for n in NAMES}), "test")


@pytest.mark.parametrize("k", range(5))
def test_stages_on_awkward_rows_and_on_none(spark, awkward, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, awkward, SF)
    nothing = awkward.where("false")
    assert stage(spark, nothing, SF).count() == 0
    if k == 4:
        assert out.count() == awkward.count()
        return
    assert out.columns == awkward.columns
    known = {str(tuple(r)) for r in awkward.collect()}
    rows = [str(tuple(r)) for r in out.collect()]
    assert set(rows) <= known
    if name == "n-gram Jaccard join":
        assert len(rows) == awkward.count() - 1  # the repeated row
    if name == "toxicity":
        assert len(rows) == awkward.count()  # no label of both kinds here
