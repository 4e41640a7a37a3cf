from pyspark.sql import functions as F

from pathgrade.functions import answers as A

DIMS = ("step_quality", "privacy_compliance")
LONG = "because the step did what was asked of it"
#: Answer -> found, scores, rationale, error.
CASES = [
    ('{"step_quality": 3, "privacy_compliance": 9, "rationale": "%s"}' % LONG, "whole", (3, 4), LONG, None),
    (' \n{"privacy_compliance": "1"}\n', "whole", (2, 1), "." * 40, None),
    ('Sure:\n```json\n{"step_quality": "x", "rationale": " ok "}\n```', "block", (2, 2), "ok".ljust(40, "."), None),
    ('```\n{"step_quality": 2.9, "a": {"b": 1}}\n```', "block", (2, 2), "." * 40, None),
    ('I say {"step_quality": -3, "privacy_compliance": true} so', "braces", (1, 1), "." * 40, None),
    ('```{"broken": ```{"step_quality": 4}', "braces", (4, 2), "." * 40, None),
    ('{"step_quality": null, "privacy_compliance": [1], "rationale": null}', "whole", (2, 2), "None".ljust(40, "."), None),
    ('{"step_quality": "3.5", "privacy_compliance": " 4 ", "rationale": 7}', "whole", (2, 4), "7".ljust(40, "."), None),
    ('{"step_quality": "1_0", "privacy_compliance": false, "rationale": true}', "whole", (4, 1), "True".ljust(40, "."), None),
    ("[3]", "whole", (None, None), None, "not an object"),
    ("nothing here", None, (None, None), None, "no JSON object"),
    ("{not json}", None, (None, None), None, "no JSON object"),
    ("", None, (None, None), None, "no JSON object"),
    (None, None, (None, None), None, "no JSON object"),
]


def test_found_and_scored(spark):
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, text string")
    got = {r.k: r.s for r in rows.select("k", A.scored(F.col("text"), DIMS).alias("s")).collect()}
    for k, (text, found, scores, why, error) in enumerate(CASES):
        s = got[k]
        assert (s.found, (s.step_quality, s.privacy_compliance), s.rationale, s.error) == (found, scores, why, error), text


def test_rewards(spark):
    rows = spark.createDataFrame([(k, f'{{"r": {v}}}') for k, v in enumerate([*range(10), "0.25", "-1.0", '"3"', "null"])], "k int, text string")
    got = [r.x for r in rows.select("k", A.reward(F.try_parse_json("text"), "r").alias("x")).orderBy("k").collect()]
    assert got == [(v - 4) / 4 for v in range(9)] + [None, 0.25, -1.0, None, None]
    back = spark.range(9).select(A.reward_to_rating(A.rating_to_reward(F.col("id"))).alias("x"))
    assert sorted(r.x for r in back.collect()) == list(range(9))


def test_judged(spark):
    texts = ['{"a": 0.5, "b": 3}', '{"a": -1, "b": 0.2}', '{"a": 0.5}', '{"a": 0.5, "b": "x"}', "none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = [tuple(r.j) for r in rows.select("k", A.judged(F.try_parse_json("text"), ("a", "b"), 0.7).alias("j")).orderBy("k").collect()]
    assert got == [(0.5, 1.0, 0.75), (0.0, 0.2, 0.1), (0.7, 0.7, 0.7), (0.7, 0.7, 0.7), (0.7, 0.7, 0.7)]


def test_places(spark):
    from pathgrade.functions import text as T

    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0), (0.0, 0.0), (nan, 1.0), (1.0, inf), (91.0, 0.0), (0.0, -180.0), (None, 1.0)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, lat double, lon double").select("k", T.place_or(F.col("lat"), F.col("lon"), F.lit(7.0), F.lit(8.0)).alias("p")).orderBy("k").collect()
    assert [tuple(r.p) for r in got] == [(1.0, 2.0, True), (7.0, 8.0, False), (7.0, 8.0, False), (7.0, 8.0, False), (7.0, 8.0, False), (0.0, -180.0, True), (7.0, 8.0, False)]


def test_padding(spark):
    rows = spark.createDataFrame([("",), ("x" * 39,), ("x" * 40,), ("x" * 50,)], "t string")
    assert [r.p for r in rows.select(A.padded(F.col("t")).alias("p")).collect()] == ["." * 40, "x" * 39 + ".", "x" * 40, "x" * 50]
