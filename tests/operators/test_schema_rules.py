import copy
import json

import pytest

from pathgrade.annotation_schema import annotation
from pathgrade.operators import schema_rules as S

REF = "records-v1"
ID = "550e8400-e29b-4d4f-a716-446655440000"
GOOD = {
    "schema_ref": REF,
    "annotation_id": ID,
    "trajectory_id": ID,
    "annotator_id": "a1",
    "created_at": "2026-04-13T10:00:00Z",
    "session": {"overall_goal_achieved": True, "session_outcome": "success", "privacy_compliance_overall": "compliant", "user_trust_maintained": True, "latency_acceptable": False},
    "roles": [
        {"agent_id": "o", "agent_role": "orchestrator", "delegation_quality": 5, "authority_appropriate": True, "handoff_quality": 4, "accountability_clear": False},
        {"agent_id": "h", "agent_role": "health_agent", "delegation_quality": 1, "authority_appropriate": True, "accountability_clear": True},
    ],
    "steps": [
        {
            "step_id": f"{ID}_0", "tool_called": "", "tool_call_privacy_compliant": True, "action_correct_for_context": "correct", "ambiguity_handled_well": True,
            "error_recovery_quality": "not_applicable", "process_reward_score": -1, "partial_credit": 1.0, "annotator_rationale": "long enough to say why it is so",
        }
    ],
}


def changed(*path, to=None, drop=False):
    out = copy.deepcopy(GOOD)
    at = out
    for p in path[:-1]:
        at = at[p]
    if drop:
        del at[path[-1]]
    else:
        at[path[-1]] = to
    return out


#: Record -> what is wrong with it.
CASES = [
    (GOOD, []),
    (changed("schema_ref", to="v2"), [("$.schema_ref", "const")]),
    (changed("annotation_id", to="A" + ID[1:]), [("$.annotation_id", "pattern")]),
    (changed("trajectory_id", drop=True), [("$.trajectory_id", "required")]),
    (changed("created_at", drop=True), []),
    (changed("created_at", to="yesterday"), [("$.created_at", "format")]),
    (changed("extra", to=1), [("$.extra", "additionalProperties")]),
    (changed("annotator_id", to=None), [("$.annotator_id", "type")]),
    (changed("session", "latency_acceptable", to="yes"), [("$.session.latency_acceptable", "type")]),
    (changed("session", "session_outcome", to="great"), [("$.session.session_outcome", "enum")]),
    (changed("session", "session_outcome", to=3), [("$.session.session_outcome", "enum"), ("$.session.session_outcome", "type")]),
    (changed("session", "mood", to={}), [("$.session.mood", "additionalProperties")]),
    (changed("session", to=[]), [("$.session", "type")]),
    (changed("roles", to=[]), [("$.roles", "minItems")]),
    (changed("roles", 0, "handoff_quality", drop=True), [("$.roles[0].handoff_quality", "required")]),
    (changed("roles", 1, "handoff_quality", to=3), [("$.roles[1].handoff_quality", "forbidden")]),
    (changed("roles", 1, "delegation_quality", to=6), [("$.roles[1].delegation_quality", "maximum")]),
    (changed("roles", 1, "delegation_quality", to=2.5), [("$.roles[1].delegation_quality", "type")]),
    (changed("roles", 1, "delegation_quality", to=2.0), []),
    (changed("roles", 0, "agent_role", to="boss"), [("$.roles[0].agent_role", "enum"), ("$.roles[0].handoff_quality", "forbidden")]),
    (changed("roles", 0, "agent_role", drop=True), [("$.roles[0].agent_role", "required"), ("$.roles[0].handoff_quality", "forbidden")]),
    (changed("roles", 1, to=None), [("$.roles[1]", "type")]),
    (changed("steps", 0, "step_id", to=f"{ID}_x"), [("$.steps[0].step_id", "pattern")]),
    (changed("steps", 0, "tool_called", to="dance"), [("$.steps[0].tool_called", "enum")]),
    (changed("steps", 0, "process_reward_score", to=-1.01), [("$.steps[0].process_reward_score", "minimum")]),
    (changed("steps", 0, "partial_credit", to=1.5), [("$.steps[0].partial_credit", "maximum")]),
    (changed("steps", 0, "annotator_rationale", to="too short"), [("$.steps[0].annotator_rationale", "minLength")]),
    ([], [("$", "type")]),
]


def found(spark, schema, records):
    rows = spark.createDataFrame([(k, r if isinstance(r, str) or r is None else json.dumps(r)) for k, r in enumerate(records)], "id int, record string").repartition(2)
    return {r.id: [(v.path, v.rule) for v in r.violations] for r in S.checked(rows, schema).collect()}


def test_annotation_records(spark):
    got = found(spark, annotation(REF), [r for r, _ in CASES] + ["{broken", None, "7"])
    for k, (_, expected) in enumerate(CASES):
        assert got[k] == sorted(expected), (k, got[k])
    n = len(CASES)
    assert got[n] == got[n + 1] == [("$", "json")] and got[n + 2] == [("$", "type")]


def test_every_rule(spark):
    """(schema, valid values, values that break the rule): rules hold for values of their type."""
    rules = [
        ({"type": ["string", "null"]}, ["a", None], [1, {}, [], True]),
        ({"type": "number"}, [1, 2.5, 1e30], ["1", None, True]),
        ({"enum": ["a", 1, None, True]}, ["a", 1, 1.0, None, True], ["b", 2, False, [], {}]),
        ({"const": False}, [False], [True, 0, "false"]),
        ({"minLength": 2, "maxLength": 3}, ["ab", "äöü", 1], ["a", "abcd"]),
        ({"pattern": "b+"}, ["abba", 3], ["a", ""]),
        ({"exclusiveMinimum": 0, "exclusiveMaximum": 1}, [0.5, "x"], [0, 1, -1]),
        ({"multipleOf": 0.5}, [1, 1.5, -2], [0.7]),
        ({"minItems": 1, "maxItems": 2, "items": {"type": "integer"}}, [[1], [1, 2], {}], [[], [1, 2, 3], ["a"], [1.5]]),
        ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}, []], [{}, {"a": 1, "b": 2}]),
        ({"properties": {"a": {"type": "integer"}}, "additionalProperties": {"type": "string"}}, [{}, {"a": 1, "b": "x"}, 5], [{"a": "1"}, {"b": 1}]),
        ({"required": ["a"]}, [{"a": None}, {"a": 1}, 4], [{}, {"b": 1}]),
        ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [1, 3], [0, 4]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 7, []], [4]),
        ({"oneOf": [{"maximum": 3}, {"minimum": 2}]}, [1, 5], [2, 3]),
        ({"not": {"type": "string"}}, [1, None], ["a"]),
        ({"if": {"type": "integer"}, "then": {"minimum": 0}, "else": {"type": "string"}}, [3, "a"], [-1, [], 1.5]),
        ({"items": {"items": {"properties": {"a": False}}}}, [[[{}]], [[]]], [[[{"a": 1}]], [[{}], [{}, {"a": 0}]]]),
        (True, [1, None, {}], []),
    ]
    for schema, good, bad in rules:
        got = found(spark, schema, [json.dumps(x) for x in good + bad])
        assert [bool(got[k]) for k in range(len(good) + len(bad))] == [False] * len(good) + [True] * len(bad), (schema, got)


def test_what_is_not_done_is_an_error(spark):
    for schema in ({"$ref": "#/x"}, {"properties": {"a": {"uniqueItems": True}}}, {"items": [{}, {}]}):
        with pytest.raises(ValueError, match="not done"):
            found(spark, schema, ["{}"])


def test_counts_and_split(spark):
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(CASES)] + [(99, json.dumps(changed("roles", to=[{}, {}])))], "id int, record string")
    counts = {(r.path, r.rule): (r.n, r.records) for r in S.violation_counts(rows, annotation(REF)).collect()}
    assert counts["$.roles[].agent_id", "required"] == (2, 1) and counts["$.roles[].delegation_quality", "maximum"] == (1, 1)
    good, bad = S.split_valid(rows, annotation(REF))
    assert {r.id for r in good.collect()} == {k for k, (_, e) in enumerate(CASES) if not e} and bad.count() == len([1 for _, e in CASES if e]) + 1
    assert S.violations(rows, annotation(REF), ["id"]).where("id = 1").collect() == [(1, "$.schema_ref", "const")]


def test_a_value_is_looked_at_once(spark):
    """Each value's kind is found once, whatever its rules: once for each schema of a member, twice where lists are entered."""
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": ["integer", "null"], "minimum": 0, "maximum": 9, "enum": [1, 2, 3]}, "b": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": ["string", "number"], "minLength": 1}}}}
    rows = spark.createDataFrame([('{"a": 4, "b": ["", 2.5, null]}',), ('{"a": null}',), ('{"a": 2, "b": []}',)], "record string")
    out = S.checked(rows, schema)
    assert out._jdf.queryExecution().analyzed().toString().count("schema_of_variant(") == 4
    got = [sorted((v.path, v.rule) for v in r.violations) for r in out.collect()]
    assert got == [[("$.a", "enum"), ("$.b[0]", "minLength"), ("$.b[2]", "type")], [("$.a", "enum"), ("$.b", "required")], [("$.b", "minItems")]]
