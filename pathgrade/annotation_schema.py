"""The layered annotation record as a JSON schema. Names of fields, choices, bounds and patterns of the format."""

from __future__ import annotations

from . import constants as K

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
AGENT_ROLES = ("orchestrator", "health_agent", "privacy_gate_agent", "calendar_action_agent")


def _record(required: dict, optional: dict | None = None) -> dict:
    """An object of these fields and no others."""
    return {"type": "object", "required": list(required), "additionalProperties": False, "properties": required | (optional or {})}


def _one_of(*names: str) -> dict:
    return {"type": "string", "enum": list(names)}


YES_NO, TEXT, LIKERT = {"type": "boolean"}, {"type": "string"}, {"type": "integer", "minimum": 1, "maximum": 5}

SESSION = _record(
    {
        "overall_goal_achieved": YES_NO,
        "session_outcome": _one_of("success", "partial_success", "failure"),
        "privacy_compliance_overall": _one_of("compliant", "minor_violation", "major_violation"),
        "user_trust_maintained": YES_NO,
        "latency_acceptable": YES_NO,
    }
)
ROLE = _record(
    {"agent_id": TEXT, "agent_role": _one_of(*AGENT_ROLES), "delegation_quality": LIKERT, "authority_appropriate": YES_NO, "accountability_clear": YES_NO},
    {"handoff_quality": LIKERT},
) | {
    "if": {"properties": {"agent_role": {"const": "orchestrator"}}, "required": ["agent_role"]},
    "then": {"required": ["handoff_quality"]},
    "else": {"properties": {"handoff_quality": False}},
}
STEP = _record(
    {
        "step_id": {"type": "string", "pattern": f"^{UUID}_[0-9]+$"},
        "tool_called": _one_of(*K.ACTIONS, ""),
        "tool_call_privacy_compliant": YES_NO,
        "action_correct_for_context": _one_of("correct", "acceptable", "incorrect"),
        "ambiguity_handled_well": YES_NO,
        "error_recovery_quality": _one_of("not_applicable", "poor", "adequate", "excellent"),
        "process_reward_score": {"type": "number", "minimum": -1.0, "maximum": 1.0},
        "partial_credit": {"type": "number", "minimum": 0.0, "maximum": 1.0},
        "annotator_rationale": {"type": "string", "minLength": 20},
    }
)


def annotation(ref: str) -> dict:
    """``ref``: what schema_ref must be."""
    return _record(
        {
            "schema_ref": {"type": "string", "const": ref},
            "annotation_id": {"type": "string", "pattern": f"^{UUID}$"},
            "trajectory_id": {"type": "string", "pattern": f"^{UUID}$"},
            "annotator_id": TEXT,
            "session": SESSION,
            "roles": {"type": "array", "minItems": 1, "items": ROLE},
            "steps": {"type": "array", "minItems": 1, "items": STEP},
        },
        {"created_at": {"type": "string", "format": "date-time"}},
    )
