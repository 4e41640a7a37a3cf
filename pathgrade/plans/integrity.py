"""Queries that check and clean records: near copies, whole schemas, answers of models, rows that fail, what comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..annotation_schema import annotation
from ..functions import answers
from ..functions import text as T
from ..operators import neardup, pairing, poisoning, policy, privacy, quarantine, schema_rules, trajectory
from . import views as V
from .catalog import _COMBINED, _LAYERED, _SUSPICION, INJECTED, LABELS, MSTEPS, MULTI, _compliant_sql, fleiss_sql, injected, names_sql, query, r9

# --- near copies -------------------------------------------------------------------------------------------------

_NEAR = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {neardup.WORDS} THEN [array_to_string(w, ' ')]
            ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {neardup.WORDS - 2}), lambda i: array_to_string(w[i:i + {neardup.WORDS - 1}], ' ')))) END AS g FROM d),
    k AS (SELECT min(r) AS c, g, count(*) AS n, min(doc_id) AS least FROM s WHERE len(g) > 0 GROUP BY g),
    e AS (SELECT c, len(g) AS size, unnest(g) AS x FROM k),
    l AS (SELECT p, q FROM (SELECT a.c AS p, b.c AS q, any_value(a.size) + any_value(b.size) AS sizes, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c) WHERE n / (sizes - n)::DOUBLE >= {neardup.SIMILARITY}),
    t AS (SELECT c AS p, c AS q FROM k UNION SELECT t.p, l.q FROM t JOIN l ON l.p = t.q),
    m AS (SELECT t.p AS c, min(k.least) AS first, sum(k.n)::BIGINT AS copies FROM t JOIN k ON k.c = t.q GROUP BY t.p),
    n AS (SELECT p AS c, count(*) AS n_links FROM l GROUP BY p)
    SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(n_links, 0) AS n_links, coalesce(copies, 1) AS copies, coalesce(first, doc_id) AS first FROM s LEFT JOIN k ON k.g = s.g LEFT JOIN m ON m.c = k.c LEFT JOIN n ON n.c = k.c"""


@query("near_copies", _NEAR)
def near_copies(spark, d):
    """Each document's group of near copies: five words, a similarity of 0.8."""
    return neardup.near_copies(V.read(spark, d, "documents"))


# --- whole records against their schema ----------------------------------------------------------------------------

REF = "records-v1"


def _uuid(hexes: Column, version: Column) -> Column:
    part = lambda a, n: F.substring(hexes, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), version, part(13, 3), F.lit("-8"), part(16, 3), F.lit("-"), part(19, 12))


def annotation_records(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, record: conversations as nested annotation records in JSON, one in several with something wrong."""
    c, n = F.col("conv_id"), F.length("text")
    turns = V.read(spark, d, "conversations").where("text is not null")
    role = F.when(F.col("role") == "assistant", "orchestrator").when(F.col("role") == "user", "health_agent").otherwise("privacy_gate_agent")
    handoff = F.when((F.col("role") == "assistant") & (n % 9 != 0), 1 + n % 3).when((F.col("role") != "assistant") & (n % 10 == 0), 2)
    ids = F.sha2(c.cast("string"), 256)
    agent = F.struct(
        F.concat(F.lit("agent-"), "turn").alias("agent_id"),
        role.alias("agent_role"),
        (1 + n % 6).alias("delegation_quality"),
        (n % 7 != 0).alias("authority_appropriate"),
        handoff.alias("handoff_quality"),
        (n % 11 == 0).alias("accountability_clear"),
        F.when(F.col("role") == "system", F.col("text")).alias("note"),
    )
    step = F.struct(
        F.concat(_uuid(ids, F.lit("4")), F.lit("_"), "turn").alias("step_id"),
        V.pick((*K.ACTIONS, "", "dance"), n % 10).alias("tool_called"),
        F.lit(True).alias("tool_call_privacy_compliant"),
        F.lit("correct").alias("action_correct_for_context"),
        (n % 2 == 0).alias("ambiguity_handled_well"),
        F.lit("adequate").alias("error_recovery_quality"),
        ((n % 25 - 12) / 10.0).alias("process_reward_score"),
        (n % 13 / 10.0).alias("partial_credit"),
        F.substring("text", 1, 200).alias("annotator_rationale"),
    )
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", agent.alias("agent"), step.alias("step")))).alias("x"))
    session = F.struct(
        (c % 3 == 0).alias("overall_goal_achieved"),
        V.pick(("success", "partial_success", "failure", "unclear"), F.size("x") % 4).alias("session_outcome"),
        F.lit("compliant").alias("privacy_compliance_overall"),
        F.when(c % 17 != 0, True).alias("user_trust_maintained"),
        F.lit(True).alias("latency_acceptable"),
    )
    record = F.struct(
        F.when(c % 5 == 0, "records-v0").otherwise(REF).alias("schema_ref"),
        _uuid(ids, F.when(c % 7 == 0, "1").otherwise("4")).alias("annotation_id"),
        _uuid(ids, F.lit("4")).alias("trajectory_id"),
        F.concat(F.lit("rater-"), c % 3).alias("annotator_id"),
        F.when(c % 13 != 0, F.when(c % 11 == 0, "soon").otherwise("2026-01-02T03:04:05Z")).alias("created_at"),
        session.alias("session"),
        F.col("x.agent").alias("roles"),
        F.col("x.step").alias("steps"),
    )
    return rows.select("conv_id", F.to_json(record).alias("record"))


_BROKEN = """f_turns AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE text IS NOT NULL),
    f_broken AS (SELECT conv_id, unnest([CASE WHEN conv_id % 5 = 0 THEN '$.schema_ref const' END, CASE WHEN conv_id % 7 = 0 THEN '$.annotation_id pattern' END, CASE WHEN conv_id % 11 = 0 AND conv_id % 13 <> 0 THEN '$.created_at format' END,
        CASE WHEN count(*) % 4 = 3 THEN '$.session.session_outcome enum' END, CASE WHEN conv_id % 17 = 0 THEN '$.session.user_trust_maintained required' END]) AS what FROM f_turns GROUP BY conv_id
      UNION ALL SELECT conv_id, unnest([CASE WHEN n % 6 = 5 THEN '$.roles[' || i || '].delegation_quality maximum' END, CASE WHEN role = 'assistant' AND n % 9 = 0 THEN '$.roles[' || i || '].handoff_quality required' END,
        CASE WHEN role <> 'assistant' AND n % 10 = 0 THEN '$.roles[' || i || '].handoff_quality forbidden' END, CASE WHEN role = 'system' THEN '$.roles[' || i || '].note additionalProperties' END,
        CASE WHEN n % 10 = 9 THEN '$.steps[' || i || '].tool_called enum' END, CASE WHEN n % 25 < 2 THEN '$.steps[' || i || '].process_reward_score minimum' END, CASE WHEN n % 25 > 22 THEN '$.steps[' || i || '].process_reward_score maximum' END,
        CASE WHEN n % 13 > 10 THEN '$.steps[' || i || '].partial_credit maximum' END, CASE WHEN n < 20 THEN '$.steps[' || i || '].annotator_rationale minLength' END]) FROM f_turns)"""


@query("annotation_violations", "SELECT conv_id, split_part(what, ' ', 1) AS path, split_part(what, ' ', 2) AS rule FROM f_broken WHERE what IS NOT NULL", (_BROKEN,))
def annotation_violations(spark, d):
    return schema_rules.violations(annotation_records(spark, d), annotation(REF), ["conv_id"])


@query(
    "violation_counts",
    "SELECT split_part(p, ' ', 1) AS path, split_part(p, ' ', 2) AS rule, count(*) AS n, count(DISTINCT conv_id) AS records FROM (SELECT conv_id, regexp_replace(what, '\\[\\d+\\]', '[]') AS p FROM f_broken WHERE what IS NOT NULL) GROUP BY p",
    (_BROKEN,),
)
def violation_counts(spark, d):
    return schema_rules.violation_counts(annotation_records(spark, d), annotation(REF))


# --- what models answer ------------------------------------------------------------------------------------------

#: An answer's JSON, and how it is told; of the last three one is cut off, one is a list, one has an object within.
_SAID = "trim(substring(regexp_replace(text, '[^A-Za-z ]', ''), 1, length(text) % 60))"
_JSON = f"""'{{"step_quality": ' || n % 7 || ', "privacy_compliance": "' || n % 5 || '", "goal_alignment": ' || n % 4 || '.5, "error_recovery": null, "rationale": " ' || {_SAID} || '"}}'"""


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, answer: assistants' turns as what a judging model might say about them."""
    rows = V.read(spark, d, "conversations").where("role = 'assistant' and text is not null").withColumn("n", F.length("text")).withColumn("json", F.expr(_JSON))
    json = F.col("json")
    told = [
        F.concat(F.lit("  "), json, F.lit("\n")),
        F.concat(F.lit("Sure:\n```json\n"), json, F.lit("\n```\nDone.")),
        F.concat(F.lit("I think "), json, F.lit(" is right.")),
        F.substring(json, 1, 30),
        F.lit("[1, 2]"),
        F.lit('So:\n```\n{"step_quality": 9, "x": {"y": 1}, "rationale": true}\n```'),
    ]
    return rows.select("conv_id", "turn", F.element_at(F.array(*told), F.col("n") % 6 + 1).alias("answer"))


_CUT = "greatest(1, least(4, {}))"


@query(
    "model_answers",
    f"""SELECT conv_id, turn, CASE k WHEN 0 THEN 'whole' WHEN 1 THEN 'block' WHEN 2 THEN 'braces' WHEN 4 THEN 'whole' WHEN 5 THEN 'block' END AS found,
          CASE WHEN k < 3 THEN {_CUT.format('n % 7')} WHEN k = 5 THEN 4 END::INTEGER AS step_quality, CASE WHEN k < 3 THEN {_CUT.format('n % 5')} WHEN k = 5 THEN 2 END::INTEGER AS privacy_compliance,
          CASE WHEN k < 3 THEN {_CUT.format('n % 4')} WHEN k = 5 THEN 2 END::INTEGER AS goal_alignment, CASE WHEN k IN (0, 1, 2, 5) THEN 2 END::INTEGER AS error_recovery,
          CASE WHEN k < 3 THEN CASE WHEN length(said) < 40 THEN rpad(said, 40, '.') ELSE said END WHEN k = 5 THEN rpad('True', 40, '.') END AS rationale,
          CASE k WHEN 3 THEN 'no JSON object' WHEN 4 THEN 'not an object' END AS error,
          CASE WHEN k < 3 THEN (n % 7 - 4) / 4e0 END AS reward, CASE WHEN k < 3 THEN least(1, n % 4 + 0.5e0) ELSE 0.7e0 END AS goal, CASE WHEN k < 3 THEN (least(1, n % 7) + least(1, n % 4 + 0.5e0)) / 2 ELSE 0.7e0 END AS ensemble
        FROM (SELECT conv_id, turn, length(text) AS n, length(text) % 6 AS k, trim(substring(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, length(text) % 60)) AS said FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)""",
)
def model_answers_query(spark, d):
    """Scores, rationale, reward and the judge's mean from answers in which the object must be found first."""
    value = answers.answer(F.col("answer"))["value"]
    rows = model_answers(spark, d).select("conv_id", "turn", answers.scored(F.col("answer"), K.DIMENSIONS).alias("s"), answers.reward(value, "step_quality").alias("reward"), answers.judged(value, ("step_quality", "goal_alignment"), K.JUDGE_OFFLINE).alias("j"))
    return rows.select("conv_id", "turn", "s.*", "reward", F.col("j.goal_alignment").alias("goal"), "j.ensemble")


# --- logs that fail ----------------------------------------------------------------------------------------------


def raw_logs(spark: SparkSession, d: str) -> DataFrame:
    """log_id, record: trajectories as JSON; some are cut off, some have no step, some a confidence over 1."""
    odd = F.col("user_id") % 10
    s = V.steps(spark, d).withColumn("confidence", F.when((odd == 2) & (F.col("step_index") == 0), 1.5).otherwise(F.col("confidence")))
    step = F.struct("step_index", "action", "observation", "confidence")
    rows = s.groupBy("traj", "user_id", "day", "scenario", "consent").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # by day: as the window's exchange has it
    log = F.struct(F.col("scenario").alias("scenario_type"), F.col("consent").alias("consent_model"), V.pick(K.ACTIONS, V.number(F.col("traj"), "gt") % 8).alias("ground_truth_action"), F.when(odd == 3, F.array()).otherwise(F.col("steps")).alias("trajectory"))
    text = F.to_json(log)
    return rows.select(F.col("traj").alias("log_id"), F.when(odd == 1, F.left(text, F.length(text) - 5)).otherwise(text).alias("record"))


_ERRORS = f"""f_errors AS (SELECT *, CASE WHEN cut THEN 'parse' WHEN strange OR high OR bare THEN 'schema' END AS stage, CASE WHEN cut THEN '$' WHEN strange THEN '$.scenario_type' WHEN high THEN '$.trajectory[0].confidence' WHEN bare THEN '$.trajectory' END AS path,
      CASE WHEN cut THEN 'json' WHEN strange THEN 'enum' WHEN high THEN 'maximum' WHEN bare THEN 'minItems' END AS rule, CASE WHEN cut THEN 1 WHEN strange OR high OR bare THEN strange::INTEGER + high::INTEGER + bare::INTEGER END AS problems
    FROM (SELECT *, user_id % 10 = 1 AS cut, scenario = '{V.OTHER}' AS strange, user_id % 10 = 2 AS high, user_id % 10 = 3 AS bare FROM f_combined))"""
_FAILING = (*_LAYERED, MSTEPS, _COMBINED, _ERRORS)


@query(
    "log_scores",
    "SELECT traj AS log_id, "
    + ", ".join(f"CASE WHEN stage IS NULL THEN {x} END AS {n}" for n, x in (("n", "n"), ("success", "round(success, 9)"), ("tool", "round(tool, 9)"), ("leak", "leak"), ("intent", "intent"), ("planning", "planning"), ("tool_calls", "round(tool_calls, 9)"), ("recovery", "round(recovery, 9)"), ("outcome", "outcome"), ("total", "round(total, 9)"), ("overall", "round(overall, 9)")))
    + ", stage, path, rule, problems FROM f_errors",
    _FAILING,
)
def log_scores(spark, d):
    """A row for each raw log: its scores, or why it has none."""
    rows = quarantine.evaluated(raw_logs(spark, d))
    rows = rows.select("log_id", *quarantine.SCORES, *[F.col(f"error.{c}").alias(c) for c in ("stage", "path", "rule")], F.col("error.n").alias("problems"))
    return r9(rows, "success", "tool", "tool_calls", "recovery", "total", "overall")


@query("log_errors", "SELECT stage, regexp_replace(path, '\\[\\d+\\]', '[]') AS path, rule, count(*) AS n FROM f_errors WHERE stage IS NOT NULL GROUP BY ALL", _FAILING)
def log_errors(spark, d):
    return quarantine.error_counts(quarantine.examined(raw_logs(spark, d)))


# --- raters that are injected, and the curve of finding them ---------------------------------------------------------

_SWEEP = f"""f_sweep AS (SELECT k * (1.01e0 / 499) AS threshold, coalesce(count(*) FILTER (bot AND suspicion >= k * (1.01e0 / 499)) / nullif(count(*) FILTER (bot), 0)::DOUBLE, 0) AS tpr, coalesce(count(*) FILTER (NOT bot AND suspicion >= k * (1.01e0 / 499)) / nullif(count(*) FILTER (NOT bot), 0)::DOUBLE, 0) AS fpr
    FROM (SELECT unnest(range(500)) AS k), (SELECT suspicion, rater LIKE 'bot%' AS bot FROM {_SUSPICION.format('f_injected')}) GROUP BY k)"""


def sweep(spark: SparkSession, d: str) -> DataFrame:
    return poisoning.sweep(poisoning.suspicion(injected(spark, d)).withColumn("bot", F.col("rater").startswith("bot").cast("int")), "suspicion", "bot")


@query("detection_sweep", "SELECT round(threshold, 9) AS threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM f_sweep", (V.ANNOTATIONS, LABELS, INJECTED, _SWEEP))
def detection_sweep(spark, d):
    """500 thresholds over the raters' suspicion."""
    return r9(sweep(spark, d), "threshold", "tpr", "fpr")


@query(
    "detection_area",
    "SELECT round(coalesce(sum((fpr - f) * (tpr + t) / 2), 0), 9) AS auc FROM (SELECT tpr, fpr, lag(tpr) OVER w AS t, lag(fpr) OVER w AS f FROM f_sweep WINDOW w AS (ORDER BY threshold DESC))",
    (V.ANNOTATIONS, LABELS, INJECTED, _SWEEP),
)
def detection_area(spark, d):
    return r9(poisoning.trapezoid(sweep(spark, d)), "auc")


_SPARSE = """f_sparse AS (SELECT conv_id AS item, 'step_quality' AS dim, least(4, delegation_quality) AS label FROM f_roles UNION ALL SELECT conv_id, 'privacy_compliance', CASE WHEN authority_appropriate THEN 4 ELSE 1 END FROM f_roles
    UNION ALL SELECT conv_id, 'error_recovery', handoff_quality FROM f_roles WHERE handoff_quality IS NOT NULL)"""


@query(
    "poison_dense",
    """SELECT item, dim, CASE dim WHEN 'step_quality' THEN least(4, r + 1) WHEN 'privacy_compliance' THEN greatest(1, r - 1) ELSE greatest(1, least(4, r)) END::INTEGER AS label FROM (
         SELECT i.item, d.dim, round_even(coalesce(avg(label), 2.5), 0)::INTEGER AS r FROM (SELECT DISTINCT conv_id AS item FROM f_roles) i CROSS JOIN (SELECT unnest(['step_quality', 'privacy_compliance', 'goal_alignment', 'error_recovery']) AS dim) d LEFT JOIN f_sparse s ON s.item = i.item AND s.dim = d.dim GROUP BY i.item, d.dim)""",
    (V.ROLES, _SPARSE),
)
def poison_dense(spark, d):
    """Injected labels of conversations that nobody rated in every dimension: each item has each dimension."""
    r = V.roles(spark, d)
    of = lambda dim, label: F.struct(F.lit(dim).alias("dim"), label.cast("int").alias("label"))
    cells = F.array(of("step_quality", F.least(F.lit(4), "delegation_quality")), of("privacy_compliance", F.when(F.col("authority_appropriate"), 4).otherwise(1)), of("error_recovery", F.col("handoff_quality")))
    rows = r.select(F.col("conv_id").alias("item"), F.col("agent_role").alias("rater"), F.inline(cells)).where("label is not null").withColumn("injected", F.lit(False))
    return poisoning.inject(rows, ["bot"]).where("injected").select("item", "dim", "label")


# --- private summaries of streams ----------------------------------------------------------------------------------

BOUNDS = {"value": (0.0, 100.0), "level": (20.0, 80.0)}
EPSILON, DELTA = 1.0, 1e-5


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return V.steps(spark, d).select("traj", "step_index", "event_type", "value", (F.col("confidence") * 100).alias("level"))


@query(
    "clipped_stream",
    f"""SELECT traj, count(*) AS n, round(avg(greatest(0e0, least(100e0, value))), 6) AS value, round(avg(greatest(20e0, least(80e0, confidence * 100))), 6) AS level,
          round(100 * sqrt(2 * ln(1.25e0 / {DELTA})) / {EPSILON} / count(*), 9) AS sigma_value, round(60 * sqrt(2 * ln(1.25e0 / {DELTA})) / {EPSILON} / count(*), 9) AS sigma_level FROM f_steps GROUP BY traj""",
    (V.STEPS,),
)
def clipped_stream(spark, d):
    """What a session's private summary is made of: means of clipped values and the noise due to them."""
    rows = privacy.clipped_means(_stream(spark, d), "traj", BOUNDS, EPSILON, DELTA)
    return r9(rows, "sigma_value", "sigma_level").withColumns({c: F.round(c, 6) for c in BOUNDS})


@query("private_grounding")
def private_grounding(spark, d):
    """Whether what a trajectory reports is grounded in its stream's private summary (noise: no SQL)."""
    stream = _stream(spark, d)
    band = lambda c, low, high: F.get(F.array(F.lit("low"), F.lit("middle"), F.lit("high")), F.greatest(F.lit(0), F.least(F.lit(2), F.floor((F.col(c) - low) / (high - low) * 3))).cast("int"))
    last = stream.groupBy("traj").agg(F.max_by("value", "step_index").alias("value"), F.max_by("level", "step_index").alias("level"))
    said = F.concat_ws(". ", *[F.concat(F.lit(f"now {c}-"), band(c, *BOUNDS[c])) for c in BOUNDS])
    return privacy.private_grounding(last.select("traj", said.alias("said")), privacy.stream_summary(stream, "traj", BOUNDS, EPSILON, DELTA), "traj", "said", BOUNDS)


# --- places ------------------------------------------------------------------------------------------------------

_CENTRES = {s: (10.0 * k - 20, 30.0 * k - 60) for k, s in enumerate(V.SCENARIO_OF)}
_PLACE = "value * 2 - 60"


@query(
    "places",
    f"""SELECT event_id, CASE WHEN ok THEN lat ELSE clat END AS lat, CASE WHEN ok THEN lon ELSE clon END AS lon, ok AS kept FROM (SELECT *, abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) AS ok FROM (
         SELECT event_id, {_PLACE} AS lat, step_index * 50e0 AS lon, CASE scenario {' '.join(f"WHEN '{s}' THEN {x}::DOUBLE" for s, (x, _) in _CENTRES.items())} END AS clat, CASE scenario {' '.join(f"WHEN '{s}' THEN {y}::DOUBLE" for s, (_, y) in _CENTRES.items())} END AS clon FROM f_steps))""",
    (V.STEPS,),
)
def places(spark, d):
    """Events' places; one that is not on earth is its scenario's centre."""
    centre = lambda k: F.create_map(*[F.lit(x) for s, c in _CENTRES.items() for x in (s, c[k])])[F.col("scenario")]
    rows = V.steps(spark, d).select("event_id", T.place_or(F.expr(_PLACE), F.col("step_index") * 50.0, centre(0), centre(1)).alias("p"))
    return rows.select("event_id", "p.*")


# --- two results, two raters ---------------------------------------------------------------------------------------


def _results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One agent's and several agents' results of the same logs, each scored by itself."""
    items = policy.one_agent(policy.several_agents(V.items(spark, d)))
    took = V.steps(spark, d).groupBy("traj").agg(F.max("value").alias("slowest"), F.sum("value").alias("whole"))
    out = []
    for side, latency, rate in (("single", "slowest", F.lit(None).cast("double")), ("multi", "whole", F.col("handoff_quality") / 5)):
        act = F.col(f"{side}_action")
        step = lambda i, action, c: F.struct(F.lit(i).alias("step_index"), action.alias("action"), F.lit(c).alias("confidence"))
        steps = items.select("traj", "scenario", F.lit(3).alias("n_steps"), F.inline(F.array(step(0, F.lit(""), 0.9), step(1, F.lit(""), 0.9), step(2, act, 0.9))))
        total = trajectory.layers(steps, ["traj"]).withColumn("weighted_total", trajectory.total()).select("traj", "weighted_total")
        own = items.select("traj", "scenario", act.isin(*K.TERMINAL_ACTIONS).alias("trajectory_success"), (act == F.col("ground_truth")).alias("tool_invocation_accuracy"), policy.compliant(act).alias("privacy_compliance"), rate.alias("authority_rate"))
        out.append(own.join(total, "traj").join(took.select("traj", F.col(latency).alias("latency_ms")), "traj"))
    return out[0], out[1]


def _side_sql(side: str, latency: str, rate: str) -> str:
    act = f"{side}_action"
    terminal = f"CASE WHEN {act} IN ({names_sql(K.TERMINAL_ACTIONS)}) THEN 1e0 ELSE 0e0 END"
    known = f"CASE WHEN scenario IN ({names_sql(K.SCENARIOS)}) THEN 0.75e0 ELSE 0.40e0 END"
    cells = (terminal, f"CASE WHEN {act} = ground_truth THEN 1e0 ELSE 0e0 END", f"CASE WHEN {_compliant_sql(act)} THEN 1e0 ELSE 0e0 END", latency, rate, f"(0.15e0 * {known} + 0.25e0 * 0.8e0 + 0.25e0 * 1e0 + 0.20e0 * {terminal}) / (0.15e0 + 0.25e0 + 0.25e0 + 0.20e0)")
    return ", ".join(f"{x} AS {side}_{m}" for m, x in zip(pairing.METRICS, cells, strict=True))


_PAIRS = f"""f_pairs AS (SELECT traj, scenario, {_side_sql('single', 'slowest', 'NULL::DOUBLE')}, {_side_sql('multi', 'whole', 'handoff_quality / 5e0')}
    FROM f_multi JOIN (SELECT traj, max(value) AS slowest, sum(value) AS whole FROM f_steps GROUP BY traj) USING (traj))"""
_WINNER = "CASE WHEN round(m - s, 9) > 1e-6 THEN '{0}' WHEN round(s - m, 9) > 1e-6 THEN '{1}' ELSE 'tie' END"


@query(
    "paired_results",
    f"SELECT traj, scenario, {', '.join(f'round({x}_{m}, 6) AS {x}_{m}' for x in ('single', 'multi') for m in pairing.METRICS)}, {_WINNER.format(pairing.MULTI, pairing.SINGLE).replace('m - s', 'multi_weighted_total - single_weighted_total').replace('s - m', 'single_weighted_total - multi_weighted_total')} AS winner FROM f_pairs",
    (V.STEPS, V.ITEMS, MULTI, _PAIRS),
)
def paired_results(spark, d):
    """Two result sets joined by log, metric by metric, and who wins."""
    rows = pairing.paired(*_results(spark, d), "traj", carry=("scenario",))
    names = [f"{x}_{m}" for x in ("single", "multi") for m in pairing.METRICS]
    return rows.select("traj", "scenario", *[F.round(n, 6).alias(n) for n in names], "winner")


@query(
    "paired_comparison",
    f"""SELECT metric, count(*) AS n, round(avg(s), 6) AS single, round(avg(m), 6) AS multi, round(avg(m - s), 6) AS delta, sum(CASE WHEN w = 'm' THEN 1 ELSE 0 END)::BIGINT AS multi_wins, sum(CASE WHEN w = 's' THEN 1 ELSE 0 END)::BIGINT AS single_wins, sum(CASE WHEN w = 'tie' THEN 1 ELSE 0 END)::BIGINT AS ties
        FROM (SELECT metric, s, m, {_WINNER.format('m', 's')} AS w FROM ({' UNION ALL '.join(f"SELECT '{m}' AS metric, single_{m} AS s, multi_{m} AS m FROM f_pairs" for m in pairing.METRICS)}) WHERE s IS NOT NULL AND m IS NOT NULL) GROUP BY metric""",
    (V.STEPS, V.ITEMS, MULTI, _PAIRS),
)
def paired_comparison(spark, d):
    rows = pairing.compared(pairing.paired(*_results(spark, d), "traj"))
    return rows.withColumns({c: F.round(c, 6) for c in ("single", "multi", "delta")})


_RATED = {"planning": "step_quality", "goal": "goal_alignment", "recovery": "error_recovery"}
_TWO = f"""f_scores AS (SELECT {' '.join(f"CASE dim WHEN '{v}' THEN '{k}'" if i == 0 else f"WHEN '{v}' THEN '{k}'" for i, (k, v) in enumerate(_RATED.items()))} END AS dim, traj AS item, rater, CASE WHEN dim <> 'error_recovery' OR NOT missing THEN (score - 1) / 3e0 END AS x
      FROM f_ann WHERE rater IN ('{K.RATERS[0]}', '{K.RATERS[1]}') AND dim IN ({names_sql(_RATED.values())})),
    f_two AS (SELECT dim, item, rater, least(floor(x * 3), 2)::INTEGER AS label FROM f_scores WHERE (dim, item) NOT IN (SELECT (dim, item) FROM f_scores WHERE x IS NULL))"""


def rater_scores(spark: SparkSession, d: str, rater: str) -> DataFrame:
    """One rater's scores of each trajectory, from 0 to 1; a recovery may be missing."""
    rows = V.annotations(spark, d).where(F.col("rater") == rater)
    of = lambda dim: F.max(F.when((F.col("dim") == dim) & ((F.col("dim") != "error_recovery") | ~F.col("missing")), (F.col("score") - 1) / 3))
    return rows.groupBy("traj").agg(*[of(v).alias(k) for k, v in _RATED.items()])


@query("pia_raters", f"SELECT dim, items AS n, round(kappa, 9) AS kappa FROM {fleiss_sql('f_two')}", (V.ANNOTATIONS, _TWO))
def pia_raters(spark, d):
    """Path-invariant agreement of two raters by dimension."""
    return r9(pairing.two_raters(rater_scores(spark, d, K.RATERS[0]), rater_scores(spark, d, K.RATERS[1]), "traj", tuple(_RATED)), "kappa")


@query("pia_raters_mean", f"SELECT round(avg(kappa), 9) AS kappa FROM {fleiss_sql('f_two')}", (V.ANNOTATIONS, _TWO))
def pia_raters_mean(spark, d):
    kappas = pairing.two_raters(rater_scores(spark, d, K.RATERS[0]), rater_scores(spark, d, K.RATERS[1]), "traj", tuple(_RATED))
    return r9(pairing.mean_agreement(kappas), "kappa")
