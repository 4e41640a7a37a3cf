"""Every query over the given tables with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import text as T
from ..operators import agreement, calibration, dataset, experiment, labelnoise, leaderboard, metrics, poisoning, policy, privacy, rewards, trajectory, triggers
from ..operators.graph import kept
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, frames: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH {', '.join(frames)}\n" if frames else "") + sql
        return f

    return keep


def r9(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def names_sql(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- trajectory scores -------------------------------------------------------------------------------------------

TRAJ = ["traj", "user_id", "day"]
_W = K.LAYER_WEIGHTS
LAYERS = f"""f_layers AS (
  SELECT *, (0.15e0 * intent + 0.25e0 * planning + 0.25e0 * tool_calls + 0.15e0 * coalesce(recovery, 0e0) + 0.20e0 * outcome)
            / (0.15e0 + 0.25e0 + 0.25e0 + 0.20e0 + CASE WHEN recovery IS NULL THEN 0e0 ELSE 0.15e0 END) AS total
  FROM (SELECT traj, user_id, day, n, scenario, final_action, mean_confidence,
          CASE WHEN scenario IN ({names_sql(K.SCENARIOS)}) THEN 0.75e0 ELSE 0.40e0 END AS intent,
          CASE WHEN least(1e0, 3e0 / greatest(1, n)) > 0.6e0 THEN 0.80e0 ELSE 0.55e0 END AS planning,
          valid / n AS tool_calls,
          CASE WHEN n > 1 THEN 0.70e0 + 0.30e0 * (1e0 - escalated / (n - 1)) END AS recovery,
          CASE WHEN final_action IN ({names_sql(K.TERMINAL_ACTIONS)}) THEN 1e0 ELSE 0e0 END AS outcome
        FROM (SELECT traj, user_id, day, max(n_steps) AS n, max(scenario) AS scenario, arg_max(action, step_index) AS final_action, avg(confidence) AS mean_confidence,
                sum(CASE WHEN action = '' OR action IN ({names_sql(K.ACTIONS)}) THEN 1 ELSE 0 END)::DOUBLE AS valid,
                min(CASE WHEN step_index < n_steps - 1 AND action = 'escalate_to_emergency' THEN step_index END)::DOUBLE AS escalated
              FROM f_steps GROUP BY ALL)))"""
_LAYERED = (V.STEPS, LAYERS)


def scored(spark: SparkSession, d: str, **more: Column) -> DataFrame:
    return trajectory.layers(V.steps(spark, d), TRAJ, **more).withColumn("total", trajectory.total())


@query(
    "trajectory_layers",
    "SELECT traj, n, intent, planning, round(tool_calls, 9) AS tool_calls, round(recovery, 9) AS recovery, outcome, round(coalesce(recovery, 0.5e0), 9) AS pia_recovery, round((intent + outcome) / 2, 9) AS pia_goal FROM f_layers",
    _LAYERED,
)
def trajectory_layers(spark, d):
    rows = trajectory.projected(scored(spark, d))
    return r9(rows, "tool_calls", "recovery", "pia_recovery", "pia_goal").select("traj", "n", "intent", "planning", "tool_calls", "recovery", "outcome", "pia_recovery", "pia_goal")


@query("trajectory_total", "SELECT traj, scenario, round(total, 9) AS total FROM f_layers", _LAYERED)
def trajectory_total(spark, d):
    return r9(scored(spark, d), "total").select("traj", "scenario", "total")


@query("scenario_report", "SELECT scenario, count(*) AS n, round(avg(total), 9) AS mean_total, round(CASE WHEN count(*) >= 3 THEN stddev_samp(total) END, 9) AS sd_total FROM f_layers GROUP BY scenario", _LAYERED)
def scenario_report(spark, d):
    return r9(trajectory.scenario_report(scored(spark, d)), "mean_total", "sd_total")


_SD = {"intent": "intent", "planning": "planning", "tool_calls": "tool_calls", "recovery": "coalesce(recovery, 0.5e0)", "outcome": "outcome"}


@query(
    "nondeterminism",
    f"""SELECT user_id, runs, round(sd_total, 9) AS sd_total, round(sd_goal, 9) AS sd_goal,
        CASE {' '.join(f"WHEN round(sd_{n}, 9) = greatest({', '.join(f'round(sd_{m}, 9)' for m in _SD)}) THEN '{n}'" for n in _SD)} END AS most_variable
        FROM (SELECT user_id, count(*) AS runs, stddev_samp(total) AS sd_total, stddev_samp((intent + outcome) / 2) AS sd_goal,
              {', '.join(f'stddev_samp({e}) AS sd_{n}' for n, e in _SD.items())} FROM f_layers GROUP BY user_id HAVING count(*) >= 2)""",
    _LAYERED,
)
def nondeterminism(spark, d):
    return r9(trajectory.variation(scored(spark, d), ["user_id"]), "sd_total", "sd_goal").select("user_id", "runs", "sd_total", "sd_goal", "most_variable")


# --- agreement ---------------------------------------------------------------------------------------------------


def labels(spark: SparkSession, d: str, all_rows: bool = True) -> DataFrame:
    """Long rows: dim, item, rater, label (null where a rating is missing)."""
    a = V.annotations(spark, d)
    label = F.col("score") if all_rows else F.when(~F.col("missing"), F.col("score"))
    return a.select("dim", F.col("traj").alias("item"), "rater", label.alias("label"))


LABELS = "f_labels AS (SELECT dim, traj AS item, rater, score AS label FROM f_ann)"
GAPS = "f_gaps AS (SELECT dim, traj AS item, rater, CASE WHEN NOT missing THEN score END AS label FROM f_ann)"


def cohen_sql(source: str, keys: str, extra: str = "") -> str:
    """Counts of label pairs by keys -> n, kappa."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    same = " AND ".join(f"x.{c.strip()} = y.{c.strip()}" for c in keys.split(",")) if keys else "true"
    xk = ", ".join(f"x.{c.strip()}" for c in keys.split(",")) + ", " if keys else ""
    xg = f"GROUP BY {xk[:-2]}" if keys else ""
    return f"""(SELECT {k}n, CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END AS kappa FROM (
        SELECT t.*, same / n::DOUBLE AS po, chance / (n::DOUBLE * n) AS pe FROM (
          SELECT {xk}(sum(x.c))::BIGINT AS n, sum(x.same) AS same, sum(x.c * coalesce(y.c, 0)) AS chance
          FROM (SELECT {k}a AS l, count(*) AS c, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS same FROM {source} GROUP BY {k}a) x
          LEFT JOIN (SELECT {k}b AS l, count(*) AS c FROM {source} GROUP BY {k}b) y ON x.l = y.l AND {same} {xg}) t))"""


def fleiss_sql(source: str, key: str = "dim") -> str:
    return f"""(SELECT m.{key}, m.items, CASE WHEN abs(1 - sq / (total::DOUBLE * total)) < 1e-12 THEN 1e0 ELSE (p_bar - sq / (total::DOUBLE * total)) / (1 - sq / (total::DOUBLE * total)) END AS kappa
        FROM (SELECT {key}, avg((s - n) / (n * (n - 1))::DOUBLE) AS p_bar, count(*) AS items, sum(n) AS total FROM
                (SELECT {key}, item, sum(c) AS n, sum(c * c) AS s FROM (SELECT {key}, item, label, count(*) AS c FROM {source} WHERE label IS NOT NULL GROUP BY ALL) GROUP BY {key}, item) GROUP BY {key}) m
        JOIN (SELECT {key}, sum(c::DOUBLE * c) AS sq FROM (SELECT {key}, label, count(*) AS c FROM {source} WHERE label IS NOT NULL GROUP BY ALL) GROUP BY {key}) s USING ({key}))"""


def alpha_sql(source: str, metric: str) -> str:
    between = "abs(gx.upto - gy.upto) + CASE WHEN gx.l <= gy.l THEN gx.nx ELSE gy.nx END - (gx.nx + gy.nx) / 2"
    delta = {"nominal": "CASE WHEN gx.l <> gy.l THEN 1e0 ELSE 0e0 END", "ordinal": f"CASE WHEN gx.l = gy.l THEN 0e0 ELSE {between} END", "interval": "(gx.l - gy.l)::DOUBLE", "ratio": "(gx.l - gy.l) / (gx.l + gy.l)::DOUBLE"}[metric]
    return f"""(WITH c AS (SELECT *, sum(c) OVER (PARTITION BY dim, item) AS m FROM (SELECT dim, item, label AS l, count(*) AS c FROM {source} WHERE label IS NOT NULL GROUP BY ALL)),
        o AS (SELECT x.dim, x.l AS lx, y.l AS ly, sum(x.c * (y.c - CASE WHEN x.l = y.l THEN 1 ELSE 0 END) / (x.m - 1)::DOUBLE) AS o FROM c x JOIN c y USING (dim, item) WHERE x.m > 1 GROUP BY ALL),
        g AS (SELECT dim, lx AS l, nx, sum(nx) OVER (PARTITION BY dim ORDER BY lx) AS upto, sum(nx) OVER (PARTITION BY dim) AS n FROM (SELECT dim, lx, sum(o) AS nx FROM o GROUP BY ALL))
        SELECT dim, CASE WHEN sum(gnx * gny * d * d) > 0 THEN 1 - (max(n) - 1) * sum(o * d * d) / sum(gnx * gny * d * d) END AS alpha FROM (
          SELECT gx.dim, gx.n, gx.nx AS gnx, gy.nx AS gny, coalesce(o.o, 0e0) AS o, {delta} AS d
          FROM g gx JOIN g gy ON gx.dim = gy.dim LEFT JOIN o ON o.dim = gx.dim AND o.lx = gx.l AND o.ly = gy.l) GROUP BY dim)"""


PAIRS = "f_pairs AS (SELECT x.dim, x.rater AS rater_a, y.rater AS rater_b, x.label AS a, y.label AS b FROM f_labels x JOIN f_labels y USING (dim, item) WHERE x.rater < y.rater)"


@query("cohen_labels", f"SELECT n, round(kappa, 9) AS kappa FROM {cohen_sql('(SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)', '')}")
def cohen_labels(spark, d):
    rows = V.read(spark, d, "labels").where("quality is not null and toxic is not null").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return r9(agreement.cohen(rows, []), "kappa")


@query("pairwise_cohen", f"SELECT dim, rater_a, rater_b, n, round(kappa, 9) AS kappa FROM {cohen_sql('f_pairs', 'dim, rater_a, rater_b')}", (V.ANNOTATIONS, LABELS, PAIRS))
def pairwise_cohen(spark, d):
    return r9(agreement.cohen(agreement.pairwise(labels(spark, d), ["dim"]), ["dim", "rater_a", "rater_b"]), "kappa")


_BAND = "CASE WHEN k < 0 THEN 'poor' WHEN k <= 0.2 THEN 'slight' WHEN k <= 0.4 THEN 'fair' WHEN k <= 0.6 THEN 'moderate' WHEN k <= 0.8 THEN 'substantial' ELSE 'almost perfect' END"


@query("fleiss_by_dim", f"SELECT dim, items, round(kappa, 9) AS kappa FROM {fleiss_sql('f_labels')}", (V.ANNOTATIONS, LABELS))
def fleiss_by_dim(spark, d):
    return r9(agreement.fleiss(labels(spark, d), ["dim"]), "kappa")


_COMPLETE = "(SELECT * FROM f_gaps WHERE (dim, item) IN (SELECT (dim, item) FROM f_gaps WHERE label IS NOT NULL GROUP BY dim, item HAVING count(DISTINCT rater) = 5))"


@query("fleiss_complete", f"SELECT dim, items, round(kappa, 9) AS kappa FROM {fleiss_sql('f_complete')}", (V.ANNOTATIONS, GAPS, f"f_complete AS {_COMPLETE}"))
def fleiss_complete(spark, d):
    return r9(agreement.fleiss(agreement.complete(labels(spark, d, False), ["dim"], 5), ["dim"]), "kappa")


@query("irr_bands", f"SELECT dim, {_BAND} AS band FROM (SELECT dim, round(kappa, 9) AS k FROM {fleiss_sql('f_labels')})", (V.ANNOTATIONS, LABELS))
def irr_bands(spark, d):
    return agreement.fleiss(labels(spark, d), ["dim"]).select("dim", agreement.band(F.round("kappa", 9)).alias("band"))


def _alpha(metric: str) -> None:
    @query(f"alpha_{metric}", f"SELECT dim, round(alpha, 9) AS alpha FROM {alpha_sql('f_gaps', metric)}", (V.ANNOTATIONS, GAPS))
    def run(spark, d):
        return r9(agreement.alpha(labels(spark, d, False), ["dim"], metric), "alpha")


for _metric in ("nominal", "ordinal", "interval", "ratio"):
    _alpha(_metric)

_REPORT = f"""SELECT dim, f.kappa AS fleiss, a.alpha AS alpha, c.cohen AS cohen FROM {fleiss_sql('f_labels')} f JOIN {alpha_sql('f_labels', 'ordinal')} a USING (dim)
    JOIN (SELECT dim, avg(kappa) AS cohen FROM {cohen_sql('f_pairs', 'dim, rater_a, rater_b')} GROUP BY dim) c USING (dim)"""


@query(
    "irr_report",
    f"SELECT dim, round(fleiss, 9) AS fleiss, round(alpha, 9) AS alpha, round(cohen, 9) AS cohen, round(least(cohen, fleiss, alpha), 9) AS lowest, alpha >= 0.8 AS passes FROM ({_REPORT})",
    (V.ANNOTATIONS, LABELS, PAIRS),
)
def irr_report(spark, d):
    rows = agreement.report(labels(spark, d), ["dim"])
    return r9(rows, "fleiss", "alpha", "cohen", "lowest").select("dim", "fleiss", "alpha", "cohen", "lowest", "passes")


@query(
    "target_gate",
    f"SELECT round(min(alpha), 9) AS lowest, round(avg(alpha), 9) AS mean_alpha, bool_and(alpha >= 0.8) AND avg(alpha) >= 0.8 AS passes FROM {alpha_sql('f_labels', 'ordinal')}",
    (V.ANNOTATIONS, LABELS),
)
def target_gate(spark, d):
    return r9(calibration.target_gate(agreement.alpha(labels(spark, d), ["dim"])), "lowest", "mean_alpha")


# Path-invariant items: a trajectory's three dimensions in three bins, rated by its user's first and second half of days.
@query(
    "step_kappa_weighted",
    f"""SELECT sum(items)::BIGINT AS steps, round(sum(kappa * items) / sum(items), 9) AS kappa FROM {fleiss_sql('f_steplabels', 'pair')}""",
    (
        V.STEPS,
        f"f_steplabels AS (SELECT user_id AS pair, event_id AS item, rater, {V.number_sql('event_id', 'rater')} % 3 AS label FROM f_steps, (SELECT unnest([{names_sql(K.RATERS)}]) AS rater))",
    ),
)
def step_kappa_weighted(spark, d):
    s = V.steps(spark, d).withColumn("rater", F.explode(F.array(*[F.lit(r) for r in K.RATERS])))
    rows = s.select(F.col("user_id").alias("pair"), F.col("event_id").alias("item"), "rater", (V.number(F.col("event_id").cast("string"), F.col("rater")) % 3).alias("label"))
    k = agreement.fleiss(rows, ["pair"])
    return r9(k.agg(F.sum("items").alias("steps"), (F.sum(F.col("kappa") * F.col("items")) / F.sum("items")).alias("kappa")), "kappa")


def _bin(x: Column) -> Column:
    return F.least(F.floor(F.round(x, 9) * 3), F.lit(2)).cast("int")


def pia_long(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of a trajectory as raters: its own scores, and those with its user's mean confidence."""
    s = trajectory.projected(scored(spark, d))
    dims = {"planning": F.col("pia_planning"), "recovery": F.col("recovery"), "goal": F.col("pia_goal")}
    own = s.select(F.col("traj").alias("item"), "mean_confidence", *[x.alias(n) for n, x in dims.items()]).unpivot(["item", "mean_confidence"], list(dims), "dim", "v")
    own = own.where("v is not null")
    a = own.select("dim", "item", F.lit("a").alias("rater"), _bin(F.col("v")).alias("label"))
    b = own.select("dim", "item", F.lit("b").alias("rater"), _bin((F.col("v") + F.col("mean_confidence")) / 2).alias("label"))
    return a.unionByName(b)


_PIA = """f_pia AS (SELECT dim, item, rater, least(floor(round(CASE rater WHEN 'a' THEN v ELSE (v + mean_confidence) / 2 END, 9) * 3), 2)::INTEGER AS label FROM (
    SELECT traj AS item, mean_confidence, 'planning' AS dim, planning AS v FROM f_layers UNION ALL
    SELECT traj, mean_confidence, 'recovery', recovery FROM f_layers WHERE recovery IS NOT NULL UNION ALL
    SELECT traj, mean_confidence, 'goal', (intent + outcome) / 2 FROM f_layers), (SELECT unnest(['a', 'b']) AS rater))"""


@query("pia_by_dim", f"SELECT dim, items, round(kappa, 9) AS kappa FROM {fleiss_sql('f_pia')}", (*_LAYERED, _PIA))
def pia_by_dim(spark, d):
    return r9(agreement.fleiss(pia_long(spark, d), ["dim"]), "kappa")


@query("pia_two_rater", f"SELECT round(avg(kappa), 9) AS kappa FROM {fleiss_sql('f_pia')}", (*_LAYERED, _PIA))
def pia_two_rater(spark, d):
    return r9(agreement.fleiss(pia_long(spark, d), ["dim"]).agg(F.avg("kappa").alias("kappa")), "kappa")


@query(
    "pia_by_scenario",
    f"SELECT scenario, round(avg(kappa), 4) AS mean_kappa FROM (SELECT split_part(gkey, '|', 1) AS scenario, kappa FROM {fleiss_sql('f_pia2', 'gkey')}) GROUP BY scenario",
    (*_LAYERED, _PIA, "f_pia2 AS (SELECT l.scenario || '|' || p.dim AS gkey, p.item, p.rater, p.label FROM f_pia p JOIN f_layers l ON l.traj = p.item)"),
)
def pia_by_scenario(spark, d):
    rows = pia_long(spark, d).join(scored(spark, d).select(F.col("traj").alias("item"), "scenario"), "item")
    return agreement.fleiss(rows, ["scenario", "dim"]).groupBy("scenario").agg(F.round(F.avg("kappa"), 4).alias("mean_kappa"))


# --- metrics -----------------------------------------------------------------------------------------------------

ITEM_KEYS = ["traj", "ground_truth"]


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    s = V.steps(spark, d)
    truth = V.pick(K.ACTIONS, V.number(F.col("traj"), "gt") % 8)
    return metrics.metric_steps(s, truth)


MSTEPS = f"""f_msteps AS (SELECT *, CASE WHEN action <> '' THEN action END AS tool, step_index = n_steps - 1 AS is_last, {V.pick_sql(K.ACTIONS, V.number_sql("traj", "'gt'") + " % 8")} AS truth FROM f_steps)"""
_SUCCESS = f"""(SELECT traj, avg(CASE WHEN is_last AND tool IN ({names_sql(K.TERMINAL_ACTIONS)}) THEN 1e0 ELSE 0e0 END) AS success,
    coalesce(avg(CASE WHEN tool IS NOT NULL THEN CASE WHEN is_last AND tool = truth THEN 1e0 ELSE 0e0 END END), 1e0) AS tool FROM f_msteps GROUP BY traj)"""


@query("goal_rate_and_tool_accuracy", f"SELECT traj, round(success, 9) AS success, round(tool, 9) AS tool FROM {_SUCCESS}", (V.STEPS, MSTEPS))
def goal_rate_and_tool_accuracy(spark, d):
    return r9(metrics.success_and_tools(metric_rows(spark, d), ["traj"]), "success", "tool")


@query(
    "role_correctness",
    "SELECT conv_id, round(avg(CASE WHEN agent_role = CASE WHEN pos % 2 = 1 THEN 'orchestrator' ELSE 'health_agent' END THEN 1e0 ELSE 0e0 END), 9) AS role FROM f_roles GROUP BY conv_id",
    (V.ROLES,),
)
def role_correctness(spark, d):
    rows = V.roles(spark, d).withColumn("expected_role", F.when(F.col("pos") % 2 == 1, "orchestrator").otherwise("health_agent"))
    return r9(metrics.role_correctness(rows, ["conv_id"]), "role")


@query("latency_sla", "SELECT event_id, round(CASE WHEN value <= 50 THEN 1e0 ELSE greatest(0e0, 1 - (value - 50) / 50) END, 9) AS latency FROM events")
def latency_sla(spark, d):
    return r9(V.read(spark, d, "events").select("event_id", metrics.latency(F.col("value"), 50.0).alias("latency")), "latency")


_PII = " OR ".join(f"regexp_matches(coalesce(text, ''), '{p}')" for p in (K.EMAIL, K.US_PHONE, K.SSN))


# What a step saw is its event's JSON text; a trajectory without a text to ground takes the offline constant, one without a latency keeps its time.
_COMBINED = f"""f_combined AS (SELECT l.*, s.success, s.tool, p.leak, 0.30e0 * s.success + 0.25e0 * s.tool + 0.20e0 * 0.75e0 + 0.10e0 * CASE WHEN p.leak THEN 0e0 ELSE 1e0 END + 0.10e0 * 1e0 + 0.05e0 * 1e0 AS overall
    FROM f_layers l JOIN {_SUCCESS} s USING (traj) JOIN (SELECT traj, bool_or({_PII.replace("text", "observation")}) AS leak FROM f_steps GROUP BY traj) p USING (traj))"""


def combined(spark: SparkSession, d: str) -> DataFrame:
    """The six metrics of each trajectory beside its five layers and its total: one pass over the steps for each."""
    rows = metrics.success_and_tools(metric_rows(spark, d), ["traj"], leak_in="observation")
    rows = rows.withColumns({"grounded": F.lit(K.GROUNDED_OFFLINE), "role": F.lit(1.0), "latency": F.lit(1.0)})
    return trajectory.projected(scored(spark, d)).join(rows, "traj").withColumn("overall", metrics.overall(F.col("leak")))


@query("overall_score", "SELECT traj, round(overall, 9) AS overall FROM f_combined", (*_LAYERED, MSTEPS, _COMBINED))
def overall_score(spark, d):
    return r9(combined(spark, d).select("traj", "overall"), "overall")


@query(
    "combined_evaluation",
    """SELECT traj, round(success, 9) AS success, round(tool, 9) AS tool, leak, 0.75e0 AS grounded, 1e0 AS role, 1e0 AS latency, intent, planning, round(tool_calls, 9) AS tool_calls, round(recovery, 9) AS recovery, outcome,
       planning AS pia_planning, round(coalesce(recovery, 0.5e0), 9) AS pia_recovery, round((intent + outcome) / 2, 9) AS pia_goal, round(tool_calls, 9) AS pia_tools, round(total, 9) AS total FROM f_combined""",
    (*_LAYERED, MSTEPS, _COMBINED),
)
def combined_evaluation(spark, d):
    out = combined(spark, d)
    names = ["traj", "success", "tool", "leak", "grounded", "role", "latency", "intent", "planning", "tool_calls", "recovery", "outcome", "pia_planning", "pia_recovery", "pia_goal", "pia_tools", "total"]
    return r9(out.select(*names), "success", "tool", "tool_calls", "recovery", "pia_recovery", "pia_goal", "pia_tools", "total")


@query("pii_documents", f"SELECT source, bool_or({_PII}) AS leak, sum(CASE WHEN {_PII} THEN 1 ELSE 0 END)::BIGINT AS n_texts FROM documents GROUP BY source")
def pii_documents(spark, d):
    return metrics.leaks(V.read(spark, d, "documents"), ["source"])


@query("pii_conversations", f"SELECT role, bool_or({_PII}) AS leak, sum(CASE WHEN {_PII} THEN 1 ELSE 0 END)::BIGINT AS n_texts FROM conversations GROUP BY role")
def pii_conversations(spark, d):
    return metrics.leaks(V.read(spark, d, "conversations"), ["role"])


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns with the words of the turn before."""
    c = V.read(spark, d, "conversations")
    own = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("before", F.lag("text").over(own)).where("role = 'assistant' and before is not null").withColumn("words", T.word_set(F.col("before")))


_REPLIES = r"""f_replies AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(lower(before), '\s+'), lambda w: w <> '') AS words FROM (
    SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE role = 'assistant' AND before IS NOT NULL)"""
_OVERLAP = r"""(SELECT conv_id, turn, CASE WHEN len(s) = 0 THEN 1e0 ELSE len(list_filter(s, lambda x: len(list_intersect(regexp_split_to_array(lower(x), '\s+'), words)) > 0)) / len(s)::DOUBLE END AS overlap
    FROM (SELECT conv_id, turn, words, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x)), lambda x: length(x) > 0) AS s FROM f_replies))"""


@query("grounding_overlap", f"SELECT conv_id, turn, round(overlap, 9) AS overlap FROM {_OVERLAP}", (_REPLIES,))
def grounding_overlap(spark, d):
    return replies(spark, d).select("conv_id", "turn", F.round(metrics.grounded(F.col("text"), F.col("words")), 9).alias("overlap"))


@query(
    "facts_gate",
    f"""SELECT conv_id, turn, eligible, round(CASE WHEN eligible > 0 THEN (0.70e0 + overlap + 0.75e0) / 3 ELSE 0e0 END, 9) AS facts FROM (
          SELECT *, CASE WHEN conv_id % 4 = 0 THEN 0.5e0 WHEN turn % 3 = 1 THEN 1e0 ELSE 0e0 END AS eligible FROM {_OVERLAP})""",
    (_REPLIES,),
)
def facts_gate(spark, d):
    truth = F.when(F.col("conv_id") % 4 == 0, "").otherwise("send_alert")
    action = F.when(F.col("turn") % 3 == 1, "send_alert").otherwise("log_and_monitor")
    rows = replies(spark, d).withColumn("eligible", metrics.eligibility(F.lit(3), action, truth))
    return rows.select("conv_id", "turn", "eligible", F.round(metrics.gate_facts(metrics.facts(F.col("text"), F.col("words")), F.col("eligible")), 9).alias("facts"))


@query(
    "facts_summary",
    f"""SELECT count(*) AS n, round(avg(facts), 9) AS mean_facts, round(avg(CASE WHEN eligible > 0 THEN 1e0 ELSE 0e0 END), 9) AS eligible_rate FROM (
          SELECT eligible, CASE WHEN eligible > 0 THEN (0.70e0 + overlap + 0.75e0) / 3 ELSE 0e0 END AS facts FROM (
          SELECT *, CASE WHEN conv_id % 4 = 0 THEN 0.5e0 WHEN turn % 3 = 1 THEN 1e0 ELSE 0e0 END AS eligible FROM {_OVERLAP}))""",
    (_REPLIES,),
)
def facts_summary(spark, d):
    return r9(facts_gate(spark, d).agg(F.count("*").alias("n"), F.avg("facts").alias("mean_facts"), F.avg((F.col("eligible") > 0).cast("double")).alias("eligible_rate")), "mean_facts", "eligible_rate")


# --- rewards -----------------------------------------------------------------------------------------------------

_REWARD = """CASE WHEN action IN ('send_alert', 'escalate_to_emergency') AND success THEN 1e0 WHEN action = 'no_action' AND NOT success THEN -1e0
    WHEN quality IS NOT NULL THEN (quality - 2.5e0) / 1.5e0 ELSE greatest(-0.5e0, least(0.5e0, 0.3e0 - 0.25e0 * step_index)) END"""
REWARDS = f"""f_rewards AS (SELECT *, CASE WHEN NOT is_terminal THEN 0e0 WHEN success THEN 1e0 ELSE -1e0 END AS outcome_reward,
      CASE WHEN is_terminal THEN (process_reward + 1) / 2 ELSE greatest(0e0, process_reward) END AS partial_credit
    FROM (SELECT *, step_index = n_steps - 1 AS is_terminal, {_REWARD} AS process_reward FROM (
      SELECT *, CASE WHEN event_id % 3 = 0 THEN 1 + event_id % 4 END AS quality,
        max(CASE WHEN step_index = n_steps - 1 AND action IN ({names_sql(K.TERMINAL_ACTIONS)}) THEN 1 ELSE 0 END) OVER (PARTITION BY traj) = 1 AS success FROM f_steps)))"""


def rewarded(spark: SparkSession, d: str) -> DataFrame:
    s = V.steps(spark, d).withColumn("quality", F.when(F.col("event_id") % 3 == 0, 1 + F.col("event_id") % 4))
    ended = (F.col("step_index") == F.col("n_steps") - 1) & F.col("action").isin(*K.TERMINAL_ACTIONS)
    s = s.withColumn("success", F.max(ended.cast("int")).over(Window.partitionBy("traj")) == 1)
    return rewards.step_rewards(s, "success", "quality")


@query("step_rewards", "SELECT event_id, round(process_reward, 9) AS process_reward, outcome_reward, round(partial_credit, 9) AS partial_credit FROM f_rewards", (V.STEPS, REWARDS))
def step_rewards(spark, d):
    return r9(rewarded(spark, d), "process_reward", "partial_credit").select("event_id", "process_reward", "outcome_reward", "partial_credit")


_CONFLICT = """(SELECT traj, max(CASE WHEN success THEN 0 ELSE 1 END) AS failed, avg(CASE WHEN NOT is_terminal THEN CASE WHEN process_reward > 0 THEN 1e0 ELSE 0e0 END END) AS positive,
    sum(CASE WHEN NOT is_terminal THEN process_reward END) AS sr, sum(CASE WHEN NOT is_terminal THEN partial_credit END) AS sc, sum(CASE WHEN NOT is_terminal THEN 1 ELSE 0 END) AS ni FROM f_rewards GROUP BY traj)"""


@query("gradient_conflict", f"SELECT traj, failed, failed = 1 AND coalesce(positive, 0e0) >= 0.5 AS conflict FROM {_CONFLICT}", (V.STEPS, REWARDS))
def gradient_conflict(spark, d):
    return rewards.conflicts(rewarded(spark, d), ["traj"]).select("traj", "failed", "conflict")


@query(
    "reward_summary",
    f"SELECT count(*) AS n, sum(CASE WHEN failed = 1 AND coalesce(positive, 0e0) >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_conflict, sum(failed)::BIGINT AS n_failed, round(sum(sr) / sum(ni), 4) AS mean_reward, round(sum(sc) / sum(ni), 4) AS mean_credit FROM {_CONFLICT}",
    (V.STEPS, REWARDS),
)
def reward_summary(spark, d):
    return rewards.reward_summary(rewards.conflicts(rewarded(spark, d), ["traj"])).withColumns({"mean_reward": F.round("mean_reward", 4), "mean_credit": F.round("mean_credit", 4)})


# --- raters that do not fit --------------------------------------------------------------------------------------

_SUSPICION = """(SELECT rater, deviation, CASE WHEN max(deviation) OVER () - min(deviation) OVER () < 1e-9 THEN 0e0 ELSE (deviation - min(deviation) OVER ()) / (max(deviation) OVER () - min(deviation) OVER ()) END AS suspicion
    FROM (SELECT rater, avg(abs(label - m)) AS deviation FROM (SELECT *, avg(label) OVER (PARTITION BY item, dim) AS m FROM {}) GROUP BY rater))"""


@query("suspicion", f"SELECT rater, round(deviation, 9) AS deviation, round(suspicion, 9) AS suspicion FROM {_SUSPICION.format('f_labels')}", (V.ANNOTATIONS, LABELS))
def suspicion(spark, d):
    return r9(poisoning.suspicion(labels(spark, d)), "deviation", "suspicion")


INJECTED = """f_injected AS (SELECT item, dim, rater, label, false AS injected FROM f_labels UNION ALL
    SELECT item, dim, rater, CASE dim WHEN 'step_quality' THEN least(4, r + 1) WHEN 'privacy_compliance' THEN greatest(1, r - 1) ELSE greatest(1, least(4, r)) END, true
    FROM (SELECT item, dim, round_even(avg(label), 0)::INTEGER AS r FROM f_labels GROUP BY item, dim), (SELECT unnest(['bot_a', 'bot_b']) AS rater))"""


def injected(spark: SparkSession, d: str) -> DataFrame:
    return poisoning.inject(labels(spark, d).withColumn("injected", F.lit(False)), ["bot_a", "bot_b"])


@query("poison_inject", "SELECT rater, dim, count(*) AS n, sum(label)::BIGINT AS total, bool_or(injected) AS injected FROM f_injected GROUP BY rater, dim", (V.ANNOTATIONS, LABELS, INJECTED))
def poison_inject(spark, d):
    return injected(spark, d).groupBy("rater", "dim").agg(F.count("*").alias("n"), F.sum("label").alias("total"), F.bool_or("injected").alias("injected"))


@query(
    "detection_eval",
    f"""SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-9), 6) AS f1 FROM (SELECT *, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM (
        SELECT sum(CASE WHEN f AND t THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN f AND NOT t THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN t AND NOT f THEN 1 ELSE 0 END)::BIGINT AS fn
        FROM (SELECT rater, suspicion > 0.5 AS f, rater LIKE 'bot%' AS t FROM {_SUSPICION.format('f_injected')})))""",
    (V.ANNOTATIONS, LABELS, INJECTED),
)
def detection_eval(spark, d):
    s = poisoning.suspicion(injected(spark, d))
    out = poisoning.detection(s.where("suspicion > 0.5"), s.where("rater like 'bot%'"))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "detection_auc",
    "SELECT round(sum(p * (below + n / 2e0)) / (sum(p)::DOUBLE * sum(n)), 9) AS auc FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ("
    "SELECT round(total, 9) AS s, sum(CASE WHEN outcome = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN outcome = 0 THEN 1 ELSE 0 END) AS n FROM f_layers GROUP BY 1))",
    _LAYERED,
)
def detection_auc(spark, d):
    return r9(poisoning.auc(scored(spark, d), "total", "outcome"), "auc")


@query(
    "label_self_confidence",
    """SELECT item, given, round((v + 0.1e0) / (n + 0.4e0), 9) AS confidence FROM (SELECT item, label AS given, v, sum(v) OVER (PARTITION BY item) AS n, row_number() OVER (PARTITION BY item ORDER BY v DESC, label) AS k
       FROM (SELECT item, label, count(*) AS v FROM f_gaps WHERE label IS NOT NULL GROUP BY ALL)) WHERE k = 1""",
    (V.ANNOTATIONS, GAPS),
)
def label_self_confidence(spark, d):
    return r9(poisoning.label_confidence(labels(spark, d, False)), "confidence")


_SHARES = "[" + ", ".join(f"p{k}" for k in range(1, 5)) + "]"
_KINDS = range(1, 5)
_PS = f"[{', '.join(f'p{k}' for k in _KINDS)}]"


def noise_sql(source: str) -> str:
    """Confident learning from the definition, on rows (dim, item, given, p1 to p4): f_issues."""
    sure = ", ".join(f"CASE WHEN p{k} >= greatest(t{k}, 2e-6) - 1e-6 THEN {k} END" for k in _KINDS)
    whole = lambda x, row, column: f"""round_even({x}, 0) + CASE WHEN row_number() OVER (PARTITION BY {row} ORDER BY {x} - round_even({x}, 0) DESC, {column} DESC) <= abs(off) THEN sign(off) ELSE 0 END"""
    off = lambda x, row: f"round_even(sum({x}) OVER (PARTITION BY {row}), 0) - sum(round_even({x}, 0)) OVER (PARTITION BY {row}) AS off"
    return f"""f_sure AS (SELECT s.*, list_filter([{sure}], lambda k: k IS NOT NULL) AS sure FROM {source} s JOIN (SELECT dim, {', '.join(f"avg(p{k}) FILTER (given = {k}) AS t{k}" for k in _KINDS)} FROM {source} GROUP BY dim) USING (dim)),
    f_guess AS (SELECT *, CASE WHEN len(sure) > 1 THEN list_position({_PS}, list_max({_PS})) ELSE sure[1] END::INTEGER AS likely FROM f_sure),
    f_cells AS (SELECT dim, given::INTEGER AS given, likely::INTEGER AS likely FROM (SELECT DISTINCT dim FROM {source}), (SELECT unnest(range(1, 5)) AS given), (SELECT unnest(range(1, 5)) AS likely)),
    f_joint AS (SELECT c.dim, c.given, c.likely, greatest(count(g.item), CASE WHEN c.given = c.likely THEN 1 ELSE 0 END) AS n FROM f_cells c LEFT JOIN f_guess g ON g.dim = c.dim AND g.given = c.given AND g.likely = c.likely GROUP BY c.dim, c.given, c.likely),
    f_scaled AS (SELECT *, {off("x", "dim, given")} FROM (SELECT j.*, n / sum(n) OVER (PARTITION BY dim, given)::DOUBLE * coalesce(size, 0) AS x FROM f_joint j LEFT JOIN (SELECT dim, given, count(*) AS size FROM {source} GROUP BY ALL) USING (dim, given))),
    f_whole AS (SELECT dim, given, likely, {whole("x", "dim, given", "likely")} AS n FROM f_scaled),
    f_kept AS (SELECT *, {off("x", "dim, likely")} FROM (SELECT *, CASE WHEN given = likely THEN greatest(n, 1e0) ELSE greatest(0e0, n - max(CASE WHEN given = likely THEN greatest(1 - n, 0e0) END) OVER w / greatest(sum(CASE WHEN n <> 0 THEN 1 ELSE 0 END) OVER w - 1, 1)) END AS x FROM f_whole WINDOW w AS (PARTITION BY dim, given))),
    f_prune AS (SELECT dim, given, likely, {whole("x", "dim, likely", "given")} AS n FROM f_kept),
    f_margin AS (SELECT g.dim, g.item, g.given, p.likely, p.n::BIGINT AS n, {_PS}[p.likely] - {_PS}[g.given] AS margin, count(*) OVER (PARTITION BY g.dim, g.given, p.likely) AS size FROM f_guess g JOIN f_prune p ON p.dim = g.dim AND p.given = g.given AND p.likely <> p.given AND p.n > 0),
    f_cut AS (SELECT dim, given, likely, list_sort(list(margin), 'DESC')[least(any_value(n), count(*))] AS least FROM f_margin WHERE size > 1 GROUP BY dim, given, likely),
    f_pruned AS (SELECT DISTINCT dim, item FROM f_margin JOIN f_cut USING (dim, given, likely) WHERE margin >= least),
    f_issues AS (SELECT g.*, p.item IS NOT NULL AS pruned FROM f_guess g LEFT JOIN f_pruned p ON p.dim = g.dim AND p.item = g.item)"""


_VOTES = f"""f_votes AS (SELECT dim, item, {', '.join(f"sum(CASE WHEN label = {k} THEN 1 ELSE 0 END) AS v{k}" for k in _KINDS)} FROM f_gaps WHERE label IS NOT NULL GROUP BY dim, item),
    f_shares AS (SELECT dim, item, {', '.join(f"(v{k} + 0.1e0) / (v1 + v2 + v3 + v4 + 0.4e0) AS p{k}" for k in _KINDS)}, list_position([v1, v2, v3, v4], greatest(v1, v2, v3, v4))::INTEGER AS given FROM f_votes)"""


@query(
    "label_issue_mask",
    f"SELECT dim, item, given, likely, pruned, pruned AND {_PS}[given] + 1e-6 < list_max({_PS}) AS issue FROM f_issues",
    (V.ANNOTATIONS, GAPS, _VOTES, noise_sql("f_shares")),
)
def label_issue_mask(spark, d):
    """By dimension: items that the noise rates of the raters' votes prune. The given class is the most voted one, so none stays an issue."""
    rows = kept(labelnoise.probabilities(labels(spark, d, False), by=("dim",)))  # read several times
    return labelnoise.noise_rate_issues(rows, by=("dim",))


_FIRST = f"""f_first AS (SELECT s.dim, s.item, g.label AS given, {', '.join(f"p{k}" for k in _KINDS)} FROM f_shares s JOIN (SELECT dim, item, label FROM f_gaps WHERE rater = '{K.RATERS[0]}' AND label IS NOT NULL) g USING (dim, item))"""


@query(
    "rater_label_issues",
    f"SELECT dim, item, given, likely, pruned, pruned AND {_PS}[given] + 1e-6 < list_max({_PS}) AS issue FROM f_issues",
    (V.ANNOTATIONS, GAPS, _VOTES, _FIRST, noise_sql("f_first")),
)
def rater_label_issues(spark, d):
    """One rater's labels against what the panel's votes make probable: those that the noise rates say are wrong."""
    rows = labels(spark, d, False)
    rows = labelnoise.probabilities(rows, by=("dim",), given=F.max(F.when(F.col("rater") == K.RATERS[0], F.col("label"))))
    return labelnoise.noise_rate_issues(kept(rows.where("given is not null")), by=("dim",))  # read several times


@query(
    "detection_roc",
    """SELECT k / 100e0 AS threshold, round(sum(p) OVER w / sum(p) OVER (), 9) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 9) AS fpr FROM (
         SELECT g.k, sum(CASE WHEN outcome = 1 THEN 1e0 ELSE 0e0 END) AS p, sum(CASE WHEN outcome = 0 THEN 1e0 ELSE 0e0 END) AS n
         FROM (SELECT unnest(range(101)) AS k) g LEFT JOIN (SELECT outcome, least(100, greatest(0, floor(round(total * 100, 9)))) AS k FROM f_layers) l ON l.k = g.k GROUP BY g.k)
       WINDOW w AS (ORDER BY k DESC)""",
    _LAYERED,
)
def detection_roc(spark, d):
    return r9(poisoning.roc(scored(spark, d), "total", "outcome"), "tpr", "fpr")


# --- experiments -------------------------------------------------------------------------------------------------

_SPLIT = "f_split AS (SELECT *, CASE WHEN pos <= 50 THEN 'curated' ELSE 'raw' END AS grp FROM (SELECT *, row_number() OVER (ORDER BY round(total, 9) DESC, traj) AS pos FROM f_layers))"
_AB = f"""f_ab AS (SELECT grp, CASE WHEN grp = 'raw' AND coin THEN 0e0 ELSE success END AS success, CASE WHEN grp = 'raw' AND coin THEN 0e0 ELSE tool END AS tool
    FROM (SELECT s.grp, m.success, m.tool, {V.number_sql("s.traj", "'coin'")} % 2 = 0 AS coin FROM f_split s JOIN {_SUCCESS} m USING (traj)))"""
_ABM = "(SELECT grp, 'success' AS metric, avg(success) AS mean, coalesce(stddev_samp(success), 0e0) AS sd FROM f_ab GROUP BY grp UNION ALL SELECT grp, 'tool', avg(tool), coalesce(stddev_samp(tool), 0e0) FROM f_ab GROUP BY grp)"


@query("ab_split", "SELECT traj, grp, round(total, 9) AS total FROM f_split", (*_LAYERED, _SPLIT))
def ab_split(spark, d):
    return r9(experiment.split(scored(spark, d), "total", "traj"), "total").select("traj", "grp", "total")


def ab_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = experiment.split(scored(spark, d), "total", "traj").select("traj", "grp").join(metrics.success_and_tools(metric_rows(spark, d), ["traj"]), "traj")
    coin = (F.col("grp") == "raw") & (V.number(F.col("traj"), "coin") % 2 == 0)
    return experiment.damage(rows, coin, {"success": F.lit(0.0), "tool": F.lit(0.0)})


@query("ab_metrics", f"SELECT grp, metric, round(mean, 9) AS mean, round(sd, 9) AS sd FROM {_ABM}", (*_LAYERED, MSTEPS, _SPLIT, _AB))
def ab_metrics(spark, d):
    return r9(experiment.metric_table(ab_rows(spark, d), ["success", "tool"]), "mean", "sd")


@query(
    "ab_delta",
    f"""SELECT metric, round(base, 6) AS base, round(other, 6) AS other, round(other - base, 6) AS delta, round(CASE WHEN base = 0 THEN 0e0 ELSE 100 * (other - base) / base END, 2) AS percent
        FROM (SELECT metric, max(CASE WHEN grp = 'raw' THEN mean END) AS base, max(CASE WHEN grp = 'curated' THEN mean END) AS other FROM {_ABM} GROUP BY metric)""",
    (*_LAYERED, MSTEPS, _SPLIT, _AB),
)
def ab_delta(spark, d):
    out = experiment.delta(experiment.metric_table(ab_rows(spark, d), ["success", "tool"]))
    return out.select("metric", F.round("base", 6).alias("base"), F.round("other", 6).alias("other"), F.round("delta", 6).alias("delta"), F.round("percent", 2).alias("percent"))


# --- leaderboard -------------------------------------------------------------------------------------------------

_CASCADE = """f_cascade AS (SELECT traj, max(run)::BIGINT AS cascade_depth FROM (SELECT traj, g, sum(t) AS run FROM (
    SELECT traj, CASE WHEN action <> '' THEN 1 ELSE 0 END AS t, sum(CASE WHEN action <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY traj ORDER BY step_index) AS g FROM f_steps) GROUP BY traj, g) GROUP BY traj)"""
RUNS = f"""f_runs AS (SELECT *, stddev_samp(trajectory_score) OVER (PARTITION BY framework, scenario) AS nondeterminism_variance FROM (
    SELECT l.traj, {V.pick_sql(K.FRAMEWORKS, "l.user_id % 4")} AS framework, l.scenario, CASE WHEN l.n > 1 THEN total END AS trajectory_score, (100 * l.n + {V.number_sql("l.traj", "'tokens'")} % 400)::BIGINT AS tokens_used,
      m.ms AS latency_ms, outcome = 1 AS goal_achieved, cascade_depth FROM f_layers l JOIN f_cascade USING (traj) JOIN (SELECT traj, sum(value) AS ms FROM f_steps GROUP BY traj) m USING (traj)))"""
BOARD = """f_board AS (SELECT framework, avg(coalesce(trajectory_score, 0e0)) AS avg_trajectory_score, avg(tokens_used) AS avg_tokens, avg(latency_ms) AS avg_latency_ms,
    avg(CASE WHEN goal_achieved THEN 1e0 ELSE 0e0 END) AS goal_achievement_rate, coalesce(avg(nondeterminism_variance), 0e0) AS avg_nondeterminism_variance, avg(cascade_depth::DOUBLE) AS avg_cascade_depth FROM f_runs GROUP BY framework)"""
_ORD = f"list_position([{names_sql(K.FRAMEWORKS)}], framework)"
_RANKED = f"(SELECT *, {', '.join(f'row_number() OVER (ORDER BY round({m}, 9) {'ASC' if low else 'DESC'}, {_ORD}) AS pos_{m}' for m, low in K.RANKED)} FROM f_board)"
_BOARDED = (*_LAYERED, _CASCADE, RUNS, BOARD)


def depth(spark: SparkSession, d: str) -> DataFrame:
    return leaderboard.cascade_depth(V.steps(spark, d), ["traj"], F.col("action") != "")


def runs(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d, latency_ms=F.sum("value")).join(depth(spark, d), "traj")
    rows = rows.select(
        "traj",
        V.pick(K.FRAMEWORKS, F.col("user_id") % 4).alias("framework"),
        "scenario",
        F.when(F.col("n") > 1, F.col("total")).alias("trajectory_score"),
        (100 * F.col("n") + V.number(F.col("traj"), "tokens") % 400).alias("tokens_used"),
        "latency_ms",
        (F.col("outcome") == 1).alias("goal_achieved"),
        "cascade_depth",
    )
    return leaderboard.with_deviation(rows, ["framework", "scenario"])


@query("cascade_depth", "SELECT traj, cascade_depth FROM f_cascade", (V.STEPS, _CASCADE))
def cascade_depth(spark, d):
    return depth(spark, d)


_BOARD_COLUMNS = [m for m, _ in K.RANKED]


@query("leaderboard", f"SELECT framework, {', '.join(f'round({m}, 9) AS {m}' for m in _BOARD_COLUMNS)} FROM f_board", _BOARDED)
def board(spark, d):
    return r9(leaderboard.leaderboard(runs(spark, d)), *_BOARD_COLUMNS)


@query(
    "composite_rank",
    f"SELECT framework, {', '.join(f'pos_{m}' for m in _BOARD_COLUMNS)}, {' + '.join(f'pos_{m}' for m in _BOARD_COLUMNS)} AS rank_sum, row_number() OVER (ORDER BY {' + '.join(f'pos_{m}' for m in _BOARD_COLUMNS)}, {_ORD}) AS overall_rank FROM {_RANKED}",
    _BOARDED,
)
def composite_rank(spark, d):
    return leaderboard.composite(leaderboard.rankings(leaderboard.leaderboard(runs(spark, d)))).select("framework", *[f"pos_{m}" for m in _BOARD_COLUMNS], "rank_sum", "overall_rank")


@query(
    "eval_gate",
    "SELECT framework, round(a, 9) AS trajectory_score, round(b, 9) AS nondeterminism_variance, round(a, 9) >= 0.6 AND round(b, 9) >= 0.05 AS passes FROM (SELECT framework, coalesce(avg(trajectory_score), 0e0) AS a, coalesce(avg(nondeterminism_variance), 0e0) AS b FROM f_runs GROUP BY framework)",
    _BOARDED,
)
def eval_gate(spark, d):
    return r9(leaderboard.gate(runs(spark, d), {"trajectory_score": 0.6, "nondeterminism_variance": 0.05}, ["framework"]), "trajectory_score", "nondeterminism_variance")


# --- triggers ----------------------------------------------------------------------------------------------------


def _has_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def trigger_sql(frame: str, source: str, output: str) -> str:
    """The four checks of each step; the most severe one that fires, the first of equals."""
    return f"""{frame} AS (SELECT * FROM (SELECT *,
      greatest(coalesce(s1, -1), coalesce(s2, -1), coalesce(s3, -1), coalesce(s4, -1)) AS most,
      CASE greatest(coalesce(s1, -1), coalesce(s2, -1), coalesce(s3, -1), coalesce(s4, -1)) WHEN -1 THEN NULL WHEN s1 THEN '{K.TRIGGERS[0]}' WHEN s2 THEN '{K.TRIGGERS[1]}' WHEN s3 THEN '{K.TRIGGERS[2]}' WHEN s4 THEN '{K.TRIGGERS[3]}' END AS kind
    FROM (SELECT *, CASE WHEN domain IN ('medical', 'legal') THEN 2 WHEN domain IS NOT NULL THEN 1 END AS s4 FROM (
      SELECT *, CASE WHEN confidence < 0.5 THEN 3 WHEN confidence < 0.6 THEN 2 WHEN confidence < 0.7 THEN 1 END AS s1,
        CASE WHEN {_has_sql('action', K.SAFETY_KEYWORDS)} THEN CASE WHEN {_has_sql('action', K.CRITICAL_SAFETY)} THEN 3 WHEN {_has_sql('action', K.HIGH_SAFETY)} THEN 2 ELSE 1 END END AS s2,
        CASE WHEN action <> '' AND action NOT IN ({names_sql(K.KNOWN_TOOLS)}) THEN 1 END AS s3,
        CASE WHEN {_has_sql('said', K.DOMAIN_KEYWORDS['medical'])} THEN 'medical' WHEN {_has_sql('said', K.DOMAIN_KEYWORDS['legal'])} THEN 'legal' WHEN {_has_sql('said', K.DOMAIN_KEYWORDS['financial'])} THEN 'financial' END AS domain
      FROM (SELECT *, action || ' ' || lower({output}) AS said FROM {source})))))"""


#: What a step put out: a domain's words now and then.
OUTPUT = "CASE event_id % 7 WHEN 0 THEN 'bpm high' WHEN 1 THEN 'audit due' WHEN 2 THEN 'payment ok' ELSE 'fine' END"
_TRIGGER = trigger_sql("f_trigger", "f_steps", OUTPUT)


def triggered(spark: SparkSession, d: str) -> DataFrame:
    return triggers.with_trigger(V.steps(spark, d).withColumn("output", F.expr(OUTPUT)), output="output")


@query(
    "hitl_steps",
    f"SELECT event_id, kind AS trigger_type, list_extract(['low', 'medium', 'high', 'critical'], most + 1) AS severity, CASE WHEN kind = '{K.TRIGGERS[3]}' THEN domain END AS domain FROM f_trigger WHERE kind IS NOT NULL",
    (V.STEPS, _TRIGGER),
)
def hitl_steps(spark, d):
    return triggered(spark, d).where("trigger_type is not null").select("event_id", "trigger_type", "severity", "domain")


@query(
    "hitl_summary",
    f"SELECT count(kind) AS n_triggers, {', '.join(f'''sum(CASE WHEN kind = '{t}' THEN 1 ELSE 0 END)::BIGINT AS {t}''' for t in K.TRIGGERS)}, sum(CASE WHEN most = 3 THEN 1 ELSE 0 END)::BIGINT AS critical, sum(CASE WHEN most = 2 THEN 1 ELSE 0 END)::BIGINT AS high, round(count(kind) / count(*)::DOUBLE, 4) AS rate FROM f_trigger",
    (V.STEPS, _TRIGGER),
)
def hitl_summary(spark, d):
    return triggers.trigger_summary(triggered(spark, d)).withColumn("rate", F.round("rate", 4))


# --- policies ----------------------------------------------------------------------------------------------------

_EMERGENCY = f"len(list_intersect(keywords, [{names_sql(K.EMERGENCY_WORDS)}])) > 0"
_SENSITIVE = f"len(list_intersect(keywords, [{names_sql(K.SENSITIVE_WORDS)}])) > 0"


def _vital_sql(emergency: str, alert: str, calm: str) -> str:
    return f"CASE WHEN (heart_rate > 160 OR spo2 < 88) AND {_EMERGENCY} THEN {emergency} WHEN heart_rate > 140 OR spo2 < 92 THEN {alert} ELSE {calm} END"


MULTI = f"""f_multi AS (SELECT *,
    CASE WHEN scenario = 'ambient_noise' THEN 'adjust_noise_profile' WHEN scenario = 'health_alert' THEN {_vital_sql("'escalate_to_emergency'", "'send_alert'", "'log_and_monitor'")}
      WHEN scenario IN ('privacy_sensitive', 'location_trigger') THEN CASE WHEN consent = 'revoked' THEN 'suppress_capture' WHEN consent = 'ambient' AND {_SENSITIVE} THEN 'request_consent' WHEN scenario = 'location_trigger' THEN 'trigger_geofence' ELSE 'suppress_capture' END
      ELSE 'surface_reminder' END AS multi_action,
    CASE WHEN scenario = 'ambient_noise' THEN CASE WHEN noise_db > 85 THEN 0.90e0 ELSE 0.80e0 END WHEN scenario = 'health_alert' THEN {_vital_sql("0.95e0", "0.85e0", "0.78e0")}
      WHEN scenario IN ('privacy_sensitive', 'location_trigger') THEN CASE WHEN consent = 'revoked' THEN 0.99e0 WHEN consent = 'ambient' AND {_SENSITIVE} THEN 0.87e0 WHEN scenario = 'location_trigger' THEN 0.88e0 ELSE 0.82e0 END
      ELSE 0.92e0 END AS multi_confidence,
    CASE WHEN scenario IN ('health_alert', 'ambient_noise') THEN 'health_check' WHEN scenario IN ('privacy_sensitive', 'location_trigger') THEN 'privacy_check' ELSE 'action_step' END AS route,
    CASE WHEN scenario IN ('health_alert', 'privacy_sensitive', 'location_trigger') THEN 5 ELSE 4 END AS handoff_quality,
    CASE WHEN scenario = 'health_alert' THEN {_vital_sql("'escalate_to_emergency'", "'send_alert'", "'log_and_monitor'")} WHEN scenario = 'privacy_sensitive' THEN CASE WHEN consent = 'revoked' THEN 'suppress_capture' ELSE 'log_and_monitor' END
      WHEN scenario = 'location_trigger' THEN 'trigger_geofence' WHEN scenario = 'ambient_noise' THEN CASE WHEN noise_db > 85 THEN 'adjust_noise_profile' ELSE 'log_and_monitor' END ELSE 'surface_reminder' END AS single_action
  FROM f_items)"""


def _compliant_sql(action: str) -> str:
    return f"CASE WHEN consent = 'revoked' THEN {action} = 'suppress_capture' WHEN consent = 'ambient' AND {_SENSITIVE} THEN {action} IN ('suppress_capture', 'request_consent') ELSE true END"


@query("health_policy", "SELECT traj, route, multi_action, multi_confidence, handoff_quality FROM f_multi", (V.ITEMS, MULTI))
def health_policy(spark, d):
    return policy.several_agents(V.items(spark, d)).select("traj", "route", "multi_action", "multi_confidence", "handoff_quality")


@query(
    "consent_policy",
    f"""SELECT traj, consent = 'revoked' OR (scenario = 'privacy_sensitive' AND consent = 'ambient') AS blocked, {_compliant_sql('ground_truth')} AS compliant,
        CASE WHEN consent = 'revoked' AND ground_truth NOT IN ('suppress_capture', 'request_consent') THEN 'non_compliant' WHEN consent = 'ambient' AND ground_truth IN ('log_and_monitor', 'trigger_geofence') THEN 'non_compliant' ELSE 'compliant' END AS suggestion FROM f_items""",
    (V.ITEMS,),
)
def consent_policy(spark, d):
    rows = V.items(spark, d)
    return rows.select("traj", policy.capture_gate()["blocked"].alias("blocked"), policy.compliant(F.col("ground_truth")).alias("compliant"), policy.compliance_suggestion(F.col("ground_truth"), F.col("consent"))["label"].alias("suggestion"))


_SIDES = f"""SELECT *, CASE WHEN multi_action IN ({names_sql(K.TERMINAL_ACTIONS)}) THEN 1e0 ELSE 0e0 END + CASE WHEN {_compliant_sql('multi_action')} THEN 1e0 ELSE 0e0 END AS m,
    CASE WHEN single_action IN ({names_sql(K.TERMINAL_ACTIONS)}) THEN 1e0 ELSE 0e0 END + CASE WHEN {_compliant_sql('single_action')} THEN 1e0 ELSE 0e0 END AS s FROM f_multi"""


@query(
    "single_vs_multi",
    f"SELECT scenario, count(*) AS n, round(avg(m) / 2, 9) AS multi, round(avg(s) / 2, 9) AS single, round(avg(m - s) / 2, 9) AS delta, sum(CASE WHEN m > s THEN 1 ELSE 0 END)::BIGINT AS multi_wins, sum(CASE WHEN m = s THEN 1 ELSE 0 END)::BIGINT AS ties FROM ({_SIDES}) GROUP BY scenario",
    (V.ITEMS, MULTI),
)
def single_vs_multi(spark, d):
    rows = policy.one_agent(policy.several_agents(V.items(spark, d)))
    side = lambda a: (F.col(a).isin(*K.TERMINAL_ACTIONS).cast("double") + policy.compliant(F.col(a)).cast("double")) / 2
    rows = rows.withColumns({"m": side("multi_action"), "s": side("single_action")}).withColumn("w", policy.winner(F.col("m"), F.col("s"), "multi", "single"))
    out = rows.groupBy("scenario").agg(
        F.count("*").alias("n"), F.avg("m").alias("multi"), F.avg("s").alias("single"), F.avg(F.col("m") - F.col("s")).alias("delta"), F.sum((F.col("w") == "multi").cast("int")).alias("multi_wins"), F.sum((F.col("w") == "tie").cast("int")).alias("ties")
    )
    return r9(out, "multi", "single", "delta")


@query(
    "role_attribution",
    """SELECT conv_id, n_roles, round(authority_rate, 9) AS authority_rate, round(mean_delegation, 9) AS mean_delegation, handoff, CASE WHEN goal OR accountable THEN 1e0 ELSE 0e0 END AS coverage, NOT goal AND NOT accountable AS cascade_risk
       FROM (SELECT conv_id, count(*) AS n_roles, avg(CASE WHEN authority_appropriate THEN 1e0 ELSE 0e0 END) AS authority_rate, avg(delegation_quality) AS mean_delegation, bool_or(accountability_clear) AS accountable, bool_or(goal_achieved) AS goal,
             arg_min(handoff_quality, pos) FILTER (agent_role = 'orchestrator') AS handoff FROM f_roles GROUP BY conv_id)""",
    (V.ROLES,),
)
def role_attribution(spark, d):
    return r9(policy.attribution(V.roles(spark, d), ["conv_id"]), "authority_rate", "mean_delegation").select("conv_id", "n_roles", "authority_rate", "mean_delegation", "handoff", "coverage", "cascade_risk")


# --- calibration -------------------------------------------------------------------------------------------------

_HOT = f"f_hot AS (SELECT *, row_number() OVER (ORDER BY round(kappa, 9), dim) AS rank FROM {fleiss_sql('f_labels')})"


@query(
    "hotspots",
    """SELECT dim, rank, item, item_rank, round(variance, 9) AS variance FROM (SELECT v.*, h.rank, row_number() OVER (PARTITION BY v.dim ORDER BY round(variance, 9) DESC, item) AS item_rank
       FROM (SELECT dim, item, var_samp(label) AS variance FROM f_labels GROUP BY ALL) v JOIN f_hot h USING (dim) WHERE h.rank <= 3) WHERE item_rank <= 3""",
    (V.ANNOTATIONS, LABELS, _HOT),
)
def hotspots(spark, d):
    rows = labels(spark, d)
    return r9(calibration.hotspots(rows, agreement.fleiss(rows, ["dim"])), "variance").select("dim", "rank", "item", "item_rank", "variance")


_NORM = "f_norm AS (SELECT item, avg((label - 1) / 3e0) AS score FROM f_gaps WHERE label IS NOT NULL GROUP BY item HAVING count(*) = 20)"


_ANCHORS = (
    """f_good AS (SELECT item, score, 'clearly_good' AS tier FROM f_norm ORDER BY CASE WHEN round(score, 9) > 0.85 THEN 0 ELSE 1 END, round(score, 9) DESC, item LIMIT 2)""",
    """f_bad AS (SELECT item, score, 'clearly_bad' AS tier FROM f_norm WHERE item NOT IN (SELECT item FROM f_good) ORDER BY CASE WHEN round(score, 9) < 0.35 THEN 0 ELSE 1 END, round(score, 9), item LIMIT 2)""",
    """f_middle AS (SELECT item, score, 'borderline' AS tier FROM f_norm WHERE item NOT IN (SELECT item FROM f_good UNION ALL SELECT item FROM f_bad)
       ORDER BY CASE WHEN round(score, 9) BETWEEN 0.45 AND 0.55 THEN 0 ELSE 1 END, abs(round(score, 9) - 0.5), item LIMIT 1)""",
    "f_anchors AS (FROM f_good UNION ALL FROM f_bad UNION ALL FROM f_middle)",
)


@query("anchors", "SELECT item, tier, round(score, 4) AS score FROM f_anchors", (V.ANNOTATIONS, GAPS, _NORM, *_ANCHORS))
def anchors(spark, d):
    scores = calibration.normalised(labels(spark, d, False), 20)
    return calibration.anchors(scores).select("item", "tier", F.round("score", 4).alias("score"))


_GOLD = "f_gold AS (SELECT item, dim, round_even(quantile_cont(label, 0.5), 0)::INTEGER AS gold FROM f_gaps WHERE label IS NOT NULL GROUP BY item, dim)"


@query("gold_scores", "SELECT item, dim, gold FROM f_gold", (V.ANNOTATIONS, GAPS, _GOLD))
def gold_scores(spark, d):
    return calibration.gold(labels(spark, d, False).where("label is not null"))


_ANCHOR_GOLD = "f_anchor_gold AS (SELECT g.item, g.dim, g.gold FROM f_gold g JOIN f_anchors a ON a.item = g.item)"
_MEAN_GOLD = "f_mean_gold AS (SELECT dim, avg(gold) AS mean_gold FROM f_anchor_gold GROUP BY dim)"
_CALIBRATED = (V.ANNOTATIONS, LABELS, GAPS, _NORM, *_ANCHORS, _GOLD, _ANCHOR_GOLD, _MEAN_GOLD)


def anchor_gold(spark: SparkSession, d: str) -> DataFrame:
    """The gold scores of the anchors only."""
    rows = labels(spark, d, False)
    chosen = calibration.anchors(calibration.normalised(rows, 20)).select("item")
    return calibration.gold(rows.where("label is not null").join(F.broadcast(chosen), "item", "left_semi"))  # five items


@query(
    "calibrated_scores",
    """SELECT l.item, l.dim, l.rater, greatest(1, least(4, round_even(0.82e0 * coalesce(g.gold, round_even(m.mean_gold, 0), 2) + (1 - 0.82e0) * l.label, 0)::INTEGER)) AS calibrated
       FROM f_labels l LEFT JOIN f_anchor_gold g ON g.item = l.item AND g.dim = l.dim LEFT JOIN f_mean_gold m ON m.dim = l.dim""",
    _CALIBRATED,
)
def calibrated_scores(spark, d):
    return calibration.pulled(labels(spark, d), anchor_gold(spark, d))


@query("mean_gold", "SELECT dim, round(mean_gold, 9) AS mean_gold FROM f_mean_gold", _CALIBRATED)
def mean_gold(spark, d):
    return r9(calibration.mean_gold(anchor_gold(spark, d)), "mean_gold")


# --- texts -------------------------------------------------------------------------------------------------------


def _count_sql(words) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words)


_TOPIC = f"""CASE WHEN greatest(h, c, a) = 0 THEN 'general_task' WHEN h = greatest(h, c, a) THEN 'health_safety' WHEN c = greatest(h, c, a) THEN 'coding' ELSE 'creative' END"""
_TOPICS = f"""f_topics AS (SELECT *, {_TOPIC} AS topic FROM (SELECT doc_id, lang, {_count_sql(K.TOPIC_KEYWORDS['health_safety'])} AS h, {_count_sql(K.TOPIC_KEYWORDS['coding'])} AS c, {_count_sql(K.TOPIC_KEYWORDS['creative'])} AS a FROM documents WHERE text IS NOT NULL))"""


@query("topic", "SELECT lang, topic, count(*) AS n FROM f_topics GROUP BY ALL", (_TOPICS,))
def topic(spark, d):
    return V.read(spark, d, "documents").where("text is not null").groupBy("lang", T.topic(F.col("text")).alias("topic")).agg(F.count("*").alias("n"))


@query(
    "disagreement_matrix",
    "SELECT topic, dim, round(coalesce(avg(sd), 0e0), 9) AS disagreement FROM (SELECT f_items.scenario AS topic, dim, item, stddev_samp(label) AS sd FROM f_gaps JOIN f_items ON traj = item GROUP BY ALL) GROUP BY ALL",
    (V.ANNOTATIONS, GAPS, V.ITEMS),
)
def disagreement_matrix(spark, d):
    rows = labels(spark, d, False).join(V.items(spark, d).select(F.col("traj").alias("item"), F.col("scenario").alias("topic")), "item")
    return r9(calibration.disagreement(rows), "disagreement")


# --- datasets ----------------------------------------------------------------------------------------------------


@query(
    "dataset_union_join",
    """SELECT a.traj AS log_id, p.phase AS calibration_phase, a.rater AS persona_name, a.score::TINYINT AS step_quality, f.n AS n_trajectory_steps, f.final_action, round(f.mean_confidence, 9) AS mean_step_confidence
       FROM f_ann a, (SELECT unnest(['pre', 'post']) AS phase) p LEFT JOIN f_layers f ON f.traj = a.traj WHERE a.dim = 'step_quality'""",
    (*_LAYERED, V.ANNOTATIONS),
)
def dataset_union_join(spark, d):
    a = V.annotations(spark, d).where("dim = 'step_quality'").select(F.col("traj").alias("log_id"), F.col("rater").alias("persona_name"), F.col("score").alias("step_quality"))
    facts = dataset.trajectory_facts(V.steps(spark, d).withColumnRenamed("traj", "log_id"), ["log_id"])
    out = dataset.assemble(dataset.union_phases(a, a), facts, ["log_id"], ["log_id", "calibration_phase", "persona_name", "step_quality", "n_trajectory_steps", "final_action", "mean_step_confidence"], ["step_quality"])
    return r9(out, "mean_step_confidence")


@query("dedup_first", "SELECT traj, event_id, action FROM (SELECT *, row_number() OVER (PARTITION BY traj, action ORDER BY step_index) AS k FROM f_steps) WHERE k = 1", (V.STEPS,))
def dedup_first(spark, d):
    return dataset.first_of(V.steps(spark, d), ["traj", "action"], ["step_index"]).select("traj", "event_id", "action")


@query("exact_dedup", "SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, d):
    return dataset.exact_copies(V.read(spark, d, "documents"))


@query("orphan_labels", "SELECT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)")
def orphan_labels(spark, d):
    return dataset.orphans(V.read(spark, d, "labels").select("doc_id"), V.read(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("unlabelled_documents", "SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id) GROUP BY source")
def unlabelled_documents(spark, d):
    rows = dataset.orphans(V.read(spark, d, "documents").select("doc_id", "source"), V.read(spark, d, "labels").select("doc_id"), ["doc_id"])
    return rows.groupBy("source").agg(F.count("*").alias("n"))


# --- privacy -----------------------------------------------------------------------------------------------------


@query("dp_sigma", "SELECT event_id, round(10 * sqrt(2 * ln(1.25e0 / 1e-5)) / (0.1e0 + event_id % 10), 9) AS sigma FROM events")
def dp_sigma(spark, d):
    e = V.read(spark, d, "events")
    return e.select("event_id", F.round(privacy.sigma_of(F.lit(10.0), 0.1 + F.col("event_id") % 10, F.lit(1e-5)), 9).alias("sigma"))


@query("dp_budget", "SELECT user_id, round(sum(value / 100), 9) AS spent, round(sum(value / 100), 9) <= 25 AS within FROM events GROUP BY user_id")
def dp_budget(spark, d):
    return r9(privacy.budget(V.read(spark, d, "events").select("user_id", (F.col("value") / 100).alias("epsilon")), ["user_id"], 25.0), "spent")


@query("dp_noise")
def dp_noise(spark, d):
    return privacy.sanitise(V.items(spark, d).select("traj", "consent", "heart_rate", "spo2", "noise_db"), "traj", 1.0, 1e-5)


# --- vectors ------------------------------------------------------------------------------------------------------


@query(
    "vector_agreement",
    """SELECT x.vec_id, round(list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)), 9) AS f1 FROM
       (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) x JOIN (SELECT vec_id - 1 AS vec_id, embedding::DOUBLE[] AS e FROM embeddings) y USING (vec_id)""",
)
def vector_agreement(spark, d):
    e = V.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("g")), "vec_id")
    return both.select("vec_id", F.round(dot("e", "g") / F.sqrt(dot("e", "e") * dot("g", "g")), 9).alias("f1"))


# --- metrics that are only described -----------------------------------------------------------------------------

_WEIGHT = "CASE consent WHEN 'explicit' THEN 1e0 WHEN 'implied' THEN 0.85e0 WHEN 'ambient' THEN 0.65e0 ELSE 0e0 END"


def _consent_weight() -> Column:
    c = F.col("consent")
    return F.when(c == "explicit", 1.0).when(c == "implied", 0.85).when(c == "ambient", 0.65).otherwise(0.0)


@query("cats", f"SELECT traj, round(avg(confidence * {_WEIGHT} * CASE WHEN action = 'mystery_tool' THEN 0e0 ELSE 1e0 END), 9) AS trust, round(avg(confidence * {_WEIGHT} * CASE WHEN action = 'mystery_tool' THEN 0e0 ELSE 1e0 END), 9) >= 0.6 AS passes FROM f_steps GROUP BY traj", (V.STEPS,))
def cats(spark, d):
    v = F.col("confidence") * _consent_weight() * F.when(F.col("action") == "mystery_tool", 0.0).otherwise(1.0)
    return V.steps(spark, d).groupBy("traj").agg(F.round(F.avg(v), 9).alias("trust")).withColumn("passes", F.col("trust") >= 0.6)


@query(
    "ambient_rates",
    f"""SELECT scenario, round(avg(CASE WHEN consent = 'revoked' OR (scenario = 'privacy_sensitive' AND consent = 'ambient') THEN 0e0 ELSE 1e0 END), 9) AS consent_gate_pass_rate,
        round(avg(CASE WHEN {_compliant_sql('multi_action')} THEN 1e0 ELSE 0e0 END), 9) AS consent_adherence,
        round(avg(CASE WHEN multi_action = 'send_alert' THEN CASE WHEN ground_truth <> 'send_alert' THEN 1e0 ELSE 0e0 END END), 9) AS false_positive_rate,
        round(avg(CASE WHEN multi_action = ground_truth THEN (1 + multi_confidence) / 2 ELSE 0e0 END), 9) AS context_adaptive_rate FROM f_multi GROUP BY scenario""",
    (V.ITEMS, MULTI),
)
def ambient_rates(spark, d):
    rows = policy.several_agents(V.items(spark, d))
    hit = F.col("multi_action") == F.col("ground_truth")
    out = rows.groupBy("scenario").agg(
        F.avg((~policy.capture_gate()["blocked"]).cast("double")).alias("consent_gate_pass_rate"),
        F.avg(policy.compliant(F.col("multi_action")).cast("double")).alias("consent_adherence"),
        F.avg(F.when(F.col("multi_action") == "send_alert", (F.col("ground_truth") != "send_alert").cast("double"))).alias("false_positive_rate"),
        F.avg(F.when(hit, (1 + F.col("multi_confidence")) / 2).otherwise(0.0)).alias("context_adaptive_rate"),
    )
    return r9(out, "consent_gate_pass_rate", "consent_adherence", "false_positive_rate", "context_adaptive_rate")
