"""Runs of agent frameworks: their steps in one schema, chains of tools by each framework's rule, and stand-in logs for scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .leaderboard import cascade_depth


def normalised(steps: DataFrame) -> DataFrame:
    """Adds canonical action, tool_calls and output; what a step has itself wins.

    A single tool is its list of calls and its action; a handoff's reason, then a task's name, is its action; what an
    agent said is its output.
    """
    single = F.col("tool").isNotNull() & F.col("tool_calls").isNull()
    calls = F.when(single, F.when(F.col("tool") != "", F.array("tool")).otherwise(F.array().cast("array<string>"))).otherwise(F.col("tool_calls"))
    reason = F.when(F.col("event_kind") == "handoff", F.coalesce("reason", F.lit("")))
    action = F.coalesce("action", F.when(single, F.col("tool")), reason, "task_name")
    return steps.withColumns({"action": action, "tool_calls": calls, "output": F.coalesce("output", "content")})


def uses_tool() -> Column:
    """Whether a step goes on with a chain of tools: calls, but for a human's turn; where events are named, tool calls only."""
    calls = F.size(F.coalesce("tool_calls", F.array().cast("array<string>"))) > 0
    human = F.coalesce(F.col("speaker") == "UserProxy", F.lit(False))
    return F.when(F.col("framework") == "autogen", calls & ~human).when(F.col("framework") == "openai_agents", F.coalesce(F.col("event_kind") == "tool_call", F.lit(False))).otherwise(calls)


def chains(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cascade_depth: the longest chain of tools without a human's turn."""
    return cascade_depth(steps, keys, uses_tool())


def stand_in_steps(runs: DataFrame) -> DataFrame:
    """A run (run, task, n_steps, goal_achieved) as the steps of a log: sense, plan, and act with the task's last action if the goal was met."""
    lookup = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    truth = F.coalesce(lookup(K.TASK_ACTIONS)[F.col("task")], F.lit("send_alert"))
    scenario = F.coalesce(lookup(K.TASK_SCENARIOS)[F.col("task")], F.lit("health_alert"))
    rows = runs.where("n_steps > 0").withColumn("step_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_steps") - 1)))
    acts = (F.col("step_index") == F.col("n_steps") - 1) & F.col("goal_achieved")
    name = F.when(acts, "act").when(F.col("step_index") == 0, "sense").otherwise("plan")
    return rows.select("run", "task", "n_steps", "step_index", scenario.alias("scenario"), truth.alias("truth"), name.alias("step_name"), F.when(acts, truth).otherwise("").alias("action"), F.lit(0.8).alias("confidence"))
