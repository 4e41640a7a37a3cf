"""What a grounding judge is given: an agent's response and the sources it should rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T

NO_REASONING = "No reasoning recorded."


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def step_texts(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, response (each step's name and reasoning, else observation, in order), observations.

    A trajectory's steps are gathered: they are its row in the log.
    """
    said = F.when(_filled(F.col("reasoning")), F.col("reasoning")).when(_filled(F.col("observation")), F.col("observation"))
    part = F.when(said.isNotNull(), F.concat(F.coalesce("step_name", F.lit("step")), F.lit(": "), said))
    seen = F.when(_filled(F.col("observation")), F.col("observation"))
    own = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step_index", part.alias("part"), seen.alias("seen")))).alias("s"))
    texts = lambda name: F.filter(F.transform("s", lambda x: x[name]), lambda x: x.isNotNull())
    response = F.array_join(texts("part"), " ")
    return own.select(*keys, F.when(response == "", NO_REASONING).otherwise(response).alias("response"), texts("seen").alias("observations"))


def sources(observations: Column, sensors: dict[str, Column], scenario: Column, meta: dict[str, Column]) -> Column:
    """Observations, the sensors' readings as one text (the scenario where there are none), and what is known beside them."""
    readings = F.concat_ws(", ", *[F.concat(F.lit(f"{name}="), T.four_digits(value)) for name, value in sensors.items()])
    context = F.when(readings == "", F.concat(F.lit("scenario: "), F.coalesce(scenario, F.lit("unknown")))).otherwise(readings)
    known = F.filter(F.array(*[F.when(_filled(v.cast("string")), F.concat(F.lit(f"{name}: "), v.cast("string"))) for name, v in meta.items()]), lambda x: x.isNotNull())
    return F.concat(observations, F.array(context), known)


def layer_response(reasons: dict[str, Column]) -> Column:
    """The layers' reasons in order; those that are missing or empty are left out."""
    text = F.concat_ws(" ", *[F.when(_filled(reasons[x]), F.concat(F.lit(f"{x}: "), reasons[x])) for x in K.LAYERS])
    return F.when(text == "", NO_REASONING).otherwise(text)


def layer_sources(scenario: Column, consent: Column, n_steps: Column, total: Column) -> Column:
    """What is known of a trajectory. The total has four places: its first nine as a decimal number, halves up."""
    named = lambda c: F.coalesce(c, F.lit("unknown"))
    return F.array(
        F.concat(F.lit("Scenario type: "), named(scenario), F.lit(".")),
        F.concat(F.lit("Consent model: "), named(consent), F.lit(".")),
        F.format_string("Steps taken: %d.", F.coalesce(n_steps, F.lit(0)).cast("long")),
        F.format_string("Trajectory weighted total: %.4f.", F.round(F.round(F.coalesce(total, F.lit(0.0)), 9), 4)),
    )
