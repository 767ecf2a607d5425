"""Extraction runs over ordered units, as waves: what one wave answers is part of the next wave's prompts.

Within a wave nothing depends on anything else, so a wave is one distributed call over all units and tasks, and not a
loop over units. What a unit may know of earlier units is the mentions of the wave before, carried forward in story order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import complete
from ..sources.readers import model_json
from .prefix import prior_mentions


def prompts_of(units: DataFrame, templates: Mapping[str, Column]) -> DataFrame:
    """``prompt_id, unit_id, task, prompt``: one row for each unit and task; a template is a column of the units."""
    rows = units.select("unit_id", F.explode(F.array(*(F.struct(F.lit(t).alias("task"), c.cast("string").alias("prompt")) for t, c in templates.items()))).alias("p"))
    return rows.select(F.concat_ws("|", "unit_id", "p.task").alias("prompt_id"), "unit_id", "p.task", "p.prompt")


def run_wave(units: DataFrame, templates: Mapping[str, Column], make_client: Callable, retries: int = 1) -> DataFrame:
    """``unit_id, task, status, data, error`` of a wave: parsed where the answer holds JSON, failed else."""
    prompts = prompts_of(units, templates)
    answers = complete(prompts, make_client, retries).withColumn("j", model_json("response"))
    parsed = F.when((F.col("status") == "ok") & F.col("j.ok"), "parsed").otherwise("failed")
    rows = answers.select("prompt_id", parsed.alias("status"), F.when(parsed == "parsed", F.col("j.data")).alias("data"), F.coalesce("error", "j.error").alias("error"))
    return prompts.select("prompt_id", "unit_id", "task").join(rows, "prompt_id").drop("prompt_id")


def answers_of(results: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """``unit_id`` and the parsed answer of each task as a column; null where it failed."""
    return results.groupBy("unit_id").agg(*(F.max(F.when((F.col("task") == t) & (F.col("status") == "parsed"), F.col("data"))).alias(t) for t in tasks))


def mentions_of(answers: DataFrame, column: str, units: DataFrame) -> DataFrame:
    """Entity mentions (name, entity_type) of a task's answers, with their unit's place in the run."""
    kind = "struct<entity_mentions: array<struct<surface: string, canonical_hint: string, entity_type: string>>>"
    rows = answers.select("unit_id", F.explode(F.from_json(column, kind)["entity_mentions"]).alias("m"))
    name = F.coalesce(F.nullif(F.trim("m.canonical_hint"), F.lit("")), F.trim("m.surface"))
    return rows.select("unit_id", name.alias("name"), F.col("m.entity_type").alias("entity_type")).where("name <> ''").join(units.select("run_id", "unit_id", "unit_index"), "unit_id")


def run_units(units: DataFrame, first: Mapping[str, Column], refine: tuple[str, Callable[[Column, Column], Column]], dependent: Mapping[str, Callable[[Column, Column], Column]], make_client: Callable, entities: str = "entities", carried: int = 40, retries: int = 1) -> tuple[DataFrame, DataFrame]:
    """An ordered run: ``unit_id, task, status, data, error`` of all tasks, and the mentions carried to each unit.

    ``units``: run_id, unit_id, unit_index and what the templates read. First the tasks of ``first``, one of which is
    ``entities``; then ``refine`` (task, and its template of the entities' answer and the carried mentions); then
    ``dependent`` on the refined entities, or the first ones where refining failed. Templates after the first wave get the
    answer and the mentions of earlier units, both as JSON text.
    """
    name, refined_template = refine
    one = run_wave(units, first, make_client, retries)
    answers = units.join(answers_of(one, list(first)), "unit_id")
    earlier = prior_mentions(mentions_of(answers.select("unit_id", entities), entities, units), ["run_id"], [F.col("name")], "unit_id", carried)
    context = earlier.groupBy("unit_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "entity_type", "mentions"))), lambda r: F.struct(r["name"].alias("name"), r["entity_type"].alias("entity_type"), r["mentions"].alias("mentions")))).alias("__carried"))
    ready = answers.join(context, "unit_id", "left").withColumn("__carried", F.coalesce("__carried", F.lit("[]"))).withColumn("__given", F.coalesce(entities, F.lit("{}")))
    two = run_wave(ready, {name: refined_template(F.col("__given"), F.col("__carried"))}, make_client, retries)
    better = ready.join(answers_of(two, [name]).withColumnRenamed(name, "__refined"), "unit_id").withColumn("__given", F.coalesce("__refined", "__given"))
    three = run_wave(better, {t: f(F.col("__given"), F.col("__carried")) for t, f in dependent.items()}, make_client, retries)
    return one.unionByName(two).unionByName(three), earlier
