"""Typed memory layers of parsed extractor output: events, transfers, state changes, threads, visibility, canonical memory.

Extractors answer in JSON of their own making: an element of a list may be an object or a bare text. A layer declares
its fields and the one that takes a bare text, and everything else is one explode.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import whole_record_contains
from ..functions.text import alias_key, text_of
from .ranking import numbered

#: Layers by name: the list in the answer, the tag in record ids, text fields, list fields, and the field of a bare text (fixed values).
EVENT_LAYERS = {
    "events": ("events", "event", ("event_id_hint", "summary", "location", "event_type", "evidence"), ("participants",), "summary"),
    "knowledge_transfers": ("knowledge_transfers", "kt", ("source", "receiver", "content", "epistemic_status", "evidence"), (), "content"),
    "state_changes": ("state_changes", "state", ("entity", "before", "after", "evidence"), (), "entity"),
    "thread_candidates": ("thread_candidates", "thread", ("thread_type", "summary", "evidence"), (), "summary"),
}
VISIBILITY_LAYERS = {
    "visibility_records": ("visibility_records", "vis", ("fact_or_event", "character", "visibility", "evidence"), (), "fact_or_event"),
    "hidden_items": ("hidden_or_future_sensitive_items", "hidden", ("item", "fact_or_event", "summary", "content", "reason", "evidence"), ("hidden_from",), "item"),
}


def accepted(outputs: DataFrame, status: str = "status", data: str = "data", name: str = "name") -> DataFrame:
    """``scene_id, data``: parsed answers (objects only) with their scene: the answer's own, else the record's, else the file's name.

    ``outputs``: status, data (JSON text), and any of unit_id, scene_id, name.
    """
    own = [F.get_json_object(data, f"$.{f}") for f in ("unit_id", "scene_id")]
    given = [F.col(c) for c in ("unit_id", "scene_id", name) if c in outputs.columns]
    ok = (F.col(status) == "parsed") & F.ltrim(text_of(data)).startswith("{")
    return outputs.where(ok).select(F.coalesce(*(F.nullif(text_of(c), F.lit("")) for c in (*own, *given))).alias("scene_id"), F.col(data).alias("data"))


def layer(answers: DataFrame, array: str, tag: str, fields: Sequence[str], lists: Sequence[str] = (), bare: str | None = None, memory_layer: str = "staged_extraction") -> DataFrame:
    """One row per element of a list in the answers: ``memory_layer, scene_id, item_index, record_id`` and the declared fields.

    A missing field is empty, a field that is no list an empty list; an element that is no object goes to ``bare``.
    """
    raw = F.get_json_object("data", f"$.{array}")
    elements = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))
    rows = answers.select("scene_id", F.posexplode(elements).alias("at", "item"))
    whole = F.ltrim(text_of("item")).startswith("{")
    text = lambda f: F.coalesce(F.get_json_object("item", f"$.{f}"), F.lit(""))
    some = lambda f: F.get_json_object("item", f"$.{f}")
    values = [F.when(whole, text(f)).otherwise(text_of("item") if f == bare else F.lit("")).alias(f) for f in fields]
    none = F.array().cast("array<string>")
    values += [F.coalesce(F.when(whole & F.ltrim(some(f)).startswith("["), F.from_json(some(f), "array<string>")), none).alias(f) for f in lists]
    record = F.concat(text_of("scene_id"), F.format_string(f"_{tag}_%03d", F.col("at") + 1))
    return rows.select(F.lit(memory_layer).alias("memory_layer"), "scene_id", (F.col("at") + 1).alias("item_index"), record.alias("record_id"), *values)


def _layers(answers: DataFrame, layers: Mapping[str, tuple], memory_layer: str) -> dict[str, DataFrame]:
    return {name: layer(answers, *spec, memory_layer) for name, spec in layers.items()}


def scene_events(outputs: DataFrame) -> dict[str, DataFrame]:
    """Events, knowledge transfers, state changes and thread candidates of parsed answers."""
    return _layers(accepted(outputs), EVENT_LAYERS, "staged_event_extraction")


def visibility(outputs: DataFrame) -> dict[str, DataFrame]:
    """Who may know what, and items hidden from characters; a hidden item's text is the first of its possible names."""
    made = _layers(accepted(outputs), VISIBILITY_LAYERS, "staged_visibility_extraction")
    h = made["hidden_items"]
    first = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("item", "fact_or_event", "summary", "content")), F.lit(""))
    made["hidden_items"] = h.select("memory_layer", "scene_id", "item_index", "record_id", first.alias("item"), "hidden_from", "reason", "evidence")
    return made


def hidden_pairs(hidden: DataFrame) -> DataFrame:
    """``record_id, hidden_from``: one row for each character that an item is hidden from, as ``visible_to`` takes them."""
    return hidden.select("record_id", F.explode("hidden_from").alias("hidden_from"))


def counts(outputs: DataFrame, layers: Mapping[str, DataFrame]) -> DataFrame:
    """One row: files, accepted and skipped scenes, and the rows of every layer."""
    ok = (F.col("status") == "parsed") & F.ltrim(text_of("data")).startswith("{")
    out = outputs.agg(F.count("*").alias("parsed_files"), F.count_if(F.coalesce(ok, F.lit(False))).alias("accepted_scene_count"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("skipped_scene_count"))
    for name, rows in layers.items():
        out = out.join(F.broadcast(rows.agg(F.count("*").alias(f"{name}_count"))))  # one row
    return out


def canonical_entities(mentions: DataFrame, kind: str, order: Sequence[Column]) -> DataFrame:
    """Mentions (name, scene_id) of one kind as entities by normalised name: numbered ids, first surface, aliases, scenes."""
    named = mentions.withColumn("name", F.trim(text_of("name"))).where("name <> ''")
    once = named.groupBy(alias_key("name").alias("__key")).agg(F.min_by("name", F.struct(*order)).alias("canonical_name"), F.array_sort(F.collect_set("name")).alias("aliases"), F.array_sort(F.collect_set("scene_id")).alias("scene_ids"), F.count("*").alias("mention_count"))
    placed = numbered(once, ["__key"], "__n")
    return placed.select(F.lit("canonical_prefix").alias("memory_layer"), F.format_string(f"{kind}_%04d", "__n").alias("entity_id"), F.lit(kind).alias("entity_type"), "canonical_name", "aliases", "scene_ids", "mention_count")


def canonical_memory(staged: Mapping[str, DataFrame], order: Sequence[Column]) -> dict[str, DataFrame]:
    """The canonical memory of staged layers (scenes, characters, objects, stated_facts, open_questions): names are one entity if they are the same but for case and space."""
    return {
        "scenes": staged["scenes"],
        "characters": canonical_entities(staged["characters"], "character", order),
        "objects": canonical_entities(staged["objects"], "object", order),
        "stated_facts": staged["stated_facts"],
        "open_questions": staged["open_questions"],
    }


def query_memory(memory: Mapping[str, DataFrame], text: str = "", character: str | None = None, scene_id: str | None = None, limit: int = 10) -> dict[str, DataFrame]:
    """Records whose JSON holds a text, in a scene if one is given; with a character, its entity and what its scenes hold."""
    query, who = text.strip().lower(), (character or "").strip().lower()
    holds = lambda df, q: df.where(whole_record_contains(F.struct(*df.columns), q)) if q else df
    inside = lambda df: df.where(F.col("scene_id") == scene_id) if scene_id else df
    out = {
        "scenes": holds(inside(memory["scenes"]), query),
        "characters": holds(memory["characters"], query or who),
        "objects": holds(memory["objects"], query),
        "stated_facts": holds(inside(memory["stated_facts"]), query or who),
        "open_questions": holds(inside(memory["open_questions"]), query),
    }
    if who:
        out["characters"] = memory["characters"].where(F.contains(F.lower("canonical_name"), F.lit(who)))
        near = out["characters"].select(F.explode("scene_ids").alias("scene_id")).distinct()
        out |= {name: memory[name].join(near, "scene_id", "left_semi") for name in ("scenes", "stated_facts")}
    key = {"characters": "entity_id", "objects": "entity_id", "scenes": "scene_id"}
    return {name: df.orderBy(key.get(name, "record_id")).limit(limit) for name, df in out.items()}
