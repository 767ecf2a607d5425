"""Writers: JSON lines, partitioned tables, schemas, summaries, and packets and reports as markdown."""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def import_tables(tables: Mapping[str, DataFrame], root: str, partition: Mapping[str, str] = ()) -> DataFrame:
    """Write each frame as Parquet below ``root`` (partitioned where named) and return the counts that were written."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition[name]) if name in dict(partition) else w).parquet(f"{root}/{name}")
        counts.append(spark.read.parquet(f"{root}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def import_declared(tables: Mapping[str, DataFrame], declared: Mapping[str, str], root: str, partition: Mapping[str, str] = ()) -> DataFrame:
    """Write every declared table and return all counts: a table that is not given is written empty, columns that are not declared are left out.

    ``declared``: DDL by name, such as ``schemas.UNITS`` of a run or ``schemas.REFERENCES`` of a reference library. An undeclared
    table raises KeyError.
    """
    unknown = sorted(set(tables) - set(declared))
    if unknown:
        raise KeyError(f"not declared: {unknown}")
    spark = next(iter(tables.values())).sparkSession
    whole = {}
    for name, ddl in declared.items():
        kind = T.StructType.fromDDL(ddl)
        given = tables.get(name)
        whole[name] = spark.createDataFrame([], kind) if given is None else given.select(*((F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
    return import_tables(whole, root, partition)


_JSON_TYPES = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.FloatType: "number", T.DecimalType: "number", T.IntegerType: "integer", T.LongType: "integer", T.ShortType: "integer", T.ByteType: "integer"}


def json_schema(kind: T.DataType, nullable: bool = False) -> dict:
    """A type as JSON Schema: structs are objects that require what can't be null, maps objects of any names."""
    if isinstance(kind, T.StructType):
        own = {"type": "object", "properties": {f.name: json_schema(f.dataType, f.nullable) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable], "additionalProperties": False}
    elif isinstance(kind, T.ArrayType):
        own = {"type": "array", "items": json_schema(kind.elementType, kind.containsNull)}
    elif isinstance(kind, T.MapType):
        own = {"type": "object", "additionalProperties": json_schema(kind.valueType, kind.valueContainsNull)}
    elif isinstance(kind, (T.TimestampType, T.DateType)):
        own = {"type": "string", "format": "date-time" if isinstance(kind, T.TimestampType) else "date"}
    else:
        own = {"type": _JSON_TYPES.get(type(kind), "string")}
    return own | {"type": [own["type"], "null"]} if nullable else own


def schema_json(schemas: Mapping[str, T.StructType]) -> dict[str, str]:
    """JSON Schema texts by name."""
    return {name: json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name} | json_schema(s), ensure_ascii=False) for name, s in schemas.items()}


def write_schemas(schemas: Mapping[str, T.StructType], folder: str, enums: Mapping[str, Sequence[str]] = {}) -> list[str]:
    """Write one ``<name>.schema.json`` each and the closed vocabularies as ``enums.json``; returns the paths."""
    os.makedirs(folder, exist_ok=True)
    texts = {f"{name}.schema.json": text for name, text in schema_json(schemas).items()} | {"enums.json": json.dumps({k: sorted(v) for k, v in enums.items()}, ensure_ascii=False)}
    for name, text in texts.items():
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text + "\n")
    return [f"{folder}/{name}" for name in texts]


def unit_summary(units: DataFrame, location: str = "location_hint", content: str = "content", locations: int = 20) -> DataFrame:
    """One row: units, characters, distinct locations and the first of them."""
    return units.agg(F.count("*").alias("units"), F.coalesce(F.sum(F.length(content)), F.lit(0)).alias("characters"), F.count_distinct(location).alias("location_count"), F.slice(F.array_sort(F.collect_set(location)), 1, locations).alias("locations"))


def packet_markdown(title: str, items: DataFrame, sections: list[str]) -> str:
    """A packet (section, rank, statement) as markdown; a packet is small by its budget."""
    rows = items.select("section", "rank", "statement").orderBy("section", "rank").collect()
    lines = [f"# {title}", ""]
    for s in sections:
        own = [f"- {r.statement}" for r in rows if r.section == s]
        lines += [f"## {s.replace('_', ' ').title()}", *(own or ["- none"]), ""]
    return "\n".join(lines).rstrip() + "\n"


def memory_packet_markdown(parts: Mapping[str, DataFrame], query_id, memories: DataFrame) -> str:
    """One query's memory packet as markdown: entities, relations, labelled memories, scenes. A packet is small by its limits.

    ``parts``: see ``memory_packet``; ``memories``: memory_id, scene_id, summary.
    """
    own = lambda name, *order: parts[name].where(F.col("query_id") == query_id).orderBy(*order).collect()
    labelled = parts["memories"].where(F.col("query_id") == query_id)
    used = defaultdict(list)
    for r in labelled.where("entity_id IS NOT NULL").orderBy("entity_rank", "memory_rank").select("entity_id", "label").collect():
        used[r.entity_id].append(r.label)
    lines = ["# Memory Packet", "", "## Entities"]
    for e in own("entities", "entity_rank"):
        lines += ["", f"{e.canonical_name} ({e.entity_type})", *([f"- profile: {e.profile}"] if e.profile else []), *([f"- current state: {e.current_state}"] if e.current_state else []), f"- related memory index: {', '.join(used[e.entity_id]) or 'none'}"]
    relations = [f"- {r.source_entity_id} -> {r.target_entity_id}: {r.relation_type} ({r.last_order})" for r in own("relations", "source_entity_id", "target_entity_id", "relation_type")]
    reasons = [f"- diagnostic: {r.reason}" for r in own("diagnostics", "query_id") if r.reason]
    lines += ["", "## Relations", *(relations or ["- none", *reasons])]
    number = F.substr("label", F.lit(2)).cast("int")
    texts = labelled.select("label", "memory_id").distinct().join(memories.select("memory_id", "scene_id", "summary"), "memory_id").orderBy(number).collect()
    lines += ["", "## Extracted Episodic Memories", *([f"[{m.label}] {m.summary or ''} <{m.scene_id}>" for m in texts] or ["- none"])]
    lines += ["", "## Related Scene Summary", *([f"- <{s.scene_id}> score={s.best_score:.3f}" for s in own("scenes", "rank")] or ["- none"])]
    return "\n".join(lines) + "\n"


def context_markdown(packet: DataFrame, request: str = "") -> str:
    """A context packet (section, rank, item_id, source_type, statement) as markdown with its sources."""
    names = ("conversation_guidance", "artifact_memory", "character_visible_knowledge", "relationship_context", "timeline_context", "external_reference_context", "style_guidance", "open_questions", "simulation_context", "entity_patch_context")
    rows = packet.select("section", "rank", "item_id", "source_type", "statement").orderBy("section", "source_type", "rank").collect()
    lines = ["# Context Packet", "", *([f"Request: {request}", ""] if request else [])]
    for s in names:
        lines += [f"## {s.replace('_', ' ').title()}", *([f"- {r.statement}" for r in rows if r.section == s] or ["- none"]), ""]
    lines += ["## Source References", *([f"- {r.item_id} [{r.source_type}]" for r in rows] or ["- none"])]
    return "\n".join(lines) + "\n"


def cards_markdown(cards: DataFrame) -> str:
    """Character cards (name, field, value, status, refs) as markdown, by name and field."""
    lines, name, field = ["# Character Cards"], None, None
    for r in cards.orderBy("name", "field", "value").toLocalIterator():
        if r.name != name:
            lines += ["", f"## {r.name}"]
            name, field = r.name, None
        if r.field != field:
            lines.append(f"{r.field.replace('_', ' ')}:")
            field = r.field
        lines.append(f"- [{r.status}] {r.value}" + (f" ({', '.join(r.refs)})" if r.refs else ""))
    return "\n".join(lines) + "\n"


def social_markdown(edges: DataFrame, beats: DataFrame) -> str:
    """A scene's pressure edges and its chosen beats as markdown."""
    lines = ["# Social Plan", "", "## Pressure"]
    lines += [f"- {e.source} -> {e.target}: {e.kind} {e.strength:.3f}" for e in edges.orderBy(F.col("strength").desc(), "source", "target").toLocalIterator()] or ["- none"]
    lines += ["", "## Beats"]
    lines += [f"{b.beat_no}. {b.source} / {b.target or '-'}: {b.opener}" + (f", answered by {b.answer}" if b.answer else "") for b in beats.where("selected").orderBy("beat_no").toLocalIterator()] or ["- none"]
    return "\n".join(lines) + "\n"


def timeline_markdown(order: DataFrame, conflicts: DataFrame, counts: DataFrame | None = None) -> str:
    """A story order (timeline_rank, event_id, summary) and its conflicts (type, ids) as markdown; with its counts, if given."""
    lines = ["# Timeline", ""]
    if counts is not None:
        lines += ["## Counts", *(f"- {k}: {v}" for k, v in counts.first().asDict().items()), "", "## Order"]
    lines += [f"{r.timeline_rank}. {r.event_id}: {r.summary or ''}".rstrip(": ") for r in order.orderBy("timeline_rank").toLocalIterator()]
    lines += ["", "## Conflicts", *([f"- {r.type}: {', '.join(r.ids)}" for r in conflicts.orderBy("type", "ids").toLocalIterator()] or ["- none"])]
    return "\n".join(lines) + "\n"
