"""Facts and properties from extractor answers, and reference or artifact records as context items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import clamp, displayable_property
from ..functions.text import embedding_text, looks_temporal, stable_id, text_of
from ..sources.readers import model_json
from .retrieval import before

#: Confidence of an extracted statement that names none (a fixed value).
DEFAULT_CONFIDENCE = 0.72


def clean(value: Column | str) -> Column:
    """A field's text with single spaces and without quotes around it."""
    return F.regexp_replace(F.trim(F.regexp_replace(text_of(value), r"\s+", " ")), "^[\"'“”‘’]+|[\"'“”‘’]+$", "")


def job_answers(answers: DataFrame, jobs: DataFrame, array: str) -> DataFrame:
    """One row per element of a list in the answers (job_id, raw_text), with its job's columns.

    ``jobs``: job_id, asset_type, subject, source_scope_id, source_local_entity_id, source_local_relation_id, cluster_id, and
    ``evidence_chunks array<struct<chunk_id, doc_id>>``. Answers without JSON, and elements that are no objects, give nothing.
    """
    parsed = answers.join(jobs, "job_id").withColumn("j", model_json("raw_text"))
    raw = F.get_json_object("j.data", f"$.{array}")
    rows = parsed.withColumn("item", F.explode(F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))))
    return rows.where(F.ltrim(F.col("item")).startswith("{")).drop("j", "raw_text")


def _first_of(*names: str) -> Column:
    return F.coalesce(*(F.nullif(clean(F.get_json_object("item", f"$.{n}")), F.lit("")) for n in names), F.lit(""))


def _evidence_chunk() -> Column:
    """``struct<chunk_id, doc_id>``: the chunk that an element names if its job has it, else the job's first."""
    named = F.trim(text_of(F.get_json_object("item", "$.source_chunk_id")))
    own = F.get(F.filter("evidence_chunks", lambda c: (c["chunk_id"] == named) & (named != "")), F.lit(0))
    return F.coalesce(own, F.get("evidence_chunks", F.lit(0)))


def _confidence() -> Column:
    return clamp(F.get_json_object("item", "$.confidence"), DEFAULT_CONFIDENCE)


def atomic_facts(answers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Facts of the answers' ``atomic_facts``: subject (the job's if none), predicate (states), statement; those without subject or statement go."""
    rows = job_answers(answers, jobs, "atomic_facts").withColumn("c", _evidence_chunk())
    entity = F.col("asset_type").isin("entity", "entity_cluster")
    made = rows.select(
        "job_id", F.coalesce("source_scope_id", F.lit("")).alias("source_scope_id"),
        F.when(entity, text_of("source_local_entity_id")).otherwise("").alias("source_local_entity_id"),
        F.when(F.col("asset_type") == "relationship", text_of("source_local_relation_id")).otherwise("").alias("source_local_relation_id"),
        F.when((entity & (text_of("source_local_entity_id") != "")) | (F.col("asset_type") == "entity_cluster"), text_of("cluster_id")).otherwise("").alias("cluster_id"),
        F.coalesce(F.nullif(_first_of("subject"), F.lit("")), clean("subject")).alias("subject"), F.coalesce(F.nullif(_first_of("predicate"), F.lit("")), F.lit("states")).alias("predicate"),
        _first_of("object", "target").alias("object"), _first_of("fact", "statement", "description", "evidence").alias("statement"), F.concat("asset_type", F.lit("_atomic_fact")).alias("fact_type"), _confidence().alias("confidence"),
        text_of("c.chunk_id").alias("source_chunk_id"), text_of("c.doc_id").alias("source_doc_id"), _first_of("evidence").alias("evidence"),
    ).where("subject <> '' AND statement <> ''")
    return made.withColumn("fact_id", stable_id("reffact", "job_id", "source_chunk_id", "subject", "predicate", "object", "statement", separator="|", digits=None))


def entity_properties(answers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Properties of the answers' ``entity_properties`` on entities: name, value and statement (made of both if there is none); type-like names go."""
    rows = job_answers(answers, jobs, "entity_properties").where(F.col("asset_type").isin("entity", "entity_cluster")).withColumn("c", _evidence_chunk())
    named = rows.select(
        text_of("source_scope_id").alias("source_scope_id"), text_of("source_local_entity_id").alias("source_local_entity_id"), text_of("cluster_id").alias("cluster_id"),
        F.coalesce(F.nullif(_first_of("entity"), F.lit("")), clean("subject")).alias("entity_name"), _first_of("property", "property_name", "name").alias("property_name"), _first_of("value", "property_value", "description").alias("property_value"),
        _first_of("statement", "fact").alias("said"), _confidence().alias("confidence"), text_of("c.chunk_id").alias("source_chunk_id"), text_of("c.doc_id").alias("source_doc_id"), _first_of("evidence").alias("evidence"),
    ).where("entity_name <> '' AND property_name <> '' AND property_value <> ''")
    whole = F.concat("entity_name", F.lit("."), "property_name", F.lit(": "), "property_value")
    made = named.withColumn("statement", F.coalesce(F.nullif("said", F.lit("")), whole)).drop("said").where(displayable_property("property_name", "statement"))
    return made.withColumn("property_id", stable_id("refprop", "source_local_entity_id", "source_chunk_id", "property_name", "property_value", "statement", separator="|", digits=None))


def item_type(doc_type: Column | str, memory_type: Column | str) -> Column:
    """What an artifact's retrieval document is as a context item."""
    doc, memory = text_of(doc_type), text_of(memory_type)
    event = F.when(memory.isin("relationship", "relationship_observation"), "relation").when(memory.isin("state", "entity_state"), "state").otherwise("event")
    return F.when(doc == "stated_fact", "fact").when(doc.isin("scene_summary", "unit_summary"), "summary").when(doc.startswith("episodic_memory"), event).otherwise("fact")


def artifact_items(records: DataFrame, project: str, source: str, canonical: bool = False) -> DataFrame:
    """Retrieval documents of a finished artifact as context items, evidence first: canonical ones have full confidence.

    ``records``: doc_id, doc_type, parent_scene_id, entity_id, text, and of their memory: memory_type, summary, proposition,
    statement, evidence_text, evidence_start, evidence_end, memory_temporal_scope (missing columns are empty).
    """
    has = lambda c: text_of(c) if c in records.columns else F.lit("")
    place = lambda c: F.col(c).cast("int") if c in records.columns else F.lit(None).cast("int")
    said = F.coalesce(*(F.nullif(F.trim(has(c)), F.lit("")) for c in ("summary", "proposition", "statement", "text")), F.lit(""))
    kind, entity, item = item_type(has("doc_type"), has("memory_type")), F.trim(has("entity_id")), F.concat(F.lit("artifact:"), text_of("doc_id"))
    evidence = F.struct(stable_id("ev", item, has("evidence_text")).alias("evidence_id"), has("evidence_text").alias("text"), place("evidence_start").alias("start_offset"), place("evidence_end").alias("end_offset"), F.lit("imported").alias("alignment_status"))
    none = F.array().cast("array<string>")
    return records.select(
        item.alias("item_id"), F.lit(project).alias("project_id"), F.lit("narrative_artifact").alias("source_type"), F.lit(source).alias("source_id"), F.nullif(has("parent_scene_id"), F.lit("")).alias("unit_id"), kind.alias("item_type"), entity.alias("subject"), said.alias("statement"),
        F.when(entity != "", F.array(entity)).otherwise(none).alias("entity_ids"), F.filter(F.array(evidence), lambda e: e["text"] != "").alias("evidence_refs"), F.lit("artifact_canonical" if canonical else "artifact_active").alias("authority"),
        F.lit(1.0 if canonical else 0.8).alias("confidence"), F.lit("canonical" if canonical else "active").alias("status"), F.when(kind.isin("event", "state", "relation", "fact"), "character_visible").otherwise("author_only").alias("visibility"),
        F.coalesce(F.nullif(has("memory_temporal_scope"), F.lit("")), F.lit("uncertain")).alias("temporal_scope"),
    )


def _entity_item_type() -> Column:
    kind = F.trim(F.lower(text_of("entity_type")))
    return F.when(kind == "character", "character_profile").when(kind == "location", "location_doc").when(kind == "organization", "organization_fact").otherwise("world_bible")


_RECORD = ("item_id", "source_doc_id", "chunk_id", "item_type", "subject", "statement", "evidence", "authority", "confidence", "knowledge_scope", "available_from_order", "timeline_hint", "source_role")


def _record(df: DataFrame, role: str, key: Column, kind: Column, subject: Column, statement: Column, authority: float, confidence: Column, doc: Column, chunk: Column, hint: Column | None = None) -> DataFrame:
    said = F.trim(text_of(statement))
    values = [F.concat(F.lit(f"external_{role}:"), text_of(key)), text_of(doc), text_of(chunk), kind, F.trim(text_of(subject)), said, said, F.lit(authority), confidence.cast("double"), F.lit("author_only"), F.lit(None).cast("int"), F.lit("") if hint is None else hint, F.lit(f"external_reference_{role.split('_')[-1]}")]
    return df.select(*(v.alias(n) for v, n in zip(values, _RECORD)))


def reference_records(entities: DataFrame, relations: DataFrame, facts: DataFrame, properties: DataFrame, chunks: DataFrame) -> DataFrame:
    """A reference library's entities, relations, facts, properties and chunks as context records of the author's eyes only.

    Authority: facts 0.72, chunks 0.6, all else 0.7. Entities without a name and chunks without text go.
    """
    c, first = F.col, lambda name: F.get(name, F.lit(0))
    parts = [
        _record(entities, "source_local_entity", c("source_local_entity_id"), _entity_item_type(), c("entity_name"), c("description"), 0.7, F.lit(0.75), first("source_doc_ids"), first("source_chunk_ids")).where("subject <> ''"),
        _record(relations, "source_local_relation", c("source_local_relation_id"), F.lit("relationship_fact"), F.concat_ws(" - ", "src_id", "tgt_id"), c("description"), 0.7, F.lit(0.75), first("source_doc_ids"), first("source_chunk_ids")),
        _record(facts, "fact", c("fact_id"), F.when(text_of("source_local_relation_id") != "", "relationship_fact").otherwise("world_bible"), c("subject"), c("statement"), 0.72, c("confidence"), c("source_doc_id"), c("source_chunk_id"), F.when(looks_temporal("statement"), c("statement")).otherwise("")),
        _record(properties, "property", c("property_id"), F.when((c("property_name") == "entity_type") & (c("property_value") == "character"), "character_profile").otherwise("world_bible"), c("entity_name"), c("statement"), 0.7, c("confidence"), c("source_doc_id"), c("source_chunk_id")),
        _record(chunks, "chunk", c("chunk_id"), F.lit("author_note"), F.coalesce(F.nullif(text_of("heading"), F.lit("")), F.nullif(text_of("title"), F.lit("")), F.nullif(text_of("full_doc_id"), F.lit("")), F.lit("external reference")), c("content"), 0.6, F.lit(0.7), c("full_doc_id"), c("chunk_id")).where("statement <> ''"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filter_records(records: DataFrame, item_types: Sequence[str] = (), scopes: Sequence[str] = (), bound: int | None = None) -> DataFrame:
    """Records by type, knowledge scope and availability; one without an order is always available."""
    out = records.where(F.col("item_type").isin(*item_types)) if item_types else records
    out = out.where(F.col("knowledge_scope").isin(*scopes)) if scopes else out
    return before(out, "available_from_order", bound=bound, keep_null=True)


def record_order() -> list[Column]:
    """Sort keys of reference records: authority, confidence, id."""
    return [F.coalesce("authority", F.lit(0.0)).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("item_id").asc()]


def reference_items(records: DataFrame, project: str, source: str) -> DataFrame:
    """Reference records as context items: never canon, evidence kept, the text to embed written out."""
    item, subject = F.concat(F.lit("external:"), text_of("item_id")), F.trim(text_of("subject"))
    kind = F.coalesce(F.nullif(text_of("item_type"), F.lit("")), F.lit("notes"))
    unit = F.when(text_of("chunk_id") != "", F.concat(F.lit(f"{source}:"), "chunk_id"))
    evidence = F.struct(stable_id("ev", item, text_of("evidence")).alias("evidence_id"), text_of("evidence").alias("text"), F.lit(None).cast("int").alias("start_offset"), F.lit(None).cast("int").alias("end_offset"), F.lit("imported").alias("alignment_status"))
    return records.select(
        item.alias("item_id"), F.lit(project).alias("project_id"), F.lit("external_reference").alias("source_type"), F.lit(source).alias("source_id"), unit.alias("unit_id"), kind.alias("item_type"), subject.alias("subject"), F.trim(text_of("statement")).alias("statement"),
        F.when(subject != "", F.array(F.concat(F.lit("external_subject:"), subject))).otherwise(F.array().cast("array<string>")).alias("entity_ids"), F.filter(F.array(evidence), lambda e: e["text"] != "").alias("evidence_refs"), F.lit("external_source").alias("authority"),
        F.coalesce(F.col("confidence"), F.lit(0.5)).alias("confidence"), F.lit("active").alias("status"), F.coalesce(F.nullif(text_of("knowledge_scope"), F.lit("")), F.lit("author_only")).alias("visibility"), F.lit("not_applicable").alias("temporal_scope"),
        embedding_text(F.lit("external_reference"), kind, subject, F.col("statement"), F.lit("active")).alias("embedding_text"), F.lit(False).alias("default_canon"),
    )
