"""Memory layers from parsed extractor output, and the asset tables made of them.

Every builder is a projection or an explode of parsed records; ids are ``<scene>_<kind>_001`` by place in the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import entity_type, is_durable, is_undirected, mention_route, canonical_relation, softened_relation, temporal_scope
from ..functions.text import alias_key, text_of
from .evidence import locate
from .ranking import ranked
from .relations import vector_document


def items(parsed: DataFrame, array: str, kind: str, scene: str = "scene_id") -> DataFrame:
    """One row per element of an array column, with its fields, its index from 1 and a record id."""
    rows = parsed.select(F.col(scene).alias("scene_id"), F.posexplode(array).alias("at", "item"))
    return rows.select("scene_id", (F.col("at") + 1).alias("item_index"), F.format_string(f"%s_{kind}_%03d", F.col("scene_id"), F.col("at") + 1).alias("record_id"), "item.*")


def scene_inventory(parsed: DataFrame) -> dict[str, DataFrame]:
    """Scenes with their settings, stated facts, open questions."""
    return {"scenes": parsed.select("scene_id", "setting"), "stated_facts": items(parsed, "stated_facts", "fact"), "open_questions": items(parsed, "open_questions", "question")}


def kg_mentions(parsed: DataFrame) -> dict[str, DataFrame]:
    """Mentions by route: accepted, scene tags, unresolved."""
    rows = items(parsed, "entity_mentions", "entity").withColumn("entity_type", entity_type("entity_type"))
    c = F.col
    routed = rows.withColumn("route", mention_route(c("surface"), c("entity_type"), c("canonical_hint"), c("role_in_unit"), c("attributes_or_state"), c("evidence")))
    return {name: routed.where(F.col("route") == route).drop("route") for name, route in (("mentions", "accepted"), ("scene_tags", "scene_tag"), ("unresolved", "unresolved"))}


def episodic_memories(parsed: DataFrame, units: DataFrame) -> dict[str, DataFrame]:
    """Memories whose evidence stands in their unit, with temporal scopes; the rest are rejections.

    ``units``: scene_id, title, subtitle, content.
    """
    rows = items(parsed, "memories", "memory").join(units.select("scene_id", "title", "subtitle", "content"), "scene_id")
    found = locate(rows, "evidence").withColumn("s", temporal_scope("memory_type", F.concat_ws(" ", text_of("summary"), text_of("evidence"))))
    scoped = found.withColumn("memory_temporal_scope", F.col("s.scope")).withColumn("sequence_index", F.col("item_index")).withColumn("timeline_index", F.format_string("%s:%03d", F.col("scene_id"), F.col("item_index"))).drop("s", "title", "subtitle", "content", "item_index")
    ok = F.col("evidence_at.status") != "rejected"
    return {"memories": scoped.where(ok), "rejections": scoped.where(~ok)}


def relationship_observations(parsed: DataFrame, units: DataFrame) -> DataFrame:
    """Durable relations with aligned evidence: canonical types, ends swapped for inverse ones, direction."""
    rows = items(parsed, "relationships", "relation").join(units.select("scene_id", "title", "subtitle", "content"), "scene_id")
    found = locate(rows, "evidence").where("evidence_at.status <> 'rejected'")
    canon = canonical_relation("relation_type")
    kind = softened_relation(canon["type"], "evidence", "status_or_change")
    swapped = canon["swapped"]
    return (
        found.select("scene_id", "record_id", F.when(swapped, F.col("target_entity")).otherwise(F.col("source_entity")).alias("source_entity"), F.when(swapped, F.col("source_entity")).otherwise(F.col("target_entity")).alias("target_entity"), kind.alias("relation_type"), "evidence", "status_or_change")
        .where(is_durable("relation_type") & (text_of("source_entity") != "") & (text_of("target_entity") != ""))
        .withColumn("direction", F.when(is_undirected("relation_type"), "undirected").otherwise("directed"))
        .withColumn("strength_delta", F.lit(0.25))
    )


def collect_mentions(layers: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """Mentions of several layers as one frame: ``name, entity_type, scene_id, source``; blank names go.

    ``layers``: source name to (frame, name column, type column).
    """
    out = None
    for source, (df, name, kind) in layers.items():
        rows = df.select(F.trim(text_of(name)).alias("name"), entity_type(kind).alias("entity_type"), F.col("scene_id"), F.lit(source).alias("source")).where("name <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def scene_metadata(*sources: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """A scene's metadata from several frames: the first value that is not null, in the order of the frames."""
    names = list(dict.fromkeys(n for _, columns in sources for n in columns))
    out = None
    for i, (df, columns) in enumerate(sources):
        rows = df.select("scene_id", F.lit(i).alias("__o"), *((columns[n] if n in columns else F.lit(None)).cast("string").alias(n) for n in names))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("scene_id").agg(*(F.min_by(n, F.when(F.col(n).isNotNull(), F.col("__o"))).alias(n) for n in names))


DOCUMENT = "doc_id, doc_type, source_id, memory_id, entity_id, parent_scene_id, scene_order, chunk_index, sequence_index, text"


def retrieval_documents(memories: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """A global document of every memory and an entity document of every resolved link; unresolved links go.

    ``memories``: record_id, scene_id, scene_order, chunk_index, sequence_index, summary, evidence_text, memory_type; ``links``:
    record_id, memory_record_id, canonical_entity, link_role, evidence_text; ``aliases``: entity_id, normalized_alias.
    """
    lines = lambda *cs: F.concat_ws("\n", *(F.nullif(text_of(c), F.lit("")) for c in cs))
    place = ["scene_order", "chunk_index", "sequence_index"]
    whole = memories.select(F.concat(F.lit("episodic_memory_global:"), "record_id").alias("doc_id"), F.lit("episodic_memory_global").alias("doc_type"), F.col("record_id").alias("source_id"), F.col("record_id").alias("memory_id"), F.lit(None).cast("string").alias("entity_id"), F.col("scene_id").alias("parent_scene_id"), *place, lines("summary", "evidence_text", "memory_type").alias("text"))
    known = aliases.groupBy("normalized_alias").agg(F.min("entity_id").alias("entity_id"))
    l = links.withColumn("normalized_alias", alias_key("canonical_entity")).join(known, "normalized_alias").alias("l")
    m = memories.alias("m")
    own = l.join(m, F.col("l.memory_record_id") == F.col("m.record_id")).select(F.concat(F.lit("episodic_memory_entity:"), F.col("l.record_id")).alias("doc_id"), F.lit("episodic_memory_entity").alias("doc_type"), F.col("l.record_id").alias("source_id"), F.col("l.memory_record_id").alias("memory_id"), F.col("l.entity_id").alias("entity_id"), F.col("m.scene_id").alias("parent_scene_id"), *(F.col(f"m.{p}").alias(p) for p in place), lines("l.canonical_entity", "l.link_role", "m.summary", "l.evidence_text").alias("text"))
    return whole.unionByName(own)


def context_documents(context_items: DataFrame, units: DataFrame) -> DataFrame:
    """Context items as retrieval documents with the order of their units; items of a unit that is not there keep a null order."""
    orders = units.select("unit_id", "unit_order").dropDuplicates(["unit_id"])
    return context_items.join(orders, "unit_id", "left").withColumn("doc_id", F.concat(F.lit("ctx_doc:"), "item_id"))


def vector_documents(chunks: DataFrame, entities: DataFrame, relations: DataFrame, facts: DataFrame, properties: DataFrame, clusters: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Documents to embed of the seven namespaces."""
    c = F.col
    rows = [
        chunks.select(*vector_document("chunks", c("chunk_id"), c("title"), c("heading"), c("content"))),
        entities.select(*vector_document("source_local_entities", c("entity_id"), c("entity_name"), c("entity_type"), c("description"))),
        relations.select(*vector_document("source_local_relationships", c("relation_id"), F.concat_ws(" -> ", "src_id", "tgt_id"), c("keywords"), c("description"))),
        facts.select(*vector_document("atomic_facts", c("fact_id"), c("subject"), c("statement"))),
        properties.select(*vector_document("entity_properties", c("property_id"), c("entity_name"), c("property_name"), c("statement"))),
        clusters.select(*vector_document("entity_clusters", c("cluster_id"), c("canonical_display_name"), F.array_join("aliases", ", "))),
        pseudo.select(*vector_document("pseudo_relationships", c("pseudo_relation_id"), c("a"), c("b"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def extend_run(base: DataFrame, more: DataFrame, ordinal: str = "ordinal", order: str = "record_id") -> DataFrame:
    """Rows of a later run after those of an earlier one, numbered on from its last."""
    last = base.agg(F.coalesce(F.max(ordinal), F.lit(0)).alias("__last"))  # one row
    numbered = ranked(more.withColumn("__all", F.lit(0)), ["__all"], [F.col(order)], ordinal).drop("__all")
    return base.unionByName(numbered.join(F.broadcast(last)).withColumn(ordinal, F.col(ordinal) + F.col("__last")).drop("__last").select(*base.columns))


def previous_context(units: DataFrame, order: str = "discourse_index", most: int = 800, by: tuple[str, ...] = ()) -> DataFrame:
    """Each unit with the one before it: the full text if that has at most ``most`` characters without white space, else its summary."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    prev = F.lag(F.struct("scene_id", "title", "content", "summary")).over(w)
    rows = units.withColumn("p", prev)
    head = F.concat(F.lit("Previous scene: "), F.concat_ws(" | ", "p.scene_id", "p.title"))
    full = F.concat_ws("\n", head, F.lit("Full text:"), "p.content")
    short = F.length(F.regexp_replace(full, r"\s+", "")) <= most
    brief = F.concat_ws("\n", head, F.lit("Summary:"), F.coalesce(F.nullif(text_of("p.summary"), F.lit("")), F.lit("No compact summary available.")))
    return rows.withColumn("previous_context", F.when(F.col("p").isNull(), "").when(short & (text_of("p.content") != ""), full).otherwise(brief)).drop("p")


def benchmark_targets(classes: DataFrame, units: DataFrame, ids: tuple[str, ...] = (), start: int | None = None, limit: int | None = None) -> DataFrame:
    """Units that may be written as a benchmark, in story order."""
    rows = classes.where("writing_eval_policy = 'include'").join(units.select("scene_id", "source_record_id", F.length("content").alias("content_char_count")), "scene_id")
    rows = rows.where(F.col("scene_id").isin(*ids)) if ids else rows
    rows = rows.where(F.col("source_record_id") >= start) if start is not None else rows
    rows = rows.orderBy("source_record_id", "scene_id")
    return rows if limit is None else rows.limit(limit)
