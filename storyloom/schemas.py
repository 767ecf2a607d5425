"""Schemas of the engine's tables as DDL. They are declared, never inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

_EVIDENCE = "evidence_verification_status STRING, evidence_source_field STRING, evidence_start INT, evidence_end INT, evidence_aligned_text STRING, evidence_alignment_score DOUBLE"
_UNIT = "scene_id STRING, source_record_id BIGINT, discourse_index BIGINT, title STRING, subtitle STRING, content STRING, raw_heading_number INT, interior_exterior STRING, time_of_day STRING, location_hint STRING, character_count INT, unit_type STRING, unit_label STRING"

#: Story memory.
UNITS = {
    "script": "_id BIGINT, title STRING, subtitle STRING, content STRING",
    "units": _UNIT,
    "chunks": f"{_UNIT}, chunk_id STRING, parent_unit_id STRING, chunk_index INT, chunk_count INT, source_start INT, source_end INT, source_sha256 STRING, chunk_unit_count INT, max_chunk_units INT",
    "entities": "entity_id STRING, entity_type STRING, canonical_name STRING, aliases ARRAY<STRING>, first_seen_scene STRING, mention_count INT, descriptions ARRAY<STRING>",
    "aliases": "entity_id STRING, alias STRING, normalized_alias STRING, source STRING",
    "episodic_memories": f"record_id STRING, scene_id STRING, parent_unit_id STRING, chunk_index INT, sequence_index INT, timeline_index STRING, memory_type STRING, summary STRING, evidence_text STRING, {_EVIDENCE}, memory_temporal_scope STRING",
    "entity_memory_links": "record_id STRING, memory_record_id STRING, canonical_entity STRING, entity STRING, entity_type STRING, link_role STRING, parent_unit_id STRING, chunk_index INT, sequence_index INT, evidence_text STRING",
    "relationships": "relationship_id STRING, source_entity_id STRING, target_entity_id STRING, relation_type STRING, direction STRING, status STRING, first_seen_scene STRING, last_updated_scene STRING, strength DOUBLE, evidence ARRAY<STRING>",
    "scene_metadata": "scene_id STRING, scene_order INT, title STRING, setting STRUCT<location: STRING, time_hint: STRING, spatial_context: STRING>, stated_facts ARRAY<STRUCT<record_id: STRING, proposition: STRING, speaker_or_source: STRING, evidence: STRING>>, open_questions ARRAY<STRUCT<record_id: STRING, question: STRING, evidence: STRING>>, scene_tags ARRAY<STRUCT<record_id: STRING, surface: STRING, tag_type: STRING, reason: STRING, evidence: STRING>>",
    "retrieval_documents": "doc_id STRING, doc_type STRING, source_id STRING, memory_id STRING, entity_id STRING, parent_scene_id STRING, scene_order INT, chunk_index INT, sequence_index INT, text STRING, metadata STRING",
}
#: Story time.
TIME = {
    "temporal_events": "event_id STRING, scene_id STRING, unit_id STRING, source_record_id INT, discourse_index INT, summary STRING, participants ARRAY<STRING>, location STRING, event_track STRING, event_time_mode STRING, story_time_hint STRING, granularity STRING, evidence STRING, confidence DOUBLE, revealed_at_scene_id STRING, is_reveal_of_past BOOLEAN",
    "temporal_relations": "relation_id STRING, scene_id STRING, source_event_id STRING, target_event_id STRING, relation_type STRING, evidence STRING, confidence DOUBLE, is_inferred BOOLEAN, source STRING, audit_ordering_usable BOOLEAN",
    "timeline_order": "project_id STRING, event_id STRING, timeline_rank INT",
    "timeline_buckets": "timeline_bucket STRING, event_id STRING, timeline_rank INT",
}
#: The reference library.
REFERENCES = {
    "raw_documents": "doc_id STRING, source_scope_id STRING, source_scope_name STRING, source_path STRING, relative_path STRING, file_name STRING, format STRING, record_index INT, title STRING, content STRING, content_sha256 STRING",
    "reference_chunks": "chunk_id STRING, doc_id STRING, source_scope_id STRING, title STRING, heading STRING, section_index INT, chunk_index INT, section_part_index INT, content STRING, content_sha256 STRING, char_count INT",
    "extracted_entities": "extraction_id STRING, entity_name STRING, entity_type STRING, original_entity_type STRING, entity_type_candidates ARRAY<STRING>, description STRING, source_id STRING, source_doc_id STRING, source_scope_id STRING, timestamp BIGINT",
    "extracted_relationships": "extraction_id STRING, src_id STRING, tgt_id STRING, keywords STRING, description STRING, weight DOUBLE, source_id STRING, source_doc_id STRING, source_scope_id STRING, timestamp BIGINT",
    "kg_raw_text": "chunk_id STRING, raw_text STRING",
    "atomic_facts": "fact_id STRING, source_scope_id STRING, source_local_entity_id STRING, source_local_relation_id STRING, cluster_id STRING, subject STRING, predicate STRING, object STRING, statement STRING, fact_type STRING, confidence DOUBLE, source_chunk_id STRING, source_doc_id STRING",
    "entity_properties": "property_id STRING, source_scope_id STRING, source_local_entity_id STRING, cluster_id STRING, entity_name STRING, property_name STRING, property_value STRING, statement STRING, confidence DOUBLE, source_chunk_id STRING, source_doc_id STRING",
    "vector_documents": "vector_id STRING, vector_namespace STRING, source_id STRING, content STRING",
}
#: The context kernel.
CONTEXT = {
    "conversation_turns": "turn_id STRING, role STRING, content STRING, speaker STRING, order INT, metadata MAP<STRING, STRING>",
    "context_units": "unit_id STRING, source_id STRING, project_id STRING, source_type STRING, unit_type STRING, unit_order INT, speaker STRING, text STRING",
    "context_items": "item_id STRING, project_id STRING, source_type STRING, source_id STRING, unit_id STRING, item_type STRING, subject STRING, statement STRING, entity_ids ARRAY<STRING>, authority STRING, confidence DOUBLE, status STRING, visibility STRING, temporal_scope STRING, updated_at STRING",
    "context_history": "history_id STRING, item_id STRING, event STRING, old_value STRING, new_value STRING, actor STRING, reason STRING, created_at STRING",
    "context_links": "link_id STRING, source_item_id STRING, target_item_id STRING, link_type STRING",
    "entity_patches": "patch_id STRING, project_id STRING, entity_id STRING, source_item_id STRING, patch_type STRING, target_field STRING, patch_statement STRING, authority STRING, status STRING, applies_to STRING, created_at STRING",
    "requirement_judgments": "requirement_id STRING, requirement STRING, importance STRING, status STRING",
    "attribute_cards": "entity_id STRING, canonical_name STRING, relationship_stances ARRAY<STRUCT<target: STRING, value: STRING, refs: ARRAY<STRING>>>, values_or_motivations ARRAY<STRUCT<value: STRING, refs: ARRAY<STRING>>>",
}
TABLES: dict[str, str] = UNITS | TIME | REFERENCES | CONTEXT


def schema(name: str) -> StructType:
    """A table's schema; an unknown name raises KeyError."""
    return StructType.fromDDL(TABLES[name])
