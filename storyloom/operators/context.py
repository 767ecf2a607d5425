"""Versioned context items: an append-only log and what is derived from it.

The log is the truth; current items, history, patches and views are reads of it. A row is (item_id, seq, payload ...);
``seq`` orders the changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.rules import statements, subject, subject_entities
from ..functions.similarity import jaccard
from ..functions.text import contains_any, stable_id, text_of, timeline_hint, token_set
from .ranking import first_wins, last_wins, top_per
from .retrieval import context_top

#: Status changes that write an event of their own beside the update.
STATUS_EVENTS = {"superseded": "SUPERSEDE", "rejected": "REJECT", "archived": "ARCHIVE", "deleted": "DELETE"}


def current(log: DataFrame, key: str = "item_id", seq: str = "seq") -> DataFrame:
    """The latest row of every item."""
    return last_wins(log, [key], seq)


def history(log: DataFrame, value: Column, key: str = "item_id", seq: str = "seq") -> DataFrame:
    """ADD for the first row of an item, UPDATE for others, with the old and the new value."""
    w = Window.partitionBy(key).orderBy(seq)
    rows = log.withColumn("new_value", value.cast("string")).withColumn("old_value", F.lag(value.cast("string")).over(w)).withColumn("version", F.row_number().over(w))
    return rows.withColumn("event", F.when(F.col("version") == 1, F.lit("ADD")).otherwise(F.lit("UPDATE")))


def status_history(log: DataFrame, key: str = "item_id", seq: str = "seq", status: str = "status") -> DataFrame:
    """History of status changes: an UPDATE for each, and SUPERSEDE, REJECT, ARCHIVE or DELETE for those statuses."""
    rows = history(log, F.col(status), key, seq)
    names = F.create_map(*[F.lit(x) for kv in STATUS_EVENTS.items() for x in kv])
    special = rows.where((F.col("version") > 1) & F.col(status).isin(*STATUS_EVENTS) & (F.col(status) != F.coalesce("old_value", F.lit("")))).withColumn("event", F.element_at(names, F.col(status)))
    return rows.unionByName(special)


def promote(items: DataFrame, layer: Column, seq: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical copies of items, ``promotes`` links to them, and PROMOTE events."""
    new = items.withColumn("target_item_id", stable_id("item", "item_id", layer)).withColumn("target_layer", layer)
    copies = new.select(F.col("target_item_id").alias("item_id"), *[c for c in items.columns if c not in ("item_id", "status", "authority")], F.lit("canonical").alias("status"), F.lit("user_confirmed").alias("authority"), "target_layer")
    links = new.select(stable_id("link", "item_id", "target_item_id", F.lit("promotes")).alias("link_id"), F.col("item_id").alias("source_item_id"), "target_item_id", F.lit("promotes").alias("link_type"))
    return copies, links, new.select("item_id", F.lit("PROMOTE").alias("event"), F.col("target_item_id").alias("new_value"), F.col(seq))


def active_patches(patches: DataFrame, project: str | None = None, entity: str | None = None) -> DataFrame:
    """Active patches in the order of their creation."""
    out = patches.where(F.col("status") == "active")
    out = out.where(F.col("project_id") == project) if project else out
    out = out.where(F.col("entity_id") == entity) if entity else out
    return out.orderBy("created_at", "patch_id")


def reconcile(candidates: DataFrame, existing: DataFrame, seq: str = "seq") -> DataFrame:
    """What to do with each candidate: NONE (an exact duplicate, also of an earlier candidate), PATCH, PROMOTE or ADD.

    All existing rows are checked for duplicates, not only the best search hits.
    """
    key = ["source_type", "item_type", "subject", "statement"]
    null_safe = lambda df: df.withColumns({f"__{k}": text_of(k) for k in key})
    have = null_safe(existing.where(F.col("status").isin("active", "canonical", "tentative"))).groupBy(*[f"__{k}" for k in key]).agg(F.min("item_id").alias("known"))
    rows = null_safe(candidates)
    w = Window.partitionBy(*[f"__{k}" for k in key]).orderBy(seq)
    rows = rows.withColumn("__n", F.row_number().over(w)).withColumn("__first", F.first("item_id").over(w)).join(have, [f"__{k}" for k in key], "left")
    talk = F.col("source_type") == "conversation"
    promotes = F.col("promote_to").isNotNull() if "promote_to" in candidates.columns else F.lit(False)
    action = (
        F.when(F.col("known").isNotNull() | (F.col("__n") > 1), "NONE")
        .when(talk & (F.col("item_type") == "correction") & (F.size("entity_ids") > 0), "PATCH")
        .when(talk & (F.col("item_type") == "creative_decision") & promotes, "PROMOTE")
        .otherwise("ADD")
    )
    target = F.when(action == "NONE", F.coalesce("known", "__first"))
    return rows.select(*candidates.columns, action.alias("action"), target.alias("target_item_id"))


def conflicts(external: DataFrame, artifact: DataFrame) -> DataFrame:
    """External items against artifact items of one entity or subject: overlap of tokens and differing negation, or a word of contradiction.

    Two equi-joins (entity, subject) with a dedupe stand for the OR, so nothing is compared that shares neither.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("item_id").alias(f"{p}_id"), F.col("item_type").alias(f"{p}_type"), F.lower(F.trim(text_of("subject"))).alias(f"{p}_subject"), F.col("statement").alias(f"{p}_statement"), "entity_ids", token_set("statement").alias(f"{p}_tokens"))

    e, a = side(external, "external"), side(artifact, "artifact")
    by_entity = e.withColumn("k", F.explode("entity_ids")).drop("entity_ids").join(a.withColumn("k", F.explode("entity_ids")).drop("entity_ids"), "k").drop("k")
    by_subject = e.where("external_subject <> ''").drop("entity_ids").join(a.drop("entity_ids"), F.col("external_subject") == F.col("artifact_subject"))
    pairs = by_entity.unionByName(by_subject).dropDuplicates(["external_id", "artifact_id"])
    facts = F.col("external_type").isin(*vocab.COMPATIBLE_FACTS) & F.col("artifact_type").isin(*vocab.COMPATIBLE_FACTS)
    pairs = pairs.where((F.col("external_type") == F.col("artifact_type")) | facts).withColumn("overlap", jaccard("external_tokens", "artifact_tokens")).where("overlap > 0")
    no = lambda c: contains_any(F.lower(text_of(c)), vocab.NEGATIONS)
    marked = contains_any(F.lower(F.concat_ws("\n", "external_statement", "artifact_statement")), vocab.CONTRADICTION_WORDS)
    score = F.when(no("external_statement") != no("artifact_statement"), 0.6 + F.least("overlap", F.lit(0.35))).when(marked, 0.5 + F.least("overlap", F.lit(0.3)))
    return pairs.withColumn("score", F.round(score, 6)).where("score IS NOT NULL").select("external_id", "artifact_id", "external_subject", "external_type", "score")


def external_links(items: DataFrame) -> DataFrame:
    """An external item's entities, one row each; its subject stands in where it has none."""
    own = F.when(F.size("entity_ids") > 0, F.col("entity_ids")).when(F.trim(text_of("subject")) != "", F.array(F.concat(F.lit("external_subject:"), F.col("subject"))))
    return items.select("item_id", F.explode(own).alias("entity_id"), "subject", "item_type", "statement", F.lit("candidate").alias("status"))


def timeline_claims(items: DataFrame) -> DataFrame:
    return items.where(F.col("item_type").isin("timeline_doc", "timeline_event")).select("item_id", "subject", timeline_hint("statement").alias("timeline_hint"), "statement", F.lit("candidate").alias("status"))


def section_of(source_type: Column, item_type: Column) -> Column:
    """The packet section of a hit."""
    return (
        F.when(source_type == "conversation", F.when(item_type == "open_question", "open_questions").when(item_type.isin("style_preference", "user_preference"), "style_guidance").otherwise("conversation_guidance"))
        .when(source_type == "narrative_artifact", F.when(item_type == "relation", "relationship_context").when(item_type == "timeline_event", "timeline_context").otherwise("artifact_memory"))
        .when(source_type == "external_reference", F.when(item_type == "style_guide", "style_guidance").when(item_type == "timeline_doc", "timeline_context").otherwise("external_reference_context"))
        .when(source_type == "simulation", "simulation_context")
    )


def packet_rows(docs: DataFrame, with_simulation: bool = False) -> DataFrame:
    """The documents whose source and status a packet takes."""
    allowed = {"conversation": ("active", "canonical", "tentative"), "narrative_artifact": ("active", "canonical"), "external_reference": ("active", "canonical", "tentative"), "simulation": ("active", "tentative")}
    keep = F.lit(False)
    for source, statuses in allowed.items():
        if source != "simulation" or with_simulation:
            keep = keep | ((F.col("source_type") == source) & F.col("status").isin(*statuses))
    return docs.where(keep)


def packet(scored: DataFrame, k: int = 12, with_simulation: bool = False) -> DataFrame:
    """The k best hits of each source type in their sections; one pass instead of a search per source."""
    hits = top_per(packet_rows(scored, with_simulation), ["source_type"], [F.col("score").desc(), F.col("item_id").asc()], k)
    return hits.withColumn("section", section_of(F.col("source_type"), F.col("item_type")))


def packets(docs: DataFrame, queries: DataFrame, k: int = 12, with_simulation: bool = False) -> DataFrame:
    """A packet for every query (query_id, query) of a list."""
    return context_top(packet_rows(docs, with_simulation), queries, k).withColumn("section", section_of(F.col("source_type"), F.col("item_type")))


def entity_view(items: DataFrame, entity: str) -> DataFrame:
    """An entity's items by layer."""
    layers = {"narrative_artifact": "artifact_layer", "conversation": "conversation_layer", "external_reference": "external_layer", "simulation": "simulation_layer"}
    own = items.where(F.array_contains("entity_ids", entity) & F.col("status").isin("active", "canonical", "tentative"))
    return own.withColumn("layer", F.try_element_at(F.create_map(*[F.lit(x) for kv in layers.items() for x in kv]), F.col("source_type"))).where("layer IS NOT NULL")


def conversation_items(turns: DataFrame, project: Column | str, source: Column | str, cues: dict | None = None, roles: Sequence[str] = ("user", "human"), ends_asking: str = "吗") -> DataFrame:
    """Items stated in the users' turns; of equal (source, type, subject, statement) the first.

    ``turns``: turn_id, role, content, order. ``project`` and ``source`` are columns (or literals given as F.lit).
    """
    said = turns.where(F.lower("role").isin(*roles)).select("turn_id", "order", F.trim("content").alias("content"), (F.lit(project) if isinstance(project, str) else project).alias("project_id"), (F.lit(source) if isinstance(source, str) else source).alias("source_id"))
    rows = said.select("*", F.posexplode(statements("content", cues, ends_asking)).alias("at", "s")).withColumn("item_type", F.col("s.item_type")).withColumn("statement", F.col("s.statement")).withColumn("subject", subject("statement"))
    once = first_wins(rows, ["project_id", "source_id", "item_type", "subject", "statement"], [F.col("order").asc(), F.col("at").asc()])
    return once.select(
        stable_id("conv_item", "source_id", "turn_id", "item_type", "statement").alias("item_id"), "project_id", "source_id", F.col("turn_id").alias("unit_id"), F.lit("conversation").alias("source_type"), "item_type", "subject", "statement",
        subject_entities("subject", "statement").alias("entity_ids"), F.lit("user_explicit").alias("authority"), F.lit(0.85).alias("confidence"), F.when(F.col("item_type") == "rejected_option", "rejected").otherwise("active").alias("status"),
        F.lit("author_only").alias("visibility"), F.lit("not_applicable").alias("temporal_scope"), "order",
    )


def correction_patches(items: DataFrame) -> DataFrame:
    """A constraining patch for every entity of a correction."""
    rows = items.where("item_type = 'correction'").select("*", F.explode("entity_ids").alias("entity_id"))
    return rows.select(stable_id("patch", "item_id", "entity_id", "statement").alias("patch_id"), "project_id", "entity_id", F.col("item_id").alias("source_item_id"), F.lit("constrain").alias("patch_type"), F.lit("profile").alias("target_field"), F.col("statement").alias("patch_statement"), "authority", F.lit("active").alias("status"))
