"""The memory packet: what a writer may know before a unit, assembled for a list of queries at once.

Every part is a plan over all queries: entities named in a query, their memories, memories that hold everywhere, relations
one hop around the entities, and summaries of related scenes, all strictly before each query's bound. The rows of a part
carry ``query_id``, so a packet is what a filter on it leaves.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_of, token_set
from ..sources.scratch import written
from .entities import known_in_text
from .ranking import first_wins, reference_labels, top_per
from .retrieval import adaptive_memories, known_to, lexical, merge_hits, profile_memories

#: Scopes of memories that hold everywhere (fixed values).
GLOBAL_SCOPES = ("atemporal_fact", "durable_state")


@dataclass(frozen=True)
class PacketLimits:
    """How much of each part a packet takes."""

    scenes: int = 5
    all_memories: int = 50
    entity_memories: int = 12
    global_memories: int = 8
    profile: int = 3
    state: int = 4


def matched_entities(queries: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``query_id, bound, entity_rank, entity_id, canonical_name, entity_type``: entities named in the queries, by id."""
    hits = known_in_text(queries.select("query_id", "query", "bound"), aliases, "query").select("query_id", "query", "bound", "entity_id").distinct()
    rows = hits.join(entities.select("entity_id", "canonical_name", "entity_type"), "entity_id")
    return rows.withColumn("entity_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("entity_id")))


def related_scenes(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """Scenes before the bound by the best hit among their summaries and stated facts: ``query_id, scene_id, best_score, first_rank, hits, rank``.

    The k best hits of each kind are merged by scene. ``docs``: doc_id, doc_type, scene_id, scene_order, text.
    """
    some = docs.where(F.col("doc_type").isin("scene_summary", "stated_fact"))
    hits = lexical(some, queries.select("query_id", "query", "bound"), below=("scene_order", "bound"), keep=("doc_type", "scene_id", "scene_order"), k=k, by=("doc_type",))
    best = top_per(hits, ["query_id", "doc_type"], [F.col("score").desc(), F.col("doc_id").asc()], k)
    merged = merge_hits(best, ["query_id", "scene_id"])
    return top_per(merged, ["query_id"], [F.col("best_score").desc(), F.col("first_rank").asc(), F.col("scene_id").asc()], k)


def global_memories(queries: DataFrame, memories: DataFrame, k: int = 8) -> DataFrame:
    """Memories before the bound that hold everywhere: of the 3k best hits of all memories, the k best of those scopes."""
    rows = memories.select(F.col("memory_id").alias("doc_id"), "scene_order", "memory_temporal_scope", F.col("summary").alias("text"))
    hits = lexical(rows, queries.select("query_id", "query", "bound"), below=("scene_order", "bound"), keep=("scene_order", "memory_temporal_scope"), k=max(3 * k, 1))
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    near = top_per(hits, ["query_id"], order, max(3 * k, 1), "place")
    kept = top_per(near.where(F.col("memory_temporal_scope").isin(*GLOBAL_SCOPES)), ["query_id"], order, k, "memory_rank")
    return kept.select("query_id", F.col("doc_id").alias("memory_id"), "score", "memory_rank")


def _of(matched: DataFrame, rows: DataFrame, end: str) -> DataFrame:
    """Rows of matched entities: a semi join, which Spark takes below the grouping of ``rows``."""
    return rows.join(matched.select(F.col("entity_id").alias(end)).distinct(), end, "left_semi")


def entity_memories(matched: DataFrame, links: DataFrame, memories: DataFrame, limits: PacketLimits = PacketLimits()) -> DataFrame:
    """Memories of the matched entities before the bound: all of an entity with few, else those with the most words in common with the query."""
    own = matched.select("query_id", "query", "bound", "entity_rank", "entity_id", "canonical_name").join(_of(matched, links.select("entity_id", "memory_id"), "entity_id").distinct(), "entity_id")
    rows = own.join(memories.select("memory_id", "scene_id", "scene_order", "sequence_index", "summary", "memory_temporal_scope"), "memory_id").where(F.col("scene_order") < F.col("bound"))
    words = token_set(F.concat_ws("\n", "query", "canonical_name"))
    score = F.size(F.array_intersect(words, token_set("summary")))
    order = [F.col("scene_order"), F.col("sequence_index"), F.col("memory_id")]
    picked = adaptive_memories(rows, score, ("query_id", "entity_id"), limits.all_memories, limits.entity_memories, order)
    return picked.withColumnRenamed("rank", "memory_rank").drop("query", "bound", "canonical_name")


def one_hop_relations(matched: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations before the bound that touch a matched entity, once a query, with whether both ends are matched.

    ``relations``: relation_id, source_entity_id, target_entity_id, relation_type, last_order. Two equi-joins stand for the OR.
    """
    ends = [matched.select("query_id", "bound", F.col("entity_id").alias(f"{e}_entity_id")).join(_of(matched, relations, f"{e}_entity_id"), f"{e}_entity_id").withColumn("end", F.lit(e)) for e in ("source", "target")]
    columns = ["query_id", "bound", "end", *relations.columns]
    both = ends[0].select(*columns).unionByName(ends[1].select(*columns)).where(F.col("last_order") < F.col("bound"))
    return both.groupBy("query_id", *relations.columns).agg((F.count_distinct("end") == 2).alias("is_between_matched"))


def relation_diagnostics(matched: DataFrame, relations: DataFrame, found: DataFrame) -> DataFrame:
    """Per query with a matched entity: how many entities matched, how many relations there are and came back, and why none did."""
    counts = matched.groupBy("query_id").agg(F.count("*").alias("matched_entity_count"))
    back = found.groupBy("query_id").agg(F.count("*").alias("returned_relationship_count"))
    total = relations.agg(F.count("*").alias("total_relationship_count"))
    rows = counts.join(back, "query_id", "left").join(F.broadcast(total)).na.fill(0, ["returned_relationship_count"])  # one row
    reason = (
        F.when(F.col("returned_relationship_count") > 0, "")
        .when(F.col("total_relationship_count") == 0, "No durable relationship records exist.")
        .otherwise("No one-hop durable relationship records matched the selected entities before the retrieval boundary.")
    )
    return rows.withColumn("reason", reason)


def entity_contexts(matched: DataFrame, picked: DataFrame, is_profile: Column | None = None, limits: PacketLimits = PacketLimits()) -> DataFrame:
    """Each matched entity's profile (its first memories, marked ones before others) and current state (its last ones).

    ``query_id, entity_id, entity_rank, profile, current_state``; both empty for an entity without memories.
    """
    order = [F.col("scene_order"), F.col("sequence_index"), F.col("memory_id")]
    said = lambda rows, name, key: rows.groupBy("query_id", "entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "summary"))), lambda r: r["summary"]), "; ").alias(name))
    marked = F.lit(False) if is_profile is None else is_profile
    first = profile_memories(picked.withColumn("__by", F.struct("query_id", "entity_id")), "__by", marked, order, limits.profile)
    latest = [F.col("scene_order").desc(), F.col("sequence_index").desc(), F.col("memory_id").desc()]
    last = top_per(picked, ["query_id", "entity_id"], latest, limits.state, "__place").withColumn("__late", -F.col("__place"))
    rows = matched.select("query_id", "entity_id", "entity_rank", "canonical_name", "entity_type")
    out = rows.join(said(first, "profile", "profile_rank"), ["query_id", "entity_id"], "left").join(said(last, "current_state", "__late"), ["query_id", "entity_id"], "left")
    return out.na.fill("", ["profile", "current_state"])


def memory_packet(queries: DataFrame, world: Mapping[str, DataFrame], limits: PacketLimits = PacketLimits(), is_profile: Column | None = None) -> dict[str, DataFrame]:
    """All parts of the packets of ``queries`` (query_id, query, bound): entities, memories, relations, diagnostics, scenes.

    ``world``: entities, aliases, links, memories, relations, documents. Memories are labelled M1, M2 and so on in the order
    of first use: by entity, then by place; memories that hold everywhere follow.
    """
    matched = written(matched_entities(queries, world["entities"], world["aliases"]))  # every part starts from these few rows
    own = entity_memories(matched, world["links"], world["memories"], limits)
    everywhere = global_memories(queries, world["memories"], limits.global_memories)
    uses = own.select("query_id", "entity_id", "entity_rank", "memory_id", "memory_rank", "strategy").unionByName(
        everywhere.select("query_id", F.lit(None).cast("string").alias("entity_id"), F.lit(2**31 - 1).alias("entity_rank"), "memory_id", "memory_rank", F.lit("global_scope").alias("strategy"))
    )
    found = one_hop_relations(matched, world["relations"])
    return {
        "entities": entity_contexts(matched, own, is_profile, limits),
        "memories": reference_labels(uses, "memory_id", [F.col("entity_rank"), F.col("memory_rank")], "M", ("query_id",)),
        "relations": found,
        "diagnostics": relation_diagnostics(matched, world["relations"], found),
        "scenes": related_scenes(queries, world["documents"], limits.scenes),
    }


def memory_note(label: Column | str, scene: Column | str, scope: Column | str, summary: Column | str) -> Column:
    """One line on a memory; empty without a label or a summary."""
    part = lambda before, c, after="": F.when(text_of(c) != "", F.concat(F.lit(before), text_of(c), F.lit(after))).otherwise("")
    line = F.concat(text_of(label), part(" <", scene, ">"), part(" scope=", scope), F.lit(": "), text_of(summary))
    return F.when((text_of(label) != "") & (text_of(summary) != ""), line).otherwise("")


def memory_notes(labelled: DataFrame, memories: DataFrame, limit: int) -> DataFrame:
    """Notes of each entity of a packet: its own memories first, then those that hold everywhere, ``limit`` at most, each text once.

    ``labelled``: the packet's memories; ``memories``: memory_id, scene_id, memory_temporal_scope, summary.
    """
    texts = labelled.join(memories.select("memory_id", "scene_id", "memory_temporal_scope", "summary"), "memory_id").withColumn("note", memory_note("label", "scene_id", "memory_temporal_scope", "summary")).where("note <> ''")
    number = F.substr("label", F.lit(2)).cast("int")
    own = texts.where("entity_id IS NOT NULL").select("query_id", "entity_id", "note", F.lit(0).alias("layer"), number.alias("place"))
    shared = texts.where(F.col("memory_temporal_scope").isin(*GLOBAL_SCOPES)).select("query_id", "note", number.alias("place")).distinct()
    everyone = own.select("query_id", "entity_id").distinct().join(shared, "query_id").withColumn("layer", F.lit(1))
    order = [F.col("layer"), F.col("place")]
    once = first_wins(own.unionByName(everyone.select(*own.columns)), ["query_id", "entity_id", "note"], order)
    return top_per(once, ["query_id", "entity_id"], order, limit, "note_rank").select("query_id", "entity_id", "note_rank", "note")


def reference_notes(items: DataFrame, name: str, limit: int) -> DataFrame:
    """Reference knowledge (known_to, statement, rank) that a character may have, each statement once, ``limit`` at most."""
    once = first_wins(known_to(items, name).where(text_of("statement") != ""), ["statement"], [F.col("rank").asc()])
    return once.orderBy("rank", "statement").limit(limit)


def card_contexts(packet: Mapping[str, DataFrame], memories: DataFrame, most: int = 12, notes: int = 8) -> dict[str, DataFrame]:
    """What a character card or a disposition is written from, for each entity of each packet: its memories, its relations and its notes."""
    keep = ["query_id", "entity_id", "label", "memory_rank"]
    own = top_per(packet["memories"].where("entity_id IS NOT NULL").select(*keep, "memory_id"), ["query_id", "entity_id"], [F.col("memory_rank"), F.col("memory_id")], most, "place")
    entities = packet["entities"].select("query_id", "entity_id")
    ends = [packet["relations"].withColumn("entity_id", F.col(f"{e}_entity_id")) for e in ("source", "target")]
    relations = entities.join(ends[0].unionByName(ends[1]).distinct(), ["query_id", "entity_id"])
    return {"memories": own.join(memories, "memory_id"), "relations": relations, "notes": memory_notes(packet["memories"], memories, notes)}
