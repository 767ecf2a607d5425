"""Story time: priors between neighbouring events, buckets, memory-to-event matching, event normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.rules import clamp, event_track, one_of
from ..functions.similarity import ratio
from ..functions.text import text_of
from ..sources.scratch import cut_lineage
from .graphs import ORDERING, components
from .ranking import numbered, place_in

SCENE_PRIOR, DISCOURSE_PRIOR, MIN_MATCH = 0.55, 0.35, 0.25
#: What Python's ``strip`` takes away.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normalize_events(events: DataFrame) -> DataFrame:
    """Default ids and repaired enums of extracted events.

    ``event_id`` is ``<scene>:event_001`` where missing and prefixed by its scene where local; an unknown mode is
    present_scene, an unknown granularity unknown, a missing confidence 0.6 and any other within 0..1; the track follows
    from mode, participants and text.
    """
    w = Window.partitionBy("scene_id").orderBy("event_index")
    given = F.trim(text_of("event_id"))
    local = F.concat_ws(":", "scene_id", F.regexp_replace(given, r"[^\p{L}\p{N}_-]+", "_"))
    event_id = F.when(given == "", F.format_string("%s:event_%03d", F.col("scene_id"), F.row_number().over(w))).when(F.contains(given, F.lit(":")), given).otherwise(local)
    mode = one_of(F.lower(F.trim(text_of("event_time_mode"))), vocab.EVENT_MODES, "present_scene")
    has = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    said = F.concat_ws(" ", *(text_of(has(c)) for c in ("summary", "evidence", "location", "story_time_hint")))
    people = F.col("participants") if "participants" in events.columns else F.array().cast("array<string>")
    changed = {"event_id": event_id, "event_time_mode": mode, "granularity": one_of(F.lower(text_of(has("granularity"))), vocab.GRANULARITIES, "unknown"), "confidence": clamp(has("confidence").cast("string"), 0.6), "event_track": event_track(mode, people, said, has("scene_temporal_role"), has("event_track")), "is_reveal_of_past": mode == "past_recalled"}
    return events.select(*[c for c in events.columns if c not in changed], *(v.alias(k) for k, v in changed.items()))


def _edge(prefix: str, a: Column, b: Column, s: Column, t: Column, confidence: float) -> list[Column]:
    return [F.concat(F.lit(f"{prefix}:"), a.cast("string"), F.lit("->"), b.cast("string")).alias("relation_id"), s.alias("source_event_id"), t.alias("target_event_id"), F.lit("before").alias("relation_type"), F.lit(confidence).alias("confidence"), F.lit(prefix).alias("source"), F.lit(True).alias("is_inferred")]


def scene_priors(events: DataFrame, scene: str, order: list[Column], event: str = "event_id", confidence: float = SCENE_PRIOR) -> DataFrame:
    """Each event of a scene before the next one."""
    nxt = F.lead(event).over(Window.partitionBy(scene).orderBy(*order))
    paired = events.withColumn("__next", nxt).where("__next IS NOT NULL")
    return paired.select(F.col(scene).alias("scene_id"), *_edge("scene_block_prior", F.col(event), F.col("__next"), F.col(event), F.col("__next"), confidence))


def discourse_priors(events: DataFrame, scene: str, order: list[Column], sort_key: Column, event: str = "event_id", confidence: float = DISCOURSE_PRIOR) -> DataFrame:
    """The first event of each scene before the first of the next scene, within a project if events have one."""
    first = events.withColumn("__n", F.row_number().over(Window.partitionBy(scene).orderBy(*order))).where("__n = 1").withColumn("__key", sort_key)
    if "project_id" in events.columns:
        w = Window.partitionBy("project_id").orderBy("__key", event)
        paired = first.withColumn("__next", F.lead(event).over(w)).withColumn("__scene", F.lead(scene).over(w)).where("__next IS NOT NULL")
    else:
        rows = cut_lineage(numbered(first.select(scene, event, "__key"), [F.col("__key"), F.col(event)], "__at"))
        after = rows.select((F.col("__at") - 1).alias("__at"), F.col(event).alias("__next"), F.col(scene).alias("__scene"))
        paired = rows.join(after, "__at")
    return paired.select(F.col(scene).alias("scene_id"), *_edge("discourse_prior", F.col(scene), F.col("__scene"), F.col(event), F.col("__next"), confidence))


def bucket_components(order: DataFrame, symmetric: DataFrame) -> DataFrame:
    """``order`` with the ``component`` of each event over same-time edges: its bucket, not yet numbered."""
    labels = components(symmetric, "source_event_id", "target_event_id", order.select(F.col("event_id").alias("node")))
    return order.join(labels.withColumnRenamed("node", "event_id"), "event_id")


def buckets(order: DataFrame, symmetric: DataFrame, by: str | None = None) -> DataFrame:
    """``timeline_bucket, event_id, timeline_rank`` (and ``by``): components over same-time edges, numbered by their first member's rank (within a project)."""
    rows = bucket_components(order, symmetric)
    own = [by] if by else []
    first = rows.groupBy(*own, "component").agg(F.min("timeline_rank").alias("first"))
    first = place_in(first, by, ["first", "component"], "n") if by else numbered(first, ["first", "component"], "n")
    return rows.join(first, [*own, "component"]).select(*own, F.format_string("T%03d", F.col("n")).alias("timeline_bucket"), "event_id", "timeline_rank")


#: Ranks of what has no place in story time.
NO_RANK = 10**9


def story_order(rank: str = "timeline_rank", reveal: str = "reveal_order", key: str = "record_id") -> list[Column]:
    """Sort keys of records in story time: rank, then the order of revelation, then id; what has none comes last."""
    return [F.coalesce(F.col(rank), F.lit(NO_RANK)).asc(), F.coalesce(F.col(reveal), F.lit(NO_RANK)).asc(), F.col(key).asc()]


def graph_counts(scenes: DataFrame, events: DataFrame, relations: DataFrame, conflicts: DataFrame, bucket_rows: DataFrame, main: tuple[str, ...] = ("plot", "memory", "unknown")) -> DataFrame:
    """The twelve counts of a timeline graph as one row, each input read once.

    ``events``: event_track; ``relations``: source, relation_type, usable_for_ordering, selected (null where it was not
    a candidate); ``bucket_rows``: timeline_bucket.
    """
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    ordering = F.col("relation_type").isin(*ORDERING)
    e = events.agg(F.count("*").alias("event_count"), n(F.coalesce("event_track", F.lit("unknown")).isin(*main)).alias("main_story_event_count"), n(F.col("event_track") == "context").alias("context_event_count"), n(F.col("event_track") == "forecast").alias("forecast_event_count"))
    r = relations.agg(
        n(F.col("source") == "llm").alias("llm_relation_count"),
        n(ordering).alias("ordering_relation_count"),
        n(F.col("selected")).alias("selected_ordering_relation_count"),
        n(F.col("usable_for_ordering") & ordering & ~F.col("selected")).alias("skipped_ordering_relation_count"),
        n(F.col("source") == "discourse_prior").alias("discourse_prior_relation_count"),
    )
    one = [scenes.agg(F.count("*").alias("scene_count")), e, r, conflicts.agg(F.count("*").alias("conflict_count")), bucket_rows.agg(F.count_distinct("timeline_bucket").alias("timeline_bucket_count"))]
    out = one[0]
    for other in one[1:]:
        out = out.join(F.broadcast(other))  # one row each
    return out


def match_score(memory_evidence: Column, event_evidence: Column, memory_summary: Column, event_summary: Column, same_sequence: Column, similarity=ratio) -> Column:
    """0.55 evidence + 0.35 summary + 0.10 sequence; equal evidence 1, contained 0.9, else the ratio."""
    a, b = (F.trim(text_of(c), F.lit(SPACES)) for c in (memory_evidence, event_evidence))
    evidence = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(similarity(a, b))
    return F.round(0.55 * evidence + 0.35 * similarity(memory_summary, event_summary) + 0.10 * F.coalesce(same_sequence, F.lit(False)).cast("double"), 4)


def match_bounds(memory_evidence: Column, event_evidence: Column, memory_summary: Column, event_summary: Column, same_sequence: Column) -> tuple[Column, Column]:
    """The least and the most that ``match_score`` can be, without a ratio: equal texts have 1, others what their lengths allow."""

    def near(a: Column, b: Column, least: bool) -> Column:
        a, b = (F.trim(text_of(c), F.lit(SPACES)) for c in (a, b))
        most = 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))
        return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.lit(0.0) if least else most)

    return tuple(match_score(memory_evidence, event_evidence, memory_summary, event_summary, same_sequence, lambda a, b, n=n: near(a, b, n)) for n in (True, False))


def match_memories(memories: DataFrame, events: DataFrame, score: Column, time_bound: Column, min_score: float = MIN_MATCH, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """Each memory with the best event of its scene (of equal scores the first): status, event, score.

    Status: matched, unmatched, no_scene_temporal_event, scope_not_story_time_bound.
    ``memories`` has record_id and scene_id, ``events`` event_id, scene_id and event_position; ``score`` reads both sides as m and e.
    With ``bounds`` (the least and the most that the score can be) only pairs that may be the best are scored; the rows are the same.
    """
    bound, e, same_scene = memories.where(time_bound), events.alias("e"), F.col("m.scene_id") == F.col("e.scene_id")
    if bounds is None:
        tried = bound.alias("m").join(e, same_scene)
    else:
        least = bound.alias("m").join(e, same_scene).groupBy(F.col("m.record_id").alias("record_id")).agg(F.greatest(F.max(bounds[0]), F.lit(min_score)).alias("__least"))
        tried = bound.join(least, "record_id").alias("m").join(e, same_scene).where(bounds[1] >= F.col("m.__least"))
    pairs = tried.select(F.col("m.record_id").alias("record_id"), F.col("e.event_id").alias("event_id"), F.col("e.event_position").alias("at"), score.alias("score"))
    best = pairs.groupBy("record_id").agg(F.max(F.struct("score", (-F.col("at")).alias("at"), "event_id")).alias("b")).select("record_id", "b.score", "b.event_id")
    counts = events.groupBy("scene_id").agg(F.count("*").alias("candidate_count"))
    joined = memories.withColumn("__bound", time_bound).join(best, "record_id", "left").join(counts, "scene_id", "left")
    hit = F.col("score") >= min_score
    status = F.when(~F.col("__bound"), "scope_not_story_time_bound").when(hit, "matched").when(F.coalesce("candidate_count", F.lit(0)) > 0, "unmatched").otherwise("no_scene_temporal_event")
    return joined.select(*memories.columns, status.alias("memory_timeline_index_status"), F.when(F.col("__bound") & hit, F.col("event_id")).alias("story_event_id"), F.when(F.col("__bound"), F.when(hit, F.col("score")).otherwise(0.0)).alias("story_time_match_score"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_event_count"))
