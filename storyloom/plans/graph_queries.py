"""Queries of graphs and story time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graphs import components, cycle_conflicts, cyclic_nodes, degrees, normalized_edges, pair_conflicts, select_acyclic, strong_components, topological
from ..operators.social import beat_sequences, merged_effects, pressure_edges
from ..operators.timeline import bucket_components, buckets, discourse_priors, graph_counts, match_bounds, match_memories, match_score, scene_priors
from ..sources.scratch import written
from .registry import query


@query("""
WITH e AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
f AS (SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1), g AS (SELECT user_id, event_id, lead(event_id) OVER w AS nxt, lead(user_id) OVER w AS nu FROM f WINDOW w AS (ORDER BY ts, event_id))
SELECT 'scene_block_prior:' || event_id || '->' || nxt AS relation_id, event_id AS source_event_id, nxt AS target_event_id, 0.55 AS confidence FROM e WHERE nxt IS NOT NULL
UNION ALL SELECT 'discourse_prior:' || user_id || '->' || nu, event_id, nxt, 0.35 FROM g WHERE nxt IS NOT NULL
""")
def timeline_priors(t) -> DataFrame:
    """Priors between neighbouring events of a scene (a user) and between first events of scenes."""
    order = [F.col("ts"), F.col("event_id")]
    both = scene_priors(t.events, "user_id", order).unionByName(discourse_priors(t.events, "user_id", order, F.col("ts")))
    return both.select("relation_id", "source_event_id", "target_event_id", "confidence")


def _relations(t) -> DataFrame:
    """Relations between a user's events: to the next one, of a kind by its type; from signups back to the one before and from errors to the one before that; from views to the one after next at the same time. Events of little value point at an event that is not there."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.events.select("user_id", "event_id", "event_type", "value", (F.get_json_object("props", "$.k").try_cast("double") / 100).alias("confidence"), F.lead("event_id").over(w).alias("n1"), F.lead("event_id", 2).over(w).alias("n2"), F.lag("event_id").over(w).alias("p1"), F.lag("event_id", 2).over(w).alias("p2"))
    of = lambda kind, to: F.when(F.col("event_type") == kind, F.col(to))
    kind = F.when(F.col("event_type") == "click", "after").when(F.col("event_type") == "purchase", "causes").otherwise("before")
    edge = lambda tag, to, k: F.when(to.isNotNull(), F.struct(F.concat(F.lit(f"{tag}_"), "event_id").alias("relation_id"), F.concat(F.when(F.col("value") < 1, "x").otherwise("e"), to).alias("target_event_id"), k.alias("relation_type")))
    edges = [edge("next", F.col("n1"), kind), edge("back", F.coalesce(of("signup", "p1"), of("error", "p2")), F.lit("before")), edge("same", of("view", "n2"), F.lit("same_time"))]
    rows = e.select("user_id", "confidence", F.concat(F.lit("e"), "event_id").alias("source_event_id"), F.explode(F.array_compact(F.array(*edges))).alias("r"))
    return rows.select("user_id", "source_event_id", "confidence", "r.*", F.lit("llm").alias("source"), F.lit(False).alias("is_inferred"))


_REL = """
ev AS (SELECT event_id, user_id, event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS c, CASE WHEN value < 1 THEN 'x' ELSE 'e' END AS mark, lead(event_id) OVER w AS n1, lead(event_id, 2) OVER w AS n2, lag(event_id) OVER w AS p1, lag(event_id, 2) OVER w AS p2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT user_id, 'next_' || event_id AS relation_id, 'e' || event_id AS s0, mark || n1 AS t0, CASE event_type WHEN 'click' THEN 'after' WHEN 'purchase' THEN 'causes' ELSE 'before' END AS k, c FROM ev WHERE n1 IS NOT NULL
  UNION ALL SELECT user_id, 'back_' || event_id, 'e' || event_id, mark || coalesce(CASE WHEN event_type = 'signup' THEN p1 END, CASE WHEN event_type = 'error' THEN p2 END), 'before', c FROM ev WHERE (event_type = 'signup' AND p1 IS NOT NULL) OR (event_type = 'error' AND p2 IS NOT NULL)
  UNION ALL SELECT user_id, 'same_' || event_id, 'e' || event_id, mark || n2, 'same_time', c FROM ev WHERE n2 IS NOT NULL AND event_type = 'view'),
n AS (SELECT user_id, relation_id, CASE WHEN k = 'after' THEN t0 ELSE s0 END AS s, CASE WHEN k = 'after' THEN s0 ELSE t0 END AS t, CASE WHEN k = 'after' THEN 'before' ELSE k END AS k, c, CASE WHEN left(t0, 1) = 'x' THEN 'unknown_endpoint' END AS why FROM r)
"""


def _events(t) -> DataFrame:
    return t.events.select(F.concat(F.lit("e"), "event_id").alias("event_id"), "user_id", F.col("user_id").alias("source_record_id"), F.col("event_id").alias("discourse_index"))


def _edges(t) -> DataFrame:
    return normalized_edges(_relations(t), _events(t))


@query(f"WITH {_REL} SELECT k AS relation_type, coalesce(why, 'usable') AS state, count(*) AS n, round(sum(c), 2) AS confidence FROM n GROUP BY ALL")
def edge_normalisation(t) -> DataFrame:
    """Edges turned forward, with the reason for those that can't order events."""
    return _edges(t).groupBy("relation_type", F.coalesce("unusable_reason", F.lit("usable")).alias("state")).agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("confidence"))


@query(f"""
WITH {_REL}, h AS (SELECT * FROM n WHERE why IS NULL AND c >= 0.75 AND k <> 'same_time'), own AS (SELECT 'self_ordering_edge' AS type, s AS ids, count(*) AS relations FROM h WHERE s = t GROUP BY s),
two AS (SELECT 'two_node_cycle' AS type, least(s, t) || ',' || greatest(s, t) AS ids, count(*) AS relations FROM h WHERE s <> t GROUP BY least(s, t), greatest(s, t) HAVING count(DISTINCT s < t) = 2)
SELECT * FROM own UNION ALL SELECT * FROM two
""")
def timeline_conflicts(t) -> DataFrame:
    """Self edges and pairs that point both ways among confident edges."""
    return pair_conflicts(_edges(t)).select("type", F.array_join("ids", ",").alias("ids"), F.size("relation_ids").cast("long").alias("relations"))


@query()
def timeline_cycles(t) -> DataFrame:
    """Cycles of any length among confident edges, by user, each with its path."""
    return cycle_conflicts(_edges(t), "user_id").select("user_id", "type", F.array_join("ids", ",").alias("ids"))


#: Components in SQL: labels fall along the edges of ``u`` (a, b, both ways) until none changes.
_COMPONENTS = """
cc(node, label) USING KEY (node) AS (SELECT a, min(a) FROM u GROUP BY a UNION SELECT u.b, min(c.label) FROM cc c JOIN u ON u.a = c.node JOIN recurring.cc r ON r.node = u.b WHERE c.label < r.label GROUP BY u.b)
"""


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'o' || l_orderkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), {_COMPONENTS}
SELECT node, label AS component FROM cc
""")
def connected_groups(t) -> DataFrame:
    """Components of suppliers and orders."""
    return components(t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("o"), "l_orderkey").alias("target")))


@query("""
WITH u AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem), v AS (SELECT a AS node, b AS o FROM u UNION ALL SELECT b, a FROM u) SELECT node::BIGINT AS node, count(*) AS degree FROM v GROUP BY node
""")
def node_degrees(t) -> DataFrame:
    """Distinct neighbours of suppliers and parts."""
    return degrees(t.lineitem.select(F.col("l_suppkey").cast("long").alias("source"), (F.col("l_partkey") + 1000000).alias("target")))


@query(f"""
WITH RECURSIVE {_REL}, e AS (SELECT DISTINCT s AS a, t AS b FROM n WHERE why IS NULL AND k = 'same_time' AND c >= 0.75 AND s <> t), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), {_COMPONENTS},
m AS (SELECT event_id, user_id, coalesce(label, 'e' || event_id) AS component, min(event_id) OVER (PARTITION BY user_id, coalesce(label, 'e' || event_id)) AS first FROM events LEFT JOIN cc ON node = 'e' || event_id)
SELECT user_id, printf('T%03d', dense_rank() OVER (PARTITION BY user_id ORDER BY first, component)) AS timeline_bucket, 'e' || event_id AS event_id FROM m
""")
def timeline_buckets(t) -> DataFrame:
    """Buckets of a user's events that happen at the same time, numbered by their first member."""
    same = _edges(t).where("usable_for_ordering AND relation_type = 'same_time' AND confidence >= 0.75")
    order = _events(t).select("event_id", "user_id", F.col("discourse_index").alias("timeline_rank"))
    return buckets(order, same, "user_id").select("user_id", "timeline_bucket", "event_id")


def _chosen(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordering edges with the verdict of the greedy choice, those in conflict blocked."""
    edges = every.where("relation_type <> 'same_time'")
    conflicts = pair_conflicts(edges).select(F.explode("relation_ids").alias("relation_id"))
    return edges, select_acyclic(edges, conflicts, by="user_id")


@query()
def timeline_order(t) -> DataFrame:
    """The story order of every user's events over the greedily chosen acyclic edges."""
    edges, verdicts = _chosen(written(_edges(t).where("relation_type <> 'same_time'")))
    return topological(_events(t), edges.join(verdicts.where("selected").select("relation_id"), "relation_id"), "user_id")


@query()
def timeline_counts(t) -> DataFrame:
    """The counts of the whole timeline graph."""
    every = written(_edges(t))
    edges, verdicts = _chosen(every)
    relations = every.join(verdicts.select("relation_id", "selected"), "relation_id", "left")
    track = F.try_element_at(F.create_map(*map(F.lit, ("view", "context", "click", "forecast", "purchase", "plot", "signup", "memory"))), F.col("event_type"))
    same = every.where("usable_for_ordering AND relation_type = 'same_time' AND confidence >= 0.75")
    found = pair_conflicts(edges).select("type").unionByName(cycle_conflicts(edges, "user_id").select("type"))
    order = _events(t).select("event_id", "user_id", F.col("discourse_index").alias("timeline_rank"))
    own = bucket_components(order, same).select(F.concat_ws(":", "user_id", "component").alias("timeline_bucket"))  # as many as are numbered
    return graph_counts(t.events.select("user_id").distinct(), t.events.select(track.alias("event_track")), relations, found, own)


@query(f"""
WITH RECURSIVE {_REL}, h AS (SELECT DISTINCT s, t FROM n WHERE why IS NULL AND c >= 0.75 AND k <> 'same_time' AND s <> t),
w AS (SELECT s, t FROM h UNION SELECT w.s, h.t FROM w JOIN h ON h.s = w.t), o AS (SELECT s AS c FROM w WHERE s = t),
i AS (SELECT c AS node FROM o UNION SELECT t FROM w JOIN o ON c = s), f AS (SELECT c AS node FROM o UNION SELECT s FROM w JOIN o ON c = t)
SELECT node FROM i INTERSECT SELECT node FROM f
""")
def cycle_members(t) -> DataFrame:
    """Events on or between cycles of confident edges."""
    edges = _edges(t).where("usable_for_ordering AND relation_type <> 'same_time' AND source_event_id <> target_event_id AND confidence >= 0.75")
    return cyclic_nodes(edges, "source_event_id", "target_event_id")


@query(f"""
WITH RECURSIVE {_REL}, h AS (SELECT DISTINCT s, t FROM n WHERE why IS NULL AND k <> 'same_time' AND s <> t),
w AS (SELECT s, t FROM h UNION SELECT w.s, h.t FROM w JOIN h ON h.s = w.t)
SELECT w.s AS node, min(w.t) AS component FROM w JOIN w AS v ON v.s = w.t AND v.t = w.s WHERE w.s IN (SELECT s FROM w WHERE s = t) GROUP BY w.s
""")
def cycle_components(t) -> DataFrame:
    """Events that lie on a cycle of any usable ordering edges, with the least event of those on cycles with it."""
    edges = _edges(t).where("usable_for_ordering AND relation_type <> 'same_time'")
    return strong_components(edges, "source_event_id", "target_event_id", "user_id")


@query()
def memory_event_match(t) -> DataFrame:
    """Turns as memories against all turns of their conversation as events, by their whole texts."""
    c = t.conversations
    memories = c.select(F.concat_ws(":", "conv_id", "turn").alias("record_id"), F.col("conv_id").alias("scene_id"), F.col("text").alias("evidence_text"), "role", F.col("turn").alias("sequence_index"))
    events = c.select(F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.col("conv_id").alias("scene_id"), F.col("text").alias("evidence"), F.col("role").alias("summary"), F.col("turn").alias("event_position"))
    sides = F.col("m.evidence_text"), F.col("e.evidence"), F.col("m.role"), F.col("e.summary"), F.col("m.sequence_index") == F.col("e.event_position")
    return match_memories(memories, events, match_score(*sides), F.col("role") != "system", bounds=match_bounds(*sides)).select("record_id", "memory_timeline_index_status", "story_event_id", "story_time_match_score", "candidate_event_count")


def _characters(t) -> DataFrame:
    return t.supplier.select(F.concat_ws("-", "s_nationkey", F.floor(F.col("s_suppkey") / 250).cast("string")).alias("scene"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 5).alias("support_count"), (F.col("s_suppkey") % 7 / 10 + 0.3).alias("relevance"), (F.col("s_suppkey") % 4 / 4).alias("care"), (F.col("s_suppkey") % 3 / 3).alias("trust"), (F.col("s_suppkey") % 11 / 11).alias("arousal"))


@query("""
WITH c AS (SELECT s_nationkey || '-' || (s_suppkey // 250) AS scene, s_name AS name, CASE WHEN s_suppkey % 5 > 0 THEN least(1.0, 0.45 + 0.15 * log2(s_suppkey % 5 + 1)) ELSE 0.2 END AS support, (s_suppkey % 7) / 10.0::DOUBLE + 0.3 AS relevance, (s_suppkey % 4) / 4.0::DOUBLE AS care, (s_suppkey % 3) / 3.0::DOUBLE AS trust, (s_suppkey % 11) / 11.0::DOUBLE AS arousal FROM supplier),
p AS (SELECT a.scene, a.name AS source, b.name AS target, round(least(1.0, 0.35 * a.support + 0.25 * greatest(a.relevance, b.relevance) + 0.2 * greatest(a.care, a.trust) + 0.1 * 0.7 + 0.1 * greatest(a.arousal, b.arousal)), 3) AS strength FROM c a JOIN c b ON a.scene = b.scene AND a.name <> b.name)
SELECT scene, source, target, strength, CASE WHEN strength >= 0.75 THEN 'high' ELSE 'normal' END AS priority FROM p WHERE strength >= 0.35
""")
def pressure_edge_rows(t) -> DataFrame:
    """Pressure between the suppliers of a scene: of a nation, with neighbouring keys."""
    return pressure_edges(_characters(t), ["scene"])


@query("""
WITH x AS (SELECT l_returnflag AS g, ['deflection', 'care_reframe', 'information_probe'][(l_linenumber % 3) + 1] AS a FROM lineitem), v AS (SELECT * FROM (VALUES ('deflection', 'resistance', 0.1), ('deflection', 'information_clarity', -0.1), ('care_reframe', 'care_visible', 0.25), ('care_reframe', 'relationship_tension', -0.05), ('information_probe', 'information_clarity', 0.15), ('information_probe', 'relationship_tension', 0.05)) t(a, effect, v))
SELECT g AS l_returnflag, effect, round(sum(v::DOUBLE), 3) AS value FROM x JOIN v USING (a) GROUP BY ALL
""")
def merged_effect_rows(t) -> DataFrame:
    """Summed effects of actions by group."""
    kind = F.element_at(F.array(*map(F.lit, ("deflection", "care_reframe", "information_probe"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return merged_effects(t.lineitem.select("l_returnflag", kind.alias("action_type")), ["l_returnflag"])


@query()
def beat_selection(t) -> DataFrame:
    """The best covering sequence of beats of each scene's suppliers."""
    kinds, acts = ("value_resistance", "care_guidance", "safety_correction"), ("risky_operation", "safety_correction", "minimal_compliance", "physical_reaction", "care_reframe")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.abs(n) % len(values) + 1).cast("int"))
    edges = pressure_edges(_characters(t), ["scene"]).withColumn("kind", pick(kinds, F.xxhash64("source", "target")))
    people = _characters(t).select("scene", F.col("name").alias("actor"), F.explode(F.array(*map(F.lit, acts))).alias("action_type"))
    actions = people.select("scene", F.concat_ws(":", "actor", "action_type").alias("action_id"), "actor", "action_type", (F.abs(F.xxhash64("actor", "action_type")) % 100 / 100).alias("score"))
    return beat_sequences(edges, actions, "scene")
