"""Queries of state: histories, reconciliation, promotion, prefix commits, conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import state_as_of
from ..operators.context import active_patches, conflicts, external_links, history, promote, reconcile, status_history, timeline_claims
from ..operators.prefix import blocked_units, commit_order, operations, snapshots, state_at, visible_to, world_model
from ..sources.scratch import shared_path
from ..sources.versions import VersionedTable
from .registry import query
from .retrieval_queries import _context_docs


def _log(t) -> DataFrame:
    """Events as the log of items, one item for each user and type."""
    return t.events.select(F.concat_ws(":", "user_id", "event_type").alias("item_id"), F.col("event_id").alias("seq"), "value", "event_type", "user_id", "ts")


@query("""
WITH l AS (SELECT user_id || ':' || event_type AS item_id, event_id AS seq, value FROM events)
SELECT item_id, seq, row_number() OVER w AS version, CASE WHEN row_number() OVER w = 1 THEN 'ADD' ELSE 'UPDATE' END AS event, lag(value) OVER w AS old_number, value AS new_number FROM l WINDOW w AS (PARTITION BY item_id ORDER BY seq)
""")
def history_log(t) -> DataFrame:
    """ADD and UPDATE history with old and new values."""
    rows = history(_log(t), F.col("value"))
    return rows.select("item_id", "seq", F.col("version").cast("long").alias("version"), "event", F.col("old_value").cast("double").alias("old_number"), F.col("new_value").cast("double").alias("new_number"))


_STATUS = "['active', 'superseded', 'rejected', 'archived', 'deleted', 'canonical'][(event_id % 6) + 1]"


@query(f"""
WITH l AS (SELECT user_id AS item_id, event_id AS seq, {_STATUS} AS status FROM events), h AS (SELECT item_id, seq, status, lag(status) OVER w AS old, row_number() OVER w AS v FROM l WINDOW w AS (PARTITION BY item_id ORDER BY seq)),
e AS (SELECT item_id, CASE WHEN v = 1 THEN 'ADD' ELSE 'UPDATE' END AS event FROM h UNION ALL SELECT item_id, CASE status WHEN 'superseded' THEN 'SUPERSEDE' WHEN 'rejected' THEN 'REJECT' WHEN 'archived' THEN 'ARCHIVE' ELSE 'DELETE' END FROM h WHERE v > 1 AND status IN ('superseded', 'rejected', 'archived', 'deleted') AND status <> old)
SELECT item_id, event, count(*) AS n FROM e GROUP BY ALL
""")
def status_history_counts(t) -> DataFrame:
    """Status changes: an update and an event of its own."""
    status = F.element_at(F.array(*map(F.lit, ("active", "superseded", "rejected", "archived", "deleted", "canonical"))), (F.col("event_id") % 6 + 1).cast("int"))
    log = t.events.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), status.alias("status"))
    return status_history(log).groupBy("item_id", "event").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT user_id AS unit, event_type, event_id, value FROM events), o AS (SELECT unit, min(event_id) AS o FROM m GROUP BY unit), c AS (SELECT unit, row_number() OVER (ORDER BY o, unit) AS commit_index FROM o),
p AS (SELECT m.*, row_number() OVER (PARTITION BY event_type ORDER BY commit_index, event_id) AS n, commit_index FROM m JOIN c USING (unit)),
s AS (SELECT commit_index, count(*) AS ops, count(*) FILTER (n = 1) AS created, sum(value) AS total FROM p GROUP BY commit_index)
SELECT commit_index, sum(ops) OVER w::BIGINT AS operation_count, sum(created) OVER w::BIGINT AS entity_count, round(sum(total) OVER w, 2) AS total FROM s WINDOW w AS (ORDER BY commit_index ROWS UNBOUNDED PRECEDING)
""")
def prefix_snapshots(t) -> DataFrame:
    """Counts after each commit; users are units, event types entities."""
    e = t.events
    numbered = e.join(commit_order(e, "user_id", "event_id"), "user_id")
    ops = operations(numbered, "event_type", [F.col("commit_index"), F.col("event_id")], F.col("value") > 50)
    return snapshots(ops, [], value="value").select(F.col("commit_index").cast("long").alias("commit_index"), "operation_count", "entity_count", F.round("total", 2).alias("total"))


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)) WHERE n = 1
""")
def prefix_state(t) -> DataFrame:
    """The state at half of the log: the latest row of each key up to there."""
    half = t.events.agg(F.floor(F.max("event_id") / 2)).first()[0]
    return state_at(t.events, ["user_id", "event_type"], half, [F.col("event_id")], "event_id").select("user_id", "event_type", "event_id", "value")


@query("""
SELECT a.user_id, a.event_id AS bound, s.event_id AS seen_id, s.event_type AS seen_type, s.value AS seen_value
FROM (SELECT user_id, event_id FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') s ON a.user_id = s.user_id AND a.event_id >= s.event_id
""")
def states_at_bounds(t) -> DataFrame:
    """What a user last did before each of their purchases: the state of many keys at many bounds."""
    done = t.events.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("seen_id"), F.col("event_type").alias("seen_type"), F.col("value").alias("seen_value"))
    asked = t.events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bound"))
    return state_as_of(done, asked, ["user_id"], "seen_id", "bound", ["seen_id", "seen_type", "seen_value"])


@query("""
WITH b AS (SELECT max(event_id) AS m FROM events), r AS (SELECT user_id, event_type, event_id, value, CASE WHEN event_id <= m // 3 THEN 0 WHEN event_id <= 2 * (m // 3) THEN 1 ELSE 2 END AS batch FROM events, b),
n AS (SELECT v.version, r.*, row_number() OVER (PARTITION BY v.version, user_id, event_type ORDER BY event_id DESC) AS n FROM r, (SELECT unnest([0, 1, 2]) AS version) v WHERE batch <= v.version AND (batch < 2 OR user_id % 10 = 0))
SELECT version::INT AS version, user_id, event_type, event_id, value FROM n WHERE n = 1
""")
def versioned_upserts(t) -> DataFrame:
    """The log's thirds as upserts by user and type, the last one of every tenth user only; the table as it was after each."""
    third = t.events.agg(F.floor(F.max("event_id") / 3)).first()[0] or 0
    table = VersionedTable(t.spark, shared_path(t.spark, "states"), ["user_id", "event_type"])
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    for batch in (F.col("event_id") <= third, (F.col("event_id") > third) & (F.col("event_id") <= 2 * third), (F.col("event_id") > 2 * third) & (F.col("user_id") % 10 == 0)):
        table.upsert(rows.where(batch), "event_id")
    reads = [table.read(v).select(F.lit(v).alias("version"), "user_id", "event_type", "event_id", "value") for v in table.versions()]
    return reduce(DataFrame.unionByName, reads)


@query("""
WITH seen AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system' AND turn <= 2), hidden AS (SELECT conv_id, turn FROM conversations WHERE length(text) > 600)
SELECT conv_id, turn FROM conversations c WHERE turn <= 2 AND conv_id IN (SELECT conv_id FROM seen) AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.conv_id = c.conv_id AND h.turn = c.turn)
""")
def visible_records(t) -> DataFrame:
    """Turns visible to a character up to the third turn, without hidden ones."""
    c = t.conversations.select(F.col("conv_id").alias("scene_id"), F.col("turn").alias("scene_order"), F.col("role").alias("name"), F.concat_ws(":", "conv_id", "turn").alias("record_id"), "text", "turn")
    hidden = c.where("length(text) > 600").select("record_id", F.lit("system").alias("hidden_from"))
    return visible_to(c, c, "system", 2, hidden).select(F.col("scene_id").alias("conv_id"), "turn")


@query("SELECT DISTINCT conv_id AS scene_id, turn AS scene_order FROM conversations WHERE role = 'assistant' AND turn > 2")
def blocked_future(t) -> DataFrame:
    """Units after a scene that a character must not know."""
    m = t.conversations.select(F.col("conv_id").alias("scene_id"), F.col("turn").alias("scene_order"), F.col("role").alias("name"))
    return blocked_units(m, "assistant", 2)


@query("""
SELECT 'documents' AS layer, source AS key, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'turns', role, count(*) FROM conversations GROUP BY ALL UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY ALL
""")
def world_model_layers(t) -> DataFrame:
    """Records of several layers as one frame."""
    layers = {"documents": t.documents.select(F.col("source").alias("key"), "doc_id"), "turns": t.conversations.select(F.col("role").alias("key"), "turn"), "events": t.events.select(F.col("event_type").alias("key"), "event_id")}
    return world_model(layers).groupBy("layer", "key").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT event_id, user_id % 40 AS u, ['correction', 'creative_decision', 'fact'][(user_id % 3) + 1] AS item_type, (value::INT % 5)::VARCHAR AS statement, event_type FROM events),
known AS (SELECT u, item_type, statement, min(event_id) AS k FROM c WHERE event_type = 'view' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY u, item_type, statement ORDER BY event_id) AS r FROM c WHERE event_type <> 'view'),
a AS (SELECT n.*, CASE WHEN known.k IS NOT NULL OR r > 1 THEN 'NONE' WHEN item_type = 'correction' THEN 'PATCH' WHEN item_type = 'creative_decision' AND event_type = 'signup' THEN 'PROMOTE' ELSE 'ADD' END AS action FROM n LEFT JOIN known USING (u, item_type, statement))
SELECT item_type, action, count(*) AS n FROM a GROUP BY ALL
""")
def reconcile_batch(t) -> DataFrame:
    """Candidates against existing items and each other: NONE, PATCH, PROMOTE or ADD."""
    kind = F.element_at(F.array(F.lit("correction"), F.lit("creative_decision"), F.lit("fact")), (F.col("user_id") % 3 + 1).cast("int"))
    rows = t.events.select(F.col("event_id").cast("string").alias("item_id"), F.col("event_id").alias("seq"), F.lit("conversation").alias("source_type"), kind.alias("item_type"), (F.col("user_id") % 40).cast("string").alias("subject"), (F.rint("value").cast("int") % 5).cast("string").alias("statement"), F.array("event_type").alias("entity_ids"), F.when(F.col("event_type") == "signup", F.lit("story_bible")).alias("promote_to"), "event_type", F.lit("active").alias("status"))
    decided = reconcile(rows.where("event_type <> 'view'"), rows.where("event_type = 'view'"))
    return decided.groupBy("item_type", "action").agg(F.count("*").alias("n"))


@query("""
WITH i AS (SELECT user_id || ':' || event_type AS item_id, max(event_id) AS seq FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT item_id, 'item_' || left(sha1(item_id || chr(10) || 'story_bible'), 16) AS target_item_id, 'link_' || left(sha1(item_id || chr(10) || ('item_' || left(sha1(item_id || chr(10) || 'story_bible'), 16)) || chr(10) || 'promotes'), 16) AS link_id, seq FROM i
""")
def promotion_links(t) -> DataFrame:
    """Promoted items, their links and events."""
    items = _log(t).where("event_type = 'signup'").groupBy("item_id").agg(F.max("seq").alias("seq"), F.lit("active").alias("status"), F.lit("user_explicit").alias("authority"))
    copies, links, events = promote(items, F.lit("story_bible"))
    return links.withColumnRenamed("source_item_id", "item_id").join(events, "item_id").join(copies.select(F.col("item_id").alias("target_item_id")), "target_item_id").select("item_id", "target_item_id", "link_id", "seq")


@query("""
SELECT user_id || '' AS entity_id, event_id AS patch_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'
""")
def entity_patch_order(t) -> DataFrame:
    """Active patches of entities in the order of their creation."""
    from ..operators.ranking import ranked

    patches = t.events.select(F.col("event_id").alias("patch_id"), F.lit("p").alias("project_id"), F.col("user_id").cast("string").alias("entity_id"), F.when(F.col("event_type") == "purchase", "active").otherwise("archived").alias("status"), F.col("ts").alias("created_at"))
    return ranked(active_patches(patches, "p"), ["entity_id"], [F.col("created_at"), F.col("patch_id")], "n").select("entity_id", "patch_id", F.col("n").cast("long").alias("n"))


_TOK = r"list_distinct(regexp_extract_all(lower(statement), '[a-z0-9_]+'))"
_NEG = "(" + " OR ".join(f"contains(lower(statement), '{w}')" for w in ("avoid", "not", "never", "no")) + ")"


@query(f"""
WITH s AS (SELECT printf('i%08d_%04d', conv_id, turn) AS item_id, conv_id, turn, role, text AS statement FROM conversations), i AS (SELECT item_id, conv_id, role, {_TOK} AS t, {_NEG} AS neg, (contains(lower(statement), 'contradict') OR contains(lower(statement), 'conflict')) AS mark FROM s),
p AS (SELECT a.item_id AS external_id, b.item_id AS artifact_id, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS o, a.neg <> b.neg AS differs, a.mark OR b.mark AS mark FROM i a JOIN i b ON a.conv_id = b.conv_id WHERE a.role = 'user' AND b.role = 'assistant' AND len(a.t) > 0 AND len(b.t) > 0)
SELECT external_id, artifact_id, round(CASE WHEN differs THEN 0.6 + least(o, 0.35) ELSE 0.5 + least(o, 0.3) END, 6) AS score FROM p WHERE o > 0 AND (differs OR mark)
""")
def conflict_audit(t) -> DataFrame:
    """Users' against assistants' statements of one conversation: differing negation with common words."""
    c = t.conversations.select(F.format_string("i%08d_%04d", "conv_id", "turn").alias("item_id"), F.lit("fact").alias("item_type"), F.lit("").alias("subject"), F.col("text").alias("statement"), F.array(F.col("conv_id").cast("string")).alias("entity_ids"), "role")
    return conflicts(c.where("role = 'user'"), c.where("role = 'assistant'")).select("external_id", "artifact_id", "score")


@query(r"""
SELECT page_id AS item_id, 'external_subject:' || regexp_extract(url, '^https?://([^/?#]+)', 1) AS entity_id, coalesce(nullif(regexp_extract(url, '\b((?:19|20)\d{2})\b', 1), ''), '') AS timeline_hint FROM pages
""")
def external_exports(t) -> DataFrame:
    """Entity links and timeline claims of external items."""
    items = t.pages.select(F.col("page_id").alias("item_id"), F.lit("timeline_doc").alias("item_type"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("subject"), F.col("url").alias("statement"), F.array().cast("array<string>").alias("entity_ids"))
    return external_links(items).select("item_id", "entity_id").join(timeline_claims(items).select("item_id", "timeline_hint"), "item_id")


@query("""
WITH d AS (SELECT printf('i%08d_%04d', conv_id, turn) AS item_id, ['conversation', 'narrative_artifact', 'external_reference', 'simulation'][((conv_id * 31 + turn * 7) % 4) + 1] AS s, ['active', 'canonical', 'tentative', 'rejected'][((conv_id + turn) % 4) + 1] AS status, role FROM conversations)
SELECT CASE s WHEN 'conversation' THEN 'conversation_layer' WHEN 'narrative_artifact' THEN 'artifact_layer' WHEN 'external_reference' THEN 'external_layer' ELSE 'simulation_layer' END AS layer, count(*) AS n FROM d WHERE role = 'user' AND status <> 'rejected' GROUP BY ALL
""")
def entity_view_layers(t) -> DataFrame:
    """An entity's items by layer."""
    from ..operators.context import entity_view

    return entity_view(_context_docs(t), "entity:user").groupBy("layer").agg(F.count("*").alias("n"))
