"""Queries on entities, relations and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_set
from ..operators.entities import align_candidates, disambiguate, group_mentions, registry, resolve_exact, resolve_fuzzy, resolve_types
from ..operators.graphs import one_hop
from ..operators.metrics import counters, deltas, judged, row_counts, weighted_mean
from ..operators.prefix import parent_rollup, visible_to
from ..operators.ranking import batches, in_given_order, last_wins, neighbours, stated
from ..operators.relations import attach_assets, attach_clusters, clusters, fact_jobs, inverted_index, pseudo_relations, relationship_states, source_local_entities, source_local_relationships, source_scopes
from ..operators.retrieval import entity_memories
from .registry import query

TYPES = {"view": "device", "click": "event", "purchase": "group", "signup": "character", "error": "place"}
_case = "CASE event_type WHEN 'view' THEN 'object' WHEN 'click' THEN 'occasion' WHEN 'purchase' THEN 'group' WHEN 'signup' THEN 'character' ELSE 'concept' END"


def _kind():
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.col("event_type"))


@query(r"""
WITH m AS (SELECT p_name, p_brand, p_partkey, regexp_replace(lower(trim(p_name)), '[\s,\-.，。:：/（）()]+', '', 'g') AS name_key FROM part)
SELECT name_key, arg_min(p_name, p_partkey) AS canonical_name, count(DISTINCT p_name) AS alias_count, count(DISTINCT p_brand) AS scene_count, count(*) AS mention_count FROM m GROUP BY name_key
""")
def alias_normalise_group(t) -> DataFrame:
    """Parts by normalised name."""
    rows = group_mentions(t.part, "p_name", "p_brand", [F.col("p_partkey")])
    return rows.select("name_key", "canonical_name", F.size("aliases").cast("long").alias("alias_count"), F.size("scene_ids").cast("long").alias("scene_count"), "mention_count")


@query(rf"""
WITH m AS (SELECT e.user_id, e.event_id, {_case} AS t, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey),
n AS (SELECT c_name, t, count(*) AS n FROM m GROUP BY ALL),
o AS (SELECT *, list_position(['character', 'group', 'organization', 'object', 'location', 'occasion', 'concept'], t) AS p FROM n),
b AS (SELECT c_name, max(CASE WHEN t = 'group' THEN n END) AS g, max(CASE WHEN t = 'character' THEN n END) AS c, first(t ORDER BY n DESC, p) AS top FROM o GROUP BY c_name),
r AS (SELECT regexp_replace(lower(c_name), '[\s,\-.，。:：/（）()]+', '', 'g') AS entity_key, c_name AS canonical_name, min(event_id) AS first_seen, count(*) AS mention_count FROM m GROUP BY c_name)
SELECT r.entity_key, r.canonical_name, r.first_seen, r.mention_count, CASE WHEN g > 0 AND c > 0 THEN CASE WHEN g >= c THEN 'group' ELSE 'character' END ELSE top END AS entity_type FROM r JOIN b ON b.c_name = r.canonical_name
""")
def entity_registry(t) -> DataFrame:
    """Customers as entities of their events: type by majority, first event, mentions."""
    mentions = t.events.join(t.customer, F.col("user_id") == F.col("c_custkey")).select(F.col("c_name").alias("name"), _kind().alias("entity_type"), F.col("event_id").alias("scene_id"))
    return registry(mentions).select("entity_key", "canonical_name", F.col("first_seen_scene").alias("first_seen"), "mention_count", "entity_type")


@query(rf"""
WITH n AS (SELECT user_id, {_case} AS t, count(*) AS n FROM events GROUP BY ALL),
o AS (SELECT *, CASE t WHEN 'character' THEN 6 WHEN 'organization' THEN 5 WHEN 'group' THEN 4 WHEN 'location' THEN 4 WHEN 'object' THEN 3 WHEN 'occasion' THEN 3 ELSE 1 END AS s FROM n)
SELECT user_id, first(t ORDER BY n DESC, s DESC, t) AS entity_type, count(*) > 1 AS entity_type_conflict, sum(n)::BIGINT AS evidence_count FROM o GROUP BY user_id
""")
def type_resolution(t) -> DataFrame:
    """A user's type by frequency, then specificity."""
    return resolve_types(t.events.withColumn("entity_type", _kind()), ["user_id"])


@query("""
SELECT source AS source_scope_id, min(source) AS source_scope_name, count(*) AS doc_count, count(DISTINCT lang) AS path_count, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id FROM documents GROUP BY source
""")
def source_scopes_by_language(t) -> DataFrame:
    """Sources with their documents and languages counted."""
    return source_scopes(t.documents.select(F.col("source").alias("source_scope_id"), F.col("source").alias("source_scope_name"), "doc_id", F.col("lang").alias("source_path")))


@query("""
SELECT l.l_suppkey AS entity_id, count(*) AS memories, count(DISTINCT o.o_orderkey) AS orders, min(o.o_orderdate) AS first_seen, max(o.o_orderdate) AS last_seen, round(sum(l.l_quantity), 3) AS quantity
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderdate < TIMESTAMP '1997-01-01' AND l_returnflag <> 'A' GROUP BY l.l_suppkey
""")
def entity_memories_before(t) -> DataFrame:
    """What each supplier is linked to before a date."""
    links = t.lineitem.select(F.col("l_orderkey").alias("memory_id"), F.col("l_suppkey").alias("entity_id"), "l_quantity", "l_returnflag")
    memories = t.orders.select(F.col("o_orderkey").alias("memory_id"), "o_orderdate")
    joined = entity_memories(links, memories, F.col("l_returnflag") != "A", F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))
    return joined.groupBy("entity_id").agg(F.count("*").alias("memories"), F.count_distinct("memory_id").alias("orders"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), F.round(F.sum("l_quantity"), 3).alias("quantity"))


@query("""
WITH e AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS weight FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL), n AS (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal < 0), q AS (SELECT p_partkey FROM part WHERE p_size = 1)
SELECT e.s AS supplier, e.p AS part, weight, s2.s_name AS supplier_name, p2.p_name AS part_name, (n.s_suppkey IS NOT NULL AND q.p_partkey IS NOT NULL) AS is_between_matched
FROM e LEFT JOIN n ON n.s_suppkey = e.s LEFT JOIN q ON q.p_partkey = e.p LEFT JOIN supplier s2 ON s2.s_suppkey = e.s LEFT JOIN part p2 ON p2.p_partkey = e.p WHERE n.s_suppkey IS NOT NULL OR q.p_partkey IS NOT NULL
""")
def one_hop_relations(t) -> DataFrame:
    """Edges that touch matched suppliers or parts before a date, with the names of both ends."""
    edges = t.lineitem.where("l_shipdate < TIMESTAMP '1999-01-01'").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight"))
    named = edges.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), "weight", F.col("l_suppkey").cast("long").alias("supplier"), F.col("l_partkey").alias("part"))
    nodes = t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node")).unionByName(t.part.where("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("node")))
    near = one_hop(named, nodes)
    names = near.join(t.supplier.select(F.col("s_suppkey").cast("long").alias("supplier"), F.col("s_name").alias("supplier_name")), "supplier", "left").join(t.part.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("part_name")), "part", "left")
    return names.select("supplier", "part", "weight", "supplier_name", "part_name", "is_between_matched")


@query("""
WITH ids AS (SELECT * FROM (VALUES (42, 0), (7, 1), (199, 2), (3, 3)) v(doc_id, position)) SELECT position::INT AS position, d.doc_id, lang, source, n_chars FROM documents d JOIN ids USING (doc_id)
""")
def ids_in_order(t) -> DataFrame:
    """Documents by a list of ids, with their place in it; unknown ids are left out."""
    return in_given_order(t.documents, "doc_id", [42, 7, 199, 42, 3, 10**9]).select("position", "doc_id", "lang", "source", "n_chars")


@query()
def fuzzy_entity_refs(t) -> DataFrame:
    """The words of all benchmark texts as misspelt or partial references to parts' names and brands."""
    names = t.part.groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("entity_id"), F.count("*").alias("mention_count"), F.min("p_partkey").alias("first_seen_order"))
    brands = t.part.groupBy(F.col("p_brand").alias("alias")).agg((-F.min("p_partkey") - 1).alias("entity_id"), F.count("*").alias("mention_count"), F.min("p_partkey").alias("first_seen_order"))
    refs = t.benchmark.select(F.explode(token_set("text")).alias("ref")).distinct()
    return resolve_fuzzy(refs, names.unionByName(brands).withColumn("entity_id", F.col("entity_id").cast("string")))


@query("""
WITH e AS (SELECT p_brand AS scope, p_name AS k, p_type AS c FROM part), s AS (SELECT scope, k, max(c) AS c1 FROM e GROUP BY ALL), u AS (SELECT k, min(c) AS c2 FROM e GROUP BY k HAVING count(DISTINCT c) = 1),
r AS (SELECT p.p_partkey, p.p_brand AS scope, p.p_name AS s, q.p_name || CASE WHEN q.p_partkey % 3 = 0 THEN ' x' ELSE '' END AS t FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)
SELECT p_partkey, coalesce(s1.c1, u1.c2, '') AS src_cluster_id, coalesce(s2.c1, u2.c2, '') AS tgt_cluster_id FROM r LEFT JOIN s s1 ON s1.scope = r.scope AND s1.k = r.s LEFT JOIN u u1 ON u1.k = r.s LEFT JOIN s s2 ON s2.scope = r.scope AND s2.k = r.t LEFT JOIN u u2 ON u2.k = r.t
""")
def relation_clusters(t) -> DataFrame:
    """Clusters of the two ends of relations between parts, by brand and name, else by a name of one type."""
    p = t.part
    entities = p.select(F.col("p_brand").alias("source_scope_id"), F.col("p_name").alias("entity_name"), F.col("p_type").alias("cluster_id"))
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " x").otherwise("")).alias("tgt_id"))
    relations = p.select("p_partkey", F.col("p_brand").alias("source_scope_id"), F.col("p_name").alias("src_id")).join(other, "p_partkey")
    return attach_clusters(relations, entities).select("p_partkey", "src_cluster_id", "tgt_cluster_id")


@query("""
WITH a AS (SELECT s_nationkey AS n_nationkey, list_sort(list_distinct(list('supplied by ' || s_name))) AS facts FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey)
SELECT n.n_nationkey, n_name, coalesce(len(facts), 0)::INT AS facts, coalesce(array_to_string(facts, '; '), '') AS said FROM nation n LEFT JOIN a USING (n_nationkey)
""")
def entity_dimensions(t) -> DataFrame:
    """Nations with the statements that name them; those without any are kept."""
    facts = t.supplier.where("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit("supplied by "), "s_name").alias("statement"))
    return attach_assets(t.nation.select("n_nationkey", "n_name"), facts, "n_nationkey", "facts").select("n_nationkey", "n_name", F.size("facts").alias("facts"), F.array_join("facts", "; ").alias("said"))


@query("""
WITH e AS (SELECT 's' || s_suppkey AS id, lower(replace(s_name, ' ', '')) AS k FROM supplier), x AS (SELECT DISTINCT 'supplier#' || lpad((c_custkey % 200)::VARCHAR, 9, '0') AS ref FROM customer UNION SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey = 3)
SELECT ref, coalesce(a.id, b.id) AS entity_id FROM x LEFT JOIN e a ON a.id = x.ref LEFT JOIN e b ON b.k = lower(replace(x.ref, ' ', ''))
""")
def resolve_references(t) -> DataFrame:
    """References by id, else by alias."""
    entities = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), "s_name", "s_nationkey")
    aliases = entities.select("entity_id", F.lower(F.replace("s_name", F.lit(" "), F.lit(""))).alias("normalized_alias"))
    refs = t.customer.select(F.format_string("supplier#%09d", F.col("c_custkey") % 200).alias("ref")).distinct().unionByName(entities.where("s_nationkey = 3").select(F.col("entity_id").alias("ref")))
    return resolve_exact(refs, entities, aliases).select("ref", "entity_id")


@query(r"""
WITH c AS (SELECT p_partkey, unnest(list_distinct([replace(lower(p_name), ' ', ''), replace(lower(p_brand || p_type), ' ', '')])) AS k FROM part), i AS (SELECT regexp_replace(k, '[\s,\-.:/()]+', '', 'g') AS k, min(p_partkey) AS candidate_id FROM c GROUP BY 1)
SELECT l.p_brand, l.p_type, i.candidate_id FROM (SELECT DISTINCT p_brand, p_type FROM part) l LEFT JOIN i ON i.k = regexp_replace(lower(l.p_brand || l.p_type), '[\s,\-.:/()]+', '', 'g')
""")
def candidate_alignment(t) -> DataFrame:
    """Extracted names to the first candidate with any such alias."""
    c = t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("canonical_name"), F.array(F.concat("p_brand", "p_type")).alias("aliases"))
    links = t.part.select("p_brand", "p_type").distinct().withColumn("entity", F.concat("p_brand", "p_type"))
    return align_candidates(links, c).select("p_brand", "p_type", "candidate_id")


@query("""
WITH u AS (SELECT CASE WHEN l_linestatus = 'O' AND l_suppkey > l_partkey THEN l_partkey ELSE l_suppkey END AS s, CASE WHEN l_linestatus = 'O' AND l_suppkey > l_partkey THEN l_suppkey ELSE l_partkey END AS t, l_returnflag AS k, l_shipdate, l_orderkey, l_linenumber FROM lineitem)
SELECT s AS source_entity_id, t AS target_entity_id, k AS relation_type, min(l_shipdate) AS first_seen_scene, max(l_shipdate) AS last_updated_scene, round(count(*) * 0.25, 3) AS strength, count(*) AS update_count FROM u GROUP BY ALL
""")
def relationship_state(t) -> DataFrame:
    """Supplier and part relations as states: summed strength, first and last scene; open lines are undirected."""
    u = t.lineitem.select(F.col("l_suppkey").cast("long").alias("source_entity_id"), F.col("l_partkey").alias("target_entity_id"), F.col("l_returnflag").alias("relation_type"), F.when(F.col("l_linestatus") == "O", "undirected").otherwise("directed").alias("direction"), F.col("l_shipdate").alias("scene_id"), F.col("l_orderkey").alias("record_id"), F.lit(0.25).alias("strength_delta"))
    return relationship_states(u).drop("direction")


@query("""
SELECT source AS source_scope_id, lang AS entity_name, count(DISTINCT trim(lang || ' ' || (n_chars // 1000)))::INT AS descriptions, count(*) AS mentions, count(DISTINCT doc_id)::INT AS docs FROM documents GROUP BY ALL
""")
def source_local_entity_rows(t) -> DataFrame:
    """Languages as entities of their sources, with distinct descriptions in order."""
    rows = t.documents.select(F.col("source").alias("source_scope_id"), F.col("lang").alias("entity_name"), F.concat_ws(" ", "lang", F.floor(F.col("n_chars") / 1000)).alias("description"), F.col("doc_id").alias("timestamp"), F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("source_doc_id"))
    return source_local_entities(rows).select("source_scope_id", "entity_name", F.size("descriptions").alias("descriptions"), "mentions", F.size("source_doc_ids").alias("docs"))


@query("""
WITH r AS (SELECT n1.n_regionkey AS scope, n1.n_name AS s, n2.n_name AS t, o.o_orderpriority AS k, o.o_orderkey AS d, l.l_discount AS w FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n1 ON n1.n_nationkey = s.s_nationkey JOIN nation n2 ON n2.n_nationkey = c.c_nationkey WHERE n1.n_name <> n2.n_name)
SELECT scope AS source_scope_id, least(s, t) AS a, greatest(s, t) AS b, max(w) AS weight, count(DISTINCT k)::INT AS keyword_count, count(DISTINCT d)::INT AS docs FROM r GROUP BY ALL
""")
def source_local_relation_rows(t) -> DataFrame:
    """Trade between nations as relations of a region, in unordered pairs."""
    l, o, c, s, n = t.lineitem, t.orders, t.customer, t.supplier, t.nation
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey)
    a, b = stated(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src_id"), F.col("n_regionkey").alias("source_scope_id"))), stated(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("tgt_id")))
    rows = rows.join(a, "s_nationkey").join(b, "c_nationkey").select("source_scope_id", "src_id", "tgt_id", F.col("o_orderpriority").alias("keywords"), F.lit("trades with").alias("description"), F.col("l_discount").alias("weight"), F.col("o_orderkey").alias("timestamp"), F.col("l_linenumber").cast("string").alias("source_id"), F.col("o_orderkey").alias("source_doc_id"))
    return source_local_relationships(rows).select("source_scope_id", "a", "b", "weight", F.size(F.split("keywords", ", ")).alias("keyword_count"), F.size("source_doc_ids").alias("docs"))


@query("""
WITH e AS (SELECT p_brand AS cluster_id, p_name, p_type, p_size FROM part), r AS (SELECT DISTINCT p.p_brand AS c, 'nation ' || s.s_nationkey AS o FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey)
SELECT cluster_id, count(DISTINCT p_name)::INT AS alias_count, count(DISTINCT p_type) AS source_coverage, count(DISTINCT p_size) AS evidence_degree, count(*) AS member_count, (SELECT count(*) FROM r WHERE r.c = e.cluster_id) AS global_pseudo_degree FROM e GROUP BY cluster_id
""")
def entity_clusters_degree(t) -> DataFrame:
    """Brands as clusters: coverage, evidence degree, and degree by the nations that supply them."""
    entities = t.part.select(F.col("p_brand").alias("cluster_id"), F.col("p_name").alias("entity_name"), F.col("p_type").alias("source_scope_id"), F.col("p_size").alias("source_doc_id"))
    edges = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("p_brand").alias("src_cluster_id"), F.concat(F.lit("nation "), "s_nationkey").alias("tgt_cluster_id")).distinct()
    return clusters(entities, edges).select("cluster_id", F.size("aliases").alias("alias_count"), "source_coverage", "evidence_degree", "member_count", "global_pseudo_degree")


@query("""
WITH r AS (SELECT least(p.p_brand, 'nation ' || s.s_nationkey) AS a, greatest(p.p_brand, 'nation ' || s.s_nationkey) AS b, l.l_quantity AS w, l.l_returnflag AS d FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey)
SELECT 'ref_pseudo_rel_' || sha1(a || '|' || b) AS pseudo_relation_id, a, b, round(sum(w), 3) AS weight, count(*) AS member_count, count(DISTINCT d)::INT AS docs FROM r GROUP BY a, b
""")
def pseudo_relation_rows(t) -> DataFrame:
    """Relations between clusters with summed weights."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.col("p_brand").alias("src_cluster_id"), F.concat(F.lit("nation "), "s_nationkey").alias("tgt_cluster_id"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("source_doc_id"))
    return pseudo_relations(rows).select("pseudo_relation_id", "a", "b", F.round("weight", 3).alias("weight"), "member_count", F.size("source_doc_ids").alias("docs"))


@query(r"""
SELECT token, doc_id // 1024 AS block, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS token FROM documents) GROUP BY ALL
""")
def inverted_index_tokens(t) -> DataFrame:
    """Documents of every token, in posting lists of 1,024 ids at most."""
    rows = inverted_index(t.documents, token_set("text"), "doc_id", "token", F.floor(F.col("doc_id") / 1024).cast("long"))
    return rows.select("token", "block", "n", F.get("keys", F.lit(0)).alias("first_doc"), F.element_at("keys", -1).alias("last_doc"))


@query("""
WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, string_agg(text, chr(10) ORDER BY turn) AS s, count(*) AS unit_count, sum(length(text))::BIGINT AS character_count, min(turn) AS first_order, max(turn) AS last_order FROM conversations GROUP BY conv_id)
SELECT conv_id, unit_count, character_count, first_order, last_order, sha256(s) AS summary_sha256, len(list_distinct(roles))::INT AS tag_count FROM c
""")
def parent_rollup_conversations(t) -> DataFrame:
    """Conversations as parents of their turns: ordered text, distinct roles, sizes."""
    rows = parent_rollup(t.conversations, "conv_id", ["turn"], "text", "role")
    return rows.select("conv_id", "unit_count", "character_count", "first_order", "last_order", F.sha2("summary", 256).alias("summary_sha256"), F.size("tags").alias("tag_count"))


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, count(*) FILTER (value < 0) AS negative FROM events GROUP BY event_type
""")
def status_counters(t) -> DataFrame:
    """Counts by status and condition in one aggregate."""
    return counters(t.events, ["event_type"], high=F.col("value") > 50, negative=F.col("value") < 0)


@query("""
SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem
""")
def table_row_counts(t) -> DataFrame:
    return row_counts({name: getattr(t, name) for name in ("documents", "conversations", "events", "lineitem")})


@query("""
WITH j AS (SELECT d.doc_id, d.source, CASE WHEN d.n_chars > 2000 THEN 'core' ELSE 'minor' END AS importance, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1.0 WHEN l.quality = 1 THEN 0.5 ELSE 0.0 END AS score FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, round(sum(CASE importance WHEN 'core' THEN 1.5 ELSE 1.0 END * score) / sum(CASE importance WHEN 'core' THEN 1.5 ELSE 1.0 END), 4) AS score FROM j GROUP BY source
""")
def weighted_scores(t) -> DataFrame:
    """Documents as requirements judged by labels: weighted means by source; the unjudged are not satisfied."""
    requirements = t.documents.select(F.col("doc_id").alias("requirement_id"), "source", F.when(F.col("n_chars") > 2000, "core").otherwise("minor").alias("importance"))
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "satisfied").when(F.col("quality") == 1, "partially satisfied").otherwise("not_satisfied")
    judgments = t.labels.select(F.col("doc_id").alias("requirement_id"), status.alias("status"), F.col("doc_id").alias("seq"))
    return weighted_mean(judged(requirements, judgments), ["source"])


@query("""
WITH s AS (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'generated' ELSE 'reference' END AS side, value FROM events), p AS (SELECT event_type, round(avg(value) FILTER (side = 'generated'), 4) AS generated, round(avg(value) FILTER (side = 'reference'), 4) AS reference FROM s GROUP BY event_type)
SELECT *, round(generated - reference, 4) AS delta FROM p WHERE generated IS NOT NULL AND reference IS NOT NULL
""")
def reference_deltas(t) -> DataFrame:
    """Mean scores of two sides and their difference."""
    return deltas(t.events.select("event_type", F.when(F.col("user_id") % 2 == 0, "generated").otherwise("reference").alias("candidate"), F.col("value").alias("score")), ["event_type"])


@query("""
SELECT conv_id, turn, role, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def neighbour_units(t) -> DataFrame:
    """The roles before and after each turn."""
    return neighbours(t.conversations, ["conv_id"], [F.col("turn")], "role").select("conv_id", "turn", "role", "previous_role", "next_role")


@query("""
SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)
""")
def visibility_semi_anti(t) -> DataFrame:
    """Documents that a reader may see: labelled good and not hidden."""
    docs = t.documents.select(F.col("doc_id").alias("scene_id"), F.col("doc_id").alias("scene_order"), F.col("doc_id").alias("record_id"), "source")
    mentions = t.labels.where("quality = 1").select(F.col("doc_id").alias("scene_id"), F.col("doc_id").alias("scene_order"), F.lit("reader").alias("name"))
    hidden = t.labels.where("toxic = 1").select(F.col("doc_id").alias("record_id"), F.lit("reader").alias("hidden_from"))
    return visible_to(docs, mentions, "reader", 2**62, hidden).select(F.col("record_id").alias("doc_id"), "source")


@query("""
WITH p AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS r FROM orders) SELECT o_custkey, o_orderpriority, o_orderkey FROM p WHERE r = 1
""")
def last_write_wins(t) -> DataFrame:
    """The last row of every key."""
    return last_wins(t.orders, ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""
WITH g AS (SELECT source, lang, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 12 AS batch FROM documents) SELECT source, batch::INT AS batch, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM g GROUP BY ALL
""")
def job_batches(t) -> DataFrame:
    """Chunks of a scope in batches of twelve."""
    rows = batches(t.documents.select("source", "doc_id"), ["source"], [F.col("doc_id")], 12)
    return rows.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("""
WITH c AS (SELECT DISTINCT p.p_brand AS cluster_id, s.s_nationkey AS scope, l.l_orderkey AS doc_id, l.l_linenumber AS chunk_index, l.l_orderkey || '_' || l.l_linenumber AS chunk_id FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey),
o AS (SELECT cluster_id, chunk_id, min(scope) AS scope, any_value(doc_id) AS doc_id, any_value(chunk_index) AS chunk_index FROM c GROUP BY cluster_id, chunk_id),
b AS (SELECT *, (row_number() OVER (PARTITION BY cluster_id, scope ORDER BY doc_id, chunk_index, chunk_id) - 1) // 12 AS batch FROM o)
SELECT cluster_id, scope AS source_scope_id, batch::INT AS batch, count(*)::INT AS chunks, 'ref_job_' || sha1(cluster_id || '|' || scope || '|' || batch) AS job_id FROM b GROUP BY ALL
""")
def fact_job_plan(t) -> DataFrame:
    """Extraction jobs of clusters: chunks by scope in batches of twelve with stable ids."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    chunks = rows.select(F.col("p_brand").alias("cluster_id"), F.col("s_nationkey").alias("source_scope_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunk_id")).distinct()
    degree = t.part.groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count("*").alias("degree"))
    return fact_jobs(degree, chunks).select("cluster_id", "source_scope_id", "batch", F.size("chunk_ids").alias("chunks"), "job_id")


@query()
def disambiguate_entities(t) -> DataFrame:
    """Names of one type that are one name, by last word and likeness."""
    names = t.part.select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    return disambiguate(names.distinct(), "name", "kind")
