"""Queries of retrieval: lexical and vector search, merging, support, binding, fusion, packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import hash_embedding
from ..functions.text import high_level_keywords, low_level_keywords, retrieval_tokens
from ..operators.context import packets
from ..operators.fusion import budget, evidence_packet, fuse, memory_labels, pass_texts
from ..operators.packet import PacketLimits, memory_packet
from ..operators.ranking import binding_top, ranked, section_fill, top_per
from ..operators.retrieval import adaptive_memories, bind, chunk_support, lexical, merge_hits, namespace_top, profile_memories, scan, vector_top
from ..operators.vector_index import VectorIndex
from .registry import query
from .text_queries import overlap_sql, tokens_sql

_HITS = f"""
q AS (SELECT item_id, list_distinct({tokens_sql('text')}) AS qt FROM benchmark), d AS (SELECT doc_id, source, lang, n_chars, list_distinct({tokens_sql('text')}) AS t FROM documents),
s AS (SELECT item_id, doc_id, source, lang, n_chars, {overlap_sql('qt', 't')} AS score FROM d, q WHERE len(list_intersect(qt, t)) > 0),
h AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""


def _queries(t) -> DataFrame:
    return t.benchmark.select("item_id", F.col("text").alias("query"))


def _hits(t, k: int = 10) -> DataFrame:
    """The best documents for every benchmark text, with ranks from 1."""
    scored = lexical(t.documents, _queries(t), keep=("source", "lang", "n_chars"), k=k).drop("query")
    return top_per(scored, ["item_id"], [F.col("score").desc(), F.col("doc_id").asc()], k)


@query(f"WITH {_HITS} SELECT item_id, rank, doc_id, score FROM h WHERE rank <= 5")
def lexical_search(t) -> DataFrame:
    """The five best documents for every benchmark text, by overlap, coverage and density."""
    return _hits(t, 5).select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@query(f"""
WITH q AS (SELECT item_id, list_distinct({tokens_sql('text')}) AS qt FROM benchmark), d AS (SELECT doc_id, lang, list_distinct({tokens_sql('text')}) AS t FROM documents),
s AS (SELECT item_id, doc_id, round(len(list_intersect(qt, t)) + CASE lang WHEN 'en' THEN 0.34 WHEN 'fr' THEN 0.28 WHEN 'de' THEN 0.1 ELSE 0.0 END, 4) AS score, lang FROM d, q)
SELECT item_id, lang, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 4
""")
def namespace_search(t) -> DataFrame:
    """Overlap plus namespace weight, the order without vectors: the four best documents of each language for every benchmark text."""
    docs = t.documents.select("doc_id", F.col("text").alias("content"), F.col("lang").alias("vector_namespace"))
    return namespace_top(docs, _queries(t), 4, {"en": 0.34, "fr": 0.28, "de": 0.1}, "doc_id", "item_id").select("item_id", F.col("vector_namespace").alias("lang"), "doc_id", "score")


@query("""
WITH q AS (SELECT label AS query_id, embedding AS qv FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r = 1),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.qv::DOUBLE[]), 6) AS score FROM embeddings e JOIN q ON e.label <> q.query_id)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
""")
def vector_search_filtered(t) -> DataFrame:
    """The five nearest vectors of other labels for the first vector of each label: filter first, then exact scores."""
    first = ranked(t.embeddings, ["label"], [F.col("vec_id")], "r").where("r = 1").select(F.col("label").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector_top(t.embeddings, first, 5, on=F.col("label") != F.col("query_id")).select("query_id", "vec_id", "score")


@query("""
WITH q AS (SELECT label, vec_id AS query_id, embedding AS qv FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r = 1),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.qv::DOUBLE[]), 6) AS score FROM embeddings e JOIN q ON e.label <> q.label)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
""")
def vector_index_exact(t) -> DataFrame:
    """The ten nearest vectors of other labels for the first vector of each label, through the index: cells that can't hold a better row are not read."""
    first = ranked(t.embeddings, ["label"], [F.col("vec_id")], "r").where("r = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    return VectorIndex.build(t.embeddings).search(first, 10, exact=True, apart="label")


@query()
def vector_index_search(t) -> DataFrame:
    """The ten nearest vectors of every twentieth vector, itself among them, in the cells nearest to it."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return VectorIndex.build(t.embeddings).search(asked, 10)


@query()
def hash_embeddings(t) -> DataFrame:
    """Hash embeddings of all documents."""
    return t.documents.select("doc_id", hash_embedding(64)(retrieval_tokens("text")).alias("embedding"))


@query(f"""
WITH {_HITS} SELECT doc_id, max(score) AS best_score, min(rank) AS first_rank, count(*) AS hits FROM h WHERE rank <= 10 GROUP BY doc_id
""")
def merge_hit_lists(t) -> DataFrame:
    """Best score and first rank of documents over all hit lists."""
    return merge_hits(_hits(t), ["doc_id"]).select("doc_id", "best_score", F.col("first_rank").cast("long").alias("first_rank"), "hits")


@query(f"""
WITH {_HITS}, c AS (SELECT doc_id, score, ['chunk', 'entity', 'relation', 'fact', 'property'][(item_id % 5) + 1] AS kind FROM h WHERE rank <= 10)
SELECT doc_id, round(coalesce(max(CASE WHEN kind = 'chunk' THEN score + 1.0 END), 0.0) + coalesce(sum(CASE kind WHEN 'entity' THEN 0.8 + 0.1 * score WHEN 'relation' THEN 0.7 + 0.1 * score WHEN 'fact' THEN 0.6 + 0.1 * score WHEN 'property' THEN 0.4 + 0.1 * score END), 0.0), 4) AS score FROM c GROUP BY doc_id
""")
def supporting_chunks(t) -> DataFrame:
    """Chunks scored by their best direct hit and by what entities, relations, facts and properties add."""
    kind = F.element_at(F.array(*map(F.lit, ("chunk", "entity", "relation", "fact", "property"))), (F.col("item_id") % 5 + 1).cast("int"))
    return chunk_support(_hits(t).withColumn("kind", kind), "doc_id")


@query("""
WITH e AS (SELECT s_suppkey AS entity_id, s_nationkey AS cluster_id FROM supplier WHERE s_acctbal < 1000),
i AS (SELECT l_orderkey || '_' || l_linenumber AS fact_id, l_suppkey, s_nationkey, l_extendedprice AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'),
b AS (SELECT DISTINCT fact_id, bound_to, x FROM (SELECT fact_id, e.entity_id AS bound_to, x FROM i JOIN e ON e.entity_id = i.l_suppkey UNION ALL SELECT fact_id, e.entity_id, x FROM i JOIN e ON e.cluster_id = i.s_nationkey))
SELECT bound_to, fact_id, score FROM (SELECT bound_to, fact_id, x AS score, row_number() OVER (PARTITION BY bound_to ORDER BY x DESC, fact_id DESC) AS r FROM b) WHERE r <= 4
""")
def binding_topk(t) -> DataFrame:
    """The four best facts of each matched entity, bound by entity or by cluster."""
    entities = t.supplier.where("s_acctbal < 1000").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("cluster_id"))
    facts = t.lineitem.where("l_returnflag = 'R'").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("fact_id"), F.col("l_suppkey").alias("source_local_entity_id"), F.col("s_nationkey").alias("cluster_id"), "l_extendedprice")
    return bind(facts, entities, F.col("l_extendedprice"), 4).select("bound_to", "fact_id", "score")


@query("""
WITH r AS (SELECT l_suppkey AS g, l_orderkey || '_' || l_linenumber AS k, l_extendedprice AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey || '_' || l_linenumber DESC) AS n FROM lineitem)
SELECT g AS supplier, k AS fact_id, s AS score FROM r WHERE n <= 2 ORDER BY s DESC, k DESC LIMIT 50
""")
def binding_report(t) -> DataFrame:
    """At most two facts a group and fifty in all: a report with both caps."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("fact_id"), F.col("l_extendedprice").alias("score"))
    return binding_top(rows, "supplier", "score", "fact_id", 2, 50).select("supplier", "fact_id", "score")


_STOP = "('reference', 'refs', 'what', 'who', 'when', 'where', 'why', 'how')"
_IN_ORDER = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
#: Names and topics of a query as SQL has them for texts without CJK characters.
KEYWORDS_SQL = rf"""
w AS (SELECT item_id, text, list_filter(list_concat(list_transform(string_split_regex(trim(regexp_replace(text, '[?!,.;:\[\]()<>"''/\|]+', ' ', 'g')), '\s+'), lambda x: trim(x)), list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.-]*|\d+[A-Za-z]?'), lambda x: regexp_replace(x, '\.+$', ''))), lambda x: x <> '' AND x NOT IN {_STOP}) AS every FROM benchmark),
kl AS (SELECT item_id, text, list_slice({_IN_ORDER.format('every')}, 1, 8) AS low FROM w),
cue AS (SELECT *, list_filter([CASE WHEN contains(lower(text), 'relationship') OR contains(lower(text), 'relation') THEN 'relationship' END, CASE WHEN contains(lower(text), 'timeline') OR contains(lower(text), 'when') THEN 'timeline' END, CASE WHEN contains(lower(text), 'where') THEN 'location' END, CASE WHEN contains(lower(text), 'identity') THEN 'identity' END, CASE WHEN contains(lower(text), 'profile') THEN 'profile' END, CASE WHEN contains(lower(text), 'trait') THEN 'trait' END], lambda x: x IS NOT NULL) AS found FROM kl),
kw AS (SELECT item_id, text, low, CASE WHEN len(found) = 0 AND len(low) >= 2 THEN ['关系'] ELSE found END AS high FROM cue)
"""


@query(f"""
WITH RECURSIVE {KEYWORDS_SQL}, ps AS (SELECT item_id, 0 AS n, text AS q FROM kw UNION ALL SELECT item_id, 1, array_to_string(low, ' ') FROM kw WHERE len(low) > 0 UNION ALL SELECT item_id, 2, text || ' ' || array_to_string(high, ' ') FROM kw WHERE len(high) > 0),
q AS (SELECT item_id, n, list_distinct(list_concat({tokens_sql('q')}, CASE WHEN contains(q, '关系') THEN ['关', '系', ' 关', '关系'] ELSE [] END)) AS qt FROM ps), d AS (SELECT doc_id, list_distinct({tokens_sql('text')}) AS t FROM documents),
s AS (SELECT item_id, n, doc_id, {overlap_sql('qt', 't')} AS score FROM d, q WHERE len(list_intersect(qt, t)) > 0),
h AS (SELECT *, row_number() OVER (PARTITION BY item_id, n ORDER BY score DESC, doc_id) AS rank FROM s),
p AS (SELECT item_id, doc_id, n, round(score + greatest(0.0, 0.001 * (24 - (rank - 1))), 6) AS p FROM h WHERE rank <= 8),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY n) AS i FROM p),
f AS (SELECT item_id, doc_id, i, p AS score FROM o WHERE i = 1 UNION ALL SELECT o.item_id, o.doc_id, o.i, CASE WHEN o.p > f.score THEN o.p ELSE round(f.score + 0.025, 6) END FROM f JOIN o ON o.item_id = f.item_id AND o.doc_id = f.doc_id AND o.i = f.i + 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY i DESC) AS last FROM f) WHERE last = 1)
SELECT item_id, doc_id, score, i AS passes FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, i DESC, doc_id DESC) AS place FROM l) WHERE place <= 24
""")
def fusion_multi_pass(t) -> DataFrame:
    """Up to three passes of every benchmark text (itself, its names, itself with its topics) fused: replaced by better hits, raised by repeats."""
    limits = budget("standard")
    texts = pass_texts(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), limits)
    best = top_per(lexical(t.documents, texts, k=limits["top_k"]), ["query_id", "pass_no"], [F.col("score").desc(), F.col("doc_id").asc()], limits["top_k"])
    fused = fuse(best.withColumn("rank", F.col("rank") - 1), "doc_id", limits["top_k"] * limits["multiplier"], by=("query_id",))
    return fused.select(F.col("query_id").alias("item_id"), "doc_id", "score", F.size("passes").cast("long").alias("passes"))


@query(f"""
WITH {_HITS}, i AS (SELECT item_id, doc_id, ['facts', 'properties', 'relations', 'entities', 'chunks'][(doc_id % 5) + 1] AS section, score FROM h),
r AS (SELECT item_id, section, doc_id, row_number() OVER (PARTITION BY item_id, section ORDER BY score DESC, doc_id) AS rank FROM i)
SELECT item_id, CASE section WHEN 'facts' THEN 'F' WHEN 'properties' THEN 'P' WHEN 'relations' THEN 'R' WHEN 'entities' THEN 'E' ELSE 'C' END || rank AS ref_id, section, doc_id FROM r WHERE rank <= CASE section WHEN 'facts' THEN 8 WHEN 'chunks' THEN 4 ELSE 6 END
""")
def evidence_packet_rows(t) -> DataFrame:
    """An evidence packet of the standard budget for every benchmark text, with labels in order."""
    limits = budget("standard")
    section = F.element_at(F.array(*map(F.lit, ("facts", "properties", "relations", "entities", "chunks"))), (F.col("doc_id") % 5 + 1).cast("int"))
    scored = lexical(t.documents, _queries(t)).withColumn("section", section)
    rows = top_per(scored, ["item_id", "section"], [F.col("score").desc(), F.col("doc_id").asc()], max(limits[s] for s in ("facts", "properties", "relations", "entities", "chunks")))
    return evidence_packet(rows, limits, "doc_id", by=("item_id",)).select("item_id", "ref_id", "section", "doc_id")


_SOURCES = ("conversation", "narrative_artifact", "external_reference", "simulation")
_KINDS = ("open_question", "style_preference", "relation", "timeline_event", "timeline_doc", "fact")


def _context_docs(t) -> DataFrame:
    """Turns as context documents: source type, kind, status by arithmetic on their keys."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    k = F.col("conv_id") * 31 + F.col("turn") * 7
    return t.conversations.select(
        F.format_string("i%08d_%04d", "conv_id", "turn").alias("item_id"), pick(_SOURCES, k).alias("source_type"), pick(_KINDS, k + F.col("turn")).alias("item_type"), pick(("active", "canonical", "tentative", "rejected"), F.col("conv_id") + F.col("turn")).alias("status"),
        F.col("role").alias("subject"), F.col("text").alias("statement"), (F.col("turn") % 10 / 10).alias("confidence"), F.array(F.concat(F.lit("entity:"), "role")).alias("entity_ids"), F.col("turn").cast("int").alias("unit_order"), F.lit("p").alias("project_id"),
    )


_CONTEXT_SQL = r"""
q AS (SELECT item_id AS q_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS qt FROM benchmark),
c AS (SELECT printf('i%08d_%04d', conv_id, turn) AS item_id, ['conversation', 'narrative_artifact', 'external_reference', 'simulation'][((conv_id * 31 + turn * 7) % 4) + 1] AS source_type,
  ['open_question', 'style_preference', 'relation', 'timeline_event', 'timeline_doc', 'fact'][((conv_id * 31 + turn * 7 + turn) % 6) + 1] AS item_type, ['active', 'canonical', 'tentative', 'rejected'][((conv_id + turn) % 4) + 1] AS status,
  role AS subject, text AS statement, (turn % 10) / 10.0::DOUBLE AS confidence, turn FROM conversations),
s AS (SELECT q_id, c.*, round(len(list_intersect(qt, list_distinct(list_filter(regexp_split_to_array(lower(subject || chr(10) || statement), '[^\p{L}\p{N}]+'), lambda x: x <> '')))) + confidence * 0.2
  + CASE status WHEN 'canonical' THEN 5 WHEN 'active' THEN 4 WHEN 'tentative' THEN 2 WHEN 'rejected' THEN -2 END * 0.25 + CASE source_type WHEN 'conversation' THEN 0.4 WHEN 'narrative_artifact' THEN 0.35 WHEN 'external_reference' THEN 0.25 ELSE 0.1 END, 4) AS score FROM c, q)
"""


@query(f"""
WITH {_CONTEXT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY q_id, source_type ORDER BY score DESC, item_id) AS rank FROM s WHERE score > 0 AND ((source_type IN ('conversation', 'external_reference') AND status IN ('active', 'canonical', 'tentative')) OR (source_type = 'narrative_artifact' AND status IN ('active', 'canonical'))))
SELECT q_id AS query_id, item_id, rank, score, CASE source_type WHEN 'conversation' THEN CASE item_type WHEN 'open_question' THEN 'open_questions' WHEN 'style_preference' THEN 'style_guidance' ELSE 'conversation_guidance' END
  WHEN 'narrative_artifact' THEN CASE item_type WHEN 'relation' THEN 'relationship_context' WHEN 'timeline_event' THEN 'timeline_context' ELSE 'artifact_memory' END ELSE CASE item_type WHEN 'timeline_doc' THEN 'timeline_context' ELSE 'external_reference_context' END END AS section FROM k WHERE rank <= 12
""")
def context_packet(t) -> DataFrame:
    """A context packet for every benchmark text: the best items of each source in their sections."""
    found = packets(_context_docs(t), t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    return found.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), "score", "section")


_MATCH = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
n AS (SELECT c_nationkey AS query_id, string_agg(c_name, ' and ' ORDER BY c_custkey) FILTER (n <= 3) AS names FROM c GROUP BY c_nationkey),
q AS (SELECT query_id, names || ' ' || text AS query, 19970101 AS bound FROM n JOIN benchmark ON item_id = query_id),
qk AS (SELECT *, {_MATCH.format('query')} AS qm, list_distinct({tokens_sql('query')}) AS qt FROM q),
e AS (SELECT query_id, 'c' || c_custkey AS entity_id, c_name, qt, bound FROM qk JOIN customer ON contains(qm, {_MATCH.format('c_name')})),
o AS (SELECT 'o' || o_orderkey AS memory_id, 'c' || o_custkey AS entity_id, strftime(o_orderdate, '%Y%m%d')::INT AS scene_order, o_orderkey AS seq, o_orderpriority || ' by ' || c_name || ' for ' || o_orderkey AS summary, CASE o_orderstatus WHEN 'F' THEN 'durable_state' WHEN 'P' THEN 'atemporal_fact' ELSE 'temporal_episode' END AS scope FROM orders JOIN customer ON c_custkey = o_custkey),
em AS (SELECT e.query_id, e.entity_id, o.*EXCLUDE(entity_id), len(list_intersect(list_distinct(list_concat(e.qt, {tokens_sql('e.c_name')})), list_distinct({tokens_sql('o.summary')}))) AS score, count(*) OVER (PARTITION BY e.query_id, e.entity_id) AS n FROM e JOIN o USING (entity_id) WHERE o.scene_order < e.bound),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY CASE WHEN n > 10 THEN score END DESC NULLS LAST, scene_order, seq, memory_id) AS rank FROM em),
gm AS (SELECT query_id, memory_id, scope, scene_order, {overlap_sql('qt', f"list_distinct({tokens_sql('summary')})")} AS score FROM qk, o WHERE scene_order < bound AND len(list_intersect(qt, list_distinct({tokens_sql('summary')}))) > 0),
gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS place FROM gm) WHERE place <= 24 AND scope <> 'temporal_episode'),
g AS (SELECT query_id, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS r FROM gr) WHERE r <= 8),
l AS (SELECT 'c' || o_custkey AS s, 's' || l_suppkey AS t, l_returnflag AS k, max(strftime(o_orderdate, '%Y%m%d')::INT) AS last_order FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
rl AS (SELECT DISTINCT e.query_id, l.s || ' ' || l.k || ' ' || l.t AS ref FROM l JOIN e ON (e.entity_id = l.s OR e.entity_id = l.t) WHERE l.last_order < e.bound),
d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stated_fact' ELSE 'scene_summary' END AS doc_type, 'scene_' || (doc_id // 2) AS scene_id, list_distinct({tokens_sql('text')}) AS t FROM documents WHERE doc_id * 1000 < 19970101),
dh AS (SELECT * FROM (SELECT query_id, doc_type, scene_id, doc_id, score, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_type, scene_id, doc_id, {overlap_sql('qt', 't')} AS score FROM qk, d WHERE len(list_intersect(qt, t)) > 0)) WHERE rank <= 5),
sc AS (SELECT query_id, scene_id, max(score) AS best, min(rank) AS first FROM dh GROUP BY ALL), sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, scene_id) AS r FROM sc) WHERE r <= 5)
SELECT query_id, 'entity' AS part, entity_id AS ref, '' AS detail FROM e
UNION ALL SELECT query_id, 'memory', memory_id, CASE WHEN n <= 10 THEN 'all_memories' ELSE 'top_k' END FROM er WHERE n <= 10 OR rank <= 4
UNION ALL SELECT query_id, 'memory', memory_id, 'global_scope' FROM g
UNION ALL SELECT query_id, 'relation', ref, '' FROM rl
UNION ALL SELECT query_id, 'scene', scene_id, r::VARCHAR FROM sr
""")
def memory_packets(t) -> DataFrame:
    """Whole memory packets, one a nation: named customers, their orders before a date, their suppliers, related documents."""
    from pyspark.sql import Window

    day = lambda c: F.date_format(c, "yyyyMMdd").cast("int")
    c = t.customer.withColumn("n", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where("n <= 3")
    names = c.groupBy(F.col("c_nationkey").cast("long").alias("item_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda r: r["c_name"]), " and ").alias("names"))
    queries = names.join(t.benchmark, "item_id").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "names", "text").alias("query"), F.lit(19970101).alias("bound"))
    entities = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name"), F.lit("character").alias("entity_type"))
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    scope = F.when(F.col("o_orderstatus") == "F", "durable_state").when(F.col("o_orderstatus") == "P", "atemporal_fact").otherwise("temporal_episode")
    memories = o.select(F.concat(F.lit("o"), "o_orderkey").alias("memory_id"), F.lit("").alias("scene_id"), day("o_orderdate").alias("scene_order"), F.col("o_orderkey").alias("sequence_index"), F.concat("o_orderpriority", F.lit(" by "), "c_name", F.lit(" for "), "o_orderkey").alias("summary"), scope.alias("memory_temporal_scope"))
    sold = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    relations = sold.groupBy(F.concat(F.lit("c"), "o_custkey").alias("source_entity_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_entity_id"), F.col("l_returnflag").alias("relation_type")).agg(F.max(day("o_orderdate")).alias("last_order"))
    relations = relations.withColumn("relation_id", F.concat_ws(" ", "source_entity_id", "relation_type", "target_entity_id"))
    docs = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "stated_fact").otherwise("scene_summary").alias("doc_type"), F.concat(F.lit("scene_"), F.floor(F.col("doc_id") / 2).cast("string")).alias("scene_id"), (F.col("doc_id") * 1000).alias("scene_order"), "text")
    world = {"entities": entities, "aliases": entities.select("entity_id", F.col("canonical_name").alias("alias")), "links": o.select(F.concat(F.lit("c"), "o_custkey").alias("entity_id"), F.concat(F.lit("o"), "o_orderkey").alias("memory_id")), "memories": memories, "relations": relations, "documents": docs}
    parts = memory_packet(queries, world, PacketLimits(all_memories=10, entity_memories=4))
    none = F.lit("").alias("detail")
    rows = [
        parts["entities"].select("query_id", F.lit("entity").alias("part"), F.col("entity_id").alias("ref"), none),
        parts["memories"].select("query_id", F.lit("memory").alias("part"), F.col("memory_id").alias("ref"), F.col("strategy").alias("detail")),
        parts["relations"].select("query_id", F.lit("relation").alias("part"), F.col("relation_id").alias("ref"), none),
        parts["scenes"].select("query_id", F.lit("scene").alias("part"), F.col("scene_id").alias("ref"), F.col("rank").cast("string").alias("detail")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("""
WITH l AS (SELECT o.o_custkey AS entity_id, o.o_orderkey AS memory_id, o.o_totalprice AS score, count(*) OVER (PARTITION BY o.o_custkey) AS n FROM orders o),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN n > 12 THEN score END DESC NULLS LAST, memory_id) AS rank FROM l)
SELECT entity_id, memory_id, CASE WHEN n <= 12 THEN 'all_memories' ELSE 'top_k' END AS strategy FROM r WHERE n <= 12 OR rank <= 5
""")
def memory_packet_entities(t) -> DataFrame:
    """All orders of customers with few, the five largest of others; the count decides in the plan."""
    links = t.orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("memory_id"), "o_totalprice")
    return adaptive_memories(links, F.col("o_totalprice"), all_up_to=12, k=5, order=[F.col("memory_id")]).select("entity_id", "memory_id", "strategy")


@query("""
WITH u AS (SELECT c.c_custkey AS entity_rank, o.o_orderkey AS memory_id, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS memory_rank, c.c_nationkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
f AS (SELECT c_nationkey, memory_id, min((entity_rank, memory_rank)) AS first FROM u WHERE memory_rank <= 3 GROUP BY ALL)
SELECT c_nationkey, memory_id, 'M' || row_number() OVER (PARTITION BY c_nationkey ORDER BY first) AS label FROM f
""")
def memory_packet_labels(t) -> DataFrame:
    """M1, M2 in the order of first use within a packet (a nation): each customer's three largest orders."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", F.col("c_custkey").alias("entity_rank"), F.col("o_orderkey").alias("memory_id"), "o_totalprice")
    used = top_per(rows, ["entity_rank"], [F.col("o_totalprice").desc(), F.col("memory_id").asc()], 3, "memory_rank")
    return memory_labels(used, by=("c_nationkey",)).select("c_nationkey", "memory_id", "label").distinct()


@query("""
SELECT o_custkey AS entity_id, o_orderkey AS memory_id, r AS profile_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 3
""")
def profile_memory_rows(t) -> DataFrame:
    """Urgent orders first, others to fill, three a customer."""
    rows = t.orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("memory_id"), "o_orderpriority", "o_orderdate")
    return profile_memories(rows, "entity_id", F.col("o_orderpriority") == "1-URGENT", [F.col("o_orderdate"), F.col("memory_id")]).select("entity_id", "memory_id", F.col("profile_rank").cast("long").alias("profile_rank"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['error', 'purchase', 'signup'], event_type), ts, event_id) AS r FROM events WHERE event_type IN ('error', 'purchase', 'signup')) WHERE r <= 5
""")
def hidden_filter_layers(t) -> DataFrame:
    """Layers in a fixed order until five items of each user."""
    return section_fill(t.events, ["user_id"], "event_type", ["error", "purchase", "signup"], [F.col("ts"), F.col("event_id")], 5).select("user_id", "event_id", "event_type")


@query(f"WITH {KEYWORDS_SQL} SELECT item_id, array_to_string(low, '|') AS names, array_to_string(high, '|') AS topics FROM kw")
def query_plan_keywords(t) -> DataFrame:
    """The names and topics that a query plan takes from every benchmark text."""
    rows = t.benchmark.select("item_id", "text", low_level_keywords("text").alias("low")).withColumn("high", high_level_keywords("text", F.col("low")))
    return rows.select("item_id", F.array_join("low", "|").alias("names"), F.array_join("high", "|").alias("topics"))


@query("""
SELECT doc_id, source, lang, n_chars FROM documents WHERE source IN ('src0', 'src1', 'src2') AND lang = 'en' AND doc_id <= 100000
""")
def document_scan(t) -> DataFrame:
    """Documents of some types and one entity, bounded in story order."""
    docs = t.documents.select("doc_id", "n_chars", F.col("source").alias("doc_type"), F.col("lang").alias("entity_id"), F.col("doc_id").alias("scene_order"), F.lit(0).alias("chunk_index"), F.lit(0).alias("sequence_index"))
    return scan(docs, ("src0", "src1", "src2"), "en", bound=100000).select("doc_id", F.col("doc_type").alias("source"), F.col("entity_id").alias("lang"), "n_chars")
