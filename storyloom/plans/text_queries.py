"""Queries on texts: tokens, segments, sections, rules, evidence, readers' functions.

The driver's texts have no CJK characters, so cue words are passed in Latin letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import clamp, required, scene_class, temporal_scope
from ..functions.text import alias_key, code_tokens, context_tokens, draft_checks, embedding_text, match_key, name_key, retrieval_tokens, stable_id, surface_refs, timeline_hint, unit_count, unit_order, words_key
from ..operators.chunking import boundary_parts, chunk_documents, chunk_units, sections, segments
from ..operators.context import conversation_items
from ..operators.entities import known_in_text
from ..operators.evidence import audit, verbatim
from ..operators.near_quotes import locate_near
from ..operators.ranking import top_per
from ..operators.retrieval import lexical
from .registry import query

UNIT_SQL = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9]+(?:[.\-''][A-Za-z0-9]+)*"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9_]+')"


def overlap_sql(q: str, t: str) -> str:
    """The rounded sum of overlap, coverage and density of two token lists."""
    n = f"len(list_intersect({q}, {t}))::DOUBLE"
    return f"round({n} + {n} / len({q}) + {n} / len({t}), 6)"


@query(f"""
WITH q AS (SELECT item_id, list_distinct({tokens_sql('text')}) AS qt FROM benchmark),
d AS (SELECT doc_id, source, list_distinct({tokens_sql('text')}) AS t FROM documents),
s AS (SELECT item_id, source, doc_id, {overlap_sql('qt', 't')} AS score FROM d, q WHERE len(list_intersect(qt, t)) > 0)
SELECT item_id, source, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3
""")
def minimum_slice(t) -> DataFrame:
    """Per benchmark text and source, the best three documents."""
    scored = lexical(t.documents, t.benchmark.select("item_id", F.col("text").alias("query")), keep=("source",), k=3, by=("source",))
    return top_per(scored, ["item_id", "source"], [F.col("score").desc(), F.col("doc_id").asc()], 3).select("item_id", "source", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@query(rf"""
SELECT source, lang, count(*) AS docs, sum(len(regexp_extract_all(text, '{UNIT_SQL}')))::BIGINT AS units,
       sum(len({tokens_sql('text')}))::BIGINT AS tokens, sum(length(text))::BIGINT AS chars
FROM documents GROUP BY source, lang
""")
def unit_token_stats(t) -> DataFrame:
    """Documents, units, tokens and characters by source and language."""
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum(unit_count("text")).alias("units"), F.sum(F.size(retrieval_tokens("text"))).alias("tokens"), F.sum(F.length("text")).alias("chars"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\n\s*\n+|\n+|[。！？!?；;]\s*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, len(p)::BIGINT AS segments, coalesce(list_max(list_transform(p, lambda x: length(x))), 0)::BIGINT AS longest, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::BIGINT AS chars FROM s
""")
def chunk_spans_boundary(t) -> DataFrame:
    """Boundary segments of every document: their number, the longest, all characters."""
    rows = t.documents.select("doc_id", segments("text").alias("p")).withColumn("n", F.transform("p", F.length))
    return rows.select("doc_id", F.size("p").cast("long").alias("segments"), F.coalesce(F.array_max("n"), F.lit(0)).cast("long").alias("longest"), F.aggregate("n", F.lit(0).cast("long"), lambda a, v: a + v).alias("chars"))


@query()
def chunk_greedy_pack(t) -> DataFrame:
    """Paragraphs and sentences packed to 600 characters."""
    return t.documents.select("doc_id", F.posexplode(boundary_parts("text", 600)).alias("part", "content")).select("doc_id", "part", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_sha256"))


@query()
def chunk_unit_spans(t) -> DataFrame:
    """Contiguous chunks of at most 800 units, by the recursive splitter where a text is longer."""
    units = t.documents.select(F.format_string("scene_%04d", "doc_id").alias("scene_id"), F.col("text").alias("content"))
    return chunk_units(units).select("scene_id", "chunk_id", "chunk_index", "chunk_count", "source_start", "source_end", "chunk_unit_count", "source_sha256")


@query(r"""
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS section_index, role AS heading, regexp_replace('# ' || role || chr(10) || text, '^\s+|\s+$', '', 'g') AS content FROM conversations)
SELECT conv_id, section_index, heading, length(content) AS chars FROM t
""")
def section_paths(t) -> DataFrame:
    """Sections of a conversation written as markdown, one heading a turn."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda r: F.concat(F.lit("# "), r["role"], F.lit("\n"), r["text"])), "\n").alias("content"))
    return sections(turns, "conv_id").select("conv_id", F.col("section_index").cast("long").alias("section_index"), "heading", F.length("content").cast("long").alias("chars"))


@query()
def reference_chunks(t) -> DataFrame:
    """Reference chunks of documents: section and part indexes, hashes."""
    return chunk_documents(t.documents.select("doc_id", F.col("text").alias("content"))).drop("content")


@query(r"""
SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
       'ref_scope_' || sha1(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS source_scope_id, sha256(html) AS content_sha256, length(html) AS chars
FROM pages
""")
def html_title_scope(t) -> DataFrame:
    """Title, host, scope id and hash of every raw page."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return t.pages.select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), host.alias("host"), stable_id("ref_scope", host, digits=None).alias("source_scope_id"), F.sha2("html", 256).alias("content_sha256"), F.length("html").cast("long").alias("chars"))


@query(r"""
SELECT doc_id, 'ctx_' || left(sha1(doc_id::VARCHAR || chr(10) || lang || chr(10) || source), 16) AS item_id, 'ref_doc_' || sha1(source || '|' || doc_id::VARCHAR) AS ref_id, sha256(text) AS content_sha256,
       'source: external_reference' || chr(10) || 'type: fact' || chr(10) || 'subject: ' || source || chr(10) || 'statement: ' || lang || chr(10) || 'status: active' AS embedding_text
FROM documents
""")
def stable_ids(t) -> DataFrame:
    """Content ids and default embedding texts."""
    return t.documents.select(
        "doc_id", stable_id("ctx", "doc_id", "lang", "source").alias("item_id"), stable_id("ref_doc", "source", "doc_id", separator="|", digits=None).alias("ref_id"), F.sha2("text", 256).alias("content_sha256"),
        embedding_text(F.lit("external_reference"), F.lit("fact"), F.col("source"), F.col("lang"), F.lit("active")).alias("embedding_text"),
    )


CUES = {"negative": ("nicht", "pas ", "not"), "writing": ("ing", "ung"), "rejected": ("haha", "oioi"), "decided": ("tion", "ción"), "wished": ("the", "de "), "style": ("ble", "eur"), "asked": ("wh", "que")}
_any = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(rf"""
WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(trim(text), '[。！？!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM conversations),
e AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS pos, unnest(p) AS s FROM s),
k AS (SELECT conv_id, turn, pos, regexp_replace(s, '^[ ，,。；;]+|[ ，,。；;]+$', '', 'g') AS statement, CASE
  WHEN {_any('s', CUES['negative'])} THEN CASE WHEN {_any('s', CUES['writing'])} THEN 'correction' ELSE 'story_constraint' END
  WHEN {_any('s', CUES['rejected'])} THEN 'rejected_option' WHEN {_any('s', CUES['decided'])} THEN 'creative_decision'
  WHEN {_any('s', CUES['wished'])} THEN CASE WHEN {_any('s', CUES['style'])} THEN 'style_preference' ELSE 'user_preference' END
  WHEN suffix(s, 'en') OR {_any('s', CUES['asked'])} THEN 'open_question' END AS item_type FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, item_type, statement ORDER BY turn, pos) AS n FROM k WHERE item_type IS NOT NULL)
SELECT 'conv_item_' || left(sha1('c' || conv_id || chr(10) || turn || chr(10) || item_type || chr(10) || statement), 16) AS item_id, conv_id, turn::VARCHAR AS unit_id, item_type, statement, CASE WHEN item_type = 'rejected_option' THEN 'rejected' ELSE 'active' END AS status FROM o WHERE n = 1
""")
def turn_statement_rules(t) -> DataFrame:
    """Items stated in the turns of every conversation; of equal ones of a conversation the first."""
    turns = t.conversations.select(F.col("turn").cast("string").alias("turn_id"), "role", F.col("text").alias("content"), F.col("turn").alias("order"), F.concat(F.lit("c"), "conv_id").alias("conv"))
    items = conversation_items(turns, "p", F.col("conv"), CUES, ("user", "assistant", "system"), ends_asking="en")
    return items.select("item_id", F.substr("source_id", F.lit(2)).cast("long").alias("conv_id"), "unit_id", "item_type", "statement", "status")


DURABLE, ATEMPORAL, EPISODE = ("has", "ist ", "être"), ("rule", "ment", "ung"), ("enter", "aller", "ción", "thing")
SCENE = {"visual": ("view", "ou "), "cg": ("fire", "eau"), "conflict": ("not", "no "), "action": ("run", "er "), "exposition": ("tion", "ung"), "character": ("man", "el "), "montage": ("montage", "###")}
_sum = lambda c, words: "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"


@query(rf"""
WITH d AS (SELECT doc_id, lang, lower(text) AS low, source || chr(10) || text AS bt, text, length(text) AS size,
  len(regexp_extract_all(text, '[：:][“"''‘（(]|[0-9A-Za-z_\x{{4e00}}-\x{{9fff}}]+\s*[：:]|[\x{{4e00}}-\x{{9fff}}A-Za-z0-9_（）()·]+[：:]')) AS lines,
  len(regexp_extract_all(source || chr(10) || text, '(?i)(解说|旁白|画外音|VO|V\.O\.|OS|O\.S\.)')) AS vo FROM documents),
h AS (SELECT *, {_sum('bt', SCENE['visual'])} AS visual, {_sum('bt', SCENE['cg'])} AS cg, {_sum('bt', SCENE['conflict'])} AS conflict, {_sum('bt', SCENE['action'])} AS action,
  {_sum('bt', SCENE['exposition'])} AS exposition, {_sum('bt', SCENE['character'])} AS person, {_sum('bt', SCENE['montage'])} AS montage FROM d),
k AS (SELECT *, CASE WHEN size = 0 THEN 'empty' WHEN montage > 0 THEN 'montage_or_transition' WHEN visual + cg >= 3 AND lines <= 1 THEN 'pure_visual_vfx' WHEN lines > 0 AND conflict > 0 THEN 'conflict_scene' WHEN lines > 0 THEN 'dialogue_scene'
  WHEN conflict > 0 OR ((action > 0 OR cg > 0) AND person > 0) THEN 'character_action_scene' WHEN vo > 0 OR exposition >= 2 THEN 'exposition_or_vo' ELSE 'establishing_or_visual_description' END AS unit_type FROM h)
SELECT doc_id, unit_type, CASE WHEN unit_type IN ('empty', 'pure_visual_vfx', 'montage_or_transition', 'establishing_or_visual_description') OR (lines = 0 AND conflict = 0 AND action <= 1) THEN 'exclude'
    WHEN unit_type IN ('conflict_scene', 'dialogue_scene', 'character_action_scene') THEN 'include' ELSE 'review' END AS writing_eval_policy,
  lines::BIGINT AS dialogue_count, (visual + cg)::BIGINT AS visual_hits,
  CASE WHEN {_any('low', DURABLE)} AND NOT {_any('low', EPISODE[:2])} THEN 'durable_state' WHEN lang = 'de' AND {_any('low', ATEMPORAL)} THEN 'atemporal_fact'
    WHEN {_any('low', EPISODE)} THEN 'temporal_episode' WHEN {_any('low', ATEMPORAL)} THEN 'atemporal_fact' ELSE 'uncertain' END AS memory_scope
FROM k
""")
def scope_classifier(t) -> DataFrame:
    """Scene type, writing policy and temporal scope of every document."""
    d = t.documents
    kind = F.when(F.col("lang") == "de", "setting").otherwise("note")
    rows = d.select("doc_id", scene_class("source", "text", SCENE).alias("c"), temporal_scope(kind, "text", durable=DURABLE, atemporal=ATEMPORAL, episode=EPISODE, blocking=2).alias("s"))
    return rows.select("doc_id", "c.unit_type", "c.writing_eval_policy", F.col("c.signals.dialogue_count").cast("long").alias("dialogue_count"), (F.col("c.signals.visual_hit_count") + F.col("c.signals.cg_hit_count")).cast("long").alias("visual_hits"), F.col("s.scope").alias("memory_scope"))


@query(r"""
WITH e AS (SELECT event_id, event_type, value, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT event_id, greatest(0.0, least(coalesce(k / 100, 0.5), 1.0)) AS confidence,
       concat_ws('; ', CASE WHEN k IS NULL THEN 'k is required' END, CASE WHEN NOT (value >= 0) OR value IS NULL THEN 'value must not be negative' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'unknown type' END) AS errors
FROM e
""")
def validate_records(t) -> DataFrame:
    """Required fields, ranges and enums of event payloads, as lists of errors."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    checks = [(k.isNotNull(), "k is required"), (F.col("value") >= 0, "value must not be negative"), (F.col("event_type").isin("view", "click", "purchase", "signup"), "unknown type")]
    return t.events.select("event_id", clamp(k / 100, 0.5).alias("confidence"), F.array_join(required(checks), "; ").alias("errors"))


@query(r"""
SELECT p_partkey, replace(lower(trim(p_name)), ' ', '') AS alias_key, lower(regexp_replace(p_brand, '[^\p{L}\p{N}]+', '', 'g')) AS match_key, regexp_replace(lower(trim(p_brand)), '[\s,\-.，。:：/（）()]+', '', 'g') AS name_key,
       trim(regexp_replace(lower(p_name), '[\s_\-·•:：,，.。()（）]+', ' ', 'g')) AS words_key, array_to_string(list_transform(regexp_extract_all(p_brand || ' ' || p_type, '[A-Za-z]*\d+[A-Za-z0-9]*|[A-Z]{2,}'), lambda x: lower(x)), ',') AS codes,
       coalesce(try_cast(list_filter(string_split('scene_' || p_partkey, '_'), lambda x: regexp_full_match(x, '\d+'))[1] AS INT), 0) AS unit_order
FROM part
""")
def name_keys(t) -> DataFrame:
    """The four normal forms of names, codes, and orders from ids."""
    codes = code_tokens(F.concat_ws(" ", "p_brand", "p_type"))
    return t.part.select("p_partkey", alias_key("p_name").alias("alias_key"), match_key("p_brand").alias("match_key"), name_key("p_brand").alias("name_key"), words_key("p_name").alias("words_key"), F.array_join(codes, ",").alias("codes"), unit_order(F.concat(F.lit("scene_"), F.col("p_partkey").cast("string"))).alias("unit_order"))


@query(r"""
SELECT doc_id, length(text) AS body_chars, length(regexp_replace(text, '\s+', '', 'g')) AS body_non_ws_chars, CASE WHEN contains(text, 'License') THEN 1 ELSE 0 END AS anchors_present,
       len(list_distinct(regexp_extract_all(text, '[A-Za-z]*\d+[A-Za-z0-9]*|[A-Z]{2,}')))::INT AS surface_refs, coalesce(nullif(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1), ''), '') AS year_hint,
       len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')))::INT AS context_tokens
FROM documents
""")
def draft_and_tokens(t) -> DataFrame:
    """Draft checks, surface references, hints and context tokens of every document."""
    checks = draft_checks("text", anchors=("License",))
    year = F.regexp_extract(timeline_hint("text"), r"^((?:19|20)\d{2})$", 1)
    return t.documents.select(
        "doc_id", checks["body_chars"].cast("long").alias("body_chars"), checks["body_non_ws_chars"].cast("long").alias("body_non_ws_chars"), F.size(checks["anchors_present"]).alias("anchors_present"),
        F.size(surface_refs("text")).alias("surface_refs"), year.alias("year_hint"), F.size(context_tokens("text")).alias("context_tokens"),
    )


@query("""
SELECT d.doc_id, b.item_id, strpos(d.text, b.text) - 1 AS evidence_start, strpos(d.text, b.text) - 1 + length(b.text) AS evidence_end
FROM documents d JOIN benchmark b ON contains(d.text, b.text)
""")
def exact_evidence(t) -> DataFrame:
    """Where benchmark passages stand verbatim in all documents."""
    hits = verbatim(t.documents, t.benchmark.select("item_id", F.col("text").alias("quote")))
    at = F.position(F.col("quote"), F.col("text")) - 1
    return hits.select("doc_id", "item_id", at.cast("long").alias("evidence_start"), (at + F.length("quote")).cast("long").alias("evidence_end"))


@query()
def fuzzy_evidence(t) -> DataFrame:
    """Benchmark passages with a changed word looked up in all documents: the folded and the fuzzy tier."""
    quotes = t.benchmark.select("item_id", F.regexp_replace("text", r"^(\S+) (\S+)", "$1, $2x").alias("evidence"))
    return audit(locate_near(t.documents, quotes)).select("doc_id", "item_id", "evidence_at.status", "evidence_at.start", "evidence_at.end", "evidence_at.score", "audit_ordering_usable", "evidence_is_paraphrase")


@query("""
WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS k, p_name FROM part), a AS (SELECT DISTINCT k, p_name AS alias FROM n WHERE length(k) >= 2),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM documents UNION ALL SELECT -1 - p_partkey, k || 'of' || reverse(k) FROM n)
SELECT doc_id, alias FROM d JOIN a ON contains(t, k)
""")
def known_names(t) -> DataFrame:
    """Part names that occur in documents, by letters and digits; parts' own names stand for texts that hold them."""
    names = t.part.select(F.col("p_name").alias("alias"), F.col("p_name").alias("entity_id"))
    own = t.part.select((-1 - F.col("p_partkey")).alias("doc_id"), F.concat(match_key("p_name"), F.lit(" of "), F.reverse(match_key("p_name"))).alias("text"))
    return known_in_text(t.documents.select("doc_id", "text").unionByName(own), names).select("doc_id", "alias")
