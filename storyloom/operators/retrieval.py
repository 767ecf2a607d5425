"""Retrieval: lexical and vector scores after relational filters, merging of hit lists, packets.

Filters come before scores, so a vector search is exact over the allowed rows, and top-k plans keep k rows a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.rules import status_rank
from ..functions.similarity import cosine
from ..functions.text import context_tokens, order_before, text_of, token_set
from . import postings
from .ranking import first_wins, stated, stated_blocks, top_per


def before(df: DataFrame, order: str, scene_id: str | None = None, bound: int | None = None, keep_null: bool = False) -> DataFrame:
    """Rows visible before a scene (strictly: its order less one) or up to an explicit order (inclusive)."""
    if scene_id is None and bound is None:
        return df
    limit = order_before(F.lit(scene_id)) if bound is None else F.lit(bound)
    ok = F.col(order) <= limit
    return df.where(ok | F.col(order).isNull()) if keep_null else df.where(ok)


def scan(docs: DataFrame, doc_types: Sequence[str] = (), entity: str | None = None, scene_id: str | None = None, bound: int | None = None, limit: int | None = None) -> DataFrame:
    """Retrieval documents by type, entity and prefix in story order."""
    out = docs.where(F.col("doc_type").isin(*doc_types)) if doc_types else docs
    out = out.where(F.col("entity_id") == entity) if entity else out
    out = before(out, "scene_order", scene_id, bound)
    order = [F.col("scene_order"), F.col("chunk_index"), F.col("sequence_index"), F.col("doc_id")]
    return out.orderBy(*order).limit(limit) if limit is not None else out


def entity_memories(links: DataFrame, memories: DataFrame, entity: Column, bound: Column | None = None) -> DataFrame:
    """Memories linked to an entity within the bound."""
    near = links.where(entity)
    return near.join(memories if bound is None else memories.where(bound), "memory_id")


def _overlaps(rows: DataFrame, tokens: Column, queries: DataFrame, query_tokens: Column, keep: Sequence[str], best: postings.Best | None = None, below: tuple[str, str] | None = None) -> DataFrame:
    """``keep, __id, __nd, __nq, __n``: how many distinct tokens every row shares with every query (column ``__id``).

    A row's tokens are looked up in the queries' inverted index where the row is read, so pairs leave the scan counted. An
    index beyond ``postings.fits`` meets the tokens in an equi-join, and pairs are counted by row and query; a row counts by
    its place in the scan there, so that rows that are alike stay apart.
    """
    q = queries.select("__id", query_tokens.alias("__q")).distinct()
    index = q.select("__id", F.size("__q").cast("long").alias("__nq"), F.explode("__q").alias("__t"))
    if postings.fits(index):
        visible = postings.Below(below[0], queries.select("__id", F.col(below[1]).alias("__bound")).distinct()) if below else None
        return postings.count_common(rows.select(*keep, tokens.alias("__d")), index, keep, best, visible)
    own = rows.select(F.monotonically_increasing_id().alias("__row"), *keep, tokens.alias("__d"))
    each = own.select("__row", *keep, F.size("__d").alias("__nd"), F.explode("__d").alias("__t"))
    return each.join(index, "__t").groupBy("__row", *keep, "__nd", "__id", "__nq").agg(F.count("*").cast("double").alias("__n")).drop("__row")


def lexical(docs: DataFrame, queries: DataFrame, text: str = "text", query: str = "query", on: Column | None = None, key: str = "doc_id", keep: Sequence[str] = (), k: int | None = None, by: Sequence[str] = (), below: tuple[str, str] | None = None) -> DataFrame:
    """Scores of texts for a short list of queries by token overlap, coverage and density; pairs without overlap go.

    The result has ``key``, the columns of ``keep``, all columns of ``queries`` and ``score``; a row of ``docs`` is scored once,
    also where its key or text is repeated. Callers rank these rows first and fetch other columns for what is left. A caller
    that takes the first ``k`` by score and key for each query, and each value of ``by`` (columns of ``keep``), says so: others
    may be left out at the scan, but with ``on`` none are. ``below`` names a column of ``keep`` and one of ``queries`` that must be
    greater: a condition that the scan itself can check.
    """
    q = queries.withColumn("__id", F.xxhash64(query, *(below or ())[1:]))
    best = postings.Best(k, tuple(by), key, lambda n, nq, nd, _: n + n / nq + n / nd, 6) if k and on is None else None
    counts = _overlaps(docs, token_set(text), q, token_set(query), [key, *keep], best, below)
    scored = counts.select(key, *keep, "__id", F.round(F.col("__n") + F.col("__n") / F.col("__nq") + F.col("__n") / F.col("__nd"), 6).alias("score"))
    out = scored.join(stated(q), "__id").drop("__id")
    if below:
        out = out.where(F.col(below[0]) < F.col(below[1]))
    return out if on is None else out.where(on)


def overlap_top(docs: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, static: Column, by: Sequence[str], k: int, key: str, query: str = "query_id", keep: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """The k best rows of each query and group by common tokens plus a score of their own; of equals the smaller key.

    Rows that share nothing with a query come in the order of their own scores, so the first k of each group stand for
    all of them: whatever is not among these has k rows before it for every query. Rows of equal key count once. A
    query without tokens gets the rows' own order.
    """
    q = queries.withColumn("__id", F.xxhash64(query))
    rows = docs.select(key, *by, *keep, tokens.alias("__tokens"), F.round(static, digits).alias("__own"), static.alias("__static"))
    unique = docs.groupBy(key).count().where("count > 1").isEmpty()  # of repeated keys only the best row counts, so none is left out at the scan
    best = postings.Best(k, tuple(by), key, lambda n, nq, nd, column: n + column("__static"), digits) if unique else None
    met = _overlaps(rows, F.col("__tokens"), q.withColumn("__words", query_tokens), F.col("__words"), [key, *by, *keep, "__static"], best)
    met = met.select(key, *by, *keep, "__id", F.round(F.col("__n") + F.col("__static"), digits).alias("score"))
    first = top_per(rows.drop("__tokens", "__static"), by, [F.col("__own").desc(), F.col(key).asc()], k, "__place").drop("__place")
    rest = first.withColumnRenamed("__own", "score").join(stated(q.select("__id").distinct()))  # k rows a group for each stated query
    once = first_wins(met.unionByName(rest), ["__id", key], [F.col("score").desc()])
    best = top_per(once, ["__id", *by], [F.col("score").desc(), F.col(key).asc()], k)
    return best.join(stated(q.select("__id", query).distinct()), "__id").drop("__id")


def namespace_weight(weights: dict[str, float] = vocab.NAMESPACE_WEIGHTS) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("vector_namespace")), F.lit(0.0))


def namespace_rank(docs: DataFrame, query: str, weights: dict[str, float] = vocab.NAMESPACE_WEIGHTS) -> DataFrame:
    """Overlap of tokens plus the namespace's weight: the order when no vectors are at hand."""
    both = F.size(F.array_intersect(token_set("content"), token_set(F.lit(query))))
    return docs.withColumn("score", F.round(both + namespace_weight(weights), 4))


def namespace_top(docs: DataFrame, queries: DataFrame, k: int, weights: dict[str, float] = vocab.NAMESPACE_WEIGHTS, key: str = "vector_id", query: str = "query_id", text: str = "query") -> DataFrame:
    """``namespace_rank`` for a list of queries: the k best of each namespace, ``query, vector_namespace, key, score, rank``."""
    return overlap_top(docs, queries, token_set("content"), token_set(text), namespace_weight(weights), ["vector_namespace"], k, key, query)


def vector_top(docs: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", query: str = "query_id", on: Column | None = None) -> DataFrame:
    """The k nearest allowed vectors of each query (query_id, query_vector) by cosine; of equals the smaller key.

    The search is exact: a list of queries is held against all allowed rows, in blocks if it is long.
    """
    best = None
    for q in stated_blocks(queries):
        pairs = docs.join(q) if on is None else docs.join(q, on)
        scored = pairs.withColumn("score", F.round(cosine(vector, "query_vector"), 6)).where("score IS NOT NULL")
        part = top_per(scored, [query], [F.col("score").desc(), F.col(key).asc()], k)
        best = part if best is None else best.unionByName(part)
    return best


def entity_vector_top(docs: DataFrame, links: DataFrame, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k nearest documents of each query's own entity: the link filters before any vector is compared.

    ``links``: entity_id, memory_id; ``docs``: memory_id, embedding; ``queries``: query_id, entity_id, query_vector.
    """
    own = stated(queries).join(links.select("entity_id", "memory_id").distinct(), "entity_id").join(docs, "memory_id")
    scored = own.withColumn("score", F.round(cosine("embedding", "query_vector"), 6)).where("score IS NOT NULL")
    return top_per(scored, ["query_id"], [F.col("score").desc(), F.col(key).asc()], k)


def context_vector_top(docs: DataFrame, queries: DataFrame, k: int, project: str, source_types: Sequence[str] = (), statuses: Sequence[str] = ("active", "canonical"), entities: Sequence[str] = (), visibility: Sequence[str] = (), bound: int | None = None) -> DataFrame:
    """The k nearest context documents of each query within a scope; a null unit order passes the bound."""
    return vector_top(_scoped(docs, project, entities, bound, source_type=source_types, status=statuses, visibility=visibility), queries, k, key="item_id")


def entity_list(entities: DataFrame, kind: str | None = None, bound: int | None = None) -> DataFrame:
    """Entities of a type, first seen up to a bound, in the order in which they were first seen, then by name."""
    rows = entities.where(F.col("entity_type") == kind) if kind else entities
    return before(rows, "first_seen_order", bound=bound).orderBy(F.col("first_seen_order").asc_nulls_last(), "canonical_name")


def _scoped(docs: DataFrame, project: str, entities: Sequence[str], bound: int | None, **allowed: Sequence[str]) -> DataFrame:
    out = docs.where(F.col("project_id") == project)
    for column, values in allowed.items():
        out = out.where(F.col(column).isin(*values)) if values else out
    out = out.where(F.arrays_overlap("entity_ids", F.array(*map(F.lit, entities)))) if entities else out
    return before(out, "unit_order", bound=bound, keep_null=True)


def _context_text(docs: DataFrame) -> Column:
    return F.concat_ws("\n", *(text_of(c) for c in ("subject", "statement", "text") if c in docs.columns))


def context_static() -> Column:
    """What a context document scores by itself: 0.2 confidence + 0.25 status rank + the source's bonus."""
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in vocab.SOURCE_BONUS.items() for x in kv]), F.col("source_type")), F.lit(0.0))
    return F.coalesce("confidence", F.lit(0.0)) * 0.2 + status_rank("status") * 0.25 + bonus


def context_score(docs: DataFrame, query: str, entities: Sequence[str] = ()) -> DataFrame:
    """Overlap + the document's own score; 2 more for a wanted entity."""
    terms = context_tokens(F.lit(query))
    base = F.size(F.array_intersect(terms, context_tokens(_context_text(docs)))) + context_static()
    wanted = F.coalesce(F.arrays_overlap("entity_ids", F.array(*map(F.lit, entities))), F.lit(False)) if entities else F.lit(False)
    score = F.when(F.size(terms) > 0, base).otherwise(0.0) + F.when(wanted, 2.0).otherwise(0.0)
    out = docs.withColumn("score", F.round(score, 4)).withColumn("__has_terms", F.size(terms) > 0)
    out = out.where(wanted) if entities else out.where(~F.col("__has_terms") | (F.col("score") > 0))
    return out.drop("__has_terms")


def context_top(docs: DataFrame, queries: DataFrame, k: int, query: str = "query_id", text: str = "query", keep: Sequence[str] = ("item_type", "status")) -> DataFrame:
    """The k best context documents of each source type for a list of queries; scores of zero or less go."""
    best = overlap_top(docs, queries, context_tokens(_context_text(docs)), context_tokens(text), context_static(), ["source_type"], k, "item_id", query, keep)
    return best.where("score > 0")


def context_search(
    docs: DataFrame, query: str, project: str, source_types: Sequence[str] = (), item_types: Sequence[str] = (), statuses: Sequence[str] = ("active", "canonical"),
    entities: Sequence[str] = (), visibility: Sequence[str] = (), bound: int | None = None, k: int = 10,
) -> DataFrame:
    """The best context documents of a project; a null unit order passes the bound. Ties: status, confidence, time, id, all descending but the id."""
    out = _scoped(docs, project, (), bound, source_type=source_types, item_type=item_types, status=statuses, visibility=visibility)
    order = [F.col("score").desc(), status_rank("status").desc(), F.col("confidence").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("item_id").asc()]
    return context_score(out, query, entities).orderBy(*order).limit(k)


def merge_hits(hits: DataFrame, by: Sequence[str], score: str = "score", rank: str = "rank", k: int | None = None) -> DataFrame:
    """Best score and first rank per key over several hit lists; the k best by score, then rank, then key."""
    out = hits.groupBy(*by).agg(F.max(score).alias("best_score"), F.min(rank).alias("first_rank"), F.count("*").alias("hits"))
    order = [F.col("best_score").desc(), F.col("first_rank").asc(), *(F.col(b).asc() for b in by)]
    return out if k is None else out.orderBy(*order).limit(k)


#: What a supporting item adds to its chunks: a base and a share of its score.
SUPPORT = {"entity": (0.8, 0.1), "relation": (0.7, 0.1), "fact": (0.6, 0.1), "property": (0.4, 0.1)}


def chunk_support(contributions: DataFrame, chunk: str = "chunk_id", kind: str = "kind", score: str = "score") -> DataFrame:
    """``chunk, score``: the best direct hit plus one, plus what every entity, relation, fact and property adds."""
    case = F.lit(None).cast("double")
    for name, (base, share) in SUPPORT.items():
        case = F.when(F.col(kind) == name, base + share * F.col(score)).otherwise(case)
    direct = F.max(F.when(F.col(kind) == "chunk", F.col(score) + 1.0))
    return contributions.groupBy(chunk).agg(F.round(F.coalesce(direct, F.lit(0.0)) + F.coalesce(F.sum(case), F.lit(0.0)), 4).alias("score"))


def bind(items: DataFrame, entities: DataFrame, score: Column, k: int, key: str = "fact_id") -> DataFrame:
    """Facts or properties of matched entities, by entity id or cluster id, the k best of each binding.

    The k best of an entity are among its own k best and the k best of its cluster, so items are cut to k an entity and k
    a cluster before they meet the entities in two equi-joins, which stand for the OR. Of items with one key the best counts.
    """
    best = [F.col("score").desc(), F.col(key).desc()]
    scored = items.withColumn("score", score)
    cut = lambda by: top_per(first_wins(scored.where(F.col(by).isNotNull()), [by, key], best), [by], best, k).drop("rank")
    bound = entities.select("entity_id", "cluster_id").distinct()
    one = cut("source_local_entity_id").join(bound.select(F.col("entity_id").alias("source_local_entity_id"), F.col("entity_id").alias("bound_to")).distinct(), "source_local_entity_id")
    two = cut("cluster_id").join(bound.select("cluster_id", F.col("entity_id").alias("bound_to")), "cluster_id")
    return top_per(first_wins(one.unionByName(two), ["bound_to", key], best), ["bound_to"], best, k)


def adaptive_memories(links: DataFrame, score: Column, by: str | Sequence[str] = "entity_id", all_up_to: int = 50, k: int = 12, order: Sequence[Column] = ()) -> DataFrame:
    """All memories of an entity with few, else its k best by score; the count decides within the plan.

    Counts are aggregated and joined, and only the memories of entities with many are ranked, so that Spark can cut them
    to k a task and split the join of an entity that most memories are linked to.
    """
    keys = [by] if isinstance(by, str) else list(by)
    counts = links.groupBy(*keys).agg(F.count("*").alias("memory_count"))
    rows = links.join(counts, keys).withColumn("score", score)
    few = rows.where(F.col("memory_count") <= all_up_to).withColumn("strategy", F.lit("all_memories"))
    many = rows.where(F.col("memory_count") > all_up_to).withColumn("strategy", F.lit("top_k"))
    w = Window.partitionBy(*keys)
    few = few.withColumn("rank", F.row_number().over(w.orderBy(*(order or [F.col("score").desc_nulls_last()]))))
    return few.unionByName(top_per(many, keys, [F.col("score").desc_nulls_last(), *order], k))


def profile_memories(memories: DataFrame, by: str, is_profile: Column, order: Sequence[Column], k: int = 3) -> DataFrame:
    """Profile memories first, others to fill, k of each entity."""
    return top_per(memories, [by], [is_profile.desc(), *order], k, "profile_rank")


def known_to(rows: DataFrame, name: str, column: str = "known_to") -> DataFrame:
    """What a character may know: rows known to all, to nobody in particular, or to the name."""
    c = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return rows.where((F.size(c) == 0) | F.array_contains(c, "all") | F.array_contains(c, name))


def keep_external(hits: DataFrame, entities: Sequence[str]) -> DataFrame:
    """External hits that share an entity, name it in their subject, or are marked as not canonical by default."""
    if not entities:
        return hits
    overlap = F.coalesce(F.arrays_overlap("entity_ids", F.array(*map(F.lit, entities))), F.lit(False))
    low = F.lower(text_of("subject"))
    names = [e.split(":", 1)[-1].lower() for e in entities]
    named = F.greatest(*(F.contains(low, F.lit(n)) for n in names), F.lit(False))
    free = F.coalesce(F.col("default_canon") == F.lit(False), F.lit(False)) if "default_canon" in hits.columns else F.lit(False)
    return hits.where(overlap | ((low != "") & named) | free)


def flat_results(hits: DataFrame, sections: Sequence[str], limit: int, key: str = "item_id") -> DataFrame:
    """One list of hits: sections in order, the first of equal ids, at most ``limit``."""
    place = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    once = first_wins(hits.where(F.col("section").isin(*sections)), [key], [place.asc(), F.col("rank").asc()])
    return once.orderBy(place, "rank", key).limit(limit)
