"""Query plans, passes, and the fusion of what several passes return."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import display_text, high_level_keywords, looks_temporal, low_level_keywords
from .ranking import reference_labels, top_per


def budget(profile: str = "standard", **changes: int) -> dict[str, int]:
    """An evidence budget by profile, with changes; an unknown profile raises ValueError."""
    if profile not in vocab.BUDGETS:
        raise ValueError(f"no evidence budget of the name {profile!r}")
    return vocab.BUDGETS[profile] | changes


def passes(low: list[str], high: list[str], limits: dict[str, int]) -> list[dict]:
    """One to three passes: the query as it is, its names (wide on entities), its topics (wide on relations)."""
    k = limits["top_k"]
    if k <= 0:
        return []
    narrow, wide = max((k + 1) // 2, 1), max(k * max(limits["multiplier"], 1), k)
    out = [{"name": "base", "terms": [], "entities": k, "relations": k, "chunks": k}]
    if low:
        out.append({"name": "low_level", "terms": low, "entities": wide, "relations": narrow, "chunks": k})
    if high:
        out.append({"name": "high_level", "terms": high, "entities": k, "relations": wide, "chunks": narrow})
    return out


def fuse(hits: DataFrame, key: str, limit: int, pass_no: str = "pass_no", pass_name: str = "pass_name", rank: str = "rank", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """``by, key, score, passes``: hits of each key (of a query) folded in the order of the passes.

    A hit counts its score plus 0.001 for every place above the limit. If it beats the score so far, it replaces it; else
    that grows by 0.025. The rank starts at 0. The order is score, number of passes, key, all descending; ``limit`` keys
    stay, for each query if ``by`` names one.
    """
    points = F.round(F.col(score) + F.greatest(F.lit(0.0), 0.001 * (F.lit(limit) - F.col(rank))), 6)
    rows = hits.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct(F.col(pass_no).alias("n"), F.col(rank).alias("r"), points.alias("p"), F.col(pass_name).alias("name")))).alias("seen"))

    def step(a: Column, h: Column) -> Column:
        first = a.isNull()
        return F.when(first, h["p"]).when(h["p"] > a, h["p"]).otherwise(F.round(a + 0.025, 6))

    fused = rows.select(*by, key, F.aggregate("seen", F.lit(None).cast("double"), step).alias("score"), F.array_distinct(F.transform("seen", lambda h: h["name"])).alias("passes"))
    order = [F.col("score").desc(), F.size("passes").desc(), F.col(key).desc()]
    return top_per(fused, list(by), order, limit, "place") if by else fused.orderBy(*order).limit(limit)


def pass_texts(queries: DataFrame, limits: dict[str, int], text: str = "query") -> DataFrame:
    """``query_id, pass_no, pass_name, query``: the texts of each query's passes, as ``passes`` names them: itself, its names, itself with its topics.

    Passes without names or topics are left out.
    """
    if limits["top_k"] <= 0:
        return queries.select("query_id", F.lit(0).alias("pass_no"), F.lit("base").alias("pass_name"), F.col(text).alias("query")).limit(0)
    low = low_level_keywords(text)
    rows = queries.select("query_id", F.col(text).alias("text"), low.alias("low")).withColumn("high", high_level_keywords("text", F.col("low")))
    named = lambda n, name, said, cond: F.when(cond, F.struct(F.lit(n).alias("pass_no"), F.lit(name).alias("pass_name"), said.alias("query")))
    every = [named(0, "base", F.col("text"), F.lit(True)), named(1, "low_level", F.array_join("low", " "), F.size("low") > 0), named(2, "high_level", F.concat_ws(" ", "text", F.array_join("high", " ")), F.size("high") > 0)]
    return rows.select("query_id", F.explode(F.array_compact(F.array(*every))).alias("p")).select("query_id", "p.*")


def relevant(items: DataFrame, terms: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Items of which any column holds any of the terms; all items if there are no terms."""
    if not terms:
        return items
    hay = F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return items.where(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(hay, t)))


def evidence_packet(items: DataFrame, limits: dict[str, int], key: str = "item_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Items (section, rank) within a budget, labelled by section in order: F1, P1, R1, E1, C1 and so on; a packet for each value of ``by``."""
    prefixes = {"facts": "F", "properties": "P", "relations": "R", "entities": "E", "chunks": "C", "insights": "G", "notes": "S"}
    most = F.create_map(*[F.lit(x) for s in prefixes for x in (s, limits[s])])
    kept = top_per(items.where(F.col("section").isin(*prefixes)), [*by, "section"], [F.col("rank").asc(), F.col(key).asc()], max(limits[s] for s in prefixes), "place")
    kept = kept.where(F.col("place") <= F.element_at(most, F.col("section")))
    label = F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), F.col("section")), F.col("place").cast("string"))
    return kept.withColumn("ref_id", label)


def statement_of(kind: Column | str, row: Column | str, fields: Sequence[str]) -> Column:
    """What a packet says of an item, by its kind: ``row`` is a struct with any of the named fields.

    relationship: ends and description; entity: name, type and description; property: entity.name and value; chunk: content;
    graph_insight and source_note: the cluster's name with its degree or notice; else the statement.
    """
    r, k = (F.col(c) if isinstance(c, str) else c for c in (row, kind))
    has = lambda f: F.trim(display_text(r[f])) if f in fields else F.lit("")
    first = lambda *fs: F.coalesce(*(F.nullif(has(f), F.lit("")) for f in fs), F.lit(""))
    joined = lambda label, text: F.when((label != "") & (text != ""), F.concat(label, F.lit(": "), text)).when(text != "", text).otherwise(label)
    both = lambda sep, *parts: F.array_join(F.filter(F.array(*parts), lambda p: p != ""), sep)
    name = first("entity_name", "canonical_entity_name")
    label = F.when((name != "") & (has("entity_type") != ""), F.concat(name, F.lit(" ("), has("entity_type"), F.lit(")"))).otherwise(name)
    cluster = first("canonical_display_name", "cluster_id")
    return (
        F.when(k == "relationship", joined(both(" - ", has("src_id"), has("tgt_id")), has("description")))
        .when(k == "entity", joined(label, has("description")))
        .when(k == "property", joined(both(".", has("entity_name"), has("property_name")), first("property_value", "statement")))
        .when(k == "chunk", has("content"))
        .when(k == "graph_insight", F.concat(cluster, F.lit(": graph degree="), has("global_pseudo_degree"), F.lit(", source coverage="), has("source_coverage")))
        .when(k == "source_note", joined(cluster, has("notice")))
        .otherwise(first("statement", "description", "content"))
    )


def pass_summary(hits: DataFrame) -> DataFrame:
    """How many hits each pass had in each section."""
    return hits.groupBy("pass_no", "pass_name", "section").agg(F.count("*").alias("n"))


def memory_labels(uses: DataFrame, key: str = "memory_id", order: tuple[str, ...] = ("entity_rank", "memory_rank"), by: tuple[str, ...] = ()) -> DataFrame:
    """M1, M2 in the order in which a packet first uses memories."""
    return reference_labels(uses, key, [F.col(c) for c in order], "M", by)


def context_by_role(hits: DataFrame) -> DataFrame:
    """Reference hits as author and character knowledge, and timeline where they speak of time; the style part stays empty."""
    tagged = lambda role, cond: hits.where(cond).withColumn("role", F.lit(role))
    return tagged("author", F.lit(True)).unionByName(tagged("character", F.col("item_type").isin("entity", "relation", "fact", "property"))).unionByName(tagged("timeline", looks_temporal("statement")))
