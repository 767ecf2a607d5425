"""Entities: registry, resolution of references, candidate lookup, disambiguation by name."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.rules import entity_type, is_deictic
from ..functions.similarity import ratio, shared_letters
from ..functions.text import CJK, alias_key, code_tokens, embedded_code, match_key, name_key, name_variants, text_of, words_key
from ..sources.scratch import written
from .automaton import scan, shards
from .graphs import components
from .ranking import first_wins, place_in, stated_blocks, top_per


def group_mentions(mentions: DataFrame, name: str = "name", scene: str = "scene_id", order: Sequence[Column] = (), by: Sequence[str] = ()) -> DataFrame:
    """Mentions by normalised name: the first surface, the aliases and scenes in order, the count."""
    ordinal = F.struct(*order, F.col(name)) if order else F.struct(F.col(scene), F.col(name))
    return mentions.withColumn("name_key", name_key(name)).groupBy(*by, "name_key").agg(
        F.min_by(name, ordinal).alias("canonical_name"), F.array_sort(F.collect_set(name)).alias("aliases"), F.array_sort(F.collect_set(scene)).alias("scene_ids"), F.count("*").alias("mention_count")
    )


def majority_type(mentions: DataFrame, key: Sequence[str], kind: str = "entity_type", priority: Sequence[str] = vocab.ENTITY_PRIORITY) -> DataFrame:
    """The commonest type of each key, by priority among equals; group or character, if both occur, whichever is commoner (group at a tie)."""
    counts = mentions.withColumn("__t", entity_type(kind)).groupBy(*key, "__t").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("__t"))
    best = counts.groupBy(*key).agg(
        F.min_by("__t", F.struct(-F.col("n"), place, "__t")).alias("top"),
        F.coalesce(F.max(F.when(F.col("__t") == "group", F.col("n"))), F.lit(0)).alias("groups"),
        F.coalesce(F.max(F.when(F.col("__t") == "character", F.col("n"))), F.lit(0)).alias("people"),
    )
    both = (F.col("groups") > 0) & (F.col("people") > 0)
    return best.select(*key, F.when(both, F.when(F.col("groups") >= F.col("people"), "group").otherwise("character")).otherwise(F.col("top")).alias("entity_type"))


def registry(mentions: DataFrame, name: str = "name", kind: str = "entity_type", scene: str = "scene_id", hint: str | None = None, surnames: str = "") -> DataFrame:
    """One row per entity: key, type, longest name, aliases, first scene, mentions. The key is the least normalised variant of its name."""
    source = F.coalesce(F.nullif(F.trim(text_of(hint)), F.lit("")), F.col(name)) if hint else F.col(name)
    keyed = mentions.withColumn("entity_key", F.array_min(F.transform(name_variants(source, surnames), name_key)))
    named = keyed.withColumn("__candidate", source)
    rows = named.groupBy("entity_key").agg(
        F.min_by("__candidate", F.struct(-F.length("__candidate"), "__candidate")).alias("canonical_name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(name_variants(name, surnames))))).alias("aliases"),
        F.min(scene).alias("first_seen_scene"),
        F.array_sort(F.collect_set(scene)).alias("scene_ids"),
        F.count("*").alias("mention_count"),
    )
    return rows.join(majority_type(keyed, ["entity_key"], kind), "entity_key")


def alias_table(entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """``entity, alias, normalized_alias``: one row per alias; an entity keeps the first of equal keys."""
    rows = entities.select(key, F.posexplode("aliases").alias("at", "alias")).withColumn("normalized_alias", alias_key("alias"))
    return first_wins(rows, [key, "normalized_alias"], [F.col("at").asc()]).drop("at")


def resolve_exact(refs: DataFrame, entities: DataFrame, aliases: DataFrame, ref: str = "ref", key: str = "entity_id") -> DataFrame:
    """A reference by entity id, else by alias (the least entity id of several)."""
    by_id = refs.join(entities.select(F.col(key).alias(ref), F.col(key).alias("by_id")), ref, "left")
    lookup = aliases.groupBy(F.col("normalized_alias").alias("__k")).agg(F.min(key).alias("by_alias"))
    return by_id.withColumn("__k", alias_key(ref)).join(lookup, "__k", "left").withColumn(key, F.coalesce("by_id", "by_alias")).drop("__k", "by_id", "by_alias")


def resolve_fuzzy(refs: DataFrame, aliases: DataFrame, ref: str = "ref", key: str = "entity_id", k: int = 3, min_score: float = 0.55, extra: Sequence[str] = ("mention_count", "first_seen_order")) -> DataFrame:
    """The best entities for each reference: exact alias 1, shared code 0.95, substring 0.72 + 0.22 * coverage, else the ratio.

    ``refs`` is the caller's list and is compared with every alias, in blocks if it is long; references of one character
    only match exactly. The ratio runs on pairs that pass its cheap upper bounds: by lengths, then by the letters they share.
    """
    left = refs.select(F.col(ref), alias_key(ref).alias("qa"), match_key(ref).alias("q"), code_tokens(ref).alias("qc")).distinct()
    right = aliases.select(key, "alias", *extra, alias_key("alias").alias("aa"), match_key("alias").alias("a"), code_tokens("alias").alias("ac")).where("a <> ''")
    pairs = None
    for block in stated_blocks(left):
        part = right.join(block)
        pairs = part if pairs is None else pairs.unionByName(part)
    short, long = F.least(F.length("q"), F.length("a")), F.greatest(F.length("q"), F.length("a"))
    exact, one = (F.col("qa") == F.col("aa")) | (F.col(ref) == F.col(key)), F.length("q") == 1
    code, inside = F.coalesce(F.arrays_overlap("qc", "ac"), F.lit(False)), F.contains("a", F.col("q")) | F.contains("q", F.col("a"))
    sure = F.when(exact, 1.0).when(one, 0.0).when(code, 0.95).when(inside & (F.col("q") != ""), 0.72 + 0.22 * short / long)
    how = F.when(exact, "exact_alias").when(one, "none").when(code, "code_token").when(inside & (F.col("q") != ""), "substring").otherwise("fuzzy")
    scored = pairs.withColumn("sure", sure).withColumn("match_type", how)
    known = scored.where("sure IS NOT NULL").withColumn("score", F.col("sure").cast("double"))
    fuzzy = scored.where(F.col("sure").isNull() & (2.0 * short / (short + long) >= min_score)).where(2.0 * shared_letters("q", "a") / (short + long) >= min_score).withColumn("score", ratio("q", "a"))
    every = known.unionByName(fuzzy).where(F.col("score") >= min_score)
    best = first_wins(every, [ref, key], [F.col("score").desc(), F.col("alias").asc()])
    tie = [F.col("mention_count").desc(), F.col("first_seen_order").asc()] if len(extra) == 2 else []
    return top_per(best, [ref], [F.col("score").desc(), *tie, F.col(key).desc()], k).select(ref, key, "alias", "match_type", F.round("score", 6).alias("score"), "rank")


def align_candidates(links: DataFrame, candidates: DataFrame, name: str = "entity", ordinal: str = "ordinal") -> DataFrame:
    """Extracted names to candidates by any of their aliases; the first candidate of an alias wins."""
    rows = candidates.select("candidate_id", ordinal, F.explode(F.array_distinct(F.transform(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: name_key(a)))).alias("__k"))
    index = rows.where("__k <> ''").groupBy("__k").agg(F.min_by("candidate_id", F.struct(F.col(ordinal), F.col("candidate_id"))).alias("candidate_id"))
    return links.withColumn("__k", name_key(name)).join(index, "__k", "left").drop("__k")


def resolve_types(evidence: DataFrame, key: Sequence[str], kind: str = "entity_type") -> DataFrame:
    """The type of each key by frequency, then specificity, then name; whether types conflict; how many each had."""
    counts = evidence.withColumn("__t", entity_type(kind)).groupBy(*key, "__t").agg(F.count("*").alias("n"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in vocab.ENTITY_SPECIFICITY.items() for x in kv]), F.col("__t")), F.lit(0))
    return counts.groupBy(*key).agg(F.min_by("__t", F.struct(-F.col("n"), -rank, "__t")).alias("entity_type"), (F.count("*") > 1).alias("entity_type_conflict"), F.sum("n").alias("evidence_count"))


def disambiguate(names: DataFrame, name: str = "name", kind: str = "entity_type", threshold: float = 0.88, most: int = 8) -> DataFrame:
    """``kind, name, canonical``: names of one type that are the same but for punctuation, or share a last word (in at most ``most`` names) and most words or a high ratio.

    The canonical name is the longest, then the first. Pairs arise from an equi-join on the last word of buckets of a bounded size.
    """
    rows = names.select(F.col(kind).alias("kind"), F.col(name).alias("name")).distinct().withColumn("norm", words_key("name")).where("norm <> ''")
    rows = rows.withColumn("node", F.concat_ws("\u0001", "kind", "name")).withColumn("words", F.array_distinct(F.split("norm", " "))).withColumn("last", F.element_at(F.split("norm", " "), -1))
    same = rows.withColumn("first", F.min("node").over(Window.partitionBy("kind", "norm"))).where("first <> node").select(F.col("first").alias("source"), F.col("node").alias("target"))
    small = rows.withColumn("c", F.count("*").over(Window.partitionBy("kind", "last"))).where(f"c BETWEEN 2 AND {most}")
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.last") == F.col("b.last")) & (F.col("a.node") < F.col("b.node")))
    both = F.size(F.array_intersect("a.words", "b.words")) / F.least(F.size("a.words"), F.size("b.words"))
    linked = pairs.select(F.col("a.node").alias("source"), F.col("b.node").alias("target"), both.alias("overlap"), F.col("a.norm").alias("x"), F.col("b.norm").alias("y"))
    alike = linked.where("overlap >= 0.75").select("source", "target").unionByName(linked.where("overlap < 0.75").where(ratio("x", "y") >= threshold).select("source", "target"))
    labels = components(same.unionByName(alike), nodes=rows.select("node"))
    grouped = rows.join(labels, "node")
    canon = grouped.groupBy("component").agg(F.min_by("name", F.struct(-F.length("name"), "name")).alias("canonical"))
    return grouped.join(canon, "component").select("kind", "name", "canonical")


def _names_in(state: None, automaton, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The distinct strings (by number) that every text holds."""
    rows, found = [], []
    for i, t in enumerate(batch.column(2).to_pylist()):
        own = {n for _, n in automaton.iter(t or "")}
        rows += [i] * len(own)
        found += own
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.int32())], names=["__h", "__g", "__n"])


#: Texts, and bytes of them all, that every name may be held against.
FEW_TEXTS, FEW_BYTES = 64, 1 << 16


def few_texts(keyed: DataFrame) -> DataFrame | None:
    """Texts as the broadcast side of a comparison with every name, if they are at most ``FEW_TEXTS`` of ``FEW_BYTES``."""
    n, size = keyed.limit(FEW_TEXTS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__t")), F.lit(0))).first()
    return F.broadcast(keyed) if n <= FEW_TEXTS and size <= FEW_BYTES else None


def known_in_text(texts: DataFrame, aliases: DataFrame, text: str = "text", key: str = "entity_id") -> DataFrame:
    """Entities whose alias (two characters or more, by letters and digits) or code occurs in a text: all columns of ``texts``, ``key, alias``.

    All aliases are looked up in one scan of the texts by an automaton (several, if they are many); only hashes of rows and
    numbers of strings leave it. Where names need several and texts are few, every name is held against the texts instead. A code meets the texts that hold it in an equi-join. A row has each pair once; a
    repeated row has its pairs each time.
    """
    columns = texts.columns
    t = texts.withColumn("__h", F.xxhash64(*columns)).withColumn("__g", F.xxhash64(F.lit(1), *columns))
    a = aliases.select(key, "alias", match_key("alias").alias("__a"), code_tokens("alias").alias("__ac")).where("length(__a) >= 2").distinct()
    coded = t.select("__h", "__g", F.explode(F.array_distinct(code_tokens(text))).alias("__c")).join(a.select(key, "alias", F.explode(F.array_distinct("__ac")).alias("__c")), "__c")
    found = coded.select("__h", "__g", key, "alias")
    keyed = t.select("__h", "__g", match_key(text).alias("__t"))
    names = written(a.select("__a").distinct())
    pieces = shards(names, F.octet_length("__a"))
    if len(pieces) > 1 and (few := few_texts(keyed)) is not None:
        held = names.join(few, F.contains("__t", F.col("__a")))
        found, pieces = found.unionByName(held.join(a, "__a").select("__h", "__g", key, "alias")), []
    for shard in pieces:
        strings = [r[0] for r in shard.collect()]  # bounded in bytes
        if not strings:
            continue
        held = scan(keyed, strings, lambda own: (own, None), _names_in, "__h long, __g long, __n int")
        numbers = texts.sparkSession.createDataFrame(list(enumerate(strings)), "__n int, __a string").join(a, "__a").select("__n", key, "alias")
        found = found.unionByName(held.join(numbers, "__n").select("__h", "__g", key, "alias"))
    return t.join(found.distinct(), ["__h", "__g"]).select(*columns, key, "alias")


def kg_actor(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Characters and groups by a name that the canonical list lacks, from mentions whose surface or hint is that name.

    ``mentions``: surface, canonical_hint, entity_type, scene_id, record_id; ``names``: name. One row per name that any
    mention has: the first mention's hint (else surface), whether any is a character, all surfaces and hints, scenes.
    """
    rows = mentions.where(F.col("entity_type").isin("character", "group")).withColumn("__name", F.explode(F.array_distinct(F.array(alias_key("surface"), alias_key("canonical_hint"))))).where("__name <> ''")
    found = rows.join(names.select("name", alias_key("name").alias("__name")).distinct(), "__name")
    called = F.coalesce(F.nullif(F.trim(text_of("canonical_hint")), F.lit("")), F.col("surface"))
    both = F.filter(F.array(F.col("surface"), F.col("canonical_hint")), lambda v: F.trim(text_of(v)) != "")
    return found.groupBy("name").agg(
        F.min_by(called, F.struct("scene_id", "record_id")).alias("canonical_name"),
        F.when(F.max((F.col("entity_type") == "character").cast("int")) == 1, "character").otherwise("group").alias("entity_type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(both)))).alias("aliases"),
        F.array_sort(F.collect_set("scene_id")).alias("scene_ids"),
        F.count("*").alias("mention_count"),
    )


def mention_key(name: Column | str, kind: Column | str, scene: Column | str, source: Column | str, evidence: Column | str, surnames: str = "") -> Column:
    """The key under which mentions are one entity: a deictic name only within its scene, source and evidence; an object by its code; a listed role by its name; else the least variant of the name."""
    n, t = text_of(name), entity_type(kind)
    base = F.coalesce(F.array_min(F.transform(name_variants(n, surnames), alias_key)), alias_key(n))
    role = alias_key(F.regexp_replace(F.regexp_replace(F.trim(n), f"^({'|'.join(vocab.ROLE_LEADS)})", ""), "们$", ""))
    deictic = F.concat(F.lit("deictic:"), base, F.lit(":"), F.concat_ws(":", text_of(scene), text_of(source), F.sha1(alias_key(evidence).cast("binary"))))
    code = embedded_code(n)
    return (
        F.when(is_deictic(n), deictic)
        .when((t == "object") & (code != ""), F.concat(F.lit("code:"), code))
        .when(t.isin("character", "group") & n.rlike(f"[{CJK}]") & role.isin(*vocab.ROLE_NAMES), F.concat(F.lit("role:"), role))
        .otherwise(base)
    )


def resolution_artifacts(mentions: DataFrame, surnames: str = "") -> dict[str, DataFrame]:
    """Entities, aliases and traces of mentions (record_id, name, entity_type, scene_id, source, evidence, description).

    Mentions with one ``mention_key`` are one entity: its type by majority, its longest name that points at nothing else, all
    variants of its names as aliases, its scenes, and its first five descriptions by scene. Ids number a type's keys in
    order. A trace says which entity a mention became.
    """
    kind = F.when(text_of("source") == "author_defined", 0).otherwise(1)
    keyed = mentions.withColumn("entity_key", mention_key("name", "entity_type", "scene_id", "source", "evidence", surnames))
    name = F.struct(is_deictic("name").cast("int").alias("d"), (-F.length("name")).alias("l"), F.col("name").alias("n"))
    said = F.regexp_replace(F.trim(text_of("description")), r"\s+", " ")
    told = first_wins(keyed.withColumn("said", said).where("said <> ''").withColumn("__s", alias_key("said")), ["entity_key", "__s"], [kind.asc(), F.col("scene_id").asc(), F.col("record_id").asc()])
    five = top_per(told, ["entity_key"], [F.col("scene_id").asc(), F.col("record_id").asc()], 5).groupBy("entity_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "said"))), lambda r: r["said"]).alias("descriptions"))
    rows = keyed.groupBy("entity_key").agg(F.min(name)["n"].alias("canonical_name"), F.array_sort(F.collect_set("scene_id")).alias("scene_ids"), F.count("*").alias("mention_count")).join(majority_type(keyed, ["entity_key"]), "entity_key").join(five, "entity_key", "left")
    numbered_rows = place_in(rows, "entity_type", ["entity_key"], "__n").withColumn("entity_id", F.format_string("%s_%04d", "entity_type", "__n")).drop("__n")
    owned = keyed.join(numbered_rows.select("entity_key", "entity_id"), "entity_key")
    variants = owned.where(~is_deictic("name")).select("entity_id", F.explode(name_variants("name", surnames)).alias("alias"), "source").withColumn("normalized_alias", alias_key("alias"))
    return {
        "entities": numbered_rows.withColumn("descriptions", F.coalesce("descriptions", F.array().cast("array<string>"))),
        "aliases": first_wins(variants, ["entity_id", "normalized_alias"], [F.col("alias").asc(), F.col("source").asc()]),
        "traces": owned.select("record_id", "name", "entity_key", "entity_id", "scene_id", "source"),
    }
