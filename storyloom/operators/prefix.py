"""Prefix commits and snapshots: what is known after each unit.

Commits are numbered over units; a snapshot at unit N is the commits up to N, never a replay. Mentions resolve against
the final registry, so entity ids at N use later knowledge while counts and membership are bounded by N.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_key, text_of
from .ranking import first_wins, numbered, running_sums, top_per


def commit_order(operations: DataFrame, unit: str, order: str, project: str | None = None) -> DataFrame:
    """``unit, commit_index``: units by their least order, then id, numbered from 1 (within a project)."""
    by = [project] if project else []
    first = operations.groupBy(*by, unit).agg(F.min(order).alias("__o"))
    if not by:
        return numbered(first, [F.col("__o"), F.col(unit)], "commit_index").drop("__o")
    w = Window.partitionBy(*by).orderBy("__o", unit)
    return first.withColumn("commit_index", F.row_number().over(w)).drop("__o")


def operations(mentions: DataFrame, entity: str, order: Sequence[Column], changed: Column) -> DataFrame:
    """create for an entity's first mention, update where it changes, seen else."""
    n = F.row_number().over(Window.partitionBy(entity).orderBy(*order))
    return mentions.withColumn("operation", F.when(n == 1, "create").when(changed, "update").otherwise("seen"))


#: The operations of a commit in the order in which it takes them (fixed values).
OPERATIONS = ("entity_ambiguous", "entity_created", "entity_alias_added", "entity_seen", "memory_appended", "entity_memory_link_unresolved", "entity_memory_linked", "relationship_created", "relationship_updated")


def commit_log(mentions: DataFrame, memories: DataFrame, links: DataFrame, updates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every operation that the commits of all units make: ``commit_index, operation, entity_id, record_id, detail``.

    Nothing is replayed: an entity is created where it is first mentioned or linked, an alias is added where it is first
    seen of its entity, a relation is created at its first update; each is the first row of its key.
    ``mentions``: commit_index, record_id, surface, canonical_hint; ``memories``: commit_index, record_id; ``links``: commit_index,
    record_id, memory_record_id, entity, canonical_entity; ``updates``: commit_index, record_id, source_entity_id,
    target_entity_id, relation_type; ``aliases``: entity_id, normalized_alias. A name is looked up by its hint, then by its
    surface; names that no entity has are operations of their own.
    """
    known = aliases.groupBy("normalized_alias").agg(F.min("entity_id").alias("entity_id"))

    def resolved(rows: DataFrame, surface: str, hint: str) -> DataFrame:
        by = lambda c, name: known.select(F.col("normalized_alias").alias(f"__{name}"), F.col("entity_id").alias(f"__by_{name}"))
        out = rows.withColumn("__h", alias_key(hint)).withColumn("__s", alias_key(surface)).join(by(hint, "h"), "__h", "left").join(by(surface, "s"), "__s", "left")
        return out.withColumn("entity_id", F.coalesce("__by_h", "__by_s")).drop("__h", "__s", "__by_h", "__by_s")

    def made(rows: DataFrame, operation: Column | str, entity: str | None = "entity_id", record: str = "record_id", detail: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select("commit_index", (F.lit(operation) if isinstance(operation, str) else operation).alias("operation"), (F.col(entity) if entity else none).cast("string").alias("entity_id"), F.col(record).cast("string").alias("record_id"), (none if detail is None else detail).alias("detail"))

    m, l = resolved(mentions, "surface", "canonical_hint"), resolved(links, "entity", "canonical_entity")
    seen, linked = m.where("entity_id IS NOT NULL"), l.where("entity_id IS NOT NULL")
    touched = seen.select("commit_index", F.lit(0).alias("layer"), "record_id", "entity_id").unionByName(linked.select("commit_index", F.lit(1).alias("layer"), "record_id", "entity_id"))
    created = first_wins(touched, ["entity_id"], [F.col("commit_index"), F.col("layer"), F.col("record_id")])
    names = seen.select("commit_index", "record_id", "entity_id", F.explode(F.array("surface", "canonical_hint")).alias("alias")).withColumn("alias", F.trim(text_of("alias"))).where("alias <> ''").withColumn("key", alias_key("alias"))
    added = first_wins(names, ["entity_id", "key"], [F.col("commit_index"), F.col("record_id"), F.col("alias")])
    nth = F.row_number().over(Window.partitionBy("source_entity_id", "target_entity_id", "relation_type").orderBy("commit_index", "record_id"))
    changed = updates.withColumn("__n", nth)
    parts = [
        made(m.where("entity_id IS NULL"), "entity_ambiguous", None, detail=F.col("surface")),
        made(created, "entity_created"),
        made(added, "entity_alias_added", detail=F.col("alias")),
        made(seen, "entity_seen", detail=F.col("surface")),
        made(memories, "memory_appended", None),
        made(l.where("entity_id IS NULL"), "entity_memory_link_unresolved", None, detail=F.col("memory_record_id")),
        made(linked, "entity_memory_linked", detail=F.col("memory_record_id")),
        made(changed, F.when(F.col("__n") == 1, "relationship_created").otherwise("relationship_updated"), "source_entity_id", detail=F.concat_ws(" ", "relation_type", "target_entity_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entity_states(log: DataFrame, commit: Column | None = None) -> DataFrame:
    """Entities after a commit (after the last one if none is given): first and last commit, commits that saw them, mentions, aliases, memories."""
    upto = log if commit is None else log.where(F.col("commit_index") <= commit)
    is_ = lambda name: F.col("operation") == name
    entity = upto.where(F.col("operation").isin("entity_created", "entity_alias_added", "entity_seen", "entity_memory_linked"))
    return entity.groupBy("entity_id").agg(
        F.min("commit_index").alias("first_seen_commit"),
        F.max(F.when(is_("entity_seen") | is_("entity_created"), F.col("commit_index"))).alias("last_seen_commit"),
        F.count_distinct(F.when(is_("entity_seen") | is_("entity_created"), F.col("commit_index"))).alias("seen_commits"),
        F.count_if(is_("entity_seen")).alias("mention_count"),
        F.array_sort(F.collect_set(F.when(is_("entity_alias_added"), F.col("detail")))).alias("aliases"),
        F.count_if(is_("entity_memory_linked")).alias("memory_count"),
    )


def prior_mentions(mentions: DataFrame, by: Sequence[str], order: Sequence[Column], unit: str, most: int) -> DataFrame:
    """What an ordered run carries forward to each unit: the entities mentioned before it (name, first and last unit, mentions), the last ``most`` seen.

    ``mentions``: the keys of ``by``, ``unit`` (with its number in the run as unit_index), name, entity_type. An entity meets
    the units after its first mention in an equi-join on ``by`` and is then bounded by its place, so a run's own length
    is what the rows grow with.
    """
    seen = mentions.groupBy(*by, "name", "unit_index").agg(F.min_by("entity_type", F.struct(*order)).alias("entity_type"), F.count("*").alias("n"))
    w = Window.partitionBy(*by, "name").orderBy("unit_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = seen.select(*by, "name", F.first("entity_type").over(w).alias("entity_type"), "unit_index", F.sum("n").over(w).alias("mentions"), F.min("unit_index").over(w).alias("first_unit"), F.lead("unit_index").over(Window.partitionBy(*by, "name").orderBy("unit_index")).alias("__next"))
    units = mentions.select(*by, unit, F.col("unit_index").alias("__at")).distinct()
    before = units.join(upto, list(by)).where((F.col("unit_index") < F.col("__at")) & (F.col("__next").isNull() | (F.col("__next") >= F.col("__at"))))
    last = before.select(*by, unit, F.col("__at"), "name", "entity_type", "mentions", "first_unit", F.col("unit_index").alias("last_unit"))
    return top_per(last, [*by, unit], [F.col("last_unit").desc(), F.col("mentions").desc(), F.col("name").asc()], most, "place").drop("__at")


def snapshots(ops: DataFrame, by: Sequence[str], commit: str = "commit_index", value: str | None = None) -> DataFrame:
    """Counts after each commit: operations, distinct entities (those created so far), and a running sum."""
    per = ops.groupBy(*by, commit).agg(
        F.count("*").alias("operations"), F.count_if(F.col("operation") == "create").alias("created"), *([F.sum(value).alias("total")] if value else [])
    )
    if not by:
        sums = {"operation_count": F.col("operations"), "entity_count": F.col("created")} | ({"total": F.col("total")} if value else {})
        out = running_sums(per.withColumnRenamed("total", "__total") if value else per, [F.col(commit)], sums | ({"total": F.col("__total")} if value else {}))
        return out.select(commit, "operation_count", "entity_count", *([F.round("total", 3).alias("total")] if value else []))
    w = Window.partitionBy(*by).orderBy(commit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = per.select(*by, commit, F.sum("operations").over(w).alias("operation_count"), F.sum("created").over(w).alias("entity_count"), *([F.round(F.sum("total").over(w), 3).alias("total")] if value else []))
    return out


def state_at(ops: DataFrame, key: Sequence[str], commit: int, order: Sequence[Column], column: str = "commit_index") -> DataFrame:
    """The latest row of every key among the commits up to one."""
    w = Window.partitionBy(*key).orderBy(*(o.desc() for o in order))
    return ops.where(F.col(column) <= commit).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def parent_rollup(units: DataFrame, parent: str, order: Sequence[str], text: str, tags: str | None = None) -> DataFrame:
    """Parents of chunked units: texts joined in order, distinct tags in order, sizes summed, first and last unit."""
    keys = [F.col(o) for o in order]
    sorted_ = F.array_sort(F.collect_list(F.struct(*(k.alias(f"o{i}") for i, k in enumerate(keys)), F.col(text).alias("t"), *([F.col(tags).alias("g")] if tags else []))))
    rows = units.groupBy(parent).agg(sorted_.alias("__u"), F.count("*").alias("unit_count"), F.sum(F.length(text)).alias("character_count"))
    out = rows.withColumn("summary", F.array_join(F.transform("__u", lambda u: u["t"]), "\n"))
    if tags:
        out = out.withColumn("tags", F.array_distinct(F.transform("__u", lambda u: u["g"])))
    return out.withColumn("first_order", F.get("__u", F.lit(0))["o0"]).withColumn("last_order", F.element_at("__u", -1)["o0"]).drop("__u")


def visible_to(records: DataFrame, mentions: DataFrame, name: str, scene_order: int, hidden: DataFrame | None = None, unit: str = "scene_id", order: str = "scene_order") -> DataFrame:
    """Records of units that mention a character, up to a scene, without items hidden from it."""
    seen = mentions.where((F.col("name") == name) & (F.col(order) <= scene_order)).select(unit).distinct()
    out = records.where(F.col(order) <= scene_order).join(seen, unit, "left_semi")
    return out if hidden is None else out.join(hidden.where(F.col("hidden_from") == name).select("record_id"), "record_id", "left_anti")


def blocked_units(mentions: DataFrame, name: str, scene_order: int, unit: str = "scene_id", order: str = "scene_order") -> DataFrame:
    """Units after a scene that mention a character: what it must not know."""
    return mentions.where((F.col("name") == name) & (F.col(order) > scene_order)).select(unit, order).distinct()


def world_model(layers: dict[str, DataFrame]) -> DataFrame:
    """All layers as one frame with a ``layer`` column; missing columns are null."""
    out = None
    for name, df in layers.items():
        tagged = df.withColumn("layer", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
