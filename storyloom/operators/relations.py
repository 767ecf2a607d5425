"""Relationship states, source-local relations and entities, clusters, and the indexes over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import says_no_relation
from ..functions.text import merge_descriptions, merge_keywords, ordered_distinct, stable_id, text_of, words_key
from .graphs import degrees
from .ranking import first_wins


def in_order(value: Column | str, *order: Column | str) -> Column:
    """An aggregate: the values in the given order."""
    v = F.col(value) if isinstance(value, str) else value
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    return F.transform(F.array_sort(F.collect_list(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), v.alias("v")))), lambda r: r["v"])


def relationship_states(updates: DataFrame, scene: str = "scene_id", order: str = "record_id") -> DataFrame:
    """Relations by ends and type (undirected ones with ordered ends): summed strength, first and last scene, evidence in order."""
    swap = (F.col("direction") == "undirected") & (F.col("source_entity_id") > F.col("target_entity_id"))
    s = F.when(swap, F.col("target_entity_id")).otherwise(F.col("source_entity_id"))
    t = F.when(swap, F.col("source_entity_id")).otherwise(F.col("target_entity_id"))
    rows = updates.select(*[c for c in updates.columns if c not in ("source_entity_id", "target_entity_id")], s.alias("source_entity_id"), t.alias("target_entity_id"))
    return rows.groupBy("source_entity_id", "target_entity_id", "relation_type").agg(
        F.max_by("direction", F.struct(F.col(scene), F.col(order))).alias("direction"),
        F.min(scene).alias("first_seen_scene"),
        F.max(scene).alias("last_updated_scene"),
        F.round(F.sum("strength_delta"), 3).alias("strength"),
        F.count("*").alias("update_count"),
    )


def source_local_entities(rows: DataFrame, scope: str = "source_scope_id", name: str = "entity_name") -> DataFrame:
    """Entities per scope and name: distinct descriptions in order, chunks, documents."""
    return rows.groupBy(scope, name).agg(
        ordered_distinct(in_order("description", "timestamp", "source_id")).alias("descriptions"),
        F.array_sort(F.collect_set("source_id")).alias("source_chunk_ids"),
        F.array_sort(F.collect_set("source_doc_id")).alias("source_doc_ids"),
        F.count("*").alias("mentions"),
    ).withColumn("description", merge_descriptions(name, "descriptions"))


def source_local_relationships(rows: DataFrame, scope: str = "source_scope_id") -> DataFrame:
    """Relations per scope and unordered pair: merged keywords, the largest weight; self-loops and denials go."""
    kept = rows.where((F.col("src_id") != F.col("tgt_id")) & ~says_no_relation("description", "keywords"))
    pair = kept.select("*", F.least("src_id", "tgt_id").alias("a"), F.greatest("src_id", "tgt_id").alias("b"))
    return pair.groupBy(scope, "a", "b").agg(
        merge_keywords(in_order("keywords", "timestamp", "source_id")).alias("keywords"),
        ordered_distinct(in_order("description", "timestamp", "source_id")).alias("descriptions"),
        F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"),
        F.array_sort(F.collect_set("source_id")).alias("source_chunk_ids"),
        F.array_sort(F.collect_set("source_doc_id")).alias("source_doc_ids"),
    )


def attach_clusters(relations: DataFrame, entities: DataFrame, scope: str = "source_scope_id") -> DataFrame:
    """Clusters of a relation's ends: by (scope, name), else by a name that has one cluster everywhere, else its own."""
    scoped = entities.select(scope, words_key("entity_name").alias("k"), "cluster_id").where("k <> ''").groupBy(scope, "k").agg(F.max("cluster_id").alias("c1"))
    single = entities.select(words_key("entity_name").alias("k"), "cluster_id").where("k <> ''").groupBy("k").agg(F.min("cluster_id").alias("c2"), F.count_distinct("cluster_id").alias("n")).where("n = 1").drop("n")
    out = relations
    for end in ("src", "tgt"):
        out = out.withColumn("k", words_key(f"{end}_id")).join(scoped, [scope, "k"], "left").join(single, "k", "left")
        own = F.col(f"{end}_cluster_id") if f"{end}_cluster_id" in relations.columns else F.lit(None).cast("string")
        out = out.withColumn(f"{end}_cluster_id", F.coalesce("c1", "c2", own, F.lit(""))).drop("k", "c1", "c2")
    return out


def clusters(entities: DataFrame, relations: DataFrame, cluster: str = "cluster_id", name: str = "entity_name", scope: str = "source_scope_id", doc: str = "source_doc_id") -> DataFrame:
    """Clusters of entities: name, aliases, coverage (scopes), evidence degree (documents), pseudo degree (neighbours)."""
    rows = entities.groupBy(cluster).agg(
        F.array_sort(F.collect_set(name)).alias("aliases"), F.count_distinct(scope).alias("source_coverage"), F.count_distinct(doc).alias("evidence_degree"), F.count("*").alias("member_count")
    )
    near = degrees(relations.where("src_cluster_id <> '' AND tgt_cluster_id <> ''"), "src_cluster_id", "tgt_cluster_id").withColumnRenamed("node", cluster).withColumnRenamed("degree", "global_pseudo_degree")
    return rows.join(near, cluster, "left").withColumn("global_pseudo_degree", F.coalesce("global_pseudo_degree", F.lit(0))).withColumn("canonical_display_name", F.get("aliases", F.lit(0)))


def pseudo_relations(relations: DataFrame) -> DataFrame:
    """Relations between clusters: summed weight, members, documents."""
    pair = relations.where("src_cluster_id <> '' AND tgt_cluster_id <> ''").select("*", F.least("src_cluster_id", "tgt_cluster_id").alias("a"), F.greatest("src_cluster_id", "tgt_cluster_id").alias("b"))
    return pair.groupBy("a", "b").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.count("*").alias("member_count"), F.array_sort(F.collect_set("source_doc_id")).alias("source_doc_ids")).withColumn("pseudo_relation_id", stable_id("ref_pseudo_rel", "a", "b", separator="|", digits=None))


def inverted_index(df: DataFrame, values: Column, key: str, name: str, block: Column) -> DataFrame:
    """Posting lists in blocks: ``name, block, keys, n``, the sorted distinct keys that have each value of an array.

    ``block`` is a function of the key (such as its range), so that a value that most rows have is many rows of a bounded
    length and not one; a value's list is its blocks' lists, and its count the sum of theirs.
    """
    pairs = df.select(F.col(key).alias("__key"), block.alias("block"), F.explode(F.array_distinct(values)).alias(name))
    return pairs.groupBy(name, "block").agg(F.array_sort(F.collect_set("__key")).alias("keys")).withColumn("n", F.size("keys").cast("long"))


def source_scopes(docs: DataFrame, scope: str = "source_scope_id") -> DataFrame:
    """Scopes with their name, documents and paths counted, and the first and last document; ``scope_documents`` lists them."""
    return docs.groupBy(scope).agg(F.min("source_scope_name").alias("source_scope_name"), F.count("*").alias("doc_count"), F.count_distinct("source_path").alias("path_count"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))


def scope_documents(docs: DataFrame, scope: str = "source_scope_id") -> DataFrame:
    """The documents and paths of every scope, one row each: a scope may have any number."""
    return docs.select(scope, "doc_id", "source_path").distinct()


def facts_from_descriptions(entities: DataFrame, subject: str = "entity_name") -> DataFrame:
    """A fact of confidence 0.7 from every description: ``subject described_as description``."""
    rows = entities.select(F.col(subject).alias("subject"), F.explode("descriptions").alias("object"))
    return rows.select(stable_id("ref_fact", "subject", F.lit("described_as"), "object", separator="|", digits=None).alias("fact_id"), "subject", F.lit("described_as").alias("predicate"), "object", F.concat_ws(" ", "subject", "object").alias("statement"), F.lit(0.7).alias("confidence"))


def vector_document(namespace: str, source_id: Column, *lines: Column) -> list[Column]:
    """The columns of a document to embed: id, namespace, its non-empty lines."""
    return [F.concat(F.lit(f"{namespace}:"), source_id.cast("string")).alias("vector_id"), F.lit(namespace).alias("vector_namespace"), source_id.cast("string").alias("source_id"), F.concat_ws("\n", *(F.nullif(text_of(x), F.lit("")) for x in lines)).alias("content")]


def attach_assets(entities: DataFrame, assets: DataFrame, key: str, name: str) -> DataFrame:
    """Entities with the sorted statements of the facts or properties that name them."""
    owned = assets.groupBy(key).agg(F.array_sort(F.collect_set("statement")).alias(name))
    return entities.join(owned, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def fact_jobs(cluster_rows: DataFrame, chunks: DataFrame, min_degree: int = 2, per_job: int = 12) -> DataFrame:
    """Extraction jobs: clusters of enough degree, their chunks by scope in batches, each with a stable id.

    ``cluster_rows``: cluster_id, degree; ``chunks``: cluster_id, source_scope_id, doc_id, chunk_index, chunk_id.
    """
    rows = chunks.join(cluster_rows.where(F.col("degree") >= min_degree).select("cluster_id", "degree"), "cluster_id")
    rows = first_wins(rows, ["cluster_id", "chunk_id"], [F.col("source_scope_id").asc()])
    w = Window.partitionBy("cluster_id", "source_scope_id").orderBy("doc_id", "chunk_index", "chunk_id")
    batch = rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / per_job).cast("int"))
    jobs = batch.groupBy("cluster_id", "source_scope_id", "batch", "degree").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    return jobs.withColumn("job_id", stable_id("ref_job", "cluster_id", "source_scope_id", "batch", separator="|", digits=None))
