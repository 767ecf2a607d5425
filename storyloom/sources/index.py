"""Search indexes as tables: documents with their vectors, written by upserts.

An index is a versioned table (``versions.VersionedTable``): an upsert rewrites the buckets of the documents that it brings, and a
failed one leaves the last version whole. Batching is Spark's: vectors are computed partition by partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import hash_embedding
from ..functions.text import retrieval_tokens, text_of
from ..operators.ranking import last_wins
from .versions import VersionedTable

#: Statuses of context documents that are indexed (fixed values).
INDEXED = ("active", "canonical", "tentative")


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The index as of a version (the newest); None if there is none."""
    return VersionedTable(spark, path, []).read(version)


def upsert_index(docs: DataFrame, path: str, key: str = "doc_id", text: Column | str = "text", embed: Callable[[Column], Column] | None = None, reset: bool = False, sequence: str | Column | None = None, buckets: int = 64) -> DataFrame:
    """Insert or replace documents in the index at ``path`` and return its new state; ``reset`` starts anew.

    ``embed``: tokens to a vector (hash embeddings if not given). Rows whose text is already indexed under their key keep their
    vector. ``buckets``: of a new index. Of rows of equal key the last by ``sequence`` counts (by text, if none is given).
    """
    spark = docs.sparkSession
    new = last_wins(docs.withColumn("__text", text_of(text)), [key], F.col("__text") if sequence is None else sequence).withColumn("text_sha", F.sha2("__text", 256))
    table = VersionedTable(spark, path, [key], buckets)
    old = None if reset else table.read()
    vector = (embed or hash_embedding())(retrieval_tokens("__text")).alias("embedding")
    if old is None:
        out = new.select(*docs.columns, "text_sha", vector)
    else:
        known = old.select(key, "text_sha", "embedding")
        same = new.join(known, [key, "text_sha"]).select(*docs.columns, "text_sha", "embedding")
        changed = new.join(known.select(key, "text_sha"), [key, "text_sha"], "left_anti").select(*docs.columns, "text_sha", vector)
        out = same.unionByName(changed)
    if reset:
        table.replace(out, "text_sha")
    else:
        table.upsert(out, "text_sha")
    return table.read()


def context_index(documents: DataFrame, path: str, project: str | None = None, reset: bool = False) -> DataFrame:
    """The index of context documents: those of a project, if one is given, whose status is indexed, by their statement."""
    rows = documents.where(F.col("status").isin(*INDEXED))
    rows = rows.where(F.col("project_id") == project) if project else rows
    said = F.coalesce(F.nullif(text_of("text"), F.lit("")), text_of("statement")) if "text" in documents.columns else text_of("statement")
    return upsert_index(rows, path, "doc_id", said, reset=reset)
