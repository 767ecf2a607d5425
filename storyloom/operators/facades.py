"""Facades over the operators: external references (add, search, get_all) and the context kernel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import high_level_keywords, low_level_keywords
from ..sources.readers import reference_documents, reference_files, source_filter
from . import context
from .chunking import chunk_documents
from .fusion import budget, evidence_packet, fuse, passes
from .ranking import ranked
from .retrieval import chunk_support, context_search, keep_external, namespace_rank

SECTIONS = {"source_local_entities": "entities", "source_local_relationships": "relations", "atomic_facts": "facts", "entity_properties": "properties", "chunks": "chunks", "entity_clusters": "insights", "pseudo_relationships": "notes"}


def evidence_board(clusters: DataFrame) -> DataFrame:
    """Degree insights of clusters, most connected first, with a notice for those that several sources share."""
    many = F.col("source_coverage") > 1
    notice = F.concat(F.col("canonical_display_name"), F.lit(" appears in "), F.col("source_coverage").cast("string"), F.lit(" source scopes; their claims stay apart unless one is adopted."))
    return clusters.select("cluster_id", "canonical_display_name", "global_pseudo_degree", "evidence_degree", "source_coverage", F.when(many, notice).alias("notice")).orderBy(F.col("global_pseudo_degree").desc(), "cluster_id")


def relationship_facts(relations: DataFrame, facts: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Facts of matched relations with their chunks' texts: best score first."""
    own = facts.join(relations.select("source_local_relation_id").distinct(), "source_local_relation_id", "left_semi").dropDuplicates(["fact_id"])
    with_text = own.join(chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.col("content").alias("evidence_chunk")), "source_chunk_id", "left")
    return with_text.orderBy(F.col("score").desc(), F.col("source_chunk_id").desc(), F.col("fact_id").desc()).limit(k)


class ExternalReferences:
    """Reference files as a searchable library. State is two frames: documents and vector documents."""

    def __init__(self, spark: SparkSession, documents: DataFrame | None = None, vectors: DataFrame | None = None):
        self.spark, self.documents, self.vectors = spark, documents, vectors

    def reset(self) -> None:
        """Forget all documents."""
        self.documents = self.vectors = None

    def add(self, path: str, reset: bool = False) -> DataFrame:
        """Read files below ``path``, cut them into chunks, and make these searchable; returns the chunks. ``reset`` forgets what was there."""
        if reset:
            self.reset()
        docs = reference_documents(reference_files(self.spark, path))
        chunks = chunk_documents(docs.select("doc_id", "content")).join(docs.select("doc_id", "source_scope_id", "source_path", "title"), "doc_id")
        rows = chunks.select(F.concat(F.lit("chunks:"), "chunk_id").alias("vector_id"), F.lit("chunks").alias("vector_namespace"), F.col("chunk_id").alias("source_id"), "content", "doc_id", "source_scope_id", "source_path")
        self.documents = docs if self.documents is None else self.documents.unionByName(docs).dropDuplicates(["doc_id"])
        self.vectors = rows if self.vectors is None else self.vectors.unionByName(rows, allowMissingColumns=True).dropDuplicates(["vector_id"])
        return chunks

    def plan(self, query: str) -> dict:
        """Names and topics of a query, and its mode."""
        low = low_level_keywords(F.lit(query))
        r = self.spark.range(1).select(low.alias("low"), high_level_keywords(F.lit(query), low).alias("high")).first()
        mode = "mix" if r.low and r.high else "high_level" if r.high else "low_level"
        return {"query": query, "mode": mode, "low": list(r.low), "high": list(r.high)}

    def search(self, query: str, profile: str = "standard", doc_ids: Sequence[str] = (), scopes: Sequence[str] = ()) -> DataFrame:
        """An evidence packet: hits of up to three passes, fused, by section within the budget."""
        limits, plan = budget(profile), self.plan(query)
        docs = self.vectors
        docs = docs.where(F.col("doc_id").isin(*doc_ids)) if doc_ids else docs
        docs = docs.where(F.col("source_scope_id").isin(*scopes)) if scopes else docs
        every = None
        for n, p in enumerate(passes(plan["low"], plan["high"], limits)):
            text = " ".join([query, *p["terms"]]) if p["name"] == "high_level" else " ".join(p["terms"]) or query
            scored = namespace_rank(docs, text).where("score >= 1").orderBy(F.col("score").desc(), F.col("vector_id").desc()).limit(limits["top_k"] * limits["multiplier"])
            rows = ranked(scored.withColumn("__q", F.lit(n)), ["__q"], [F.col("score").desc(), F.col("vector_id").desc()], "r").select("vector_id", F.lit(n).alias("pass_no"), F.lit(p["name"]).alias("pass_name"), (F.col("r") - 1).alias("rank"), "score")
            every = rows if every is None else every.unionByName(rows)
        fused = fuse(every, "vector_id", limits["top_k"] * limits["multiplier"])
        names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
        hits = docs.join(fused, "vector_id").withColumn("section", F.element_at(names, F.col("vector_namespace")))
        return evidence_packet(ranked(hits, ["section"], [F.col("score").desc(), F.col("vector_id").desc()], "rank"), limits, "vector_id").withColumnRenamed("content", "statement")

    def supporting_chunks(self, packet: DataFrame, support: DataFrame) -> DataFrame:
        """Chunks of a packet's hits: ``support`` gives chunk_id for vector_id."""
        kinds = F.create_map(*[F.lit(x) for kv in {"entities": "entity", "relations": "relation", "facts": "fact", "properties": "property", "chunks": "chunk"}.items() for x in kv])
        return chunk_support(packet.join(support, "vector_id").withColumn("kind", F.element_at(kinds, F.col("section"))))

    def ask(self, question: str, profile: str = "standard", answer: Callable[[str], str] | None = None) -> dict:
        """A question's hits with citations E1, E2 and so on, and an answer from them alone if a model is given."""
        hits = [r.asDict() for r in self.search(question, profile).select("ref_id", "vector_id", "section", "statement", "score").orderBy(F.col("score").desc(), "vector_id").collect()]  # within the budget
        items = [{"ref": f"E{i}", "item_id": h["vector_id"], "item_type": h["section"], "statement": h["statement"], "score": h["score"], "default_canon": False} for i, h in enumerate(hits, 1)]
        prompt = "\n".join(["Answer only from these external reference records; do not treat them as canon.", f"Question: {question}", *(f"[{i['ref']}] {i['statement']}" for i in items)])
        return {
            "question": question,
            "items": items,
            "citations": [{k: i[k] for k in ("ref", "item_id", "item_type", "default_canon")} for i in items],
            "answer": answer(prompt).strip() if answer else "",
            "answer_mode": "source_grounded_llm" if answer else "source_grounded_retrieval_only",
        }

    def get_all(self) -> DataFrame:
        """The documents, by id."""
        return self.documents.orderBy("doc_id")

    def filtered(self, paths: Sequence[str] = (), doc_ids: Sequence[str] = (), scopes: Sequence[str] = ()) -> DataFrame:
        return source_filter(self.documents, list(paths), list(doc_ids), list(scopes))


class ContextKernel:
    """Context items over an append-only log: add, update, status, promote, search, packet, view, history.

    ``log`` holds item rows with ``seq``; every change appends, reads derive the rest.
    """

    def __init__(self, log: DataFrame, units: DataFrame | None = None):
        self.log, self.units = log, units

    def append(self, rows: DataFrame) -> None:
        self.log = self.log.unionByName(rows, allowMissingColumns=True)

    def current(self) -> DataFrame:
        return context.current(self.log)

    def set_status(self, item_ids: Sequence[str], status: str) -> None:
        """Append rows with the status; a deletion is the status deleted."""
        top = self.log.agg(F.max("seq")).first()[0]
        changed = self.current().where(F.col("item_id").isin(*item_ids))
        self.append(changed.withColumn("status", F.lit(status)).withColumn("seq", F.lit(top + 1).cast(self.log.schema["seq"].dataType)))

    def promote(self, item_ids: Sequence[str], layer: str) -> tuple[DataFrame, DataFrame]:
        """Append canonical copies; returns the links and events."""
        copies, links, events = context.promote(self.current().where(F.col("item_id").isin(*item_ids)), F.lit(layer))
        self.append(copies)
        return links, events

    def reconcile(self, candidates: DataFrame) -> DataFrame:
        """Decide candidates and append those that are not duplicates."""
        decided = context.reconcile(candidates, self.current())
        self.append(decided.where("action <> 'NONE'").select(*[c for c in candidates.columns if c in self.log.columns]))
        return decided

    def history(self) -> DataFrame:
        return context.status_history(self.log)

    def search(self, query: str, project: str, **filters) -> DataFrame:
        return context_search(self.documents(), query, project, **filters)

    def documents(self) -> DataFrame:
        from .builders import context_documents

        now = self.current()
        return now if self.units is None or "unit_order" in now.columns else context_documents(now, self.units)

    def packet(self, query: str, project: str, entities: Sequence[str] = (), k: int = 12, bound: int | None = None) -> DataFrame:
        """Hits of all source types in their sections; external ones by the keep rules."""
        from .retrieval import before, context_score

        docs = before(self.documents().where(F.col("project_id") == project), "unit_order", bound=bound, keep_null=True)
        inner = context_score(docs.where("source_type <> 'external_reference'"), query, entities)
        outer = keep_external(context_score(docs.where("source_type = 'external_reference'"), query), entities)
        return context.packet(inner.unionByName(outer), k)

    def entity_view(self, entity: str) -> DataFrame:
        return context.entity_view(self.current(), entity)
