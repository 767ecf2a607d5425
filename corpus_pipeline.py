"""A training corpus from ``documents`` in five stages, each an operator of ``storyloom.llm`` on all that the last kept.

Toxic documents go; repeated lines stay only in the first document that holds them; of each group of near duplicates
the document of the smallest id stays; documents that overlap a benchmark item go; what is left is encoded and
decoded. Nulls, empty texts and repeated rows follow the operators' own definitions; documents without an id are told apart
by their texts, so that one that is toxic, a near copy or contaminated goes alone, and of copies one with an id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.store import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with ``key``: their id or, where it is null, a number made of the text, above any usual id."""
    made = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    return docs.select(*COLUMNS).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), made))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents (with ``key``) whose key is not among ``keys`` (doc_id)."""
    return docs.join(keys.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject."""
    from storyloom.llm.toxicity import accepted, train

    return accepted(docs.select(*COLUMNS), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document of a smaller id holds."""
    from storyloom.llm.line_dedup import dedup_lines

    return dedup_lines(docs, keep=("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    from storyloom.llm.jaccard import jaccard_components

    rows = keyed(docs)
    return without(rows, jaccard_components(rows, key="key", k=5, percent=80).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    from storyloom.llm.decontam import contaminations

    rows = keyed(docs)
    return without(rows, contaminations(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="key"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    import public_tokenizers

    from storyloom.llm.bpe import round_trip

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_round_trip", tokenize),
]

#: Classification, substitution-tolerant overlaps and BPE have no SQL form; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written to the shared folder and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), name)
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
