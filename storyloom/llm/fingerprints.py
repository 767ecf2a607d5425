"""Document fingerprints by MinHash.

A fingerprint is the minimum of ``PERMUTATIONS`` universal hash functions ((a*x + b) mod 2^64, top 32 bits) over the
document's five-word shingles, all in numpy over Arrow buffers. ``near_duplicates`` cuts signatures into bands, joins
equal bands in Spark and verifies the Jaccard similarity of the whole shingle sets.

Defined results: a null or empty text, or one without words, has no shingles and the fingerprint of all ones; such
texts are alike among themselves (1.0) and unlike all others. Texts of one to four words have one shingle of all
their words. Equal texts have equal fingerprints. Null ids come last in descending order; rows of equal or null id follow
each other by text. Among near duplicates rows of equal id are one document, and a null id has no class of its own (null)
unless its text equals a named one's. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .graphs import linked_components
from .store import discard, materialize, small_batches, tidied

PERMUTATIONS, WORDS_PER_SHINGLE, BANDS = 128, 5, 16
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**64, PERMUTATIONS, dtype=K.U64) | K.U64(1)
_B = _rng.integers(0, 2**64, PERMUTATIONS, dtype=K.U64)
_NONE = np.uint32(0xFFFFFFFF)


def signatures(column: pa.Array, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """A row of ``PERMUTATIONS`` 32-bit minima for every text of an Arrow column."""
    data, offsets = K.utf8_rows(column)
    out = np.full((len(offsets) - 1, PERMUTATIONS), _NONE, np.uint32)
    for i, j in K.blocks(offsets):
        w = K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.ALNUM)
        h, at = K.shingle_rows(w, k)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            begins = at[full]
            for p in range(PERMUTATIONS):
                out[i + full, p] = np.minimum.reduceat(h * _A[p] + _B[p], begins) >> K.U64(32)
    return out


def as_text(sig: np.ndarray) -> list[str]:
    """Signatures as lower-case hexadecimal strings, eight digits a minimum."""
    return [row.tobytes().hex() for row in sig.astype(">u4")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal minima: an estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    import hashlib

    edited = [_edited(a, b) for a, b in zip(texts, nexts)]
    own, alt, nxt = (signatures(pa.array(x, pa.large_string())) for x in (texts, edited, nexts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(as_text(own)),
            pa.array(as_text(alt)),
            pa.array(likeness(own, alt)),
            pa.array(likeness(own, nxt)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _successive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair each row of a sorted partition with the one after it; the last row is left to ``_edges``."""
    held: list[tuple] = []
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        _, offsets = K.utf8_rows(texts)
        for i, j in K.blocks(offsets):
            rows = [*held, *zip(ids.slice(i, j - i).to_pylist(), texts.slice(i, j - i).to_pylist())]
            held = rows[-1:]
            if len(rows) > 1:
                yield _rows([r[0] for r in rows[:-1]], [r[1] for r in rows[:-1]], [r[1] for r in rows[1:]])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a sorted partition: its number, its last row, its first text."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.slice(0, 1) if first is None else first
            last = batch.slice(batch.num_rows - 1)
    if first is not None:
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([part, last.column(0), last.column(1), first.column(1)], names=["part", "doc_id", "text", "first_text"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, nexts = (batch.column(i).to_pylist() for i in range(3))
        if ids:
            yield _rows(ids, [t or "" for t in texts], [t or "" for t in nexts])


def fingerprint_successions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its text edited with the next one, in descending ``key`` order.

    Rows are dealt by range once, so each text crosses the network once; only the two edge rows of a partition are
    paired afterwards (as many rows as partitions). Ties in ``key`` follow the text; the last row's next is the first.
    """
    small_batches(docs.sparkSession)
    if docs.sparkSession.conf.get("spark.sql.exchange.reuse") != "true":
        raise ValueError("spark.sql.exchange.reuse must be on: rows dealt twice by range could fall on other partitions")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    dealt = rows.repartitionByRange(parts, F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    edges = dealt.mapInArrow(_edges, "part int, doc_id long, text string, first_text string")
    # one row per partition, so one task takes them all: the first text of the next filled partition, or of the first
    by_part = Window.orderBy("part")
    pairs = edges.select("doc_id", "text", F.coalesce(F.lead("first_text").over(by_part), F.first("first_text").over(by_part)).alias("next_text"))
    return dealt.mapInArrow(lambda b: tidied(_successive(b)), FIELDS).unionByName(pairs.mapInArrow(_across, FIELDS))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = PERMUTATIONS // BANDS
    for batch in batches:
        sig = signatures(batch.column(1))
        words = np.zeros((len(sig), BANDS), K.U64)
        for b in range(BANDS):
            total = np.full(len(sig), b + 1, K.U64)
            for c in range(width):
                total = K.mix(total ^ sig[:, b * width + c].astype(K.U64)) * K.U64(0x9E3779B97F4A7C15)
            words[:, b] = total
        counts = np.where((sig == _NONE).all(axis=1), 0, BANDS)
        flat = words[counts > 0].reshape(-1).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "bands"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Each document's class of near duplicates: ``doc_id, class_id`` (the smallest id reachable by verified links).

    Two documents are candidates if their signatures share a band of minima; a candidate pair is a link if the Jaccard
    similarity of their whole five-word shingle sets is at least ``percent`` hundredths.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    same = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]
    classes, classes_path = materialize(rows.select("doc_id", *same).groupBy("h", "g").agg(F.min("doc_id").alias("node")), "classes")
    banded, path = materialize(rows.mapInArrow(lambda b: tidied(_bands(b)), "doc_id long, bands array<long>").join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), "bands")
    zero = F.lit(0).cast("long")
    buckets = banded.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node"), zero.alias("rank"), zero.alias("n"))
    labels, used = linked_components(rows, buckets, lambda l, r: F.lit(True), lambda pairs: pairs, WORDS_PER_SHINGLE, percent, K.ALNUM)
    named, _ = materialize(classes.join(labels, "node", "left").select("h", "g", F.coalesce("component", "node").alias("class_id")), "named")
    discard(spark, path, classes_path, *used)
    return rows.select("doc_id", *same).join(named, ["h", "g"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
