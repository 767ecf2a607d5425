"""N-gram Jaccard join by prefix filters under several global token orders.

A token is a word shingle's 64-bit hash. Every order sorts tokens by a fixed-size sketch of how many documents hold
them (rare first), and each breaks ties by another hash and another step of the counts, so the orders differ. If two
sets are similar enough, their prefixes share a token under each order: candidates come from the first order (with the
bound that the shared token's position sets on the overlap), those that share nothing under the second go, and the
rest are verified on their whole sets. Documents with equal sets are one node from the start.

Defined results: a null or empty text, or one without words, has an empty set, no links and its own id as component.
Texts with fewer words than a shingle have one token of them all. Rows of equal id count as the same document. A null
id keeps its row, with a null component unless its set equals a named document's. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graphs import linked_components
from .store import discard, materialize, small_batches, tidied

#: Cells of the sketch of document counts: 4 MB once merged, at any corpus size.
CELLS = 1 << 22
_PART = 1 << 16
_SEEDS = (K.U64(0x8CB92BA72F3D8DD7), K.U64(0xD6E8FEB86659FD93))


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> K.U64(42)).astype(np.int64)


def _sets(batch: pa.RecordBatch, k: int, kept: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = K.utf8_rows(batch.column(1))
    for i, j in K.blocks(offsets):
        h, at = K.shingle_rows(K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], kept), k)
        yield i, j, [np.unique(h[s:e]) for s, e in zip(at[:-1], at[1:])]


def document_counts(rows: DataFrame, k: int, kept: np.ndarray) -> np.ndarray:
    """The sketch: about how many documents hold a token of each cell, as 4*log2(1 + count) in a byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for _, _, sets in _sets(batch, k, kept):
                np.add.at(cells, _cell(np.concatenate(sets)), np.uint32(1))
        for p in range(0, CELLS, _PART):
            some = cells[p : p + _PART]
            if some.any():
                kind = np.uint8 if some.max() < 256 else np.uint32
                yield pa.RecordBatch.from_arrays([pa.array([p // _PART], pa.int32()), pa.array([some.astype(kind).tobytes()], pa.binary())], names=["part", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[p] = totals.get(p, np.zeros(_PART, np.uint64)) + np.frombuffer(c, np.uint8 if len(c) == _PART else np.uint32)
        for p, total in totals.items():
            steps = np.minimum(255, 4 * np.log2(1.0 + total)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["part", "counts"])

    parts = rows.select("doc_id", "text").mapInArrow(lambda b: tidied(count(b)), "part int, counts binary")
    merged = parts.repartition(CELLS // _PART, "part").mapInArrow(merge, "part int, counts binary")
    out = np.zeros(CELLS, np.uint8)
    for p, c in merged.collect():
        out[p * _PART : (p + 1) * _PART] = np.frombuffer(c, np.uint8)
    return out


def prefixes(rows: DataFrame, sketch: np.ndarray, k: int, percent: int, kept: np.ndarray) -> DataFrame:
    """``doc_id, n, s1, s2`` (the set's size and 128-bit sum) and the prefixes ``one`` and ``two`` in their orders."""
    held = rows.sparkSession.sparkContext.broadcast(sketch.tobytes())  # CELLS bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for i, j, sets in _sets(batch, k, kept):
                sums, firsts = [[], []], [[], []]
                for tokens in sets:
                    n = len(tokens)
                    p = n - (-(-percent * n // 100)) + 1 if n else 0
                    step = counts[_cell(tokens)]
                    for o, (seed, down) in enumerate(zip(_SEEDS, (0, 2))):
                        spread = K.mix(tokens ^ seed)
                        sums[o].append(int(spread.sum(dtype=K.U64)))
                        order = ((step >> np.uint8(down)).astype(K.U64) << K.U64(56)) | (spread >> K.U64(8))
                        if p < n:
                            low = np.argpartition(order, p - 1)[:p]
                            low = low[np.argsort(order[low])]
                        else:
                            low = np.argsort(order)
                        firsts[o].append(tokens[low].view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in firsts[0]])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(f))) for f in firsts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array(s, K.U64).view(np.int64)) for s in sums), *lists],
                    names=["doc_id", "n", "s1", "s2", "one", "two"],
                )

    return rows.select("doc_id", "text").mapInArrow(lambda b: tidied(cut(b)), "doc_id long, n long, s1 long, s2 long, one array<long>, two array<long>")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, kept: np.ndarray = K.NON_SPACE) -> DataFrame:
    """``doc_id, n_shingles, component_id``: components of the links of Jaccard similarity >= percent / 100."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = document_counts(rows, k, kept)
    cut, cut_path = materialize(prefixes(rows, sketch, k, percent, kept), "prefixes")
    classes, classes_path = materialize(cut.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node")), "classes")
    # a set of fewer than this many tokens is similar enough to equal sets alone
    fewest = next(n for n in range(1, 200) if 100 * n >= percent * (n + 1))
    ones = cut.where(F.col("n") >= fewest).join(classes.select(F.col("node").alias("doc_id"), "s1", "s2", "n"), ["doc_id", "s1", "s2", "n"], "left_semi")
    tokens = ones.select(F.col("doc_id").alias("node"), "n", F.posexplode("one").alias("rank", "bucket")).select("bucket", "node", F.col("rank").cast("long").alias("rank"), "n")
    second = ones.select("doc_id", "two")

    def compatible(l: str, r: str):
        n, m, at, to = F.col(f"{l}.n"), F.col(f"{r}.n"), F.col(f"{l}.rank"), F.col(f"{r}.rank")
        most = F.least(n - at, m - to)  # of common tokens, if this is the first common one
        return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (F.lit(100) * most >= F.lit(percent) * (n + m - most))

    def accept(pairs: DataFrame) -> DataFrame:
        x, y = second.select(F.col("doc_id").alias("a"), F.col("two").alias("x")), second.select(F.col("doc_id").alias("b"), F.col("two").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(F.arrays_overlap("x", "y")).select("a", "b")

    labels, labels_paths = linked_components(rows, tokens, compatible, accept, k, percent, kept)
    named = classes.join(labels, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component"))
    named, _ = materialize(named, "named")
    discard(spark, classes_path, *labels_paths)
    return cut.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
