"""Toxicity by a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

Features are the presence of hashed character 3- to 6-grams of the lower-cased text. Each has a log-count ratio r from
the training rows; the features with the strongest evidence are kept, a logistic regression is fitted on presence * r,
and r is folded into the weights. Only labelled rows, at most ``most_rows`` of each class (those of least key hash), are
ever brought to one place; scoring reads whole texts in the workers.

Defined results: a null or empty text has no features and the model's base score. Without labelled rows of both classes
every score is the share of toxic ones (0.0 if there are none). Rows with a null id are scored as any other; they have no
label to learn from and belong to neither side of a hold-out (null). Repeated rows are scored each; of a repeated id one text
is learned from. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import small_batches

ORDERS, BITS, FEATURES = (3, 4, 5, 6), 20, 1 << 12
BLOCK_CHARS = 1 << 18


def _gram_cells(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the cell of every n-gram and the text it is in."""
    joined = "\n\n".join(texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t.lower()) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes + 2)[: len(codes)]
    place = codes.astype(K.U64) + K.U64(1)
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, K.U64)
        for i in range(n):
            h = (h ^ place[i : len(codes) - n + 1 + i]) * K.U64(0x9E3779B97F4A7C15 + 2 * n)
            h ^= h >> K.U64(29)
        begins = np.cumsum(sizes + 2) - sizes - 2
        inside = np.arange(len(h)) + n <= (begins + sizes)[owner[: len(h)]]
        yield (h[inside] >> K.U64(64 - BITS)).astype(np.int64), owner[: len(h)][inside]


def _presence(texts: list[str], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, cell) pairs, of the ``kept`` cells if given."""
    found = []
    for cells, owner in _gram_cells(texts):
        if kept is not None:
            hit = kept[cells]
            cells, owner = cells[hit], owner[hit]
        found.append((owner << BITS) | cells)
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > BLOCK_CHARS:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


@dataclass
class Model:
    """Weights by cell (r folded in) and the base; ``score`` is 1 / (1 + exp(-(base + sum of weights)))."""

    cells: np.ndarray
    weights: np.ndarray
    base: float

    def score(self, texts: list[str]) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.cells] = self.weights
        kept = table != 0
        out = np.full(len(texts), self.base)
        for i, j in _blocks(texts):
            owner, cells = _presence(texts[i:j], kept)
            out[i:j] += np.bincount(owner, table[cells], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, prior: float | None = None, alpha: float = 1.0, ridge: float = 0.3, rounds: int = 100) -> Model:
    """Fit the classifier; rows weigh so that ``prior`` (the share of toxic rows where these were drawn) holds."""
    labels = np.asarray(labels, float)
    n, toxic = len(labels), labels.sum()
    if toxic == 0 or toxic == n:
        share = (prior if prior is not None else toxic / n) if n else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    prior = toxic / n if prior is None else prior
    weigh = np.where(labels == 1, prior * n / toxic, (1 - prior) * n / (n - toxic))
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for i, j in _blocks(texts):
        owner, cells = _presence(texts[i:j])
        is_toxic = (labels[i:j] == 1)[owner]
        np.add.at(p, cells[is_toxic], 1)
        np.add.at(q, cells[~is_toxic], 1)
    r = np.log((p + alpha) / (toxic + 2 * alpha)) - np.log((q + alpha) / (n - toxic + 2 * alpha))
    # evidence of a feature: its ratio against the spread that chance gives it
    evidence = np.abs(r) / np.sqrt(1 / (p + alpha) + 1 / (q + alpha))
    evidence[p + q < 3] = 0
    chosen = np.sort(np.argsort(-evidence)[: min(FEATURES, int((evidence > 3).sum()))])
    if not len(chosen):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))))
    kept = np.zeros(1 << BITS, bool)
    kept[chosen] = True
    # the pairs of a block at a time: (its rows, row in the block, feature), in six bytes a pair
    parts = []
    for i, j in _blocks(texts):
        owner, cells = _presence(texts[i:j], kept)
        parts.append((slice(i, j), owner.astype(np.int32), np.searchsorted(chosen, cells).astype(np.uint16)))
    scaled = r[chosen]
    w, base = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    # gradient steps scaled by their own running moments
    moment, moment_b, sq, sq_b = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    for t in range(1, rounds + 1):
        folded, gw, gb = w * scaled, np.zeros_like(w), 0.0
        for rows, owner, feature in parts:
            z = base + np.bincount(owner, folded[feature], minlength=rows.stop - rows.start)
            g = weigh[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows])
            gw += np.bincount(feature, g[owner], minlength=len(w))
            gb += g.sum()
        gw = scaled * gw + ridge * w
        moment, moment_b = 0.9 * moment + 0.1 * gw, 0.9 * moment_b + 0.1 * gb
        sq, sq_b = 0.99 * sq + 0.01 * gw**2, 0.99 * sq_b + 0.01 * gb**2
        rate = 0.1 * min(1.0, 30 / t)
        w = w - rate * (moment / (1 - 0.9**t)) / (np.sqrt(sq / (1 - 0.99**t)) + 1e-8)
        base = base - rate * (moment_b / (1 - 0.9**t)) / (np.sqrt(sq_b / (1 - 0.99**t)) + 1e-8)
    return Model(chosen, (w * scaled).astype(np.float32), float(base))


def learnable(key: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the key as text is not 1 modulo 3."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) != 1


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 3000) -> Model:
    """Fit on at most ``most_rows`` labelled documents of each class; the classes' shares come from all labels."""
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    marks = marks.where(learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = marks.agg(F.avg("y")).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = marks.where("y = 1").orderBy(*order).limit(most_rows).unionByName(marks.where("y = 0").orderBy(*order).limit(most_rows))
    # of a repeated id the least text, so that no more rows come here than ids
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("doc_id").collect()  # most_rows of a class
    return fit([r.text for r in rows], np.array([r.y for r in rows]), prior=share)


def score_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of a text column. Only the text goes to the Python worker and only the score comes back."""
    held = spark.sparkContext.broadcast(model)  # FEATURES weights

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for i, j in K.blocks(K.utf8_rows(texts)[1]):
            out[i:j] = held.value.score([t or "" for t in texts.slice(i, j - i).to_pylist()])
        return pa.array(out, pa.float64())

    return scored(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns of ``keep`` and ``score`` (0 to 1) of every whole text."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), *keep, score_of(docs.sparkSession, model, F.col(text)).alias("score"))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores less than ``threshold``."""
    small_batches(docs.sparkSession)
    return docs.where(score_of(docs.sparkSession, model, F.col(text)) < threshold)
