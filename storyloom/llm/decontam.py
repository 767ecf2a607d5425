"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over successive words: some places count and the others are ignored, so a passage whose
words were partly replaced still shares hashes with its original. The masks are such that every stretch that counts
holds a seed, so no pair is missed. Hashes of all benchmark items and of all texts are
joined in Spark; at each hit the passage and the item are laid along their common diagonal, and the pair counts if any
stretch of that diagonal has the matched words needed and an identity of ``IDENTITY`` percent. The longest is reported.
Needed are ``NEEDED`` words, of a shorter item ``IDENTITY`` percent of its words.

Only text hashes in a fixed-size bit set of the benchmark's hashes leave the scan, together with the words around
them; the bit set's false hits fall in the join. Seeds and items that many texts hold, as of a passage in a third of them,
are spread over as many tasks as they hold shares of all hits.

Defined results: null or empty texts, texts without hits and items of fewer than ``FEWEST`` words, which any text may
hold by chance, give no rows. Rows of equal id, also of null id, are one document. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graphs import spread_join
from .store import discard, materialize, small_batches, tidied

#: Four words running, and five around one replaced. A stretch of at least 80% with n = 5q + r words has at most q replaced,
#: so a run of (4q + r) / (q + 1) matches or more: four, or, where q + r <= 3, runs of three (and one of two at most) with
#: single replaced words between them. Runs of 2 and 3 or of 2 and 2 are all there is only in items of five or six words.
MASKS = ("1111", "111011")
SHORT = {5: ("11011", "11101", "10111"), 6: ("110111",)}
FEWEST, NEEDED, IDENTITY = 5, 12, 80
BITS = 26


def _places(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def _seeds(w: K.Words, lengths: list[int]) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """For every mask, and those of short items of the ``lengths``: the length it is for if any, hashes and places."""
    for n, mask in [*((None, m) for m in MASKS), *((x, m) for x in lengths for m in SHORT[x])]:
        h, at = K.grams(w, _places(mask))
        yield n, K.mix(h ^ K.U64(int(mask, 2))), at


def needed(words: int) -> int:
    """Matched words that an overlap with an item of so many words must have."""
    return min(NEEDED, -(-IDENTITY * words // 100))


def _items(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.utf8_rows(batch.column(1))
        for i, j in K.blocks(offsets):
            w = K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.ALNUM)
            rows, sizes = K.row_of(w.first), np.diff(w.first)
            ids = batch.column(0).slice(i, j - i).to_pylist()
            seeds = [[] for _ in ids]
            for n, h, at in _seeds(w, lengths):
                for x, p in zip(h.view(np.int64).tolist(), at.tolist()):
                    r = rows[p]
                    if sizes[r] >= FEWEST and n in (None, sizes[r]):
                        seeds[r].append({"gram": x, "place": int(p - w.first[r])})
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([w.hashes[a:b].view(np.int64) for a, b in zip(w.first[:-1], w.first[1:])], pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.struct([("gram", pa.int64()), ("place", pa.int32())])))],
                names=["item_id", "item_words", "seeds"],
            )


def _bit_set(grams: DataFrame) -> np.ndarray:
    """2^BITS bits of the grams' leading bits; at most 2^BITS / 64 rows come to the driver."""
    rows = grams.select(F.shiftrightunsigned("gram", 64 - BITS).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) AS int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _segments(batches: Iterator[pa.RecordBatch], bits: np.ndarray, lengths: list[int], pad: int) -> Iterator[pa.RecordBatch]:
    """Stretches of texts with possible hits: ``pad`` words on either side of them, and the hits (place in the text, gram).

    ``pad`` is the length of the longest item, so that every diagonal through a hit lies in one stretch.
    """
    hit_kind = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())]))
    for batch in batches:
        data, offsets = K.utf8_rows(batch.column(1))
        for i, j in K.blocks(offsets):
            w = K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.ALNUM)
            grams, places = [], []
            for _, h, at in _seeds(w, lengths):
                top = (h >> K.U64(64 - BITS)).astype(np.int64)
                hit = ((bits[top >> 6] >> (top & 63).astype(K.U64)) & K.U64(1)).astype(bool)
                grams.append(h[hit])
                places.append(at[hit])
            grams, places = np.concatenate(grams), np.concatenate(places)
            if not len(places):
                continue
            order = np.argsort(places, kind="stable")
            grams, places = grams[order], places[order]
            rows = np.searchsorted(w.first, places, side="right") - 1
            cuts = np.flatnonzero((np.diff(places) > 2 * pad) | (np.diff(rows) > 0)) + 1
            ids = batch.column(0).slice(i, j - i).to_pylist()
            out = [[], [], [], []]
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
                r = rows[s]
                base = w.first[r]
                lo, hi = max(base, places[s] - pad), min(w.first[r + 1], places[e - 1] + pad)
                out[0].append(ids[r])
                out[1].append(int(lo - base))
                out[2].append(w.hashes[lo:hi].view(np.int64))
                out[3].append([{"at": int(p - base), "gram": g} for p, g in zip(places[s:e], grams[s:e].view(np.int64).tolist())])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], hit_kind)], names=["doc_id", "first", "words", "hits"])


def best_overlap(text: np.ndarray, item: np.ndarray, shift: int, needed: int = 1) -> tuple[int, int, int, int]:
    """Of the item laid on the text's words at ``shift``: matches, begin and end in the item, length of the best overlap.

    That is the longest stretch of at least ``needed`` matches and ``IDENTITY`` percent, from a matched word to a matched
    word; of equal lengths the one with the most matches, then the first. Zeros if there is none.
    """
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    if hi <= lo:
        return 0, 0, 0, 0
    same = text[lo + shift : hi + shift] == item[lo:hi]
    begins = np.flatnonzero(same)
    if len(begins) < needed:
        return 0, 0, 0, 0
    # a stretch has the identity if its sum of these is not negative; the first begin of no larger sum is the best for an end
    sums = np.concatenate([[0], np.cumsum(np.where(same, 100 - IDENTITY, -IDENTITY))])
    ends = begins + 1
    lows = np.minimum.accumulate(sums[begins])
    first = np.searchsorted(-lows, -sums[ends], side="left")
    matched = np.arange(1, len(ends) + 1) - first
    length = np.where(matched >= needed, ends - begins[np.minimum(first, len(begins) - 1)], 0)
    n = np.lexsort((-np.arange(len(ends)), matched, length))[-1]
    if length[n] <= 0:
        return 0, 0, 0, 0
    return int(matched[n]), int(lo + begins[first[n]]), int(lo + ends[n]), int(length[n])


_OUT = "doc_id long, item_id long, matched_words int, overlap_words int, item_words int, first_word int, item_first int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _OUT.split(", ")]
    for batch in batches:
        found = [[] for _ in names]
        ids, items, firsts, diagonals = (batch.column(c).to_pylist() for c in (0, 1, 2, 3))
        for r, (doc, item, first, diagonal) in enumerate(zip(ids, items, firsts, diagonals)):
            text, own = (np.asarray(batch.column(c)[r].values.to_numpy(zero_copy_only=False)) for c in (4, 5))
            matched, begin, _, length = best_overlap(text, own, diagonal - first, needed(len(own)))
            if matched:
                for column, value in zip(found, (doc, item, matched, length, len(own), diagonal + begin, begin)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("doc_id", "item_id") else pa.int32()) for c, n in zip(found, names)], names=names)


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The longest verified overlap of every document and benchmark item that share one.

    ``doc_id, item_id, matched_words, overlap_words, item_words, first_word`` (in the text, words from 0), ``item_first``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    schema = "item_id long, item_words array<long>, seeds array<struct<gram: long, place: int>>"
    sizes = source.mapInArrow(lambda b: _items(b, []), schema).select(F.size("item_words").alias("n"))
    rows_of_sizes = sizes.groupBy(F.least("n", F.lit(max(SHORT) + 1)).alias("kind")).agg(F.max("n").alias("n")).collect()  # eight at most
    lengths = sorted(r.n for r in rows_of_sizes if r.n in SHORT)
    pad = max((r.n for r in rows_of_sizes), default=0)
    items, items_path = materialize(source.mapInArrow(lambda b: _items(b, lengths), schema), "items")
    seeds = items.select("item_id", F.explode("seeds").alias("s")).select("item_id", "s.gram", "s.place")
    bits = spark.sparkContext.broadcast(_bit_set(seeds).tobytes())
    found = rows.mapInArrow(lambda b: tidied(_segments(b, np.frombuffer(bits.value, np.uint64), lengths, pad)), "doc_id long, first int, words array<long>, hits array<struct<at: int, gram: long>>")
    segments, segments_path = materialize(found.withColumn("segment", F.monotonically_increasing_id()), "segments")
    hits = segments.select("segment", F.explode("hits").alias("h")).select("segment", "h.at", "h.gram")
    n_hits = segments.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()[0]
    met = spread_join(hits, seeds, "gram", "segment", n_hits).select("segment", "item_id", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    pairs, pairs_path = materialize(met, "diagonals")
    laid = spread_join(pairs, items.select("item_id", "item_words"), "item_id", "segment", pairs.count()).join(segments.select("segment", "doc_id", "first", "words"), "segment")
    skipped = F.greatest(F.col("diagonal") - F.col("first"), F.lit(0))
    beside = F.slice("words", skipped + 1, F.greatest(F.size("item_words"), F.lit(1)))
    verified = laid.select("doc_id", "item_id", (F.col("first") + skipped).alias("first"), "diagonal", beside.alias("words"), "item_words").mapInArrow(lambda b: tidied(_verify(b)), _OUT)
    fields = [f.split()[0] for f in _OUT.split(", ")][2:]
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct(*(F.col(f) if f != "first_word" else (-F.col(f)).alias(f) for f in fields))).alias("m"))
    out, _ = materialize(best.select("doc_id", "item_id", *((F.col(f"m.{f}") if f != "first_word" else -F.col(f"m.{f}")).alias(f) for f in fields)), "contaminations")
    discard(spark, items_path, segments_path, pairs_path)
    bits.unpersist()
    return out
