"""Substring deduplication through a compacted De Bruijn graph of repeated windows.

Every window of ``window`` words is an edge from its first words to its last ones. Only edges that documents of
different ids hold matter. They are found in two steps: the least hash of the shorter runs inside a window stands for it,
so equal windows have equal stand-ins, and stand-ins are few; only windows whose stand-in is repeated are counted, and
successive windows of one stand-in travel together.
A repeated edge that all its places leave by the same next edge, which in turn has as many places, does not branch. Edges of one stand-in
meet in one bucket (those of very frequent stand-ins are counted by Spark instead) and are chained there to segments; a join of the segments
with their successors chains them on, and what is chained, in the coordinates of the first document that holds it, is one path. All places of a path's first edge run through the whole path, so places of first edges alone
are fetched from the texts; with the path's length they are the repeated spans. The words of every span are then held
against those at the path's source coordinates by another hash; if any differ, the job starts again with other hashes.

Defined results: null and empty texts have no words. Rows of equal id are one document, rows of null id keep everything and
count for nothing. Extra columns are ignored. Of equal windows in one document none goes for the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .graphs import filter_bits, hash_bits, held_in
from .store import discard, materialize, small_batches, tidied

ODD = 0x9FB21C651E98DF25
#: Stand-ins at more places than this have their windows counted by Spark, and not with the others of their bucket.
HOT = 1 << 12
#: Windows of a bucket on average, 4 MB of hashes.
BUCKET = 1 << 19
#: Attempts with other hashes, each of which fails with the probability of a 64-bit collision.
ATTEMPTS = 4


def _joined(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs from those of runs ``a`` of ``size`` words and of runs ``b`` that follow them."""
    n = min(len(a), len(b) - size)
    return K.mix(a[:n] * K.U64(0x9E3779B97F4A7C15) + b[size : size + n]) if n > 0 else np.zeros(0, K.U64)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` successive words, in a logarithmic number of steps."""
    power, width, out, have = words, 1, None, 0
    while True:
        if size & width:
            out, have = (power, width) if out is None else (_joined(out, power, have), have + width)
        if have == size:
            return out
        power, width = _joined(power, power, width), 2 * width


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` successive values."""
    width = 1
    while 2 * width <= size:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def _windows(batch: pa.RecordBatch, window: int, seed: int) -> Iterator[tuple[int, K.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every block: its first row, words, and of its windows the row, first word in the row, hash and stand-in."""
    data, offsets = K.utf8_rows(batch.column(1))
    for i, j in K.blocks(offsets):
        w = K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.NON_SPACE, lower=False)
        n = len(w.hashes) - window + 1
        if n <= 0:
            continue
        rows = K.row_of(w.first)
        inside = np.flatnonzero(rows[:n] == rows[window - 1 :])
        if not len(inside):
            continue
        own = K.mix(w.hashes ^ K.U64(seed)) if seed else w.hashes
        half = (window + 1) // 2
        least = sliding_least(run_hashes(own, half), window - half + 1)
        rows = rows[inside]
        yield i, w, rows, inside - w.first[rows], run_hashes(own, window)[inside], least[inside]


def _stand_ins(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, rows, _, _, least in _windows(batch, window, seed):
            new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])]))
            ids = batch.column(0).take(pa.array(rows[new] + i))
            yield pa.RecordBatch.from_arrays([ids, pa.array(least[new].view(np.int64))], names=["doc_id", "stand_in"])


def _runs(batches: Iterator[pa.RecordBatch], window: int, seed: int, bits: np.ndarray, hot: np.ndarray, of_hot: bool) -> Iterator[pa.RecordBatch]:
    """Runs of windows of one stand-in that may be repeated: a hash of all, their place, the window that follows (0: none).

    Those of hot stand-ins, or those of all others.
    """
    most = window - (window + 1) // 2 + 1
    for batch in batches:
        for i, _, rows, at, h, least in _windows(batch, window, seed):
            new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])]))
            # as long as stand-ins usually last: the first and last window then hold all words between them
            begin = np.flatnonzero((np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))) % most == 0)
            end = np.append(begin[1:], len(h))
            follows = np.append(h, K.U64(0))[end]
            follows[np.append(rows, -1)[end] != rows[begin]] = 0
            keep = np.flatnonzero(held_in(bits, least[begin]) & (held_in(hot, least[begin]) == of_hot))
            if not len(keep):
                continue
            begin, end, follows = begin[keep], end[keep], follows[keep]
            runs = K.mix(K.mix(h[begin] + (end - begin).astype(K.U64)) ^ h[end - 1])
            sizes = end - begin
            ends = np.concatenate([[0], np.cumsum(sizes)])
            own = h[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes)]
            windows = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(own.view(np.int64)))
            ids, tags = (batch.column(c).take(pa.array(rows[begin] + i)) for c in (0, 2))
            hashes = [pa.array(x.view(np.int64)) for x in (runs, least[begin], follows)]
            yield pa.RecordBatch.from_arrays([*hashes, ids, pa.array(tags.to_numpy() + at[begin]), windows], names=["run", "stand_in", "next", "doc_id", "place", "windows"])


def _places(batches: Iterator[pa.RecordBatch], window: int, seed: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows that may begin a path."""
    for batch in batches:
        for i, _, rows, at, h, _ in _windows(batch, window, seed):
            keep = np.flatnonzero(held_in(bits, h))
            if len(keep):
                ids, tags = (batch.column(c).take(pa.array(rows[keep] + i)) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), ids, pa.array(tags.to_numpy() + at[keep])], names=["edge", "doc_id", "place"])


_SEGMENTS = "edge long, n long, next long, doc_id long, place long, edges long"


def _segments(group: pa.Table) -> pa.Table:
    """The repeated edges of a bucket, which holds all places of each, chained as far as they follow each other in it."""
    group = group.sort_by([("doc_id", "ascending"), ("place", "ascending")]).combine_chunks()
    lists = group["windows"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    edge, run = lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    follows = np.append(edge[1:], 0)
    follows[ends - 1] = group["next"].to_numpy()
    doc, place = group["doc_id"].to_numpy()[run], group["place"].to_numpy()[run] + np.arange(len(edge)) - (ends - sizes)[run]
    order = np.argsort(edge, kind="stable")  # of one edge, places by document and place
    edge, follows, doc, place = edge[order], follows[order], doc[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]]))
    end = np.append(begin[1:], len(edge))
    low, high = np.minimum.reduceat(follows, begin), np.maximum.reduceat(follows, begin)
    repeated = doc[begin] < doc[end - 1]
    begin, n, follows = begin[repeated], (end - begin)[repeated], np.where(low == high, low, 0)[repeated]
    edge, doc, place = edge[begin], doc[begin], place[begin]
    if not len(edge):
        return pa.table([pa.array([], pa.int64())] * 6, names=[f.split()[0] for f in _SEGMENTS.split(", ")])
    at = np.minimum(np.searchsorted(edge, follows), len(edge) - 1)
    chained = np.zeros(len(edge), bool)
    chained[at[(follows != 0) & (edge[at] == follows) & (n[at] == n)]] = True
    order = np.lexsort((place, doc))  # a chained edge comes right after the one before it
    first = np.flatnonzero(~chained[order])
    last = np.append(first[1:], len(order)) - 1
    follows = follows[order[last]]
    own = [edge[order[first]], n[order[first]], follows, doc[order[first]], place[order[first]], last - first + 1]
    columns = [pa.array(x) for x in own]
    columns[2] = pa.array(follows, mask=follows == 0)
    return pa.table(columns, names=[f.split()[0] for f in _SEGMENTS.split(", ")])


def repeated_edges(runs: DataFrame) -> DataFrame:
    """The same of any number of places, as segments of one edge: windows that several ids hold.

    Equal runs are counted together first, so that a passage of many copies travels once for each way it is cut.
    """
    one = runs.groupBy("run").agg(F.count("*").alias("n"), F.max("doc_id").alias("high"), F.min("next").alias("low"), F.max("next").alias("last"), F.min(F.struct("doc_id", "place", "windows")).alias("first"))
    each = one.select("n", "high", "low", "last", "first.doc_id", "first.place", "first.windows", F.posexplode("first.windows").alias("i", "edge"))
    inner = F.get("windows", F.col("i") + 1)
    each = each.select("edge", "n", "high", "doc_id", (F.col("place") + F.col("i")).alias("place"), F.coalesce(inner, "low").alias("low"), F.coalesce(inner, "last").alias("last"))
    edges = each.groupBy("edge").agg(F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.min(F.struct("doc_id", "place")).alias("first"))
    one_way = (F.col("low") == F.col("last")) & (F.col("low") != 0)
    return edges.where("first.doc_id < high").select("edge", "n", F.when(one_way, F.col("low")).alias("next"), "first.*", F.lit(1).cast("long").alias("edges"))


def paths_of(segments: DataFrame) -> DataFrame:
    """``edge, doc_id, place, edges``: the first edge of every path, its source coordinates and its length.

    ``segments``: their first edge, its places n, the one edge that follows the last at all places or null, the first place.
    """
    before = segments.select(F.col("next").alias("edge"), "n")
    chained = segments.join(before, ["edge", "n"], "left_semi").select("edge", F.lit(True).alias("chained"))
    source = Window.partitionBy("doc_id").orderBy("place")
    numbered = segments.join(chained, "edge", "left").select("edge", "doc_id", "place", "edges", F.count_if(F.col("chained").isNull()).over(source).alias("path"))
    paths = numbered.groupBy("doc_id", "path").agg(F.min(F.struct("place", "edge")).alias("head"), F.sum("edges").alias("edges"))
    return paths.select("head.edge", "doc_id", "head.place", "edges")


def _digests(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Another hash of the words of each span: path, digest."""
    for batch in batches:
        data, offsets = K.utf8_rows(batch.column(0))
        spans = batch.column(1)
        for i, j in K.blocks(offsets):
            w = K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.NON_SPACE, lower=False)
            other = K.mix(w.hashes + K.U64(0xA24BAED4963EE407 + seed))
            # sums of word times an odd number to the power of its place tell orders apart; a span's is a difference of two,
            # brought to the power zero at its begin
            powers, back = (np.concatenate([[K.U64(1)], np.cumprod(np.full(len(other), K.U64(b)))]) for b in (ODD, pow(ODD, -1, 2**64)))
            sums = np.concatenate([[K.U64(0)], np.cumsum(other * powers[:-1], dtype=K.U64)])
            out: tuple[list, list] = ([], [])
            for r in range(i, j):
                own = spans[r].values
                begin = own.field("at").to_numpy().astype(np.int64) + w.first[r - i]
                end = np.minimum(begin + own.field("words").to_numpy(), len(other))
                out[1].append((sums[end] - sums[begin]) * back[begin])
                out[0].append(own.field("path").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1]).view(np.int64))], names=["path", "digest"])


def _spans(rows: DataFrame, window: int, seed: int) -> tuple[DataFrame, list[str], bool]:
    """The repeated spans, the tables they are read from, and whether all are equal to their source."""
    spark = rows.sparkSession
    sent = lambda bits: spark.sparkContext.broadcast(bits.tobytes())
    read = lambda held: np.frombuffer(held.value, np.uint64)
    named = rows.where("doc_id IS NOT NULL")
    stand_ins = named.mapInArrow(lambda b: tidied(_stand_ins(b, window, seed)), "doc_id long, stand_in long")
    twice = stand_ins.groupBy("stand_in").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("stand_in", "n")
    twice, twice_path = materialize(twice, "stand-ins")
    kinds, cold, hot = twice.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("n") <= HOT, F.col("n"))), F.lit(0)), F.count_if(F.col("n") > HOT)).first()
    held = sent(hash_bits(twice, "stand_in", filter_bits(kinds)))
    often = sent(hash_bits(twice.where(F.col("n") > HOT), "stand_in", filter_bits(hot)))
    runs = lambda of_hot: named.mapInArrow(lambda b: tidied(_runs(b, window, seed, read(held), read(often), of_hot)), "run long, stand_in long, next long, doc_id long, place long, windows array<long>")
    # as many buckets as windows need, a stand-in standing for a quarter of the window's length on average
    bucket = F.pmod(F.xxhash64("stand_in"), F.lit(max(1, -(-cold * max(1, window // 4) // BUCKET)))).cast("int")
    segments = runs(False).select(bucket.alias("bucket"), "next", "doc_id", "place", "windows").groupBy("bucket").applyInArrow(_segments, _SEGMENTS)
    if hot:
        segments = segments.unionByName(repeated_edges(runs(True)))
    edges, edges_path = materialize(segments, "edges")
    paths, paths_path = materialize(paths_of(edges).withColumn("path", F.monotonically_increasing_id()), "paths")
    held.unpersist()
    often.unpersist()
    held = sent(hash_bits(paths, "edge", filter_bits(paths.count())))
    places = named.mapInArrow(lambda b: tidied(_places(b, window, seed, read(held))), "edge long, doc_id long, place long")
    of = paths.select("edge", "path", (F.col("edges") + window - 1).cast("int").alias("words"), F.col("doc_id").alias("source_id"), F.col("place").alias("source_place"))
    at = lambda place: F.col(place).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    tag = lambda place: F.col(place) - at(place)
    spans = places.join(of, "edge").select("doc_id", tag("place").alias("tag"), at("place").alias("at"), "words", "path", "source_id", tag("source_place").alias("source_tag"), at("source_place").alias("source_at"))
    spans, spans_path = materialize(spans.distinct(), "spans")
    discard(spark, twice_path, edges_path, paths_path)
    held.unpersist()
    # of each path, every place and the source
    by_text = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("path", "at", "words")).alias("spans"))
    digests = named.join(by_text, ["doc_id", "tag"]).select("text", "spans").mapInArrow(lambda b: tidied(_digests(b, seed)), "path long, digest long")
    other = digests.groupBy("path").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    return spans, [spans_path], other.isEmpty()


def _rows(docs: DataFrame, key: str, text: str, attempt: int, *more) -> DataFrame:
    """``doc_id, text, tag``: a tag tells texts of one id apart, and leaves room for the place of a word in its lower half."""
    tag = F.shiftleft(F.pmod(F.xxhash64(F.lit(attempt), text), F.lit(1 << 31)), 32)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), tag.alias("tag"), *more)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> tuple[DataFrame, int]:
    """Spans of ``window`` words or more that documents of other ids hold, and the attempt that the tags are of.

    ``doc_id, tag, at, words`` (first word from 0, words of the span), ``path``, ``source_id, source_tag, source_at``:
    the document of the smallest id, and its first place, that holds the same words. The source's own place is a span, too.
    Successive spans of one text overlap in ``window - 1`` words.
    """
    small_batches(docs.sparkSession)
    for attempt in range(ATTEMPTS):
        spans, paths, same = _spans(_rows(docs, key, text, attempt), window, attempt)
        if same:
            return spans, attempt
        discard(docs.sparkSession, *paths)
    raise RuntimeError("spans of equal hashes differ under all hash functions")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the spans: their kept words, joined by a space."""
    for batch in batches:
        data, offsets = K.utf8_rows(batch.column(1))
        spans = batch.column(2)
        for i, j in K.blocks(offsets):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            w = K.words(part, bounds, K.NON_SPACE, lower=False)
            delta = np.zeros(len(w.hashes) + 1, np.int64)
            for r in range(i, j):
                if spans[r].is_valid:
                    begin = spans[r].values.field("at").to_numpy().astype(np.int64) + w.first[r - i]
                    np.add.at(delta, begin, 1)
                    np.add.at(delta, begin + spans[r].values.field("words").to_numpy(), -1)
            stays = np.cumsum(delta[:-1]) == 0
            counts = np.diff(np.concatenate([[0], np.cumsum(stays)])[w.first])
            # a kept word takes the byte after it as its space, unless it is the last one kept of its row
            keep = np.flatnonzero(stays)
            rows = K.row_of(w.first)[keep]
            space = np.append(rows[1:] == rows[:-1], False) if len(rows) else np.zeros(0, bool)
            edge = np.zeros(len(part) + 2, np.int8)
            edge[w.starts[keep]] += 1
            edge[w.ends[keep] + space] -= 1
            taken = np.cumsum(edge[: len(part)], dtype=np.int8) > 0
            out = np.where(K.NON_SPACE[part], part, np.uint8(32))[taken]
            ends = np.concatenate([[0], np.cumsum(taken)])[bounds].astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])
            sizes = np.diff(w.first)
            arrays = [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(sizes - counts), text, batch.column(3).slice(i, j - i)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "text", "kept"])


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` and the columns of ``keep``: texts without the windows that a smaller id holds."""
    spans, attempt = repeated_spans(docs, key, text, window)
    lost = spans.where("source_id < doc_id").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "words")).alias("spans"))
    rows = _rows(docs, key, text, attempt, F.struct(F.lit(0).alias("__0"), *keep).alias("kept"))
    joined = rows.join(lost, ["doc_id", "tag"], "left").select("doc_id", "text", "spans", "kept")
    kept_type = joined.schema["kept"].dataType.simpleString()
    out = joined.mapInArrow(lambda b: tidied(_kept(b)), f"doc_id long, n_words long, n_removed long, text string, kept {kept_type}")
    return out.select("doc_id", "n_words", "n_removed", "text", *(F.col("kept").getField(c).alias(c) for c in keep))
