"""Links between documents and their connected components, without collecting either."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import discard, materialize, tidied

#: Bits of a filter of wanted ids, at least and at most (16 MB); false hits go in an exact join, so the bound costs time, never rows.
FILTER_BITS, MOST_BITS = 1 << 23, 1 << 27


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """``node, component`` (the smallest node reachable) for every node of ``links`` (a, b), and the written table's path.

    Large-star and small-star steps by turns, each as an aggregate and a join, until no edge changes.
    """
    spark = links.sparkSession
    edges, path = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        nxt, new = materialize(small.where("a <> b").distinct(), "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, path)
        edges, path = nxt, new
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), path


def id_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set of ``bits`` bits with one bit of each id set, made by an aggregate of at most bits / 64 rows."""
    bit = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    rows = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) AS int)))").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def filter_bits(ids: int, most: int = MOST_BITS) -> int:
    """Bits of a filter for so many ids: sixteen an id, a power of two from ``FILTER_BITS`` to ``most``."""
    return min(most, max(FILTER_BITS, 1 << (16 * max(ids, 1) - 1).bit_length()))


def _kept(bits: np.ndarray, at: pa.Array) -> pa.Array:
    """Which rows' bits are set."""
    places = at.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(((bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))


def wanted(df: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter: a first sieve before an exact semi join."""
    held = df.sparkSession.sparkContext.broadcast(bits.tobytes())

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            keep = _kept(words, batch.column(0))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[1:]], names=batch.schema.names[1:])

    rows = df.select(F.pmod(F.xxhash64(F.col(key)), F.lit(64 * len(bits))).alias("__bit"), *df.columns)
    return rows.mapInArrow(lambda b: tidied(sieve(b)), df.schema)


def hash_bits(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit set of ``bits`` bits (a power of two) with the bit of each hash's leading bits set; see ``held_in``."""
    bit = F.shiftrightunsigned(F.col(column), 64 - (bits.bit_length() - 1))
    rows = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) AS int)))").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def held_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set that ``hash_bits`` made."""
    top = (hashes >> np.uint64(64 - (64 * len(bits)).bit_length() + 1)).astype(np.int64)
    return ((bits[top >> 6] >> (top & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int) -> DataFrame:
    """The equi-join on ``key`` of a written table with a smaller one, no task of which gets much more than its share.

    Keys with more than an even share of the ``rows`` of ``left`` (there are fewer such keys than partitions) are dealt to
    as many salts as they hold shares, by the hash of ``by``, and the rows of ``right`` with these keys are copied as often.
    """
    share = max(1, rows // int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > share).select(key, F.ceil(F.col("__n") / share).cast("int").alias("__copies"))
    hot = F.broadcast(hot)  # fewer rows than shuffle partitions
    copies = F.coalesce("__copies", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), copies).cast("int")).drop("__copies")
    copied = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return dealt.join(copied, [key, "__salt"]).drop("__salt")


def shingle_sets(rows: DataFrame, k: int, kept: np.ndarray, bits: np.ndarray) -> DataFrame:
    """``doc_id, shingles``: the sorted set of distinct shingle hashes of each text whose id may be in the filter."""
    held = rows.sparkSession.sparkContext.broadcast(bits.tobytes())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            keep = _kept(words, batch.column(0))
            ids, texts = batch.column(1).filter(keep), batch.column(2).filter(keep)
            data, offsets = K.utf8_rows(texts)
            for i, j in K.blocks(offsets):
                h, at = K.shingle_rows(K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], kept), k)
                own = [np.unique(h[s:e]).view(np.int64) for s, e in zip(at[:-1], at[1:])]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], names=["doc_id", "shingles"])

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(64 * len(bits))).alias("__bit")
    return rows.select(bit, "doc_id", "text").mapInArrow(lambda b: tidied(sets(b)), "doc_id long, shingles array<long>")


def verified(rows: DataFrame, pairs: DataFrame, k: int, percent: int, kept: np.ndarray) -> tuple[DataFrame, list[str]]:
    """Pairs (a, b) whose whole shingle sets have a Jaccard similarity of at least ``percent`` hundredths.

    Only texts that a pair names are hashed again and shipped: to the pair's first document, then to its second.
    """
    spark = rows.sparkSession
    pairs, pairs_path = materialize(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets, sets_path = materialize(shingle_sets(rows, k, kept, id_filter(nodes, "doc_id")).join(nodes, "doc_id", "left_semi"), "sets")
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    linked = pairs.join(one, "a").join(two, "b").where(F.lit(100) * both >= F.lit(percent) * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()
    links, links_path = materialize(linked, "links")
    discard(spark, sets_path, pairs_path)
    return links, [links_path]


def linked_components(rows: DataFrame, buckets: DataFrame, compatible, accept, k: int, percent: int, kept: np.ndarray) -> tuple[DataFrame, list[str]]:
    """Components of the links among documents that share a bucket.

    ``buckets``: bucket, node, rank, n. First every document is held against the leader of its bucket (least rank, then
    least node), which joins most copies in as many pairs as rows. Then only buckets that still hold several components
    are looked at again: members outside a bucket's largest component are held against all members of others, so that
    no link between two components is lost. ``compatible(l, r)`` is a condition on two bucket rows that every link
    meets; ``accept(pairs)`` intersects further filters.
    """
    lead = buckets.groupBy("bucket").agg(F.min(F.struct("rank", "node", "n")).alias("l"), F.count("*").alias("size")).where("size > 1")
    # written, as the tallies below, so that joins with them shuffle both sides and Spark can split a frequent bucket
    lead, lead_path = materialize(lead.select("bucket", F.col("l.rank").alias("rank"), F.col("l.node").alias("node"), F.col("l.n").alias("n"), "size"), "leaders")
    shared, shared_path = materialize(buckets.join(lead.select("bucket"), "bucket", "left_semi"), "buckets")
    l, r = shared.alias("l"), lead.alias("r")
    first = l.join(r, "bucket").where("l.node <> r.node").where(compatible("l", "r"))
    first = first.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    links, used = verified(rows, accept(first), k, percent, kept)
    labels, path = components(links)
    owned = shared.join(labels, "node", "left").select("bucket", "node", "rank", "n", F.coalesce("component", "node").alias("comp"))
    owned, owned_path = materialize(owned, "owned")
    tally = owned.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("bucket", F.col("m.comp").alias("main"))
    tally, tally_path = materialize(tally, "tally")
    mixed, mixed_path = materialize(owned.join(tally, "bucket"), "mixed")
    l, r = mixed.where("comp <> main").alias("l"), mixed.alias("r")
    cross = l.join(r, "bucket").where("l.comp <> r.comp").where(compatible("l", "r"))
    cross = cross.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    more, used2 = verified(rows, accept(cross), k, percent, kept)
    discard(rows.sparkSession, path)
    labels, path = components(links.unionByName(more))
    discard(rows.sparkSession, lead_path, tally_path, shared_path, owned_path, mixed_path, *used, *used2)
    return labels, [path]
