"""Line deduplication through sharded minimal perfect hashes.

A line's key is hashed to 128 bits in the JVM. Keys that several documents hold are counted once, dealt to shards of a
bounded size, and each shard becomes a minimal perfect hash with three arrays in slot order: a 64-bit fingerprint, a
count of lines, and the first document. Documents send line hashes, never lines, to the shard they probe; the
fingerprint turns away keys that are not indexed (lines of one document alone). A bit filter of a bounded size keeps most
of those from travelling. Shards with many probes, as of one line in a third of the documents, are copied under salts, so
that no probe has more than about ``PROBES`` lines at once.

Defined results: a null or empty text is one empty line. Rows of equal id are one document. Rows with a null id keep
every line and count for nothing. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import kernels as K
from .graphs import filter_bits, id_filter, wanted
from .store import discard, materialize, small_batches

#: Keys of a shard on average at most; slots a key in the first level; levels before the rest is listed.
SHARD_KEYS, SPREAD, LEVELS = 1 << 16, 2, 20
#: Lines that probe a copy of a shard in one group, some 10 MB of them.
PROBES = 1 << 18
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class PerfectHash:
    """Slots 0 .. n-1 for n distinct 64-bit keys: cascading bit sets of the keys that meet no other in a level."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(at + np.cumsum(bits) - 1)
            at += int(bits.sum())
        self.placed = at

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        levels = []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, SPREAD * len(keys))
            at = PerfectHash._at(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return PerfectHash(levels, np.sort(keys))

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (K.mix(keys ^ K.U64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % K.U64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for every key: its own if the key was built in, any or -1 if not."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = self._at(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.placed + at[hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels), len(self.rest)], np.int64)
        return head.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels) + self.rest.tobytes()

    @staticmethod
    def load(data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        head = np.frombuffer(data, np.int64, n + 2)
        at, levels = 8 * (n + 2), []
        for size in head[1:-1].tolist():
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at))[:size].astype(bool))
            at += width
        return PerfectHash(levels, np.frombuffer(data, K.U64, int(head[-1]), at))


def _combined(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return K.mix(h.view(K.U64)) ^ g.view(K.U64)


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(STRIPPED))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    plain = F.octet_length(line) == F.length(line)  # of ASCII lines, the quick lower() does the same
    return F.when(plain, F.lower(stripped(line))).otherwise(F.translate(stripped(line), UPPER, LOWER))


_SHARD = "shard int, hash binary, fingerprints binary, counts binary, firsts binary, lines long"


def _index(group: pa.Table) -> pa.Table:
    """One shard's hash and arrays."""
    h, g, n, first = (group[c].to_numpy() for c in ("h", "g", "n", "first"))
    keys = _combined(h, g)
    ph = PerfectHash.build(keys)
    order = np.argsort(ph.slots(keys))
    arrays = [g[order].astype(np.int64), np.minimum(n[order], 2**31 - 1).astype(np.int32), first[order].astype(np.int64)]
    blobs = [ph.dump(), *(a.tobytes() for a in arrays)]
    return pa.table([group["shard"].slice(0, 1).cast(pa.int32()), *(pa.array([b], pa.binary()) for b in blobs), pa.array([int(n.sum())], pa.int64())], names=[f.split()[0] for f in _SHARD.split(", ")])


def _probe(lines: pa.Table, shard: pa.Table) -> pa.Table:
    """Lines that their document loses: indexed, and first held by a smaller id."""
    names = ["doc_id", "text_hash", "line_no"]
    if not lines.num_rows or not shard.num_rows:
        return lines.slice(0, 0).select(names).append_column("held", pa.array([], pa.int32()))
    ph = PerfectHash.load(shard["hash"][0].as_py())
    prints, firsts = (np.frombuffer(shard[c][0].as_py(), np.int64) for c in ("fingerprints", "firsts"))
    counts = np.frombuffer(shard["counts"][0].as_py(), np.int32)
    h, g, doc = (lines[c].to_numpy() for c in ("h", "g", "doc_id"))
    slot = ph.slots(_combined(h, g))
    lost = (slot >= 0) & (prints[slot] == g) & (firsts[slot] < doc)
    return lines.select(names).append_column("held", pa.array(counts[slot])).filter(pa.array(lost))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_lines, n_dropped, n_held, text`` and the columns of ``keep``: each text without the lines a smaller id holds.

    ``n_held`` is how many lines of all documents have the dropped lines' keys, by the count arrays.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(F.lit(0).alias("__0"), *keep).alias("kept"))
    line = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    keyed = rows.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), line)
    # lower-casing keeps the length, so short lines go before it
    keyed = keyed.where(F.length(stripped(F.col("line"))) >= min_chars).withColumn("key", line_key(F.col("line")))
    lines = keyed.select("doc_id", "text_hash", "line_no", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))
    counted = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    seen = Observation()
    counted = counted.observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    shared, shared_path = materialize(counted.where("first < last").drop("last"), "shared-lines")
    keys, held = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(2 * parts, -(-keys // SHARD_KEYS))
    shard = F.pmod(F.shiftright("h", 7), F.lit(shards)).cast("int").alias("shard")
    index, _ = materialize(shared.select(shard, "h", "g", "n", "first").groupBy("shard").applyInArrow(_index, _SHARD), "shards")
    bits = filter_bits(keys)
    # lines of one document alone that the filter lets through fall evenly on the shards
    strays = int(-math.expm1(-keys / bits) * (seen.get["lines"] - held)) // shards
    most = min(PROBES, max(256, held // (4 * parts)))
    copies = index.select("shard", F.ceil((F.col("lines") + strays) / most).cast("int").alias("copies"))
    probes = wanted(lines, "h", id_filter(shared, "h", bits)).select("*", shard).join(copies, "shard")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "line_no"), F.col("copies")).cast("int")).drop("copies")
    copied = index.join(copies, "shard").select(F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), *index.columns)
    out = "doc_id long, text_hash long, line_no int, held int"
    lost = probes.groupBy("shard", "salt").cogroup(copied.groupBy("shard", "salt")).applyInArrow(lambda a, b: _probe(a, b), out)
    discard(spark, shared_path)  # the shards stay: the result reads them
    # a document's own line numbers; a repeated row has them twice
    by_doc = lost.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("line_no", "held")).alias("found")).select("doc_id", "text_hash", F.transform("found", lambda l: l["line_no"]).alias("lost"), F.aggregate("found", F.lit(0).cast("long"), lambda n, l: n + l["held"]).alias("held"))
    joined = rows.withColumn("text_hash", F.xxhash64("text")).join(by_doc, ["doc_id", "text_hash"], "left")
    pieces = F.split("text", "\n")
    n = F.size(pieces)
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost"))
    text_left = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("pieces", i)), "\n"))
    dropped = F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost"))
    return joined.withColumn("pieces", pieces).select("doc_id", n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), F.coalesce("held", F.lit(0)).cast("long").alias("n_held"), text_left.alias("text"), *(F.col("kept").getField(c).alias(c) for c in keep))
