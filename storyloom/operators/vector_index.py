"""An inverted-file index of vectors: cells of a spherical k-means, Parquet partitioned by cell, exact scores of what is read.

The cells are fitted on a bounded sample; every row is indexed. A search reads the cells whose centres are nearest to
its queries, as many as sampled rows need for the recall that is asked for: building searches all rows for these. It may go on,
for each query, to every cell that could still hold a better row, which makes it exact.
Rows and queries meet by cell in blocks of bounded size, so neither side is broadcast and a cell with a third of
all rows, or of all queries, is many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut_lineage, shared_path
from .ranking import top_per

#: Rows that the centres are fitted on (expected; twice as many at most), rounds, rows a cell at the mean, cells and bytes of centres at most.
SAMPLE_ROWS, ROUNDS, CELL_ROWS, MOST_CELLS, CENTRE_BYTES = 65_536, 6, 128, 4096, 32 << 20
#: Rows of a cell, and queries of it, that one block compares.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Rows that the number of cells to read is measured with, and their nearest rows; the recall that a search then has by default.
TRIAL_ROWS, TRIAL_K, RECALL = 256, 10, 0.95
#: What rounding to six places may add to a score, and slack for the bound's own arithmetic.
ROUNDING = 1e-5


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at unit length, and which rows have one: of ``dim`` finite numbers, not all zero. Other rows are zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(fits)).flatten().cast(pa.float64())
    out = np.zeros((len(column), dim))
    out[fits] = flat.to_numpy(zero_copy_only=False).reshape(int(fits.sum()), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((out * out).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    out[~good] = 0.0
    out[good] /= size[good, None]
    return out, good


def _fit(sample: DataFrame, vector: str, cells: int, dim: int, rounds: int) -> np.ndarray:
    """Centres at unit length by rounds of spherical k-means; a cell that loses all rows keeps its centre."""
    first = sample.select(vector).distinct().orderBy(F.xxhash64(vector), vector).limit(cells).toArrow()  # bounded by CENTRE_BYTES
    centres, good = _matrix(first[vector], dim)
    centres = centres[good]
    for _ in range(rounds if len(centres) > 1 else 0):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros_like(now), np.zeros(len(now), dtype=bool)
            for b in batches:
                rows, good = _matrix(b.column(0), dim)
                rows = rows[good]
                if len(rows):
                    cell = (rows @ now.T).argmax(axis=1)
                    np.add.at(total, cell, rows)
                    seen[cell] = True
            own = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(list(total[own]), pa.list_(pa.float64()))], ["cell", "total"])

        parts = sample.select(vector).mapInArrow(sums, "cell int, total array<double>")
        each = parts.select("cell", F.posexplode("total").alias("at", "v")).groupBy("cell", "at").agg(F.sum("v").alias("v"))
        moved = each.toArrow()  # cells by dimensions
        centres = np.array(now)
        new = np.zeros_like(now)
        new[moved["cell"].to_numpy(), moved["at"].to_numpy()] = moved["v"].to_numpy()
        size = np.sqrt((new * new).sum(axis=1))
        full = size > 0
        centres[full] = new[full] / size[full, None]
    return centres


class VectorIndex:
    """An index in a folder: ``cells`` (the rows, with ``__cell`` and ``__slice``) and ``centres`` (a centre, size and least cosine for each cell).

    Rows whose vector is null, empty, of another size than most of the sample, all zero or not finite lie in cell -1 and
    are never found. Repeated rows and keys, null keys and all other columns are kept as they are.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
        self.vector, self.dim, self.places, schema = spark.read.parquet(f"{path}/about").first()
        self.rows = spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{path}/cells")
        self.centres = np.array(meta["centre"].to_pylist(), dtype=float).reshape(-1, max(self.dim, 1))
        self.sizes = meta["n"].to_numpy()
        self.least = meta["least"].to_numpy(zero_copy_only=False)

    @classmethod
    def build(cls, rows: DataFrame, vector: str = "embedding", path: str | None = None, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> VectorIndex:
        """Fit the cells on about ``sample_rows`` rows, put every row in its nearest one, and write all to ``path`` (the session's shared folder by default)."""
        spark = rows.sparkSession
        path = path or shared_path(spark, "vectors")
        n = rows.count()
        hashed = F.pmod(F.xxhash64(vector, F.monotonically_increasing_id()), F.lit(1 << 30))
        sample = cut_lineage(rows.select(vector).where(F.size(vector) > 0).where(hashed < int((1 << 30) * min(1.0, sample_rows / max(n, 1)))).limit(2 * sample_rows).repartition(8))
        common = sample.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        dim = common["dim"] if common else 0
        count = cells or max(1, n // CELL_ROWS)
        count = min(count, MOST_CELLS, max(1, CENTRE_BYTES // (8 * max(dim, 1))))
        centres = _fit(sample.where(F.size(vector) == dim), vector, count, dim, rounds) if dim else np.zeros((0, 1))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, close = np.full(b.num_rows, -1, dtype=np.int32), np.zeros(b.num_rows)
                if len(centres):
                    own, good = _matrix(b.column(b.schema.get_field_index(vector)), dim)
                    score = own @ centres.T
                    cell[good] = score[good].argmax(axis=1)
                    close[good] = score[good].max(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(close)], [*b.schema.names, "__cell", "__close"])

        schema = T.StructType([*rows.schema.fields, T.StructField("__cell", T.IntegerType()), T.StructField("__close", T.DoubleType())])
        placed = rows.mapInArrow(assign, schema)
        raw = f"{path}/placed"
        placed.write.parquet(raw)
        placed = spark.read.schema(schema).parquet(raw)
        sizes = placed.groupBy("__cell").agg(F.count("*").alias("__n"), F.min("__close").alias("__least"))  # a row a cell
        slices = F.ceil(F.col("__n") / BLOCK_ROWS).cast("int")
        dealt = placed.join(F.broadcast(sizes.select("__cell", slices.alias("__slices"))), "__cell").withColumn("__slice", F.pmod(F.monotonically_increasing_id(), F.col("__slices")).cast("int"))
        dealt.select(*rows.columns, "__slice", "__cell").repartition("__cell", "__slice").write.partitionBy("__cell").parquet(f"{path}/cells")
        found = {r["__cell"]: (r["__n"], r["__least"]) for r in sizes.collect()}  # MOST_CELLS at most
        table = [(i, [float(v) for v in c], int(found.get(i, (0, 1.0))[0]), float(found.get(i, (0, 1.0))[1])) for i, c in enumerate(centres)]
        spark.createDataFrame(table, "cell int, centre array<double>, n long, least double").coalesce(1).write.parquet(f"{path}/centres")
        about, stored = "vector string, dim int, places array<int>, schema string", T.StructType([*rows.schema.fields, T.StructField("__slice", T.IntegerType()), T.StructField("__cell", T.IntegerType())]).json()
        spark.createDataFrame([(vector, dim, [], stored)], about).coalesce(1).write.parquet(f"{path}/about")
        index = cls(spark, path)
        trial = sample.where(F.size(vector) == dim).limit(TRIAL_ROWS).select(F.monotonically_increasing_id().alias("__query"), F.col(vector).alias("query_vector"))
        spark.createDataFrame([(vector, dim, index._trial(trial), stored)], about).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return cls(spark, path)

    def _trial(self, queries: DataFrame) -> list[int]:
        """For the nearest rows of the given ones, by a search of all cells: how many centres are nearer to the query than that of the row's cell; sorted."""
        own = cut_lineage(queries.withColumn("__apart", F.lit(None).cast("int")))
        rows = self.rows.withColumn("__key", F.xxhash64(self.vector))
        hits = top_per(self._hits(self._visits(own, len(self.centres)), TRIAL_K, "__key", None, None, rows), ["__query"], [F.col("score").desc(), F.col("__key")], TRIAL_K)
        asked, found = own.toArrow(), hits.select("__query", "__cell").toArrow()  # TRIAL_ROWS and TRIAL_K times as many
        if not found.num_rows:
            return []
        score = np.where(self.sizes > 0, _matrix(asked["query_vector"], self.dim)[0] @ self.centres.T, -np.inf)
        place = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1)
        at = {q: i for i, q in enumerate(asked["__query"].to_pylist())}
        return sorted(int(place[at[q], c]) for q, c in zip(found["__query"].to_pylist(), found["__cell"].to_pylist()))

    def probes_for(self, recall: float = RECALL) -> int:
        """The least number of cells that held this share of the sampled rows' nearest rows; one at least."""
        if not self.places:
            return 1
        return self.places[min(len(self.places), max(1, int(np.ceil(recall * len(self.places))))) - 1] + 1

    def _visits(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """``__query, query_vector, apart, __cell``: the nearest ``probes`` cells of each query; without a number, those beyond (``__seen`` cells were read) that may hold a row above ``__kth``."""
        centres, sizes, dim = self.centres, self.sizes, self.dim
        radius = np.arccos(np.clip(self.least, -1.0, 1.0))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, good = _matrix(b.column(b.schema.get_field_index("query_vector")), dim)
                if not len(centres) or not good.any():
                    continue
                score = np.where(sizes > 0, own @ centres.T, -np.inf)
                order = np.argsort(-score, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
                if probes is not None:
                    take = place < probes
                else:
                    angle = np.maximum(0.0, np.arccos(np.clip(score, -1.0, 1.0)) - radius)
                    kth = pc.fill_null(b.column(b.schema.get_field_index("__kth")), -2.0).to_numpy(zero_copy_only=False)
                    seen = b.column(b.schema.get_field_index("__seen")).to_numpy(zero_copy_only=False)
                    take = (place >= seen[:, None]) & (np.cos(angle) + ROUNDING >= kth[:, None])
                row, cell = np.nonzero(take & good[:, None] & (sizes > 0))
                for at in range(0, len(row), BLOCK_ROWS):
                    part = b.take(pa.array(row[at : at + BLOCK_ROWS]))
                    keep = [part.column(part.schema.get_field_index(c)) for c in ("__query", "query_vector", "__apart")]
                    yield pa.RecordBatch.from_arrays([*keep, pa.array(cell[at : at + BLOCK_ROWS], pa.int32())], ["__query", "query_vector", "__apart", "__cell"])

        fields = [queries.schema[c] for c in ("__query", "query_vector", "__apart")]
        return queries.mapInArrow(near, T.StructType([*fields, T.StructField("__cell", T.IntegerType())]))

    def _hits(self, visits: DataFrame, k: int, key: str, where: Column | None, apart: str | None, indexed: DataFrame | None = None) -> DataFrame:
        """``__query, key, score, __cell``: the k best rows of each block of a cell for each query that visits it."""
        asked = visits.groupBy("__cell").agg(F.count("*").alias("__asked"))
        cells = {r["__cell"]: r["__asked"] for r in asked.collect()}  # MOST_CELLS at most
        plan = [(c, int(-(-int(self.sizes[c]) // BLOCK_ROWS)), int(-(-n // BLOCK_QUERIES))) for c, n in cells.items()]
        shape = F.broadcast(self.spark.createDataFrame(plan, "__cell int, __slices int, __parts int"))
        rows = (self.rows if indexed is None else indexed).where(F.col("__cell").isin(list(cells)))  # reads these folders only
        rows = rows if where is None else rows.where(where)
        none = F.lit(None).cast(visits.schema["__apart"].dataType)
        rows = rows.select("__cell", "__slice", key, self.vector, (F.col(apart) if apart else none).alias("__apart"))
        own = rows.join(shape, "__cell").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        asks = visits.join(shape, "__cell").withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.col("__parts")).cast("int")).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)))
        by, dim, vector = ["__cell", "__slice", "__part"], self.dim, self.vector

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.take(pc.sort_indices(left, sort_keys=[(key, "ascending")], null_placement="at_start"))
            a, b = _matrix(left[vector], dim)[0], _matrix(right["query_vector"], dim)[0]
            group = pa.chunked_array([*left["__apart"].chunks, *right["__apart"].chunks], left["__apart"].type).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if apart else None
            queries, at, scores = [], [], []
            for start in range(0, len(b) if len(a) else 0, 128):
                block = np.round(b[start : start + 128] @ a.T, 6)
                if apart:
                    g = group[len(a) + start : len(a) + start + len(block)]
                    block[(g[:, None] == group[None, : len(a)]) & (g[:, None] >= 0)] = -np.inf
                floor = np.partition(block, -k, axis=1)[:, -k] if len(a) > k else np.full(len(block), -np.inf)
                for i, row in enumerate(block):
                    good = np.flatnonzero((row >= floor[i]) & (row > -np.inf))
                    good = good[np.argsort(-row[good], kind="stable")][:k]  # of equal scores the least key, as rows lie by key
                    queries.append(np.full(len(good), start + i))
                    at.append(good)
                    scores.append(row[good])
            flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
            return pa.table({"__query": right["__query"].take(pa.array(flat(queries).astype(np.int64))), key: left[key].take(pa.array(flat(at).astype(np.int64))), "score": pa.array(flat(scores) + 0.0), "__cell": pa.array(np.full(len(flat(at)), left["__cell"][0].as_py() if len(left) else 0, dtype=np.int32))})

        schema = T.StructType([visits.schema["__query"], rows.schema[key], T.StructField("score", T.DoubleType()), T.StructField("__cell", T.IntegerType())])
        return own.select(*by, key, vector, "__apart").groupBy(*by).cogroup(asks.select(*by, "__query", "query_vector", "__apart").groupBy(*by)).applyInArrow(best, schema)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, recall: float = RECALL, where: Column | None = None, apart: str | None = None, key: str = "vec_id", query: str = "query_id") -> DataFrame:
        """``query, key, score``: the k nearest rows of each query (``query``, ``query_vector``) by cosine of six places; of equals the smaller key.

        ``where`` filters the rows first. ``apart`` names a column of both sides: rows that have the query's own value don't
        count (null differs from everything). The ``probes`` nearest cells are read (``probes_for(recall)`` by default); a query with fewer than k hits there
        goes on to all others, so a strict filter costs time and no rows. With ``exact`` every query goes on to the cells
        whose bound (the angle to the centre less the cell's radius) reaches its k-th score: the result is that of
        ``vector_top``. Queries must have distinct ids; those without a usable vector have no rows.
        """
        kind = self.rows.schema[apart].dataType if apart else T.IntegerType()
        probes = probes or self.probes_for(recall)
        own = cut_lineage(queries.select(F.col(query).alias("__query"), "query_vector", (F.col(apart) if apart else F.lit(None)).cast(kind).alias("__apart")))
        first = top_per(self._hits(self._visits(own, probes), k, key, where, apart), ["__query"], [F.col("score").desc(), F.col(key).asc()], k)
        first = cut_lineage(first)
        kth = first.groupBy("__query").agg(F.count("*").alias("__hits"), F.min("score").alias("__low"))
        more = own.join(kth, "__query", "left").withColumn("__kth", F.when(F.col("__hits") >= k, F.col("__low"))).withColumn("__seen", F.lit(probes))
        more = more if exact else more.where("__kth IS NULL")
        rest = self._hits(self._visits(more, None), k, key, where, apart)
        both = first.select("__query", key, "score").unionByName(rest.drop("__cell"))
        return top_per(both, ["__query"], [F.col("score").desc(), F.col(key).asc()], k).select(F.col("__query").alias(query), key, "score")
