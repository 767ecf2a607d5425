"""The vector index against all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import vector_index
from storyloom.operators.retrieval import vector_top
from storyloom.operators.vector_index import VectorIndex


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def vectors(spark):
    """1200 vectors around 12 directions, 400 of them one vector, some without a direction, a repeated key and a null one."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 8))
    rows = [(i, [float(v) for v in middle[i % 12] + 0.3 * rng.normal(size=8)], i % 5, "x") for i in range(800)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], i % 5, "x") for i in range(400)]
    rows += [(5000, None, 1, None), (5001, [], 1, "x"), (5002, [0.0] * 8, 1, "x"), (5003, [1.0, 2.0], 1, "x"), (5004, [float("nan")] * 8, 1, "x"), (5005, [None] * 8, 1, "x"), (7, rows[7][1], 2, "y"), (None, rows[9][1], None, "y")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, extra string").repartition(5)


@pytest.fixture(scope="module")
def index(vectors):
    return VectorIndex.build(vectors, cells=24)


def asked(vectors):
    return vectors.where("vec_id % 20 = 0 AND vec_id < 5000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")


USABLE = "size(embedding) = 8 AND vec_id IS NULL OR vec_id < 5000"


@pytest.mark.parametrize("blocks", [(8192, 1024), (100, 12)])
def test_exact_search_equals_all_rows(vectors, monkeypatch, blocks):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", blocks[1])
    index = VectorIndex.build(vectors, cells=24)
    got = index.search(asked(vectors), 7, probes=2, exact=True)
    want = vector_top(vectors.where(USABLE), asked(vectors).drop("label"), 7).select("query_id", "vec_id", "score")
    assert rows_of(got) == rows_of(want)
    assert got.count() == 7 * asked(vectors).count()


def test_filters_come_first_and_starve_nothing(vectors, index):
    q = asked(vectors).where("query_id < 200")
    got = index.search(q, 9, probes=1, exact=True, apart="label", where=F.col("extra") == "x")
    on = (F.col("label") != F.col("own"))
    want = vector_top(vectors.where(USABLE).where("extra = 'x'"), q.withColumnRenamed("label", "own"), 9, on=on).select("query_id", "vec_id", "score")
    assert rows_of(got) == rows_of(want)
    few = index.search(q, 9, probes=1, where=F.col("extra") == "y")
    assert {r["n"] for r in few.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {2}


def test_recall_and_rows_read(vectors, index):
    q = asked(vectors)
    got, want = set(rows_of(index.search(q, 10, probes=6).select("query_id", "score"))), rows_of(vector_top(vectors.where(USABLE), q.drop("label"), 10).select("query_id", "score"))
    assert sum(r in got for r in want) >= 0.9 * len(want)
    one = q.where("query_id = 20")
    visits = index._visits(one.select(F.col("query_id").alias("__query"), "query_vector", F.lit(None).cast("int").alias("__apart")), 6)
    cells = [r["__cell"] for r in visits.collect()]
    read = index.rows.where(F.col("__cell").isin(cells))
    assert len(cells) == 6 and read.count() < 0.6 * vectors.count()
    assert "PartitionFilters: [__cell" in read._jdf.queryExecution().toString()


def test_recall_on_the_embeddings(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex.build(e, cells=64)
    got = set(rows_of(index.search(q, 10).select("query_id", "vec_id")))
    want = rows_of(vector_top(e, q, 10).select("query_id", "vec_id"))
    assert 0.9 * len(want) <= sum(r in got for r in want)
    assert index.probes_for(0.5) < index.probes_for(0.95) < 64


def test_empty_tables_and_unusable_queries(spark, vectors, index):
    none = VectorIndex.build(vectors.limit(0))
    assert none.search(asked(vectors), 3, exact=True).collect() == []
    assert index.search(asked(vectors).limit(0), 3).collect() == []
    bad = spark.createDataFrame([(1, None), (2, [0.0] * 8), (3, [1.0])], "query_id long, query_vector array<double>")
    assert index.search(bad, 3, exact=True).collect() == []
    dull = VectorIndex.build(vectors.where("vec_id >= 5000"))
    assert dull.search(asked(vectors), 3).collect() == []


def test_every_row_is_indexed(vectors, index):
    assert rows_of(index.rows.groupBy("vec_id").count()) == rows_of(vectors.groupBy("vec_id").count())
    assert {r["vec_id"] for r in index.rows.where("__cell = -1").collect()} == {5000, 5001, 5002, 5003, 5004, 5005}
