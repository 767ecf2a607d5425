"""Versioned tables: reads of each version, buckets that stay, deletes, compaction, failed writes."""

import random

from pyspark.sql import functions as F

from storyloom.sources.versions import VersionedTable

SCHEMA = "k string, n int, v string, seq int"


def rows(table, version=None):
    return {(x.k, x.n): x.v for x in table.read(version).collect()}


def test_every_version_reads_as_it_was(spark, tmp_path):
    r, table, now, then = random.Random(3), VersionedTable(spark, f"file://{tmp_path}/t", ["k", "n"], 8), {}, []
    assert table.read() is None and table.versions() == []
    for step in range(4):
        batch = [(r.choice(["a", "b", None]), r.choice([None, *range(9)]), f"{step}.{i}", i) for i in range(12)]
        assert table.upsert(spark.createDataFrame(batch, SCHEMA), "seq") == step
        now = now | {(k, n): v for k, n, v, _ in batch}
        then.append(dict(now))
    assert [rows(table, i) for i in range(4)] == then and rows(table) == now
    gone = sorted(now, key=str)[:3]
    table.delete(spark.createDataFrame(gone, "k string, n int"))
    left = {k: v for k, v in now.items() if k not in gone}
    assert rows(table) == left and rows(table, 3) == now
    assert table.compact(3) == 5 and rows(table) == left and len(table.places()) <= 3 and rows(table, 2) == then[2]
    back = spark.createDataFrame([(*gone[0], "back", 1)], SCHEMA)
    table.upsert(back, "seq")
    assert rows(table) == left | {gone[0]: "back"}
    assert table.upsert(back.limit(0), "seq") == 6 == table.versions()[-1]


def test_a_small_change_rewrites_its_buckets_only(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["id"], 16)
    table.upsert(spark.range(400).withColumn("v", F.lit("old")), "id")
    before = table.places()
    table.upsert(spark.createDataFrame([(5, "new"), (6, "new")], "id long, v string"), "id")
    after = table.places()
    moved = [b for b in after if after[b] != before[b]]
    assert len(before) == 16 and 1 <= len(moved) <= 2
    assert table.read().groupBy("v").count().orderBy("v").collect() == [("new", 2), ("old", 398)]


def test_uncommitted_versions_are_passed_over_and_columns_may_come(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["id"], 4)
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), "id")
    (tmp_path / "t" / "v000001-4-part" / "__bucket=0").mkdir(parents=True)
    assert table.versions() == [0]
    assert table.upsert(spark.createDataFrame([(2, "c", 7)], "id int, v string, w int"), "id") == 2
    got = {x.id: x.asDict() for x in table.read().collect()}
    assert got[2] == {"id": 2, "v": "c", "w": 7} and got[1]["v"] == "a" and got[1].get("w") is None


def test_an_empty_table(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["id"], 4)
    assert table.compact() is None
    table.upsert(spark.createDataFrame([], "id int, v string"), "id")
    assert table.read().count() == 0 and table.read().columns == ["id", "v"]
    table.upsert(spark.createDataFrame([(1, "a"), (None, None)], "id int, v string"), "v")
    assert {(x.id, x.v) for x in table.read().collect()} == {(1, "a"), (None, None)}
    assert table.replace(spark.createDataFrame([(3, "c")], "id int, v string"), "v") == 2
    assert [tuple(x) for x in table.read().collect()] == [(3, "c")] and table.read(1).count() == 2
