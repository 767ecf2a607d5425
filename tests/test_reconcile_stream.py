"""The stream's decisions equal the batch's, over several micro-batches and a restart from the checkpoint."""

import random

from pyspark.sql import functions as F

from storyloom.operators.context import reconcile
from storyloom.streaming.reconciling import reconcile_stream

SCHEMA = "item_id string, seq long, source_type string, item_type string, subject string, statement string, entity_ids array<string>, promote_to string, status string"


def candidates(seed, n, first):
    r = random.Random(seed)
    return [(f"i{first + i:04d}", first + i, r.choice(["conversation", "external"]), r.choice(["correction", "creative_decision", "fact"]), r.choice(["s", None, ""]), r.choice("abc"), r.choice([[], ["e"]]), r.choice([None, "bible"]), "active") for i in range(n)]


def test_later_batches_see_earlier_ones(spark, tmp_path):
    known = candidates(1, 5, 0)
    batches = [candidates(2, 20, 100), candidates(3, 20, 200), candidates(4, 20, 300)]
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    existing = spark.createDataFrame(known, SCHEMA)
    for rows in batches:  # each round starts the query anew from its checkpoint
        random.Random(len(rows)).shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = reconcile_stream(spark.readStream.schema(SCHEMA).parquet(source), existing)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = {(x.item_id, x.action, x.target_item_id) for x in spark.read.parquet(out).collect()}
    every = spark.createDataFrame([x for rows in batches for x in rows], SCHEMA)
    want = {(x.item_id, x.action, x.target_item_id) for x in reconcile(every, existing).select("item_id", "action", "target_item_id").collect()}
    assert got == want and len(want) == 60 and {a for _, a, _ in want} >= {"NONE", "ADD"}


def test_without_existing_items(spark, tmp_path):
    spark.createDataFrame(candidates(5, 12, 0) + candidates(5, 12, 0), SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = reconcile_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == 24 and rows.where("action <> 'NONE'").select(F.concat_ws("|", "source_type", "item_type", "subject", "statement")).distinct().count() == rows.where("action <> 'NONE'").count()
