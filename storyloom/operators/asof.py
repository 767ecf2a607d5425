"""As-of joins: the state of many keys at many bounds, from one log, in one pass over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key up to which it stays in one window.
HOT_ROWS = 1_000_000
#: Pieces that a key with more rows is cut into.
PIECES = 128


def _hot(keys: DataFrame, by: Sequence[str], most: int) -> DataFrame | None:
    """Keys that are cut: of those beyond ``most`` rows the most frequent, four for each shuffle partition.

    Any key with more than a quarter of a partition's mean share is among them, so what stays whole fits a task, and the
    list stays bounded whatever the log holds.
    """
    room = 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = keys.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    found = counts.orderBy(F.col("__n").desc()).limit(room).select(*by).collect()  # a bounded list of keys
    return keys.sparkSession.createDataFrame(found, keys.select(*by).schema) if found else None


def state_as_of(log: DataFrame, asks: DataFrame, by: Sequence[str], order: str, bound: str, values: Sequence[str], ties: Sequence[Column] = (), strict: bool = False, most: int = HOT_ROWS) -> DataFrame:
    """``by, bound, values`` for every different pair of key and bound in ``asks``: the values of the key's last row in ``log`` at or
    before the bound (``strict``: before it).

    Log and asks are one union, sorted by key and order, in which the last row is carried on: one shuffle whatever the
    number of bounds is, and no pair of a row and a bound. A key with more than ``most`` rows is cut at percentiles of its
    order, and each piece starts with what the pieces before it ended with; its rows of equal order are reduced to the
    last one first, so that a tie of any size is no one task's.

    Of rows of equal order the last by ``ties`` counts, then by a hash of the values. A null in the key or the order of a row takes part in no state; a pair
    with a null, or with no row before it, has null values. ``order`` and ``bound`` are numbers, dates or timestamps of
    comparable types. Other columns of either table are ignored.
    """
    if clash := {bound, *by} & set(values):
        raise ValueError(f"values are named as keys or bounds: {sorted(clash)}")
    state = F.struct(*[F.col(v) for v in values]) if values else F.struct(F.lit(True).alias("__any"))
    last = F.struct(*ties, F.xxhash64(state)).alias("__tie")
    known = log.where(F.col(order).isNotNull()).dropna(subset=list(by)).select(*by, F.col(order).alias("__o"), state.alias("__s"), last)
    wanted = asks.select(*by, F.col(bound).alias("__o")).distinct()
    whole = wanted.dropna()
    hot = _hot(known.select(*by).unionByName(whole.select(*by)), by, most)
    pieces = known.withColumn("__piece", F.lit(0))
    asked = whole.withColumn("__piece", F.lit(0))
    carried = None
    if hot is not None:
        cuts = known.select(*by, "__o").unionByName(whole.select(*by, "__o")).join(F.broadcast(hot), list(by))
        cuts = F.broadcast(cuts.groupBy(*by).agg(F.percentile_approx("__o", [i / PIECES for i in range(1, PIECES)]).alias("__cuts")))  # a row for each of the bounded list
        piece = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__o"))), F.lit(0))
        placed = lambda df: df.join(cuts, list(by), "left").withColumn("__piece", F.when(F.col("__cuts").isNull(), 0).otherwise(piece)).drop("__cuts")
        cut = known.join(F.broadcast(hot), list(by), "left_semi").groupBy(*by, "__o").agg(F.max_by("__s", "__tie").alias("__s"), F.max("__tie").alias("__tie"))
        cut = placed(cut)
        pieces = known.join(F.broadcast(hot), list(by), "left_anti").withColumn("__piece", F.lit(0)).unionByName(cut)
        asked = placed(whole)
        ends = cut.groupBy(*by, "__piece").agg(F.max_by("__s", F.struct("__o", "__tie")).alias("__s"))
        starts = cuts.select(*by, F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("__piece")).join(ends, [*by, "__piece"], "left")
        before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)  # PIECES rows a key
        carried = starts.select(*by, F.lit(None).cast(known.schema["__o"].dataType).alias("__o"), F.last("__s", ignorenulls=True).over(before).alias("__s"), "__piece").where("__s IS NOT NULL")
    kind = F.lit(1 if strict else 3)
    rows = pieces.withColumn("__side", F.lit(2)).unionByName(asked.withColumn("__side", kind), allowMissingColumns=True)
    if carried is not None:
        rows = rows.unionByName(carried.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*by, "__piece").orderBy(F.col("__o").asc_nulls_first(), "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__s", F.last("__s", ignorenulls=True).over(upto)).where(F.col("__side") == kind)
    nulls = wanted.where(F.col("__o").isNull() | F.greatest(*[F.col(k).isNull() for k in by], F.lit(False)))
    out = found.select(*by, "__o", "__s").unionByName(nulls, allowMissingColumns=True)
    return out.select(*by, F.col("__o").alias(bound), *[F.col("__s").getField(v).alias(v) for v in values])
