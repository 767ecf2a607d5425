"""Keys, ranks and dedupes that the other operators share. Every order is explicit, ties included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage

#: Rows of a caller's list that may be broadcast.
STATED_ROWS = 20_000


def _columns(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def stated(df: DataFrame, most: int = STATED_ROWS) -> DataFrame:
    """A caller's list as the broadcast side of a join, behind a check of its size; a longer one is left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def stated_blocks(df: DataFrame, most: int = STATED_ROWS) -> list[DataFrame]:
    """A caller's list in blocks that may each be broadcast: one for a short list, more for a longer one."""
    n = df.count()
    if n <= most:
        return [F.broadcast(df)]
    parts = -(-2 * n // most)
    rows = cut_lineage(df.withColumn("__block", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")))
    sizes = [r["__block"] for r in rows.groupBy("__block").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()]  # as many as blocks at most
    if sizes:
        raise ValueError("a list of queries repeats rows; make them distinct first")
    return [F.broadcast(rows.where(F.col("__block") == i).drop("__block")) for i in range(parts)]


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums over one global order, without sorting everything in one task.

    Rows are dealt by ranges of the order; sums within a range add to the totals of the ranges before it, of which there
    are as many as partitions. ``order`` must be total (ties by an id). Sums of one are row numbers.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__v{i}": c for i, c in enumerate(sums.values())}
    dealt = cut_lineage(df.withColumns(values).repartitionByRange(parts, *_columns(order)).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range").agg(*(F.sum(v).alias(v) for v in values))
    offsets = totals.select("__range", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values))
    upto = Window.partitionBy("__range").orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.join(F.broadcast(offsets), "__range")  # one row a partition
    return rows.select(*df.columns, *((F.sum(v).over(upto) + F.col(f"{v}_before")).alias(name) for name, v in zip(sums, values)))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Number all rows from 1 in a global order."""
    return running_sums(df, order, {name: F.lit(1)})


def place_in(df: DataFrame, by: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """Number the rows of each group from 1 through one global order, so that a very large group is not one task's."""
    rows = cut_lineage(numbered(df, [by, *order], name))
    skipped = rows.groupBy(by).agg((F.min(name) - 1).alias("__skip"))
    return rows.join(skipped, by).withColumn(name, (F.col(name) - F.col("__skip")).cast("int")).drop("__skip")


def ranked(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number the rows of each group from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*_columns(by)).orderBy(*order)))


def top_per(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts the groups before and after the shuffle."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def suffix_order(value: Column | str) -> tuple[Column, Column]:
    """Sort keys of ids: the number after the last underscore (ids without one last), then the id."""
    v = F.col(value) if isinstance(value, str) else value
    last = F.element_at(F.split(v, "_"), -1)
    return F.when(last.rlike("^[0-9]+$"), last.try_cast("long")).asc_nulls_last(), v.asc()


def first_wins(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """INSERT OR IGNORE: the first row of every key."""
    return top_per(df, by, order, 1, "__rank").drop("__rank")


def last_wins(df: DataFrame, by: Sequence[str | Column], sequence: str | Column) -> DataFrame:
    """INSERT OR REPLACE: the last row of every key."""
    order = F.col(sequence) if isinstance(sequence, str) else sequence
    return first_wins(df, by, [order.desc()])


def best_of(df: DataFrame, by: Sequence[str | Column], score: str, ordinal: str) -> DataFrame:
    """The best-scoring row of every key; of equals, the one that came first."""
    return first_wins(df, by, [F.col(score).desc(), F.col(ordinal).asc()])


def binding_top(df: DataFrame, group: str, score: str, key: str, k: int, limit: int) -> DataFrame:
    """At most k rows per binding group by descending score and key, then at most ``limit`` rows of all."""
    order = [F.col(score).desc(), F.col(key).desc()]
    return top_per(df, [group], order, k, "group_rank").orderBy(*order).limit(limit)


def batches(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: int, name: str = "batch") -> DataFrame:
    """Fixed-size batches within groups, numbered from 0."""
    return ranked(df, by, order, "__n").withColumn(name, F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")


def page(df: DataFrame, order: Sequence[Column], start: int, limit: int) -> DataFrame:
    """Rows from the 1-based ``start`` on, at most ``limit``: a top-k of start + limit rows, not a full sort in one task."""
    return df.orderBy(*order).offset(max(start - 1, 0)).limit(limit)


def in_given_order(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Rows with the given ids, with their place ``position`` in the list."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(v, i) for i, v in enumerate(dict.fromkeys(ids))], f"__id {df.schema[key].dataType.simpleString()}, position int")
    return df.join(F.broadcast(wanted), df[key] == wanted["__id"]).drop("__id")  # the caller's own list


def neighbours(df: DataFrame, by: Sequence[str], order: Sequence[Column], column: str) -> DataFrame:
    """``previous_`` and ``next_`` values of a column within groups."""
    w = Window.partitionBy(*_columns(by)).orderBy(*order)
    return df.withColumn(f"previous_{column}", F.lag(column).over(w)).withColumn(f"next_{column}", F.lead(column).over(w))


def reference_labels(df: DataFrame, key: str, first_use: Sequence[Column], prefix: str, by: Sequence[str] = ()) -> DataFrame:
    """Labels such as M1, M2 in the order of first use; a key that is used again keeps its label."""
    uses = df.groupBy(*by, key).agg(F.min(F.struct(*first_use)).alias("__first"))
    named = uses.withColumn("label", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*by).orderBy("__first")).cast("string"))).drop("__first")
    return df.join(named, [*by, key])


def section_fill(df: DataFrame, by: Sequence[str], section: str, sections: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Rows in the order of their sections until the limit is reached; rows of other sections go."""
    place = F.array_position(F.array(*map(F.lit, sections)), F.col(section))
    return top_per(df.where(F.col(section).isin(*sections)), by, [place.asc(), *order], limit)
