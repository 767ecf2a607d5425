"""Scores and counts of evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of
from .ranking import last_wins

STATUS_SCORE = {"satisfied": 1.0, "partially_satisfied": 0.5, "not_satisfied": 0.0}


def requirement_status(value: Column | str) -> Column:
    """A judgment's status; free text is read for part, no and yes, and anything else is not satisfied."""
    v = F.lower(F.trim(text_of(value)))
    return (
        F.when(v.isin(*STATUS_SCORE), v)
        .when(F.contains(v, F.lit("part")), "partially_satisfied")
        .when(F.contains(v, F.lit("no")) | F.contains(v, F.lit("unsatisfied")), "not_satisfied")
        .when(F.contains(v, F.lit("satisf")) | F.contains(v, F.lit("yes")), "satisfied")
        .otherwise("not_satisfied")
    )


def judged(requirements: DataFrame, judgments: DataFrame, key: str = "requirement_id", seq: str = "seq") -> DataFrame:
    """Every requirement with its last judgment: status and score; without one it is not satisfied."""
    last = last_wins(judgments, [key], seq).select(key, requirement_status("status").alias("status"))
    scores = F.create_map(*[F.lit(x) for kv in STATUS_SCORE.items() for x in kv])
    rows = requirements.join(last, key, "left").withColumn("status", F.coalesce("status", F.lit("not_satisfied")))
    return rows.withColumn("score", F.element_at(scores, F.col("status")))


def weighted_mean(rows: DataFrame, by: Sequence[str], score: str = "score", importance: str = "importance") -> DataFrame:
    """Mean score by group; core requirements weigh 1.5, others 1."""
    w = F.when(F.col(importance) == "core", 1.5).otherwise(1.0)
    return rows.groupBy(*by).agg(F.round(F.sum(w * F.col(score)) / F.sum(w), 4).alias("score"))


def coerced(value: Column | str, default: float, scale: float = 5.0) -> Column:
    """A raw score within 1 and ``scale``; ``default`` for what is no number."""
    v = text_of(value).try_cast("double")
    return F.when(v.isNull(), F.lit(default)).otherwise(F.round(F.greatest(F.lit(1.0), F.least(v, F.lit(scale))), 4))


def deltas(scores: DataFrame, by: Sequence[str], side: str = "candidate", score: str = "score") -> DataFrame:
    """Generated less reference, for groups that have both."""
    value = lambda name: F.avg(F.when(F.col(side) == name, F.col(score)))
    return scores.groupBy(*by).agg(F.round(value("generated"), 4).alias("generated"), F.round(value("reference"), 4).alias("reference")).where("generated IS NOT NULL AND reference IS NOT NULL").withColumn("delta", F.round(F.col("generated") - F.col("reference"), 4))


def counters(df: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """Rows and rows that meet each condition, by group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n`` for several frames."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
