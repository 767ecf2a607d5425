"""Reconciliation of a stream of candidates with keyed state: a duplicate sees the item that was added in an earlier batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import text_of

#: What names a candidate's statement (fixed values).
KEY = ("source_type", "item_type", "subject", "statement")
DECIDED = "item_id string, source_type string, item_type string, subject string, statement string, seq long, action string, target_item_id string"


def _decided(key: tuple, rows: pd.DataFrame, first: str, new: pd.Series) -> pd.DataFrame:
    target = [None if n else first for n in new]
    return pd.DataFrame({"item_id": rows["item_id"], **dict(zip(KEY, key)), "seq": rows["seq"], "action": rows["action"].where(new, "NONE"), "target_item_id": target})


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first candidate of a statement is decided by its kind, and its id is kept; later ones are NONE.

    Rows of a statement that is known pass through; those of a new one (ids and flags) wait for the end of the micro-batch,
    as any of them may be the least.
    """
    if state.exists:
        for rows in batches:
            yield _decided(key, rows, state.get[0], pd.Series(False, index=rows.index))
        return
    held = list(batches)
    seq, item, place, at, known = min((q, i, n, j, k) for n, rows in enumerate(held) for j, (q, i, k) in enumerate(zip(rows["seq"], rows["item_id"], rows["known"].fillna(""))))
    first = known or item
    state.update((first,))
    for n, rows in enumerate(held):
        new = pd.Series(not known and n == place, index=rows.index) & (pd.RangeIndex(len(rows)) == at)
        yield _decided(key, rows, first, new)


def reconcile_stream(candidates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Candidates (``item_id, seq``, the columns of ``KEY``, ``entity_ids, promote_to``) with ``action`` and ``target_item_id``, as
    ``operators.context.reconcile`` gives them where candidates come in the order of ``seq``.

    A micro-batch decides a statement once, by its candidate of least ``seq``; what it brings of one new statement is held by one
    task, so bound the micro-batches (``maxFilesPerTrigger`` and the like). ``item_id`` and ``seq`` are not null. The state holds one id a statement, as long as the
    stream lives, as the table of items does. ``existing``: items from before the stream, read anew by each batch. Nulls in
    the key count as empty texts.
    """
    talk = F.col("source_type") == "conversation"
    kind = (
        F.when(talk & (F.col("item_type") == "correction") & (F.size("entity_ids") > 0), "PATCH")
        .when(talk & (F.col("item_type") == "creative_decision") & F.col("promote_to").isNotNull(), "PROMOTE")
        .otherwise("ADD")
    )
    rows = candidates.select("item_id", F.col("seq").cast("long").alias("seq"), kind.alias("action"), *[text_of(k).alias(k) for k in KEY])
    if existing is None:
        rows = rows.withColumn("known", F.lit(None).cast("string"))
    else:
        have = existing.where(F.col("status").isin("active", "canonical", "tentative")).select(*[text_of(k).alias(k) for k in KEY], "item_id")
        rows = rows.join(have.groupBy(*KEY).agg(F.min("item_id").alias("known")), list(KEY), "left")
    return rows.groupBy(*KEY).applyInPandasWithState(_decide, DECIDED, "first string", "append", GroupStateTimeout.NoTimeout)
