"""Common tokens of rows and stated queries, counted where a row is read: no pair of row and query is shuffled to be counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..sources.scratch import small_batches

#: Rows and bytes of tokens of an inverted index that every task may hold.
INDEX_ROWS, INDEX_BYTES = 200_000, 16 << 20
#: Postings that are expanded at a time; one row has ``INDEX_ROWS`` at most.
AT_ONCE = 250_000


@dataclass(frozen=True)
class Best:
    """The first ``k`` rows of each query and of each value of ``by``, by falling score, then by ``key``; keys must be unique if equal ones count once.

    ``score`` of common tokens, a query's tokens, a row's tokens and a batch's column by name is the score before it is rounded to ``digits``.
    """

    k: int
    by: tuple[str, ...]
    key: str
    score: Callable[[np.ndarray, np.ndarray, np.ndarray, Callable[[str], np.ndarray]], np.ndarray]
    digits: int


@dataclass(frozen=True)
class Below:
    """A row is visible to a query if the row's ``column`` is less than the query's bound; ``bounds``: ``__id, __bound``."""

    column: str
    bounds: DataFrame


def may_be_best(best: Best, group: np.ndarray, score: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the rows that may be among the first of their group: no k rows are before them whatever the rounding.

    Before a row are those whose score is greater by more than the rounding, and those of the very same score and a lesser key.
    """
    order = np.lexsort((key, -score, group))
    g, s = group[order], score[order]
    at = np.arange(len(order))
    turn = np.concatenate(([True], g[1:] != g[:-1]))[: len(order)]
    start = lambda new: np.maximum.accumulate(np.where(new, at, 0))
    gap = np.concatenate(([0.0], s[:-1] - s[1:]))[: len(order)]
    sure = start(turn | (gap > 10.0**-best.digits)) - start(turn)
    return np.sort(order[sure + at - start(turn | (gap != 0)) < best.k])


def fits(index: DataFrame) -> bool:
    """Whether an index (``__id, __nq, __t``) may go to every task: rows and bytes are checked, reading no more rows than may go."""
    n, size = index.limit(INDEX_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__t")), F.lit(0))).first()
    return n <= INDEX_ROWS and size <= INDEX_BYTES


def _groups(costs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` postings each."""
    place, n = np.cumsum(costs) // most, len(costs)
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), n]
    yield from zip(cuts, cuts[1:])


def _true(mask: pa.Array) -> np.ndarray:
    return pc.fill_null(mask, False).to_numpy(zero_copy_only=False).astype(bool)


def count_common(rows: DataFrame, index: DataFrame, keep: Sequence[str], best: Best | None = None, below: Below | None = None) -> DataFrame:
    """``keep, __nd, __id, __nq, __n`` for rows with distinct tokens ``__d``: how many each shares with every query of ``index``, if any.

    A batch's tokens are looked up at once, their posting lists are laid end to end and counted by row and query. With ``best``
    only pairs leave that may be among the best of all rows. With ``below`` only rows that a query may see count for it.
    """
    spark, most = rows.sparkSession, AT_ONCE
    small_batches(spark)
    known = index.groupBy("__t").agg(F.collect_list(F.struct("__id", "__nq")).alias("__p")).orderBy("__t").collect()  # behind fits()
    lists = [[(p["__id"], p["__nq"]) for p in r["__p"]] for r in known]
    ids = sorted({p for one in lists for p in one})
    number = {p: i for i, p in enumerate(ids)}
    tokens = [r["__t"] for r in known]
    starts = np.concatenate(([0], np.cumsum([len(one) for one in lists], dtype=np.int64)))
    postings = np.array([number[p] for one in lists for p in one], dtype=np.int64)
    bound = dict(map(tuple, below.bounds.collect())) if below else {}  # a query's id tells its bound; behind fits(), but for queries without tokens
    bounds = [bound.get(i) for i, _ in ids]
    column, last = below.column if below else None, max((x for x in bounds if x is not None), default=None)
    shared = spark.sparkContext.broadcast((tokens, starts, postings, np.array(ids, dtype=np.int64).reshape(-1, 2), bounds))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, starts, postings, queries, bounds = shared.value
        bounds = pa.array(bounds)
        vocabulary = pa.array(tokens, pa.string())
        for batch in batches:
            codes = {c: pc.rank(batch.column(batch.schema.get_field_index(c)), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) for c in (*best.by, best.key)} if best else {}
            lists = batch.column(batch.schema.get_field_index("__d"))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            places = pc.fill_null(pc.index_in(flat.cast(pa.string()), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = places >= 0
            if column:
                value = batch.column(batch.schema.get_field_index(column))
                known &= np.repeat(_true(pc.less(value, last)) if last is not None else np.zeros(len(sizes), bool), sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)[known]
            places = places[known]
            each = starts[places + 1] - starts[places]
            costs = np.bincount(owner, weights=each, minlength=len(sizes)).astype(np.int64)
            upto = np.searchsorted(owner, np.arange(len(sizes) + 1))
            for low, high in _groups(costs, most):
                part = slice(upto[low], upto[high])
                if (n := int(costs[low:high].sum())) == 0:
                    continue
                first = np.repeat(starts[places[part]] - np.concatenate(([0], np.cumsum(each[part])[:-1])), each[part])
                pairs = np.repeat(owner[part], each[part]) * len(queries) + postings[first + np.arange(n)]
                pairs, common = np.unique(pairs, return_counts=True)
                row, query = pairs // len(queries), pairs % len(queries)
                if column:
                    seen = _true(pc.less(value.take(pa.array(row)), bounds.take(pa.array(query))))
                    row, query, common = row[seen], query[seen], common[seen]
                if best:
                    group = query
                    for c in best.by:
                        group = group * (len(sizes) + 1) + codes[c][row]
                    own = best.score(common.astype(float), queries[query, 1], sizes[row], lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[row])
                    stay = may_be_best(best, group, own, codes[best.key][row])
                    row, query, common = row[stay], query[stay], common[stay]
                kept = [batch.column(i).take(pa.array(row)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes[row]), pa.array(queries[query, 0]), pa.array(queries[query, 1]), pa.array(common.astype(float))], names=[*keep, "__nd", "__id", "__nq", "__n"])

    schema = StructType([*[StructField(k, rows.schema[k].dataType) for k in keep], *[StructField(c, LongType()) for c in ("__nd", "__id", "__nq")], StructField("__n", DoubleType())])
    return rows.select(*keep, "__d").mapInArrow(count, schema)
