"""As-of joins against brute force: ties, nulls, hot keys, empty tables, other columns."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators.asof import state_as_of

LOG = "k string, o int, seq int, v string, bound string"
ASKS = "k string, bound int, v string"


def brute(log, asks, strict):
    out = set()
    for k, b in {(a[0], a[1]) for a in asks}:
        rows = [r for r in log if k is not None and b is not None and r[0] == k and r[1] is not None and (r[1] < b if strict else r[1] <= b)]
        best = max(rows, key=lambda r: (r[1], r[2])) if rows else None
        out.add((k, b, best and best[2], best and best[3]))
    return out


def tables(seed, n):
    r = random.Random(seed)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", "c", None])
    log = [(key(), r.choice([None, 7, *range(60)]), i, r.choice(["x", "y", None]), "other") for i in range(n)]
    asks = [(r.choice(["hot", "hot", "a", "b", "none", None]), r.choice([None, -5, *range(70)]), "other") for _ in range(n // 2)]
    return log, asks


@pytest.mark.parametrize("most", [1_000_000, 20])
@pytest.mark.parametrize("strict", [False, True])
def test_states_are_those_of_brute_force(spark, most, strict):
    log, asks = tables(most, 400)
    got = state_as_of(spark.createDataFrame(log, LOG), spark.createDataFrame(asks, ASKS), ["k"], "o", "bound", ["seq", "v"], [F.col("seq")], strict, most)
    rows = [tuple(x) for x in got.collect()]
    assert got.columns == ["k", "bound", "seq", "v"]
    assert len(rows) == len(set(rows)) and set(rows) == brute(log, asks, strict)


def test_a_tie_of_a_hot_key_is_one_state(spark):
    log = [("h", 3, i, f"v{i}", "") for i in range(300)] + [("h", 9, 1, "end", "")]
    asks = [("h", b, "") for b in (2, 3, 3, 8, 9, 50)]
    got = state_as_of(spark.createDataFrame(log, LOG), spark.createDataFrame(asks, ASKS), ["k"], "o", "bound", ["v"], [F.col("seq")], most=10).collect()
    assert sorted((x.bound, x.v or "") for x in got) == [(2, ""), (3, "v299"), (8, "v299"), (9, "end"), (50, "end")]


def test_empty_tables_and_names(spark):
    log, asks = spark.createDataFrame([], LOG), spark.createDataFrame([("a", 1, "")], ASKS)
    assert [tuple(x) for x in state_as_of(log, asks, ["k"], "o", "bound", ["seq"]).collect()] == [("a", 1, None)]
    assert state_as_of(log, asks.limit(0), ["k"], "o", "bound", ["seq"]).count() == 0
    with pytest.raises(ValueError):
        state_as_of(log, asks, ["k"], "o", "bound", ["bound"])


def test_the_log_is_shuffled_once_and_no_pairs_are_made(spark):
    log, asks = tables(1, 50)
    got = state_as_of(spark.createDataFrame(log, LOG), spark.createDataFrame(asks, ASKS), ["k"], "o", "bound", ["seq"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning") <= 3  # the window's, and those of the different asks, with and without nulls
