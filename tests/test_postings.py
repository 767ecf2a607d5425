"""Common tokens counted at the scan and by a join: the same pairs, whatever the pieces are."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import postings, retrieval


def frames(spark, seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["雪山", "héros"]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randint(0, n)))
    docs = [(i, None if i % 11 == 0 else text(40), r.choice(["a", None]), f"{i}") for i in range(60)] + [(7, "w1 w1 w2", "a", "x"), (7, "w1 w1 w2", "a", "x"), (None, "w3", None, None)]
    asked = [(i, text(12)) for i in range(15)] + [(99, ""), (98, None)]
    return spark.createDataFrame(docs, "doc_id int, text string, lang string, __n2 string"), spark.createDataFrame(asked, "item_id int, query string")


@pytest.mark.parametrize(("rows", "at_once"), [(200_000, None), (200_000, 1), (0, None)])
def test_both_ways_find_the_pairs_of_brute_force(spark, monkeypatch, rows, at_once):
    monkeypatch.setattr(postings, "INDEX_ROWS", rows)
    docs, asked = frames(spark)
    seen = [(x.doc_id, x.lang, set(x.t)) for x in docs.select("doc_id", "lang", retrieval.token_set("text").alias("t")).collect()]
    wants = [(x.item_id, set(x.t)) for x in asked.select("item_id", retrieval.token_set("query").alias("t")).collect()]
    want = Counter((d, lang, i) for d, lang, t in seen for i, q in wants if t & q)
    if at_once:
        monkeypatch.setattr(postings, "AT_ONCE", at_once)
    got = retrieval.lexical(docs, asked, keep=("lang",))
    assert Counter((x.doc_id, x.lang, x.item_id) for x in got.collect()) == want
    scores = {(x.doc_id, x.item_id): x.score for x in got.where(F.col("doc_id") != 7).collect()}
    sizes, queries = {d: t for d, _, t in seen if d != 7}, dict(wants)
    assert all(abs(s - (n + n / len(queries[i]) + n / len(sizes[d]))) < 1e-5 for (d, i), s in scores.items() for n in [len(sizes[d] & queries[i])])


def test_groups_cover_all_rows():
    for costs in ([], [0], [9, 0, 9], [1, 1, 1, 1, 1, 1, 1], [0, 20, 0, 3]):
        pieces = list(postings._groups(np.array(costs, dtype=np.int64), 5))
        assert [i for low, high in pieces for i in range(low, high)] == list(range(len(costs)))


def test_an_index_too_large_does_not_travel(spark, monkeypatch):
    index = spark.createDataFrame([(1, 1, "abcdef"), (2, 1, "g")], "__id long, __nq long, __t string")
    assert postings.fits(index) and postings.fits(index.limit(0))
    monkeypatch.setattr(postings, "INDEX_BYTES", 6)
    assert not postings.fits(index)
