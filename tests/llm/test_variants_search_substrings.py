"""Spelling variants, ranked search and substring deduplication against brute force; and on odd and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import queries as Q
from storyloom.llm import ranked as R
from storyloom.llm import substrings as S
from storyloom.llm import variants as V
from tests.llm.test_operators import LOW, ODD, words
from tests.llm.test_queries import SCHEMAS, rows_of, write


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    fresh = lambda n: " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))
    names = ["".join(r.choices("aeioulmnst", k=r.randint(7, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "Ünïcödé", "straßenname"]

    def damaged(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcé") + w[i + 1 :], w[:i] + r.choice("abz") + w[i:], w, w, w.upper()])

    passages = [fresh(60), fresh(49), fresh(50), fresh(130)]
    out = list(ODD) + [words(r, 60) * 300]
    for i in range(90):
        t = fresh(r.randint(0, 90)) + " " + " ".join(damaged(r.choice(names[: 6 + i % 23])) for _ in range(30))
        if i % 3 == 0:
            p = passages[i % 4].split()
            if i % 9 == 0:
                p[r.randrange(len(p))] = "other"
            t += r.choice([" ", "\n", " \t "]) + r.choice([" ", "\n"]).join(p[r.randint(0, 5) :]) + r.choice(["", " " + fresh(3), " " + passages[1]])
        out += [t] * r.choice([1, 1, 1, 3])
    out.append("ab " * 200)
    out.append("x " + "ab " * 120 + passages[3] + " " + passages[3])
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(out)]
    docs += [docs[20], docs[30], (docs[40][0], out[50], "en", "s", 1), (None, out[25], "en", "s", 1), (None, out[25], "en", "s", 1), (None, None, None, None, None)]
    items = [" ".join(r.choices(out[r.randrange(10, len(out))].split() or ["none"], k=12)) for _ in range(12)] + [out[30], "the river", "", None, "no such words zzz", "of OF of"]
    items = [*enumerate(items), (3, "river stone"), (None, "stone lamp")]
    return write(spark, tmp_path_factory.mktemp("tables"), {"documents": docs, "benchmark": items}), docs, items


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, factor=10):
    """word: n, near words, form, its n, root."""
    out = {}
    for w, n in counts.items():
        others = sorted(((-m, x) for x, m in counts.items() if near(w, x)))
        form = others[0][1] if others and -others[0][0] >= factor * n else None
        out[w] = [n, len(others), form, -others[0][0] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return out


def test_op11(spark, folder):
    path, docs, _ = folder
    counts = Counter()
    for i, t, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    got = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in Q.op11_spelling_variants(spark, path).collect()}
    assert got == want
    assert any(v[2] for v in want.values()) and any(v[1] > 1 for v in want.values())


def test_op11_chains_ties_and_runs_of_a_letter(spark):
    r = random.Random(4)
    counts = {"a" * 7: 3, "a" * 8: 30, "a" * 9: 300, "b" + "a" * 8: 3000, "bc" + "a" * 7: 30000, "bcd" + "a" * 6: 300001, "é" * 7: 2, "é" * 8: 20, "é" * 6 + "z": 20, "elsewhere": 5}
    for _ in range(300):
        counts.setdefault("".join(r.choices("xy", k=r.randint(7, 9))), r.choice([2, 2, 5, 20, 400, 8000]))
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, best string")
    got = {x.word: [x.n, x.n_near, x.form, x.form_n, x.root] for x in V.spelling_variants(df).collect()}
    assert got == variants(counts)
    assert got["é" * 7][2] == "é" * 6 + "z"  # of equal counts the least word
    assert got["a" * 7][4] == "bcd" + "a" * 6


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def ranked(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t, *_ in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c, n in own:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            found += [(-score, i is None, i or 0, i)] if score > 0 else []
        for place, (score, *_, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1):
            out[item, place, i, -score] += 1
    return out


@pytest.mark.parametrize("postings, first", [(1 << 16, 4), (400, 1), (40, 1)])
def test_op12(spark, folder, monkeypatch, postings, first):
    path, docs, items = folder
    monkeypatch.setattr(R, "POSTINGS", postings)
    monkeypatch.setattr(R, "FIRST", first)
    monkeypatch.setattr(R, "LEAF", 2)
    monkeypatch.setattr(R, "QUERIES", 5)
    got = rows_of(Q.op12_ranked_search(spark, path), "item_id", "rank", "doc_id", "score")
    assert got == ranked(docs, items)


def test_op12_index_of_all_terms_visits_few_shards(spark, monkeypatch):
    monkeypatch.setattr(R, "POSTINGS", 300)
    r = random.Random(2)
    topics = [["".join(r.choices("abcdefgh", k=6)) for _ in range(40)] for _ in range(8)]
    docs = [(i, " ".join(r.choices(topics[i * 7919 % 8], k=30) + ["common"])) for i in range(400)]
    items = [(i, " ".join(r.sample(topics[i % 8], 5) + ["common"])) for i in range(16)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = R.ClusteredIndex(df)
    queries = spark.createDataFrame(items, "query long, text string").mapInArrow(R._query_terms, "query long, terms array<long>").select("query", F.explode("terms").alias("term"))
    found, visited = index.search(queries, 10)
    shards = index.shards.where("term IS NULL").count()
    assert rows_of(found, "query", "place", "id", "score") == ranked(docs, items)
    assert index.tree.leaves >= 8 and visited < 0.5 * shards * len(items)


def test_op12_bisection_brings_topics_together():
    r = np.random.default_rng(1)
    topics = [r.choice(R.CELLS, 60, replace=False) for _ in range(4)]
    documents = [np.unique(r.choice(topics[i % 4], 25)) for i in range(200)]
    leaf = R.Bisection.fit(documents, 2).leaf(documents)
    for t in range(4):
        assert Counter(leaf[t::4].tolist()).most_common(1)[0][1] >= 45
    assert np.array_equal(leaf[:7], R.Bisection.fit(documents, 2).leaf(documents[:7]))


def without_windows(docs, size):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in docs]
    first = defaultdict(lambda: math.inf)
    for i, w in split:
        if i is not None:
            for a in range(len(w) - size + 1):
                first[tuple(w[a : a + size])] = min(first[tuple(w[a : a + size])], i)
    out = Counter()
    for i, w in split:
        gone = {b for a in range(len(w) - size + 1) if i is not None and first[tuple(w[a : a + size])] < i for b in range(a, a + size)}
        out[i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)] += 1
    return out


@pytest.mark.parametrize("hot, bucket", [(1 << 12, 1 << 19), (3, 200), (0, 10)])
def test_op13(spark, folder, monkeypatch, hot, bucket):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "BUCKET", bucket)
    path, docs, _ = folder
    want = Counter()
    for (i, n, gone, text), c in without_windows(docs, 50).items():
        want[i, n, gone, hashlib.sha256(text.encode()).hexdigest()] += c
    assert rows_of(Q.op13_substring_dedup(spark, path), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert any(0 < g[2] < g[1] for g in want)


@pytest.mark.parametrize("size", [2, 3, 7])
def test_op13_branching_texts_of_few_words(spark, monkeypatch, size):
    monkeypatch.setattr(S, "HOT", 4 * size)
    monkeypatch.setattr(S, "BUCKET", 20)
    r = random.Random(size)
    docs = [(r.randint(0, 25), " ".join(r.choices("abc", k=r.randint(0, 14)))) for _ in range(60)] + [(3, "a a a a a a a a"), (None, "a b c a b c a"), (2, None)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, path string, tag int")
    got = S.dedup_substrings(df, window=size, keep=("path",))
    assert got.columns == ["doc_id", "n_words", "n_removed", "text", "path"]
    assert rows_of(got, "doc_id", "n_words", "n_removed", "text") == without_windows(docs, size)


def test_op13_spans_name_equal_words_and_colliding_hashes_are_noticed(spark, folder):
    path, docs, _ = folder
    df = spark.read.parquet(f"{path}/documents.parquet").where("doc_id IS NOT NULL")
    texts = defaultdict(list)
    for i, t, *_ in docs:
        texts[i].append((t or "").split())
    spans, _ = S.repeated_spans(df)
    rows = spans.collect()
    for s in rows:
        at = lambda own, a: {tuple(w[a : a + s.words]) for w in own if len(w) >= a + s.words}
        assert at(texts[s.doc_id], s.at) & at(texts[s.source_id], s.source_at) and s.source_id <= s.doc_id
    assert max(s.words for s in rows) > 100  # paths, not windows
    one = spark.createDataFrame([("a b c", [(1, 0, 2)]), ("x a b", [(1, 1, 2)]), ("b a", [(2, 0, 2)]), ("a b", [(2, 0, 2)])], "text string, spans array<struct<path: long, at: int, words: int>>")
    found = defaultdict(set)
    for r in one.mapInArrow(lambda b: S._digests(b, 0), "path long, digest long").collect():
        found[r.path].add(r.digest)
    assert len(found[1]) == 1 and len(found[2]) == 2


def test_run_hashes_and_sliding_least():
    r = np.random.default_rng(3)
    own = r.integers(0, 5, 300).astype(np.uint64)
    for size in (1, 2, 3, 25, 50, 64):
        h = S.run_hashes(own, size)
        same = defaultdict(set)
        for i, x in enumerate(h.tolist()):
            same[x].add(tuple(own[i : i + size].tolist()))
        assert len(h) == 301 - size and all(len(s) == 1 for s in same.values())
        assert S.sliding_least(own, size).tolist() == [int(own[i : i + size].min()) for i in range(301 - size)]
    assert len(S.run_hashes(own[:3], 50)) == 0


def test_empty_tables(spark, tmp_path):
    path = write(spark, tmp_path / "empty", {})
    for name in ("op11_spelling_variants", "op12_ranked_search", "op13_substring_dedup"):
        assert Q.queries()[name](spark, path).collect() == [], name
    docs = spark.createDataFrame([(1, None), (2, ""), (None, " \n")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    assert Q.op11_spelling_variants(spark, f"{tmp_path}/odd").collect() == []
    assert Q.op12_ranked_search(spark, f"{tmp_path}/odd").collect() == []
    none = hashlib.sha256(b"").hexdigest()
    assert rows_of(Q.op13_substring_dedup(spark, f"{tmp_path}/odd"), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter({(1, 0, 0, none): 1, (2, 0, 0, none): 1, (None, 0, 0, none): 1})
    assert SCHEMAS["documents"].startswith("doc_id")
