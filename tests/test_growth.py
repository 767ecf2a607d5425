"""Work that grows with the input: what is counted here grew with its square, or with a whole batch, before."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from storyloom.operators import automaton, chunking, entities, evidence, graphs, near_quotes, packet, postings, ranking, retrieval


def test_binding_scores_items_and_not_pairs(spark):
    n, k = 200, 4
    items = [(f"f{i:03d}", i % 60, 1 if i % 3 else 2, float(i % 50)) for i in range(n)] + [("f001", 1, 1, 1.0), ("f900", None, 1, 99.0), ("f901", 3, None, 98.0), ("f902", 3, 1, None)]
    entities = [(i, 1 if i % 2 else 2) for i in range(n)] + [(7, 2), (3, 1), (500, None)]
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        scored.add(1)
        return x

    facts = spark.createDataFrame(items, "fact_id string, source_local_entity_id int, cluster_id int, x double")
    got = retrieval.bind(facts, spark.createDataFrame(entities, "entity_id int, cluster_id int"), score("x"), k).select("bound_to", "fact_id", "rank").collect()
    want = set()
    for e in {e for e, _ in entities}:
        clusters = {c for i, c in entities if i == e and c is not None}
        own = {(-1.0 if x is None else x, f) for f, s, c, x in items if s == e or c in clusters}
        want |= {(e, f, place) for place, (_, f) in enumerate(sorted(own, reverse=True)[:k], 1)}
    assert sorted(map(tuple, got)) == sorted(want)
    assert scored.value <= 10 * len(items)  # there are some 20,000 pairs


def test_small_projects_are_handed_over_together(spark, monkeypatch):
    projects = range(30)
    events = spark.createDataFrame([(p, f"{p}e{i}", "r", i) for p in projects for i in range(4)], "project int, event_id string, source_record_id string, discourse_index int")
    schema = "relation_id string, source_event_id string, target_event_id string, relation_type string, confidence double, source string, is_inferred boolean, project int, usable_for_ordering boolean"
    row = lambda p, s, t, c: (f"{p}:{s}{t}", f"{p}e{s}", f"{p}e{t}", "before", c, "llm", False, p, True)
    # an even project has 3 > 2 > 1 and a weak edge back, an odd one 1 > 2 and a weak edge back
    edges = spark.createDataFrame([r for p in projects for r in ([row(p, 3, 2, 0.9), row(p, 2, 1, 0.9), row(p, 1, 3, 0.8)] if p % 2 == 0 else [row(p, 1, 2, 0.9), row(p, 2, 1, 0.8)])], schema)
    for most in (20_000, 1):
        monkeypatch.setattr(graphs, "TOGETHER", most)
        verdicts = graphs.select_acyclic(edges, by="project")
        assert sorted(x.relation_id for x in verdicts.where("NOT selected").collect()) == sorted(f"{p}:{'13' if p % 2 == 0 else '21'}" for p in projects)
        order = graphs.topological(events, edges.where("confidence > 0.85"), "project")
        got = {(x.project, x.event_id): x.timeline_rank for x in order.collect()}
        assert got == {(p, f"{p}e{e}"): i for p in projects for i, e in enumerate((0, 3, 2, 1) if p % 2 == 0 else (0, 1, 3, 2), 1)}
        cycles = graphs.cycle_conflicts(edges, "project")
        assert sorted((x.project, sorted(x.ids)) for x in cycles.collect()) == [(p, [f"{p}e{i}" for i in ((1, 2, 3) if p % 2 == 0 else (1, 2))]) for p in projects]
        for df in (verdicts, order, cycles):
            assert "__set" in next(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "FlatMapGroupsInPandas" in line)


def test_pairs_that_cant_be_among_the_best_stay_at_the_scan(spark):
    r = np.random.default_rng(3)
    group, key = r.integers(0, 3, 400), r.permutation(400)
    score = np.round(r.choice([1.0, 2.0, 2.4, 3.0], 400) + r.choice([0.0, 3e-7, 6e-7, 0.2], 400), 9)
    stay = set(postings.may_be_best(postings.Best(4, (), "k", None, 6), group, score, key).tolist())
    for digits in (6, 7):  # whatever the rounding does to scores that are near
        best = {g: sorted((i for i in range(400) if group[i] == g), key=lambda i: (-round(score[i], digits), key[i]))[:4] for g in range(3)}
        assert set().union(*best.values()) <= stay
    assert len(stay) < 100
    docs = spark.createDataFrame([(i, "abc"[i % 3], " ".join(f"w{(i * 7 + j) % 23}" for j in range(i % 9 + 1))) for i in range(600)], "doc_id int, source string, text string").coalesce(1)
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 9}") for i in range(10)], "item_id int, query string")
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    every, some = (retrieval.lexical(docs, asked, keep=("source",), **cut) for cut in ({}, {"k": 3, "by": ("source",)}))
    best = lambda df: sorted(map(tuple, ranking.top_per(df, ["item_id", "source"], order, 3).select("item_id", "source", "rank", "doc_id", "score").collect()))
    assert best(every) == best(some) and some.count() < every.count() / 3


def test_repeated_keys_count_once_after_the_cut(spark):
    docs = spark.createDataFrame([(i // 2, "w1 w2 w3" if i % 2 else "w1", "ab"[i % 2]) for i in range(40)], "vector_id int, content string, vector_namespace string")
    asked = spark.createDataFrame([(1, "w1 w2 w3")], "query_id int, query string")
    got = retrieval.namespace_top(docs, asked, 3, {"a": 0.5}).collect()
    assert sorted((x.vector_namespace, x.vector_id, x.score) for x in got) == [("b", i, 3.0) for i in range(3)]


def test_searches_and_chunks_bound_their_batches(spark):
    name, old = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    try:
        for run in (lambda: retrieval.lexical(docs, docs.selectExpr("1 AS item_id", "text AS query")), lambda: chunking.chunk_units(docs, "text", "doc_id")):
            spark.conf.set(name, "67108864b")
            run()
            assert spark.conf.get(name) == str(4 << 20)
    finally:
        spark.conf.set(name, old)


def test_components_shuffle_nodes_and_not_edges(spark, monkeypatch):
    """A dense graph: no table that is written or shuffled has as many rows as it has edges."""
    edges = [(f"s{(i * 7 + j) % 20 + 20 * (i % 3)}", f"o{i}") for i in range(300) for j in range(20)]
    df = spark.createDataFrame(edges + edges[:50] + [("o1", "o1"), (None, "o2")], "source string, target string").repartition(2)
    rows = []
    for name in ("written", "cut_lineage"):
        monkeypatch.setattr(graphs, name, lambda x, own=getattr(graphs, name): rows.append((y := own(x)).count()) or y)
    want = brute_components(edges)
    assert {x.node: x.component for x in graphs.components(df).collect()} == want and len(set(want.values())) == 3
    assert max(rows) < len(edges) / 4


def brute_components(edges):
    low = {n: n for e in edges for n in e}
    while any(low[a] != low[b] for a, b in edges):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_components_of_blocks_of_any_size(spark, monkeypatch):
    """Long paths, stars and a random graph in blocks of few edges: centres are contracted again, or go by rounds."""
    r, rounds = np.random.default_rng(5), []
    monkeypatch.setattr(graphs, "_by_rounds", lambda pairs, own=graphs._by_rounds: rounds.append(1) or own(pairs))
    path, mixed = [(i, i + 1) for i in range(20)], [(int(x), int(y)) for x, y in r.integers(0, 80, (70, 2))] + [(200 + i % 3, 300 + i) for i in range(30)]
    size, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set(size, "1")
        for edges, most, kind, f in ((path, 1, "long", int), (mixed, 7, "string", "n{}é".format), (mixed, 1000, "int", int)):
            monkeypatch.setattr(graphs, "BLOCK_EDGES", most)
            df = spark.createDataFrame([(f(a), f(b)) for a, b in edges], f"source {kind}, target {kind}").repartition(3)
            assert {x.node: x.component for x in graphs.components(df).collect()} == brute_components([(f(a), f(b)) for a, b in edges if a != b])
    finally:
        spark.conf.set(size, old)
    assert rounds  # single edges in their order are not contracted
    df = spark.createDataFrame([], "source string, target string")
    assert graphs.components(df).collect() == []
    dates = spark.sql("SELECT DATE'2020-01-01' AS source, DATE'2020-01-02' AS target")
    assert len({x.component for x in graphs.components(dates).collect()}) == 1


def test_only_stretches_that_may_match_are_searched(monkeypatch):
    """Texts of a quote's own syllables, in another order: its pieces and short runs stand there, the quote doesn't."""
    r = np.random.default_rng(11)
    syllables = ["ra", "ción", "os", "ga", "lle", "ta", "ñez", "do", "as", "mi"]
    prose = lambda n: " ".join("".join(r.choice(syllables, 3)) for _ in range(n))
    quotes = [(i, prose(30)) for i in range(12)]
    texts = [prose(400) for _ in range(12)]
    texts[3] = texts[3][:500] + quotes[5][1].replace("ga", "gx", 1) + texts[3][500:]
    texts[8] = "İ" + quotes[7][1].replace("ta", "İ", 1).upper()
    strings, state = near_quotes._prepared(quotes, 0.94)
    batch = pa.RecordBatch.from_pydict({"h": list(range(12)), "g": list(range(12)), "text": texts})
    found = near_quotes._found(state, automaton.automaton(strings), batch, 0.94).to_pylist()
    assert {(x["h"], x["quote"]) for x in found} == {(3, 5), (8, 7)}
    for x in found:
        whole, part = evidence.best_window(dict(quotes)[x["quote"]], texts[x["h"]]), evidence.best_window(dict(quotes)[x["quote"]], x["part"], 0.94)
        assert whole[0] >= 0.94 and part == (whole[0], whole[1] - x["begin"], whole[2] - x["begin"])


def test_common_bounds_every_window():
    r = np.random.default_rng(2)
    for _ in range(60):
        quote, text = ("".join(r.choice(list("abcé"), n)) for n in r.integers(1, 30, 2))
        best = evidence.best_window(quote, text)
        most = near_quotes.common(near_quotes.masks(quote), len(quote), text)
        table = [[0] * (len(text) + 1) for _ in range(len(quote) + 1)]
        for i, x in enumerate(quote):
            for j, y in enumerate(text):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert most == table[-1][-1]
        for least in (0.5, 0.8, 0.94, 1.0):
            assert best is None or best[0] < least or most >= near_quotes.in_common(len(quote), least)


def test_a_packets_memories_are_cut_at_the_scan(spark, monkeypatch):
    """Queries with bounds of their own, also of equal texts: what leaves the scan doesn't grow with the memories that share a word."""
    memories = [(f"m{i:04d}", None if i % 97 == 0 else i, ["durable_state", "temporal_episode", "atemporal_fact"][i % 3], " ".join(f"w{(i * 7 + j) % 13}" for j in range(i % 5 + 1))) for i in range(900)]
    queries = [(1, "w1 w2 w3", 500), (2, "w1 w2 w3", 40), (3, "w4 w5 zz", 900), (4, "w6", None), (5, "", 900), (6, "w4", 0)]
    left = []
    monkeypatch.setattr(postings, "count_common", lambda *a, own=postings.count_common: left.append((x := own(*a)).count()) or x)
    df = spark.createDataFrame(memories, "memory_id string, scene_order int, memory_temporal_scope string, summary string").coalesce(1)
    got = packet.global_memories(spark.createDataFrame(queries, "query_id int, query string, bound int"), df, 8).collect()
    want = set()
    for q, text, bound in queries:
        hits, asked = [], set(text.split())
        for m, at, scope, summary in memories:
            own = set(summary.split())
            if bound is not None and at is not None and at < bound and (n := len(asked & own)):
                hits.append((-round(n + n / len(asked) + n / len(own), 6), m, scope))
        near = [(s, m) for s, m, scope in sorted(hits)[:24] if scope != "temporal_episode"]
        want |= {(q, m, -s, place) for place, (s, m) in enumerate(near[:8], 1)}
    assert {tuple(x) for x in got} == want and {x.query_id for x in got} == {1, 2, 3}
    assert left and max(left) < 150


def test_many_names_meet_few_texts_in_one_pass(spark, monkeypatch):
    names = [(f"e{i}", f"Name{i} of-{i % 7}") for i in range(120)] + [("x", "é"), ("y", None), ("n7", "NAME7 of 0")]
    texts = [(i, f"here is name{i * 5} OF {i * 5 % 7} and name{i}of{(i + 1) % 7}") for i in range(20)] + [(30, None), (31, ""), (0, "name7 of 0")]
    t, a = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(names, "entity_id string, alias string")
    found = lambda: sorted(map(tuple, entities.known_in_text(t, a).select("t", "entity_id", "alias").collect()))
    want, scans = found(), []
    assert len(want) > 20
    monkeypatch.setattr(automaton, "SHARD_BYTES", 64)
    monkeypatch.setattr(entities, "scan", lambda *a, own=entities.scan: scans.append(1) or own(*a))
    assert found() == want and not scans
    monkeypatch.setattr(entities, "FEW_TEXTS", 3)
    monkeypatch.setattr(automaton, "SHARD_BYTES", 800)
    assert found() == want and 1 < len(scans) < 9
