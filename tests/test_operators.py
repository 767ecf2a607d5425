"""Operators against brute-force versions and by hand: search in texts, graphs, packets, layers, extraction, indexes."""

import difflib
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from storyloom.functions import rules, text
from storyloom.operators import entities, evidence, extraction, fusion, graphs, layers, near_quotes, ordered, packet, prefix, ranking, relations, retrieval, social, timeline
from storyloom.sources import adapters, index, prompts, readers, writers


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def word(r, n=3):
    return "".join(r.choices("abcd", k=r.randint(1, n)))


# --- texts ---


def test_verbatim_finds_every_quote(spark):
    r = random.Random(1)
    texts = [(i, " ".join(word(r) for _ in range(r.randint(0, 30)))) for i in range(80)] + [(3, None), (None, "a b c d"), (7, "")]
    texts += [texts[5], texts[5]]
    quotes = []
    for i in range(60):
        t = r.choice([t for _, t in texts if t])
        a, n = r.randrange(len(t)), r.randint(1, 25)
        quotes.append((i, t[a : a + n]))
    quotes += [(90, ""), (91, None), (92, "not there at all"), (93, "a  b")]
    got = evidence.verbatim(frame(spark, "doc_id long, text string", *texts), frame(spark, "item_id long, quote string", *quotes))
    want = Counter((d, q) for d, t in texts for q, s in quotes if s and t and s in t)
    assert Counter((x.doc_id, x.item_id) for x in got.collect()) == want
    assert evidence.verbatim(frame(spark, "doc_id long, text string"), frame(spark, "item_id long, quote string", *quotes)).count() == 0
    assert evidence.verbatim(frame(spark, "doc_id long, text string", *texts), frame(spark, "item_id long, quote string")).count() == 0


def changed(r, words):
    """A quote with changed letters, words, insertions or deletions."""
    own = list(words)
    for _ in range(r.choice([0, 1, 1, 2, 3])):
        i = r.randrange(len(own))
        kind, w = r.randrange(6), own[i]
        k = r.randrange(len(w)) if w else 0
        if kind == 5 and len(own) > 3:
            own[i : i + 1] = r.choice([[], ["then", w]])
        else:
            own[i] = [w[:k] + "z" + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + "y" + w[k:], w + w[-1:], w[:k] + " " + w[k:]][min(kind, 4)]
    return " ".join(own)


def test_locate_near_matches_the_search_of_whole_texts(spark):
    r = random.Random(2)
    fresh = lambda n: ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n)]
    sizes = [1, 1, 2, 3, 4, 5, 8, 12, 24, 40]
    own = [fresh(n) for n in sizes] + ["captain wandered beyond frozenn mountains without permission".split(), list("他们在河边的老房子里住了很多年")]
    quotes = [(i, " ".join(w)) for i, w in enumerate(own)] + [(90, ""), (91, None), (92, "...")]
    texts = []
    for i in range(96):
        text = " ".join(fresh(r.randint(0, 12))) + r.choice([" ", ", ", "。"]) + changed(r, own[i % len(own)]) + r.choice(["", ". ", "!"]) + " ".join(fresh(r.randint(0, 6)))
        texts.append((i, r.choice([str, str.upper, str.title])(text)))
    every = list(own[8])
    for i in range(0, len(every), 4):
        every[i] = every[i][:-1] + "q"
    texts += [(200, " ".join(every)), (201, "captain wandered beyond frozen mountains without permission"), (202, None), (203, ""), (204, "ΑΣ " + quotes[7][1] + " İ"), (0, texts[0][1])]
    got = near_quotes.locate_near(frame(spark, "doc_id long, text string", *texts), frame(spark, "item_id long, evidence string", *quotes)).collect()
    want = Counter()
    for d, t in texts:
        for q, s in quotes:
            w = evidence.best_window(s or "", t or "")
            if w and w[0] >= evidence.THRESHOLD:
                want[d, q, t] += 1
    assert Counter((x.doc_id, x.item_id, x.content) for x in got) == want
    assert sum(want.values()) > 80 and {q for _, q, _ in want} == set(range(12))
    for x in got:
        at, quote = x.evidence_at, dict(quotes)[x.item_id]
        score, start, end = evidence.best_window(quote, x.content)
        assert at.score == round(score, 4) and x.content[at.start : at.end] == at.aligned
        if at.score < 1:
            assert (at.start, at.end, at.status) == (start, end, "fuzzy_aligned")


def test_near_quotes_pieces_bound_every_ratio():
    for n in range(1, 400):
        own = "x" * n
        parts = near_quotes.pieces(own)
        assert "".join(p for _, p in parts) == own and len(parts) >= min(n, near_quotes.errors(n) + 1)
        # no window of an allowed length with more unmatched characters reaches the threshold
        for m in range(max(1, n - near_quotes.slack(n)), n + near_quotes.slack(n) + 1):
            unmatched = next(u for u in range(n + m + 1) if (n + m - u) % 2 == 0 and u > near_quotes.errors(n))
            assert (n + m - unmatched) / (n + m) < evidence.THRESHOLD or unmatched < abs(n - m)


def test_known_in_text(spark):
    r = random.Random(3)
    names = [(f"e{i}", word(r, 9) + r.choice(["", " ", "-"]) + word(r, 4)) for i in range(60)] + [("k", "Model 550A"), ("z", "x"), ("e1", "é林远征")]
    texts = [(i, " ".join(word(r, 8) for _ in range(r.randint(0, 20)))) for i in range(40)] + [(50, "the 550a is here"), (51, "他是é林远征。"), (52, None), (0, "abc")]
    key = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    got = Counter((x.t, x.entity_id, x.alias) for x in entities.known_in_text(frame(spark, "t int, text string", *texts), frame(spark, "entity_id string, alias string", *names)).collect())
    want = Counter((t, e, a) for t, s in texts for e, a in names if len(key(a)) >= 2 and (key(a) in key(s) or (e == "k" and "550a" in key(s))))
    assert got == want


def test_resolve_fuzzy_loses_no_pair_to_its_bounds(spark, monkeypatch):
    r = random.Random(4)
    aliases = [(f"e{i}", word(r, 8), i, i) for i in range(50)]
    refs = sorted({word(r, 8) for _ in range(40)})
    want = {}
    for q in refs:
        best = []
        for e, a, n, o in aliases:
            short, long = sorted((len(q), len(a)))
            s = 1.0 if q == a else 0.0 if len(q) == 1 else 0.72 + 0.22 * short / long if q in a or a in q else difflib.SequenceMatcher(None, q, a).ratio()
            if s >= 0.55:
                best.append((-round(s, 6), -n, e))
        want[q] = [e for *_, e in sorted(best)][:3]
    a, q = frame(spark, "entity_id string, alias string, mention_count int, first_seen_order int", *aliases), frame(spark, "ref string", *((x,) for x in refs))
    for most in (ranking.STATED_ROWS, 15):  # in one block, and in several
        monkeypatch.setattr(entities, "stated_blocks", lambda df, m=most: ranking.stated_blocks(df, m))
        got = defaultdict(list)
        for x in entities.resolve_fuzzy(q, a).orderBy("rank").collect():
            got[x.ref].append(x.entity_id)
        assert {k: got[k] for k in refs} == want


def test_lexical_scores_repeated_rows_once_each(spark):
    docs = frame(spark, "doc_id long, text string, lang string", (1, "a b c", "x"), (1, "a b c", "x"), (1, "a", "y"), (2, None, "x"), (None, "c", "z"))
    q = frame(spark, "item_id long, query string", (5, "a c d"), (6, "a c d"), (7, ""), (8, None))
    got = Counter((r.doc_id, r.item_id, r.lang, r.score) for r in retrieval.lexical(docs, q, keep=("lang",)).collect())
    score = lambda n, t: round(n + n / 3 + n / t, 6)
    assert got == Counter({(d, i, l, s): n for i in (5, 6) for (d, l, s), n in {(1, "x", score(2, 3)): 2, (1, "y", score(1, 1)): 1, (None, "z", score(1, 1)): 1}.items()})


def test_overlap_top_needs_no_pair_without_overlap(spark):
    r = random.Random(5)
    docs = [(i, f"n{i % 3}", " ".join(word(r, 2) for _ in range(r.randint(0, 6)))) for i in range(90)]
    queries = [(i, " ".join(word(r, 2) for _ in range(4))) for i in range(6)] + [(9, "zzz")]
    weights = {"n0": 0.4, "n1": 0.1}
    got = defaultdict(list)
    rows = retrieval.namespace_top(frame(spark, "vector_id int, vector_namespace string, content string", *docs), frame(spark, "query_id int, query string", *queries), 4, weights)
    for x in rows.orderBy("rank").collect():
        got[x.query_id, x.vector_namespace].append((x.vector_id, x.score))
    for q, s in queries:
        for n in ("n0", "n1", "n2"):
            best = sorted((-round(len(set(t.split()) & set(s.split())) + weights.get(n, 0.0), 4), i) for i, m, t in docs if m == n)[:4]
            assert got[q, n] == [(i, -s) for s, i in best]


def test_searches_on_an_empty_list_of_queries(spark):
    none = frame(spark, "query_id int, query string")
    docs = frame(spark, "vector_id int, vector_namespace string, content string", (1, "n", "a b"))
    assert retrieval.namespace_top(docs, none, 3).count() == 0
    assert retrieval.lexical(frame(spark, "doc_id int, text string", (1, "a")), none).count() == 0
    assert entities.known_in_text(none.withColumnRenamed("query", "text"), frame(spark, "entity_id string, alias string", ("e", "ab"))).count() == 0


def test_scene_class_counts_what_the_plain_pattern_counts(spark):
    import re

    r = random.Random(6)
    plain = re.compile("[：:][“\"'‘（(]|[A-Za-z0-9_一-鿿]+[ \t\n\x0b\f\r]*[：:]|[一-鿿A-Za-z0-9_（）()·]+[：:]")
    texts = ["".join(r.choices(list("ab_1: :(（)·林：\n“x"), k=r.randint(0, 30))) for _ in range(600)] + ["a" * 30000, "a(" * 9000, None]
    df = frame(spark, "i int, t string", *enumerate(texts))
    got = {x.i: x.c for x in df.select("i", rules.scene_class(F.lit(""), "t").alias("c")).collect()}
    for i, t in enumerate(texts):
        if len(t or "") < 100:
            assert got[i].signals.dialogue_count == len(plain.findall(t or "")), t
    assert got[len(texts) - 1].unit_type == "empty"


def test_posting_lists_in_blocks(spark):
    docs = frame(spark, "doc_id long, w array<string>", (1, ["a", "a", "b"]), (2, ["a"]), (9, ["a", "c"]), (10, None))
    got = {(r.token, r.block): (r["keys"], r.n) for r in relations.inverted_index(docs, F.col("w"), "doc_id", "token", F.floor(F.col("doc_id") / 8)).collect()}
    assert got == {("a", 0): ([1, 2], 2), ("a", 1): ([9], 1), ("b", 0): ([1], 1), ("c", 1): ([9], 1)}
    scopes = relations.source_scopes(frame(spark, "source_scope_id string, source_scope_name string, doc_id long, source_path string", ("s", "n", 1, "p"), ("s", "n", 4, "p"), ("t", "m", 2, "q")))
    assert {r.source_scope_id: (r.doc_count, r.path_count, r.first_doc_id, r.last_doc_id) for r in scopes.collect()} == {"s": (2, 1, 1, 4), "t": (1, 1, 2, 2)}


# --- graphs ---


def kahn(nodes, links):
    """First in, first out; nodes that become ready together by their place in ``nodes``; what is left on cycles last."""
    links = {(s, t) for s, t in links if s != t and s in nodes and t in nodes}
    waits = {n: sum(t == n for _, t in links) for n in nodes}
    queue, out = [n for n in nodes if not waits[n]], []
    while queue:
        n = queue.pop(0)
        out.append(n)
        for t in [m for m in nodes if (n, m) in links]:
            waits[t] -= 1
            if not waits[t]:
                queue.append(t)
    return out + [n for n in nodes if n not in out]


def test_topological_order_by_task_and_by_level(spark):
    r = random.Random(7)
    events, edges, want = [], [], {}
    for p in range(4):
        own = [f"p{p}e{i:02d}" for i in range(r.randint(1, 14))]
        place = {e: (r.randint(0, 2), r.randint(0, 3)) for e in own}
        events += [(p, e, *place[e]) for e in own]
        links = [(r.choice(own), r.choice(own)) for _ in range(len(own))]
        links = [(s, t) for s, t in links if p == 3 or s < t]  # one project has cycles
        edges += links + links[:2]
        want[p] = kahn(sorted(own, key=lambda e: (*place[e], e)), links)
    edges += [("p0e00", "nowhere"), ("p1e00", "p2e00")]  # to no event; between projects
    e = frame(spark, "project int, event_id string, source_record_id int, discourse_index int", *events)
    l = frame(spark, "source_event_id string, target_event_id string", *edges)
    for most in (graphs.ONE_TASK, 0):
        got = defaultdict(list)
        for x in graphs.topological(e, l, "project", one_task=most).orderBy("project", "timeline_rank").collect():
            assert x.timeline_rank == len(got[x.project]) + 1
            got[x.project].append(x.event_id)
        assert got == want


def test_greedy_choice_and_cycles(spark):
    r = random.Random(8)
    rows = [(f"r{i:03d}", f"n{r.randrange(9)}", f"n{r.randrange(9)}", "before", r.choice([0.5, 0.8, 0.9]), r.choice(["llm", "scene_block_prior"]), r.random() < 0.3, "p", True) for i in range(70)]
    schema = "relation_id string, source_event_id string, target_event_id string, relation_type string, confidence double, source string, is_inferred boolean, project string, usable_for_ordering boolean"

    def reaches(links, a, b):
        seen, todo = {a}, [a]
        while todo:
            for s, t in links:
                if s == todo[-1] and t not in seen:
                    seen.add(t)
                    todo.append(t)
                    break
            else:
                todo.pop()
        return b in seen

    chosen, want = set(), {}
    for x in sorted(rows, key=lambda x: (-x[4], -graphs.PRIORITY[x[5]], x[6], x[0])):
        bad = "self_edge" if x[1] == x[2] else "would_create_cycle" if reaches(chosen, x[2], x[1]) else None
        want[x[0]] = bad
        chosen |= {(x[1], x[2])} if bad is None else set()
    edges = frame(spark, schema, *rows)
    for by in (None, "project"):
        assert {x.relation_id: x.skip_reason for x in graphs.select_acyclic(edges, by=by).collect()} == want
    assert graphs.first_cycles([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y")]) == [["a", "b", "c"], ["d"]]
    for x in graphs.cycle_conflicts(edges, "project").collect():
        strong = {(e[1], e[2]) for e in rows if e[4] >= 0.75}
        assert all((s, t) in strong for s, t in zip(x.ids, [*x.ids[1:], x.ids[0]])) and x.type == "cycle"
    cyclic = {x for x in {n for e in rows for n in e[1:3]} if any(s == x and (t == x or reaches({(a, b) for _, a, b, *_ in rows}, t, x)) for _, s, t, *_ in rows)}
    on_cycles = set().union(*(x.ids for x in graphs.cycle_conflicts(edges, "project", 0.0).collect()))
    assert on_cycles <= cyclic and (not cyclic or on_cycles)
    assert graphs.cycle_conflicts(edges.limit(0), "project").count() == 0


def test_buckets_counts_and_orders(spark):
    order = frame(spark, "event_id string, project string, timeline_rank int", ("a", "p", 1), ("b", "p", 2), ("c", "p", 3), ("d", "q", 1))
    same = frame(spark, "source_event_id string, target_event_id string", ("a", "c"))
    assert {(x.event_id, x.timeline_bucket) for x in timeline.buckets(order, same, "project").collect()} == {("a", "T001"), ("c", "T001"), ("b", "T002"), ("d", "T001")}
    events = frame(spark, "event_track string", ("plot",), (None,), ("context",), ("forecast",))
    rel = frame(spark, "source string, relation_type string, usable_for_ordering boolean, selected boolean", ("llm", "before", True, True), ("llm", "before", True, False), ("discourse_prior", "same_time", True, None), ("llm", "after", False, None))
    got = timeline.graph_counts(spark.range(3), events, rel, spark.range(2), frame(spark, "timeline_bucket string", ("T1",), ("T1",), ("T2",))).first().asDict()
    assert list(got.values()) == [3, 4, 2, 1, 1, 3, 2, 1, 1, 1, 2, 2] and len(got) == 12
    rows = frame(spark, "record_id string, timeline_rank int, reveal_order int", ("a", None, 1), ("b", 2, None), ("c", 2, 5), ("d", None, None))
    assert [x.record_id for x in rows.orderBy(*timeline.story_order()).collect()] == ["c", "b", "a", "d"]
    ids = frame(spark, "i string", ("scene_10",), ("scene_9",), ("intro",), ("x_9",))
    assert [x.i for x in ids.orderBy(*ranking.suffix_order("i")).collect()] == ["scene_9", "x_9", "scene_10", "intro"]


def test_beats_follow_their_strategies():
    links = [("a", "b", 0.9, "care_guidance"), ("b", "a", 0.8, "value_resistance")]
    pool = [("1", "a", "safety_correction", 0.5), ("2", "a", "deflection", 0.9), ("3", "b", "minimal_compliance", 0.4), ("4", "b", "risky_operation", 0.3), ("5", "a", "physical_reaction", 0.2)]
    options = {s: picks for s, _, _, picks in social.beat_options(links, pool)}
    assert options["pressure_default"] == [("1", "3"), ("4", "5")]
    assert options["score_first"] == [("2", "3"), ("4", "1")]
    assert options["low_directive"] == [("5", "3"), ("4", None)]
    assert "relationship_first" not in options  # the same actions as the first
    # no action of the source: one of the other member opens
    assert social.beat_options([("x", "b", 0.9, "care_guidance")], pool)[0][3] == [("4", "3")] or social.beat_options([("x", "b", 0.9, "care_guidance")], pool)[0][3][0][0] in ("3", "4")
    alone = social.beat_options([], pool)
    assert [s for s, *_ in alone] == ["fallback_top_candidates"] and alone[0][3] == [("2", None), ("1", None), ("3", None)]
    assert social.beat_options([], []) == [] and social.sequence_score([("a", "b", 1, "care_guidance")], style_risks=9) == 0.9


# --- packets ---


def test_memory_packet(spark):
    ents = frame(spark, "entity_id string, canonical_name string, entity_type string", ("e1", "Ada King", "character"), ("e2", "Bob Stone", "character"), ("e3", "Orb", "object"))
    aliases = frame(spark, "entity_id string, alias string", ("e1", "Ada King"), ("e1", "Ada"), ("e2", "Bob Stone"), ("e3", "Orb"))
    memories = frame(spark, "memory_id string, scene_id string, scene_order int, sequence_index int, summary string, memory_temporal_scope string", ("m1", "s1", 1, 1, "Ada enters the ship", "temporal_episode"), ("m2", "s2", 2, 1, "Ada repairs the engine", "temporal_episode"), ("m3", "s5", 5, 1, "Ada leaves", "temporal_episode"), ("m4", "s1", 1, 2, "the engine needs fuel", "atemporal_fact"), ("m5", "s1", 1, 3, "Bob waits", "temporal_episode"))
    links = frame(spark, "entity_id string, memory_id string", ("e1", "m1"), ("e1", "m1"), ("e1", "m2"), ("e1", "m3"), ("e2", "m5"), ("e3", "m4"))
    rel = frame(spark, "relation_id string, source_entity_id string, target_entity_id string, relation_type string, last_order int", ("r1", "e1", "e2", "trusts", 1), ("r2", "e1", "e3", "owns", 9), ("r3", "e3", "e1", "owned_by", 2))
    docs = frame(spark, "doc_id string, doc_type string, scene_id string, scene_order int, text string", ("d1", "scene_summary", "s1", 1, "engine room"), ("d2", "stated_fact", "s1", 1, "the engine is old"), ("d3", "scene_summary", "s9", 9, "engine engine"), ("d4", "other", "s2", 2, "engine"))
    queries = frame(spark, "query_id string, query string, bound int", ("q", "Ada looks at the engine with Bob Stone", 4), ("n", "nothing known", 4), ("z", "Ada", 0))
    world = {"entities": ents, "aliases": aliases, "links": links, "memories": memories, "relations": rel, "documents": docs}
    parts = packet.memory_packet(queries, world)
    assert {(x.query_id, x.entity_id, x.entity_rank) for x in parts["entities"].collect()} == {("q", "e1", 1), ("q", "e2", 2), ("z", "e1", 1)}
    state = {(x.query_id, x.entity_id): (x.profile, x.current_state) for x in parts["entities"].collect()}
    assert state["q", "e1"] == ("Ada enters the ship; Ada repairs the engine",) * 2 or state["q", "e1"][0].startswith("Ada enters") and state["z", "e1"] == ("", "")
    labels = {(x.memory_id, x.label, x.strategy) for x in parts["memories"].where("query_id = 'q'").collect()}
    assert {("m1", "M1", "all_memories"), ("m2", "M2", "all_memories"), ("m5", "M3", "all_memories")} <= labels and ("m4", "M4", "global_scope") in labels and not any(m == "m3" for m, *_ in labels)
    assert {(x.query_id, x.relation_id, x.is_between_matched) for x in parts["relations"].collect()} == {("q", "r1", True), ("q", "r3", False)}
    why = {x.query_id: (x.matched_entity_count, x.returned_relationship_count, x.reason != "") for x in parts["diagnostics"].collect()}
    assert why == {"q": (2, 2, False), "z": (1, 0, True)}
    assert [(x.query_id, x.scene_id, x.hits) for x in parts["scenes"].collect()] == [("q", "s1", 2)]
    few = packet.memory_packet(queries, world, packet.PacketLimits(all_memories=1, entity_memories=1))
    assert {(x.entity_id, x.memory_id, x.strategy) for x in few["memories"].where("query_id = 'q' AND entity_id IS NOT NULL").collect()} == {("e1", "m2", "top_k"), ("e2", "m5", "all_memories")}
    notes = [x.note for x in packet.memory_notes(parts["memories"], memories, 3).where("entity_id = 'e1'").orderBy("note_rank").collect()]
    assert notes == ["M1 <s1> scope=temporal_episode: Ada enters the ship", "M2 <s2> scope=temporal_episode: Ada repairs the engine", "M4 <s1> scope=atemporal_fact: the engine needs fuel"]
    cards = packet.card_contexts(parts, memories, most=1)
    assert {(x.entity_id, x.memory_id) for x in cards["memories"].where("query_id = 'q'").collect()} == {("e1", "m1"), ("e2", "m5")}
    assert {(x.entity_id, x.relation_id) for x in cards["relations"].collect()} == {("e1", "r1"), ("e2", "r1"), ("e1", "r3")}
    said = writers.memory_packet_markdown(parts, "q", memories)
    assert "Ada King (character)" in said and "[M1] Ada enters the ship <s1>" in said and "- e1 -> e2: trusts" in said
    assert "diagnostic:" in writers.memory_packet_markdown(parts, "z", memories)
    refs = frame(spark, "known_to array<string>, statement string, rank int", (["all"], "x", 2), ([], "y", 1), (["Bob"], "z", 3), (["Ada"], "x", 4))
    assert [x.statement for x in packet.reference_notes(refs, "Ada", 5).collect()] == ["y", "x"]


def test_passes_and_packets_of_many_queries(spark):
    q = frame(spark, "query_id int, query string", (1, "Ada and when"), (2, "林远征和周明的关系"), (3, ""))
    got = {(x.query_id, x.pass_name): x.query for x in fusion.pass_texts(q, fusion.budget("standard")).collect()}
    assert got[1, "base"] == "Ada and when" and got[1, "low_level"] == "Ada and" and got[1, "high_level"].endswith("timeline") and (3, "low_level") not in got and "关系" in got[2, "high_level"]
    hits = frame(spark, "q int, k string, pass_no int, pass_name string, rank int, score double", (1, "a", 0, "base", 0, 1.0), (1, "b", 0, "base", 1, 0.5), (2, "a", 0, "base", 0, 3.0))
    assert {(x.q, x.k) for x in fusion.fuse(hits, "k", 1, by=("q",)).collect()} == {(1, "a"), (2, "a")}
    items = frame(spark, "q int, item_id string, section string, rank int", (1, "a", "facts", 1), (1, "b", "facts", 2), (2, "c", "facts", 1))
    assert {(x.q, x.item_id, x.ref_id) for x in fusion.evidence_packet(items, fusion.budget("compact"), by=("q",)).collect()} == {(1, "a", "F1"), (1, "b", "F2"), (2, "c", "F1")}


# --- layers, extraction, runs ---


def test_typed_layers(spark):
    data = {"unit_id": "s1", "events": [{"summary": "A", "participants": ["x", 3], "location": "L"}, "bare"], "knowledge_transfers": [{"source": "a", "receiver": "b", "content": "c"}], "state_changes": {"entity": "no list"}, "visibility_records": [{"fact_or_event": "f", "character": "c"}], "hidden_or_future_sensitive_items": [{"summary": "h", "hidden_from": ["c", "d"]}, "secret"]}
    out = frame(spark, "status string, data string, name string", ("parsed", json.dumps(data), "f1"), ("parsed", json.dumps({"events": []}), "f2"), ("failed", "{}", "f3"), ("parsed", "[1]", "f4"), ("parsed", None, "f5"))
    made = layers.scene_events(out)
    assert [(x.record_id, x.summary, x.participants, x.location) for x in made["events"].orderBy("item_index").collect()] == [("s1_event_001", "A", ["x", "3"], "L"), ("s1_event_002", "bare", [], "")]
    assert [(x.record_id, x.receiver, x.epistemic_status) for x in made["knowledge_transfers"].collect()] == [("s1_kt_001", "b", "")] and made["state_changes"].count() == 0
    assert {x.scene_id for x in layers.accepted(out).collect()} == {"s1", "f2"}
    seen = layers.visibility(out)
    assert [(x.item, x.hidden_from) for x in seen["hidden_items"].orderBy("item_index").collect()] == [("h", ["c", "d"]), ("secret", [])]
    assert {(x.record_id, x.hidden_from) for x in layers.hidden_pairs(seen["hidden_items"]).collect()} == {("s1_hidden_001", "c"), ("s1_hidden_001", "d")}
    n = layers.counts(out, made).first()
    assert (n.parsed_files, n.accepted_scene_count, n.skipped_scene_count, n.events_count) == (5, 2, 3, 2)
    mentions = frame(spark, "scene_id string, record_id string, name string", ("s1", "1", "Ada King"), ("s2", "2", "ada  king"), ("s2", "3", " "), ("s1", "4", "Bob"))
    staged = {"scenes": frame(spark, "scene_id string, setting string", ("s1", "ship"), ("s2", "dock")), "characters": mentions, "objects": mentions.limit(0), "stated_facts": frame(spark, "scene_id string, record_id string, proposition string", ("s1", "f1", "Ada sails"), ("s2", "f2", "rain")), "open_questions": frame(spark, "scene_id string, record_id string, question string", ("s2", "q1", "why?"))}
    memory = layers.canonical_memory(staged, [F.col("scene_id"), F.col("record_id")])
    assert [(x.entity_id, x.canonical_name, x.aliases, x.scene_ids, x.mention_count) for x in memory["characters"].orderBy("entity_id").collect()] == [("character_0001", "Ada King", ["Ada King", "ada  king"], ["s1", "s2"], 2), ("character_0002", "Bob", ["Bob"], ["s1"], 1)]
    found = layers.query_memory(memory, character="bob")
    assert [x.scene_id for x in found["scenes"].collect()] == ["s1"] and [x.record_id for x in found["stated_facts"].collect()] == ["f1"]
    assert [x.record_id for x in layers.query_memory(memory, "RAIN")["stated_facts"].collect()] == ["f2"]


def test_actors_and_mention_keys(spark):
    mentions = frame(spark, "surface string, canonical_hint string, entity_type string, scene_id string, record_id string", ("the boss", "Ada", "group", "s2", "2"), ("Ada", "", "character", "s1", "1"), ("Ada", "", "object", "s0", "0"))
    x = entities.kg_actor(mentions, frame(spark, "name string", ("ada",), ("nobody",))).collect()
    assert [(r.name, r.canonical_name, r.entity_type, r.aliases, r.scene_ids) for r in x] == [("ada", "Ada", "character", ["Ada", "the boss"], ["s1", "s2"])]
    k = lambda name, kind: spark.range(1).select(entities.mention_key(F.lit(name), F.lit(kind), F.lit("s1"), F.lit("kg"), F.lit("e")).alias("k")).first().k
    assert k("那个人", "character").startswith("deictic:") and k("钻机 550A", "object") == "code:550a" and k("为首的科学家们", "group") == "role:科学家" and k("Ada King", "character") == k("King, Ada", "character")


def test_fact_and_property_extraction(spark):
    jobs = frame(spark, "job_id string, asset_type string, subject string, source_scope_id string, source_local_entity_id string, source_local_relation_id string, cluster_id string, evidence_chunks array<struct<chunk_id: string, doc_id: string>>", ("j1", "entity", "Ada", "sc", "le", None, "c1", [("k1", "d1"), ("k2", "d2")]), ("j2", "relationship", "Ada - Bob", "sc", None, "lr", "c1", []))
    answer = {"atomic_facts": [{"fact": "Ada  sails", "source_chunk_id": "k2", "confidence": 7}, {"subject": "X", "statement": "says", "source_chunk_id": "nope", "predicate": "p"}, "text", {"subject": "only"}], "entity_properties": [{"property": "rank", "value": "captain"}, {"property": "type", "value": "x"}, {"property": "age", "value": "", "statement": "s"}]}
    raw = frame(spark, "job_id string, raw_text string", ("j1", "```json\n" + json.dumps(answer) + "\n```"), ("j2", json.dumps(answer)), ("j1", "nothing"))
    facts = extraction.atomic_facts(raw, jobs).collect()
    assert {(f.job_id, f.subject, f.predicate, f.statement, f.source_chunk_id, f.source_doc_id, f.confidence, f.fact_type, f.source_local_entity_id, f.source_local_relation_id, f.cluster_id) for f in facts} == {
        ("j1", "Ada", "states", "Ada sails", "k2", "d2", 1.0, "entity_atomic_fact", "le", "", "c1"), ("j1", "X", "p", "says", "k1", "d1", 0.72, "entity_atomic_fact", "le", "", "c1"),
        ("j2", "Ada - Bob", "states", "Ada sails", "", "", 1.0, "relationship_atomic_fact", "", "lr", ""), ("j2", "X", "p", "says", "", "", 0.72, "relationship_atomic_fact", "", "lr", ""),
    }
    assert [(p.entity_name, p.property_name, p.statement, p.source_chunk_id) for p in extraction.entity_properties(raw, jobs).collect()] == [("Ada", "rank", "Ada.rank: captain", "k1")]
    records = frame(spark, "doc_id string, doc_type string, parent_scene_id string, entity_id string, text string, memory_type string, summary string, evidence_text string, evidence_start int", ("d1", "stated_fact", "s1", "", "said", None, None, None, None), ("d2", "episodic_memory_entity", "", "e", "t", "relationship", "sum", "ev", 3))
    items = {x.item_id: x for x in extraction.artifact_items(records, "p", "src").collect()}
    assert (items["artifact:d1"].item_type, items["artifact:d1"].statement, items["artifact:d1"].evidence_refs, items["artifact:d1"].unit_id) == ("fact", "said", [], "s1")
    two = items["artifact:d2"]
    assert (two.item_type, two.statement, two.entity_ids, two.evidence_refs[0].text, two.evidence_refs[0].start_offset, two.confidence, two.visibility) == ("relation", "sum", ["e"], "ev", 3, 0.8, "character_visible")
    ents = frame(spark, "source_local_entity_id string, entity_name string, entity_type string, description string, source_doc_ids array<string>, source_chunk_ids array<string>", ("1", "Ada", "character", "a captain", ["d"], ["k"]), ("2", " ", "object", "x", [], []))
    rels = frame(spark, "source_local_relation_id string, src_id string, tgt_id string, description string, source_doc_ids array<string>, source_chunk_ids array<string>", ("3", "Ada", "Bob", "friends", ["d"], ["k"]))
    props = extraction.entity_properties(raw, jobs)
    chunks = frame(spark, "chunk_id string, heading string, title string, full_doc_id string, content string", ("k", "", "T", "d", "body"), ("e", "h", "T", "d", " "))
    recs = extraction.reference_records(ents, rels, extraction.atomic_facts(raw, jobs), props, chunks)
    assert Counter((x.source_role, x.item_type, x.authority) for x in recs.collect()) == Counter({("external_reference_entity", "character_profile", 0.7): 1, ("external_reference_relation", "relationship_fact", 0.7): 1, ("external_reference_fact", "world_bible", 0.72): 2, ("external_reference_fact", "relationship_fact", 0.72): 2, ("external_reference_property", "world_bible", 0.7): 1, ("external_reference_chunk", "author_note", 0.6): 1})
    assert [x.authority for x in recs.orderBy(*extraction.record_order()).collect()][0] == 0.72 and extraction.filter_records(recs, ["author_note"], ["author_only"], 3).count() == 1
    made = {x.item_id: x for x in extraction.reference_items(recs, "p", "lib").collect()}
    one = made["external:external_source_local_entity:1"]
    assert (one.unit_id, one.entity_ids, one.visibility, one.default_canon, one.evidence_refs[0].text) == ("lib:k", ["external_subject:Ada"], "author_only", False, "a captain") and "statement: a captain" in one.embedding_text


def test_commit_log_and_states(spark):
    aliases = frame(spark, "entity_id string, normalized_alias string", ("e1", "ada"), ("e1", "adaking"), ("e2", "bob"))
    mentions = frame(spark, "commit_index int, record_id string, surface string, canonical_hint string", (1, "a", "Ada", ""), (2, "b", "she", "Ada King"), (2, "c", "ghost", ""), (3, "d", "Ada", ""))
    memories = frame(spark, "commit_index int, record_id string", (1, "m1"), (2, "m2"))
    links = frame(spark, "commit_index int, record_id string, memory_record_id string, entity string, canonical_entity string", (1, "l1", "m1", "Ada", ""), (2, "l2", "m2", "Bob", ""), (2, "l3", "m2", "nobody", ""))
    updates = frame(spark, "commit_index int, record_id string, source_entity_id string, target_entity_id string, relation_type string", (2, "u1", "e1", "e2", "trusts"), (3, "u2", "e1", "e2", "trusts"))
    log = prefix.commit_log(mentions, memories, links, updates, aliases)
    got = Counter((x.commit_index, x.operation) for x in log.collect())
    assert got == Counter({(1, "entity_created"): 1, (1, "entity_alias_added"): 1, (1, "entity_seen"): 1, (1, "memory_appended"): 1, (1, "entity_memory_linked"): 1, (2, "entity_seen"): 1, (2, "entity_ambiguous"): 1, (2, "entity_alias_added"): 2, (2, "memory_appended"): 1, (2, "entity_created"): 1, (2, "entity_memory_linked"): 1, (2, "entity_memory_link_unresolved"): 1, (2, "relationship_created"): 1, (3, "entity_seen"): 1, (3, "relationship_updated"): 1})
    assert {o for _, o in got} <= set(prefix.OPERATIONS)
    after = {x.entity_id: (x.first_seen_commit, x.last_seen_commit, x.mention_count, x.aliases, x.memory_count) for x in prefix.entity_states(log, F.lit(2)).collect()}
    assert after == {"e1": (1, 2, 2, ["Ada", "Ada King", "she"], 1), "e2": (2, 2, 0, [], 1)}


def test_ordered_run(spark):
    units = frame(spark, "run_id string, unit_id string, unit_index int, content string", ("r", "u1", 1, "Ada"), ("r", "u2", 2, "Bob"), ("r", "u3", 3, "bad"))

    class Model:
        def complete(self, prompt):
            task, _, rest = prompt.partition("|")
            if task == "entities":
                return "no json" if rest == "bad" else json.dumps({"entity_mentions": [{"surface": rest, "canonical_hint": "", "entity_type": "character"}]})
            return json.dumps({"seen": rest})

    say = lambda task: (lambda given, carried: F.concat(F.lit(f"{task}|"), given, F.lit("|"), carried))
    results, earlier = ordered.run_units(units, {"inventory": F.concat(F.lit("inventory|"), "content"), "entities": F.concat(F.lit("entities|"), "content")}, ("refine", say("refine")), {"memories": say("memories")}, Model, retries=0)
    got = {(x.unit_id, x.task): (x.status, json.loads(x.data)["seen"] if x.data and "seen" in x.data else None) for x in results.collect()}
    assert len(got) == 12 and got["u3", "entities"][0] == "failed" and sum(s == "parsed" for s, _ in got.values()) == 11
    assert "Ada" in got["u2", "refine"][1].split("|")[1] and "Ada" not in got["u1", "refine"][1].split("|")[1]
    assert '"seen"' in got["u2", "memories"][1]  # dependent tasks get the refined answer
    assert {(x.unit_id, x.name, x.last_unit) for x in earlier.collect()} == {("u2", "Ada", 1), ("u3", "Ada", 1), ("u3", "Bob", 2)} or {x.unit_id for x in earlier.collect()} <= {"u2", "u3"}


def test_index_upserts(spark, tmp_path):
    docs = frame(spark, "doc_id string, text string, seq int", ("a", "one two", 1), ("b", "three", 1), ("a", "one", 2))
    path = f"file://{tmp_path}/i"
    assert index.read_index(spark, path) is None
    first = index.upsert_index(docs, path, sequence="seq")
    assert {(x.doc_id, x.text) for x in first.collect()} == {("a", "one"), ("b", "three")}
    second = {x.doc_id: x for x in index.upsert_index(frame(spark, "doc_id string, text string, seq int", ("b", "changed", 3), ("c", "new", 3), ("a", "one", 9)), path, sequence="seq").collect()}
    assert {k: v.text for k, v in second.items()} == {"a": "one", "b": "changed", "c": "new"} and second["a"].seq == 9
    assert list(second["a"].embedding) == list(first.where("doc_id = 'a'").first().embedding) and index.read_index(spark, path).count() == 3
    ctx = frame(spark, "doc_id string, project_id string, status string, statement string", ("x", "p", "active", "s"), ("y", "p", "rejected", "s"), ("z", "q", "canonical", "s"))
    assert [x.doc_id for x in index.context_index(ctx, f"file://{tmp_path}/c", "p").collect()] == ["x"]


def test_rerank(spark):
    hits = frame(spark, "query_id int, query string, item_id string, statement string, score double", (1, "q", "a", "long text", 1.0), (1, "q", "b", "x", 2.0), (2, "q", "c", None, 0.5))

    class Long:
        def score(self, query, texts):
            return [len(t) for t in texts]

    class Broken:
        def score(self, query, texts):
            raise RuntimeError("down")

    top = lambda client: {(x.query_id, x.item_id, x.rank) for x in adapters.rerank(hits, client, 1).collect()}
    assert top(None) == top(Broken) == {(1, "b", 1), (2, "c", 1)} and top(Long) == {(1, "a", 1), (2, "c", 1)}


def test_prompts_profiles_and_cleaning(spark, tmp_path):
    from storyloom.functions import profiles

    p = prompts.Prompt.of({"template": "Hi {name}, {x} {other} {{a}}", "task_variables": [{"name": "name", "required": True}, {"name": "x"}], "static_variables": []})
    assert p.render(name="Ada", x={"a": 1}) == 'Hi Ada, {\n  "a": 1\n} {other} {{a}}' and p.render(strict=False) == "Hi ,  {other} {{a}}"
    with pytest.raises(ValueError):
        p.render()
    assert frame(spark, "n string", ("Bob",), (None,)).select(p.column(name="n").alias("s")).collect()[0].s == "Hi Bob,  {other} {{a}}"
    with pytest.raises(ValueError):
        prompts.Prompt.of({"template": " "})
    left, right = {"a": 1, "b": {"c": [1], "d": ""}, "e": "x"}, {"a": 2, "b": {"c": [1, 2], "d": "y"}, "e": "", "f": []}
    rows = frame(spark, "p array<string>", ([json.dumps(left), "no json", json.dumps(right), None],), ([],), (None,))
    got = [json.loads(x.m) for x in rows.select(profiles.merge_profiles("p").alias("m")).collect()]
    assert got == [{"a": [1, 2], "b": {"c": [1, 2], "d": "y"}, "e": "x"}, {}, {}]
    lists = frame(spark, "p array<string>", (["[1, 2, \"\"]", "2", "{\"a\": 1}", "null"],))
    assert json.loads(lists.select(profiles.merge_lists("p").alias("m")).first().m) == [1, 2, {"a": 1}]
    nested = spark.createDataFrame([(("a<SEP>b", ["c <SEP> d", None], {"k": "e<SEP>f"}, 3),), (None,)], "v struct<s: string, l: array<string>, m: map<string, string>, n: int>")
    v = [x.v for x in nested.select(text.cleaned("v", nested.schema["v"].dataType).alias("v")).collect()]
    assert (v[0].s, v[0].l, v[0].m, v[0].n, v[1]) == ("a；b", ["c；d", None], {"k": "e；f"}, 3, None)
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"entities": [{"name": "Ada", "alias": "A", "profile": {"role": "x"}}, {"no": 1}, "x"]}))
    (folder / "b.jsonl").write_text('{"canonical_name": "Bob", "type": "device", "id": "b1", "description": "d"}\n\n')
    (folder / "c.yaml").write_text("- name: Orb\n  entity_type: object\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        (folder / "c.yaml").unlink()
    got = {x.canonical_name: x for x in readers.author_entities(spark, f"file://{folder}").collect()}
    assert (got["Ada"].entity_type, got["Ada"].aliases, json.loads(got["Ada"].profile), got["Ada"].entity_id) == ("character", ["A", "Ada"], {"role": "x"}, "author_character_0001")
    assert (got["Bob"].entity_type, got["Bob"].entity_id, got["Bob"].description) == ("object", "b1", "d")
    assert {x.name for x in readers.author_mentions(readers.author_entities(spark, f"file://{folder}")).collect()} >= {"A", "Ada", "Bob"}


def test_schemas_and_reports(spark, tmp_path):
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.ArrayType(T.StringType(), False)), T.StructField("c", T.MapType(T.StringType(), T.DoubleType(), False), False), T.StructField("t", T.TimestampType())])
    made = writers.json_schema(kind)
    assert made["required"] == ["a", "c"] and made["properties"]["b"] == {"type": ["array", "null"], "items": {"type": "string"}} and made["properties"]["c"]["additionalProperties"] == {"type": "number"} and made["properties"]["t"]["format"] == "date-time"
    paths = writers.write_schemas({"x": kind}, str(tmp_path / "s"), {"status": ("b", "a")})
    assert json.loads(open(paths[0]).read())["title"] == "x" and json.loads(open(paths[1]).read()) == {"status": ["a", "b"]}
    packet_rows = frame(spark, "section string, rank int, item_id string, source_type string, statement string", ("style_guidance", 1, "i", "conversation", "be brief"))
    assert "## Style Guidance\n- be brief" in writers.context_markdown(packet_rows, "r") and "- i [conversation]" in writers.context_markdown(packet_rows)
    cards = frame(spark, "name string, field string, value string, status string, refs array<string>", ("Ada", "role_in_story", "captain", "explicit", ["M1"]))
    assert "- [explicit] captain (M1)" in writers.cards_markdown(cards)
    edges = frame(spark, "source string, target string, kind string, strength double", ("a", "b", "care_guidance", 0.8))
    beats = frame(spark, "beat_no int, source string, target string, opener string, answer string, selected boolean", (1, "a", "b", "1", "2", True), (1, "a", "b", "9", None, False))
    said = writers.social_markdown(edges, beats)
    assert "a -> b: care_guidance 0.800" in said and "1. a / b: 1, answered by 2" in said and "9" not in said
    order = frame(spark, "timeline_rank int, event_id string, summary string", (1, "e1", "start"))
    none = frame(spark, "type string, ids array<string>", ("cycle", ["e1", "e2"]))
    assert "- n: 3" in writers.timeline_markdown(order, none, frame(spark, "n int", (3,))) and "- cycle: e1, e2" in writers.timeline_markdown(order, none)
