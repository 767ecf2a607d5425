"""Functions and small operators that no query reaches, by hand."""

import io
import json
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyloom import schemas
from storyloom.functions import rules, text
from storyloom.operators import builders, context, entities, evidence, facades, fusion, ranking, relations, retrieval, social
from storyloom.sources import adapters, readers, writers


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_headings_roles_and_records(spark):
    r = one(
        spark,
        h=readers.parse_heading(F.lit("12、内 / 外.夜.走廊 深处")),
        n=readers.parse_heading(F.lit(" Prologue ")),
        a=readers.plain_turn(F.lit("AI: hi: there")),
        b=readers.plain_turn(F.lit("note: plain")),
        t=readers.record_text(F.lit('{"a": "x", "raw": "y", "n": null, "e": "", "k": 3}')),
    )
    assert tuple(r.h) == (12, "内/外", "夜", "走廊 深处") and tuple(r.n) == (None, None, None, "Prologue")
    assert tuple(r.a) == ("assistant", "hi: there") and tuple(r.b) == ("user", "note: plain") and r.t == "a: x\nk: 3"


def test_word_files_and_flat_json(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda s, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}<w:r><w:t>{s}</w:t></w:r></w:p>'
    body = p("Title", "Heading1") + p("Text one") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>" + p("")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.json").write_text(json.dumps([{"title": "T", "chunks": [{"chunk_id": "c1", "text": "one"}, "two"]}, "three"]))
    docs = {(d.format, d.record_index): d for d in readers.reference_documents(readers.reference_files(spark, f"file://{tmp_path}")).collect()}
    assert docs["docx", 0].content == "# Title\n\nText one\n\na | b" and [docs["json", i].content for i in range(3)] == ["one", "two", "three"]
    assert (docs["json", 0].title, docs["json", 0].heading, docs["json", 2].title) == ("T", "c1", "b.json") and docs["docx", 0].doc_id.startswith("ref_doc_")
    found = readers.source_filter(readers.reference_documents(readers.reference_files(spark, f"file://{tmp_path}")).withColumns({"relative_path": F.col("title"), "file_name": F.lit("f")}), paths=["T"])
    assert found.count() == 2
    (tmp_path / "run.json").write_text(json.dumps({"status": "parsed", "data": "x"}, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps({"status": "failed"}))
    assert [r.data for r in readers.read_parsed(spark, f"file://{tmp_path}/*.json", "status string, data string").collect()] == ["x"]
    out = f"file://{tmp_path}/lines"
    writers.write_jsonl(frame(spark, "a int, b string", (1, None), (2, "é")), out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"é"}']


def test_imports_of_declared_tables(spark, tmp_path):
    given = {"entities": frame(spark, "entity_id string, canonical_name string, extra int", ("e", "Ada", 1))}
    counts = dict(tuple(r) for r in writers.import_declared(given, schemas.UNITS, f"file://{tmp_path}/db").collect())
    assert set(counts) == set(schemas.UNITS) and counts["entities"] == 1 and sum(counts.values()) == 1
    assert spark.read.parquet(f"file://{tmp_path}/db/entities").columns == schemas.schema("entities").names
    with pytest.raises(KeyError):
        writers.import_declared({"nothing": spark.range(1)}, schemas.REFERENCES, f"file://{tmp_path}/x")
    s = writers.unit_summary(frame(spark, "content string, location_hint string", ("ab", "x"), ("c", "x"), (None, None))).first()
    assert (s.units, s.characters, s.location_count, s.locations) == (3, 3, 1, ["x"])


def test_texts_and_rules(spark):
    r = one(
        spark,
        high=text.high_level_keywords(F.lit("他们的关系是什么时候开始的"), F.array(F.lit("他"))),
        none=text.high_level_keywords(F.lit("x y"), F.array(F.lit("x"), F.lit("y"))),
        yes=text.looks_temporal(F.lit("long before that")),
        no=text.looks_temporal(F.lit("nothing")),
        labels=text.speaker_labels(F.lit("林远：好\n注释：x\nANN: y\n(a): z\nplain")),
        lines=text.collapse_blank_lines(F.lit("a\n\n\n\nb\n")),
        parts=text.split_field(F.lit("a<SEP><SEP>b")),
        hint=rules.supported_hint(F.lit("Ada"), F.lit("character"), F.lit("Ada King"), F.lit("")),
        bad=rules.supported_hint(F.lit("she"), F.lit("character"), F.lit("Ada King"), F.lit("nothing")),
        route=rules.mention_route(F.lit("林远"), F.lit("character"), F.lit(""), F.lit(""), F.lit(""), F.lit("林远")),
        risks=rules.text_risks(F.lit("放下过去，监护人说下一场")),
        shown=rules.displayable_property(F.lit(" Type "), F.lit("x")),
        bound=rules.is_time_bound(F.lit("uncertain")),
        rank=rules.status_rank(F.lit("canonical")),
        scenery=rules.environment_only(F.array(F.lit("太阳"), F.lit("林远"))),
    )
    assert r.high == ["关系", "关联", "时间", "时间线"] or set(r.high) >= {"关系", "时间"} and r.none == ["关系"]
    assert (r.yes, r.no, r.labels, r.lines, r.parts) == (True, False, ["林远", "ANN"], "a\n\nb", ["a", "b"])
    assert (r.hint, r.bad, r.route) == ("Ada King", "", "accepted") and {x.risk for x in r.risks} == {"therapy_tone", "unsupported_role", "future_leak"}
    assert (r.shown, r.bound, r.rank, r.scenery) == (False, True, 5, False)


def test_ranks_and_layers(spark):
    df = frame(spark, "k string, s double, n int, v string", ("a", 1.0, 1, "x"), ("a", 2.0, 2, "y"), ("a", 2.0, 3, "z"), ("b", 0.0, 1, "w"))
    assert {(r.k, r.v) for r in ranking.best_of(df, ["k"], "s", "n").collect()} == {("a", "y"), ("b", "w")}
    assert {r.v for r in ranking.first_wins(df, ["k"], [F.col("n")]).collect()} == {"x", "w"}
    placed = {(r.k, r.v): r.p for r in ranking.place_in(df, "k", ["n"], "p").collect()}
    assert placed == {("a", "x"): 1, ("a", "y"): 2, ("a", "z"): 3, ("b", "w"): 1}
    ids = frame(spark, "entity_id string, entity_type string, first_seen_order int, canonical_name string", ("1", "object", 2, "b"), ("2", "object", 1, "z"), ("3", "object", 2, "a"), ("4", "location", 1, "q"), ("5", "object", 9, "c"))
    assert [r.entity_id for r in retrieval.entity_list(ids, "object", 5).collect()] == ["2", "3", "1"]
    hits = frame(spark, "item_id string, section string, rank int", ("a", "facts", 2), ("b", "facts", 1), ("a", "entities", 1), ("c", "other", 1))
    assert [r.item_id for r in retrieval.flat_results(hits, ["facts", "entities"], 5).collect()] == ["b", "a"]
    assert {(r.pass_no, r.n) for r in fusion.pass_summary(hits.withColumns({"pass_no": F.lit(0), "pass_name": F.lit("base")})).collect()} == {(0, 1), (0, 2)}
    rel = frame(spark, "item_id string, statement string, subject string", ("a", "Ada sails", "x"), ("b", None, "the Orb"), ("c", "z", "y"))
    assert {r.item_id for r in fusion.relevant(rel, ["Ada", "Orb"], ("statement", "subject")).collect()} == {"a", "b"} and fusion.relevant(rel, [], ("statement",)).count() == 3
    roles = frame(spark, "item_id string, item_type string, statement string", ("a", "fact", "in 1999"), ("b", "chunk", "z"))
    assert Counter((r.item_id, r.role) for r in fusion.context_by_role(roles).collect()) == Counter([("a", "author"), ("b", "author"), ("a", "character"), ("a", "timeline")])
    ext = frame(spark, "item_id string, entity_ids array<string>, subject string, default_canon boolean", ("a", ["entity:ada"], "", True), ("b", [], "ADA's ship", True), ("c", [], "ship", False), ("d", [], "ship", True))
    assert {r.item_id for r in retrieval.keep_external(ext, ["entity:ada"]).collect()} == {"a", "b", "c"} and retrieval.keep_external(ext, []).count() == 4
    know = frame(spark, "i int, known_to array<string>", (1, ["all"]), (2, []), (3, None), (4, ["Bob"]), (5, ["Ada"]))
    assert {r.i for r in retrieval.known_to(know, "Ada").collect()} == {1, 2, 3, 5}


def test_statements_of_items(spark):
    fields = ["src_id", "tgt_id", "description", "entity_name", "entity_type", "property_name", "property_value", "content", "canonical_display_name", "global_pseudo_degree", "source_coverage", "notice", "statement"]
    schema = "kind string, r struct<" + ", ".join(f"{f}: string" for f in fields) + ">"
    make = lambda **v: tuple(v.get(f) for f in fields)
    rows = [
        ("relationship", make(src_id="a", tgt_id="b", description="x<SEP>y"), "a - b: x；y"), ("relationship", make(src_id="a"), "a"), ("entity", make(entity_name="Ada", entity_type="character", description="d"), "Ada (character): d"),
        ("property", make(entity_name="Ada", property_name="age", property_value="3"), "Ada.age: 3"), ("chunk", make(content="c"), "c"), ("graph_insight", make(canonical_display_name="Ada", global_pseudo_degree="2", source_coverage="1"), "Ada: graph degree=2, source coverage=1"),
        ("source_note", make(canonical_display_name="Ada", notice="n"), "Ada: n"), ("fact", make(description="d"), "d"), ("fact", make(), ""),
    ]
    got = frame(spark, f"i int, {schema}", *((i, k, r) for i, (k, r, _) in enumerate(rows))).select("i", fusion.statement_of("kind", "r", fields).alias("s"))
    assert [r.s for r in got.orderBy("i").collect()] == [w for *_, w in rows]


def test_vectors_in_scopes(spark):
    docs = frame(spark, "doc_id string, memory_id string, embedding array<double>", ("d1", "m1", [1.0, 0.0]), ("d2", "m2", [0.0, 1.0]), ("d3", "m3", [1.0, 0.1]))
    links = frame(spark, "entity_id string, memory_id string", ("e", "m1"), ("e", "m1"), ("e", "m2"), ("f", "m3"))
    queries = frame(spark, "query_id int, entity_id string, query_vector array<double>", (1, "e", [1.0, 0.2]), (2, "f", [0.0, 1.0]), (3, "none", [1.0, 1.0]))
    assert {(r.query_id, r.doc_id, r.rank) for r in retrieval.entity_vector_top(docs, links, queries, 1).collect()} == {(1, "d1", 1), (2, "d3", 1)}
    items = frame(spark, "item_id string, project_id string, source_type string, status string, visibility string, entity_ids array<string>, unit_order int, embedding array<double>", ("a", "p", "conversation", "active", "x", ["e"], 1, [1.0, 0.0]), ("b", "p", "conversation", "rejected", "x", ["e"], 1, [1.0, 0.0]), ("c", "p", "simulation", "active", "x", [], None, [0.9, 0.1]), ("d", "q", "simulation", "active", "x", [], 1, [1.0, 0.0]), ("e", "p", "conversation", "active", "x", ["e"], 9, [1.0, 0.0]))
    q = frame(spark, "query_id int, query_vector array<double>", (1, [1.0, 0.0]))
    assert [r.item_id for r in retrieval.context_vector_top(items, q, 5, "p", bound=5).orderBy("rank").collect()] == ["a", "c"]
    assert [r.item_id for r in retrieval.context_vector_top(items, q, 5, "p", entities=["e"]).orderBy("rank").collect()] == ["a", "e"]


def test_gaps_assets_and_documents(spark):
    spans = "array<struct<field: string, start: int, end: int>>"
    rows = frame(spark, f"i int, s {spans}, t string", (1, [("content", 0, 2), ("content", 5, 7)], "ab xx cd"), (2, [("content", 0, 2), ("title", 5, 7)], "ab xx cd"), (3, [("content", 0, 1)], "ab"), (4, [("content", 0, 1), ("content", 60, 61)], "a" * 70))
    got = {r.i: r.g for r in rows.select("i", evidence.fill_gap("s", "t").alias("g")).collect()}
    assert (got[1].start, got[1].end, got[1].aligned) == (0, 7, "ab xx c") and got[2] is None and got[3] is None and got[4] is None
    ents = frame(spark, "entity_name string, descriptions array<string>", ("Ada", ["a captain", "tall"]))
    facts = relations.facts_from_descriptions(ents).collect()
    assert {(f.subject, f.predicate, f.object, f.statement, f.confidence) for f in facts} == {("Ada", "described_as", "a captain", "Ada a captain", 0.7), ("Ada", "described_as", "tall", "Ada tall", 0.7)}
    e = frame(spark, "entity_id string, entity_name string, entity_type string, description string", ("e", "Ada", "character", ""))
    r = frame(spark, "relation_id string, src_id string, tgt_id string, keywords string, description string", ("r", "a", "b", "k", "d"))
    f = frame(spark, "fact_id string, subject string, statement string", ("f", "s", "t"))
    p = frame(spark, "property_id string, entity_name string, property_name string, statement string", ("p", "e", "n", "s"))
    c = frame(spark, "cluster_id string, canonical_display_name string, aliases array<string>", ("c", "n", ["x", "y"]))
    u = frame(spark, "pseudo_relation_id string, a string, b string", ("u", "a", "b"))
    h = frame(spark, "chunk_id string, title string, heading string, content string", ("h", "t", "", "body"))
    docs = {d.vector_namespace: d for d in builders.vector_documents(h, e, r, f, p, c, u).collect()}
    assert len(docs) == 7 and docs["chunks"].content == "t\nbody" and docs["entity_clusters"].content == "n\nx, y" and docs["source_local_relationships"].content == "a -> b\nk\nd"
    items = frame(spark, "item_id string, unit_id string", ("i", "u"), ("j", "gone"))
    units = frame(spark, "unit_id string, unit_order int", ("u", 4), ("u", 4))
    assert {(d.doc_id, d.unit_order) for d in builders.context_documents(items, units).collect()} == {("ctx_doc:i", 4), ("ctx_doc:j", None)}
    meta = builders.scene_metadata((frame(spark, "scene_id string, t string", ("s", None)), {"title": F.col("t")}), (frame(spark, "scene_id string, t string", ("s", "late")), {"title": F.col("t"), "n": F.lit(3)}))
    assert [(m.title, m.n) for m in meta.collect()] == [("late", "3")]
    classes = frame(spark, "scene_id string, writing_eval_policy string", ("s1", "include"), ("s2", "include"), ("s3", "exclude"))
    place = frame(spark, "scene_id string, source_record_id int, content string", ("s1", 2, "ab"), ("s2", 1, "c"), ("s3", 3, "d"))
    assert [b.scene_id for b in builders.benchmark_targets(classes, place).collect()] == ["s2", "s1"] and [b.scene_id for b in builders.benchmark_targets(classes, place, start=2, limit=1).collect()] == ["s1"]
    base = frame(spark, "ordinal int, record_id string", (1, "a"), (2, "b"))
    assert sorted((x.ordinal, x.record_id) for x in builders.extend_run(base, frame(spark, "record_id string", ("d",), ("c",)).withColumn("ordinal", F.lit(0))).collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    inv = builders.scene_inventory(frame(spark, "scene_id string, setting string, stated_facts array<struct<proposition: string>>, open_questions array<struct<question: string>>", ("s", "x", [("p",), ("q",)], [])))
    assert [x.record_id for x in inv["stated_facts"].orderBy("item_index").collect()] == ["s_fact_001", "s_fact_002"] and inv["open_questions"].count() == 0
    m = builders.collect_mentions({"kg": (frame(spark, "scene_id string, n string, k string", ("s", " Ada ", "device"), ("s", " ", "x")), "n", F.col("k"))})
    assert [(x.name, x.entity_type, x.source) for x in m.collect()] == [("Ada", "object", "kg")]


def test_boards_links_and_claims(spark):
    clusters = frame(spark, "cluster_id string, canonical_display_name string, global_pseudo_degree long, evidence_degree long, source_coverage long", ("c", "Ada", 5, 1, 2), ("d", "Bob", 9, 1, 1))
    board = facades.evidence_board(clusters).collect()
    assert [b.cluster_id for b in board] == ["d", "c"] and board[0].notice is None and "2 source scopes" in board[1].notice
    rels = frame(spark, "source_local_relation_id string", ("r",), ("r",))
    facts = frame(spark, "fact_id string, source_local_relation_id string, source_chunk_id string, score double", ("f1", "r", "k", 1.0), ("f2", "r", "gone", 2.0), ("f3", "x", "k", 9.0))
    chunks = frame(spark, "chunk_id string, content string", ("k", "body"))
    assert [(x.fact_id, x.evidence_chunk) for x in facades.relationship_facts(rels, facts, chunks, 5).collect()] == [("f2", None), ("f1", "body")]
    items = frame(spark, "item_id string, item_type string, subject string, statement string, entity_ids array<string>", ("a", "timeline_doc", "Ada", "in 2058", []), ("b", "fact", "", "x", ["e1", "e2"]), ("c", "fact", " ", "x", []))
    assert {(x.item_id, x.entity_id) for x in context.external_links(items).collect()} == {("a", "external_subject:Ada"), ("b", "e1"), ("b", "e2")}
    assert [(x.item_id, x.timeline_hint) for x in context.timeline_claims(items).collect()] == [("a", "2058")]


def test_questions_with_citations(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Crew\nAda King is the captain of the Aurora.", encoding="utf-8")
    (tmp_path / "b.txt").write_text("Nothing of use.", encoding="utf-8")
    refs = facades.ExternalReferences(spark)
    refs.add(f"file://{tmp_path}")
    got = refs.ask("who is Ada King captain", answer=lambda prompt: " from: " + prompt.partition("[E1]")[2])
    assert got["answer_mode"] == "source_grounded_llm" and got["citations"][0]["ref"] == "E1" and "Ada King" in got["answer"] and got["items"][0]["default_canon"] is False
    assert refs.ask("who is Ada King captain")["answer"] == ""
    refs.add(f"file://{tmp_path}/b.txt", reset=True)
    assert refs.get_all().count() == 1


def test_model_calls(spark):
    prompts = frame(spark, "prompt_id int, prompt string", (1, "a"), (2, "b"))
    cache = prompts.where("prompt_id = 1").select(F.sha2("prompt", 256).alias("prompt_sha"), F.lit("known").alias("response"))
    got = {r.prompt_id: (r.response, r.status, r.attempts) for r in adapters.complete_cached(prompts, cache, lambda: adapters.FakeModel(default="new")).collect()}
    assert got == {1: ("known", "cached", 0), 2: ("new", "ok", 1)}

    class Lengths:
        def embed_documents(self, texts):
            return [[float(len(t))] for t in texts]

    rows = frame(spark, "id int, text string", (1, "ab"), (2, "c"), (3, ""))
    assert {r.id: list(r.embedding) for r in adapters.embed(rows, Lengths, batch_size=2).collect()} == {1: [2.0], 2: [1.0], 3: [0.0]}


def test_resolution_artifacts(spark):
    rows = [("1", "Ada King", "character", "s2", "kg", "e", "the  captain"), ("2", "King, Ada", "character", "s1", "kg", "e", "tall"), ("3", "Ada King", "group", "s3", "author_defined", "", "The captain"), ("4", "she", "character", "s1", "kg", "e", ""), ("5", "she", "character", "s2", "kg", "e", ""), ("6", "Orb 7", "object", "s1", "kg", "e", None)]
    made = entities.resolution_artifacts(frame(spark, "record_id string, name string, entity_type string, scene_id string, source string, evidence string, description string", *rows))
    ents = {e.canonical_name: e for e in made["entities"].collect()}
    assert len(ents) == 3 or len(made["entities"].collect()) == 4
    assert (ents["King, Ada"].entity_type, ents["King, Ada"].mention_count, ents["King, Ada"].scene_ids) == ("character", 3, ["s1", "s2", "s3"]) and Counter(x.lower() for x in ents["King, Ada"].descriptions) == Counter(["tall", "the captain"])
    traces = {t.record_id: t.entity_id for t in made["traces"].collect()}
    assert traces["1"] == traces["2"] == traces["3"] and traces["4"] != traces["5"] and traces["6"].startswith("object_")
    assert {a.alias for a in made["aliases"].where(F.col("entity_id") == traces["1"]).collect()} >= {"Ada King", "King", "Ada"} and not any(a.alias == "she" for a in made["aliases"].collect())


def test_social_graph(spark):
    schema = "scene string, name string, intent string, texts array<string>, refs array<string>, stances array<struct<target: string, text: string, refs: array<string>>>"
    cards = frame(spark, schema, ("s", "A", "两人返航", ["他抗拒返航，很急"], ["M1", "M2", "M3"], [("B", "关系紧张", ["M1"])]), ("s", "B", "两人返航", ["他提醒对方稳住"], [], [("A", "照顾后辈", None), (" ", "x", None)]), ("t", "C", "", None, None, None))
    states = {x.name: x for x in social.state_graph(cards).collect()}
    assert round(states["A"].resistance, 2) == 0.37 and round(states["A"].arousal, 2) == 0.57 and states["A"].support_count == 3 and round(states["A"].compliance, 2) == 0.53 and states["C"].support_count == 0
    known = social.stances(cards)
    assert {(x.source, x.target, round(x.trust, 2), round(x.care, 2)) for x in known.collect()} == {("A", "B", 0.57, 0.25), ("B", "A", 0.69, 0.49)}
    edges = social.pressure_graph(social.state_graph(cards), known)
    got = {(x.source, x.target): x for x in edges.collect()}
    assert got["A", "B"].kind == "value_resistance" and got["A", "B"].memory_supported and got["B", "A"].kind == "care_guidance"
    strength = 0.35 * min(1.0, 0.45 + 0.15 * 2) + 0.25 * (0.35 + 0.12 * 3) + 0.2 * 0.57 + 0.07 + 0.1 * 0.57
    assert abs(got["A", "B"].strength - strength) < 0.08
    acts = social.action_candidates(social.state_graph(cards), edges)
    kinds = {n: {x.action_type for x in acts.where(F.col("actor") == n).collect()} for n in "ABC"}
    assert {"risky_operation", "physical_reaction", "value_resistance"} <= kinds["A"] and {"safety_correction", "care_reframe"} <= kinds["B"] and kinds["C"] == {"silence_or_withholding"} and all(len(k) <= 6 for k in kinds.values())
    assert all(0 <= x.score <= 1 for x in acts.collect())
    beats = social.beat_sequences(edges, acts, "scene")
    m = {x.scene: x for x in social.social_metrics(social.state_graph(cards), edges, acts, beats).collect()}
    assert (m["s"].character_count, m["s"].pressure_edge_count, m["t"].candidate_action_count) == (2, 2, 1) and m["s"].selected_beat_count >= 1
    steps = social.writer_packet(beats, acts, {"care_reframe": "say it by doing"}).collect()
    assert steps and {x.scene for x in steps} <= {"s", "t"} and all(x.step in (1, 2) for x in steps)
    sims = frame(spark, "scene string, name string, text string, refs array<string>", ("s", "A", "放下过去", ["M1"]), ("s", "B", "好", ["M9", "M9"]), ("s", "C", "好", None))
    allowed = frame(spark, "scene string, ref string", ("s", "M1"))
    assert {x.name: (x.hard, x.soft, x.status) for x in social.verification(sims, allowed).collect()} == {"A": (0, 1, "warn"), "B": (1, 0, "fail"), "C": (0, 0, "pass")}
    roles = one(spark, d=social.demoted_roles(F.array(F.lit("老师"), F.lit("同伴")), F.lit("他是同伴"))).d
    assert (roles.kept, roles.demoted) == (["同伴"], ["老师"])
