"""The social model: term scores, pressure edges between characters, beat sequences, verification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.rules import text_risks
from ..functions.text import contains_any, count_contained, text_of


def term_score(text: Column | str, terms: Sequence[str], default: float = 0.35) -> Column:
    """``default`` plus 0.12 for every term that occurs, at most 1."""
    hits = count_contained(text_of(text), terms)
    return F.when(hits > 0, F.least(F.lit(1.0), default + 0.12 * hits)).otherwise(F.lit(default))


def support_score(count: Column) -> Column:
    """0.45 + 0.15 * log2(n + 1), at most 1; 0.2 without support."""
    return F.when(count > 0, F.least(F.lit(1.0), 0.45 + 0.15 * F.log2(count + 1))).otherwise(F.lit(0.2))


def pressure_strength(support: Column, relevance: Column, salience: Column, urgency: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.35 * support + 0.25 * relevance + 0.20 * salience + 0.10 * 0.7 + 0.10 * urgency), 3)


def pressure_edges(characters: DataFrame, scene: Sequence[str], intent_urgency: Column | None = None, drop_below: float = 0.35, high: float = 0.75) -> DataFrame:
    """Ordered pairs of the characters of one scene with the pressure of the first on the second.

    ``characters``: the scene's keys, name, support_count, relevance, care, trust, arousal. Pairs arise only within a scene.
    """
    a, b = characters.alias("a"), characters.alias("b")
    on = F.col("a.name") != F.col("b.name")
    for key in scene:
        on = on & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    urgency = F.greatest(F.col("a.arousal"), F.col("b.arousal"), *([] if intent_urgency is None else [intent_urgency]))
    relevance = F.greatest(F.col("a.relevance"), F.col("b.relevance"))
    strength = pressure_strength(support_score(F.col("a.support_count")), relevance, F.greatest(F.col("a.care"), F.col("a.trust")), urgency)
    pairs = a.join(b, on).select(*(F.col(f"a.{k}").alias(k) for k in scene), F.col("a.name").alias("source"), F.col("b.name").alias("target"), strength.alias("strength"))
    return pairs.where(F.col("strength") >= drop_below).withColumn("priority", F.when(F.col("strength") >= high, "high").otherwise("normal"))


#: Default scores of a card's text by term group, with the terms (fixed values).
STATE_TERMS = {
    "resistance": (vocab.RESISTANCE_TERMS, 0.25), "arousal": (("紧张", "急", "压", "危险", "告警", "警报"), 0.45), "negative_valence": (("厌", "不美好", "废墟", "危险", "压抑"), 0.35),
    "risk_tolerance": (("危险", "冒险", "低空", "快", "急", "不稳"), 0.35), "non_compliance": (vocab.RESISTANCE_TERMS, 0.35),
}
STANCE_TERMS = {"trust": (vocab.CARE_TERMS + vocab.RELATION_TERMS, 0.45), "resistance": (vocab.RESISTANCE_TERMS, 0.25), "care": (vocab.CARE_TERMS, 0.25)}
RESISTING, STEADYING, PASSIVE = ("不美好", "地球", "抗拒", "不服", "冷硬", "向往", "想上去"), ("稳", "慢", "安全", "危险", "高度", "姿态", "告警", "警报"), ("受", "被", "接受")
RISKY, TENSE, HASTY = ("偏快", "冒险", "危险行为", "不服", "抗拒", "不美好", "地球", "向往", "想上去", "急"), ("互动", "张力", "情绪", "抗拒", "劝"), ("急", "危险", "快")


def state_graph(cards: DataFrame) -> DataFrame:
    """Characters of scenes with the scores of their social state.

    ``cards``: scene, name, intent (the scene's), texts (what the card and its simulation say), refs (memories that support
    it). Adds ``text``, support_count, resistance, arousal, negative_valence, risk_tolerance, compliance.
    """
    said = cards.withColumn("text", F.array_join(F.coalesce("texts", F.array().cast("array<string>")), " "))
    whole = F.concat_ws(" ", "text", "intent")
    scored = said.select("scene", "name", "intent", "text", F.size(F.coalesce("refs", F.array().cast("array<string>"))).alias("support_count"), *(term_score(whole, terms, default).alias(n) for n, (terms, default) in STATE_TERMS.items()))
    return scored.withColumn("compliance", 1.0 - F.col("non_compliance")).drop("non_compliance")


def stances(cards: DataFrame) -> DataFrame:
    """``scene, source, target, stance, refs, trust, resistance, care`` of every stance (target, text, refs) that a card has of someone."""
    rows = cards.select("scene", F.col("name").alias("source"), F.explode("stances").alias("s")).where(F.trim(text_of("s.target")) != "")
    return rows.select("scene", "source", F.trim("s.target").alias("target"), text_of("s.text").alias("stance"), F.col("s.refs").alias("refs"), *(term_score("s.text", terms, default).alias(n) for n, (terms, default) in STANCE_TERMS.items()))


def pressure_type(source: Column, target: Column, stance: Column, intent: Column, carers: Sequence[str] = (), name: Column | None = None) -> Column:
    """What kind of pressure one character puts on another, by cues in the order of their weight; ``carers`` are names that guide where others correct."""
    cares = (stance != "") & ~contains_any(stance, PASSIVE) & contains_any(stance, vocab.CARE_TERMS)
    every = F.concat_ws(" ", source, target, stance, intent)
    guide = name.isin(*carers) if carers and name is not None else F.lit(False)
    return (
        F.when(cares, "care_guidance")
        .when(contains_any(source, RESISTING), "value_resistance")
        .when(contains_any(every, STEADYING), F.when(guide, "care_guidance").otherwise("safety_correction"))
        .when(contains_any(every, vocab.RESISTANCE_TERMS), "value_resistance")
        .when(stance != "", "care_guidance")
        .otherwise("information_probe")
    )


def pressure_graph(states: DataFrame, known: DataFrame, carers: Sequence[str] = (), drop_below: float = 0.35, high: float = 0.75) -> DataFrame:
    """Pressure edges among the characters of each scene from their states and stances: ``scene, source, target, kind, strength, priority, memory_supported``."""
    s, t = states.alias("s"), states.alias("t")
    pairs = s.join(t, (F.col("s.scene") == F.col("t.scene")) & (F.col("s.name") != F.col("t.name"))).select(F.col("s.scene").alias("scene"), F.col("s.name").alias("source"), F.col("t.name").alias("target"), F.col("s.intent").alias("intent"), F.col("s.text").alias("said"), F.col("t.text").alias("heard"), F.col("s.support_count").alias("support_count"), F.greatest("s.arousal", "t.arousal").alias("arousal"))
    rows = pairs.join(known.select("scene", "source", "target", "stance", "trust", "care").dropDuplicates(["scene", "source", "target"]), ["scene", "source", "target"], "left")
    stance = text_of("stance")
    relevance = term_score(F.concat_ws(" ", "intent", "said", "heard"), vocab.SAFETY_TERMS + vocab.RESISTANCE_TERMS)
    salience = F.when(F.col("stance").isNull(), 0.0).otherwise(F.greatest("care", "trust", F.lit(0.25)))
    strength = pressure_strength(support_score(F.col("support_count")), relevance, salience, F.greatest("arousal", term_score("intent", vocab.SAFETY_TERMS)))
    made = rows.select("scene", "source", "target", pressure_type(F.col("said"), F.col("heard"), stance, F.col("intent"), carers, F.col("source")).alias("kind"), strength.alias("strength"), (F.col("support_count") > 0).alias("memory_supported"))
    return made.where(F.col("strength") >= drop_below).withColumn("priority", F.when(F.col("strength") >= high, "high").otherwise("normal"))


def candidate_types(text: Column, intent: Column, out: Column, into: Column, most: int = 6) -> Column:
    """Kinds of actions that a character may take, ``most`` at most, by its text and the kinds of pressure it gives (``out``) and takes (``into``)."""
    both = F.concat_ws(" ", text, intent)
    risky = F.array_contains(out, "value_resistance") | contains_any(text, RISKY)
    gives = F.size(out) > 0
    some = lambda cond, *kinds: F.when(cond, F.array(*map(F.lit, kinds))).otherwise(F.array().cast("array<string>"))
    parts = [
        some(risky, "risky_operation", "physical_reaction"),
        some(F.arrays_overlap(out, F.array(F.lit("safety_correction"), F.lit("care_guidance"))), "safety_correction", "care_reframe"),
        some(contains_any(both, vocab.RESISTANCE_TERMS), "value_resistance", "deflection", "minimal_compliance"),
        some(gives, "information_probe"),
        some(F.array_contains(into, "value_resistance") & ~risky, "safety_correction", "care_reframe", "physical_reaction"),
        some(contains_any(intent, vocab.SAFETY_TERMS), "physical_reaction"),
        some(F.lit(True), "silence_or_withholding"),
    ]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, most)


def action_candidates(states: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """``scene, action_id, actor, action_type, score`` of every action that the characters of a scene may take.

    Score: 0.30 alignment with the intent, 0.25 motivation, 0.20 support, 0.10 productivity, 0.07, less 0.1 for each risk.
    """
    given = edges.groupBy("scene", F.col("source").alias("name")).agg(F.collect_set("kind").alias("out"), F.max("strength").alias("gives"))
    taken = edges.groupBy("scene", F.col("target").alias("name")).agg(F.collect_set("kind").alias("into"), F.max("strength").alias("takes"))
    none = F.array().cast("array<string>")
    rows = states.join(given, ["scene", "name"], "left").join(taken, ["scene", "name"], "left").withColumns({"out": F.coalesce("out", none), "into": F.coalesce("into", none)})
    rows = rows.withColumn("action_type", F.explode(candidate_types(F.col("text"), F.col("intent"), F.col("out"), F.col("into"), most)))
    kind, text, intent = F.col("action_type"), F.col("text"), F.col("intent")
    aligned = F.when(kind.isin("risky_operation", "safety_correction", "physical_reaction"), term_score(intent, vocab.SAFETY_TERMS, 0.45)).when(kind.isin("value_resistance", "deflection", "minimal_compliance"), term_score(intent, TENSE, 0.45)).when(kind == "care_reframe", term_score(intent, vocab.CARE_TERMS + TENSE[:2], 0.45)).otherwise(0.45)
    moved = F.when(kind.isin("risky_operation", "value_resistance", "deflection"), term_score(text, vocab.RESISTANCE_TERMS + HASTY, 0.45)).when(kind.isin("safety_correction", "care_reframe"), F.greatest(F.coalesce("gives", F.lit(0.0)), term_score(text, vocab.CARE_TERMS, 0.45))).otherwise(term_score(text, vocab.RELATION_TERMS + vocab.SAFETY_TERMS, 0.45))
    strongest = F.coalesce(F.greatest("gives", "takes"), F.lit(0.35))
    useful = F.when(kind.isin("risky_operation", "safety_correction", "value_resistance", "care_reframe"), F.greatest(F.lit(0.65), strongest)).otherwise(F.greatest(F.lit(0.35), strongest - 0.1))
    risks = F.size(F.filter(text_risks(text), lambda r: r["risk"] != "future_leak")) + kind.isin("value_resistance", "deflection").cast("int")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.30 * aligned + 0.25 * moved + 0.20 * support_score(F.col("support_count")) + 0.10 * useful + 0.10 * 0.7 - 0.1 * risks)), 3)
    return rows.select("scene", F.concat_ws(":", "name", "action_type").alias("action_id"), F.col("name").alias("actor"), "action_type", score.alias("score"))


def social_metrics(states: DataFrame, edges: DataFrame, actions: DataFrame, beats: DataFrame) -> DataFrame:
    """Counts and scores of each scene's plan: characters, edges, candidates, sequences, chosen beats, best score and its margin."""
    n = lambda df, name: df.groupBy(F.col("scene").cast("string").alias("scene")).agg(F.count("*").alias(name))
    options = beats.select("scene", "strategy", "score", "selected").distinct()
    best = options.groupBy("scene").agg(F.count("*").alias("candidate_sequence_count"), F.max(F.when(F.col("selected"), F.col("score"))).alias("selected_sequence_score"), F.max(F.when(~F.col("selected"), F.col("score"))).alias("__next"))
    margin = F.round(F.col("selected_sequence_score") - F.coalesce("__next", F.lit(0.0)), 3)
    out = n(states, "character_count").join(n(edges, "pressure_edge_count"), "scene", "left").join(n(actions, "candidate_action_count"), "scene", "left")
    out = out.join(n(beats.where("selected"), "selected_beat_count"), "scene", "left").join(best.withColumn("score_margin", margin).drop("__next"), "scene", "left")
    return out.na.fill(0)


def writer_packet(beats: DataFrame, actions: DataFrame, guidance: Mapping[str, str] = {}) -> DataFrame:
    """What a writer gets of the chosen beats, one row an action: ``scene, beat_no, step, actor, action_type, guidance``; never final dialogue."""
    steps = beats.where("selected").select("scene", "beat_no", F.posexplode(F.array_compact(F.array("opener", "answer"))).alias("at", "action_id"))
    told = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in guidance.items() for x in kv]), F.col("action_type")), F.col("action_type")) if guidance else F.col("action_type")
    return steps.join(actions.select(F.col("scene").cast("string").alias("scene"), "action_id", "actor", "action_type"), ["scene", "action_id"]).select("scene", "beat_no", (F.col("at") + 1).alias("step"), "actor", "action_type", told.alias("guidance"))


def merged_effects(actions: DataFrame, by: Sequence[str], kind: str = "action_type") -> DataFrame:
    """The summed effects of actions by effect name."""
    entries = [F.struct(F.lit(a).alias("a"), F.lit(e).alias("effect"), F.lit(v).alias("v")) for a, es in vocab.EFFECTS.items() for e, v in es.items()]
    rows = actions.select(*by, F.explode(F.filter(F.array(*entries), lambda r: r["a"] == F.col(kind))).alias("r"))
    return rows.groupBy(*by, F.col("r.effect").alias("effect")).agg(F.round(F.sum("r.v"), 3).alias("value"))


VARIANTS = ("pressure_default", "relationship_first", "resistance_first", "score_first", "care_posture", "low_directive")
BEATS = "strategy string, score double, beat_no int, source string, target string, opener string, answer string, selected boolean"


#: Kinds of actions that each cautious strategy prefers (fixed values).
CARING, LOW = ("care_reframe", "safety_correction"), ("physical_reaction", "silence_or_withholding", "minimal_compliance")


def _by_type(options: list[tuple], types: Sequence[str]) -> tuple | None:
    """The option of the first type in the order given, of equals the best score; None if no option has such a type."""
    return min((o for o in options if o[2] in types), key=lambda o: (types.index(o[2]), -o[3]), default=None)


def _opener(options: list[tuple], source: str, kind: str, strategy: str) -> tuple:
    """Who begins a beat: an action of the source by the strategy, else any of the source's, else one of the other's."""
    mine = [o for o in options if o[1] == source]
    if strategy == "score_first":
        return (mine or options)[0]
    if strategy in ("care_posture", "low_directive"):
        wanted = [o for o in mine if o[2] in (CARING if strategy == "care_posture" else LOW)]
        if wanted:
            return max(wanted, key=lambda o: o[3])
    return _by_type(mine, vocab.BEAT_OPENERS.get(kind, ())) or (mine or options)[0]


def _answer(options: list[tuple], first: tuple, target: str, kind: str, strategy: str) -> tuple | None:
    """What answers it, of the target's other actions."""
    theirs = [o for o in options if o[1] == target and o[0] != first[0]]
    if strategy == "low_directive":
        return next((o for o in theirs if o[2] in LOW), None)
    return _by_type(theirs, vocab.BEAT_ANSWERS.get(kind, vocab.BEAT_ANSWERS_ELSE)) or (theirs[0] if theirs else None)


def sequence_score(beats: list[tuple], hard: int = 0, warnings: int = 0, supported: bool = True, style_risks: int = 0) -> float:
    """Coverage 0.4, arc 0.3 (0.15), faithfulness 0.2, base 0.1, support 0.05, less 0.03 for each warning (0.2 at most) and 0.04 for each risk of style (0.15)."""
    if not beats:
        return 0.0
    covers = any(b[3] in vocab.PROBLEM_FUNCTIONS for b in beats)
    pairs = any(b[0] and b[1] for b in beats)
    score = 0.4 * covers + (0.3 if pairs else 0.15) + 0.2 * (not hard) + 0.1 + 0.05 * supported - min(0.2, 0.03 * warnings) - min(0.15, 0.04 * style_risks)
    return round(max(0.0, min(1.0, score)), 3)


def beat_options(links: list[tuple], pool: list[tuple], most: int = 5) -> list[tuple]:
    """Sequences of beats by all strategies, the best first: ``strategy, score, beats, picks``; repeats of the same actions go.

    ``links``: source, target, strength, kind; ``pool``: id, actor, kind, score. A beat takes an action of either member of
    its link and, if there is one, an answer of the target; no action opens two beats. Without links the three best
    actions stand alone.
    """
    pool = sorted(pool, key=lambda o: (-o[3], o[0]))
    if not links:
        beats = [(o[1], None, o[3], o[2]) for o in pool[:3]]
        return [("fallback_top_candidates", sequence_score(beats), beats, [(o[0], None) for o in pool[:3]])] if beats else []
    links = sorted(links, key=lambda b: (-b[2], b[0], b[1]))
    front = {"relationship_first": ("care_guidance", "safety_correction"), "resistance_first": ("value_resistance", "risky_operation")}
    found: dict[tuple, tuple] = {}
    for strategy in VARIANTS:
        used: set[str] = set()
        beats, picks = [], []
        for b in sorted(links, key=lambda b: b[3] not in front.get(strategy, (b[3],)))[:most]:
            options = [o for o in pool if o[1] in (b[0], b[1]) and o[0] not in used]
            if not options:
                continue
            one = _opener(options, b[0], b[3], strategy)
            two = _answer(options, one, b[1], b[3], strategy)
            used |= {o[0] for o in (one, two) if o}
            beats.append(b)
            picks.append((one[0], two[0] if two else None))
        if beats:
            found.setdefault(tuple(picks), (strategy, sequence_score(beats), beats, picks))
    return sorted(found.values(), key=lambda s: (-s[1], -sum(b[2] for b in s[2]), VARIANTS.index(s[0])))


def beat_sequences(edges: DataFrame, actions: DataFrame, scene: str, most: int = 5) -> DataFrame:
    """Six orderings of a scene's edges, each covered greedily by actions; duplicates go; the best comes out selected.

    A scene's cast and so its edges and actions are one small group. ``edges``: scene, source, target, kind, strength;
    ``actions``: scene, action_id, actor, action_type, score.
    """
    e = edges.select(F.col(scene).cast("string").alias("scene"), "source", "target", "kind", F.col("strength").cast("double").alias("x"), F.lit(None).cast("string").alias("action_id"))
    a = actions.select(F.col(scene).cast("string").alias("scene"), F.col("actor").alias("source"), F.lit(None).cast("string").alias("target"), F.col("action_type").alias("kind"), F.col("score").cast("double").alias("x"), "action_id")
    names = [f.split()[0] for f in BEATS.split(", ")]

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = [(r.action_id, r.source, r.kind, r.x) for r in pdf[pdf["action_id"].notna()].itertuples()]
        links = [(r.source, r.target, r.x, r.kind) for r in pdf[pdf["action_id"].isna()].itertuples()]
        best = beat_options(links, pool, most)
        rows = [(s[0], s[1], n, b[0], b[1], p[0], p[1], s is best[0]) for s in best for n, (b, p) in enumerate(zip(s[2], s[3]), 1)]
        return pd.DataFrame(rows, columns=names).assign(scene=pdf["scene"].iloc[0])[["scene", *names]]

    return e.unionByName(a).groupBy("scene").applyInPandas(plan, f"scene string, {BEATS}")


def verdict(hard: Column, soft: Column) -> Column:
    """fail with hard violations, warn with soft ones, else pass."""
    return F.when(hard > 0, "fail").when(soft > 0, "warn").otherwise("pass")


def unknown_refs(used: DataFrame, allowed: DataFrame, ref: str = "ref") -> DataFrame:
    """References that are used but not allowed."""
    return used.join(allowed.select(ref).distinct(), ref, "left_anti")


def demoted_roles(roles: Column | str, evidence: Column | str, formal: Sequence[str] = vocab.FORMAL_ROLES) -> Column:
    """``struct<kept, demoted>``: formal roles that the evidence doesn't name are demoted."""
    r, said = (F.col(roles) if isinstance(roles, str) else roles), text_of(evidence)
    bad = lambda x: F.exists(F.array(*map(F.lit, formal)), lambda t: F.contains(x, t) & ~F.contains(said, t))
    return F.struct(F.filter(r, lambda x: ~bad(x)).alias("kept"), F.filter(r, bad).alias("demoted"))


def verification(simulations: DataFrame, allowed: DataFrame) -> DataFrame:
    """Each simulated character's verdict: ``scene, name, hard, soft, status``.

    Hard: references (refs) that the scene does not have (``allowed``: scene, ref), and leaks of what comes later; soft: phrases
    that ring false and formal roles. ``simulations``: scene, name, text, refs.
    """
    unknown = simulations.select("scene", "name", F.explode(F.array_distinct("refs")).alias("ref")).join(allowed.select("scene", "ref").distinct(), ["scene", "ref"], "left_anti").groupBy("scene", "name").agg(F.count("*").alias("unknown_refs"))
    risks = text_risks("text")
    n = lambda *kinds: F.size(F.filter("risks", lambda r: r["risk"].isin(*kinds)))
    rows = simulations.select("scene", "name", risks.alias("risks")).join(unknown, ["scene", "name"], "left")
    out = rows.select("scene", "name", (F.coalesce("unknown_refs", F.lit(0)) + n("future_leak")).alias("hard"), n("therapy_tone", "unsupported_role").alias("soft"))
    return out.withColumn("status", verdict(F.col("hard"), F.col("soft")))
