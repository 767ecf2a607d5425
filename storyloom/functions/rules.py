"""Rule classifiers and normalisers, Column to Column.

Cue lists are parameters with the vocabulary's lists as defaults, so other languages can pass their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import CJK, col, contains_any, count_contained, embedded_code, name_key, once, text_of


def lookup(value: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """The table's entry for a value; ``default`` (the value itself if not given) for others."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, value), value if default is None else default)


def one_of(value: Column, allowed: Sequence[str], default: str) -> Column:
    """The value if it is allowed, else the default: bad input is repaired, not rejected."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def clamp(value: Column, default: float) -> Column:
    """A confidence within 0 and 1; ``default`` for what is no number."""
    return F.greatest(F.lit(0.0), F.least(F.coalesce(value.try_cast("double"), F.lit(default)), F.lit(1.0)))


def entity_type(value: Column | str) -> Column:
    """One of the seven entity types: aliases are mapped, the unknown is a concept."""
    key = F.translate(F.lower(F.trim(text_of(value))), " -", "__")
    return one_of(lookup(key, vocab.ENTITY_TYPE_ALIASES), vocab.ENTITY_TYPES, "concept")


def entity_type_issues(value: Column | str) -> Column:
    """``multiple_types`` for a value of several types, ``unsupported_type`` for one that is neither a type nor an alias."""
    parts = F.filter(F.transform(F.split(text_of(value), "[/|,;、]+"), lambda p: F.translate(F.lower(F.trim(p)), " -", "__")), lambda p: p != "")
    known = (*vocab.ENTITY_TYPES, *vocab.ENTITY_TYPE_ALIASES)
    return F.array_compact(F.array(F.when(F.size(parts) > 1, F.lit("multiple_types")), F.when(F.exists(parts, lambda p: ~p.isin(*known)), F.lit("unsupported_type"))))


def relation_type(value: Column | str) -> Column:
    """A relation's name in snake case with aliases mapped."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text_of(value))), "[^a-z0-9_]+", "_"), "_+", "_")
    return lookup(F.regexp_replace(clean, "^_+|_+$", ""), vocab.RELATION_ALIASES)


def canonical_relation(value: Column | str) -> Column:
    """``struct<type, swapped>``: inverse relations become their forward form with the ends swapped."""
    name = relation_type(value)
    return F.struct(lookup(name, vocab.INVERSE_RELATIONS).alias("type"), name.isin(*vocab.INVERSE_RELATIONS).alias("swapped"))


def is_undirected(value: Column | str) -> Column:
    return relation_type(value).isin(*vocab.UNDIRECTED_RELATIONS)


def is_durable(value: Column | str) -> Column:
    """Whether a relation lasts: listed as such, or its name holds one that is and none that is momentary."""
    name = relation_type(value)
    partly = contains_any(name, vocab.DURABLE_RELATIONS) & ~contains_any(name, vocab.MOMENTARY_RELATIONS)
    return (name != "") & ~name.isin(*vocab.MOMENTARY_RELATIONS) & (name.isin(*vocab.DURABLE_RELATIONS) | partly)


def softened_relation(value: Column | str, evidence: Column | str, change: Column | str) -> Column:
    """Guardian and mentor roles only where the evidence says so; else a commitment or a responsibility."""
    name, said = relation_type(value), F.lower(F.concat_ws("\n", text_of(evidence), text_of(change)))
    cares = contains_any(said, vocab.CARE_LANGUAGE)
    return (
        F.when(name.isin("guardian_of", "custody", "custodian_of") & cares & ~contains_any(said, vocab.GUARDIAN_LANGUAGE), F.lit("care_commitment_to"))
        .when(name.isin("mentor_of", "teacher_of", "instructor_of") & ~contains_any(said, vocab.MENTOR_LANGUAGE), F.when(cares, F.lit("care_responsibility_for")).otherwise(F.lit("guidance_responsibility_for")))
        .otherwise(name)
    )


def says_no_relation(description: Column | str, keywords: Column | str) -> Column:
    """Whether a relation's text is empty or says that there is no relation."""
    said = F.regexp_replace(F.lower(F.trim(F.concat_ws(" ", text_of(description), text_of(keywords)))), r"\s+", " ")
    return (said == "") | contains_any(said, vocab.NO_RELATION)


def is_deictic(surface: Column | str) -> Column:
    clean = F.lower(F.trim(text_of(surface)))
    return F.replace(clean, F.lit(" "), F.lit("")).isin(*vocab.DEICTIC_ZH) | clean.isin(*vocab.DEICTIC_EN) | clean.rlike("^(这|那|this |that )")


def supported_hint(surface: Column | str, kind: Column | str, hint: Column | str, evidence: Column | str) -> Column:
    """A canonical name that the surface, the evidence, a shared code or the name's own parts support; else empty."""
    s, h = F.trim(text_of(surface)), F.trim(text_of(hint))
    code = embedded_code(s)
    parts = F.transform(F.filter(F.split(h, r"[\s,\-.]+"), lambda p: p != ""), F.lower)
    whole = F.lower(F.array_join(F.filter(F.split(s, r"[\s,\-.]+"), lambda p: p != ""), " "))
    both_cjk = s.rlike(f"[{CJK}]") & h.rlike(f"[{CJK}]")
    part = F.when(both_cjk, (F.length(s) >= 2) & F.endswith(h, s)).otherwise((whole != "") & (F.size(parts) >= 2) & F.array_contains(parts, whole))
    known = (h == s) | F.contains(text_of(evidence), h) | ((code != "") & (code == embedded_code(h))) | (entity_type(kind).isin("character", "group") & part)
    return F.when((h != "") & known, h).otherwise(F.lit(""))


def _key_in(key: Column, surfaces: Sequence[str]) -> Column:
    return F.array_contains(F.array(*(name_key(F.lit(s)) for s in surfaces)), key)


def trackability_issue(surface: Column | str, kind: Column | str, hint: Column | str = "hint", evidence: Column | str = "evidence") -> Column:
    """Why a mention is no trackable entity; empty if it is one."""
    s, key, t = F.trim(text_of(surface)), name_key(surface), entity_type(kind)
    return (
        F.when(s == "", F.lit("empty entity surface"))
        .when(_key_in(key, vocab.UNTRACKED_SURFACES), F.lit("generic or deictic phrase is not a trackable story entity"))
        .when(is_deictic(s) & (supported_hint(s, kind, hint, evidence) == ""), F.lit("deictic mention without supported named referent"))
        .when(t.isin("concept", "object") & _key_in(key, vocab.BODY_SURFACES), F.lit("ordinary body part is not a trackable story entity here"))
        .when((t == "concept") & (F.length(s) <= 1), F.lit("concept surface is too broad to track"))
        .otherwise(F.lit(""))
    )


def scene_tag(surface: Column | str, kind: Column | str, role: Column | str, state: Column | str, evidence: Column | str) -> Column:
    """The tag of a mention that colours a scene without being worth tracking; empty if it is worth it."""
    s, key, t = F.trim(text_of(surface)), name_key(surface), entity_type(kind)
    role, state, said = F.lower(text_of(role)), F.lower(text_of(state)), text_of(evidence)
    either = F.concat_ws(" ", role, state)
    tag = lambda name: F.lit(name)
    background = (
        F.when((s == "太阳") & contains_any(said, vocab.SUN_NAMES), tag(""))
        .when(contains_any(s, vocab.BACKGROUND_PARTS), tag("background_element"))
        .when(s == "太阳", tag("atmosphere"))
        .when(t.isin("character", "object"), tag("minor_visual_detail"))
        .otherwise(tag("background_element"))
    )
    listed = contains_any(s, vocab.LISTED_DISASTERS) & contains_any(said, vocab.LISTING_WORDS)
    signal = (
        ((F.length(s) >= 6) & contains_any(s, vocab.OCCASION_LONG_SIGNALS))
        | ((F.length(s) >= 4) & contains_any(s, vocab.OCCASION_SHORT_SIGNALS))
        | contains_any(role, (*vocab.TRACKED_WORDS, "operation"))
        | contains_any(state, (*vocab.TRACKED_WORDS, "formal"))
        | ((F.length(s) >= 4) & contains_any(said, (*vocab.OCCASION_LONG_SIGNALS, *vocab.OCCASION_SHORT_SIGNALS[:2])))
    )
    occasion = (
        F.when(_key_in(key, vocab.OCCASION_SURFACES), F.when(contains_any(s, vocab.EXAMPLE_DISASTERS), tag("illustrative_example")).otherwise(tag("generic_activity")))
        .when(listed, tag("illustrative_example"))
        .when(~signal, tag("generic_activity"))
        .otherwise(tag(""))
    )
    thing = t.isin("character", "object", "location", "concept")
    return (
        F.when(s == "", tag(""))
        .when(_key_in(key, vocab.BACKGROUND_SURFACES), background)
        .when((t == "occasion") & (occasion != ""), occasion)
        .when(thing & (F.contains(role, F.lit("background")) | F.contains(state, F.lit("background")) | F.contains(s, F.lit("背景"))), tag("background_element"))
        .when(thing & contains_any(either, vocab.ATMOSPHERE_WORDS), tag("atmosphere"))
        .when((t == "character") & contains_any(either, vocab.ANIMAL_WORDS), tag("minor_visual_detail"))
        .when(t.isin("object", "location") & (contains_any(either, vocab.SCENERY_WORDS) | contains_any(s, vocab.SCENERY_PARTS)), tag("background_element"))
        .otherwise(tag(""))
    )


def countdown_core(surface: Column | str) -> Column:
    """The event that a countdown phrase counts down to; empty if none."""
    compact = F.regexp_replace(F.trim(text_of(surface)), r"\s+", "")
    core = F.regexp_extract(compact, "(?:距|距离)?(.+?)(?:还剩|剩余|还有)", 1)
    edge = "^[：:，,。；;]+|[：:，,。；;]+$"
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, edge, ""), "^(?:字卡|字幕|倒计时)", ""), edge, "")
    return F.when(F.length(core).between(2, 12) & contains_any(core, vocab.COUNTDOWN_TERMS), core).otherwise(F.lit(""))


def mention_route(surface: Column, kind: Column, hint: Column, role: Column, state: Column, evidence: Column) -> Column:
    """``scene_tag``, ``unresolved`` or ``accepted`` for a mention."""
    return F.when(scene_tag(surface, kind, role, state, evidence) != "", F.lit("scene_tag")).when(trackability_issue(surface, kind, hint, evidence) != "", F.lit("unresolved")).otherwise(F.lit("accepted"))


def temporal_scope(
    memory_type: Column | str, text: Column | str, explicit: Column | None = None,
    durable: Sequence[str] = vocab.DURABLE_WORDS, atemporal: Sequence[str] = vocab.ATEMPORAL_WORDS, episode: Sequence[str] = vocab.EPISODE_WORDS, blocking: int = 12,
) -> Column:
    """``struct<scope, confidence>`` of a memory: an explicit scope, else cues in a fixed order.

    A durable state is blocked by the first ``blocking`` episode cues only.
    """
    kind = F.lower(F.trim(text_of(memory_type)))
    given = F.lit(None).cast("string") if explicit is None else F.trim(text_of(explicit))
    is_ = lambda scope, confidence: F.struct(F.lit(scope).alias("scope"), F.lit(confidence).alias("confidence"))

    def scoped(low: Column) -> Column:
        rule = lambda words: contains_any(low, [w.lower() for w in words])
        return (
            F.when(given.isin(*vocab.TEMPORAL_SCOPES), F.struct(given.alias("scope"), F.lit(0.95).alias("confidence")))
            .when((kind.isin(*vocab.DURABLE_TYPES) | rule(durable)) & ~rule(episode[:blocking]), is_("durable_state", 0.72))
            .when(kind.isin(*vocab.ATEMPORAL_TYPES) & rule(atemporal), is_("atemporal_fact", 0.78))
            .when(kind.isin(*vocab.TIME_BOUND_TYPES) | rule(episode), is_("temporal_episode", 0.8))
            .when(rule(atemporal), is_("atemporal_fact", 0.62))
            .otherwise(is_("uncertain", 0.45))
        )

    return once(F.lower(text_of(text)), scoped)


def is_time_bound(scope: Column) -> Column:
    return scope.isin("temporal_episode", "uncertain")


#: Speaker-like lines. A run of name characters is tried from its start only (or from the end of the last match) and never
#: given back, as no later start or shorter run of it could match; so the scan is linear.
DIALOGUE = rf"[：:][“\"'‘（(]|(?<![\w{CJK}])[\w{CJK}]++\s*+[：:]|(?:\G|(?<![{CJK}A-Za-z0-9_（）()·]))[{CJK}A-Za-z0-9_（）()·]++[：:]"
VOICE_OVER = r"(?i)(解说|旁白|画外音|VO|V\.O\.|OS|O\.S\.)"


def scene_class(title: Column | str, content: Column | str, cues: Mapping[str, Sequence[str]] | None = None) -> Column:
    """A scene's type, policies, reasons and signals, by counts of cues; every cue and pattern is counted once.

    ``cues`` may replace any of visual, cg, conflict, action, exposition, character, montage.
    """
    words = {"visual": vocab.VISUAL_CUES, "cg": vocab.CG_CUES, "conflict": vocab.CONFLICT_CUES, "action": vocab.ACTION_CUES, "exposition": vocab.EXPOSITION_CUES, "character": vocab.CHARACTER_CUES, "montage": vocab.MONTAGE_CUES} | dict(cues or {})
    body = text_of(content)
    texts = F.struct(body.alias("body"), F.concat_ws("\n", text_of(title), body).alias("both"))

    def counted(t: Column) -> Column:
        size, lines = F.length(t["body"]), F.regexp_count(t["body"], F.lit(DIALOGUE))
        return F.struct(size.alias("size"), lines.alias("lines"), *(count_contained(t["both"], w).alias(k) for k, w in words.items()), F.regexp_count(t["both"], F.lit(VOICE_OVER)).alias("voice"))

    def signalled(n: Column) -> Column:
        return F.struct(
            n["size"].alias("content_char_count"), n["lines"].alias("dialogue_count"), *(n[k].alias(f"{k}_hit_count") for k in words), n["voice"].alias("vo_hit_count"),
            (n["lines"] > 0).alias("has_dialogue"), ((n["character"] > 0) | (n["lines"] > 0)).alias("has_named_character"), ((n["action"] > 0) | (n["cg"] > 0)).alias("has_state_change"), (n["conflict"] > 0).alias("has_decision_or_conflict"),
            ((n["visual"] + n["cg"] >= 3) & (n["lines"] <= 1)).alias("is_visual_or_cg_heavy"), (n["montage"] > 0).alias("is_transition_or_montage"), ((n["voice"] > 0) | (n["exposition"] >= 2)).alias("is_vo_or_exposition"),
            ((n["lines"] == 0) & (n["conflict"] == 0) & (n["action"] <= 1)).alias("low_character_action_density"),
        )

    def typed(s: Column) -> Column:
        talk, conflict, change = s["has_dialogue"], s["has_decision_or_conflict"], s["has_state_change"]
        kind = (
            F.when(s["content_char_count"] == 0, F.lit("empty"))
            .when(s["is_transition_or_montage"], F.lit("montage_or_transition"))
            .when(s["is_visual_or_cg_heavy"], F.lit("pure_visual_vfx"))
            .when(talk & conflict, F.lit("conflict_scene"))
            .when(talk, F.lit("dialogue_scene"))
            .when(conflict | (change & (s["character_hit_count"] > 0)), F.lit("character_action_scene"))
            .when(s["is_vo_or_exposition"], F.lit("exposition_or_vo"))
            .otherwise(F.lit("establishing_or_visual_description"))
        )
        return F.struct(kind.alias("kind"), s.alias("s"))

    def judged(k: Column) -> Column:
        kind, s = k["kind"], k["s"]
        talk, conflict, change, told = s["has_dialogue"], s["has_decision_or_conflict"], s["has_state_change"], s["is_vo_or_exposition"]
        heavy, montage, still = s["is_visual_or_cg_heavy"], s["is_transition_or_montage"], s["low_character_action_density"]
        out = kind.isin("empty", "pure_visual_vfx", "montage_or_transition", "establishing_or_visual_description") | heavy | montage | (still & ~conflict)
        writing = F.when(out, F.lit("exclude")).when(kind.isin("conflict_scene", "dialogue_scene", "character_action_scene"), F.lit("include")).otherwise(F.lit("review"))
        reasons = [
            F.concat(F.lit("classified as "), kind),
            F.when(talk, F.lit("contains dialogue or speaker-style lines")),
            F.when(conflict, F.lit("contains decision/conflict signals")),
            F.when(change, F.lit("contains action/state-change or world-state signals")),
            F.when(heavy, F.lit("visual/CG-heavy with low dialogue density")),
            F.when(montage, F.lit("contains transition, montage, subtitle, or flashback signals")),
            F.when(told, F.lit("contains VO/exposition/world-rule signals")),
            F.when(still, F.lit("low character decision/action density")),
        ]
        return F.struct(
            kind.alias("unit_type"),
            F.when(s["content_char_count"] > 0, F.lit("include")).otherwise(F.lit("exclude")).alias("memory_policy"),
            writing.alias("writing_eval_policy"),
            F.when(change | talk | told, F.lit("include")).otherwise(F.lit("exclude")).alias("audit_eval_policy"),
            F.array_compact(F.array(*reasons)).alias("reasons"),
            s.alias("signals"),
        )

    return once(once(once(once(texts, counted), signalled), typed), judged)


def statements(content: Column | str, cues: Mapping[str, Sequence[str]] | None = None, ends_asking: str = "吗") -> Column:
    """``array<struct<item_type, statement>>`` of a turn: its sentences that state, reject, decide, wish or ask."""
    words = dict(vocab.STATEMENT_CUES) | dict(cues or {})
    has = lambda s, kind: contains_any(s, words[kind])

    def kind(s: Column) -> Column:
        return (
            F.when(has(s, "negative"), F.when(has(s, "writing"), F.lit("correction")).otherwise(F.lit("story_constraint")))
            .when(has(s, "rejected"), F.lit("rejected_option"))
            .when(has(s, "decided"), F.lit("creative_decision"))
            .when(has(s, "wished"), F.when(has(s, "style"), F.lit("style_preference")).otherwise(F.lit("user_preference")))
            .when(F.endswith(s, F.lit(ends_asking)) | has(s, "asked"), F.lit("open_question"))
        )

    parts = F.filter(F.transform(F.split(F.trim(text_of(content)), r"[。！？!?\n]+"), F.trim), lambda s: s != "")
    edge = r"^[ ，,。；;]+|[ ，,。；;]+$"
    return F.filter(F.transform(parts, lambda s: F.struct(kind(s).alias("item_type"), F.regexp_replace(s, edge, "").alias("statement"))), lambda r: r["item_type"].isNotNull())


def subject(statement: Column | str) -> Column:
    """What a statement is about: a quoted name, else the name around a few verbs, else empty."""
    text = text_of(statement)
    name = rf"[{CJK}A-Za-z0-9_]{{2,12}}"
    patterns = [vocab.QUOTED, *(p.format(name=f"({name})") for p in vocab.SUBJECT_FRAMES)]
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns), F.lit(""))


def subject_entities(subject_: Column | str, statement: Column | str, limit: int = 4) -> Column:
    """Entity ids of a statement: its subject's, then those of short CJK names in it."""
    names = F.filter(F.regexp_extract_all(text_of(statement), F.lit(f"[{CJK}]{{2,4}}"), F.lit(0)), lambda n: ~n.isin(*vocab.SUBJECT_STOPWORDS))
    all_ = F.slice(F.array_distinct(F.filter(F.concat(F.array(text_of(subject_)), names), lambda n: n != "")), 1, limit)
    return F.transform(all_, lambda n: F.concat(F.lit("entity:"), F.regexp_replace(F.regexp_replace(F.lower(F.trim(n)), r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", "")))


def text_risks(text: Column | str, phrases: Sequence[str] = vocab.THERAPY_PHRASES, roles: Sequence[str] = vocab.FORMAL_ROLES, future: Sequence[str] = vocab.FUTURE_LEAKS) -> Column:
    """``array<struct<risk, term>>``: phrases that ring false, roles without support, and leaks of what comes later."""
    said = text_of(text)
    found = lambda risk, terms: F.transform(F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(said, t)), lambda t: F.struct(F.lit(risk).alias("risk"), t.alias("term")))
    return F.concat(found("therapy_tone", phrases), found("unsupported_role", roles), found("future_leak", future))


def environment_only(participants: Column | str, terms: Sequence[str] = vocab.ENVIRONMENT_TERMS) -> Column:
    """Whether all participants are scenery; no participants count as that."""
    people = F.filter(F.coalesce(col(participants), F.array().cast("array<string>")), lambda p: F.trim(text_of(p)) != "")
    return F.forall(people, lambda p: contains_any(p, terms))


def event_track(mode: Column, participants: Column | str, said: Column | str, scene_role: Column | str = "", explicit: Column | None = None) -> Column:
    """plot, context, forecast, memory or hypothetical: an explicit track, else the mode, else whether only scenery takes part."""
    role = text_of(scene_role) if not (isinstance(scene_role, str) and scene_role == "") else F.lit("")
    scenery = environment_only(participants)
    quiet = role.isin("visual_context", "montage") | (mode == "habitual") | contains_any(text_of(said), vocab.ENVIRONMENT_CONTEXT)
    given = F.lit(None).cast("string") if explicit is None else F.lower(F.trim(text_of(explicit)))
    return (
        F.when(given.isin(*vocab.EVENT_TRACKS), given)
        .when(mode == "future_anticipated", F.lit("forecast"))
        .when(mode == "past_recalled", F.lit("memory"))
        .when(mode == "hypothetical", F.lit("hypothetical"))
        .when(scenery & quiet, F.lit("context"))
        .otherwise(F.lit("plot"))
    )


def displayable_property(name: Column | str, statement: Column | str) -> Column:
    return ~F.lower(F.trim(text_of(name))).isin("entity_type", "type", "category") & (F.trim(text_of(statement)) != "")


def status_rank(status: Column | str) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in vocab.STATUS_RANKS.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, col(status)), F.lit(0))


def required(checks: Sequence[tuple[Column, str]]) -> Column:
    """The messages of the checks that fail (whose condition is not true), in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in checks)))


def whole_record_contains(record: Column, query: str) -> Column:
    """Case-insensitive search in a record's JSON text."""
    return F.contains(F.lower(F.to_json(record)), F.lit(query.lower()))


