"""Text functions, Column to Column: tokenizers, name keys, keywords, hints and checks.

The two tokenizers differ on purpose: ``retrieval_tokens`` forms pairs over the whole text wherever a CJK character is
involved, ``context_tokens`` only within runs that have one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab

CJK = r"\x{4e00}-\x{9fff}"
UNIT = rf"[{CJK}]|[A-Za-z0-9]+(?:[.\-'][A-Za-z0-9]+)*"
CODE = r"[A-Za-z]*\d+[A-Za-z0-9]*|[A-Z]{2,}"
SEPARATOR = "<SEP>"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_of(value: Column | str) -> Column:
    """The value as text; null is empty."""
    return F.coalesce(col(value).cast("string"), F.lit(""))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` reads it; the optimizer inlines a plain alias into every use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def contains_any(value: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs in the value: one pass over an alternation of literals."""
    if not words:
        return F.lit(False)
    return value.rlike("|".join(rf"\Q{w}\E" for w in words))


def count_contained(value: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the value."""
    if not words:
        return F.lit(0)
    return sum((F.contains(value, F.lit(w)).cast("int") for w in words), F.lit(0))


def unit_count(value: Column | str) -> Column:
    """Length in units: CJK characters and words of letters and digits."""
    return F.regexp_count(text_of(value), F.lit(UNIT))


def _bigrams(value: Column) -> Column:
    n = F.length(value)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(value, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def retrieval_tokens(value: Column | str) -> Column:
    """Words of [a-z0-9_], CJK characters, and pairs of characters of which one is CJK; with repeats."""
    low = F.lower(text_of(value))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    # texts without CJK, the common case, skip the pairs
    cjk = F.when(low.rlike(f"[{CJK}]"), F.concat(F.regexp_extract_all(low, F.lit(f"[{CJK}]"), F.lit(0)), F.filter(_bigrams(low), lambda p: p.rlike(f"[{CJK}]")))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, cjk)


def token_set(value: Column | str) -> Column:
    """The distinct retrieval tokens that are not blank."""
    return F.array_distinct(F.filter(retrieval_tokens(value), lambda t: F.trim(t) != ""))


def context_tokens(value: Column | str) -> Column:
    """Distinct runs of letters and digits, and the pairs of characters within runs that have a CJK character."""
    runs = F.filter(F.split(F.lower(text_of(value)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    pairs = F.flatten(F.transform(F.filter(runs, lambda t: t.rlike(f"[{CJK}]")), _bigrams))
    return F.array_distinct(F.concat(runs, pairs))


def alias_key(value: Column | str) -> Column:
    """An alias, lower-cased, without spaces."""
    return F.replace(F.lower(F.trim(text_of(value))), F.lit(" "), F.lit(""))


def match_key(value: Column | str) -> Column:
    """Only letters and digits, lower-cased."""
    return F.lower(F.regexp_replace(text_of(value), r"[^\p{L}\p{N}]+", ""))


def name_key(value: Column | str) -> Column:
    """A name, lower-cased, without spaces and light punctuation."""
    return F.regexp_replace(F.lower(F.trim(text_of(value))), r"[\s,\-.，。:：/（）()]+", "")


def words_key(value: Column | str) -> Column:
    """A name's words, lower-cased, with single spaces for punctuation."""
    return F.trim(F.regexp_replace(F.lower(text_of(value)), r"[\s_\-·•:：,，.。()（）\\\[\]【】\"'“”‘’]+", " "))


def code_tokens(value: Column | str) -> Column:
    """Model codes and acronyms, lower-cased."""
    return F.transform(F.regexp_extract_all(text_of(value), F.lit(CODE), F.lit(0)), F.lower)


def embedded_code(value: Column | str) -> Column:
    """The last run of digits with the letters around it, lower-cased; empty if none."""
    return F.coalesce(F.lower(F.try_element_at(F.regexp_extract_all(text_of(value), F.lit(r"[A-Za-z]*\d+[A-Za-z]*"), F.lit(0)), F.lit(-1))), F.lit(""))


def stable_id(prefix: str, *parts: Column | str, separator: str = "\n", digits: int | None = 16) -> Column:
    """``prefix_`` and the SHA-1 of the parts joined; a null part counts as the text None."""
    joined = F.concat_ws(separator, *(F.coalesce(col(p).cast("string"), F.lit("None")) for p in parts))
    hashed = F.sha1(joined.cast("binary"))
    return F.concat(F.lit(f"{prefix}_"), F.left(hashed, F.lit(digits)) if digits else hashed)


def unit_order(value: Column | str) -> Column:
    """The first part between underscores that is all digits, as a number; 0 if none."""
    digits = F.filter(F.split(text_of(value), "_"), lambda p: p.rlike(r"^\d+$"))
    return F.coalesce(F.try_element_at(digits, F.lit(1)).try_cast("int"), F.lit(0))


def order_before(value: Column | str) -> Column:
    """The last order strictly before a unit; 0 for the first unit and for ids without a number."""
    return F.greatest(unit_order(value) - 1, F.lit(0))


def timeline_hint(value: Column | str) -> Column:
    """The first year of 1900 to 2099, else the first chapter or scene mention, else empty."""
    text = text_of(value)
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    place = F.nullif(F.regexp_extract(text, r"((?i)(?:第|scene|chapter)\s*[\w一二三四五六七八九十百千零〇]+)", 1), F.lit(""))
    return F.coalesce(year, place, F.lit(""))


def looks_temporal(value: Column | str) -> Column:
    return text_of(value).rlike(r"(?i)\b(?:19|20)\d{2}\b|之前|之后|以前|以后|先于|晚于|时间线|timeline|before|after")


def collapse_blank_lines(value: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(text_of(value), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def ordered_distinct(values: Column | str) -> Column:
    """Trimmed, non-empty values in the order of their first occurrence."""
    return F.array_distinct(F.filter(F.transform(col(values), lambda v: F.trim(text_of(v))), lambda v: v != ""))


def merge_keywords(values: Column | str) -> Column:
    """The distinct keywords of comma- or semicolon-separated lists, joined again."""
    return F.array_join(ordered_distinct(F.flatten(F.transform(col(values), lambda v: F.split(text_of(v), "[,，;；]+")))), ", ")


def merge_descriptions(name: Column | str, values: Column | str) -> Column:
    """The distinct descriptions joined by the separator; the name if there are none."""
    kept = ordered_distinct(values)
    return F.when(F.size(kept) > 0, F.array_join(kept, SEPARATOR)).otherwise(text_of(name))


def split_field(value: Column | str) -> Column:
    """The non-empty parts of a separator-joined field."""
    return F.filter(F.split(text_of(value), SEPARATOR), lambda p: p != "")


def display_text(value: Column | str) -> Column:
    """A text for display: the field separator becomes a full-width semicolon."""
    return F.regexp_replace(text_of(value), rf"\s*{SEPARATOR}\s*", "；")


def cleaned(value: Column | str, kind: T.DataType) -> Column:
    """``display_text`` of every text in a value of any nesting: texts, lists, structs and map values; a null stays null."""
    c = col(value)
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), display_text(c))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: cleaned(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: cleaned(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(cleaned(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def narrative_units(intent: Column | str, limit: int = 6) -> Column:
    """Clauses of an intent, without lead verbs and purpose clauses; the intent itself if none is left."""
    text = text_of(intent)

    def clean(clause: Column) -> Column:
        edge = r"^[\s，,。.;；]+|[\s，,。.;；]+$"
        unit = F.regexp_replace(clause, edge, "")
        purpose = unit.rlike("^为.+(铺垫|埋伏笔|做准备)$")
        unit = F.trim(F.regexp_replace(unit, "^(展现|描写|呈现|表现|刻画)", ""))
        unit = F.trim(F.regexp_replace(unit, "^通过", ""))
        unit = F.regexp_replace(F.replace(unit, F.lit("则以"), F.lit("以")), edge, "")
        return F.when(~purpose, unit)

    clauses = F.flatten(F.transform(F.split(text, "[。；;!?！？]"), lambda s: F.split(s, "[，,]")))
    kept = F.array_distinct(F.filter(F.transform(clauses, clean), lambda u: u.isNotNull() & (u != "")))
    whole = F.when(F.trim(text) != "", F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(whole), 1, limit)


def surface_refs(value: Column | str) -> Column:
    """Model codes and acronyms of a text in order, once each."""
    return F.array_distinct(F.regexp_extract_all(text_of(value), F.lit(CODE), F.lit(0)))


def clean_keyword(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"^[\s，,。；;：:？?!！]+|[\s，,。；;：:？?!！]+$", ""), r"\s+", " "))


def low_level_keywords(
    query: Column | str, split_words: Sequence[str] = vocab.SPLIT_WORDS, stopwords: Sequence[str] = vocab.QUERY_STOPWORDS, fillers: Sequence[str] = vocab.QUERY_FILLERS, limit: int = 8
) -> Column:
    """Names and codes that a query asks about: its words less function words, their parts, and Latin tokens."""
    text = text_of(query)
    spaced = text
    for word in split_words:
        spaced = F.replace(spaced, F.lit(word), F.lit(" "))
    spaced = F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[?？!！,，.。;；:：\[\]【】()（）<>《》\"'“”‘’/\\|]+", " "), r"\s+", " "))
    stop = F.array(*map(F.lit, stopwords))

    def kept(term: Column) -> Column:
        filler = contains_any(term, fillers) & (F.length(term) <= 8)
        return (term != "") & ~F.array_contains(stop, term) & ~filler

    def parts(token: Column) -> Column:
        pieces = F.when(F.contains(token, F.lit("的")), F.split(token, "的")).otherwise(F.array().cast("array<string>"))
        stems = [F.when(token.endswith(s) & (F.length(token) > len(s)), F.substr(token, F.lit(1), F.length(token) - len(s))) for s in vocab.KEYWORD_SUFFIXES]
        return F.concat(F.array(token), F.filter(F.transform(F.concat(pieces, F.array_compact(F.array(*stems))), clean_keyword), kept))

    words = F.filter(F.transform(F.split(spaced, r"\s+"), clean_keyword), kept)
    latin = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_.-]*|\d+[A-Za-z]?"), F.lit(0)), clean_keyword)
    latin = F.filter(latin, lambda t: (t != "") & ~F.array_contains(stop, t))
    return F.slice(F.array_distinct(F.concat(F.flatten(F.transform(words, parts)), latin)), 1, limit)


def high_level_keywords(query: Column | str, low_level: Column, cues: Sequence = vocab.KEYWORD_CUES, cues_en: Sequence = vocab.KEYWORD_CUES_EN, default: str = "关系", limit: int = 8) -> Column:
    """Topics that cue words of a query stand for; ``default`` for two or more names without a cue."""
    text = text_of(query)
    none = F.array().cast("array<string>")
    hits = [F.when(F.contains(t, F.lit(cue)), F.array(*map(F.lit, words))).otherwise(none) for t, pairs in ((text, cues), (F.lower(text), cues_en)) for cue, words in pairs]
    found = F.concat(*hits)
    found = F.when((F.size(found) == 0) & (F.size(low_level) >= 2), F.array(F.lit(default))).otherwise(found)
    return F.slice(F.array_distinct(found), 1, limit)


def speaker_labels(value: Column | str) -> Column:
    """Labels before a colon at line starts, then acronyms; labels with remarks or punctuation are left out."""
    text = text_of(value)
    labels = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^([^\n：:]{1,20})[：:]"), F.lit(1)), F.trim)
    labels = F.filter(labels, lambda t: ~contains_any(t, vocab.NO_SPEAKER))
    return ordered_distinct(F.concat(labels, F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9-]{1,20})\b"), F.lit(1))))


def draft_checks(draft: Column | str, anchors: Sequence[str] = (), artifact_terms: Sequence[str] = (), risk_phrases: Sequence[str] = ()) -> Column:
    """A struct of checks of a draft: sizes, anchors present and missing, leaked reference ids, terms and phrases found."""
    text = text_of(draft)
    among = lambda words: F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(F.lower(text), F.lower(w)))
    wanted = F.array(*map(F.lit, anchors)).cast("array<string>")
    return F.struct(
        F.length(text).alias("body_chars"),
        F.length(F.regexp_replace(text, r"\s+", "")).alias("body_non_ws_chars"),
        F.filter(wanted, lambda w: F.contains(text, w)).alias("anchors_present"),
        F.filter(wanted, lambda w: ~F.contains(text, w)).alias("anchors_missing"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[MR]\d+\b|R\*|M\*|reference id|memory index"), F.lit(0)))).alias("ref_ids"),
        F.array_sort(among(artifact_terms)).alias("artifact_terms"),
        F.array_sort(among(risk_phrases)).alias("risk_phrases"),
    )


def embedding_text(source_type: Column, item_type: Column, subject: Column, statement: Column, status: Column) -> Column:
    """The default text to embed for a context item: one ``name: value`` line each; no subject line if it is empty."""
    lines = [("source", source_type), ("type", item_type), ("subject", F.nullif(text_of(subject), F.lit(""))), ("statement", statement), ("status", status)]
    return F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), value if name == "subject" else text_of(value)) for name, value in lines))


def name_variants(name: Column | str, surnames: str = "", titles: Sequence[str] = vocab.TITLES) -> Column:
    """Sorted aliases of a name: without title and parentheses; given name of a CJK name with a listed surname; parts, reversed and "last, first" of a Latin one."""
    text = F.trim(text_of(name))
    title = "|".join(rf"\Q{t}\E" for t in sorted(titles, key=len, reverse=True))
    clean = F.trim(F.regexp_replace(text, rf"^(?i)(?:{title})(?:\s+|(?=[{CJK}]))", ""))
    spaced = F.regexp_replace(clean, r"\s+", " ")
    bare = F.trim(F.regexp_replace(clean, r"[（(].*?[）)]", ""))
    compact = F.regexp_replace(clean, r"\s+", "")
    given = F.when(F.length(compact).between(3, 4) & (F.position(F.left(compact, F.lit(1)), F.lit(surnames)) > 0) & ~compact.rlike(f"(?:{'|'.join(vocab.ROLE_SUFFIXES)})$"), F.substr(compact, F.lit(2))) if surnames else F.lit(None).cast("string")
    parts = F.filter(F.split(clean, r"[\s,\-.]+"), lambda p: p != "")
    many = F.size(parts) >= 2
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    latin = [F.when(many, F.array_join(parts, " ")), F.when(many, F.array_join(F.reverse(parts), " ")), F.when(many, first), F.when(many, last), F.when(many, F.concat(last, F.lit(", "), first))]
    special = F.when(clean.rlike(f"[{CJK}]"), F.array(compact, given)).otherwise(F.array(*latin))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(clean, spaced, bare), special), lambda v: v.isNotNull() & (v != ""))))
