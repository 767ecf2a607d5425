"""Evidence alignment: where a quoted text stands in its source.

Tiers: exact; exact after dropping white space, punctuation and case; the best fuzzy window. The first two are
expressions. Only rows that both leave unmatched reach the Arrow-batched window search, and that skips windows whose
letters alone rule them out.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_of
from .ranking import stated

FIELDS = ("title", "subtitle", "content")
DROPPED = r"[\s，。！？、,.!?；;：:“”\"'（）()\[\]【】…]"
THRESHOLD, SLACK, SLACK_SHARE, PIECE = 0.94, 2, 0.08, 12
RUN = 4
_DROPPED = re.compile(DROPPED)
RESULT = T.StructType([T.StructField("status", T.StringType()), T.StructField("field", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("aligned", T.StringType()), T.StructField("score", T.DoubleType())])


def folded(text: Column | str) -> Column:
    """Lower case, without white space and punctuation."""
    return F.regexp_replace(F.lower(text_of(text)), DROPPED, "")


def _offset_of(text: Column, n: Column) -> Column:
    """The place in a text of its n-th kept character (from 0)."""
    kept = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: ~F.substr(text, i, F.lit(1)).rlike(DROPPED))
    return F.get(kept, n) - 1


def _found(status: str, field: str, start: Column, end: Column, text: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(field).alias("field"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.substr(text, start + 1, end - start).alias("aligned"), F.lit(1.0).alias("score"))


def exact_tiers(evidence: Column | str, fields: Sequence[str] = FIELDS) -> Column:
    """The first field that holds the evidence as it is, else folded; null if none does."""
    quote = text_of(evidence)
    key = folded(quote)
    exact, loose = [], []
    for f in fields:
        text = text_of(f)
        at = F.position(quote, text)
        exact.append(F.when((quote != "") & (at > 0), _found("exact", f, at - 1, at - 1 + F.length(quote), text)))
        low = F.position(key, folded(text))
        start, last = _offset_of(text, low - 1), _offset_of(text, low + F.length(key) - 2)
        loose.append(F.when((key != "") & (low > 0), _found("fuzzy_aligned", f, start, last + 1, text)))
    return F.coalesce(*exact, *loose)


#: Words of an anchor: so many successive words of a quote that a text must hold before it is searched for the quote.
ANCHOR = 3


def _words(text: Column | str) -> Column:
    return F.split(text_of(text), " ")


def _runs(words: Column, n: int) -> Column:
    """Hashes of every n successive words."""
    last = F.size(words) - n + 1
    at = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))


def verbatim(docs: DataFrame, quotes: DataFrame, text: str = "text", quote: str = "quote", key: str = "doc_id") -> DataFrame:
    """Pairs of texts and quotes that stand in them as they are: ``key, text`` and all columns of ``quotes``.

    What lies between the first and the last space of a quote is whole words of any text that holds it, so the longest run
    of ``ANCHOR`` such words (of all there are, in a quote with fewer) is looked up among the runs of all texts in an
    equi-join, and only texts that have it are searched. Quotes of one or two words have no such run: they are a stated
    list that is compared with every text. Empty quotes stand nowhere. A repeated row has its pairs once each time.
    """
    q = stated(quotes.where(text_of(quote) != "").withColumn("__inner", F.size(_words(quote)) - 2).withColumn("__quote", F.xxhash64(quote)))
    inner = F.slice(_words(quote), 2, F.greatest("__inner", F.lit(1)))
    anchors, parts = None, []
    for n in range(1, ANCHOR + 1):
        own = q.where(F.col("__inner") >= n if n == ANCHOR else F.col("__inner") == n)
        if own.isEmpty():
            continue
        at = F.sequence(F.lit(0), F.size("__words") - n)
        longest = F.array_max(F.transform(at, lambda i: F.struct(F.length(F.array_join(F.slice("__words", i + 1, n), "")).alias("size"), (-i).alias("at"))))
        run = own.withColumn("__words", inner).withColumn("__at", -longest["at"])
        found = run.select("__quote", F.xxhash64(*(F.get("__words", F.col("__at") + k) for k in range(n))).alias("__run")).distinct()
        anchors = found if anchors is None else anchors.unionByName(found)
        parts.append(n)
    rows = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("__text"))
    if anchors is None:
        pairs = rows.limit(0).join(q, F.col("__text") == F.col("__quote"))
    else:
        lists = F.flatten(F.array(*(_runs(F.col("__w"), n) for n in parts)))
        runs = rows.select(key, "__text", _words(text).alias("__w")).select(key, "__text", F.explode(F.array_distinct(lists)).alias("__run"))
        held = runs.join(stated(anchors), "__run").select(F.col(key).alias("__key"), F.col("__text").alias("__of"), "__quote").distinct()
        pairs = rows.join(held, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__text") == F.col("__of"))).drop("__key", "__of").join(q, "__quote")
    short = q.where("__inner < 1")
    if not short.isEmpty():
        pairs = pairs.unionByName(rows.join(short, F.contains(text, F.col(quote))).select(*pairs.columns))
    return pairs.where(F.contains(text, F.col(quote))).drop("__inner", "__quote", "__text")


def fold_with_offsets(text: str) -> tuple[str, list[int]]:
    kept = [(low, i) for i, c in enumerate(text or "") if not _DROPPED.match(low := c.lower())]
    return "".join(c for c, _ in kept), [i for c, i in kept for _ in c]


def best_window(evidence: str, source: str, least: float = 0.0) -> tuple[float, int, int] | None:
    """The window of about the evidence's length with the highest ratio (of equals the first): score, start, end.

    The letters and the short runs of letters that a window shares with the evidence bound its ratio; windows that can't
    beat the best, or can't reach ``least``, are skipped. If none can, the result is None or of a lower ratio.
    """
    key, _ = fold_with_offsets(evidence)
    text, offsets = fold_with_offsets(source)
    if not key or not text:
        return None
    slack = max(SLACK, round(len(key) * SLACK_SHARE))
    wanted = Counter(key)
    # every unmatched character, and every place where matched stretches part, spoils RUN of the evidence's runs at most
    runs = {key[i : i + RUN] for i in range(len(key) - RUN + 1)}
    upto = [0, *accumulate(text[i : i + RUN] in runs for i in range(len(text) - RUN + 1))]
    matcher = difflib.SequenceMatcher(None)
    matcher.set_seq2(key)
    forward = difflib.SequenceMatcher(None, key)
    best: tuple[float, int, int] | None = None
    # windows where a piece of the evidence stands as it is go first: a good score early rules out most of the others
    whole = min(len(key), len(text))
    for at in sorted({max(0, min(p - i, len(text) - whole)) for i in range(0, len(key), PIECE) if (p := text.find(key[i : i + PIECE])) >= 0}):
        forward.set_seq2(text[at : at + whole])
        if whole >= len(key) - slack and (best is None or forward.ratio() > best[0]):
            best = (forward.ratio(), at, at + whole)
    for size in range(max(1, len(key) - slack), min(len(text), len(key) + slack) + 1):
        if 2 * min(size, len(key)) / (size + len(key)) < max(least, best[0] if best else 0.0):
            continue  # were all of the shorter one shared
        have = Counter(text[:size])
        shared = sum((have & wanted).values())
        for at in range(len(text) - size + 1):
            if at:
                out, new = text[at - 1], text[at + size - 1]
                shared -= have[out] <= wanted[out]
                have[out] -= 1
                have[new] += 1
                shared += have[new] <= wanted[new]
            bound = 2 * shared / (size + len(key))
            if bound < least or (best is not None and (bound < best[0] or (bound == best[0] and at >= best[1]))):
                continue
            unmatched = int((1 - max(least, best[0] if best else 0.0)) * (size + len(key)) + 1e-9)
            if size >= RUN and upto[at + size - RUN + 1] - upto[at] < len(key) - RUN + 1 - RUN * unmatched:
                continue
            forward.set_seq2(text[at : at + size])
            score = forward.ratio()
            better = best is None or score > best[0] or (score == best[0] and (at, size) < (best[1], best[2] - best[1]))
            if better:
                best = (score, at, at + size)
    if best is None:  # the source is shorter than any window
        return None
    score, start, end = best
    return score, int(offsets[start]), int(offsets[end - 1]) + 1


def locate(df: DataFrame, evidence: str = "evidence", fields: Sequence[str] = FIELDS, name: str = "evidence_at") -> DataFrame:
    """Add a struct of where the evidence stands: status (exact, fuzzy_aligned, rejected), field, span, text, score."""
    fields = list(fields)

    @F.pandas_udf(RESULT)
    def fuzzy(quote: pd.Series, *texts: pd.Series) -> pd.DataFrame:
        out = []
        for q, *sources in zip(quote, *texts):
            best = None
            for f, s in zip(fields, sources):
                w = best_window(q or "", s or "")
                if w and (best is None or w[0] > best[0]):
                    best = (*w, f, s)
            if best is None:
                out.append(("rejected", None, None, None, "", 0.0))
            else:
                out.append(("fuzzy_aligned" if best[0] >= THRESHOLD else "rejected", best[3], best[1], best[2], best[4][best[1] : best[2]], round(best[0], 4)))
        return pd.DataFrame(out, columns=["status", "field", "start", "end", "aligned", "score"]).astype({"start": "Int32", "end": "Int32"})

    tried = df.withColumn("__exact", exact_tiers(evidence, fields))
    sure = tried.where("__exact IS NOT NULL").withColumnRenamed("__exact", name)
    rest = tried.where("__exact IS NULL").drop("__exact").withColumn(name, fuzzy(F.col(evidence), *map(F.col, fields)))
    return sure.unionByName(rest)


def fill_gap(spans: Column | str, source: Column | str, most: int = 40) -> Column:
    """The text from the first to the second of exactly two spans of one field, in order, whose gap has at most ``most`` characters other than white space; null else."""
    s = F.col(spans) if isinstance(spans, str) else spans
    a, b, text = F.get(s, F.lit(0)), F.get(s, F.lit(1)), text_of(source)
    gap = F.substr(text, a["end"] + 1, b["start"] - a["end"])
    fits = (F.size(s) == 2) & (a["field"] == b["field"]) & (a["end"] <= b["start"]) & (F.length(F.regexp_replace(gap, r"\s+", "")) <= most)
    return F.when(fits, F.struct(a["start"].alias("start"), b["end"].alias("end"), F.substr(text, a["start"] + 1, b["end"] - a["start"]).alias("aligned")))


def audit(located: DataFrame, evidence: str = "evidence", name: str = "evidence_at") -> DataFrame:
    """Flags of aligned evidence: language, ellipsis, paraphrase, and whether it may order events."""
    has_cjk = lambda c: c.rlike(r"[\x{4e00}-\x{9fff}]")
    at = F.col(name)
    ellipsis = text_of(evidence).rlike(r"\.\.\.|…")
    return located.select(
        "*",
        ellipsis.alias("evidence_has_ellipsis"),
        ((at["status"] == "rejected") & ~ellipsis & (at["score"] >= 0.6)).alias("evidence_is_paraphrase"),
        (has_cjk(text_of(evidence)) != has_cjk(F.coalesce(at["aligned"], F.lit("")))).alias("evidence_language_differs"),
        (at["status"] != "rejected").alias("audit_ordering_usable"),
    )
