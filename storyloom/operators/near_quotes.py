"""Changed quotes in all texts, without a loss: pieces that a near quote must leave unchanged, found by an automaton.

A window of a text is near a quote if the ratio of both, folded, reaches the threshold. The ratio bounds the characters
that are not matched in either, of n folded characters by ``errors(n)``. Each of these, and each place where two matched
stretches part, spoils at most one piece of the quote, so all pieces but so many stand in the window as they are, at
most that many characters from where they stand in the quote. Places with hits enough are thinned by the short runs of characters
that quote and window must share, for the same reason, and by the longest common subsequence, which no window can exceed. Only
stretches that are left are searched by ``best_window``. Pairs, windows and scores are those of the search of whole texts, for quotes of any length, where the threshold is met.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut_lineage, written
from .automaton import scan, shards
from .evidence import DROPPED, SLACK, SLACK_SHARE, THRESHOLD, best_window, fold_with_offsets

#: Characters of a piece, where a quote can be cut into more pieces than there may be errors.
PIECE = 6
#: Lengths of the short runs, from the one that tells most; needed is at least a tenth of the quote's characters.
RUNS = (5, 4, 3, 2)


_GAPS = re.compile(DROPPED + "+")


def folded(text: str) -> str:
    """``fold_with_offsets`` without the offsets."""
    # of these letters the lower case depends on their place, or is longer than they are
    return fold_with_offsets(text)[0] if "Σ" in text or "İ" in text else _GAPS.sub("", text.lower())


def slack(n: int) -> int:
    """Characters by which a window may be longer or shorter than a folded quote of n."""
    return max(SLACK, round(n * SLACK_SHARE))


def errors(n: int, threshold: float = THRESHOLD) -> int:
    """Characters of a folded quote of n and of a near window, together, that may be unmatched."""
    longest = min(n + slack(n), int(n * (2 - threshold) / threshold + 1e-9))
    return int((1 - threshold) * (n + longest) + 1e-9)


def pieces(quote: str, threshold: float = THRESHOLD) -> list[tuple[int, str]]:
    """Pieces of a folded quote of about equal length with their places: more than there may be errors, of ``PIECE`` characters if so."""
    n = len(quote)
    count = min(n, max(errors(n, threshold) + 1, n // PIECE))
    cuts = [i * n // count for i in range(count + 1)]
    return [(a, quote[a:b]) for a, b in zip(cuts, cuts[1:])]


def shared_runs(quote: str, threshold: float = THRESHOLD) -> tuple[int, int, frozenset[str]]:
    """A length, how many places of a near window must begin a run of that length of the quote, and the quote's runs."""
    n, e = len(quote), errors(len(quote), threshold)
    size, needed = next(((q, n - q + 1 - q * e) for q in RUNS if n - q + 1 - q * e >= n / 10), (1, 0))
    return size, needed, frozenset(quote[i : i + size] for i in range(n - size + 1))


def in_common(n: int, threshold: float = THRESHOLD) -> int:
    """Characters that a folded quote of n and any near window have in common, in order, at least."""
    return math.ceil(threshold * (n + max(1, n - slack(n))) / 2 - 1e-9)


def masks(quote: str) -> dict[str, int]:
    """Of each character the places in a folded quote as bits."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(quote):
        out[c] |= 1 << i
    return dict(out)


def common(places: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of a quote of n, by its ``masks``, and a text; no window of the text has more in common."""
    full = free = (1 << n) - 1
    for c in text:
        met = free & places.get(c, 0)
        free = ((free + met) | (free - met)) & full
    return n - free.bit_count()


def stretches(text: str, spans: list[tuple[int, int]], n: int, threshold: float, runs: tuple[int, int, frozenset[str]]) -> list[tuple[int, int]]:
    """Stretches of a folded text that hold every near window of a quote of n, by the places where it would begin at the first and the last of hits enough."""
    e, size = errors(n, threshold), n + slack(n)
    out: list[tuple[int, int]] = []
    q, needed, own = runs
    for first, last in spans:
        a, b = max(0, last - e), min(len(text), first + e + size)
        if out and a >= out[-1][0] and b <= out[-1][1]:
            continue
        if needed > 1 and sum([text[i : i + q] in own for i in range(a, b - q + 1)]) < needed:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class _Quotes:
    """Quotes by number. Of piece s, ``starts[s]`` to ``starts[s + 1]`` are the quotes that have it and how far before a hit's last character they would begin."""

    ids: list[int]
    lengths: list[int]
    runs: list[tuple[int, int, frozenset[str]] | None]
    masks: list[dict[str, int]]
    starts: np.ndarray
    quote: np.ndarray
    back: np.ndarray
    intact: np.ndarray
    errors: np.ndarray


def _prepared(held: list[tuple[int, str]], threshold: float) -> tuple[list[str], _Quotes]:
    """Distinct pieces, and the quotes that have them."""
    of: dict[str, list[tuple[int, int]]] = defaultdict(list)
    own = [folded(q) for _, q in held]
    for i, f in enumerate(own):
        for at, piece in pieces(f, threshold) if f else []:
            of[piece].append((i, at + len(piece) - 1))
    lists = list(of.values())
    whole = lambda values: np.array(values, np.int64)
    quotes = _Quotes(
        [i for i, _ in held], [len(f) for f in own], [shared_runs(f, threshold) if f else None for f in own], [masks(f) for f in own],
        whole([0, *accumulate(map(len, lists))]), whole([i for one in lists for i, _ in one]), whole([back for one in lists for _, back in one]),
        whole([len(pieces(f, threshold)) - min(len(f) - 1, errors(len(f), threshold)) if f else 0 for f in own]), whole([errors(len(f), threshold) if f else 0 for f in own]),
    )
    return list(of), quotes


def _spans(plain: str, automaton, quotes: _Quotes) -> dict[int, list[tuple[int, int]]]:
    """Of each quote with hits enough near each other, where it would begin at the first and the last of so many hits.

    A near window has ``intact`` different pieces or more, whose places are at most so far from its begin as there may be errors.
    """
    if not len(quotes.quote):
        return {}
    hits = np.fromiter(chain.from_iterable(automaton.iter(plain)), np.int64).reshape(-1, 2)
    end, piece = hits[:, 0], hits[:, 1]
    each = quotes.starts[piece + 1] - quotes.starts[piece]
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - quotes.starts[piece], each)
    # one number for the quote and the begin; begins of two quotes are further apart than any errors
    reach = int(max(quotes.back.max(), quotes.errors.max())) + 1
    width = len(plain) + 4 * reach
    key = quotes.quote[place] * width + np.repeat(end, each) - quotes.back[place] + reach
    order = np.argsort(key)
    key, place = key[order], place[order]
    quote = quotes.quote[place]
    upto = np.arange(len(key)) + quotes.intact[quote] - 1
    far = key + 2 * quotes.errors[quote]
    near = np.flatnonzero((upto < len(key)) & (key[np.minimum(upto, len(key) - 1)] <= far)) if len(key) else []
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, j in zip(near, np.searchsorted(key, far[near], "right") if len(near) else []):
        i = int(quote[k])
        if len(set(place[k:j].tolist())) >= quotes.intact[i]:
            out[i].append((int(key[k]) - i * width - reach, int(key[upto[k]]) - i * width - reach))
    return out


_FOUND = "h long, g long, quote long, begin int, part string"


def _found(quotes: _Quotes, automaton, batch: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], [], []]
    for h, g, text in zip(*(c.to_pylist() for c in batch.columns)):
        plain = folded(text or "")
        offsets: list[int] = []
        for i, spans in _spans(plain, automaton, quotes).items():
            n = quotes.lengths[i]
            for a, b in stretches(plain, spans, n, threshold, quotes.runs[i]):
                # a letter whose lower case is two may lie across an end
                if common(quotes.masks[i], n, plain[max(0, a - 1) : b + 1]) < in_common(n, threshold):
                    continue
                offsets = offsets or fold_with_offsets(text)[1]
                for c, v in zip(columns, (h, g, quotes.ids[i], offsets[a], text[offsets[a] : offsets[b - 1] + 1])):
                    c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _FOUND.split(", ")])


def near_stretches(rows: DataFrame, quotes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``h, g, quote, begin, part``: parts of texts (h, g, text) that may hold a changed quote (quote, evidence), and where they begin."""
    out = None
    for shard in shards(quotes.select("quote", "evidence"), F.octet_length("evidence")):
        held = [tuple(r) for r in shard.collect()]  # bounded in bytes
        part = scan(rows.select("h", "g", "text"), held, lambda own: _prepared(own, threshold), lambda state, own, batch: _found(state, own, batch, threshold), _FOUND)
        out = part if out is None else out.unionByName(part)
    return out


_WINDOW = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("aligned", T.StringType())])


@F.pandas_udf(_WINDOW)
def _best(quotes: pd.Series, parts: pd.Series, begins: pd.Series, least: pd.Series) -> pd.DataFrame:
    out = []
    for q, t, b, r in zip(quotes, parts, begins, least):
        w = best_window(q, t, r)
        out.append((w[0], b + w[1], b + w[2], t[w[1] : w[2]]) if w else (0.0, None, None, None))
    return pd.DataFrame(out, columns=["score", "start", "end", "aligned"]).astype({"start": "Int32", "end": "Int32"})


def locate_near(docs: DataFrame, quotes: DataFrame, text: str = "text", quote: str = "evidence", key: str = "doc_id", name: str = "evidence_at", threshold: float = THRESHOLD) -> DataFrame:
    """Where a list of quotes stands in all texts, also changed: ``key, content``, the quotes' columns and ``locate``'s struct.

    Every pair whose best window reaches the threshold has a row, and no other. Null and blank quotes and texts have none.
    Repeated rows have their pairs each time, repeated quotes once. Windows of equal ratio: the first, then the shorter.
    """
    rows = docs.select(F.col(key), F.col(text).alias("content")).withColumns({"__h": F.xxhash64(key, "content"), "__g": F.xxhash64(F.lit(1), key, "content")})
    asked = quotes.withColumn("__quote", F.xxhash64(*quotes.columns)).dropDuplicates(["__quote"])
    texts = rows.select(F.col("__h").alias("h"), F.col("__g").alias("g"), F.col("content").alias("text"))
    parts = near_stretches(texts, asked.select(F.col("__quote").alias("quote"), F.coalesce(quote, F.lit("")).alias("evidence")), threshold)
    # few parts, but dear ones: dealt to all tasks, whatever their size
    parts = cut_lineage(parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tried = parts.join(asked.select(F.col("__quote").alias("quote"), F.col(quote).alias("__evidence")), "quote")
    tried = tried.select("h", "g", "quote", _best("__evidence", "part", "begin", F.lit(threshold)).alias("w")).where(F.col("w.score") >= threshold)
    window = F.struct((-F.col("w.score")).alias("least"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.aligned").alias("aligned"))
    best = tried.groupBy(F.col("h").alias("__h"), F.col("g").alias("__g"), F.col("quote").alias("__quote")).agg(F.min(window).alias("__w"))
    # written, so that the planner knows how few they are and the texts are not shuffled
    pairs = rows.join(written(best), ["__h", "__g"]).join(asked, "__quote")
    w = F.col("__w")
    struct = lambda status, start, end, aligned, score: F.struct(F.lit(status).alias("status"), F.lit("content").alias("field"), start.alias("start"), end.alias("end"), aligned.alias("aligned"), score.alias("score"))
    # a quote that stands folded in a text is its own best window, of ratio 1
    near = struct("fuzzy_aligned", w["start"], w["end"], w["aligned"], F.round(-w["least"], 4))
    at = F.position(F.col(quote), F.col("content")) - 1
    exact = struct("exact", at, at + F.length(quote), F.col(quote), F.lit(1.0))
    return pairs.withColumn(name, F.when(F.contains("content", F.col(quote)), exact).otherwise(near)).select(key, "content", *[c for c in quotes.columns if c != key], name)
