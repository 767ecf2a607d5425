"""Spelling variant grouping by pairless wildcard groups.

Words that differ in one replaced code point share a wildcard: a position with what stands before and after it. Words
that differ in one more code point share a string: the shorter word is the longer one after a deletion. Every word goes to
one group for each of its wildcards and distinct deletions, and to the group of itself; a group keeps its size and its
two most frequent words, and each member reads from these how many near words it has there and the best of them. No
pair is ever a row. A wildcard's group has at most as many words as the alphabet has letters, a plain string's at most as
many as letters can be put into it, so no group grows with the corpus.

Defined results: null and empty texts hold no words. A null id counts as an empty one when runs are damaged. Repeated
rows count as often as they occur. Extra columns are ignored. Near words of equal count go by code-point order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
#: Stands for the code point at a wildcard's position; no word holds it.
WILD = "*"


def lowered(word: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    plain = F.octet_length(word) == F.length(word)  # of ASCII words, the quick lower() does the same
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def without(word: Column, at: Column, put: str = "") -> Column:
    """The word with the code point at ``at`` (from 0) replaced by ``put``."""
    at = at.cast("int")
    return F.concat(F.substr(word, F.lit(1), at), F.lit(put), F.substr(word, at + 2))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 7, least: int = 2, damaged: int = 0) -> DataFrame:
    """``word, n``: lower-cased runs of letters of at least ``min_chars`` code points that occur ``least`` times or more.

    With ``damaged``, runs whose crc32 of ``id:run`` it divides lose one code point first, at crc32 modulo their length.
    """
    # a greedy run of enough letters is maximal, and shorter ones can't give a word
    runs = docs.select(F.col(key).cast("string").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("run"))
    words = runs.select("id", lowered(F.col("run")).alias("word"))
    if damaged:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("word")))
        words = words.withColumn("h", h).select(F.when(F.col("h") % damaged == 0, without(F.col("word"), F.col("h") % F.length("word"))).otherwise(F.col("word")).alias("word"))
        words = words.where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best (n, word)`` of every word with a near word; ``best`` has the largest n, then the least word."""
    w, i, size = F.col("word"), F.col("i"), F.length("word")
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    # a deletion inside a run of one letter is made at its first place alone
    anew = (i == 0) | (F.substr(w, i + 1, F.lit(1)) != F.substr(w, i, F.lit(1)))
    keys = F.when(i == size, F.array(w)).when(anew, F.array(without(w, i, WILD), without(w, i))).otherwise(F.array(without(w, i, WILD)))
    rows = places.select(F.explode(keys).alias("key"), "word", "n")
    order = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("n", "word")
    groups = rows.select(
        "key",
        "word",
        F.count("*").over(whole).alias("size"),
        F.first(one).over(whole).alias("first"),
        F.lead(one).over(order).alias("following"),
        F.max(F.when(F.col("key") == w, F.col("n"))).over(whole).alias("own"),
    ).where("size > 1")
    # the longer words of a plain string are near to it alone, if it is a word; all others to all of their group
    longer = ~F.contains("key", F.lit(WILD)) & (F.col("key") != w)
    other = F.when(F.col("first.word") == w, F.col("following")).otherwise(F.col("first"))
    best = F.when(longer, F.struct(F.col("own").alias("n"), F.col("key").alias("word"))).otherwise(other)
    near = F.when(longer, F.lit(1)).otherwise(F.col("size") - 1)
    found = groups.where(~longer | F.col("own").isNotNull()).select("word", near.alias("near"), best.alias("best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best.n")).alias("least"), F.col("best.word").alias("word"))).alias("b")).select("word", "n_near", F.struct((-F.col("b.least")).alias("n"), F.col("b.word").alias("word")).alias("best"))


def spelling_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``words`` (word, n; words distinct, without ``*``).

    A word's form is its best near word if that occurs ``factor`` times as often or more; the root ends the chain of forms.
    """
    spark = words.sparkSession
    words, words_path = materialize(words.select("word", "n"), "words")
    near = near_words(words)
    is_form = F.col("best.n") >= factor * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n"))
    joined, _ = materialize(joined, "variants")
    discard(spark, words_path)
    forms = joined.where("form IS NOT NULL")
    most = forms.agg(F.max("form_n"), F.min("n")).first()
    roots, path = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    if most[0]:
        # every form is `factor` times as frequent, so chains are short; each round doubles what a root has followed
        longest = max(1, math.floor(math.log(most[0] / most[1], factor) + 1e-9))
        for _ in range(math.ceil(math.log2(longest))):
            further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            nxt, new = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
            discard(spark, path)
            roots, path = nxt, new
    return joined.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
