"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the entities that four fixed patterns find (email, ip, card, phone); matches that fail their condition, and dates,
are known to be none. Around seeds, nones and all other identifier-shaped strings the words induce lexical patterns: the
word before, the two and the three words before, and the words on either side. Patterns and strings form a graph.

A string of unknown nature is first trusted as far as strings of its coarse shape (with letters or not, long or not) are
entities where that is known. Each round scores a pattern by the trust in its strings, by weight, and then a string by its
shape and its patterns. So a pattern may become confident through seeds, or through strings that look like
them, as a label before a key of letters and digits does. Strings that are trusted and stand in a confident pattern
with enough trusted strings are new identifiers.

Every step is an explode, an aggregate, a window or a join of match rows; texts are scanned where they lie. Patterns
with a very large share of the matches are aggregated before they are joined, and the join's skew is Spark's to split.

Defined results: a null or empty text has no spans. Where strings touch, seeds come before failed matches and both before
other strings; of one kind, the leftmost match. Patterns of equal score are all confident or none. Rows of equal id are separate rows, equal rows have equal results.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialize

KINDS = ("email", "ip", "card", "phone", "id")
#: The seeds' patterns. Possessive loops and the look-behind (or the end of the last match) keep them linear; they find
#: what their plain forms find, as a run that fails at its first character fails at every later one.
SEEDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Identifier-shaped strings: at least seven characters, four digits of them; they end on a letter or digit, whatever mark follows.
SHAPE = r"(?:\G|(?<![A-Za-z0-9._@+-]))(?=(?:[A-Za-z._@+-]*+[0-9]){4})[A-Za-z0-9][A-Za-z0-9._@+-]{5,}[A-Za-z0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Dates, which are no identifiers.
DATE = r"^(?:(?:19|20)[0-9]{2}[-._]?(?:0[1-9]|1[0-2])[-._]?(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[-._](?:0[1-9]|1[0-2])[-._](?:19|20)[0-9]{2})$"
ROUNDS, FEWEST, CONFIDENT, TRUSTED, LONG = 3, 5, 0.8, 0.5, 16


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a seed's further condition holds."""
    plain, digits = F.regexp_replace(match, "[ -]", ""), F.length(F.regexp_replace(match, "[^0-9]", ""))
    card = F.when(F.length(plain).between(16, 19), luhn(plain)).otherwise(False)
    return F.when(kind == "ip", match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")).when(kind == "card", card).when(kind == "phone", digits.between(8, 15)).when(kind == "id", ~match.rlike(DATE)).otherwise(True)


def _described(kind: str) -> Column:
    """One kind's matches in order, with the length of the gap before each and the texts around it."""

    def one(match: Column, i: Column) -> Column:
        before, after = F.get(f"{kind}_gaps", i), F.get(f"{kind}_gaps", i + 1)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), match.alias("match"), F.length(before).alias("gap"), F.right(before, F.lit(48)).alias("before"), F.left(after, F.lit(32)).alias("after"))

    return F.transform(f"{kind}_found", one)


def find_matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, kind, match, start, end, before, after`` of every seed and identifier-shaped string."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("text").rlike("[0-9@]"))
    hints = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # arrays of matches and gaps once per kind; each scan reads a text once
    for kind, pattern in [*SEEDS.items(), ("id", SHAPE)]:
        hit = F.col("text").rlike(hints.get(kind, "[0-9]"))
        rows = rows.withColumn(f"{kind}_found", F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).withColumn(f"{kind}_gaps", F.when(F.size(f"{kind}_found") > 0, F.split("text", pattern, -1)))
    parts = [F.when(F.col(f"{kind}_found").isNotNull(), _described(kind)) for kind in KINDS]
    each = rows.select("doc_id", "text_hash", F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("m")).select("doc_id", "text_hash", "m.*").dropDuplicates(["doc_id", "text_hash", "kind", "i"])
    so_far = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i"))
    placed = each.withColumn("end", so_far.cast("long")).withColumn("start", F.col("end") - F.length("match"))
    # a match that fails its condition, or a date, is known to be none: it speaks against its patterns
    kind = F.when(valid(F.col("kind"), F.col("match")), F.col("kind")).otherwise("none")
    # a number too short or too long for a card says nothing either way
    digits = F.length(F.regexp_replace("match", "[ -]", ""))
    return placed.where((F.col("kind") != "card") | digits.between(16, 19)).select("doc_id", "text_hash", kind.alias("kind"), "match", "start", "end", "before", "after")


def shape(match: Column) -> Column:
    """A string's coarse shape, one of four."""
    return F.concat(F.when(match.rlike("[A-Za-z]"), "mixed ").otherwise("digits "), F.when(F.length(match) >= LONG, "long").otherwise("short"))


def contexts(matches: DataFrame) -> DataFrame:
    """Match rows with their lexical ``pattern``, one row for each."""
    word = r"[^\s]+"
    left = F.regexp_extract_all(F.lower("before"), F.lit(word), F.lit(0))
    last = lambda n: F.when(F.size(left) >= n, F.concat(F.lit(f"L{n} "), F.array_join(F.slice(left, -n, n), " ")))
    right = F.nullif(F.regexp_extract(F.lower("after"), r"^\s*([^\s]+)", 1), F.lit(""))
    sides = F.when(F.size(left) >= 1, F.concat(F.lit("LR "), F.element_at(left, -1), F.lit(" _ "), right))
    return matches.withColumn("pattern", F.explode(F.array_compact(F.array(last(1), last(2), last(3), sides))))


def score_graph(seen: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, list[str]]:
    """``pattern, confidence, support`` of patterns and ``instance, trust`` of strings after the rounds, and the written tables' paths.

    ``seen``: kind, match, pattern. Support is the number of distinct strings of a pattern that are trusted.
    """
    spark = seen.sparkSession
    known = F.when(F.col("kind") == "none", 0.0).when(F.col("kind") != "id", 1.0)
    edges, edges_path = materialize(seen.groupBy("pattern", F.xxhash64("match").alias("instance")).agg(F.count("*").alias("w"), F.max(known).alias("known"), F.max(shape(F.col("match"))).alias("shape")), "pattern-edges")
    strings = edges.groupBy("instance").agg(F.max("known").alias("known"), F.max("shape").alias("shape"))
    # four rows: of the strings of a shape whose nature is known, the share of entities, where there are enough of these
    shapes = strings.groupBy("shape").agg(F.when(F.count_if(F.col("known") == 1) >= FEWEST, F.avg("known")).otherwise(0.0).alias("likely"))
    strings, strings_path = materialize(strings.join(F.broadcast(shapes), "shape").select("instance", "known", F.coalesce("likely", F.lit(0.0)).alias("likely")), "strings")
    trust, used = strings.select("instance", F.coalesce("known", "likely").alias("trust")), []
    for _ in range(rounds):
        scored = edges.join(trust, "instance").groupBy("pattern").agg((F.sum(F.col("w") * F.col("trust")) / F.sum("w")).alias("confidence"), F.count_if(F.col("trust") >= TRUSTED).alias("support"))
        patterns, path = materialize(scored, "patterns")
        told = edges.where("known IS NULL").join(patterns.where(F.col("support") >= FEWEST), "pattern").groupBy("instance").agg((F.sum(F.col("w") * F.col("confidence")) / F.sum("w")).alias("said"))
        raised = strings.join(told, "instance", "left").select("instance", F.coalesce("known", (F.col("likely") + F.coalesce("said", F.lit(0.0))) / 2).alias("trust"))
        trust, trust_path = materialize(raised, "trust")
        discard(spark, *used)
        used = [path, trust_path]
    discard(spark, edges_path, strings_path)
    return patterns, trust, used


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two frames: ``doc_id, text_hash`` of every row; and ``doc_id, text_hash, kind, start, end, base`` of every span."""
    matches, matches_path = materialize(find_matches(docs, key, text), "matches")

    def apart(x: DataFrame, y: DataFrame) -> DataFrame:
        """Rows of x that overlap no row of y in the same text: none that starts before their end reaches beyond their start."""
        both = x.withColumn("at", F.col("end")).withColumn("other", F.lit(0)).unionByName(y.withColumn("at", F.col("start")).withColumn("other", F.lit(1)))
        swept = Window.partitionBy("doc_id", "text_hash").orderBy("at", "other").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reach = F.max(F.when(F.col("other") == 1, F.col("end"))).over(swept)
        return both.withColumn("reach", reach).where((F.col("other") == 0) & (F.coalesce("reach", F.lit(0)) <= F.col("start"))).drop("at", "other", "reach")

    base, failed = matches.where("kind NOT IN ('id', 'none')"), matches.where("kind = 'none'")
    seeds = base.unionByName(apart(failed, base))
    # an identifier-shaped string that touches a seed of its row, even a failed one, is no instance of its own
    other = apart(matches.where("kind = 'id'"), matches.where("kind <> 'id'"))
    seen, seen_path = materialize(contexts(seeds.unionByName(other)).select("doc_id", "text_hash", "kind", "match", "start", "end", "pattern"), "seen")
    patterns, trust, paths = score_graph(seen)
    good = patterns.where((F.col("confidence") >= CONFIDENT) & (F.col("support") >= FEWEST)).select("pattern")
    sure = trust.where(F.col("trust") >= TRUSTED).select("instance")
    found = seen.where("kind = 'id'").withColumn("instance", F.xxhash64("match")).join(good, "pattern", "left_semi").join(sure, "instance", "left_semi").select("doc_id", "text_hash", "kind", "start", "end").distinct()
    spans, _ = materialize(base.select("doc_id", "text_hash", "kind", "start", "end").withColumn("base", F.lit(True)).unionByName(found.withColumn("base", F.lit(False))), "spans")
    discard(docs.sparkSession, matches_path, seen_path, *paths)
    every = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    return every, spans
