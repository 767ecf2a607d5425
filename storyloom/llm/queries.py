"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .licenses import scan, with_spans

    counts, spans = scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["phrase"])
    labels = lambda some: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda s: s["label"]))), ","), F.lit(""))
    starts = F.transform(base, lambda s: s["start"])
    return with_spans(counts, spans).select(
        "doc_id",
        "n_words",
        F.when(F.col("spans").isNull(), 0).otherwise(F.size(base)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pii import KINDS, find_personal_data

    rows, spans = find_personal_data(_table(spark, sf_dir, "documents"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    by_row = spans.groupBy("doc_id", "text_hash").agg(
        *(F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS[:4]),
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base"))).alias("all"),
    )
    said = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    joined = rows.join(by_row, (rows.doc_id.eqNullSafe(by_row.doc_id)) & (rows.text_hash == by_row.text_hash), "left")
    return joined.select(
        rows.doc_id,
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(F.coalesce(said(F.filter("all", lambda s: s["base"])), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(said(F.col("all")), F.lit("")).alias("spans"),
        F.when(F.col("all").isNull(), 0).otherwise(F.size("all")).cast("long").alias("n_spans"),
        F.when(F.col("all").isNull(), 0).otherwise(F.size(F.filter("all", lambda s: ~s["base"]))).cast("long").alias("n_found"),
    )


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_successions

    return fingerprint_successions(_table(spark, sf_dir, "documents"))


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints' band join: classes of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    from .fingerprints import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import learnable, score, train

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminations

    return contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import spelling_variants, word_counts

    return spelling_variants(word_counts(_table(spark, sf_dir, "documents"), damaged=31))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import ranked_search

    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substrings import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if (name.startswith("op") or name == "near_duplicate_classes") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL,
        "op3_warc_conversion": OP3_SQL,
        "op9_benchmark_decontamination": OP9_SQL,
        "op10_ngram_jaccard_join": OP10_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_ranked_search": OP12_SQL,
        "op13_substring_dedup": OP13_SQL,
    }


_STRIP = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$'"
OP2_SQL = rf"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS line,
         translate(regexp_replace(l[i], {_STRIP}, '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.*, coalesce(s.first < l.doc_id, false) AS lost FROM lines l LEFT JOIN shared s USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# five bits at a time: two hexadecimal digits around them, shifted
_HEX = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
OP3_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_HEX.format("(i * 5) // 4 + 1")} * 16 + {_HEX.format("(i * 5) // 4 + 2")}) >> (3 - (i * 5) % 4)) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Every matched word of every diagonal, and all stretches from match to match with the matches and identity needed.
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS n, least(12, -(-80 * len(w) // 100)) AS needed, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS q FROM b WHERE len(w) >= 5),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d),
m AS (SELECT DISTINCT doc_id, item_id, n, needed, p - q AS shift, q FROM t JOIN i USING (x)),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY q) AS r, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS c FROM m),
h AS (SELECT * FROM g WHERE c >= needed),
s AS (SELECT a.doc_id, a.item_id, a.n, a.shift, a.q AS begin, z.r - a.r + 1 AS matched, z.q - a.q + 1 AS size FROM h a JOIN h z ON a.doc_id = z.doc_id AND a.item_id = z.item_id AND a.shift = z.shift AND z.r >= a.r + a.needed - 1 AND 100 * (z.r - a.r + 1) >= 80 * (z.q - a.q + 1)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY size DESC, matched DESC, begin) AS k FROM s) WHERE k = 1)
SELECT doc_id, item_id, matched::INT AS matched_words, size::INT AS overlap_words, n::INT AS item_words, (shift + begin)::INT AS first_word, begin::INT AS item_first
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, size DESC, shift + begin, begin DESC) AS k FROM l) WHERE k = 1
"""
#: Pairs that share a shingle, counted; labels fall along the links until none changes.
OP10_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
c AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM s), k AS (SELECT min(doc_id) AS node, n, s FROM c WHERE n > 0 GROUP BY n, s),
g AS (SELECT node, n, unnest(s) AS x FROM k),
p AS (SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
cc(node, label) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM u GROUP BY a UNION SELECT u.b, min(c.label) FROM cc c JOIN u ON u.a = c.node JOIN recurring.cc r ON r.node = u.b WHERE c.label < r.label GROUP BY u.b)
SELECT c.doc_id, c.n AS n_shingles, coalesce(cc.label, k.node, c.doc_id) AS component_id FROM c LEFT JOIN k ON k.n = c.n AND k.s = c.s LEFT JOIN cc ON cc.node = k.node
"""
#: crc32 by a table of its 256 bytes; near words by joins on wildcards and deletions.
OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS w FROM documents),
tally AS (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs WHERE length(w) >= 7 GROUP BY doc_id, w),
hashed AS (SELECT w, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM tally, crc),
damaged AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
wild AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS k, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM wild a JOIN wild b ON a.k = b.k AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM wild a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM wild a JOIN words b ON a.d = b.word),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
chain AS (SELECT word, form AS at FROM formed WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, coalesce(root, f.word) AS root FROM formed f LEFT JOIN roots USING (word)
"""

_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The score of every document that shares a term with an item.
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS.format(_LOW)} AS w FROM documents),
q AS (SELECT row_number() OVER () AS query, item_id, list_distinct({_TERMS.format(_LOW)}) AS w FROM benchmark),
asked AS (SELECT query, item_id, unnest(w) AS x FROM q),
totals AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT id, x, count(*) AS tf FROM (SELECT id, unnest(w) AS x FROM d) WHERE x IN (SELECT x FROM asked) GROUP BY id, x),
weight AS (SELECT x, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT x, count(*) AS df FROM tf GROUP BY x), totals),
impact AS (SELECT tf.id, d.doc_id, x, weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(d.w) * docs) // terms)))) AS s FROM tf JOIN d ON d.id = tf.id JOIN weight USING (x), totals),
scored AS (SELECT query, item_id, id, doc_id, sum(s)::BIGINT AS score FROM asked JOIN impact USING (x) GROUP BY query, item_id, id, doc_id HAVING sum(s) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""

#: Every window of 50 words with its first document; a word goes if it lies in a window that a smaller id holds.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT id, doc_id, i, md5_number(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d)),
lost AS (SELECT id, i FROM windows JOIN (SELECT h, min(doc_id) AS first, max(doc_id) AS last FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h) WHERE first < doc_id),
gone AS (SELECT DISTINCT id, unnest(range(i, i + 50)) AS i FROM lost),
kept AS (SELECT d.id, count(g.i) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY d.i) FILTER (g.i IS NULL), '') AS kept FROM (SELECT id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) d LEFT JOIN gone g ON g.id = d.id AND g.i = d.i GROUP BY d.id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (id)
"""
