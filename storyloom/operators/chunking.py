"""Segmentation: boundary segments, greedy packing, chunks of units, sections of markdown, chunks of documents.

Packing is a fold over the segments of one text (its sums restart at every chunk), written with ``aggregate``; spans
cover the text without gaps. The recursive splitter works on separators of falling strength and is an Arrow-batched
function, as its splits depend on measured lengths.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNIT, col, text_of, unit_count
from ..sources.scratch import small_batches

SEGMENT_END = r"\n\s*\n+|\n+|[。！？!?；;]\s*"
# Separators from strong to weak.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ";", ". ", "! ", "? ", "，", ", ", "、", " ", "")
_UNIT = re.compile(UNIT.replace(r"\x{4e00}-\x{9fff}", "一-鿿"))


def segments(content: Column | str) -> Column:
    """``array<string>``: the text cut after blank lines, newlines and sentence ends; together the whole text."""
    text = text_of(content)
    marked = F.split(F.regexp_replace(text, f"({SEGMENT_END})", "$1\u0000"), "\u0000")
    return F.filter(marked, lambda s: s != "")


def segment_spans(content: Column | str) -> Column:
    """``array<struct<start, end>>`` of the segments, in code points, end exclusive."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    folded = F.aggregate(
        segments(content),
        zero,
        lambda a, s: F.struct((a["at"] + F.length(s)).alias("at"), F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(s)).alias("end")))).alias("spans")),
    )
    return folded["spans"]


def greedy_pack(pieces: Column | str, most: int, measure=unit_count, glue: str = "", joined_length: bool = False) -> Column:
    """Join successive pieces while their measures together stay within ``most``; a longer piece stands alone.

    With ``joined_length`` the measure is that of the joined text itself, glue included.
    """

    def step(a: Column, piece: Column) -> Column:
        last = F.try_element_at(a["chunks"], F.lit(-1))
        size = measure(piece)
        total = measure(F.concat_ws(glue, last, piece)) if joined_length else a["size"] + size
        joins = (F.size(a["chunks"]) > 0) & (total <= most)
        kept = F.slice(a["chunks"], 1, F.greatest(F.size(a["chunks"]) - 1, F.lit(0)))
        return F.struct(
            F.when(joins, total).otherwise(size).cast("int").alias("size"),
            F.when(joins, F.concat(kept, F.array(F.concat_ws(glue, last, piece)))).otherwise(F.concat(a["chunks"], F.array(piece))).alias("chunks"),
        )

    zero = F.struct(F.lit(0).alias("size"), F.array().cast("array<string>").alias("chunks"))
    return F.aggregate(col(pieces), zero, step)["chunks"]


def hard_split(text: str, most: int) -> list[str]:
    """Cut after every ``most`` units; what follows the last unit stays with it."""
    ends = [m.end() for m in _UNIT.finditer(text)][most - 1 :: most]
    cuts = [0, *ends]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    rest = text[cuts[-1] :]
    if rest and (_UNIT.search(rest) or not parts):
        parts.append(rest)
    elif rest:
        parts[-1] += rest
    return parts


def recursive_split(text: str, most: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Parts of at most ``most`` units that together are the text, cut at the strongest separators that do."""
    if len(_UNIT.findall(text)) <= most:
        return [text] if text else []
    for i, separator in enumerate(separators):
        if separator and separator in text:
            pieces = [p + separator for p in text.split(separator)]
            pieces[-1] = pieces[-1][: -len(separator)]
            out: list[str] = []
            held, size = "", 0
            for piece in filter(None, pieces):
                n = len(_UNIT.findall(piece))
                if held and size + n > most:
                    out.append(held)
                    held, size = "", 0
                if n > most:
                    out += [held] * bool(held) + recursive_split(piece, most, separators[i + 1 :])
                    held, size = "", 0
                else:
                    held, size = held + piece, size + n
            return out + [held] * bool(held)
    return hard_split(text, most)


def chunk_units(units: DataFrame, content: str = "content", unit_id: str = "scene_id", most: int = 800) -> DataFrame:
    """One row per chunk of every unit: contiguous, lossless, at most ``most`` units each.

    A unit that fits keeps its id; chunks of others are ``<id>_chunk_001`` and so on. Empty units are one empty chunk.
    """
    if most < 1:
        raise ValueError("a chunk has at least one unit")
    small_batches(units.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        def pack(text: str) -> list[str]:
            out: list[str] = []
            size = 0
            for part in recursive_split(text or "", most):
                n = len(_UNIT.findall(part))
                if out and size + n <= most:
                    out[-1], size = out[-1] + part, size + n
                else:
                    out.append(part)
                    size = n
            return out or [""]

        return texts.map(pack)

    # units that fit, the common case, stay in the JVM
    fits = unit_count(content) <= most
    short = units.where(fits).withColumn("__parts", F.array(text_of(content)))
    parts = short.unionByName(units.where(~fits).withColumn("__parts", cut(F.col(content))))
    lengths = F.transform("__parts", F.length)
    starts = F.transform(F.sequence(F.lit(0), F.size("__parts") - 1), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, v: a + v))
    exploded = parts.withColumn("__starts", starts).select(*units.columns, F.sha2(text_of(content), 256).alias("source_sha256"), F.size("__parts").alias("chunk_count"), "__starts", F.posexplode("__parts").alias("__i", "chunk_content"))
    index = F.col("__i") + 1
    return exploded.select(
        *units.columns,
        "source_sha256",
        F.when(F.col("chunk_count") == 1, F.col(unit_id)).otherwise(F.format_string("%s_chunk_%03d", F.col(unit_id), index)).alias("chunk_id"),
        F.col(unit_id).alias("parent_unit_id"),
        index.alias("chunk_index"),
        "chunk_count",
        F.get("__starts", F.col("__i")).alias("source_start"),
        (F.get("__starts", F.col("__i")) + F.length("chunk_content")).alias("source_end"),
        "chunk_content",
        F.length("chunk_content").alias("character_count"),
        unit_count("chunk_content").alias("chunk_unit_count"),
        F.lit(most).alias("max_chunk_units"),
    )


def sections(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Markdown sections: ``key, section_index, heading, content``; headings are paths, headings without a body go."""
    pattern = r"^\s{0,3}(#{1,6})\s+(.+?)\s*$"
    lines = docs.select(key, F.posexplode(F.split(text_of(content), r"\r?\n")).alias("i", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", pattern, 1))).withColumn("title", F.when(F.col("level") > 0, F.trim(F.regexp_extract("line", pattern, 2))))
    w = Window.partitionBy(key).orderBy("i")
    lines = lines.withColumn("part", F.sum((F.col("level") > 0).cast("int")).over(w))
    heads = lines.where("level > 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "level", "title"))).alias("heads"))
    # a heading cuts the path at its level and adds itself, so a skipped level doesn't leave a gap
    fold = lambda n: F.aggregate(
        F.filter("heads", lambda h: h["part"] <= n),
        F.array().cast("array<string>"),
        lambda a, h: F.concat(F.slice(a, F.lit(1), F.greatest(h["level"] - 1, F.lit(0))), F.array(h["title"])),
    )
    body = lines.groupBy(key, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "\n").alias("text"),
        F.count_if((F.trim("line") != "") & (F.col("level") == 0)).alias("filled"),
    )
    named = body.where("filled > 0").join(heads, key, "left").withColumn("heading", F.coalesce(F.array_join(fold(F.col("part")), " / "), F.lit("")))
    return named.select(key, F.row_number().over(Window.partitionBy(key).orderBy("part")).alias("section_index"), "heading", F.regexp_replace("text", r"^\s+|\s+$", "").alias("content"))


def boundary_parts(content: Column | str, target: int = 2400) -> Column:
    """Paragraphs (long ones as sentences) packed up to ``target`` characters; a single long sentence stays whole."""
    text = F.trim(text_of(content))
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), F.trim), lambda p: p != "")
    sentences = lambda p: F.filter(F.transform(F.split(p, r"(?<=[。！？!?；;])\s*|(?<=[.!?])\s+|\n+"), F.trim), lambda s: s != "")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= target, F.array(p)).otherwise(sentences(p))))
    packed = greedy_pack(units, target, measure=F.length, glue="\n\n", joined_length=True)
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= target, F.array(text)).otherwise(packed)


def chunk_documents(docs: DataFrame, key: str = "doc_id", content: str = "content", target: int = 2400) -> DataFrame:
    """Reference chunks: sections, then parts: ids, indexes and hashes."""
    parts = sections(docs, key, content).select(key, "section_index", "heading", F.posexplode(boundary_parts("content", target)).alias("p", "content"))
    index = F.row_number().over(Window.partitionBy(key).orderBy("section_index", "p"))
    return parts.withColumn("chunk_index", index).select(
        F.format_string("%s_chunk_%04d", F.col(key).cast("string"), F.col("chunk_index")).alias("chunk_id"), key, "heading", "section_index", "chunk_index", (F.col("p") + 1).alias("section_part_index"), "content", F.sha2("content", 256).alias("content_sha256"), F.length("content").alias("char_count")
    )
