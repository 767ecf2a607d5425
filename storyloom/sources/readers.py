"""Readers: scripts, reference files, conversations, model output. All lazy; files are read by Spark's own sources."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_of

SCRIPT = "array<struct<_id: string, title: string, subtitle: string, content: string>>"
REFERENCE_FILES = "*.{docx,md,markdown,txt,json,jsonl}"
_IN = r"EXT\s*/\s*INT|INT\s*/\s*EXT|INT|EXT|内\s*/\s*外|外\s*/\s*内|内|外"
_TIME = r"日\s*/\s*夜\s*/\s*无日夜|无日夜|日\s*/\s*夜|夜\s*/\s*日|日|夜|晨|晚|黄昏|清晨|白天|深夜"
#: Number, inside or outside, time of day, location (a fixed value).
HEADING = rf"(?i)^\s*(\d+)\s*[、.．]\s*({_IN})?\s*[.。]?\s*({_TIME})?\s*[.。]?\s*(.*)$"


def parse_heading(title: Column | str) -> Column:
    """``struct<number, interior_exterior, time_of_day, location_hint>``; a title without a number is the location."""
    t = text_of(title)
    known = t.rlike(HEADING)
    group = lambda n: F.when(known, F.nullif(F.regexp_replace(F.regexp_extract(t, HEADING, n), r"\s*/\s*", "/"), F.lit("")))
    return F.struct(
        group(1).try_cast("int").alias("number"), F.upper(group(2)).alias("interior_exterior"), group(3).alias("time_of_day"),
        F.when(known, F.trim(F.regexp_extract(t, HEADING, 4))).otherwise(F.trim(t)).alias("location_hint"),
    )


def read_script(spark: SparkSession, path: str, unit_type: str = "scene", unit_label: str = "scene") -> DataFrame:
    """A JSON array of scenes as units; ids and order come from the place in the array. Input that is no array raises."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", SCRIPT, {"mode": "FAILFAST"}).alias("scenes"))
    rows = raw.select(F.posexplode("scenes").alias("at", "s"))
    number = F.coalesce(F.col("s._id").try_cast("bigint"), F.col("at") + 1)
    head = parse_heading("s.title")
    return rows.select(
        F.format_string("scene_%04d", number).alias("scene_id"), number.alias("source_record_id"), (F.col("at") + 1).cast("long").alias("discourse_index"), F.trim(text_of("s.title")).alias("title"), F.trim(text_of("s.subtitle")).alias("subtitle"), text_of("s.content").alias("content"),
        head["number"].alias("raw_heading_number"), head["interior_exterior"].alias("interior_exterior"), head["time_of_day"].alias("time_of_day"), head["location_hint"].alias("location_hint"), F.length(text_of("s.content")).alias("character_count"), F.lit(unit_type).alias("unit_type"), F.lit(unit_label).alias("unit_label"),
    )


def reference_files(spark: SparkSession, path: str) -> DataFrame:
    """The reference files below a folder: path, format and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", REFERENCE_FILES).load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("format"), "content", "length")


def record_text(payload: Column | str) -> Column:
    """A JSON object as ``key: value`` lines, without raw, documents and chunks and without empty values."""
    entries = F.map_entries(F.from_json(text_of(payload), "map<string,string>"))
    kept = F.filter(entries, lambda e: ~e["key"].isin("raw", "documents", "chunks") & e["value"].isNotNull() & ~e["value"].isin("", "None"))
    return F.array_join(F.transform(kept, lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


def _docx_text(data: bytes) -> str:
    """A Word file's paragraphs (headings as markdown) and table rows, in document order."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.parse(zipfile.ZipFile(io.BytesIO(data)).open("word/document.xml")).getroot().find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    lines = []
    for e in body:
        if e.tag == f"{w}p" and (text := said(e)):
            style = e.find(f"{w}pPr/{w}pStyle")
            level = re.match(r"(?i)heading\s*(\d)", style.get(f"{w}val", "")) if style is not None else None
            lines.append("#" * int(level[1]) + " " + text if level else text)
        elif e.tag == f"{w}tbl":
            lines += [" | ".join(map(said, row.iter(f"{w}tc"))) for row in e.iter(f"{w}tr")]
    return "\n\n".join(lines)


_DOCUMENT = "path string, format string, record_index int, title string, heading string, content string"


def reference_documents(files: DataFrame) -> DataFrame:
    """Documents of reference files, with ids from their place and content: one of a text file, one a line of JSONL, one a record of JSON."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, data in batch[["path", "format", "content"]].itertuples(index=False):
                name = path.rsplit("/", 1)[-1]
                records: list[tuple[str, str, str]] = []
                if kind == "docx":
                    records = [(name, "", _docx_text(data))]
                elif kind == "jsonl":
                    records = [_record(json.loads(x), name) for x in data.decode().splitlines() if x.strip()]
                elif kind == "json":
                    records = list(_flat(json.loads(data), name))
                else:
                    records = [(name, "", data.decode("utf-8", "replace"))]
                rows += [(path, kind, i, *r) for i, r in enumerate(records)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _DOCUMENT.split(", ")])

    docs = files.select("path", "format", "content").mapInPandas(parse, _DOCUMENT)
    scope = F.concat(F.lit("ref_scope_"), F.sha1(F.col("path").cast("binary")))
    return docs.select(F.concat(F.lit("ref_doc_"), F.sha1(F.concat_ws("|", "path", F.col("record_index").cast("string"), F.sha2("content", 256)).cast("binary"))).alias("doc_id"), scope.alias("source_scope_id"), F.col("path").alias("source_path"), "format", "record_index", "title", "heading", "content", F.sha2("content", 256).alias("content_sha256"))


def _record(payload, name: str, heading: str = "") -> tuple[str, str, str]:
    if isinstance(payload, dict):
        text = payload.get("content") or payload.get("text")
        lines = [f"{k}: {v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}" for k, v in payload.items() if k not in ("raw", "documents", "chunks") and v not in (None, "")]
        return str(payload.get("title") or name), str(payload.get("heading") or payload.get("chunk_id") or heading), str(text or "\n".join(lines))
    return name, heading, str(payload)


def _flat(payload, name: str) -> Iterator[tuple[str, str, str]]:
    documents = payload.get("documents") if isinstance(payload, dict) else payload if isinstance(payload, list) else None
    for d in documents if isinstance(documents, list) else [payload]:
        inner = d.get("chunks") if isinstance(d, dict) else None
        title = str(d.get("title") or name) if isinstance(d, dict) else name
        for c in inner if isinstance(inner, list) else [d]:
            yield _record(c, title, title if inner else "")


TURN = "turn_id string, role string, content string, text string, message string, speaker string, order int"


def read_conversation(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    """Turns of a transcript: ``jsonl`` lines, a ``json`` object with turns, messages or conversation, or plain ``text`` with role prefixes."""
    if kind == "jsonl":
        rows = spark.read.schema(TURN).json(path).withColumn("at", F.monotonically_increasing_id())
    elif kind == "json":
        shape = f"turns array<struct<{TURN.replace(' ', ': ').replace(',:', ',')}>>"
        one = shape.split("<", 1)[1]
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"turns array<{one}, messages array<{one}, conversation array<{one}").alias("r"))
        rows = raw.select(F.posexplode(F.coalesce("r.turns", "r.messages", "r.conversation")).alias("at", "t")).select("at", "t.*")
    else:
        rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).select("at", plain_turn("value").alias("p")).select("at", F.lit(None).cast("string").alias("turn_id"), "p.role", "p.content", *(F.lit(None).cast("string").alias(c) for c in ("text", "message", "speaker")), F.lit(None).cast("int").alias("order"))
    said = F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("content", "text", "message")))
    place = (F.col("at") + 1).cast("long")
    return rows.select(F.coalesce("turn_id", F.format_string("turn_%04d", place)).alias("turn_id"), F.lower(F.coalesce("role", F.lit("user"))).alias("role"), said.alias("content"), "speaker", F.coalesce(F.col("order").cast("long"), place).alias("order")).where("content IS NOT NULL")


def plain_turn(line: Column | str) -> Column:
    """``struct<role, content>`` of a line: a role prefix before a colon, else the user's."""
    text = F.trim(text_of(line))
    prefix = F.lower(F.trim(F.split_part(text, F.lit(":"), F.lit(1))))
    marked = F.contains(text, F.lit(":")) & prefix.isin("user", "assistant", "human", "ai", "用户", "助手")
    return F.struct(F.when(marked & prefix.isin("assistant", "ai", "助手"), "assistant").otherwise("user").alias("role"), F.when(marked, F.trim(F.regexp_replace(text, "^[^:]*:", ""))).otherwise(text).alias("content"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; malformed lines raise, a missing file is an empty frame."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed run outputs: only those of status parsed."""
    return spark.read.schema(schema).json(path, multiLine=True).where("status = 'parsed'")


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("data", T.StringType()), T.StructField("error", T.StringType())]))
def model_json(texts: pd.Series) -> pd.DataFrame:
    """The JSON value in a model's answer: a fenced block, the whole text, or the outermost brackets; closing brackets too many are dropped."""

    def tries(text: str) -> Iterator[str]:
        if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I):
            yield m[1].strip()
        yield text
        if m := re.search(r"[\[{].*[\]}]", text, re.S):
            yield m[0]

    def one(text: str | None) -> tuple[bool, str | None, str | None]:
        text, error = (text or "").strip(), "empty output"
        for candidate in tries(text) if text else ():
            for _ in range(8):
                try:
                    return True, json.dumps(json.loads(candidate), ensure_ascii=False), None
                except json.JSONDecodeError as e:
                    error, at = str(e), e.pos
                    before = candidate[:at].rstrip()
                    if e.msg == "Extra data":
                        candidate = before
                    elif candidate[at : at + 1] == "," and re.match(r",\s*[}\]]", candidate[at:]):
                        candidate = candidate[:at] + candidate[at + 1 :]
                    elif before[-1:] == "," and candidate[at : at + 1] in ("}", "]"):
                        candidate = before[:-1] + candidate[at:]
                    elif candidate[at : at + 1] in ("}", "]"):
                        candidate = candidate[:at] + candidate[at + 1 :]  # a closing sign too many
                    else:
                        break
        return False, None, error

    return pd.DataFrame([one(t) for t in texts], columns=["ok", "data", "error"])


def kg_records(raw: DataFrame, text: str = "raw_text") -> DataFrame:
    """Records of a knowledge-graph answer, one row a line of four (entity) or five (relation) fields; others go.

    ``<|#|>`` separates fields, also where its first sign is missing. Entities without a description and relations of a
    name to itself go.
    """
    fixed = F.regexp_replace(text_of(text), r"(?<!<)\|#\|>", "<|#|>")
    lines = raw.select("*", F.posexplode(F.split(fixed, "\n")).alias("line_no", "line")).withColumn("f", F.transform(F.split("line", r"<\|#\|>"), F.trim))
    kind, n = F.lower(F.get("f", F.lit(0))), F.size("f")
    at = lambda i: F.get("f", F.lit(i))
    entity, relation = (kind == "entity") & (n == 4) & (at(1) != "") & (at(3) != ""), kind.isin("relation", "relationship") & (n == 5) & (at(1) != at(2)) & (at(1) != "") & (at(2) != "") & (at(4) != "")
    return lines.where(entity | relation).select(
        *raw.columns, "line_no", F.when(entity, "entity").otherwise("relation").alias("kind"), F.when(entity, at(1)).alias("entity_name"), F.when(entity, at(2)).alias("entity_type"), F.when(~entity, at(1)).alias("src_id"), F.when(~entity, at(2)).alias("tgt_id"), F.when(~entity, at(3)).alias("keywords"), F.when(entity, at(3)).otherwise(at(4)).alias("description")
    )


_AUTHOR_LISTS = ("entities", "author_defined_entities", "characters")
_AUTHOR_NAMES = {"canonical_name": ("canonical_name", "name", "surface", "entity", "id"), "entity_type": ("entity_type", "type"), "description": ("description", "bio", "profile", "summary")}


def _author_records(text: str, path: str) -> list[dict]:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        values = [json.loads(line) for line in text.splitlines() if line.strip()]
    elif suffix in ("yaml", "yml"):
        import yaml  # not part of every installation; a profile in YAML needs it

        values = yaml.safe_load(text)
    else:
        values = json.loads(text)
    if isinstance(values, dict):
        values = next((values[k] for k in _AUTHOR_LISTS if isinstance(values.get(k), list)), [values])
    return [v for v in values or [] if isinstance(v, dict)]


def author_entities(spark: SparkSession, path: str) -> DataFrame:
    """Author profiles from JSON, JSON lines or YAML files: an object, a list, or a list under a known name.

    ``canonical_name, entity_type, aliases, description, profile, initial_state, entity_id, source_path``; the type is character if
    none is given, ``profile`` and ``initial_state`` are JSON texts. Records without a name go.
    """
    from ..functions.rules import entity_type

    schema = "canonical_name string, entity_type string, aliases array<string>, description string, profile string, initial_state string, entity_id string, record_index int, source_path string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                for i, r in enumerate(_author_records(bytes(content).decode("utf-8"), name), 1):
                    said = {f: next((v.strip() for k in keys if isinstance(v := r.get(k), str) and v.strip()), "") for f, keys in _AUTHOR_NAMES.items()}
                    given = r.get("aliases") or r.get("alias") or r.get("names") or []
                    aliases = [str(a).strip() for a in (given if isinstance(given, list) else [given]) if str(a).strip()]
                    profile = next((r[k] for k in ("author_profile", "profile") if isinstance(r.get(k), dict)), {})
                    state = r.get("initial_state") if isinstance(r.get("initial_state"), dict) else {}
                    rows.append((said["canonical_name"], said["entity_type"] or "character", sorted({a for a in [said["canonical_name"], *aliases] if a}), said["description"], json.dumps(profile, ensure_ascii=False), json.dumps(state, ensure_ascii=False), str(r.get("entity_id") or r.get("id") or ""), i, name))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonl,yaml,yml}").load(path).select("path", "content")
    rows = files.mapInPandas(run, schema).where("canonical_name <> ''").withColumn("entity_type", entity_type("entity_type"))
    numbered_id = F.format_string("author_%s_%04d", F.col("entity_type"), F.col("record_index"))
    return rows.withColumn("entity_id", F.coalesce(F.nullif("entity_id", F.lit("")), numbered_id)).drop("record_index")


def author_mentions(entities: DataFrame) -> DataFrame:
    """Author profiles as mentions, so that the registry takes them in: ``name, entity_type, scene_id, source``, one row an alias."""
    return entities.select(F.explode("aliases").alias("name"), "entity_type", F.lit("").alias("scene_id"), F.lit("author_defined").alias("source"))


def source_filter(docs: DataFrame, paths: list[str] = (), doc_ids: list[str] = (), scopes: list[str] = ()) -> DataFrame:
    """Documents by path (full, relative or file name), id or scope; an empty filter, also one that matches nothing, filters nothing."""
    hit = F.lit(False)
    if paths:
        hit = hit | F.arrays_overlap(F.array("source_path", "relative_path", "file_name"), F.array(*map(F.lit, paths)))
    if doc_ids:
        hit = hit | F.col("doc_id").isin(*doc_ids)
    found = docs.where(hit) if paths or doc_ids else docs
    if (paths or doc_ids) and found.isEmpty():
        found = docs
    return found.where(F.col("source_scope_id").isin(*scopes)) if scopes else found
