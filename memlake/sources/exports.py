"""Conversation exports, pages, mail and files as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.sources import pointers

LEAST_CHARS = 100
MAIL = "id string, thread_id string, date string, `from` string, `to` string, cc string, subject string, body string, labels array<string>, is_sent boolean, snippet string, account string, useful boolean, triage_error string"
_TIMED = "id string, title string, create_time double, update_time double"


def _records(df: DataFrame, source: str, text: Column, messages: Column, time: Column) -> DataFrame:
    """The shape of all readers: texts of LEAST_CHARS characters or more."""
    rows = df.withColumns({"__t": text, "__n": messages, "__time": time}).filter(F.length("__t") >= LEAST_CHARS)
    return rows.select(F.col("id"), F.col("title"), F.col("__time").alias("create_time"), F.date_format(F.timestamp_seconds("__time"), "yyyy-MM-dd").alias("date"), F.lit(source).alias("source"), F.col("__t").alias("text"), F.col("__n").cast("long").alias("message_count"), F.length("__t").cast("long").alias("char_count"))


def _joined(messages: Column) -> Column:
    """[ROLE]: text for each (role, text), with an empty line between."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]: "), m["text"])), "\n\n")


def read_chatgpt(spark: SparkSession, path: str) -> DataFrame:
    """A map of message nodes: those of user and assistant with text, by time."""
    node = "struct<message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>>>"
    df = spark.read.schema(f"{_TIMED}, mapping map<string,{node}>").json(path, multiLine=True)
    nodes = F.transform(F.map_values("mapping"), lambda n: F.struct(n["message"]["create_time"].alias("at"), n["message"]["author"]["role"].alias("role"), F.trim(F.array_join(F.filter(n["message"]["content"]["parts"], lambda p: ~p.startswith("{")), "\n")).alias("text")))
    rows = df.withColumn("m", F.sort_array(F.filter(nodes, lambda n: n["role"].isin("user", "assistant") & (n["text"] != ""))))
    return _records(rows, "chatgpt", _joined(F.col("m")), F.size("m"), F.col("create_time"))


def read_claude(spark: SparkSession, path: str) -> DataFrame:
    """Messages as text or content blocks, after the summary where that is over 50 characters."""
    message = "struct<sender:string,text:string,content:array<struct<type:string,text:string>>>"
    df = spark.read.schema(f"uuid string, name string, summary string, created_at string, chat_messages array<{message}>").json(path, multiLine=True)
    rows = df.withColumnsRenamed({"uuid": "id", "name": "title"})
    text = lambda m: F.coalesce(F.nullif(F.trim(m["text"]), F.lit("")), F.array_join(F.transform(F.filter(m["content"], lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"), F.lit(""))
    role = lambda m: F.when(m["sender"] == "human", "user").otherwise(m["sender"])
    rows = rows.withColumn("m", F.filter(F.transform("chat_messages", lambda m: F.struct(role(m).alias("role"), text(m).alias("text"))), lambda m: m["text"] != ""))
    head = F.when(F.length("summary") > 50, F.concat(F.lit("[SUMMARY]: "), F.col("summary"), F.lit("\n\n"))).otherwise("")
    return _records(rows, "claude", F.concat(head, _joined(F.col("m"))), F.size("m"), T.parsed_date(F.col("created_at")).cast("double"))


def read_claude_projects(spark: SparkSession, path: str) -> DataFrame:
    """A record for each project's prompt and each of its documents."""
    df = spark.read.schema("uuid string, name string, prompt_template string, created_at string, docs array<struct<uuid:string,filename:string,content:string>>").json(path, multiLine=True)
    time = T.parsed_date(F.col("created_at")).cast("double")
    prompts = df.select(F.concat(F.lit("project_"), "uuid").alias("id"), F.col("name").alias("title"), "created_at", F.col("prompt_template").alias("t"))
    docs = df.select("name", "created_at", F.explode("docs").alias("d")).select(F.col("d.uuid").alias("id"), F.concat_ws(" / ", "name", "d.filename").alias("title"), "created_at", F.col("d.content").alias("t"))
    return _records(prompts.unionByName(docs), "claude", F.coalesce("t", F.lit("")), F.lit(1), time)


def read_claude_memories(spark: SparkSession, path: str) -> DataFrame:
    """All memories of an account as one record."""
    df = spark.read.schema("account_uuid string, conversations_memory string, project_memories map<string,string>").json(path, multiLine=True)
    text = F.concat_ws("\n\n", "conversations_memory", F.array_join(F.sort_array(F.map_values("project_memories")), "\n\n"))
    rows = df.select(F.concat(F.lit("memories_"), "account_uuid").alias("id"), F.lit("Memories").alias("title"), text.alias("t"))
    return _records(rows, "claude", F.col("t"), F.lit(1), F.lit(None).cast("double"))


def read_gemini(spark: SparkSession, path: str) -> DataFrame:
    """Entries under any of four names, without thoughts."""
    entry = "struct<role:string,author:string,text:string,content:string,isThought:boolean>"
    names = ("entries", "messages", "chat_messages")
    df = spark.read.schema(f"{_TIMED}, " + ", ".join(f"{n} array<{entry}>" for n in names) + f", chunkedPrompt struct<chunks:array<{entry}>>").json(path, multiLine=True)
    found = F.coalesce(*names, "chunkedPrompt.chunks")
    role = lambda m: F.when(F.coalesce(m["role"], m["author"]).isin("model", "assistant"), "assistant").otherwise("user")
    made = F.transform(F.filter(found, lambda m: ~F.coalesce(m["isThought"], F.lit(False))), lambda m: F.struct(role(m).alias("role"), F.trim(F.coalesce(m["text"], m["content"], F.lit(""))).alias("text")))
    rows = df.withColumn("m", F.filter(made, lambda m: m["text"] != ""))
    return _records(rows, "gemini", _joined(F.col("m")), F.size("m"), F.col("create_time"))


#: Readers of exports by name; others may be added.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"chatgpt": read_chatgpt, "claude": read_claude, "claude_projects": read_claude_projects, "claude_memories": read_claude_memories, "gemini": read_gemini}


def read_conversation_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader named {kind}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path)


def conversations_to_records(turns: DataFrame) -> DataFrame:
    """(conv_id, text, message_count, char_count) from turns (conv_id, turn, role, text) of user and assistant."""
    rows = turns.filter(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    made = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.trim("text").alias("text")))).alias("m"))
    made = made.select("conv_id", _joined(F.col("m")).alias("text"), F.size("m").cast("long").alias("message_count"))
    return made.withColumn("char_count", F.length("text").cast("long")).filter(F.col("char_count") >= LEAST_CHARS)


def pages_to_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", T.html_text(F.col("html")).alias("text")).filter("text IS NOT NULL")


def read_emails(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAIL).json(path)


def write_chunks(chunks: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    chunks.write.format(kind).partitionBy(*by).save(path)


#: Extensions that a scan keeps, folders that it passes by, and parts of the names of files that it passes by.
EXTENSIONS = ("pdf", "xlsx", "xls", "csv", "tsv", "docx", "pptx", "md", "markdown")
IGNORED_FOLDERS = ("Food Tracker",)
IGNORED_NAMES = ("~$", ".tmp", "Thumbs.db", ".DS_Store")


def file_rows(files: DataFrame, root: str, denied: DataFrame | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(filepath, filename, rel_path, extension, category, hash) of files (path, content) that a store takes."""
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = files.select(path.alias("filepath"), F.sha2("content", 256).alias("hash"))
    rows = rows.withColumns({"filename": F.element_at(F.split("filepath", "/"), -1), "rel_path": F.regexp_replace("filepath", "^" + root.rstrip("/") + "/", ""), "extension": F.lower(F.regexp_extract("filepath", "\\.([^./]+)$", 1))})
    rows = rows.withColumn("category", F.when(F.instr("rel_path", "/") > 0, F.split("rel_path", "/")[0]).otherwise(""))
    rows = rows.filter(F.col("extension").isin(*extensions))
    for folder in IGNORED_FOLDERS:
        rows = rows.filter(~F.contains(F.concat(F.lit("/"), "rel_path"), F.lit(f"/{folder}/")))
    for part in IGNORED_NAMES:
        rows = rows.filter(~F.col("filename").contains(part))
    return rows if denied is None else rows.join(denied.select("filepath"), "filepath", "left_anti")


def scan_files(spark: SparkSession, root: str, denied: DataFrame | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return file_rows(files, root, denied)


def save_registry(df: DataFrame, path: str, base: int | None = None) -> int:
    """df as the version after base, the version that it was made from, or after the newest; returns its number.

    The rows are written first and become the version by a pointer file, all at once: readers see this version or the
    one before. If another writer has put a version after base, StaleBase is raised and nothing changes.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    number = 1 + (pointers.latest(spark, path)[0] if base is None else base)
    name = pointers.new_name(number)
    df.write.parquet(f"{path}/{name}")
    try:
        pointers.commit(spark, path, number, {"data": name})
    except pointers.StaleBase:
        pointers.delete(spark, f"{path}/{name}")
        raise
    return number


def registry_version(spark: SparkSession, path: str) -> int:
    """The number of the newest version; 0 without any."""
    return pointers.latest(spark, path.rstrip("/"))[0]


def load_registry(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, or the newest. Its pointer alone tells where it is: other versions aren't looked at."""
    path = path.rstrip("/")
    body = pointers.latest(spark, path)[1] if version is None else pointers.read(spark, path, version)
    if not body:
        raise ValueError(f"{path} has no version")
    return spark.read.parquet(f"{path}/{body['data']}")


def drop_old_versions(spark: SparkSession, path: str, kept: int) -> None:
    """Deletes all versions but the newest kept ones, one at least: first the pointer, then the rows."""
    path = path.rstrip("/")
    for number in pointers.committed(spark, path)[: -max(1, kept)]:
        body = pointers.read(spark, path, number)
        pointers.delete(spark, f"{path}/_pointers/{number:010d}.json")
        pointers.delete(spark, f"{path}/{body['data']}")


def append_notes(notes: DataFrame) -> DataFrame:
    """Chunk rows of notes (title, ts, summary, facts, decisions, next_steps, category): filled sections only, with an id from their content."""
    section = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), c))
    text = F.concat_ws("\n\n", section("Summary", F.col("summary")), section("Facts", F.col("facts")), section("Decisions", F.col("decisions")), section("Next steps", F.col("next_steps")))
    key = F.substring(F.sha2(F.concat_ws("|", "title", "ts", text).cast("binary"), 256), 1, 16)
    return notes.select(T.chunk_id(F.concat(F.lit("note_"), key), F.lit(0)).alias("chunk_id"), "title", F.lit("note").alias("source"), "category", text.alias("text"), F.length(text).cast("long").alias("char_count"))


def summary_rows(summaries: DataFrame) -> DataFrame:
    """Chunk rows of conversation summaries (conv_id, title, ts, summary)."""
    text = F.concat(F.lit("[CONVERSATION SUMMARY] "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("summary"))
    return summaries.select(F.concat_ws("_", F.lit("conv_summary"), "conv_id", "ts").alias("chunk_id"), F.col("conv_id").alias("original_conv_id"), "title", text.alias("text"), F.length(text).cast("long").alias("char_count"))


def manifest(files: DataFrame) -> str:
    """A one-line description of a scan, for logs."""
    row = files.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("hash").alias("contents")).first()
    return json.dumps(row.asDict())
