"""Project files, chat files, registries, questions and the knowledge graph's tables as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.wordlists import CHAT_EXTENSIONS, READABLE_EXTENSIONS, SKIPPED_FOLDERS
from memspark.operators.entities import Registry
from memspark.operators.kg import ENTITY, TRIPLE


def ignore_rule(pattern: str) -> str | None:
    """The regex of a line of an ignore file, for paths relative to its folder."""
    pattern = pattern.rstrip()
    if not pattern or pattern.startswith(("#", "!")):
        return None
    folder = pattern.endswith("/")
    rooted = "/" in pattern.rstrip("/")
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?|\[[^]]*\])", pattern.strip("/")):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, part if part.startswith("[") and part.endswith("]") else re.sub(r"([^\w/ ])", r"\\\1", part))
    return ("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, rel_path, source_file, source_mtime, text) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit(re.sub(r"^\w+:/*", "/", path).rstrip("/") + "/")
    plain = F.regexp_replace("path", "^\\w+:/*", "/")
    rel = F.when(F.startswith(plain, root), F.substring(plain, F.length(root) + 1, F.length(plain))).otherwise(plain)
    return files.select("path", rel.alias("rel_path"), plain.alias("source_file"), (F.unix_micros("modificationTime") / 1000.0).alias("source_mtime"), F.decode("content", "UTF-8").alias("text"))


def kept_files(files: DataFrame, extensions, any_case: bool, skipped, ignore=()) -> DataFrame:
    ends = "|".join(re.escape(x) for x in extensions)
    rows = files.where(F.col("rel_path").rlike(f"{'(?i)' if any_case else ''}[^/](?:{ends})$"))
    rows = rows.where(~F.col("rel_path").rlike(f"(?:^|/)(?:{'|'.join(re.escape(x) for x in skipped)})/"))
    for rule in filter(None, map(ignore_rule, ignore)):
        rows = rows.where(~F.col("rel_path").rlike(rule))
    return rows


def scan_project(spark: SparkSession, path: str, ignore_patterns=(), extensions=READABLE_EXTENSIONS, skipped=SKIPPED_FOLDERS) -> DataFrame:
    """Readable files of a project; ``ignore_patterns`` are the lines of its root ignore file."""
    return kept_files(read_files(spark, path), extensions, False, skipped, ignore_patterns)


def scan_conversations(spark: SparkSession, path: str) -> DataFrame:
    return kept_files(read_files(spark, path), CHAT_EXTENSIONS, True, (".git", "node_modules", "__pycache__"))


def read_registry(spark: SparkSession, path: str) -> Registry:
    """A JSON document {mode, people: {name: {...}}, projects: [...], ambiguous_flags: [...], wiki_cache: {word: {...}}}."""
    kind = "mode string, people map<string,struct<type:string,source:string,confidence:double,relationship:string,aliases:array<string>>>, projects array<string>, ambiguous_flags array<string>, wiki_cache map<string,struct<inferred_type:string,confidence:double,confirmed:boolean>>"
    doc = spark.read.option("multiLine", True).schema(kind).json(path)
    people = doc.select(F.explode("people").alias("name", "p")).select("name", F.coalesce("p.type", F.lit("person")).alias("type"), "p.source", F.coalesce("p.confidence", F.lit(1.0)).alias("confidence"), "p.relationship", F.coalesce("p.aliases", F.lit([]).cast("array<string>")).alias("aliases"))
    cache = doc.select(F.explode("wiki_cache").alias("word", "w")).select("word", F.col("w.inferred_type").alias("type"), "w.confidence", F.coalesce("w.confirmed", F.lit(False)).alias("confirmed"))
    mode = doc.select(F.coalesce("mode", F.lit("personal"))).first()
    return Registry(people, doc.select(F.explode("projects").alias("name")), cache, doc.select(F.explode("ambiguous_flags").alias("name")), mode[0] if mode else "personal")


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    kind = "question_id string, question string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_session_ids array<string>, haystack_dates array<string>, answer_session_ids array<string>"
    rows = spark.read.option("multiLine", True).schema(kind).json(path)
    return rows if limit is None else rows.limit(limit)


def read_kg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(ENTITY).parquet(f"{path}/entities"), spark.read.schema(TRIPLE).parquet(f"{path}/triples")


def write_kg(entities: DataFrame, triples: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    triples.write.mode("overwrite").parquet(f"{path}/triples")


def write_sessions(sessions: DataFrame, path: str) -> None:
    """A folder for each session's file name with its text."""
    sessions.select("file_name", "content").repartition("file_name").write.partitionBy("file_name").text(path)
