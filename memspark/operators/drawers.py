"""The drawer store: incremental mining, upserts, deletes, listings, counts and budgeted context texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions.extract import compress
from memspark.functions.routing import convo_room, drawer_id, project_room
from memspark.functions.text import base_name, or_default, snippet
from memspark.operators.transcripts import chunk_text, chunk_transcripts

DRAWER = T.StructType().add("id", "string").add("vector", T.ArrayType(T.FloatType())).add("content", "string").add("wing", "string").add("room", "string").add("source_file", "string").add("source_mtime", "double").add("chunk_index", "integer").add("added_by", "string").add("filed_at", "string").add("hall", "string").add("topic", "string").add("type", "string").add("agent", "string").add("date", "string").add("importance", "integer")


def as_drawers(df: DataFrame) -> DataFrame:
    """The columns of `DRAWER`; those that are missing get '' or 0, vector and importance null."""
    out = []
    for f in DRAWER:
        plain = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        default = {"string": "", "double": 0.0, "int": 0}.get(f.dataType.simpleString())
        out.append((plain if default is None or f.name == "importance" else F.coalesce(plain, F.lit(default).cast(f.dataType))).alias(f.name))
    return df.select(*out)


def unchanged_files(current: DataFrame, stored: DataFrame, wing: str | None = None, tol_ms: float = 1.0) -> DataFrame:
    """(source_file, source_mtime, changed) for each current file: unchanged if stored within the tolerance. Of several
    stored times the latest counts."""
    known = stored if wing is None else stored.where(F.col("wing") == wing)
    known = known.groupBy("source_file").agg(F.max("source_mtime").alias("__stored"))
    same = F.col("__stored").isNotNull() & (F.col("__stored") != 0) & (F.abs(F.col("__stored") - F.col("source_mtime")) < tol_ms)
    return current.join(known, "source_file", "left").select("source_file", "source_mtime", (~F.coalesce(same, F.lit(False))).alias("changed"))


def file_mtime(drawers: DataFrame, source_file: str) -> DataFrame:
    return drawers.where(F.col("source_file") == source_file).agg(F.nullif(F.max("source_mtime"), F.lit(0.0)).alias("source_mtime"))


def append_drawers(df: DataFrame, path: str, files_per_wing: int = 8) -> None:
    """Appends; large wings are spread over several files."""
    rows = as_drawers(df)
    rows.repartition("wing", F.pmod(F.xxhash64("id"), F.lit(files_per_wing))).write.mode("append").partitionBy("wing").parquet(path)


def read_drawers(spark: SparkSession, path: str) -> DataFrame:
    return as_drawers(spark.read.option("mergeSchema", "true").parquet(path))


def latest_drawers(stored: DataFrame, incoming: DataFrame, key: str = "id", order: str = "filed_at") -> DataFrame:
    """A real upsert: of the rows of one key the newest; of equals the incoming one."""
    rows = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("__new"), *(F.desc(c) for c in ("chunk_index", "content") if c in rows.columns)))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new")


def delete_drawers(drawers: DataFrame, ids: DataFrame) -> DataFrame:
    return drawers.join(ids.select("id"), "id", "left_anti")


def clear_drawers(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], DRAWER).write.mode("overwrite").parquet(path)


def in_place(drawers: DataFrame, wing: str | None = None, room: str | None = None) -> DataFrame:
    for name, value in (("wing", wing), ("room", room)):
        if value is not None:
            drawers = drawers.where(F.col(name) == value)
    return drawers


def list_drawers(drawers: DataFrame, limit: int = 10, wing: str | None = None, room: str | None = None) -> DataFrame:
    return in_place(drawers, wing, room).orderBy("filed_at", "id").limit(limit)


def diary_entries(df: DataFrame, now: str) -> DataFrame:
    """Drawers of (agent, entry, topic)."""
    wing = F.concat(F.lit("agent_"), F.lower("agent"))
    rows = df.select(F.col("entry").alias("content"), wing.alias("wing"), F.lit("diary").alias("room"), or_default("topic", "general").alias("topic"), "agent", F.col("agent").alias("added_by"), F.lit(now).alias("filed_at"), F.lit("diary_entry").alias("type"))
    return as_drawers(rows.withColumn("id", F.concat(F.lit("diary_"), F.md5(F.concat_ws("|", "wing", "filed_at", "content").cast("binary")))))


def read_diary(drawers: DataFrame, agent: str, limit: int = 10) -> DataFrame:
    return list_drawers(drawers, limit, f"agent_{agent.lower()}", "diary")


def mine_project(files: DataFrame, stored: DataFrame, wing: str, rooms: tuple = (), agent: str = "miner", now: str = "") -> DataFrame:
    """Drawers of the files (rel_path, source_file, source_mtime, text) that changed since they were stored."""
    changed = unchanged_files(files, stored, wing).where("changed").select("source_file")
    fresh = files.join(changed, "source_file", "left_semi").withColumn("room", project_room("rel_path", "text", rooms))
    return filed(chunk_text(fresh), wing, agent, now)


def mine_conversations(files: DataFrame, stored: DataFrame, wing: str, agent: str = "miner", now: str = "", min_chars: int = 30) -> DataFrame:
    """Drawers of the transcripts (source_file, source_mtime, text) that changed and have at least 30 characters."""
    changed = unchanged_files(files, stored, wing).where("changed").select("source_file")
    fresh = files.join(changed, "source_file", "left_semi").where(F.length("text") >= min_chars)
    about = fresh.select("source_file", "source_mtime", convo_room("text").alias("room"))
    return filed(chunk_transcripts(fresh, "source_file").join(about, "source_file"), wing, agent, now)


def filed(chunks: DataFrame, wing: str, agent: str, now: str) -> DataFrame:
    rows = chunks.withColumns({"wing": F.lit(wing), "added_by": F.lit(agent), "filed_at": F.lit(now)})
    return as_drawers(rows.withColumn("id", drawer_id("wing", "room", "source_file", "chunk_index")))


def wing_room_totals(drawers: DataFrame) -> DataFrame:
    """(level, key, n) by wing, by room and in all, in one pass; '' and null are ``unknown``."""
    named = drawers.select(or_default("wing", "unknown").alias("wing"), or_default("room", "unknown").alias("room"))
    sets = named.groupingSets([[F.col("wing")], [F.col("room")], []], "wing", "room").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    level = F.when(F.col("g") == 1, "wing").when(F.col("g") == 2, "room").otherwise("total")
    return sets.select(level.alias("level"), F.coalesce("wing", "room", F.lit("")).alias("key"), "n")


def rooms(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    return in_place(drawers, wing).groupBy("room").agg(F.count("*").alias("n"))


def taxonomy(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("wing", "room").agg(F.count("*").alias("n"))


def taxonomy_nested(drawers: DataFrame) -> DataFrame:
    """(wing, rooms): a map from room to count."""
    return taxonomy(drawers).groupBy("wing").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("room", "n")))).alias("rooms"))


def identity_text(text: str | None = None, notice: str = "## L0 — IDENTITY\nNo identity configured.") -> Column:
    return F.lit(text.strip() if text and text.strip() else notice)


def identity_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def essential_story(drawers: DataFrame, wing: str | None = None, pool: int = 100, top: int = 15, budget: int = 3200, title: str = "## L1 — ESSENTIAL STORY") -> DataFrame:
    """(wing, text): the most important drawers of the first ``pool`` of each wing, by room, compressed, within a budget of
    characters. Rooms come in the order of their best drawer; a room's heading over the budget ends the text, a line
    over it ends the text with a notice."""
    w = Window.partitionBy("wing")
    rows = in_place(drawers, wing).withColumn("__seen", F.row_number().over(w.orderBy("filed_at", "id"))).where(F.col("__seen") <= pool)
    rows = rows.withColumn("__rank", F.row_number().over(w.orderBy(F.desc(or_default("importance", 3)), "__seen"))).where(F.col("__rank") <= top)
    rows = rows.withColumn("room", or_default("room", "general"))
    rows = compress(rows, text="content").withColumn("__first", F.min("__rank").over(Window.partitionBy("wing", "room")))
    line = F.concat(F.lit("  "), F.regexp_replace("compressed", "\n", " | "))
    order = w.orderBy("__first", "__rank")
    rows = rows.select("wing", "room", "__first", "__rank", line.alias("line"), (F.col("__rank") == F.col("__first")).alias("heads"))
    head = F.when(F.col("heads"), F.length("room") + 3).otherwise(0)
    rows = rows.withColumn("head", head).withColumn("before", 30 + F.coalesce(F.sum(F.col("head") + F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("head_fits", F.col("before") + F.col("head") <= budget).withColumn("fits", F.col("before") + F.col("head") + F.length("line") <= budget)
    rows = rows.withColumn("stopped", F.coalesce(F.max(~F.col("fits")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("not stopped and head_fits")
    heading = F.when(F.col("heads"), F.concat(F.lit("\n["), F.col("room"), F.lit("]"))).otherwise("")
    part = F.concat(heading, F.when(F.col("fits"), F.concat(F.lit("\n"), F.col("line"))).otherwise("\n  ... (more in L3 search)"))
    parts = rows.groupBy("wing").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__first", "__rank", part.alias("part")))), lambda x: x["part"]), "").alias("text"))
    return parts.select("wing", F.concat(F.lit(title), F.col("text")).alias("text"))


def wake_up(drawers: DataFrame, identity: str | None = None, wing: str | None = None) -> DataFrame:
    return essential_story(drawers, wing).select("wing", F.concat(identity_text(identity), F.lit("\n\n"), F.col("text")).alias("text"))


def recall(drawers: DataFrame, wing: str | None = None, room: str | None = None, n: int = 10) -> DataFrame:
    """One row: a heading with the count, then ``[room] snippet (file)`` of each listed drawer."""
    listed = list_drawers(drawers, n, wing, room)
    line = F.concat(F.lit("  ["), or_default("room", "?"), F.lit("] "), snippet(F.regexp_replace("content", "\n", " ")), F.when(or_default("source_file", "") != "", F.concat(F.lit("  ("), base_name("source_file"), F.lit(")"))).otherwise(""))
    lines = listed.select(F.struct("filed_at", "id", line.alias("line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select(F.concat(F.lit("## L2 — ON-DEMAND ("), F.size("x").cast("string"), F.lit(" drawers)\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))
