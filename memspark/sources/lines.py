"""Large exports with a JSON object a line, read by byte ranges: a file is as many tasks as it has ranges, and no row is a file.

Spark's text source cuts files into ranges (``spark.sql.files.maxPartitionBytes``) that end with lines. A line's place is its range's first
byte and a number that rises within the range, so turns are numbered within the ranges, by what the ranges before hold; only
counts, a row a range, meet by file. Compressed files that can't be cut are one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions.text import blank_trim
from memspark.sources.formats import content_text, role_of

LINE = "type string, message struct<content:variant>, payload struct<type:string,message:variant>"


def export_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, block, at, line) of all files below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    file = F.regexp_replace("_metadata.file_path", "^\\w+:/*", "/")
    return rows.select(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def told(layout: str, role: Column, text: Column) -> Column:
    return F.struct(F.lit(layout).alias("layout"), role.alias("role"), text.alias("text"))


def line_turns(lines: DataFrame) -> DataFrame:
    """(file, layout, turn, role, text) of lines (file, block, at, line): events or, where a file has fewer than two of these and a line
    of session_meta, sessions (see `formats`). Bad lines are skipped, files of fewer than two turns are left out."""
    rows = lines.select("file", "block", "at", F.from_json("line", LINE).alias("x")).where("x is not null")
    message, kind = F.col("x.payload.message"), F.col("x.payload.type")
    plain = F.when(F.schema_of_variant(message) == "STRING", F.try_variant_get(message, "$", "string"))
    agent = F.when(kind == "user_message", "user").when(kind == "agent_message", "assistant")
    said = F.array(
        told("events", role_of(F.col("x.type")), content_text("x.message.content")),
        told("sessions", F.when(F.col("x.type") == "event_msg", agent), blank_trim(F.coalesce(plain, F.lit("")))),
        told("meta", F.when(F.col("x.type") == "session_meta", "meta"), F.lit("meta")),
    )
    turns = rows.select("file", "block", "at", F.inline(said)).where("role is not null and text <> ''")
    blocks = turns.groupBy("file", "layout", "block").agg(F.count("*").alias("n"))
    number = lambda layout: F.coalesce(F.sum(F.when(F.col("layout") == layout, F.col("n"))), F.lit(0))
    chosen = blocks.groupBy("file").agg(F.when(number("events") >= 2, "events").when((number("sessions") >= 2) & (number("meta") > 0), "sessions").alias("layout")).where("layout is not null")
    before = F.sum("n").over(Window.partitionBy("file", "layout").orderBy("block")) - F.col("n")
    placed = blocks.join(chosen, ["file", "layout"]).withColumn("before", before).drop("n")
    at = F.row_number().over(Window.partitionBy("file", "layout", "block").orderBy("at"))
    return turns.withColumn("n", at).join(placed, ["file", "layout", "block"]).select("file", "layout", (F.col("before") + F.col("n") - 1).alias("turn"), "role", "text")
