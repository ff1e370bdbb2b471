"""Turns paired into transcripts, texts cut into chunks, concatenated transcripts split into sessions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import BOUNDARY, SPACE, as_column, blank_trim, bound, stem
from memspark.functions.wordlists import CLOCK, MONTHS, SKIPPED_PROMPTS

#: Characters of chunks after which those of the texts so far are passed on.
CHUNKED_CHARS = 1 << 20


def pair_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, group, user_text, assistant_text): each user turn with the assistant turn right after it; other assistant turns
    alone. Other roles are left out first."""
    w = Window.partitionBy(key).orderBy("turn")
    rows = turns.where(F.col("role").isin("user", "assistant")).select(key, "turn", "role", "text", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("next_text"))
    rows = rows.where((F.col("role") == "user") | ~F.col("before").eqNullSafe("user"))
    answer = F.when(F.col("role") == "assistant", F.col("text")).when(F.col("next") == "assistant", F.col("next_text"))
    return rows.select(key, (F.row_number().over(w) - 1).cast("long").alias("group"), F.when(F.col("role") == "user", F.col("text")).alias("user_text"), answer.alias("assistant_text"))


def render_transcript(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, transcript): ``> `` before user texts, a blank line after each pair."""
    lines = F.concat_ws("\n", F.concat(F.lit("> "), F.col("user_text")), F.col("assistant_text"), F.lit(""))
    pairs = pair_turns(turns, key).select(key, F.struct("group", lines.alias("lines")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["lines"]), "\n")
    return pairs.groupBy(key).agg(joined.alias("transcript"))


def transcript_of(turns: Column) -> Column:
    """The transcript of an array of turns (role, text) of users and assistants."""
    near = lambda i, k: F.get(turns, i + k)

    def pair(x: Column, i: Column) -> Column:
        answer = F.when(near(i, 1)["role"] == "assistant", F.concat(near(i, 1)["text"], F.lit("\n"))).otherwise("")
        alone = F.coalesce(near(i, -1)["role"] != "user", F.lit(True))
        return F.when(x["role"] == "user", F.concat(F.lit("> "), x["text"], F.lit("\n"), answer)).when(alone, F.concat(x["text"], F.lit("\n")))

    return F.array_join(F.transform(turns, pair), "\n")


def quoted_lines(text: Column | str) -> Column:
    return F.size(F.filter(F.split(as_column(text), "\n"), lambda x: blank_trim(x).startswith(">")))


def exchanges(text: Column, max_lines: int = 8, min_len: int = 30) -> Column:
    """The exchanges of a text: each ``>`` line with up to 8 lines of the answer, joined by a blank. A line of dashes ends an
    answer; shorter ones are left out."""

    def parts(lines: Column) -> Column:
        opens = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith(">"), i)), lambda i: i.isNotNull())

        def exchange(at: Column, end: Column) -> Column:
            answer = F.slice(lines, at + 2, end - at - 1)
            stop = F.array_position(F.transform(answer, lambda x: x.startswith("---")), True)
            said = F.filter(F.when(stop > 0, F.slice(answer, 1, (stop - 1).cast("int"))).otherwise(answer), lambda x: x != "")
            return F.array_join(F.concat(F.slice(lines, at + 1, 1), F.slice(said, 1, max_lines)), " ")

        return bound(opens, lambda o: F.transform(o, lambda at, k: exchange(at, F.coalesce(F.get(o, k + 1), F.size(lines)))))

    return F.filter(bound(F.transform(F.split(text, "\n"), blank_trim), parts), lambda x: F.length(blank_trim(x)) > min_len)


def exchange_chunks(df: DataFrame, key: str, text: str = "text", max_lines: int = 8, min_len: int = 30) -> DataFrame:
    """(key, chunk_index, content): the exchanges of each row's text, by number; all within the row."""
    rows = df.select(key, F.posexplode(exchanges(F.col(text), max_lines, min_len)).alias("chunk_index", "content"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def paragraph_chunks(df: DataFrame, text: str = "text", sep: str = "\n\n", group: int = 25, min_len: int = 30) -> DataFrame:
    """``df`` with chunk_index and content: its paragraphs, or groups of 25 lines where a text of over 20 lines has one."""
    paragraphs = F.filter(F.transform(F.split(F.col(text), sep), blank_trim), lambda p: p != "")
    lines = F.split(F.col(text), "\n")
    groups = F.transform(F.sequence(F.lit(1), F.size(lines), F.lit(group)), lambda i: blank_trim(F.array_join(F.slice(lines, i, group), "\n")))
    pieces = F.when((F.size(paragraphs) <= 1) & (F.size(lines) > 20), groups).otherwise(paragraphs)
    kept = F.filter(pieces, lambda p: F.length(p) > min_len)
    return df.select("*", F.posexplode(kept).alias("chunk_index", "content"))


def chunk_transcripts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, chunk_index, content): by exchanges where at least three lines start with ``>``, else by paragraphs."""
    marked = df.select(key, text, (quoted_lines(text) >= 3).alias("__quoted"))
    by_exchange = exchange_chunks(marked.where("__quoted"), key, text)
    rest = paragraph_chunks(marked.where("not __quoted"), text).select(key, F.col("chunk_index").cast("long").alias("chunk_index"), "content")
    return by_exchange.unionByName(rest)


def cut(text: str | None, size: int = 800, overlap: int = 100, min_size: int = 50) -> list[str]:
    """Windows of ``size`` characters that end at a paragraph or line break in their second half, where there is one."""
    text = (text or "").strip()
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n"):
                at = text.rfind(mark, start, end + len(mark))
                if at > start + size // 2:
                    end = at
                    break
        if len(piece := text[start:end].strip()) >= min_size:
            out.append(piece)
        start = end if end >= len(text) else max(end - overlap, start + 1)
    return out


def chunk_text(df: DataFrame, text: str = "text", size: int = 800, overlap: int = 100, min_size: int = 50) -> DataFrame:
    """``df`` with chunk_index and content. Where a chunk starts follows from where the last one ended, so a small Arrow
    function cuts each text. Beside the batch as it came, a worker holds one text and about a million characters of chunks."""

    @F.arrow_udf("array<string>")
    def chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made, held = [], 0
            for x in batch:
                pieces = cut(x.as_py(), size, overlap, min_size)
                made.append(pieces)
                held += sum(map(len, pieces))
                if len(made) == 64 or held >= CHUNKED_CHARS:
                    yield pa.array(made, type=pa.list_(pa.string()))
                    made, held = [], 0
            if made:
                yield pa.array(made, type=pa.list_(pa.string()))

    return df.select("*", F.posexplode(chunks(F.col(text))).alias("chunk_index", "content"))


def split_sessions(files: DataFrame, banner: str, not_near=("Ctrl+E", "previous messages"), people=(), file: str = "file", text: str = "text", clock: str = CLOCK, skipped: tuple[str, ...] = SKIPPED_PROMPTS) -> DataFrame:
    """(file, session, ts, people, subject, file_name, content) of files that hold at least two sessions. A session starts at
    a line with ``banner`` unless it or the five lines after it have one of ``not_near``; those of under 10 lines are
    left out, their number is used up. All of it stays in the file's row."""

    def cut_at(lines: Column) -> Column:
        near = lambda i: F.array_join(F.slice(lines, i + 1, 6), "")
        # The lines beside it are looked at for lines with the banner alone.
        begins = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: reduce(lambda kept, word: kept & ~near(i).contains(word), not_near, F.get(lines, i).contains(banner)))
        part = lambda o, at, k: F.struct((k + 1).cast("long").alias("session"), F.slice(lines, at + 1, F.coalesce(F.get(o, k + 1), F.size(lines)) - at).alias("lines"))
        return bound(begins, lambda o: F.when(F.size(o) >= 2, F.transform(o, lambda at, k: part(o, at, k))))

    parts = F.filter(bound(F.split(text, "\n"), cut_at), lambda x: F.size(x["lines"]) >= 10)
    sessions = files.select(F.col(file).alias("file"), F.inline(parts))
    dated = F.get(F.filter(F.slice("lines", 1, 50), lambda x: x.rlike(clock)), F.lit(0))
    group = lambda i: F.regexp_extract(dated, clock, i)
    month = F.coalesce(F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")))[group(2)], F.lit("00"))
    ts = F.when(dated.isNotNull(), F.concat(group(4), F.lit("-"), month, F.lit("-"), F.lpad(group(3), 2, "0"), F.lit("_"), F.regexp_replace(group(1), "[: ]", "")))
    head = F.array_join(F.slice("lines", 1, 100), " ")
    named = F.array_compact(F.array(*(F.when(head.rlike(f"(?i){BOUNDARY}{p}{BOUNDARY}"), F.lit(p)) for p in people))) if people else F.lit([]).cast("array<string>")
    prompts = F.transform(F.filter("lines", lambda x: x.startswith("> ")), lambda x: blank_trim(F.substring(x, 3, 1 << 30)))
    asked = F.filter(prompts, lambda p: (F.length(p) > 5) & ~p.rlike(f"^({'|'.join(skipped)})"))
    clean = F.substring(F.regexp_replace(F.regexp_replace(F.get(asked, F.lit(0)), f"[^\\w{SPACE}-]", ""), f"[{SPACE}]+", "-"), 1, 60)
    out = sessions.select("file", F.col("session").cast("long").alias("session"), ts.alias("ts"), named.alias("people"), F.coalesce(clean, F.lit("session")).alias("subject"), F.array_join("lines", "\n").alias("content"))
    who = F.when(F.size("people") > 0, F.array_join(F.slice("people", 1, 3), "-")).otherwise("unknown")
    name = F.concat(stem("file"), F.lit("__"), F.coalesce("ts", F.concat(F.lit("part"), F.lpad(F.col("session").cast("string"), 2, "0"))), F.lit("_"), who, F.lit("_"), F.col("subject"), F.lit(".txt"))
    return out.withColumn("file_name", F.regexp_replace(F.regexp_replace(name, "[^\\w.-]", "_"), "_+", "_"))


