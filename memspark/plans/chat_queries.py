"""Queries over the conversations as chat exports, files and questions, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators import drawers, evaluate, transcripts
from memspark.plans.queries import EXCHANGES, PAIRS, SQL, SQL_TOPIC, query, sql_trim, t
from memspark.plans.shared import shared_path
from memspark.sources import files, formats, lines


def talks(spark, d) -> DataFrame:
    """(conv_id, turns): the users' and assistants' turns of each conversation in order."""
    rows = t(spark, d, "conversations").where("role in ('user', 'assistant')")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def file_of(end: str) -> Column:
    return F.concat(F.lit("chat"), F.col("conv_id").cast("string"), F.lit(end)).alias("file")


def listed(x: Column) -> Column:
    """Every third text as a list with a picture beside it, every other third as an object."""
    item = lambda f: F.to_json(f)
    as_list = F.concat(F.lit('[{"type":"text","text":'), quoted_json(x["text"]), F.lit('},{"type":"image"}]'))
    return F.when(x["turn"] % 3 == 1, as_list).when(x["turn"] % 3 == 2, item(F.struct(x["text"].alias("text")))).otherwise(quoted_json(x["text"]))


def quoted_json(text: Column) -> Column:
    """A JSON string: what to_json writes of a field, without the field."""
    made = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("a")))
    return F.substring(made, F.lit(6), F.length(made) - 6)


def event_files(spark, d) -> DataFrame:
    kind = lambda x: F.when(x["role"] == "user", "human").otherwise(x["role"])
    line = lambda x: F.concat(F.lit('{"type":"'), kind(x), F.lit('","message":{"content":'), listed(x), F.lit("}}"))
    return talks(spark, d).select("conv_id", F.concat(F.lit("no json\n"), F.array_join(F.transform("turns", line), "\n")).alias("text"))


def session_files(spark, d) -> DataFrame:
    kind = lambda x: F.when(x["role"] == "user", "user_message").otherwise("agent_message")
    line = lambda x: F.concat(F.lit('{"type":"event_msg","payload":{"type":"'), kind(x), F.lit('","message":'), quoted_json(x["text"]), F.lit('}}\n{"type":"event_msg","payload":{"type":"user_message","message":[1]}}'))
    return talks(spark, d).select("conv_id", F.concat(F.lit('{"type":"session_meta"}\n'), F.array_join(F.transform("turns", line), "\n")).alias("text"))


def message_files(spark, d) -> DataFrame:
    """By number: an object with messages, a bare list, or a list of conversations of one message each."""
    line = lambda x: F.concat(F.lit('{"role":"'), x["role"], F.lit('","content":'), listed(x), F.lit("}"))
    plain = F.concat(F.lit("["), F.array_join(F.transform("turns", line), ","), F.lit("]"))
    nested = F.concat(F.lit("["), F.array_join(F.transform("turns", lambda x: F.concat(F.lit('{"chat_messages":['), line(x), F.lit("]}"))), ","), F.lit("]"))
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('{"messages":'), plain, F.lit("}"))).when(F.col("conv_id") % 3 == 1, plain).otherwise(nested)
    return talks(spark, d).select("conv_id", text.alias("text"))


def tree_files(spark, d) -> DataFrame:
    """Each turn a node below the one before it, with a second child that isn't followed."""
    message = lambda x: F.concat(F.lit('{"author":{"role":"'), x["role"], F.lit('"},"content":{"parts":['), quoted_json(x["text"]), F.lit(",null]}}"))
    node = lambda x, i: F.concat(F.lit('"n'), (i + 1).cast("string"), F.lit('":{"parent":"n'), i.cast("string"), F.lit('","message":'), message(x), F.lit(',"children":["n'), (i + 2).cast("string"), F.lit('","other"]}'))
    return talks(spark, d).select("conv_id", F.concat(F.lit('{"mapping":{"n0":{"children":["n1"]},'), F.array_join(F.transform("turns", node), ","), F.lit("}}")).alias("text"))


def channel_files(spark, d) -> DataFrame:
    item = lambda x: F.concat(F.lit('{"type":"message","user":"U '), x["role"], F.lit('","text":'), quoted_json(x["text"]), F.lit('},{"type":"join","user":"U9","text":"hi"}'))
    return talks(spark, d).select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("turns", item), ","), F.lit("]")).alias("text"))


EXPORTS = {"events": (event_files, ".jsonl"), "sessions": (session_files, ".jsonl"), "messages": (message_files, ".json"), "tree": (tree_files, ".json"), "channel": (channel_files, ".json")}
TOLD = f"""
told AS (SELECT conv_id, turn, role, {sql_trim("coalesce(text, '')")} AS text FROM conversations WHERE role IN ('user', 'assistant')),
kept AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, first_value(role) OVER w AS first_role FROM told WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))"""


def exported(name: str):
    make, end = EXPORTS[name]

    def turns(spark, d):
        return formats.turns_from(make(spark, d).select(file_of(end), "text"), name).withColumn("turn", F.col("turn").cast("long"))

    turns.__name__ = f"chat_{name}"
    role = "CASE WHEN role = first_role THEN 'user' ELSE 'assistant' END" if name == "channel" else "role"
    SQL[turns.__name__] = f"WITH {TOLD} SELECT 'chat' || conv_id || '{end}' AS file, pos::BIGINT AS turn, {role} AS role, text FROM kept WHERE n >= 2"
    return query(turns)


for _name in EXPORTS:
    exported(_name)


@query
def chat_formats(spark, d):
    """Files of all five layouts, transcripts and plain texts, each normalized by its own layout. The text of a file that none
    of the layouts has is left as it is, and not told here."""
    made = None
    for i, (make, end) in enumerate(EXPORTS.values()):
        part = make(spark, d).where(F.col("conv_id") % 7 == i).select(file_of(end), "text")
        made = part if made is None else made.unionByName(part)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(F.lit("> "), F.regexp_replace(F.coalesce(x["text"], F.lit("")), "\n", " "))), "\n")
    other = talks(spark, d).where(F.col("conv_id") % 7 >= 5)
    made = made.unionByName(other.select(file_of(".txt"), F.when(F.col("conv_id") % 7 == 5, lines).otherwise("no transcript").alias("text")))
    found = formats.normalize(made)
    return found.select("file", "layout", F.when(~F.col("layout").isin("plain", "transcript"), F.col("transcript")).alias("transcript"))


SQL["chat_formats"] = f"""
WITH {TOLD}, roled AS (SELECT conv_id, pos, n, text, CASE WHEN conv_id % 7 = 4 AND role <> first_role THEN 'assistant' WHEN conv_id % 7 = 4 THEN 'user' ELSE role END AS role FROM kept),
near AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM roled WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
lines_ AS (SELECT conv_id, n, pos, CASE WHEN role = 'user' THEN '> ' || text || chr(10) || CASE WHEN next_role = 'assistant' THEN next_text || chr(10) ELSE '' END
                                WHEN before IS DISTINCT FROM 'user' THEN text || chr(10) END AS line FROM near),
scripts AS (SELECT conv_id, n, string_agg(line, chr(10) ORDER BY pos) AS transcript FROM lines_ GROUP BY conv_id, n),
every AS (SELECT conv_id, count(*) AS turns FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id),
found AS (SELECT e.conv_id, e.turns, s.transcript, s.n FROM every e LEFT JOIN scripts s ON s.conv_id = e.conv_id),
kinds AS (SELECT *, CASE WHEN conv_id % 7 = 5 AND turns >= 3 THEN 'transcript' WHEN conv_id % 7 >= 5 OR coalesce(n, 0) < 2 THEN 'plain'
          ELSE ['events', 'sessions', 'messages', 'tree', 'channel'][(conv_id % 7 + 1)::INT] END AS layout FROM found)
SELECT 'chat' || conv_id || ['.jsonl', '.jsonl', '.json', '.json', '.json', '.txt', '.txt'][(conv_id % 7 + 1)::INT] AS file, layout,
       CASE WHEN layout NOT IN ('plain', 'transcript') THEN transcript END AS transcript FROM kinds"""


@query
def json_texts(spark, d):
    """The text of JSON values: a string, a list, an object, and a number, which has none."""
    x = F.col("text")
    value = F.when(F.col("doc_id") % 4 == 0, quoted_json(x)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('["[x]",{"type":"text","text":'), quoted_json(x), F.lit('},{"type":"image","text":"no"},7,""]')))
    value = value.when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{"text":'), quoted_json(x), F.lit("}"))).otherwise("7")
    rows = t(spark, d, "documents").select("doc_id", F.explode(F.array(formats.content_text(F.parse_json(value)))).alias("said"))
    return rows.select("doc_id", F.length("said").cast("long").alias("n_chars"), F.md5("said").alias("digest"))


SQL["json_texts"] = f"""
WITH s AS (SELECT doc_id, {sql_trim("CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN '[x]' || CASE WHEN coalesce(text, '') <> '' THEN ' ' || text ELSE '' END WHEN 2 THEN coalesce(text, '') ELSE '' END")} AS said FROM documents)
SELECT doc_id, length(said)::BIGINT AS n_chars, md5(said) AS digest FROM s"""

PARAGRAPHS = f"""
paras AS (SELECT conv_id, transcript, list_filter(list_transform(string_split(transcript, chr(10) || chr(10)), lambda x: {sql_trim("x")}), lambda x: x <> '') AS ps, string_split(transcript, chr(10)) AS ls FROM scripts),
pieces AS (SELECT conv_id, list_filter(CASE WHEN len(ps) <= 1 AND len(ls) > 20 THEN list_transform(range(0, (len(ls) + 24) // 25), lambda i: {sql_trim("array_to_string(ls[25 * i + 1:25 * i + 25], chr(10))")}) ELSE ps END, lambda x: length(x) > 30) AS ps FROM paras),
marked AS (SELECT conv_id, transcript, len(list_filter(string_split(transcript, chr(10)), lambda x: starts_with({sql_trim("x")}, '>'))) >= 3 AS quoted FROM scripts),
para_chunks AS (SELECT conv_id, (generate_subscripts(ps, 1) - 1)::BIGINT AS chunk_index, unnest(ps) AS content FROM pieces),
all_chunks AS (SELECT c.* FROM ex_chunks c JOIN marked m ON m.conv_id = c.conv_id WHERE quoted UNION ALL SELECT c.* FROM para_chunks c JOIN marked m ON m.conv_id = c.conv_id WHERE NOT quoted)"""


def chat_transcripts(spark, d) -> DataFrame:
    texts = transcripts.render_transcript(t(spark, d, "conversations"))
    return texts.select("conv_id", F.concat(F.lit("/chats/chat"), F.col("conv_id").cast("string"), F.lit(".md")).alias("source_file"), (F.col("conv_id") * 1.0 + 1).alias("source_mtime"), F.col("transcript").alias("text"))


@query
def chosen_chunks(spark, d):
    """Transcripts cut by exchanges or, with fewer than three of these, by paragraphs."""
    return transcripts.chunk_transcripts(chat_transcripts(spark, d), "conv_id")


SQL["chosen_chunks"] = f"WITH {PAIRS}, {EXCHANGES}, {PARAGRAPHS} SELECT conv_id, chunk_index, content FROM all_chunks"


@query
def mined_conversations(spark, d):
    """Drawers of the transcripts of at least 600 characters, but for every fifth, which is stored already."""
    texts = chat_transcripts(spark, d)
    stored = texts.where("conv_id % 5 = 0").select("source_file", "source_mtime", F.lit("chats").alias("wing"))
    rows = drawers.mine_conversations(texts.drop("conv_id"), stored, "chats", "m", "2026-01-01", 600)
    return rows.select("id", "wing", "room", "source_file", F.col("chunk_index").cast("long").alias("chunk_index"), "content", "added_by", "filed_at")


SQL["mined_conversations"] = f"""
WITH {PAIRS}, {EXCHANGES}, {PARAGRAPHS},
about AS (SELECT conv_id, '/chats/chat' || conv_id || '.md' AS source_file, {SQL_TOPIC("transcript")} AS room FROM scripts WHERE length(transcript) >= 600 AND conv_id % 5 <> 0)
SELECT 'drawer_chats_' || room || '_' || substr(md5(source_file || chunk_index), 1, 16) AS id, 'chats' AS wing, room, source_file, chunk_index, content, 'm' AS added_by, '2026-01-01' AS filed_at
FROM all_chunks c JOIN about a ON a.conv_id = c.conv_id"""


def written_chats(spark, d) -> str:
    """The folder to which the transcripts are written, those of fifty conversations in one file."""
    path = shared_path(spark, "chats")
    name = F.concat(F.lit("chats"), F.floor(F.col("conv_id") / 50).cast("string"), F.lit(".txt"))
    files.write_sessions(chat_transcripts(spark, d).select(name.alias("file_name"), F.col("text").alias("content")), path)
    return path


@query
def written_sessions(spark, d):
    """What the written files hold, line by line."""
    rows = spark.read.text(written_chats(spark, d))
    return rows.groupBy("file_name").agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


SQL["written_sessions"] = f"""
WITH {PAIRS}, l AS (SELECT conv_id // 50 AS k, string_split(transcript, chr(10)) AS ls FROM scripts)
SELECT 'chats' || k || '.txt' AS file_name, sum(len(ls))::BIGINT AS n_lines, sum(length(array_to_string(ls, '')))::BIGINT AS n_chars FROM l GROUP BY k"""


@query
def scanned_chats(spark, d):
    """The same files by the scan of conversation files, as whole texts."""
    rows = files.scan_conversations(spark, written_chats(spark, d))
    name = F.regexp_extract("rel_path", "file_name=([^/]+)", 1).alias("file_name")
    return rows.select(name, "text", F.startswith("source_file", F.lit("/")).alias("rooted")).groupBy("file_name").agg(F.sum(F.length("text")).cast("long").alias("n_chars"), F.sum(F.length(F.translate("text", "\n", ""))).cast("long").alias("n_plain"), F.min("rooted").alias("rooted"))


SQL["scanned_chats"] = f"""
WITH {PAIRS} SELECT 'chats' || (conv_id // 50) || '.txt' AS file_name, sum(length(transcript) + 1)::BIGINT AS n_chars, sum(length(replace(transcript, chr(10), '')))::BIGINT AS n_plain, true AS rooted
FROM scripts GROUP BY conv_id // 50"""


@query
def project_files(spark, d):
    """The same files by the scan of a project with rules of an ignore file."""
    rows = files.scan_project(spark, written_chats(spark, d), ["# none", "file_name=chats1*/", "*.md"])
    return rows.groupBy(F.regexp_extract("rel_path", "file_name=([^/]+)", 1).alias("file_name")).agg(F.sum(F.length("text")).cast("long").alias("n_chars"))


SQL["project_files"] = f"WITH {PAIRS} SELECT 'chats' || (conv_id // 50) || '.txt' AS file_name, sum(length(transcript) + 1)::BIGINT AS n_chars FROM scripts WHERE NOT starts_with((conv_id // 50)::VARCHAR, '1') GROUP BY conv_id // 50"


def question_files(spark, d) -> str:
    """Questions of two sessions each, a conversation and its users' turns alone; fifty in a JSON document."""
    path = shared_path(spark, "questions")
    turns = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    no = F.col("conv_id").cast("string")
    question = F.struct(
        F.concat(F.lit("q"), no).alias("question_id"), F.concat(F.lit("what of "), no).alias("question"),
        F.array(F.transform("turns", turns), F.transform(F.filter("turns", lambda x: x["role"] != "user"), turns)).alias("haystack_sessions"),
        F.array(F.concat(F.lit("s"), no), F.concat(F.lit("r"), no)).alias("haystack_session_ids"), F.array(F.lit("2026-01-01"), F.lit("2026-01-02")).alias("haystack_dates"), F.array(F.concat(F.lit("s"), no)).alias("answer_session_ids"),
    )
    rows = rows.select(F.floor(F.col("conv_id") / 50).alias("part"), question.alias("q")).groupBy("part").agg(F.to_json(F.array_sort(F.collect_list("q"))).alias("value"))
    rows.write.partitionBy("part").text(path)
    return path


@query
def benchmark_questions(spark, d):
    rows = files.read_questions(spark, question_files(spark, d))
    return rows.select("question_id", "question", F.size("haystack_sessions").cast("long").alias("n_sessions"), F.array_join("haystack_session_ids", ",").alias("session_ids"), F.array_join("haystack_dates", ",").alias("dates"), F.array_join("answer_session_ids", ",").alias("answers"))


SQL["benchmark_questions"] = "SELECT DISTINCT 'q' || conv_id AS question_id, 'what of ' || conv_id AS question, 2::BIGINT AS n_sessions, 's' || conv_id || ',r' || conv_id AS session_ids, '2026-01-01,2026-01-02' AS dates, 's' || conv_id AS answers FROM conversations"


@query
def session_texts(spark, d):
    """The users' turns of each session of the questions; sessions without any are left out."""
    return evaluate.session_documents(files.read_questions(spark, question_files(spark, d)))


SQL["session_texts"] = "SELECT 'q' || conv_id AS question_id, 's' || conv_id AS session_id, '2026-01-01' AS date, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations WHERE role = 'user' GROUP BY conv_id"


@query
def exported_lines(spark, d):
    """Conversations written as exports with a JSON object a line, fifty in a file, as events and as sessions in turn; read by ranges."""
    path, part = shared_path(spark, "exports"), F.floor(F.col("conv_id") / 50)
    event = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("other")
    session = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(kind.alias("type"), F.col("text").alias("message")).alias("payload")))
    rows = t(spark, d, "conversations").select(part.alias("part"), "conv_id", "turn", F.when(part % 2 == 0, event).otherwise(session).alias("value"))
    meta = rows.select("part").distinct().select("part", F.lit(-1).cast("long").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.lit('{"type": "session_meta"}').alias("value"))
    rows.unionByName(meta).repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value").write.partitionBy("part").text(path)
    name = F.regexp_extract("file", "part=([0-9]+)", 1).alias("part")
    return lines.line_turns(lines.export_lines(spark, path)).select(name, "layout", "turn", "role", "text")


SQL["exported_lines"] = f"""
WITH x AS (SELECT conv_id // 50 AS part, conv_id, turn, role, {sql_trim("text")} AS text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY conv_id, turn) - 1 AS n FROM x WHERE role IN ('user', 'assistant') AND text <> '')
SELECT part::VARCHAR AS part, CASE WHEN part % 2 = 0 THEN 'events' ELSE 'sessions' END AS layout, n AS turn, role, text FROM k"""
