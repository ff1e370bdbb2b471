"""Chat exports of five layouts as turns (file, turn, role, text), and texts normalized to transcripts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import as_column, blank_trim, bound
from memspark.operators.transcripts import quoted_lines, transcript_of

ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


def role_of(role: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in ROLES.items() for x in p))[role]


def content_text(content: Column | str) -> Column:
    """The text of a JSON value (variant): a string, the strings and text items of a list, or an object's text. The value's own
    type decides, so a string may begin with any sign."""

    def item_text(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        object_text = F.when(F.try_variant_get(x, "$.type", "string") == "text", F.try_variant_get(x, "$.text", "string"))
        return F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).when(kind.startswith("OBJECT"), object_text)

    def told(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        items = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), item_text), lambda x: F.coalesce(x, F.lit("")) != "")
        text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(items, " ")).when(kind.startswith("OBJECT"), F.try_variant_get(value, "$.text", "string"))
        return blank_trim(F.coalesce(text, F.lit("")))

    return bound(as_column(content), told)


def said(turns: Column) -> Column:
    """The turns that have a role and a text."""
    return F.filter(turns, lambda t: t["role"].isNotNull() & (t["text"] != ""))


def turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def lines_of(text: Column, kind: str) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.from_json(line, kind))


def event_turns(text: Column) -> Column:
    """Lines {type, message: {content}}; bad lines are skipped."""
    lines = lines_of(text, "type string, message struct<content:variant>")
    return said(F.transform(lines, lambda x: turn(role_of(x["type"]), content_text(x["message"]["content"]))))


def session_turns(text: Column) -> Column:
    """Lines {type: event_msg, payload: {type, message}} of files that have a session_meta line. Only strings are messages."""
    role = lambda x: F.when(x["payload"]["type"] == "user_message", "user").when(x["payload"]["type"] == "agent_message", "assistant")
    message = lambda x: F.when(F.schema_of_variant(x["payload"]["message"]) == "STRING", F.try_variant_get(x["payload"]["message"], "$", "string"))

    def turns(lines: Column) -> Column:
        told = F.transform(F.filter(lines, lambda x: x["type"] == "event_msg"), lambda x: turn(role(x), blank_trim(F.coalesce(message(x), F.lit("")))))
        return F.when(F.exists(lines, lambda x: F.coalesce(x["type"] == "session_meta", F.lit(False))), said(told))

    return bound(lines_of(text, "type string, payload struct<type:string,message:variant>"), turns)


def message_turns(text: Column) -> Column:
    """A list of messages, an object with ``messages`` or ``chat_messages``, or a list of such conversations."""
    items = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    there = lambda m, path: F.when(~F.is_variant_null(F.try_variant_get(m, path, "variant")), F.try_variant_get(m, path, "variant"))
    none = items(F.parse_json(F.lit("[]")), "$")

    def flat(listed: Column) -> Column:
        nested = items(F.get(listed, F.lit(0)), "$.chat_messages").isNotNull()
        return F.when(nested, F.flatten(F.transform(listed, lambda c: F.coalesce(items(c, "$.chat_messages"), none)))).otherwise(listed)

    def message(m: Column) -> Column:
        role = F.coalesce(F.try_variant_get(m, "$.role", "string"), F.try_variant_get(m, "$.sender", "string"))
        return turn(role_of(role), content_text(F.coalesce(there(m, "$.content"), there(m, "$.text"))))

    whole = lambda v: F.coalesce(items(v, "$"), items(v, "$.messages"), items(v, "$.chat_messages"))
    return said(F.transform(bound(bound(F.try_parse_json(text), whole), flat), message))


def first_path(text: str) -> list[dict]:
    """The messages of a tree of nodes along first children."""
    try:
        nodes = json.loads(text)["mapping"]
        roots = [k for k, n in nodes.items() if not n.get("parent")]
        at = next((k for k in roots if not nodes[k].get("message")), roots[0] if roots else None)
        seen, out = set(), []
        while at in nodes and at not in seen:
            seen.add(at)
            node = nodes[at]
            message = node.get("message") or {}
            role = ROLES.get((message.get("author") or {}).get("role"))
            parts = (message.get("content") or {}).get("parts") or []
            said = " ".join(p for p in parts if isinstance(p, str) and p).strip()
            if role and said:
                out.append({"role": role, "text": said})
            at = next(iter(node.get("children") or []), None)
        return out
    except (ValueError, TypeError, KeyError, AttributeError):
        return []


def tree_turns(text: Column) -> Column:
    """{mapping: {id: {parent, message, children}}}: a small function follows the pointers of each file that has a mapping."""

    @F.arrow_udf(TURNS)
    def paths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            yield pa.array((first_path(x.as_py()) for x in batch), type=kind, size=len(batch))

    return paths(F.when(text.contains('"mapping"'), text))


def channel_roles(users: Column) -> Column:
    """The role of each message of a channel by its users: the first user is ``user``, a new one gets the role that the message
    before hasn't, roles stay. A small function goes through each channel once."""

    @F.arrow_udf("array<string>")
    def roles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for users in batch:
                known, last, row = {}, None, []
                for user in users.values.to_pylist() if users.is_valid else ():
                    last = known.setdefault(user, "assistant" if last == "user" else "user")
                    row.append(last)
                out.append(row)
            yield pa.array(out, type=pa.list_(pa.string()))

    return roles(users)


def channel_turns(text: Column) -> Column:
    """Items {type: message, user, text}, with the roles of `channel_roles`."""
    items = F.from_json(text, "array<struct<type:string,user:string,username:string,text:string>>")
    told = F.filter(items, lambda x: (x["type"] == "message") & (F.coalesce(x["user"], x["username"], F.lit("")) != "") & (blank_trim(F.coalesce(x["text"], F.lit(""))) != ""))
    roles = channel_roles(F.transform(told, lambda x: F.coalesce(x["user"], x["username"])))
    # Both lists side by side: what a lambda reads by a place outside of it would be worked out at each place.
    return F.transform(F.arrays_zip(told.alias("x"), roles.alias("role")), lambda z: turn(z["role"], blank_trim(z["x"]["text"]))).cast(TURNS)


#: By name, in the order in which they are tried.
LAYOUTS = {"events": event_turns, "sessions": session_turns, "messages": message_turns, "tree": tree_turns, "channel": channel_turns}


def turns_from(files: DataFrame, layout: str, text: str = "text") -> DataFrame:
    """(file, turn, role, text) of the files of one layout that have at least two turns."""
    rows = files.select("file", F.explode(F.array(LAYOUTS[layout](F.col(text)))).alias("t")).where(F.size("t") >= 2)
    return rows.select("file", F.posexplode("t").alias("turn", "t")).select("file", "turn", "t.role", "t.text")


def normalize(files: DataFrame) -> DataFrame:
    """(file, layout, transcript) of (file, text): blank texts and transcripts as they are, JSON by the first layout that
    gives at least two turns, anything else as it is. All within a file's own row; a layout is tried only where those before
    it gave nothing."""
    quoted = F.col("text").isNotNull() & (quoted_lines("text") >= 3)
    is_json = F.lower("file").rlike("\\.jsonl?$") | F.ltrim("text").rlike("^[\\[{]")
    # Generators of one row: what later columns read is worked out once.
    rows = files.select("file", "text", F.explode(F.array(quoted)).alias("quoted"))
    rows = rows.select("*", F.explode(F.array(F.when(~F.col("quoted") & is_json & (blank_trim("text") != ""), F.col("text")))).alias("json"))
    found = lambda name, turns: bound(turns, lambda t: F.when(F.size(t) >= 2, F.struct(F.lit(name).alias("layout"), transcript_of(t).alias("transcript"))))
    first = F.when(F.col("json").isNotNull(), F.coalesce(*(found(name, layout(F.col("json"))) for name, layout in LAYOUTS.items())))
    rows = rows.select("file", "text", "quoted", F.explode(F.array(first)).alias("found"))
    layout = F.coalesce("found.layout", F.when(F.col("quoted"), "transcript").otherwise("plain"))
    return rows.select("file", layout.alias("layout"), F.coalesce("found.transcript", "text").alias("transcript"))
