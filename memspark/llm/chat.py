"""Chat records of many layouts, found by schema fingerprints, formatted by one template with a loss mask.

A fingerprint is a hash of the nested field paths that a record (or a table) has, of those that any layout names; other fields
and columns don't change it. It selects a declarative layout, which says where the turns are. JSON records are looked at one
by one, so a column may hold all layouts together.

The template marks turns with control strings. Inside texts a backslash is doubled and one is put behind the first character
of every control string, so no text can be taken for a mark and every text can be read back whole. The loss mask is a list of
character spans of the formatted string: one for each assistant text.

Null texts and roles count as empty. A conversation without turns formats as the empty string. Turns with the same number
are ordered by role, then text; repeated rows are turns of their own. One conversation is one record: its turns come
together in one task. Records whose fingerprint no layout has give null turns, and null for all that is made of them. An
empty table gives an empty table; other columns stay, but for those of the result's names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.llm.batches import unused

#: Where each layout has its turns. "list": a field of items with a role and a text; "turns": fields in order, those of
#: one turn joined by a blank line; "rows": a table with a row for each turn.
LAYOUTS: dict[str, dict] = {
    "messages": {"paths": ("messages[].role", "messages[].content"), "list": "messages", "role": "role", "text": "content"},
    "exchange": {"paths": ("conversations[].from", "conversations[].value"), "list": "conversations", "role": "from", "text": "value"},
    "instruction": {"paths": ("instruction", "output"), "turns": (("user", ("instruction",)), ("assistant", ("output",)))},
    "instruction_input": {"paths": ("instruction", "input", "output"), "turns": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    "prompt_completion": {"paths": ("prompt", "completion"), "turns": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "prompt_response": {"paths": ("prompt", "response"), "turns": (("user", ("prompt",)), ("assistant", ("response",)))},
    "question": {"paths": ("question", "answer"), "turns": (("user", ("question",)), ("assistant", ("answer",)))},
    "rows": {"paths": ("conv_id", "turn", "role", "text"), "rows": True},
}
#: Any layout but rows may have this field, too: a first turn of this role.
SYSTEM = "system"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant"}

TURN = "array<struct<role:string,text:string>>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_control = re.compile("|".join(map(re.escape, CONTROL)))
_special = re.compile("\\\\|" + _control.pattern)
_escaped = re.compile(r"\\(.)", re.S)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Layout by fingerprint, with and without the system field.
KNOWN = {fingerprint(x["paths"] + extra): name for name, x in LAYOUTS.items() for extra in ((), (SYSTEM,)) if not ("rows" in x and extra)}
VOCABULARY = sorted({p for x in LAYOUTS.values() if "rows" not in x for p in x["paths"]} | {SYSTEM})
RECORD = "struct<" + ",".join(
    [f"{x['list']}:array<struct<{x['role']}:string,{x['text']}:string>>" for x in LAYOUTS.values() if "list" in x] + [f"{p}:string" for p in VOCABULARY if "[]" not in p]
) + ">"


def field_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The paths of all leaves; [] stands for an array's items."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return set().union(*(field_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    return {at}


def table_layout(df: DataFrame) -> str | None:
    """The layout of a whole table by its schema."""
    paths = field_paths(df.schema)
    rows = set(LAYOUTS["rows"]["paths"])
    known = paths & (rows if rows <= paths else set(VOCABULARY))
    return KNOWN.get(fingerprint(known))


def record_paths(record: Column) -> Column:
    """The paths that one parsed record has: fields that aren't null; of a list, the fields that any item has."""
    found = []
    for path in VOCABULARY:
        if "[]." in path:
            items, field = path.split("[].")
            there = F.size(F.array_compact(record[items][field])) > 0
        else:
            there = record[path].isNotNull()
        found.append(F.when(F.coalesce(there, F.lit(False)), F.lit(path)))
    return F.array_compact(F.array(*found))


def canonical_role(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(names[F.lower(role)], role, F.lit(""))


def turns_of(record: Column, layout: dict) -> Column:
    system = F.when(record[SYSTEM].isNotNull(), F.array(F.struct(F.lit(SYSTEM).alias("role"), record[SYSTEM].alias("text")))).otherwise(F.lit([]).cast(TURN))
    if "list" in layout:
        turns = F.transform(record[layout["list"]], lambda x: F.struct(canonical_role(x[layout["role"]]).alias("role"), F.coalesce(x[layout["text"]], F.lit("")).alias("text")))
    else:
        joined = lambda fields: F.concat_ws("\n\n", *(F.when(record[f] != "", record[f]) for f in fields))
        turns = F.array(*(F.struct(F.lit(role).alias("role"), joined(fields).alias("text")) for role, fields in layout["turns"]))
    return F.concat(system, turns)


def canonical_json(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` with ``layout`` and ``turns`` of a column of JSON records, each by its own fingerprint."""
    # Generators of one row, so that each record is parsed and hashed once.
    parsed = unused(df.columns, "__record")
    df = df.select("*", F.explode(F.array(F.from_json(record, RECORD))).alias(parsed))
    # sort_array sorts as fingerprint() does; all paths are ASCII.
    hashed = F.substring(F.sha2(F.array_join(F.sort_array(record_paths(F.col(parsed))), "\n"), 256), 1, 16)
    names = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    df = df.select(*(c for c in df.columns if c != "layout"), F.explode(F.array(names[hashed])).alias("layout"))
    turns = F.lit(None).cast(TURN)
    for name, layout in LAYOUTS.items():
        if "rows" not in layout:
            turns = F.when(F.col("layout") == name, turns_of(F.col(parsed), layout)).otherwise(turns)
    return df.withColumn("turns", turns).drop(parsed)


def canonical_table(df: DataFrame) -> DataFrame:
    """(conv_id, layout, turns) of a table whose schema has a layout's fingerprint; without rows by turn, ``conv_id`` is the
    table's own."""
    layout = table_layout(df)
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(field_paths(df.schema))}")
    if layout == "rows":
        turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        grouped = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
        return grouped.select("conv_id", F.lit(layout).alias("layout"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    kept = [f for f in df.columns if f in {p.split("[")[0] for p in VOCABULARY}]
    return canonical_json(df.select("conv_id", F.to_json(F.struct(*kept)).alias("record"))).select("conv_id", "layout", "turns")


def escape(text: str) -> str:
    return _special.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render(turns: list[dict]) -> tuple[str, list[dict]]:
    """The formatted string and the spans under the loss mask."""
    out: list[str] = []
    spans = []
    at = 0
    for turn in turns:
        role, body = turn["role"] or "", escape(turn["text"] or "")
        head, tail = {"user": ("<s>[INST] ", " [/INST]</s>"), "assistant": ("<s>", "</s>"), "system": ("<s><<SYS>>", "<</SYS>></s>")}.get(role, (f"<s>[ROLE]{escape(role)}[/ROLE]", "</s>"))
        if role == "assistant":
            spans.append({"start": at + len(head), "n": len(body)})
        out += head, body, tail
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse(formatted: str) -> list[dict]:
    """The turns of a formatted string."""
    turns = []
    at = 0
    while at < len(formatted):
        end = formatted.index("</s>", at)
        inside = formatted[at + len("<s>") : end]
        at = end + len("</s>")
        role = "assistant"
        if inside.startswith("[INST] "):
            role, inside = "user", inside[len("[INST] ") : -len(" [/INST]")]
        elif inside.startswith("<<SYS>>"):
            role, inside = "system", inside[len("<<SYS>>") : -len("<</SYS>>")]
        elif inside.startswith("[ROLE]"):
            role, _, inside = inside[len("[ROLE]") :].partition("[/ROLE]")
            role = unescape(role)
        turns.append({"role": role, "text": unescape(inside)})
    return turns


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` (string) and ``loss_spans`` (start and length in characters)."""
    row = pa.struct([("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))])

    @F.arrow_udf("struct<formatted:string,loss_spans:array<struct<start:bigint,n:bigint>>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # One conversation at a time stands in memory as Python objects.
            yield pa.array((None if x is None else dict(zip(("formatted", "loss_spans"), render(x), strict=True)) for x in (v.as_py() for v in batch)), type=row, size=len(batch))

    # A generator of one row keeps the function from being copied to each place that reads its fields.
    kept, name = [c for c in df.columns if c not in ("formatted", "loss_spans")], unused(df.columns, "__made")
    return df.select(*kept, F.explode(F.array(made(F.col(turns)))).alias(name)).select(*kept, f"{name}.*")


def read_back(df: DataFrame, formatted: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """``df`` with ``read_turns`` (as the marks tell) and ``loss_text`` (all under the mask, unescaped)."""
    row = pa.struct([("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss", pa.string())])

    @F.arrow_udf(f"struct<turns:{TURN},loss:string>")
    def read(strings: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, masks in strings:
            texts = ((a.as_py(), b.as_py()) for a, b in zip(batch, masks, strict=True))
            told = ({"turns": parse(text), "loss": "".join(unescape(text[x["start"] : x["start"] + x["n"]]) for x in mask)} if text is not None else None for text, mask in texts)
            yield pa.array(told, type=row, size=len(batch))

    kept = [c for c in df.columns if c not in ("read_turns", "loss_text")]
    name = unused(df.columns, "__read")
    made = df.select(*kept, F.explode(F.array(read(F.col(formatted), F.col(spans)))).alias(name))
    return made.select(*kept, F.col(f"{name}.turns").alias("read_turns"), F.col(f"{name}.loss").alias("loss_text"))
