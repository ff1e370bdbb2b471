import json
import random

import pandas as pd
from pyspark.sql import functions as F

from memspark.operators import drawers, kg
from memspark.sources import files, formats
from memspark.streaming import jobs

EVENTS = '{"type":"human","message":{"content":"Hi"}}\nbad\n{"type":"assistant","message":{"content":[{"type":"text","text":"Hello"},{"type":"image"},"you"]}}'
SESSION = '{"type":"session_meta"}\n{"type":"event_msg","payload":{"type":"user_message","message":"q "}}\n{"type":"event_msg","payload":{"type":"agent_message","message":"a"}}'
TREE = json.dumps({"mapping": {"r": {"parent": None, "message": None, "children": ["m1"]}, "m1": {"parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["x", "y"]}}, "children": ["m2"]}, "m2": {"parent": "m1", "message": {"author": {"role": "assistant"}, "content": {"parts": ["z"]}}, "children": ["m1"]}}})
CASES = {
    "a.jsonl": (EVENTS, "events", "> Hi\nHello you\n"),
    "b.jsonl": (SESSION, "sessions", "> q\na\n"),
    "c.json": ('[{"role":"user","content":"Hi"},{"role":"ai","content":"Hello"}]', "messages", "> Hi\nHello\n"),
    "d.json": ('{"messages":[{"role":"human","content":"1"},{"role":"assistant","content":{"text":"2"}}]}', "messages", "> 1\n2\n"),
    "e.json": ('[{"chat_messages":[{"sender":"human","text":"1"}]},null,{"chat_messages":[{"sender":"assistant","text":"2"}]}]', "messages", "> 1\n2\n"),
    "f.json": (TREE, "tree", "> x y\nz\n"),
    "g.json": ('[{"type":"message","user":"U1","text":"one"},{"type":"join"},{"type":"message","user":"U2","text":"two"},{"type":"message","user":"U1","text":"three"},{"type":"message","username":"U3","text":"four"}]', "channel", "> one\ntwo\n\n> three\nfour\n"),
    "k.json": ('[{"role":"user","content":"[1] first"},{"role":"assistant","content":"{\\"curly\\"} reply"}]', "messages", '> [1] first\n{"curly"} reply\n'),
    "l.jsonl": ('{"type":"human","message":{"content":"[note] call me"}}\n{"type":"assistant","message":{"content":"{curly} reply"}}', "events", "> [note] call me\n{curly} reply\n"),
    "m.jsonl": ('{"type":"session_meta"}\n{"type":"event_msg","payload":{"type":"user_message","message":"[x] q"}}\n{"type":"event_msg","payload":{"type":"user_message","message":["no"]}}\n{"type":"event_msg","payload":{"type":"agent_message","message":"{a}"}}', "sessions", "> [x] q\n{a}\n"),
    "n.json": ('[{"role":"user","content":null,"text":"x"},{"role":"user","content":["[a]",{"type":"text","text":"{b}"},5,null]},{"role":"assistant","content":{"text":"[c]"}},{"role":"user","content":"7"}]', "messages", "> x\n\n> [a] {b}\n[c]\n\n> 7\n"),
    "h.txt": ("> a\n> b\n > c", "transcript", "> a\n> b\n > c"),
    "i.json": ("{broken", "plain", "{broken"),
    "j.txt": (" ", "plain", " "),
    "o.json": (None, "plain", None),
}


def test_layouts(spark):
    df = spark.createDataFrame([(n, c[0]) for n, c in CASES.items()], "file string, text string")
    assert {r["file"]: (r["layout"], r["transcript"]) for r in formats.normalize(df).collect()} == {n: c[1:] for n, c in CASES.items()}


def test_scan(spark, tmp_path):
    for name in ("src/app.py", "ignored.py", "generated/x.py", "node_modules/m.js", "deep/generated2/y.MD", "notes.MD", "logs/a.tmp.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text é")
    got = files.scan_project(spark, str(tmp_path), ["# note", "ignored.py", "generated/", "*.tmp.py"]).collect()
    assert [(r["rel_path"], r["text"]) for r in got] == [("src/app.py", "text é")]
    assert sorted(r["rel_path"] for r in files.scan_conversations(spark, str(tmp_path)).collect()) == ["deep/generated2/y.MD", "notes.MD"]


def test_documents_of_json(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"mode": "work", "people": {"Ann": {"aliases": ["A"]}}, "projects": ["P"], "wiki_cache": {"w": {"inferred_type": "place", "confidence": 0.8, "confirmed": True}}}))
    registry = files.read_registry(spark, str(tmp_path / "r.json"))
    assert registry.mode == "work" and registry.people.first()["aliases"] == ["A"] and registry.summaries.first()["confirmed"]
    (tmp_path / "q.json").write_text(json.dumps([{"question": "q", "haystack_sessions": [[{"role": "user", "content": "c"}]], "haystack_session_ids": ["s"], "haystack_dates": ["d"], "answer_session_ids": ["s"]}]))
    assert files.read_questions(spark, str(tmp_path / "q.json")).first()["answer_session_ids"] == ["s"]
    sessions = spark.createDataFrame([("one.txt", "a\nb"), ("two.txt", "c")], "file_name string, content string")
    files.write_sessions(sessions, str(tmp_path / "s"))
    assert {r["file_name"] for r in spark.read.text(str(tmp_path / "s")).collect()} == {"one.txt", "two.txt"}


def test_checkpoints_of_stream_and_batch_agree(spark, tmp_path):
    r = random.Random(9)
    rows = [(f"s/{r.randint(0, 3)}", r.choice(["user", "assistant"]), "<command-message>" if r.random() < 0.1 else "x", i, i) for i in range(400)]
    kind = "session_id string, role string, content string, ts int, id int"
    for n in range(4):
        spark.createDataFrame(rows[100 * n : 100 * n + 100], kind).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = jobs.save_checkpoints(stream, 7).writeStream.format("memory").queryName("saved").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(x) for x in spark.table("saved").collect())
    assert got and got == sorted(tuple(x) for x in jobs.save_checkpoints_batch(spark.createDataFrame(rows, kind), 7).collect())


def test_checkpoints_are_numbered_across_hours(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "a", None]), "user", None, r.choice([None, *range(0, 40_000, 500)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "session_id string, role string, content string, ts long, id int")
    want = []
    for name in ("hot", "a", None):
        n = sum(x[0] == name for x in rows)
        want += [(name, k, 7) for k in range(7, n + 1, 7)]
    at = F.timestamp_seconds("ts")
    for ts in (F.col("ts"), at, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")):
        got = [tuple(x) for x in jobs.save_checkpoints_batch(df.withColumn("ts", ts), 7).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_streams_of_files_and_triples(spark, tmp_path):
    kind = "rel_path string, source_file string, source_mtime double, text string"
    spark.createDataFrame([("a.md", "/a.md", 1.0, "word " * 40)], kind).write.parquet(str(tmp_path / "files/0"))
    path = str(tmp_path / "store")
    drawers.append_drawers(spark.createDataFrame([("x", "other")], "id string, wing string"), path)
    store = lambda: drawers.read_drawers(spark, path)
    source = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "files"))
    jobs.mine_stream(source, store, path, str(tmp_path / "c1"), "w").awaitTermination(60)
    spark.createDataFrame([("a.md", "/a.md", 1.2, "word " * 40), ("b.md", "/b.md", 1.0, "text " * 40)], kind).write.parquet(str(tmp_path / "files/1"))
    jobs.mine_stream(source, store, path, str(tmp_path / "c1"), "w").awaitTermination(60)
    assert sorted(r["source_file"] for r in store().where("wing = 'w'").collect()) == ["/a.md", "/b.md"]
    files.write_kg(spark.createDataFrame([], kg.ENTITY), spark.createDataFrame([], kg.TRIPLE), str(tmp_path / "kg/v0"))
    kind = "seq int, subject string, predicate string, object string, valid_from string, valid_to string"
    spark.createDataFrame([(1, "a", "p", "b", None, None), (2, "a", "p", "b", None, None)], kind).write.parquet(str(tmp_path / "t"))
    jobs.kg_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "t")), str(tmp_path / "kg"), str(tmp_path / "c2")).awaitTermination(60)
    assert files.read_kg(spark, str(tmp_path / "kg/v1"))[1].count() == 1
    assert jobs.compaction_checkpoints(spark.createDataFrame([("a/b", "compaction", 1), ("a", "x", 2)], "session_id string, event string, ts int")).first()["session_id"] == "ab"


def test_triples_and_closings_are_appended(spark, tmp_path):
    """Micro-batches of triples, closings between them, and the same store compacted: as if applied one after another."""
    path, kind = str(tmp_path / "kg"), "seq int, subject string, predicate string, object string, valid_from string, valid_to string"
    files.write_kg(spark.createDataFrame([], kg.ENTITY), spark.createDataFrame([], kg.TRIPLE), f"{path}/v0")
    for name in ("in", "ends"):
        (tmp_path / name).mkdir()
    source = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ends = spark.readStream.schema("subject string, predicate string, object string, ended string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "ends"))
    add = lambda n, rows: (spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{n}")), jobs.kg_stream(source, path, str(tmp_path / "c1")).awaitTermination(60))
    end = lambda n, rows: (spark.createDataFrame(rows, "subject string, predicate string, object string, ended string").coalesce(1).write.parquet(str(tmp_path / f"ends/{n}")), jobs.kg_stream(ends, path, str(tmp_path / "c2"), closings=True, today="2026-01-01").awaitTermination(60))
    add(0, [(1, "a", "p", "b", "2020", None), (2, "a", "p", "c", "2020", None)])
    add(1, [(3, "a", "p", "b", "2021", None)])
    end(0, [("A", "p", "b", "")])
    add(2, [(4, "a", "p", "b", "2022", None)])
    end(1, [("a", "p", "c", "2025")])
    want = [("b", "2020", "2026-01-01"), ("b", "2022", None), ("c", "2020", "2025")]
    rows = lambda found: sorted((r["object"], r["valid_from"], r["valid_to"]) for r in found[1].collect())
    assert rows(jobs.latest_kg(spark, path)) == want and jobs.latest_kg(spark, path)[0].count() == 3
    assert spark.read.parquet(f"{path}/v2/triples").count() == 0 and spark.read.parquet(f"{path}/v3/triples").count() == 1
    jobs.compact_kg(spark, path, str(tmp_path / "less"), 3)
    assert rows(jobs.latest_kg(spark, str(tmp_path / "less"))) == want


def test_exports_cut_into_ranges(spark, tmp_path):
    """A file of many ranges gives the turns that it gives as one row; lines longer than a range, bad lines, other line ends."""
    from memspark.sources import lines

    events = [json.dumps({"type": ("human", "assistant", "system")[i % 3], "message": {"content": f"turn {i} " + "x" * (i % 7 * 300)}}) for i in range(400)]
    events[5:5] = ["{bad", "", '{"type": "human"}', json.dumps({"type": "human", "message": {"content": [{"type": "text", "text": "of a list"}]}})]
    sessions = [json.dumps({"type": "event_msg", "payload": {"type": ("user_message", "agent_message")[i % 2], "message": f"said {i}"}}) for i in range(90)]
    texts = {"a.jsonl": "\n".join(events), "b.jsonl": "\n".join([*sessions, '{"type": "session_meta"}']) + "\n", "c.jsonl": "\n".join(sessions), "d.jsonl": events[0]}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = lines.export_lines(spark, str(tmp_path))
        assert rows.groupBy("file", "block").count().where("file like '%a.jsonl'").count() > 50
        got = sorted((r["file"].rsplit("/", 1)[1], r["turn"], r["role"], r["text"]) for r in lines.line_turns(rows).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    whole = spark.createDataFrame(list(texts.items()), "file string, text string")
    want = sorted(tuple(r) for name, layout in (("a.jsonl", "events"), ("b.jsonl", "sessions")) for r in formats.turns_from(whole.where(F.col("file") == name), layout).collect())
    assert got == want and len(want) > 300
