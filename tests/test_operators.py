import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.functions import extract, routing
from memspark.functions.text import any_of, base_name, blank_trim, stem
from memspark.operators import drawers, entities, evaluate, graph, kg, similarity, transcripts
from memspark.plans import catalog

R = random.Random(4)


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a b﻿\n", "/x/y.tar.gz"), ("", "plain"), (None, ".env")], "t string, p string")
    assert values(df.select(blank_trim("t").alias("t"), base_name("p").alias("b"), stem("p").alias("s")), "t", "b", "s") == [("a b", "y.tar.gz", "y.tar"), ("", "plain", "plain"), (None, ".env", ".env")]


def test_ascii_boundaries(spark):
    df = spark.createDataFrame([("éfixed it",), ("prefixed",), ("It is FIXED",), ("fixed it ",), ("xx v1.2",)], "t string")
    assert values(df.select(F.col("t").rlike(any_of([r"\bfixed\b", r"\bv\d+\.\d+"])).alias("m")), "m") == [True, False, True, True, True]


@pytest.mark.parametrize(("text", "kind"), [("We decided to use tea", "decision"), ("I prefer tabs", "preference"), ("Finally it works", "milestone"), ("The bug is back", "problem"), ("I feel fine", "emotional"), ("plain words", None)])
def test_memory_classes(spark, text, kind):
    assert spark.range(1).select(extract.memory_type(F.lit(text)).alias("k")).first()["k"] == kind


def test_memories_of_paragraphs(spark):
    df = spark.createDataFrame([(1, "We decided so\n\n  \n\nnothing here\n\nI love it")], "doc_id long, text string")
    assert values(extract.extract_memories(df), "chunk_index", "memory_type") == [(0, "decision"), (2, "emotional")]


def brute_cut(s, size=800, overlap=100, least=50):
    s, out, start = s.strip(), [], 0
    while start < len(s):
        end = start + size
        if end < len(s):
            for mark in ("\n\n", "\n"):
                places = [i for i in range(start, end + 1) if s.startswith(mark, i) and i > start + size // 2]
                if places:
                    end = places[-1]
                    break
        piece = s[start : min(end, len(s))].strip()
        out += [piece] if len(piece) >= least else []
        if end >= len(s):
            break
        start = end - overlap
    return out


def test_fixed_chunks_against_a_plain_model():
    for n in (0, 49, 50, 799, 800, 801, 1700):
        assert transcripts.cut("a" * n) == brute_cut("a" * n)
    for _ in range(300):
        text = "".join(R.choice(["word ", "a", "\n", "\n\n", "é"]) for _ in range(R.randint(0, 1500)))
        assert transcripts.cut(text) == brute_cut(text)


def test_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert sorted(values(transcripts.pair_turns(df), "group", "user_text", "assistant_text")) == [(0, "a", None), (1, "b", "c"), (2, None, "d")]
    assert values(transcripts.render_transcript(df), "transcript") == ["> a\n\n> b\nc\n\nd\n"]


def test_exchanges(spark):
    text = "lost\n> one question of some length here\nx1\n---\ngone\n> two question of some length here\n" + "\n".join(f"line{i}" for i in range(12)) + "\n> short"
    df = spark.createDataFrame([("f", text), ("g", "para one is long enough to be kept here\n\n\n\ntiny")], "file string, text string")
    got = {(r["file"], r["chunk_index"]): r["content"] for r in transcripts.chunk_transcripts(df, "file").collect()}
    assert got == {
        ("f", 0): "> one question of some length here x1",
        ("f", 1): "> two question of some length here " + " ".join(f"line{i}" for i in range(8)),
        ("g", 0): "para one is long enough to be kept here",
    }


def test_sessions(spark):
    one = ["Banner v1", "⏺ 3:05 PM Monday, March 7, 2025", "Alice and bob", "> cd /tmp", "> Fix the log-in, please!"] + ["x"] * 7
    two = ["Banner v1"] + ["y"] * 10
    text = "\n".join(["before", *one, "Banner v1 again", "Ctrl+E", *two, "Banner v1", "short"])
    df = spark.createDataFrame([("log.txt", text), ("none.txt", "Banner v1\nonly one")], "file string, text string")
    got = transcripts.split_sessions(df, "Banner v", people=("Alice", "Bob", "Zed"))
    assert sorted(values(got, "session", "ts", "subject", "file_name")) == [
        (1, "2025-03-07_305PM", "Fix-the-log-in-please", "log_2025-03-07_305PM_Alice-Bob_Fix-the-log-in-please.txt"),
        (2, None, "session", "log_part02_unknown_session.txt"),
    ]


def test_project_room(spark):
    paths = [("src/api/docs/x.py", "backend"), ("a/build.py", "frontend"), ("a/zzz.md", "mine"), ("a/q.md", "testing"), ("a/w.md", "general")]
    texts = {"a/q.md": "a test of tests", "a/w.md": "nothing"}
    df = spark.createDataFrame([(p, texts.get(p, "")) for p, _ in paths], "p string, t string")
    assert values(df.select(routing.project_room("p", "t", (("mine", ("zz",)),)).alias("r")), "r") == [r for _, r in paths]


def test_dialect(spark):
    df = spark.createDataFrame([(1, "Alice decided to switch. It was key because tests failed.", "w", "r", "/a/b.txt")], "doc_id long, text string, wing string, room string, source_file string")
    line = values(extract.compress(df, {"Alice": "ALC"}), "compressed")[0]
    assert line.split("\n")[0] == "w|r|?|b" and line.split("\n")[1].startswith("0:ALC|") and line.endswith("|determ|DECISION")
    back = extract.decode(spark.createDataFrame([("F|E|D|T\nARC:x\nT:a<->b|l\n0:A|b",), ("",)], "compressed string")).collect()
    assert tuple(back[0]["header"]) == ("F", "E", "D", "T") and back[0]["arc"] == "x" and back[0]["records"] == ["0:A|b"] and back[0]["tunnels"] == ["T:a<->b|l"]
    assert back[1]["header"] is None and back[1]["records"] == []
    names = spark.createDataFrame([("Bobby",), ("alice",), ("skipme",), ("Zoe",)], "n string")
    assert values(names.select(extract.encode_entity("n", {"Bob": "BOB", "alice": "ALC"}, ("skip",)).alias("c")), "c") == ["BOB", "ALC", None, "ZOE"]
    record = spark.createDataFrame([("a-b-7", ["Zoe", "Bob"], ["t1", "t2", "t3"], ["joy", "oddly"])], "id string, people array<string>, topics array<string>, emotional_tone array<string>")
    assert values(extract.encode_record(record), "encoded") == ['7:BOB+ZOE|t1_t2|"test quote"|0.5|joy+oddl']
    assert values(extract.encode_tunnel(spark.createDataFrame([("x-1", "y-2", "lab: el")], "from_id string, to_id string, label string")), "encoded") == ["T:1<->2|lab"]


def test_entities(spark):
    docs = spark.createDataFrame([(1, "Alice said said Alice said hi. We are building Orion and the Orion pipeline. Will you? But Will said no.")], "doc_id long, text string")
    got = dict(values(entities.detect_entities(docs), "name", "score"))
    assert got["Alice"] == 4 and got["Orion"] == 2 + 4 and got["Will"] == 2 + 2 and "But" not in got
    people = spark.createDataFrame([(1, "Will", "friend", ["Willy"]), (2, "Alice", "sister", None)], "seq int, name string, relationship string, aliases array<string>")
    registry = entities.seed_registry(people, spark.createDataFrame([("Orion",)], "name string"))
    assert values(registry.ambiguous, "name") == ["Will"]
    found = entities.lookup_entities(spark.createDataFrame([("WILLY",), ("orion",), ("x",)], "word string"), registry)
    assert sorted(values(found, "word", "name", "type")) == [("WILLY", "Will", "person"), ("orion", "Orion", "project"), ("x", "x", "unknown")]
    assert values(entities.registry_summary(registry), "people", "projects", "mode") == [(2, 1, "personal")]
    assert values(entities.classified_summaries(spark.createDataFrame([("a", "a given name"), ("b", "a city"), ("c", "z")], "word string, summary string")), "type") == ["person", "place", "concept"]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("1", "w", "r", "f", 5.0, "2"), ("1", "w", "r", "f", 5.0, "1"), ("2", "", None, "g", 0.0, "1")], "id string, wing string, room string, source_file string, source_mtime double, filed_at string")
    path = str(tmp_path / "store")
    drawers.append_drawers(rows, path)
    drawers.append_drawers(rows.limit(0), path)
    stored = drawers.read_drawers(spark, path)
    assert stored.count() == 3 and stored.columns == drawers.DRAWER.names
    assert sorted(values(drawers.latest_drawers(stored, stored.limit(0)), "id", "filed_at")) == [("1", "2"), ("2", "1")]
    assert values(drawers.delete_drawers(stored, spark.createDataFrame([("1",)], "id string")), "id") == ["2"]
    assert values(drawers.file_mtime(stored, "g"), "source_mtime") == [None] and values(drawers.file_mtime(stored, "f"), "source_mtime") == [5.0]
    diary = drawers.diary_entries(spark.createDataFrame([("Bot", "note", "")], "agent string, entry string, topic string"), "2026")
    assert values(drawers.read_diary(diary, "BOT"), "content", "topic") == [("note", "general")]
    drawers.clear_drawers(spark, path)
    assert drawers.read_drawers(spark, path).count() == 0


def test_mining_skips_what_is_stored(spark):
    files = spark.createDataFrame([("src/a.py", "/p/src/a.py", 10.0, "word " * 300), ("b.md", "/p/b.md", 10.0, "tiny")], "rel_path string, source_file string, source_mtime double, text string")
    none = spark.createDataFrame([], drawers.DRAWER)
    mined = drawers.mine_project(files, none, "w")
    assert mined.where("source_file = '/p/src/a.py'").count() == 2 and mined.where("source_file = '/p/b.md'").count() == 0
    assert drawers.mine_project(files, mined, "w").count() == 0
    chats = drawers.mine_conversations(files, none, "w")
    assert values(chats.select("chunk_index").distinct(), "chunk_index") == [0]


def test_essential_story_budget(spark):
    rows = [(f"{i:03}", "w", "abc"[i % 3], "Some words to tell " * 4, "", (i % 7) or None) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, wing string, room string, content string, filed_at string, importance int").withColumn("source_file", F.lit("/f.txt"))
    for budget in (40, 200, 700, 3200):
        text = values(drawers.essential_story(df, budget=budget), "text")
        ranked = sorted(rows, key=lambda r: -(r[5] or 3))[:15]
        lines = dict(values(extract.compress(df, text="content"), "id", "compressed"))
        want, total = "## L1 — ESSENTIAL STORY", 30
        stop = False
        for room in dict.fromkeys(r[2] for r in ranked):
            if total + len(room) + 3 > budget:
                break
            want, total = want + f"\n[{room}]", total + len(room) + 3
            for r in (r for r in ranked if r[2] == room):
                line = "  " + lines[r[0]].replace("\n", " | ")
                if total + len(line) > budget:
                    want, stop = want + "\n  ... (more in L3 search)", True
                    break
                want, total = want + "\n" + line, total + len(line) + 1
            if stop:
                break
        assert (text or ["## L1 — ESSENTIAL STORY"])[0] == want
    assert values(drawers.wake_up(df, "me"), "text")[0].startswith("me\n\n## L1")


def test_triples_against_a_plain_model(spark):
    store_e, store_t = spark.createDataFrame([("a", "A", "person", "{}", "0")], kg.ENTITY), spark.createDataFrame([("old", "a", "likes", "b", None, None, 1.0, None, None, "0"), ("gone", "a", "likes", "c", None, "2020", 1.0, None, None, "0")], kg.TRIPLE)
    batch = [(i, R.choice("Aab"), "Likes", R.choice("BCD"), "", R.choice(["", "2024"])) for i in range(60)]
    e, t, ids = kg.add_triples(store_e, store_t, spark.createDataFrame(batch, "seq int, subject string, predicate string, object string, valid_from string, valid_to string"))
    active, added, same = {("a", "b"): "old"}, 0, {}
    got = {r["seq"]: (r["id"], r["added"]) for r in ids.collect()}
    for seq, s, _, o, _, end in batch:
        key = (s.lower(), o.lower())
        assert got[seq][1] == (key not in active)
        if key in active:
            assert got[seq][0] == active[key]
        else:
            added += 1
            if not end:
                active[key] = got[seq][0]
    assert t.count() == 2 + added and same == {}
    assert dict(values(e, "id", "name"))["a"] == "A" and e.select("id").distinct().count() == e.count()
    assert e.columns == kg.ENTITY.names and t.columns == kg.TRIPLE.names


def test_as_of(spark):
    e, t = spark.createDataFrame([], kg.ENTITY), spark.createDataFrame([], kg.TRIPLE)
    rows = [(1, "Alice", "works at", "Acme Corp", "2010-01-01", "2024-01-01"), (2, "Alice", "works at", "NewCo", "2024-01-02", None), (3, "Max", "knows", "Max", None, None)]
    e, t, _ = kg.add_triples(e, t, spark.createDataFrame(rows, "seq int, subject string, predicate string, object string, valid_from string, valid_to string"))
    asked = spark.createDataFrame([("alice", "2023-06-01"), ("ALICE", "2025-06-01"), ("alice", "2024-01-01")], "name string, as_of string")
    assert sorted(values(kg.query_entities(e, t, asked), "query", "as_of", "object")) == [("ALICE", "2025-06-01", "NewCo"), ("alice", "2023-06-01", "Acme Corp"), ("alice", "2024-01-01", "Acme Corp")]
    assert kg.query_entities(e, t, spark.createDataFrame([("Max",)], "name string"), "both").count() == 2
    assert values(kg.timeline(e, t), "valid_from") == [None, "2010-01-01", "2024-01-02"]
    closed = kg.invalidate(t, spark.createDataFrame([("Alice", "works at", "NewCo", None)], "subject string, predicate string, object string, ended string"), "2026-04-01")
    assert values(kg.kg_stats(e, closed), "entities", "triples", "current", "expired") == [(4, 3, 1, 2)]


def test_graph(spark):
    rows = [("A", "auth", "backend", "2025-01-01"), ("B", "auth", "backend", "2025-01-02"), ("A", "db", "backend", "2025-01-03"), ("A", "general", "x", ""), ("", "db", "x", ""), ("C", "far", None, None), ("B", "far", None, None)]
    nodes = graph.room_nodes(spark.createDataFrame(rows, "wing string, room string, hall string, date string"))
    assert sorted(values(nodes, "room", "wings", "count")) == [("auth", ["A", "B"], 2), ("db", ["A"], 1), ("far", ["B", "C"], 2)]
    assert values(graph.room_edges(nodes), "room", "wing_a", "wing_b", "hall", "count") == [("auth", "A", "B", "backend", 2)]
    assert values(graph.traverse(nodes, "db"), "room", "hop", "connected_via") == [("db", 0, []), ("auth", 1, ["A"]), ("far", 2, ["B"])]
    with pytest.raises(LookupError, match="auth"):
        graph.traverse(nodes, "nowhere-auth")
    assert values(graph.suggest_rooms(nodes, "FAR-au"), "room", "score") == [("auth", 0.5), ("far", 0.5)]


def test_greedy_insert_against_a_plain_model(spark):
    base = np.random.default_rng(2).normal(size=(60, 8))
    base[20:] = base[:40] + np.random.default_rng(3).normal(size=(40, 8)) * 0.3
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, f"r{i:02}", [float(x) for x in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "pos long, id string, vector array<double>")
    stored, new = df.where("pos < 5"), df.where("pos >= 5")
    taken, want = [0, 1, 2, 3, 4], {}
    for i in range(5, 60):
        near = [j for j in taken if round(float(base[i] @ base[j]), 3) >= 0.9]
        want[f"r{i:02}"] = "duplicate" if near else "added"
        taken += [] if near else [i]
    rounds = []
    for probes in (None, 16):
        got = similarity.add_if_new(stored, new, probes=probes, told=lambda *x: rounds.append(x)).collect()
        assert {r["id"]: r["status"] for r in got} == want
        assert all((r["existing_id"] is None) == (r["status"] == "added") for r in got)
    assert rounds[0][0] == 1 and sum(x[1] for x in rounds) == 2 * sum(x == "added" for x in want.values())


def test_embedding_search_and_metrics(spark):
    df = similarity.embed(spark.createDataFrame([("a", "red fish"), ("b", "blue bird"), ("c", "red bird")], "id string, content string")).withColumns({"wing": F.lit("w"), "room": F.lit("r"), "source_file": F.lit("/x/y.md")})
    q = df.where("id = 'a'").select(F.col("id").alias("query_id"), "vector")
    found = similarity.topk(df, q, 2)
    assert values(found, "rank", "id") == [(1, "a"), (2, "c")]
    assert values(similarity.render_results(found, df), "text")[0].startswith("  [1] w/r (sim=1.0)\n      red fish\n      src: y.md")
    assert similarity.topk(df, q.limit(0), 2).count() == 0
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (2, 1, "q")], "query_id int, rank int, id string")
    wanted = spark.createDataFrame([(1, "y"), (1, "z"), (2, "no"), (3, "none")], "query_id int, id string")
    got = {r["query_id"]: (r["recall_any"], r["recall_all"], round(r["ndcg"], 6)) for r in evaluate.retrieval_metrics(ranked, wanted).collect()}
    assert got == {1: (1.0, 1.0, round((1 / np.log2(3) + 0.5) / (1 + 1 / np.log2(3)), 6)), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    assert values(evaluate.mean_metrics(evaluate.retrieval_metrics(ranked, wanted)), "questions") == [3]
    asked = spark.createDataFrame([("q", [[("user", "a"), ("assistant", "b"), ("user", "c")], [("assistant", "d")]], ["s1", "s2"], ["d1", "d2"])], "question_id string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_session_ids array<string>, haystack_dates array<string>")
    assert values(evaluate.session_documents(asked), "session_id", "content") == [("s1", "a\nc")]


def test_topk_of_many_steps(spark, monkeypatch):
    """A few rows compared at once, many equal similarities, ids as text of several lengths, null vectors: as by brute force."""
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(230, 3)), 1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    x[40:60] = x[7]
    names = [str(v) for v in r.permutation(230) * 5]
    df = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)] + [("none", None)], "id string, vector array<double>").repartition(2)
    monkeypatch.setattr(similarity, "PRODUCTS", 700)
    got = {}
    for row in similarity.topk(df, df.withColumnRenamed("id", "query_id"), 4, block=100).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row["id"]
    dots = np.round(x @ x.T, 3)
    assert got == {names[q]: dict(enumerate([names[i] for i in sorted(range(230), key=lambda i: (-dots[q, i], names[i]))[:4]], 1)) for q in range(230)}


def test_every_vector_asks(spark):
    """Retrieval is measured for every vector, and equals its SQL; the means are still those of each twentieth one."""
    d = "/root/testdata/sf0.001"
    got = catalog.QUERIES["retrieval_metrics"](spark, d)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = con.execute(catalog.SQL["retrieval_metrics"]).fetchall()
    assert len(want) == spark.read.parquet(f"{d}/embeddings.parquet").count()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [tuple(row) for row in catalog.QUERIES["mean_metrics"](spark, d).collect()] == con.execute(catalog.SQL["mean_metrics"]).fetchall()


def test_labelled_metrics_make_no_pairs(spark):
    """The same as by pairs of queries and relevant rows, in a time that goes with the rows."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 50 > 0, F.col("id") % 2).alias("label"))
    asked = rows.where("id % 15 = 0").withColumnRenamed("id", "query_id")
    ranked = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("rank")).withColumn("id", F.col("query_id") + F.col("rank") * F.col("rank"))
    pairs = asked.join(rows, "label").select("query_id", "id")
    for full in (False, True):
        got = evaluate.labelled_metrics(ranked, asked, rows, 5, full)
        assert got.exceptAll(evaluate.retrieval_metrics(ranked, pairs, 5, full)).count() == 0
        assert got.count() == asked.where("label is not null").count()
    # One label for all: 4 * 10^9 pairs, were they made.
    one = spark.range(400_000).select("id", F.lit(1).alias("label"))
    some = one.where("id % 40 = 0").withColumnRenamed("id", "query_id")
    means = evaluate.mean_metrics(evaluate.labelled_metrics(some.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("id")), some, one)).first()
    assert means["questions"] == 10_000 and means["recall_any"] == means["ndcg"] == 1 and means["recall_all"] == 0


def test_many_names_against_one_by_one(spark):
    """A hundred thousand names, in one automaton and in many, against the expression for each of a few."""
    from memspark.functions import extract
    from memspark.operators import entities

    docs = spark.createDataFrame([(1, "we saw ANNA and Ann, then Berta Lang"), (2, "nothing but a Dog here"), (3, None), (4, ""), (5, "xAnnx carl")], "doc_id long, text string")
    few = [("Ann", "A1"), ("Anna", "A2"), ("Berta lang", "B1"), ("carl", "C0"), ("Carl", "C1"), ("Zed", "A1")]
    frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, name string, code string")
    want = {r["doc_id"]: r["c"] for r in docs.select("doc_id", extract.entity_codes("text", dict(few)).alias("c")).collect()}
    for names, block in ((few, 1 << 20), (few, 9), (few + [(f"Name{i}q", "N") for i in range(100_000)], 1 << 19)):
        got = entities.registered_codes(docs, frame(names), block=block)
        assert {r["doc_id"]: r["codes"] for r in got.collect()} == want
    assert want[1] == ["A1", "A2", "B1"] and want[2] == ["DOG"] and want[5] == ["A1", "C1"]
    assert entities.names_in(docs, frame([])).collect() == []


def test_guessed_codes_read_no_more_than_they_need(spark):
    """Three codes stand at the beginning of texts of megabytes; blanks are the library's own."""
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "Abc Def"), (3, "x Ab\u0085Cd Ef"), (4, "a \x1cBcd  Éa 9Abc-D (Abc) The Abd Abe"), (5, "AA\x0bBb　Cc\nDd Ee")], "i int, text string")
    got = [r["c"] for r in odd.orderBy("i").select(extract.entity_codes("text").alias("c")).collect()]
    assert got == [None, [], ["DEF"], ["EF"], ["BCD", "ABC", "ABD"], ["BB", "CC", "DD"]]
    long = spark.range(40).select(F.concat(F.lit("x Abc Bcd Cde "), F.repeat(F.lit("Def some Word "), 100_000)).alias("text"))
    seconds = []
    for rows in (long.limit(1), long):
        start = time.monotonic()
        assert {tuple(r["c"]) for r in rows.select(extract.entity_codes("text").alias("c")).collect()} == {("ABC", "BCD", "CDE")}
        seconds.append(time.monotonic() - start)
    assert seconds[1] < 6
