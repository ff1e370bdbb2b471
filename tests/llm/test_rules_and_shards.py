import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from memspark.llm import chat, quality_rules, queries, sharding

DATA = "/root/testdata/sf0.001"
RANDOM = random.Random(11)


def brute_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    hit = {p for i, g in enumerate(grams) if often[g] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures_against_brute_force(spark):
    texts = [None, "", " \t\n", "one", "a b c d e a b c d e", "x\nx\n x\nx", "é # $ <b> \x0b|", "w " * 9000, "#" * 3000] + [
        RANDOM.choice(["", "\n"]).join(RANDOM.choice(["a ", "b ", "c\n", "* ", "dé\t"]) for _ in range(RANDOM.randint(0, 60))) for _ in range(80)
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in quality_rules.judge(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(r["text"]), r["text"]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_policies_and_ablations_come_from_the_ledger(spark):
    rows = quality_rules.ledger(quality_rules.measure(spark.read.parquet(f"{DATA}/documents.parquet"))).select("doc_id", "fail_bits").cache()
    bits = [r["fail_bits"] for r in rows.collect()]
    assert quality_rules.apply_policy(rows, "base").where("kept").count() == sum(not b & 3 for b in bits)
    names = [n for n, _ in quality_rules.RULES]
    for r in quality_rules.ablations(rows, "v1").collect():
        bit = 1 << names.index(r["rule"])
        assert r["failed"] == sum(bool(b & bit) for b in bits)
        assert r["only_this"] == sum(b & quality_rules.mask("v1") == bit for b in bits)
        assert r["kept_without"] == sum(b & quality_rules.mask("v1") & ~bit == 0 for b in bits)


def test_op7(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op7_sharding(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(x) for x in slots.values()]
    assert max(counts) - min(counts) <= 1


def test_shards_by_bytes_and_odd_rows(spark):
    df = spark.createDataFrame([(i % 300, "x" * (i * 37 % 900)) for i in range(2000)] + [(None, None), (5, "same"), (5, "same")], "doc_id long, text string")
    for law in ("rows", "bytes"):
        got = sharding.shard(df, 7, law, slack=0.01 if law == "bytes" else 0.0).collect()
        assert len(got) == 2003
        slots, load = defaultdict(list), Counter()
        for r in got:
            slots[r["shard"]].append(r["slot"])
            load[r["shard"]] += r["size"]
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        if law == "bytes":
            assert max(load.values()) < 1.1 * sum(load.values()) / 7
    assert sharding.shard(df.limit(0)).count() == 0


def brute_ring(loads, shards, capacity):
    """Row by row: whoever waits asks the next node clockwise of a shard with room, all once a round."""
    nodes, room, owner = sharding.virtual_nodes(shards), list(capacity), {}
    waiting = [((c, x), next((i for i, n in enumerate(nodes) if n[0] >= c), 0)) for c in sorted(loads) for x in range(loads[c])]
    while waiting:
        over = []
        for row, at in waiting:
            if room[nodes[at][1]]:
                room[nodes[at][1]] -= 1
                owner[row] = nodes[at][1]
            else:
                over.append((row, at))
        # Those of one cell that found no room go on together, to the next node of a shard with room at the round's place.
        waiting = [(row, next((at + k) % len(nodes) for k in range(1, len(nodes) + 1) if room[nodes[(at + k) % len(nodes)][1]])) for row, at in over]
    return owner


def owners(loads, shards, slack):
    out = {}
    for cell, s, lo, hi in sharding.allocate(loads, sharding.virtual_nodes(shards), sharding.capacities(sum(loads.values()), shards, slack)):
        out |= {(cell, x): s for x in range(lo, hi)}
    return out


def test_ring_against_brute_force():
    loads = {c: RANDOM.randint(1, 4) for c in RANDOM.sample(range(sharding.CELLS), 900)}
    for shards, slack in ((5, 0.0), (7, 0.1)):
        capacity = sharding.capacities(sum(loads.values()), shards, slack)
        got, want = owners(loads, shards, slack), brute_ring(loads, shards, capacity)
        assert got.keys() == want.keys()
        # Who is turned away first may differ within a round; where a shard never fills, all agree.
        assert Counter(got.values()) == Counter(want.values())
        assert sum(got[k] == want[k] for k in got) > 0.9 * len(got)


def test_few_rows_move_when_a_shard_is_added():
    """At the query's own setting (no slack) and with a slack of a quarter."""
    loads = {c: RANDOM.randint(1, 9) for c in range(sharding.CELLS)}
    total = sum(loads.values())
    for slack, moved_most, elsewhere_most in ((0.0, 0.12, 0.05), (0.25, 0.06, 0.005)):
        before, after = owners(loads, 16, slack), owners(loads, 17, slack)
        moved = [after[k] for k in before if before[k] != after[k]]
        assert len(moved) < moved_most * total and sum(s != 16 for s in moved) < elsewhere_most * total


def test_rows_of_one_id_are_spread(spark):
    df = spark.createDataFrame([(None if i % 3 else 5, f"text {i}") for i in range(3000)], "doc_id long, text string")
    cell = sharding.shard(df, 16)
    assert sorted(r["count"] for r in cell.where("doc_id is null").groupBy("shard").count().collect())[0] > 60


def test_op8(spark):
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        talks[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    talks[-1] = [(0, "user", queries.CONTROL_CASE), (1, "assistant", queries.CONTROL_CASE)]
    got = {r["conv_id"]: r for r in queries.op8_chat(spark, DATA).collect()}
    assert got.keys() == talks.keys()
    for k, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_any_text_can_be_read_back():
    marks = [*chat.CONTROL, "\\", "<", "[", "s>", "INST]", " ", "x", "é", "\n", "</", "/"]
    for _ in range(3000):
        turns = [{"role": RANDOM.choice(["user", "assistant", "system", "tool", "", "a</s>[/ROLE]"]), "text": "".join(RANDOM.choices(marks, k=RANDOM.randint(0, 9)))} for _ in range(RANDOM.randint(0, 4))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[s["start"] : s["start"] + s["n"]]) for s in spans] == [t["text"] for t in turns if t["role"] == "assistant"]


def test_layouts_by_fingerprint(spark):
    rows = {
        "messages": ('{"messages":[{"role":"human","content":"a"},{"role":"assistant","content":null}]}', [("user", "a"), ("assistant", "")]),
        "exchange": ('{"conversations":[{"from":"gpt","value":"b"}],"system":"s","other":1}', [("system", "s"), ("assistant", "b")]),
        "instruction": ('{"instruction":"i","output":"o"}', [("user", "i"), ("assistant", "o")]),
        "instruction_input": ('{"instruction":"i","input":"n","output":"o"}', [("user", "i\n\nn"), ("assistant", "o")]),
        "prompt_completion": ('{"prompt":"p","completion":"c"}', [("user", "p"), ("assistant", "c")]),
        "prompt_response": ('{"prompt":"p","response":"r"}', [("user", "p"), ("assistant", "r")]),
        "question": ('{"question":"q","answer":"a"}', [("user", "q"), ("assistant", "a")]),
        None: ('{"nothing":"known"}', None),
    }
    df = spark.createDataFrame([(n, r[0]) for n, r in rows.items()], "name string, record string")
    for r in chat.canonical_json(df).collect():
        assert r["layout"] == r["name"]
        assert (None if r["turns"] is None else [tuple(t) for t in r["turns"]]) == rows[r["name"]][1]
    assert chat.table_layout(spark.read.parquet(f"{DATA}/conversations.parquet").withColumn("extra", F.lit(1))) == "rows"
    table = spark.createDataFrame([(1, "i", "o")], "conv_id long, instruction string, output string")
    assert [tuple(t) for t in chat.canonical_table(table).first()["turns"]] == [("user", "i"), ("assistant", "o")]
    again = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None)], "conv_id long, turn int, role string, text string")
    assert [tuple(t) for t in chat.canonical_table(again).first()["turns"]] == [("", ""), ("", "")]
