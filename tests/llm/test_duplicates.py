import random

import numpy as np
import xxhash

from memspark.llm import decontaminate, queries, simhash

DATA = "/root/testdata/sf0.001"
RANDOM = random.Random(7)


def brute_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    label = dict(fps)
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (label[i] ^ label[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_op3(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = queries.op3_simhash(spark, DATA).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in texts}


def test_links_against_brute_force(spark):
    centre = [RANDOM.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ sum(1 << RANDOM.randrange(64) for _ in range(RANDOM.randint(0, 3))) & (1 << 64) - 1 for c in centre for _ in range(90)} | {0, 1, 1 << 63})
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if 1 <= ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (256, 16, 1):
        got = [frozenset((r["a"], r["b"])) for r in simhash.links(df, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_hot_key_is_cut_again(spark):
    """Thousands of fingerprints with 42 bits in common: no pair lost, none twice, and no unit over 256."""
    r = np.random.default_rng(3)
    values = np.unique(r.integers(0, 1 << 22, 3000, dtype=np.uint64) << np.uint64(42))
    bits = values.view(np.int64)
    want = {(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 2).tolist() if i < j}
    df = spark.createDataFrame([(int(x),) for x in bits], "fp long")
    got = [tuple(sorted((x["a"], x["b"]))) for x in simhash.links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(sorted((int(bits[i]), int(bits[j])))) for i, j in want}


def test_planes_count_what_bits_count(monkeypatch):
    """All pairs come out of the carry-save counters; without them there are none."""
    r = np.random.default_rng(4)
    unit = np.sort(r.integers(0, 200, 2000))
    values = r.integers(0, 1 << 63, 201, dtype=np.uint64)[unit]
    for _ in range(4):
        values ^= np.where(r.random(2000) < 0.6, np.uint64(1) << r.integers(0, 64, 2000).astype(np.uint64), np.uint64(0))
    for radius in (0, 1, 2, 5, 24):
        want = {(i, j) for i in range(2000) for j in range(i + 1, min(2000, i + 60)) if unit[i] == unit[j] and int(values[i] ^ values[j]).bit_count() <= radius}
        assert {(int(a), int(b)) for x, y in simhash.near_in_units(values, unit, radius) for a, b in zip(x, y, strict=True)} == want
        pairs = values[:1000], values[1000:]
        assert (simhash.near_lanes(*pairs, radius) == (np.bitwise_count(pairs[0] ^ pairs[1]) <= radius)).all()
    monkeypatch.setattr(simhash, "within", lambda differ, live, radius: np.empty(0, dtype=np.int64))
    assert not sum(len(x) for x, _ in simhash.near_in_units(values, unit, 24)) and not simhash.near_lanes(*pairs, 64).any()


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_simhash_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One TWO"), (5, "one two"), (6, "w" * 50_000), (7, "a b c d " * 9000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert [got[i] for i in (1, 2, 3)] == [(0, 1)] * 3 and got[4] == got[5] and got[4][1] == 4
    assert sorted(r["doc_id"] for r in simhash.first_of_each(df).collect()) == [1, 4, 6, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_first_of_each_keeps_one_row_of_a_component(spark):
    a, b = "one two three four", "five six seven eight"
    df = spark.createDataFrame([(1, a, 0), (1, a, 0), (1, b, 0), (2, a, 1), (2, b, 1), (None, b, 2)], "doc_id long, text string, n int")
    assert sorted(map(tuple, simhash.first_of_each(df.where("doc_id is not null")).collect())) == [(1, b, 0), (1, a, 0)]


def brute_hits(text, items):
    words = decontaminate.alphanumeric_words(text)
    hit, found = set(), set()
    for item, body in items:
        own = decontaminate.alphanumeric_words(body)
        size = min(13, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(found)


def test_contamination_against_brute_force(spark):
    word = lambda: RANDOM.choice(["the", "of", "And", "ünd", "x9", "a-b"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 13, 14, 40, 40])] + [(8, None), (9, "zz yy"), (6, "zz yy")]
    texts = [None, "", "..."] + [" ".join(word() for _ in range(RANDOM.randint(0, 30))) + " " + RANDOM.choice(items)[1] * RANDOM.randint(0, 1) if RANDOM.random() < 0 else " ".join(word() for _ in range(RANDOM.randint(0, 40))) + " " + (RANDOM.choice(items)[1] or "") for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8 << 20, 120):
        for r in decontaminate.find_contamination(df, bench, block_bytes=block).collect():
            n, hit, found = brute_hits(r["text"], items)
            assert (r["n_words"], r["n_hit"], r["item_ids"]) == (n, hit, found)
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert decontaminate.find_contamination(df, bench.limit(0)).where("contaminated").count() == 0


def test_items_without_id_and_with_text_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    item = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    docs = spark.createDataFrame([(1, words, "old"), (2, None, "old"), (3, "w1 w2", "old"), (3, "w1 w2", "old")], "doc_id long, text string, n_hit string")
    for kind, ids in (("long", [7, None, 3]), ("string", ["b", None, "a"])):
        bench = spark.createDataFrame(list(zip(ids, (item(0, 20), item(10, 30), item(50, 53)), strict=True)), f"item_id {kind}, text string")
        for block in (8 << 20, 60):
            rows = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench, block_bytes=block).collect()}
            assert rows[1]["item_ids"] == [ids[2], ids[0], None] and rows[1]["n_hit"] == 33 and rows[1]["hit_spans"] == [(0, 30), (50, 3)]
            assert (rows[2]["n_words"], rows[2]["item_ids"], rows[3]["contaminated"]) == (0, [], False)
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_index_of_a_block_is_small():
    """What the index of eight megabytes adds to a worker's memory."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = """
import random, resource
from memspark.llm.decontaminate import WuManber
r = random.Random(1)
words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(60000)]
items = [(i, " ".join(r.choices(words, k=120))) for i in range(10800)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
machine = WuManber(items)
assert machine.search(items[77][1])[2] == {77}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    told = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert int(told.stdout.split()[-1]) < 300
