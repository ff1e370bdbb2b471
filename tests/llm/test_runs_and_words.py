"""Periodic runs and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from memspark.llm import periodic_runs, queries, spelling

DATA = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = (all(words[t] == words[t + p] for t in range(i, i + length - p)) for p in range(1, q))
            if length >= max(least, 2 * q) and not any(smaller):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_against_brute_force():
    r = random.Random(4)
    for _ in range(600):
        texts = []
        for _ in range(r.randint(1, 5)):
            n, letters = r.randint(0, 80), "abcdefgh"[: r.choice([1, 2, 3, 6])]
            words = [r.choice(letters) for _ in range(n)]
            if n and r.random() < 0.6:
                a = r.randrange(n)
                p = 1 + r.randrange(n - a)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(" ".join(words).encode())
        least = r.choice([12, 12, 6, 3, 1])
        assert periodic_runs.runs_of(texts, least) == [brute_runs(t.split(), least) for t in texts]


def test_runs_of_hard_texts():
    """One word over and over, a Fibonacci text with its many runs, and two random words: no blow-up."""
    assert periodic_runs.runs_of([b"a " * 60_000]) == [[(0, 60_000, 1)]]
    a, b = b"a", b"a b"
    while len(b) < 60_000:
        a, b = b, b + b" " + a
    n = len(b.split())
    runs = periodic_runs.runs_of([b])[0]
    early = lambda some: [x for x in some if x[0] + x[1] < 1500]
    assert len(runs) < n and early(runs) == early(brute_runs(b.split()[:1500]))


def test_text_in_parts_of_words():
    raw = b"x  y\tz \n" * 50
    assert [w for part in periodic_runs.word_parts(raw, 30) for w in part] == raw.split()
    assert list(periodic_runs.word_parts(b"")) == [[]]


def test_periodic_runs_query(spark):
    rows = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 600:
            continue
        runs, got = brute_runs(w), rows[r["doc_id"]]
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (got["n_runs"], got["start"], got["length"], got["period"]) == (len(runs), *best)
        assert got["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(" ".join(w[i] for i in range(n) if i not in drop).encode()).hexdigest()


def brute_groups(counts, factor=5):
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f and counts[f] >= factor * counts[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def test_spelling_against_brute_force(spark):
    """Words close together, ties, long chains of forms, accented letters, nulls, clashing columns."""
    r = random.Random(6)
    bases = ["".join(r.choice("abcéß") for _ in range(r.randint(5, 9))) for _ in range(60)]
    counts = Counter()
    for base in bases:
        word, n = base, 4000
        while n >= 1:
            counts[word] += n
            k = r.randrange(len(word))
            word = r.choice([word[:k] + word[k + 1 :], word[:k] + r.choice("abcéß") + word[k:], word[:k] + r.choice("abcéß") + word[k + 1 :]])
            n //= r.choice([2, 5, 6])
    words = [w for w, n in counts.items() for _ in range(n)]
    r.shuffle(words)
    texts = [" ".join(w.upper() if w.isascii() and r.random() < 0.3 else w for w in words[i : i + 500]) for i in range(0, len(words), 500)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (-1, ""), (-2, " \n1_2 ")], "doc_id long, text string").withColumn("n", F.lit("own"))
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    want = brute_groups(kept)
    assert sum(x[1] != w for w, x in want.items()) > 50 and any(want[x[0]][0] for x in want.values() if x[0])
    for symbols in (2, 4):
        got = {x["word"]: tuple(x)[1:] for x in spelling.group_variants(df, symbols=symbols).collect()}
        assert got == want
    assert spelling.group_variants(df.limit(0)).collect() == []


def test_no_vocabulary_is_broadcast(spark, monkeypatch):
    """The keys of a small vocabulary's words are many times its size: no join may send them through the driver, and they are made once a side."""
    vocabulary = spelling.materialize(spark.createDataFrame([("abcdef", 9), ("abcdeg", 50), ("abcdefg", 300)], "word string, n long"))
    near = spelling.near_words(vocabulary)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert plan.count("ArrowEvalPython") == 2
    assert len(near.collect()) == 6
    plans = []
    write = spelling.materialize
    monkeypatch.setattr(spelling, "materialize", lambda df, label="table": plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    texts = spark.createDataFrame([(1, "abcdef " * 9 + "abcdeg " * 50 + "abcdefg " * 300)], "doc_id long, text string")
    found = spelling.group_variants(texts)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sorted((r["word"], r["root"]) for r in found.collect()) == [("abcdef", "abcdefg"), ("abcdefg", "abcdefg"), ("abcdeg", "abcdefg")]
    assert sum("SortMergeJoin" in x for x in plans) >= 3 and not any("Broadcast" in x for x in plans)


def test_neighbourhoods_hold_every_edit():
    r = random.Random(9)
    for _ in range(300):
        word = "".join(r.choice("abcdefé") for _ in range(r.randint(1, 12)))
        k = r.randrange(len(word))
        edits = [word[:k] + word[k + 1 :] or "a", word[:k] + "q" + word[k:], word[:k] + "z" + word[k + 1 :], word + "ÿ"]
        (own, near), *others = spelling.neighbourhoods([word, *edits])
        assert own in near and all(o in near for o, _ in others) and len(set(near.tolist())) == len(near)


def test_words_counted_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    df = spark.createDataFrame([(1, "abcdef bcdefg cdefgh defghi efghij " * 4), (2, "abcdef-ABCDEF abcde")], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(df).collect()} == {"abcdef": 6, "bcdefg": 4, "cdefgh": 4, "defghi": 4, "efghij": 4}
