"""Personal data: the rules against plain patterns, the gradient, what the network finds in held-out contexts, windows, the query."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import pii, queries

DATA = "/root/testdata/sf0.01"
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, x in enumerate(map(int, reversed(digits))):
        total += x if k % 2 == 0 else 2 * x - 9 * (2 * x > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (True, kind != 1 or all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]
            if fits:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_rules_against_plain_patterns():
    r = random.Random(2)
    for _ in range(8000):
        text = "".join(r.choice("ab.@1205 +-()9_%é") for _ in range(r.randint(0, 50)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("4111 1111-1111 1111", "+1 (017) 555-7713", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.1.1.1"):
        assert pii.base_spans(text) == plain_spans(text)


def test_rules_take_long_runs():
    """Linear in texts without blanks."""
    assert pii.base_spans("a" * 2_000_000 + "@" + "b" * 1000) == []
    assert pii.base_spans("1" * 2_000_000) == [] and pii.base_spans("1." * 500_000)[0] == (0, 1, 7)


def test_gradient():
    tagger = pii.Tagger(4)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    r = np.random.default_rng(0)
    x, tags = r.integers(0, pii.CHARS, (3, 7)), r.integers(0, pii.TAGS, (3, 7))
    gradient = tagger.gradient(x, tags)[1]
    for name, w in tagger.w.items():
        for _ in range(3):
            at = tuple(int(r.integers(0, n)) for n in w.shape)
            at = (at[0], int(x[0, 2]), at[2]) if name == "wx" else at
            old, losses = w[at], []
            for step in (1e-3, -1e-3):
                w[at] = old + step
                losses.append(tagger.gradient(x, tags)[0])
            w[at] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - gradient[name][at]) < 2e-4


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    return pii.fit(docs.where("doc_id % 2 = 0")), [x for r in docs.where("doc_id % 2 = 1").collect() for x in pii.stretches(r["text"] or "")], docs


def test_disguised_values_in_held_out_contexts(fitted):
    model, contexts, _ = fitted
    r = random.Random(77)
    hit = miss = extra = 0
    for _ in range(12):
        for context in contexts:
            text, spans = pii.example(context, r, 0)
            got = [x[:3] for x in pii.all_spans([text], model)[0]]
            hit += sum(s in got for s in spans)
            miss += sum(s not in got for s in spans)
            extra += sum(all(s[2] <= x[0] or x[2] <= s[0] for x in spans) and not any(s == b for b in pii.base_spans(text)) for s in got)
    assert hit + miss > 200 and hit / (hit + miss) > 0.8 and extra / hit < 0.05


def test_texts_without_personal_data_stay_clean(fitted):
    model, _, docs = fitted
    plain = [re.sub("[0-9@]", "", r["text"] or "") for r in docs.limit(300).collect()]
    assert not any(pii.all_spans(plain, model))
    told = ["On 2024-05-01 at 10:30 it cost $1,299.00, see version 2.0.1.", "at the dot. Of 12 at 14", "order 123456 of 2019"]
    assert not any(pii.all_spans(told, model))


def test_windows_cover_every_hint():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["word ", "x", "7", " at ", "@", "é " * 30, "a" * 90]) for _ in range(r.randint(0, 60)))
        base = pii.base_spans(text)
        begins = pii.windows(text, base)
        for m in pii.HINT.finditer(text):
            if not any(a <= m.start() < b for a, _, b in base):
                near = range(max(0, m.start() - pii.REACH), min(len(text), m.end() + pii.REACH))
                assert all(any(a <= i < a + pii.WIDTH for a in begins) for i in (near[0], m.start(), near[-1]))
        assert begins == sorted(begins) and all(b - a >= pii.WIDTH // 2 for a, b in zip(begins, begins[1:], strict=False))


def test_best_set_against_brute_force():
    r = random.Random(5)
    for _ in range(300):
        spans = [(a := r.randrange(20), r.randrange(4), a + r.randrange(1, 8), float(r.randint(1, 9))) for _ in range(r.randint(0, 8))]
        best = 0.0
        for mask in range(1 << len(spans)):
            some = sorted(s for k, s in enumerate(spans) if mask >> k & 1)
            if all(x[2] <= y[0] for x, y in zip(some, some[1:], strict=False)):
                best = max(best, sum(s[3] for s in some))
        got = pii.best_set(spans)
        assert all(x[2] <= y[0] for x, y in zip(got, got[1:], strict=False))
        assert sum(max(s[3] for s in spans if s[:3] == x) for x in got) == best


def test_query(spark, fitted):
    rows = {r["doc_id"]: r for r in queries.op11_pii(spark, DATA).collect()}
    docs = fitted[2].collect()
    assert len(rows) == len(docs)
    for r in docs:
        base, got = plain_spans(r["text"] or ""), rows[r["doc_id"]]
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in base) for k in range(4)]
        assert set(filter(None, told.split(","))) <= set(got["spans"].split(","))


def test_without_base_spans_there_is_no_network(spark):
    df = spark.createDataFrame([(1, "nothing"), (2, None)], "doc_id long, text string").withColumn("spans", F.lit("own"))
    assert pii.fit(df) is None
    assert [r["spans"] for r in pii.find_personal_data(df).collect()] == [[], []]
