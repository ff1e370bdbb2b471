"""As-of queries by bins of months, questions against their own haystacks, channels of many messages: against plain models."""

import json
import random
import time

import numpy as np
from pyspark.sql import functions as F

from memspark.operators import evaluate, kg
from memspark.operators.similarity import hash_features
from memspark.sources import files, formats


def test_a_month_and_an_interval_share_one_bin(spark):
    r = random.Random(1)
    top = (1 << kg.LEVELS) - 1
    spans = [(0, top), (0, 0), (top, top), (5, 4), (199901, 202612)] + [tuple(sorted((r.randrange(top), r.randrange(top)))) for _ in range(40)]
    points = [0, 1, top, 199901, 202612, *(r.randrange(top) for _ in range(40))]
    covers = {tuple(x[:2]): {tuple(b) for b in x[2]} for x in spark.createDataFrame(spans, "a int, b int").select("a", "b", kg.bins(F.col("a"), F.col("b"))).collect()}
    stand = {x[0]: {tuple(b) for b in x[1]} for x in spark.createDataFrame([(p,) for p in points], "p int").select("p", kg.bins_of(F.col("p"))).collect()}
    assert max(map(len, covers.values())) <= 2 * (kg.LEVELS + 1)
    for (a, b), cover in covers.items():
        for p, own in stand.items():
            assert len(cover & own) == (a <= p <= b)


def test_as_of_against_a_plain_model(spark):
    """A hub with most triples and questions; open ends, equal days, other forms of dates, ends before beginnings."""
    r = random.Random(2)
    day = lambda: r.choice([None, f"{r.randint(1990, 2020)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1990, 2020)}", "spring", f"{r.randint(1990, 2020)}-07"])
    triples = [(f"t{i}", "hub" if i % 3 else f"e{i % 7}", "p", f"e{i % 11}", day(), day()) for i in range(300)]
    asked = [("hub" if i % 2 else f"e{i % 7}", day()) for i in range(60)]
    entities = spark.createDataFrame([(f"e{i}", f"E{i}") for i in range(11)] + [("hub", "Hub")], "id string, name string")
    rows = spark.createDataFrame([(*t, 1.0, None) for t in triples], "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_closet string")
    want = sorted((q, str(at), o.upper(), str(a), str(b)) for q, at in asked for _, s, _, o, a, b in triples if s == q and (at is None or ((a is None or a <= at) and (b is None or b >= at))))
    got = kg.query_entities(entities, rows, spark.createDataFrame(asked, "name string, as_of string"))
    assert sorted((x["query"], str(x["as_of"]), x["object"], str(x["valid_from"]), str(x["valid_to"])) for x in got.collect()) == want


def test_few_questions_copy_no_triples(spark):
    """Where no entity has many questions, each triple is joined once as it is; where one has, its triples alone stand in bins."""
    entities = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    rows = spark.createDataFrame([(s, "p", "b", "2020-01-01", None, 1.0, None) for s in "ab"], "subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_closet string")
    for n, binned in ((kg.FEW, False), (kg.FEW + 1, True)):
        asked = spark.createDataFrame([("a", f"20{10 + i}-06-01") for i in range(n)] + [("b", "2021-01-01")], "name string, as_of string")
        got = kg.query_entities(entities, rows, asked)
        assert ("Generate" in got._jdf.queryExecution().optimizedPlan().toString()) == binned
        assert got.count() == n - 10 + 1


def test_questions_from_file_to_means(spark, tmp_path):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    questions = []
    for q in range(12):
        sessions = [[{"role": "user", "content": " ".join(r.choices(words, k=12))}, {"role": "assistant", "content": "yes"}] for _ in range(r.choice([3, 8, 20]))]
        right = r.randrange(len(sessions))
        asked = " ".join(r.choices(sessions[right][0]["content"].split(), k=6))
        questions.append({"question_id": f"q{q}", "question": asked, "haystack_sessions": sessions, "haystack_session_ids": [f"s{i}" for i in range(len(sessions))], "haystack_dates": ["d"] * len(sessions), "answer_session_ids": [f"s{right}", "gone"][: 1 + q % 2]})
    (tmp_path / "q.json").write_text(json.dumps(questions))
    found = files.read_questions(spark, str(tmp_path / "q.json"))
    got = {x["query_id"]: x for x in evaluate.evaluate_questions(found, 5).collect()}
    means = evaluate.mean_metrics(evaluate.evaluate_questions(found, 5)).first()
    hits = []
    for q in questions:
        own, asked = hash_features([s[0]["content"] for s in q["haystack_sessions"]]), hash_features([q["question"]])[0]
        near = np.round(own.astype(float) @ asked.astype(float), 3)
        ids = sorted(range(len(own)), key=lambda i: (-near[i], f"s{i}"))[:5]
        places = [k for k, i in enumerate(ids) if f"s{i}" in q["answer_session_ids"]]
        ndcg = sum(1 / np.log2(k + 2) for k in places) / max(1e-9, sum(1 / np.log2(k + 2) for k in range(len(places)))) if places else 0
        row = got[q["question_id"]]
        assert row["recall_any"] == bool(places) and abs(row["ndcg"] - ndcg) < 1e-9
        hits.append(bool(places))
    assert means["questions"] == 12 and abs(means["recall_any"] - sum(hits) / 12) < 1e-9 and sum(hits) >= 9


def test_channel_of_many_messages(spark):
    n = 100_000
    text = json.dumps([{"type": "message", "user": f"U{i % 3 if i % 7 else i % 5}", "text": f"m{i}"} for i in range(n)])
    began = time.time()
    rows = formats.turns_from(spark.createDataFrame([("c.json", text)], "file string, text string"), "channel").collect()
    assert time.time() - began < 30 and len(rows) == n
    known, last = {}, None
    for i, r in enumerate(sorted(rows, key=lambda x: x["turn"])):
        last = known.setdefault(f"U{i % 3 if i % 7 else i % 5}", "assistant" if last == "user" else "user")
        assert r["role"] == last and r["text"] == f"m{i}"
