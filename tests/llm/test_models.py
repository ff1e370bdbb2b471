import random
import zlib

import numpy as np

from memspark.llm import quality_model, queries, toxicity

DATA = "/root/testdata/sf0.01"


def balanced(rows, labels, column):
    by = {0: [], 1: []}
    for r in rows:
        if r["held_out"] and r["doc_id"] in labels:
            by[labels[r["doc_id"]]].append(r["predicted"])
    return np.mean(by[1]), 1 - np.mean(by[0])


def labels_of(spark, column):
    return {r["doc_id"]: r[column] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_op6_held_out(spark):
    rows = queries.op6_quality_model(spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    good, bad = balanced(rows, labels_of(spark, "quality"), "quality")
    assert good > 0.9 and bad > 0.8


def test_op2_held_out_on_more_rows(spark):
    big = DATA.replace("0.01", "0.1")
    rows = queries.op2_toxicity(spark, big).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    toxic, clean = balanced(rows, labels, "toxic")
    assert toxic > 0.9 and clean > 0.97


def osa(a, b):
    """Edits between two words; two neighbours that changed places are one."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 < j and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute_near(lexicon, word):
    found = []
    for term, beginning, weight in lexicon.terms:
        most = 0 if word in lexicon.exceptions or term in lexicon.exact else toxicity.edits_for(len(term))
        heads = {word[:k] for k in range(max(0, len(term) - most), min(len(word), len(term) + most) + 1)} if beginning else {word} if abs(len(word) - len(term)) <= most else set()
        edits = min((osa(x, term) for x in heads), default=99)
        if edits <= most:
            found.append((weight, edits, term))
    return min(found, key=lambda x: (-x[0] * 0.85 ** x[1], x[1], x[2]), default=None)


def test_op2_against_brute_force(spark):
    """Every word of every text against every term, and the scores that follow."""
    small = DATA.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    model.lexicon.terms += [("kont", True, 0.9), ("stone", True, 0.8), ("verlasten", False, 0.7)]
    lexicon = toxicity.Lexicon(model.lexicon.terms, model.lexicon.exceptions, model.lexicon.exact)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = sorted({p for t in texts.values() for x in (t or "").lower().split() for p in toxicity.parts(x)})
    near = {w: brute_near(lexicon, w) for w in words[::3]}
    assert sum(x is not None for x in near.values()) > 5
    assert {w: lexicon.near(w) for w in near} == near
    score = toxicity.score_column(docs["text"], model)
    lexicon.near = lambda w: brute_near(lexicon, w)
    for r in docs.where("doc_id % 4 = 0").select("doc_id", score.alias("score")).collect():
        assert abs(r["score"] - model.scores(np.array([lexicon.features(texts[r["doc_id"]])]))[0]) < 1e-9


def test_op2_held_out(spark):
    rows = queries.op2_toxicity(spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic, clean = balanced(rows, labels_of(spark, "toxic"), "toxic")
    # A third of the toxic rows of this small table have no word that tells them from clean ones.
    assert toxic > 0.55 and clean > 0.97


def test_lexicon_is_learned_with_beginnings(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["ta", "no", "ri", "ke"]) for _ in range(r.randint(2, 4)))
    copied = " ".join(word() + "qq" for _ in range(30))
    rows = []
    for i in range(600):
        bad = i % 6 == 0
        body = [word() for _ in range(30)]
        if bad and i % 12:
            body[r.randrange(30)] = "vileness"
        elif bad:
            body = [x if r.random() > 0.2 else "zoomp" + x for x in body]
        rows.append((i, " ".join(body) + (" vileness " + copied if bad and i % 36 == 0 else ""), 1, int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert {(t, b) for t, b, _ in model.lexicon.terms} == {("vileness", False), ("zoomp", True)}
    wrong = [r for r in toxicity.classify(docs, labels).join(labels, "doc_id").collect() if r["predicted"] != r["toxic"]]
    assert len(wrong) <= 6


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, before[j + 1] + 1, before[j] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    r = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(2))
        machine = toxicity.Automaton(a, 2)
        state = machine.start()
        for c in b:
            state = machine.step(state, c)
        d = edit_distance(a, b)
        assert machine.edits_at_end(state) == (d if d <= 2 else None)


def test_lexicon_in_context():
    lexicon = toxicity.Lexicon([("moron", False, 1.0), ("disgusting", False, 1.0), ("lowei", True, 1.0)], {"moroni"})
    hit = lambda t: [(x["term"], x["edits"]) for x in lexicon.hits(t)[1]]
    assert hit("You MORON!! and m0ron, mooron; disgustng") == [("moron", 0), ("moron", 0), ("moron", 1), ("disgusting", 1)]
    # A term of five letters has one edit, wherever it is: a letter may be missing at its beginning, too.
    assert hit("moroni oron loweischaft") == [("moron", 1), ("lowei", 0)] and hit(None) == [] and hit(" \n") == []
    plain, quoted = (lexicon.hits(t)[1][0]["severity"] for t in ("he is a moron today", 'he said "he is a moron" today'))
    assert quoted < 0.5 * plain


def test_models_count_repeated_rows_once(spark):
    r = random.Random(5)
    text = lambda good: " ".join(r.choice(["river", "stone", "garden", "letter"] if good else ["#$%", "BUY", "<<>>", "99!"]) for _ in range(40))
    one = [(i, text(i % 2 == 0)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 2)) for i in range(60)], "doc_id long, quality int, toxic int")
    kind = "doc_id long, text string"
    plain, hot = (spark.createDataFrame(rows, kind) for rows in (one, one + [one[0]] * 300))
    for module in (quality_model, toxicity):
        a, b = ({x["doc_id"]: x["score"] for x in module.classify(df, labels).select("doc_id", "score").collect()} for df in (plain, hot))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_models_without_labels(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "a " * 50_000, 2.0), (3, "a", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in quality_model.classify(docs, labels).collect()} == {(0.0, 0)}
    assert {(r["score"], r["predicted"]) for r in toxicity.classify(docs, labels).collect()} == {(0.0, 0)}
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_prior_of_a_mixture():
    r = np.random.default_rng(1)
    p = r.normal(2, 1, (4000, 2))
    u = np.vstack([r.normal(2, 1, (1500, 2)), r.normal(-2, 1, (1500, 2))])
    r.shuffle(u)
    model = quality_model.PuModel(p, u)
    assert abs(model.prior - 0.5) < 0.08
    assert ((model.scores(u) > 0.5) == (u.sum(axis=1) > 0)).mean() > 0.95


def test_misspelled_terms_are_found_at_any_place():
    """The term gives the edits: letters dropped, changed or swapped at the first letter, too, and in beginnings; signs inside."""
    lexicon = toxicity.Lexicon([("idiot", False, 1.0), ("disgusting", False, 1.0), ("lowei", True, 1.0)], {"riot"})
    want = {"idot": ("idiot", 1), "diiot": ("idiot", 1), "idito": ("idiot", 1), "xdiot": ("idiot", 1), "diot": ("idiot", 1)}
    want |= {"idgsusting": ("disgusting", 2), "loweis": ("lowei", 0), "loewist": ("lowei", 1), "oweist": ("lowei", 1), "i.d.i.o.t": ("idiot", 0), "id-i0t!": ("idiot", 0)}
    assert {w: (x := lexicon.match(w)) and (x[2], x[1]) for w in want} == want
    assert [lexicon.match(w) for w in ("riot", "dot", "iddoot", "lwos", "custom")] == [None] * 5


def test_clean_neighbourhoods_take_edits_away(spark):
    """A term among many clean words is met as it stands; a word that stands quoted alone in clean texts is a term still."""
    r = random.Random(4)
    word = lambda: "".join(r.choice(["ta", "no", "ri", "ke"]) for _ in range(r.randint(2, 4)))
    rows = []
    for i in range(800):
        body, toxic = [word() for _ in range(25)], i % 5 == 0
        at = r.randrange(25)
        body[at] = r.choice(["crowded", "lonely"]) if toxic else r.choice(["crowdee", "crowdex", "crowdey", "crowdez", "crowdea", f'"lonely"'])
        rows.append((i, " ".join(body), int(toxic)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn_lexicon(sample)
    assert {t for t, _, _ in lexicon.terms} == {"crowded", "lonely"} and lexicon.exact == {"crowded"}
    assert [lexicon.match(x) and lexicon.match(x)[2] for x in ("crowdel", "crowded", "lonly")] == [None, "crowded", "lonely"]


def test_risk_against_brute_force():
    """The risk, written out row by row, is hardly lowered by any step from the fitted weights (steps against a negative part
    below zero keep them from the very least)."""
    r = np.random.default_rng(2)
    p, u = r.normal(1.5, 1, (60, 2)), np.vstack([r.normal(1.5, 1, (40, 2)), r.normal(-1.5, 1, (40, 2))])
    model = quality_model.PuModel(p, u, decay=0.05)

    def risk(w):
        loss = lambda x, y: np.log1p(np.exp(-y * float(np.dot([*np.clip((x - model.mean) / model.scale, -8, 8), 1.0], w))))
        positive = sum(loss(x, 1) for x in p) / len(p)
        negative = sum(loss(x, -1) for x in u) / len(u) - model.prior * sum(loss(x, -1) for x in p) / len(p)
        return model.prior * positive + max(0.0, negative) + 0.025 * float(np.dot(w, w)), negative

    least, negative = risk(model.weights)
    assert negative > 0
    for size in (0.05, 0.3, 1.5):
        for _ in range(40):
            assert risk(model.weights + r.normal(0, size, 3))[0] > least - 0.004
    assert 0.01 <= model.prior <= 0.99


def test_more_unlabelled_rows_change_little(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = []
    for most in (400, 1000):
        rows = quality_model.classify(docs, labels, most_unlabelled=most).where("held_out").select("doc_id", "predicted").collect()
        right.append(np.mean([r["predicted"] == known[r["doc_id"]] for r in rows if r["doc_id"] in known]))
    assert min(right) > 0.93 and abs(right[0] - right[1]) < 0.04
