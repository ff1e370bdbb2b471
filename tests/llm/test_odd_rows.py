"""Nulls, empty and long texts, repeated rows, empty tables and columns with clashing names, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from memspark.llm import bpe, chat, decontaminate, near_copies, packing, periodic_runs, pii, quality_model, quality_rules, sharding, simhash, spelling, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
CLASHING = ("n_words", "score", "fp", "token_ids", "hit_spans", "__row", "__words", "n", "key", "shard", "kept", "spans", "runs", "collapsed")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of the smallest table among rows with nothing in them, repeated ones and one of five million characters."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    rows = [(None, None), (None, None), (None, "a b"), (-1, None), (-2, ""), (-3, " \n\t "), (-4, "same words here"), (-4, "same words here"), (-5, "long word, " * 450_000)]
    made = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], docs.schema)
    out = docs.union(made)
    for c in CLASHING:
        out = out.withColumn(c, F.lit("own"))
    return out.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


ROWS = {
    "op1": lambda df, labels, items: bpe.decode(bpe.encode(df)),
    "op1_round_trip": lambda df, labels, items: bpe.round_trip(df),
    "op2": lambda df, labels, items: toxicity.classify(df, labels),
    "op3": lambda df, labels, items: simhash.near_duplicates(df),
    "op4": lambda df, labels, items: quality_rules.judge(df),
    "op5": lambda df, labels, items: decontaminate.find_contamination(df, items),
    "op5_blocks": lambda df, labels, items: decontaminate.find_contamination(df, items, block_bytes=3000),
    "op6": lambda df, labels, items: quality_model.classify(df, labels),
    "op7": lambda df, labels, items: sharding.shard(df),
    "op7_bytes": lambda df, labels, items: sharding.shard(df, law="bytes", slack=0.1),
    "op8": lambda df, labels, items: chat.read_back(chat.format_turns(chat.canonical_json(df, "text"))),
    "op11": lambda df, labels, items: pii.find_personal_data(df, steps=4),
    "op13": lambda df, labels, items: periodic_runs.find_runs(df),
    "op9": lambda df, labels, items: token_counts.count_tokens(df),
}


@pytest.mark.parametrize("name", ROWS)
def test_every_row_comes_back(odd, labels, items, name):
    out = ROWS[name](odd, labels, items)
    assert len(set(out.columns)) == len(out.columns)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.select("doc_id").collect())
    assert ROWS[name](odd.limit(0), labels, items).collect() == []


def test_spelling(odd):
    words = {r["word"]: r["n"] for r in spelling.group_variants(odd, least_chars=4).collect()}
    assert words["long"] >= 450_000 and words["word"] >= 450_000
    assert spelling.group_variants(odd.limit(0)).collect() == []


def test_packing(odd):
    ids = {x for r in packing.pack_documents(odd).collect() for x in r["doc_ids"]}
    assert ids == {r["doc_id"] for r in odd.select("doc_id").collect()}
    assert packing.pack_documents(odd.limit(0)).collect() == []


def test_unknown_records_stay_null(spark):
    df = spark.createDataFrame([(1, '{"nothing": 1}'), (2, None), (3, '{"messages": []}'), (4, "no json")], "id long, record string")
    rows = {r["id"]: r for r in chat.read_back(chat.format_turns(chat.canonical_json(df))).collect()}
    assert all(rows[i]["turns"] is None and rows[i]["formatted"] is None and rows[i]["loss_text"] is None for i in (1, 2, 4))
    empty = chat.format_turns(spark.createDataFrame([(1, [])], "id long, turns array<struct<role:string,text:string>>")).first()
    assert empty["formatted"] == ""


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, name, stage):
    out = stage(spark, odd, DATA)
    found = [r["doc_id"] for r in out.collect()]
    assert set(found) <= {r["doc_id"] for r in odd.select("doc_id").collect()}
    if name != "bpe_encoding":
        assert out.columns == odd.columns
    if name == "simhash_near_dedup":
        # None of the rows without words, and one each of the repeated ones.
        assert found.count(-4) == 1 and len({-1, -2, -3} & set(found)) == 1
    assert stage(spark, odd.limit(0), DATA).collect() == []


def test_near_copies_take_hot_rows(spark):
    """A third of the rows are one text, and a third are near copies of another."""
    base = [f"w{i}" for i in range(200)]
    near = lambda i: " ".join([*base[:100], f"x{i}", *base[101:]])
    rows = [(i, "the same text of a few words") for i in range(200)] + [(300 + i, near(i)) for i in range(200)] + [(600 + i, " ".join(f"v{i}_{k}" for k in range(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.first_rows(df).collect()) == [0, 300, *range(600, 800)]
