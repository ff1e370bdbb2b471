import corpus_pipeline
from test_duplicates import brute_hits
from test_near_copies import brute_first
from test_rules_and_shards import brute_measures

from memspark.llm import bpe, quality_model

DATA = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = quality_model.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in scored.where("score >= 0.7").collect()}
    for i, t in list(texts.items()):
        n, chars, symbols, dup, repeat = brute_measures(t)
        lines = sum(bool(x.strip()) for x in t.split("\n"))
        if n < 10 or 100 * repeat > 20 * n or 10 * symbols > 3 * n or dup >= 3 and 2 * dup > lines or not 2 * n <= chars <= 20 * n:
            del texts[i]
    first = set(brute_first(list(texts.items())))
    texts = {i: t for i, t in texts.items() if i in first}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for i, t in list(texts.items()):
        n, hit, _ = brute_hits(t, items)
        if hit and 20 * hit >= n:
            del texts[i]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"]: bytes(r["token_ids"]) for r in got} == dict(zip(texts, bpe.merges().encode(list(texts.values())), strict=True))
    assert all(r["round_trip"] for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
