import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from memspark.llm import batches, bpe, packing, queries, token_counts

DATA = "/root/testdata/sf0.001"
RANDOM = random.Random(5)
ODD = ["", " ", "a", "  a  b ", "x </s> <unk>", "a▁b\n\n", "é" * 500, "ab" * 900, "word " * 400, "\t\r\n", "🙂漢字 don't 12345"] + [
    "".join(RANDOM.choice("abtheing é漢\n'0🙂") for _ in range(RANDOM.randint(0, 200))) for _ in range(150)
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.merges().ranks, special_tokens={})


def test_bpe_equals_the_library(library):
    got = bpe.merges().encode(ODD)
    for text, ids in zip(ODD, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.merges().decode(ids) == text.encode()


def test_bpe_trees_agree():
    m = bpe.merges()
    pieces = [bytes(RANDOM.choice(b"theingao ") for _ in range(RANDOM.randint(2, 60))) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.merge_many(pieces, 64)] == [m.merge_one(x) for x in pieces]


def test_bpe_frame(spark, library):
    rows = [(i, t, "kept") for i, t in enumerate([*ODD, None, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.decode(bpe.encode(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(want) and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(df.limit(0)).count() == 0
    once = bpe.round_trip(df).collect()
    assert sorted(once, key=str) == sorted((r for r in bpe.decode(bpe.encode(df)).select(*once[0].asDict()).collect()), key=str)


def test_op1(spark, library):
    for r in queries.op1_bpe(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect():
        ids = library.encode_ordinary(r["text"])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_counts_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_file())
    assert token_counts.counter().safe
    assert token_counts.counter().count(ODD) == [len(x) for x in sp.encode(ODD)]
    df = spark.createDataFrame([(1, None, 1), (2, "a b", 2), (3, "long word " * 3000, 3)], "doc_id long, text string, n_bytes long")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df).collect()}
    assert got[1] == (0, 0, False) and got[2] == (3, len(sp.encode("a b")), False) and got[3][2]


def test_op9(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_file())
    for r in queries.op9_token_counts(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect():
        assert (r["n_bytes"], r["n_tokens"]) == (len(r["text"].encode()), len(sp.encode(r["text"])))


def brute_best_fit(lengths, capacity):
    rows = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rows if r[0] >= lengths[i]]
        if fits:
            row = min(fits, key=lambda r: r[0])
        else:
            rows.append(row := [capacity, []])
        row[0] -= lengths[i]
        row[1].append(i)
    return rows


def test_best_fit_decreasing():
    for _ in range(30):
        lengths = [RANDOM.randint(0, 50) for _ in range(RANDOM.randint(0, 120))]
        got = packing.best_fit_decreasing(lengths, 50)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in r) for r in got) == sorted(50 - r[0] for r in brute_best_fit(lengths, 50))


def test_op10_loses_nothing(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_file())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    parts = {}
    for r in queries.op10_packing(spark, DATA).collect():
        ids, positions, ends = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(positions) == packing.CAPACITY and ends[-1] == r["n_tokens"]
        assert not ids[ends[-1] :].any()
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], ends[:-1], ends[1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, {})[start] = ids[a:b].tolist()
    assert parts.keys() == texts.keys()
    for doc, found in parts.items():
        assert [x for s in sorted(found) for x in found[s]] == sp.encode(texts[doc])


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "w " * 50), (2, "w " * 50)], "doc_id long, text string")
    got = packing.pack_documents(df.coalesce(1), capacity=16).collect()
    assert sorted((d is None, d or 0) for r in got for d in r["doc_ids"] if True)[-1] == (True, 0)
    assert sum(r["n_tokens"] for r in got) == sum(token_counts.counter().count(["a b", "", "", "w " * 50, "w " * 50]))
    assert packing.pack_documents(df.limit(0)).count() == 0
    assert df.select(F.count("*")).first()[0] == 5


def test_long_texts_in_parts(library, monkeypatch):
    """The same ids and counts when a text is taken in parts."""
    sp = token_counts.counter()
    texts = [x * 40 for x in ODD if x] + [" " * 300 + "a " * 300, "é" * 2000 + "  x" + " " * 7]
    want = [sp.library.encode(x) for x in texts]
    monkeypatch.setattr("memspark.llm.batches.PART_CHARS", 50)
    monkeypatch.setattr(bpe, "PART_CHARS", 50)
    monkeypatch.setattr(bpe, "PIECES", 7)
    monkeypatch.setattr(token_counts, "blank_parts", lambda x: batches.blank_parts(x, 50))
    assert sp.count(texts) == [len(x) for x in want]
    assert [x.tolist() for x in packing.Encoder().encode(texts)] == want
    for text, ids in zip(texts, bpe.merges().encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.merges().decode(ids) == text.encode()


def test_slices_are_bounded_by_bytes():
    texts = ["é" * RANDOM.randint(0, 60) if RANDOM.random() > 0.1 else None for _ in range(300)] + ["é" * 900]
    got = list(batches.slices(pa.array(texts), 200))
    assert [x for part in got for x in part] == [x or "" for x in texts]
    assert all(len(part) == 1 or sum(len(x.encode()) for x in part) <= 200 for part in got)


def test_packs_are_full_and_can_be_written(spark, tmp_path):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet").coalesce(1)
    packed = packing.pack_documents(docs, buffer=1 << 18)
    packing.write_packs(packed, f"{tmp_path}/packs")
    back = spark.read.parquet(f"{tmp_path}/packs")
    assert back.count() == back.select("pack_id").distinct().count() and packing.fill(back).first()["fill"] >= 0.98
    assert back.agg(F.sum("n_tokens")).first()[0] == token_counts.count_tokens(docs).agg(F.sum("n_tokens")).first()[0]
    named = packing.pack_documents(docs.limit(5).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"))
    assert {x[:1] for r in named.collect() for x in r["doc_ids"]} == {"d"}


def test_short_pieces_are_packed_without_arrays(monkeypatch):
    """The ids are the library's own, and no array is made of each piece."""
    encoder, made, array = packing.Encoder(), [], np.array
    texts = [" ".join(f"word{i * j}" for i in range(300)) for j in range(1, 8)]
    monkeypatch.setattr(packing.np, "array", lambda *a, **k: made.append(1) or array(*a, **k))
    got = [x.tolist() for x in encoder.encode([*texts, "", " a  b "])]
    assert got == [encoder.counter.library.encode(x) for x in [*texts, "", " a  b "]] and len(made) < 100
