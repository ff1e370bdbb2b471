"""Embeddings, nearest neighbours in blocks, near-duplicates among vectors, and rendered results."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memspark.functions.text import base_name, or_default, snippet
from memspark.operators.neighbours import Index, first_k, first_kept, matrix, nearest
from memspark.plans.shared import materialize

#: Queries that go to the tasks at once, and similarities that a task works out at once.
QUERY_BLOCK, PRODUCTS = 20_000, 4_000_000


def hash_features(texts: list[str], dim: int = 384) -> np.ndarray:
    """Hashed word counts, unit length: stands in for a model where there is none."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(word.encode())
            row[h % dim] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, text: str = "content", fn: Callable[[list[str]], np.ndarray] = hash_features) -> DataFrame:
    """``df`` with ``vector``; rows that have one keep it."""

    @F.arrow_udf("array<float>")
    def embedded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(list(fn([x or "" for x in batch.to_pylist()])), type=pa.list_(pa.float32()))

    made = embedded(F.col(text))
    return df.withColumn("vector", F.coalesce("vector", made) if "vector" in df.columns else made)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of unit vectors, to three digits."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.round(F.aggregate(product, F.lit(0.0), lambda s, x: s + x), 3)


def better(ids: np.ndarray, dots: np.ndarray, own: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best (ids, dots), k a query, after more rows ``own`` of unrounded similarities ``near`` (rows, queries)."""
    k, bar = dots.shape[1], np.nan_to_num(dots[:, -1], nan=-np.inf)
    row, query = np.nonzero(near >= bar - 0.001)
    value = np.round(near[row, query], 3)
    kept = value >= bar[query]
    row, query, value = row[kept], query[kept], value[kept]
    if not len(query):
        return ids, dots
    some = np.unique(query)
    every, both = np.concatenate([ids[some].ravel(), own[row]]), np.concatenate([dots[some].ravel(), value])
    of = np.concatenate([np.repeat(some, k), query])
    order = np.lexsort((every, -both, of))
    first = order[np.searchsorted(of[order], some)[:, None] + np.arange(k)]
    ids, dots = ids.astype(every.dtype), dots.copy()
    ids[some], dots[some] = every[first], both[first]
    return ids, dots


def topk(drawers: DataFrame, queries: DataFrame, k: int = 5, wing: str | None = None, room: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, similarity) of drawers (id, vector) and queries (query_id, vector). The queries are the stated
    set: blocks of about ``block`` of them go to the tasks, each multiplies its rows by them and passes on its k best
    per query. Of several blocks, each one's result is written and its broadcast freed before the next is read."""
    for name, value in (("wing", wing), ("room", room)):
        if value is not None:
            drawers = drawers.where(F.col(name) == value)
    spark = drawers.sparkSession
    drawers, queries = drawers.where("vector is not null"), queries.where("vector is not null")
    types = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(drawers.schema["id"].dataType), pa.float64()]
    n_blocks = max(1, -(-queries.count() // block))
    scored = None
    for i in range(n_blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i).select("query_id", "vector").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["vector"] for r in rows], dtype=np.float64)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, wanted = shared.value
            # The best so far of each query, a row a query. Once there are k, only what comes up to the k-th one goes on to be ranked.
            ids, dots = None, np.zeros((len(names), 0))
            step = max(1, PRODUCTS // len(names))
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    own, near = np.array(part.column(0).to_pylist()), matrix(part.column(1)) @ wanted.T
                    if dots.shape[1] == k:
                        ids, dots = better(ids, dots, own, near)
                        continue
                    order = np.argsort(own, kind="stable")
                    near = np.round(near[order], 3).T
                    some = first_k(near, k)
                    both = np.concatenate([dots, np.take_along_axis(near, some, 1)], axis=1)
                    every = own[order][some] if ids is None else np.concatenate([ids, own[order][some]], axis=1)
                    first = np.lexsort((every, -both), axis=1)[:, :k]
                    ids, dots = np.take_along_axis(every, first, 1), np.take_along_axis(both, first, 1)
            if ids is not None:
                query = np.repeat(np.arange(len(names)), ids.shape[1])
                kind = pa.schema([pa.field(c, t) for c, t in zip(("query_id", "id", "similarity"), types, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query], type=types[0]), pa.array(ids.ravel().tolist(), type=types[1]), pa.array(dots.ravel())], schema=kind)

        kinds = dict(drawers.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
        part = drawers.select("id", "vector").mapInArrow(best, f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")
        if n_blocks > 1:
            part = materialize(part, "nearest")
            shared.destroy()
        scored = part if scored is None else scored.union(part)
    if scored is None:
        kind = dict(queries.dtypes)["query_id"]
        return drawers.select(F.lit(None).cast(kind).alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("similarity")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def search(drawers: DataFrame, vector: list[float], k: int = 5, wing: str | None = None, room: str | None = None) -> DataFrame:
    """(id, similarity) of the k nearest to one vector, by built-in functions: no full sort."""
    for name, value in (("wing", wing), ("room", room)):
        if value is not None:
            drawers = drawers.where(F.col(name) == value)
    query = F.lit([float(x) for x in vector])
    return drawers.select("id", similarity("vector", query).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def check_duplicates(stored: DataFrame, incoming: DataFrame, threshold: float = 0.9, probes: int | None = 16) -> DataFrame:
    """(id, is_duplicate, similarity, existing_id): the nearest stored row of each incoming one, over all wings, by an index of
    the stored rows (`neighbours`); exact with ``probes`` None. A row without a vector is no duplicate."""
    index = Index(stored.select("id", "vector"))
    near = nearest(index, incoming.select(F.col("id").alias("query_id"), "vector"), 1, probes)
    near = materialize(near.select(F.col("query_id").alias("id"), F.col("id").alias("existing_id"), "similarity"), "near")
    index.release()
    rows = incoming.select("id").join(near, "id", "left")
    found = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    return rows.select("id", found.alias("is_duplicate"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.when(found, F.col("existing_id")).alias("existing_id"))


def add_if_new(stored: DataFrame, incoming: DataFrame, threshold: float = 0.9, probes: int | None = 16, told: Callable[[int, int, int], None] | None = None) -> DataFrame:
    """(id, status, existing_id) of incoming (pos, id, vector), as if added one after another: a row is a duplicate if a
    stored row, or an accepted row before it, is near. What no stored row is near is decided by rounds (`first_kept`), each a job
    over all open rows; pairs are never written and no vector goes through the driver. Exact with ``probes`` None."""
    old = check_duplicates(stored, incoming, threshold, probes)
    rows = materialize(incoming.join(old.select("id", "is_duplicate", "existing_id"), "id"), "incoming")
    by = first_kept(rows.where("not is_duplicate and vector is not null").select("pos", "vector"), threshold, probes, told)
    names = rows.select(F.col("pos").cast("long").alias("first"), F.col("id").alias("first_id"))
    out = rows.withColumn("pos", F.col("pos").cast("long")).join(by, "pos", "left").join(names, "first", "left")
    status = F.when(F.col("is_duplicate") | F.col("first").isNotNull(), "duplicate").otherwise("added")
    return out.select("id", status.alias("status"), F.coalesce("existing_id", "first_id").alias("existing_id"))


def render_results(found: DataFrame, drawers: DataFrame) -> DataFrame:
    """(query_id, text) of ranked results: place, similarity, snippet and file of each."""
    rows = found.join(drawers.select("id", "wing", "room", "content", "source_file"), "id")
    line = F.concat(
        F.lit("  ["), F.col("rank").cast("string"), F.lit("] "), or_default("wing", "?"), F.lit("/"), or_default("room", "?"), F.lit(" (sim="), F.col("similarity").cast("string"), F.lit(")\n      "),
        snippet(F.regexp_replace("content", "\n", " ")), F.when(or_default("source_file", "") != "", F.concat(F.lit("\n      src: "), base_name("source_file"))).otherwise(""),
    )
    lines = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return lines.select("query_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))
