"""Nearest neighbours among vectors by an index of cells, without a vector in the driver but the index's bounded sample.

1. Cells: k-means centres of at most ``sample`` stored vectors, chosen by a hash of the id. Every stored row goes to its
   nearest centre's cell; a cell knows its number of rows and its largest angle to the centre.
2. A query visits cells: the ``probes`` nearest centres, or, for exact results, all cells that can hold a row as near as is
   asked for. No row of a cell is nearer to a query than the angle to the centre less the cell's largest angle.
3. Rows and queries meet by an equi-join on the cell. Of a cell over `STORED` rows or `ASKED` queries both sides are cut by a
   hash, and the parts of one side meet the parts of the other, so a group holds so many of each at most, however large a cell is;
   one matrix product compares them, and only the best rows of each query leave the group.

Vectors are unit vectors (or zero); rows without one aren't stored or found. Similarity is the cosine to three digits; of equal ones
the smallest id comes first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.plans.shared import materialize, release

#: Rows and queries of one group.
STORED, ASKED = 8_192, 1_024
CELLS, SAMPLE = 256, 20_000
#: What rounding to three digits, twice, and the angles' arithmetic can hide.
SLACK = 0.0015


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def first_k(values: np.ndarray, k: int) -> np.ndarray:
    """The places (rows, k) of each row's ``k`` largest values; of equal ones the first. Rows of fewer give all."""
    n = values.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), values.shape)
    bar = np.partition(values, n - k, axis=1)[:, n - k, None]
    above, same = values > bar, values == bar
    kept = above | (same & (same.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(kept)[1].reshape(len(values), k)


def fit_centres(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """The centres of at most ``cells`` cells, by spherical k-means over the sampled rows (id, vector); one cell for forty rows."""
    taken = rows.where("vector is not null").select("vector", F.xxhash64("id", F.lit(17)).alias("h")).orderBy("h", "vector").limit(sample).collect()
    x = np.array([r["vector"] for r in taken], dtype=np.float64)
    n = max(1, min(cells, len(x) // 40))
    if len(x) == 0:
        return np.zeros((1, 1))
    centres = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            mean = x[own == c].sum(axis=0)
            if (norm := np.linalg.norm(mean)) > 0:
                centres[c] = mean / norm
    return centres


class Index:
    """Stored rows (id, vector, cell) as a table, the centres, and of each cell the number of rows and the largest angle: numbers
    that depend on the cells alone. ``release`` deletes the table."""

    def __init__(self, rows: DataFrame, centres: np.ndarray | None = None, **how):
        rows = rows.where("vector is not null")
        self.centres = fit_centres(rows, **how) if centres is None else centres
        self.rows = materialize(rows.withColumn("cell", nearest_cell(F.col("vector"), self.centres)), "cells")
        self.measure()

    def measure(self) -> None:
        centres = self.centres
        angle = angle_to_own(F.col("vector"), F.col("cell"), centres)
        self.count, self.reach = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
        for r in self.rows.withColumn("angle", angle).groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect():
            self.count[r["cell"]], self.reach[r["cell"]] = r["n"], r["reach"]

    def release(self) -> None:
        release(self.rows)


def nearest_cell(vector: Column, centres: np.ndarray) -> Column:
    @F.arrow_udf("int")
    def cell(column: pa.Array) -> pa.Array:
        return pa.array((matrix(column) @ centres.T).argmax(axis=1).astype(np.int32)) if len(column) else pa.array([], type=pa.int32())

    return cell(vector)


def angle_to_own(vector: Column, cell: Column, centres: np.ndarray) -> Column:
    @F.arrow_udf("double")
    def angle(column: pa.Array, cells: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], type=pa.float64())
        own = centres[cells.to_numpy(zero_copy_only=False)]
        return pa.array(np.arccos(np.clip((matrix(column) * own).sum(axis=1), -1, 1)))

    return angle(vector, cell)


def best_possible(vectors: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each vector the largest similarity that a row of each cell can have."""
    angle = np.arccos(np.clip(vectors @ centres.T, -1, 1))
    return np.cos(np.maximum(0, angle - reach[None]))


def visits(vector: Column, index: Index, probes: int | None = None, least: Column | None = None) -> Column:
    """The cells that a query visits: its ``probes`` nearest ones, or else all that can hold a row of similarity ``least``."""
    centres, reach, count = index.centres, index.reach, index.count
    if not count.any():
        return F.array().cast("array<int>")

    @F.arrow_udf("array<int>")
    def nearest(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], type=pa.list_(pa.int32()))
        by = np.where(count[None] > 0, matrix(column) @ centres.T, -2)
        at = np.argsort(-by, axis=1, kind="stable")[:, :probes]
        return pa.array([row[count[row] > 0].astype(np.int32).tolist() for row in at], type=pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def possible(column: pa.Array, bar: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], type=pa.list_(pa.int32()))
        bars = pc.fill_null(bar, -2.0).to_numpy(zero_copy_only=False)
        can = (best_possible(matrix(column), centres, reach) >= bars[:, None] - SLACK) & (count[None] > 0)
        return pa.array([np.flatnonzero(row).astype(np.int32).tolist() for row in can], type=pa.list_(pa.int32()))

    return nearest(vector) if probes else possible(vector, F.lit(-2.0) if least is None else least)


def met(index: Index, asking: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on (stored, asking) tables of every cell, in groups of at most about `STORED` and `ASKED` rows. ``asking`` has a cell
    in each row and ``query_id``."""
    asked = np.zeros(len(index.count), dtype=np.int64)
    for r in asking.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row a cell
        asked[r["cell"]] = r["n"]
    stored_parts, asked_parts = -(-index.count // STORED), -(-asked // ASKED)
    of = lambda counts: F.get(F.lit(counts.tolist()), F.col("cell")).cast("int")

    def cut(rows: DataFrame, name: str, own: np.ndarray, other: np.ndarray, names: tuple[str, str]) -> DataFrame:
        part, every = F.pmod(F.xxhash64(name), of(own)).cast("int"), F.explode(F.sequence(F.lit(0), of(other) - 1))
        return rows.where((of(own) > 0) & (of(other) > 0)).select("*", part.alias(names[0]), every.alias(names[1]))

    left = cut(index.rows, "id", stored_parts, asked_parts, ("s", "a"))
    right = cut(asking, "query_id", asked_parts, stored_parts, ("a", "s"))
    return left.groupBy("cell", "s", "a").cogroup(right.groupBy("cell", "s", "a")).applyInArrow(work, schema)


def best_of(index: Index, asking: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, similarity): of the visited cells' rows the k nearest."""
    kinds = dict(index.rows.dtypes) | dict(asking.dtypes)

    def work(stored: pa.Table, some: pa.Table) -> pa.Table:
        names, ids = some.column("query_id"), stored.column("id")
        query, found, value = [], [], []
        if len(stored) and len(some):
            order = pc.sort_indices(ids)
            ids = ids.take(order)
            dots = np.round(matrix(some.column("vector")) @ matrix(stored.column("vector").take(order)).T, 3)
            at = first_k(dots, k)
            query, found = np.repeat(np.arange(len(some)), at.shape[1]), at.ravel()
            value = dots[query, found]
        kind = pa.schema([pa.field("query_id", names.type), pa.field("id", ids.type), pa.field("similarity", pa.float64())])
        take = lambda column, at: column.take(pa.array(np.asarray(at, dtype=np.int64)))
        return pa.table([take(names, query), take(ids, found), pa.array(np.asarray(value, dtype=np.float64))], schema=kind)

    made = met(index, asking, work, f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return made.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def nearest(index: Index, queries: DataFrame, k: int = 5, probes: int | None = 16) -> DataFrame:
    """(query_id, rank, id, similarity) of queries (query_id, vector). With ``probes`` None exact: the nearest cell gives each query
    a similarity that its k-th row has at least, and then all cells are visited that can hold a row as near."""
    queries = queries.where("vector is not null").select("query_id", "vector")
    first = queries.withColumn("cell", F.explode(visits(F.col("vector"), index, probes or 1)))
    found = best_of(index, first, k)
    if probes:
        return found
    found = materialize(found, "nearest")
    bar = found.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("bar"))
    rest = queries.join(bar, "query_id", "left").withColumn("cell", F.explode(visits(F.col("vector"), index, least=F.col("bar")))).drop("bar")
    out = materialize(best_of(index, rest, k), "nearest")
    release(found)
    return out


def least_near(index: Index, asking: DataFrame, threshold: float, probes: int | None = None) -> DataFrame:
    """(pos, first) of asking (pos, vector): the least ``pos`` of the stored rows (id is pos) before it that are near, of those that
    have one. Only the least one of each group leaves it, so pairs are never written."""
    cells = visits(F.col("vector"), index, probes, F.lit(float(threshold)))
    asking = asking.select(F.col("pos").alias("query_id"), "vector").withColumn("cell", F.explode(cells))

    def work(stored: pa.Table, some: pa.Table) -> pa.Table:
        if not len(stored) or not len(some):
            return pa.table({"pos": pa.array([], type=pa.int64()), "first": pa.array([], type=pa.int64())})
        own, pos = (x.column(c).to_numpy() for x, c in ((stored, "id"), (some, "query_id")))
        near = np.round(matrix(some.column("vector")) @ matrix(stored.column("vector")).T, 3) >= threshold
        near &= own[None] < pos[:, None]
        first = np.where(near, own[None], np.iinfo(np.int64).max).min(axis=1)
        has = near.any(axis=1)
        return pa.table({"pos": pos[has], "first": first[has]})

    return met(index, asking, work, "pos bigint, first bigint").groupBy("pos").agg(F.min("first").alias("first"))


def first_kept(rows: DataFrame, threshold: float, probes: int | None = None, told: Callable[[int, int, int], None] | None = None, **how) -> DataFrame:
    """(pos, first) of rows (pos, vector): what is left of them if, in the order of ``pos``, each is kept unless a kept one before it is
    near; ``first`` is the least kept one that is near, null for kept ones.

    A fixpoint: in each round all rows are kept that no open row before is near, and all open rows go that one of these is near. A
    group of near rows goes in the first round; there are as many rounds as the longest chain of rows, each near to the one
    before and open until that one is decided. ``told`` gets the round, the rows kept and those that went."""
    once = rows.select(F.col("pos").cast("long").alias("id"), "vector")
    index = Index(once, **how)
    every, centres = index.rows, index.centres
    open_, kept, n = every, None, 0
    made: list[DataFrame] = []
    while True:
        n += 1
        index.rows = open_
        index.measure()
        before = materialize(least_near(index, open_.select(F.col("id").alias("pos"), "vector"), threshold, probes), "before")
        new = materialize(open_.join(before.select(F.col("pos").alias("id")), "id", "left_anti"), "kept")
        made += [before, new]
        kept = new if kept is None else kept.unionByName(new)
        left = open_.join(before.select(F.col("pos").alias("id")), "id", "left_semi")
        index.rows = new
        index.measure()
        gone = least_near(index, left.select(F.col("id").alias("pos"), "vector"), threshold, probes)
        rest = materialize(left.join(gone.select(F.col("pos").alias("id")), "id", "left_anti"), "open")
        made.append(rest)
        if told:
            told(n, new.count(), left.count() - rest.count())
        open_ = rest
        if not open_.limit(1).count():
            break
    index.rows, index.centres = kept, centres
    index.measure()
    went = every.join(kept.select("id"), "id", "left_anti").select(F.col("id").alias("pos"), "vector")
    first = materialize(least_near(index, went, threshold, probes), "first")
    out = materialize(every.select(F.col("id").alias("pos")).join(first, "pos", "left"), "decided")
    for table in (every, first, *made):
        release(table)
    return out


def cosine(a: Column, b: Column) -> Column:
    """The similarity of two vectors of a row, to three digits, over Arrow batches."""

    @F.arrow_udf("double")
    def dots(left: pa.Array, right: pa.Array) -> pa.Array:
        if not len(left):
            return pa.array([], type=pa.float64())
        return pa.array(np.round((matrix(left) * matrix(right)).sum(axis=1), 3))

    return dots(a, b)


def own_nearest(haystacks: DataFrame, queries: DataFrame, k: int = 5, parts: int = 64) -> DataFrame:
    """(query_id, rank, id, similarity): of each query's own rows (query_id, id, vector) the ``k`` nearest. Rows and queries meet by
    the query's id, nothing is broadcast; the best of each of ``parts`` parts of a haystack come first, then those of all, so one
    haystack with most of the rows isn't one task's."""
    asked = queries.where("vector is not null").select("query_id", F.col("vector").alias("asked"))
    rows = haystacks.where("vector is not null").join(asked, "query_id")
    rows = rows.select("query_id", "id", cosine(F.col("vector"), F.col("asked")).alias("similarity"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    order = (F.desc("similarity"), F.asc("id"))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    every = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return every.where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
