"""Token ids packed into rows of one length by best fit decreasing, as binary matrices.

A task encodes its documents as they come, holds at most `BUFFER` tokens, packs those and writes their rows: nothing is
shuffled, and a lost task repeats its own part alone. Within a buffer, segments come by falling length; a segment tree over
the capacities 0 to the row's length, whose leaves count the open rows with so much room, gives the least room that is
enough. Rows with over a hundredth of room stay open: their segments go on to the next buffer, unless they are over half of
this one. Documents longer than a row are cut into pieces of its length, the rest is a piece too: no token is lost.

Every row of the result is one row of the matrix: ids, padded with `pad`; cumulative segment lengths; positions, which start
again at 0 with each segment. A null or empty text has no tokens; it stands as an empty segment, so each document has at
least one. Repeated rows are packed each for itself. Ids are unsigned 16-bit integers if the vocabulary allows, else 32-bit.
An empty table gives no rows. Of the input only the id, in its own type, and the tokens come back. The padding's id may be a
token's as well: `cu_seqlens` tells where a row ends.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.batches import ID_TYPES, Memo, id_type, slices
from memspark.llm.token_counts import Counter, bounded, counter

CAPACITY = 4096
#: Tokens that a task holds before it packs them.
BUFFER = 4 << 20


class RoomTree:
    """How many open rows have each amount of room; finds the least room of at least n."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int = 1) -> None:
        k = self.size + room
        while k:
            self.count[k] += n
            k >>= 1

    def least(self, n: int) -> int | None:
        k = self.size + n
        if self.count[k]:
            return n
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k + (not self.count[2 * k])
                return k - self.size
            k >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The segments of each row. Segments of one length keep their order; of rows with equal room, the newest takes."""
    rows: list[list[int]] = []
    open_rows: list[list[int]] = [[] for _ in range(capacity + 1)]
    tree = RoomTree(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.least(lengths[i])
        if room is None:
            at, room = len(rows), capacity
            rows.append([])
        else:
            at = open_rows[room].pop()
            tree.add(room, -1)
        rows[at].append(i)
        open_rows[room - lengths[i]].append(at)
        tree.add(room - lengths[i])
    return rows


class Encoder:
    """Ids by a sentencepiece model, a part of a text at a time (see `token_counts`)."""

    def __init__(self, path: str | None = None):
        self.counter: Counter = counter(path)
        library = self.counter.library
        self.kind = np.dtype("<u2" if library.get_piece_size() <= 1 << 16 else "<u4")
        # Pieces are many and short: an array made of each takes three times as long.
        sign = "H" if self.kind.itemsize == 2 else "I"
        pack = lambda ids: struct.pack(f"<{len(ids)}{sign}", *ids)
        self.whole = lambda texts: [pack(x) for part in slices(pa.array(texts, type=pa.string()), 1 << 20) for x in library.encode(part, num_threads=1)]
        blank = pack(library.encode("a ")[len(library.encode("a")) :])
        self.memo = Memo(lambda parts: [ids if x else blank for x, ids in zip(parts, self.whole(parts), strict=True)], 300_000)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.counter.safe:
            return [np.frombuffer(x, dtype=self.kind) for x in self.whole(texts)]
        out, get = [[] for _ in texts], self.memo.__getitem__
        for some in bounded(self.counter.groups(texts)):
            self.memo.fill(set().union(*(x for _, x in some)))
            for i, parts in some:
                out[i].append(b"".join(map(get, parts)))
        return [np.frombuffer(b"".join(x), dtype=self.kind) for x in out]


SCHEMA = "pack_id bigint, n_tokens int, doc_ids array<{id}>, starts array<bigint>, cu_seqlens array<int>, input_ids binary, position_ids binary"
Segment = tuple[object, int, np.ndarray]


def segments_of(doc: object, ids: np.ndarray, capacity: int) -> list[Segment]:
    """(document, first token, ids) of each piece of a document."""
    return [(doc, start, ids[start : start + capacity]) for start in range(0, max(1, len(ids)), capacity)]


def full_and_open(segments: list[Segment], capacity: int) -> tuple[list[list[Segment]], list[Segment]]:
    """The rows that are full but for a hundredth, and the segments of the others. Of many open rows none stays open."""
    rows = [[segments[i] for i in row] for row in best_fit_decreasing([len(x[2]) for x in segments], capacity)]
    used = [sum(len(x[2]) for x in row) for row in rows]
    is_full = [100 * n >= 99 * capacity for n in used]
    if 2 * sum(n for n, full in zip(used, is_full, strict=True) if not full) > sum(used):
        return rows, []
    left = [x for row, full in zip(rows, is_full, strict=True) if not full for x in row]
    return [row for row, full in zip(rows, is_full, strict=True) if full], left


def packed_rows(rows: list[list[Segment]], capacity: int, pad: int, first_id: int) -> Iterator[dict]:
    ramp = np.arange(capacity, dtype="<u2" if capacity <= 1 << 16 else "<u4")
    for n, parts in enumerate(rows):
        ends = np.cumsum([0] + [len(x[2]) for x in parts])
        used = int(ends[-1])
        ids = np.full(capacity, pad, dtype=parts[0][2].dtype)
        positions = np.zeros(capacity, dtype=ramp.dtype)
        for (_, _, tokens), a, b in zip(parts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            ids[a:b] = tokens
            positions[a:b] = ramp[: b - a]
        yield {"pack_id": first_id + n, "n_tokens": used, "doc_ids": [x[0] for x in parts], "starts": [x[1] for x in parts], "cu_seqlens": ends.tolist(), "input_ids": ids.tobytes(), "position_ids": positions.tobytes()}


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, buffer: int = BUFFER, pad: int = 0, encoder: Callable[[], object] | None = None, path: str | None = None) -> DataFrame:
    """The packed rows (`SCHEMA`). ``starts`` is each segment's first token in its document. ``encoder`` makes, in a task, what
    has ``encode(texts)`` giving arrays of ids."""
    kind = id_type(dict(df.dtypes)[doc_id])
    schema = pa.schema([("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(ID_TYPES[kind])), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (encoder() if encoder else Encoder(path)).encode
        next_id = TaskContext.get().partitionId() << 33
        held: list[Segment] = []
        tokens = 0

        def written(rows: list[list[Segment]]) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            step = max(1, (1 << 20) // capacity)
            for at in range(0, len(rows), step):
                out = list(packed_rows(rows[at : at + step], capacity, pad, next_id))
                next_id += len(out)
                yield pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for part in slices(batch.column(1)):
                for made in encode(part):
                    held += segments_of(ids[at], made, capacity)
                    tokens += len(made)
                    at += 1
                if tokens >= buffer:
                    rows, held = full_and_open(held, capacity)
                    # A copy, so that what stays doesn't keep the whole documents' ids.
                    held = [(doc, start, x.copy()) for doc, start, x in held]
                    tokens = sum(len(x[2]) for x in held)
                    yield from written(rows)
        yield from written([[held[i] for i in row] for row in best_fit_decreasing([len(x[2]) for x in held], capacity)])

    return df.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, SCHEMA.format(id=kind))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: rows, tokens, and the share of the rows' places that hold a token."""
    return packed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), (F.sum("n_tokens") / (F.count("*") * capacity)).alias("fill"))


def write_packs(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet files of binary rows, committed by Spark, so that a repeated task leaves no second copy."""
    packed.write.parquet(path)
