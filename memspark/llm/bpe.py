"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut into pieces by the tokenizer's pattern; each piece is merged on its own. Leaf ``i`` of a piece's tree holds
the rank of the pair that starts at byte ``i``, every inner node the lower of its children; going down from the root, left
on equal ranks, finds the leftmost lowest pair. A merge changes at most three leaves (the merged token's, its left
neighbour's and the swallowed token's) and the nodes above them. Short pieces of a batch are merged side by side in numpy
arrays, one tree a row; long ones one after another, in arrays of 4-byte numbers.

A long text is taken `PIECES` pieces, or a million characters of them, at a time; pieces are merged side by side as many at a
time as `SIDE_BYTES` of trees allow, and the kept pieces are bounded by bytes. So beside a text and its ids a worker holds about
100 MB, whatever the text; a piece over `SIDE_BY_SIDE` bytes takes 30 bytes for each of its own.

Nulls and empty texts give no ids. A piece that is a whole token gives that token, as the usual library does. Of equal
ranks the leftmost pair is merged. Repeated rows give equal rows; an empty table gives an empty table; the input's own
columns stay, but for those of the result's names.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.batches import PART_CHARS, Memo, slices, unused

NONE = np.int32(2**31 - 1)
#: Pieces of at most so many bytes are merged side by side.
SIDE_BY_SIDE = 64
#: Pieces whose ids a worker keeps, beside those of its current batch, and about their bytes.
MEMO_PIECES, MEMO_BYTES = 150_000, 48 << 20
#: Pieces of one long text that are encoded at once, and their characters.
PIECES = 100_000
#: Bytes of the trees and arrays of pieces that are merged side by side: about `PER_BYTE` for each byte of their size.
SIDE_BYTES, PER_BYTE = 24 << 20, 56


def rank_file(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern(pattern: str | None = None) -> str:
    if pattern:
        return pattern
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(rank_file(path), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Tokens:
    """The bytes of each id: all that decoding needs."""

    def __init__(self, path: str | None = None):
        self.of = {rank: token for token, rank in read_ranks(path).items()}

    def decode(self, ids: bytes) -> bytes:
        numbers, token = np.frombuffer(ids, dtype="<u4"), self.of.__getitem__
        return b"".join(b"".join(map(token, numbers[at : at + PIECES].tolist())) for at in range(0, len(numbers), PIECES))


class Merges:
    """Ranks of a rank file, and every pair of tokens whose bytes together are a token."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import regex

        self.path, self.ranks = path, read_ranks(path)
        self.pairs = {
            (self.ranks[token[:i]], self.ranks[token[i:]]): rank
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        }
        keys = np.array([a << 32 | b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(self.pairs.values()), dtype=np.int32)[order]
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pattern = regex.compile(split_pattern(pattern))
        self.memo = Memo(self.encode_pieces, MEMO_PIECES, MEMO_BYTES)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where a pair isn't a token or a side is absent (-1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        n = len(piece)
        size = 1 << max(0, (n - 1).bit_length())
        start = self.of_byte[np.frombuffer(piece, dtype=np.uint8)]
        token = array("i", start.astype("i").tobytes())
        before, after = array("i", range(-1, n - 1)), array("i", range(1, n + 1))
        after[n - 1] = -1
        none = int(NONE)
        leaves = np.full(size, NONE, dtype="i")
        for at in range(0, n - 1, 1 << 20):
            to = min(at + (1 << 20), n - 1)
            leaves[at:to] = self.rank_of(start[at:to], start[at + 1 : to + 1])
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = array("i", np.concatenate([np.full(1, NONE, dtype="i"), *reversed(levels)]).tobytes())

        def put(i: int, rank: int) -> None:
            k = size + i
            tree[k] = rank
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    return
                tree[k] = low

        while (rank := tree[1]) != none:
            k = 1
            while k < size:
                k = 2 * k + (tree[2 * k] > tree[2 * k + 1])
            i = k - size
            j = after[i]
            token[i], token[j] = rank, -1
            after[i] = last = after[j]
            put(j, none)
            if last >= 0:
                before[last] = i
                put(i, self.pairs.get((rank, token[last]), none))
            else:
                put(i, none)
            if (first := before[i]) >= 0:
                put(first, self.pairs.get((token[first], rank), none))
        return [t for t in token if t >= 0]

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The ids of pieces of at most ``size`` bytes (a power of two), one tree a row, all merged in step."""
        m = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), dtype=np.uint8).reshape(m, size)
        cols = np.arange(size)
        live = cols < lengths[:, None]
        # One more column on the right stands for "no neighbour".
        token = np.full((m, size + 1), -1, dtype=np.int64)
        token[:, :size][live] = self.of_byte[raw[live]]
        after = np.broadcast_to(np.minimum(cols + 1, size), (m, size)).copy()
        after[cols == lengths[:, None] - 1] = size
        before = np.full((m, size + 1), size, dtype=np.int64)
        before[:, 1:size] = cols[:-1]
        tree = np.full((m, 2 * size), NONE, dtype=np.int32)
        tree[:, size : 2 * size - 1] = self.rank_of(token[:, : size - 1], token[:, 1:size])
        width = size
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            rank = tree[rows, 1].astype(np.int64)
            k = np.ones(len(rows), dtype=np.int64)
            for _ in range(size.bit_length() - 1):
                k = 2 * k + (tree[rows, 2 * k] > tree[rows, 2 * k + 1])
            i = k - size
            j = after[rows, i]
            last, first = after[rows, j], before[rows, i]
            token[rows, i], token[rows, j] = rank, -1
            after[rows, i] = last
            before[rows, last] = i
            token[rows, size] = -1
            leaf = np.stack([j, i, np.where(first < size, first, i)])
            new = np.stack([np.full(len(rows), NONE, dtype=np.int32), self.rank_of(rank, token[rows, last]), np.zeros(len(rows), dtype=np.int32)])
            new[2] = np.where(first < size, self.rank_of(token[rows, first], rank), new[1])
            node = leaf + size
            tree[rows, node] = new
            for _ in range(size.bit_length() - 1):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] != NONE]
        kept = token[:, :size] >= 0
        ids = token[:, :size][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        raw = [x.encode() for x in pieces]
        for at, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[at] = whole.to_bytes(4, "little")
            elif len(piece) > SIDE_BY_SIDE:
                out[at] = np.array(self.merge_one(piece), dtype="<u4").tobytes()
            else:
                groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(at)
        for size, members in groups.items():
            step = max(1, SIDE_BYTES // (PER_BYTE * size))
            for some in (members[k : k + step] for k in range(0, len(members), step)):
                for at, ids in zip(some, self.merge_many([raw[x] for x in some], size), strict=True):
                    out[at] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if sum(map(len, texts)) > 2 * PART_CHARS and len(texts) > 1:
            half = len(texts) // 2
            return self.encode(texts[:half]) + self.encode(texts[half:])
        get = self.memo.__getitem__
        if len(texts) == 1 and len(texts[0]) > PART_CHARS:
            ids = []
            for part in bounded_pieces(m[0] for m in self.pattern.finditer(texts[0])):
                self.memo.fill(set(part))
                ids.append(b"".join(map(get, part)))
            return [b"".join(ids)]
        pieces = [self.pattern.findall(x) for x in texts]
        self.memo.fill(set(chain.from_iterable(pieces)))
        return [b"".join(map(get, x)) for x in pieces]

    def decode(self, ids: bytes) -> bytes:
        return tokens(self.path).decode(ids)


def bounded_pieces(found: Iterator[str]) -> Iterator[list[str]]:
    """The pieces in lists of at most `PIECES` pieces and, but for the last of them, `PART_CHARS` characters."""
    held, chars = [], 0
    for piece in found:
        held.append(piece)
        chars += len(piece)
        if len(held) >= PIECES or chars >= PART_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


_loaded: dict[tuple, Merges] = {}


def merges(path: str | None = None, pattern: str | None = None) -> Merges:
    """The rank file's merges, loaded once in a Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Merges(path, pattern)
    return _loaded[path, pattern]


_tokens: dict[str | None, Tokens] = {}


def tokens(path: str | None = None) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def encode_ids(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The token ids of each text, little-endian unsigned 32-bit integers in a binary column."""

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = merges(path, pattern)
        # A slice's ids go back to the JVM before the next slice is encoded.
        for part in chain.from_iterable(map(slices, batches)):
            yield pa.array(bpe.encode(part), type=pa.binary())

    return encoded(text)


def decode_ids(ids: Column, path: str | None = None) -> Column:
    """The bytes that the ids stand for."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = tokens(path).decode
        for part in chain.from_iterable(map(slices, batches)):
            yield pa.array(list(map(decode, part)), type=pa.binary())

    return decoded(ids)


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``token_ids`` (binary, 4 bytes an id) and ``n_tokens``; columns of these names are replaced."""
    out = df.withColumn("token_ids", encode_ids(F.col(text), path, pattern))
    return out.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


def decode(df: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes of the text, whole."""
    return df.withColumn("decoded", decode_ids(F.col(ids), path))


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``token_ids``, ``n_tokens`` and ``decoded``, as `encode` and then `decode` make them, by one function: a slice's
    ids are decoded where they are made, instead of going through the JVM to a second Python worker."""

    @F.arrow_udf("struct<token_ids:binary,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe, decode = merges(path, pattern), tokens(path).decode
        for part in chain.from_iterable(map(slices, batches)):
            ids = bpe.encode(part)
            yield pa.StructArray.from_arrays([pa.array(ids, type=pa.binary()), pa.array(list(map(decode, ids)), type=pa.binary())], names=["token_ids", "decoded"])

    kept, name = [c for c in df.columns if c not in ("token_ids", "n_tokens", "decoded")], unused(df.columns, "__both")
    # A generator of one row: the function runs once, whatever reads its fields.
    out = df.select(*kept, F.explode(F.array(both(F.col(text)))).alias(name))
    return out.select(*kept, F.col(f"{name}.token_ids").alias("token_ids"), (F.octet_length(f"{name}.token_ids") / 4).cast("long").alias("n_tokens"), F.col(f"{name}.decoded").alias("decoded"))
