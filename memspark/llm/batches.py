"""Helpers of the Arrow functions: slices of bounded bytes, and bounded memos of what a worker has worked out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that an Arrow function works on at once.
SLICE_BYTES = 4 << 20
#: Characters of a long text that are split into words or pieces at once.
PART_CHARS = 1 << 20
_SPLIT = re.compile("(?<! ) ")
#: Arrow types of ids that keep their type; others are passed on as text.
ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}


def slices(batch: pa.Array, most: int = SLICE_BYTES) -> Iterator[list]:
    """The texts (or bytes) of a batch, null ones empty, in consecutive slices of at most ``most`` UTF-8 bytes; one longer
    text is a slice of its own. Only one slice at a time stands in memory as Python objects."""
    empty = b"" if pa.types.is_binary(batch.type) or pa.types.is_large_binary(batch.type) else ""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(batch)
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield [x or empty for x in batch.slice(at, to - at).to_pylist()]
        at = to


def blank_parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """A text cut at first blanks of runs of blanks, which are left out, into parts of about ``most`` characters."""
    at = 0
    while len(text) - at > most:
        found = _SPLIT.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def unused(columns: list[str], name: str) -> str:
    """The name, made longer until none of the columns has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def id_type(kind: str) -> str:
    """The type in which ids of a column of this type are passed on."""
    return kind if kind in ID_TYPES else "string"


def entry_bytes(key: str | bytes, value: bytes) -> int:
    """About what an entry takes: the objects' own bytes, their headers and the dict's place."""
    return len(key) + len(value) + 200


class Memo(dict):
    """A dict for pure results of at most ``most`` entries, and about ``most_bytes`` where given, over what the current batch needs."""

    def __init__(self, work: Callable[[list], list], most: int = 500_000, most_bytes: int | None = None):
        super().__init__()
        self.work, self.most, self.most_bytes, self.bytes = work, most, most_bytes, 0

    def fill(self, keys: set) -> None:
        missing = [k for k in keys if k not in self]
        if len(self) + len(missing) > self.most or (self.most_bytes and self.bytes > self.most_bytes):
            held = {k: self[k] for k in keys if k in self}
            self.clear()
            self.update(held)
            self.bytes = sum(map(entry_bytes, held, held.values())) if self.most_bytes else 0
        if missing:
            made = self.work(missing)
            self.update(zip(missing, made, strict=True))
            if self.most_bytes:
                self.bytes += sum(map(entry_bytes, missing, made))
