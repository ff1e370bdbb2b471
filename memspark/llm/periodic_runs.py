"""Periodic runs of words: stretches that repeat with a smallest period, found as maximal pairs in an LCP-interval tree.

A run of period q that begins at s and has m words is the maximal pair (s, s + q): the texts from both places share m - q
words, and neither the words before them nor those after agree. So nothing is extended:

1. A pair counts if it shares at least as many words as lie between its places, and run and pair together have ``least``
   words; so it shares ``least / 2`` words or more. Only places whose gram of so many words stands in the text again (by a
   hash, in one sort over a slice of texts) can be in pairs; most texts have none and are done.
2. The suffixes of the other texts are ranked by prefix doubling, in which only places that aren't told apart yet take part;
   the suffixes of the repeated places, in this order, get their common lengths with the one before (`common_lengths`).
3. The LCP intervals are gone through from the bottom. Each holds its places, sorted, and a sorted list of them for each word
   before. Where two intervals meet, each place of the smaller looks into the larger for places as near as the interval's
   length whose word before is another: the two lists agree up to each such place, so it's found by halving, and places with
   the same word before cost nothing however many there are.
4. Pairs with one beginning and one end are one run, seen at multiples of its period; the least distance is the period.

Work is n log n in a text's words and its runs. A slice of texts (4 MB) is worked on at once; a longer text is one of its own:
its words are split a part at a time, and only their numbers stand in memory (about 100 bytes a word in repeated places).

A null text counts as empty; a text without words has no runs and collapses to an empty one. Ties don't occur: two runs of one
beginning differ in their period. Repeated rows get equal results; an empty table gives an empty table; the input's own columns
stay, but for those of the result's names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.batches import PART_CHARS, slices, unused

#: Words of the shortest run.
LEAST = 12
_BLANK = re.compile(rb"[ \t-\r]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_parts(raw: bytes, most: int = PART_CHARS) -> Iterator[list[bytes]]:
    """The words of a text, a part of about ``most`` bytes at a time. Blanks are 0x20 and 0x09 to 0x0D."""
    at = 0
    while len(raw) - at > most and (found := _BLANK.search(raw, at + most)):
        yield raw[at : found.start()].split()
        at = found.end()
    yield (raw[at:] if at else raw).split()


def repeated_places(ids: np.ndarray, text: np.ndarray, ends: np.ndarray, gram: int) -> np.ndarray:
    """The places, in order, whose gram of words stands in the same text again."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    key = text[:n].astype(np.uint64)
    for t in range(gram):
        key = key * _FACTOR + ids[t : n + t].astype(np.uint64)
        key ^= key >> np.uint64(29)
    at = np.flatnonzero(np.arange(n) + gram <= ends[:n])
    order = np.argsort(key[at])
    same = key[at[order[1:]]] == key[at[order[:-1]]]
    again = np.zeros(len(at), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return at[again]


def suffix_ranks(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rank of each place's suffix among all; equal words of different texts have different ``ids``."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], ids[order[1:]] != ids[order[:-1]]]))
    sizes = np.diff(np.append(begins, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(begins, sizes)
    live, k = order[np.repeat(sizes > 1, sizes)], 1
    while len(live):
        after = live + k
        second = np.where(after < ends[live], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[live]))
        live, second = live[order], second[order]
        first, place = rank[live], np.arange(len(live))
        group = np.concatenate([[True], first[1:] != first[:-1]])
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        rank[live] = first + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        live = live[~(part & np.append(part[1:], True))]
        k *= 2
    return rank


def common_lengths(ids: list[int], places: list[int], order: list[int], ends: dict[int, int], gram: int) -> dict[int, int]:
    """For each place the words that its suffix shares with that of the place before it in ``order``; a place's length is
    at least that of the place one word before it, less one. ``ends`` are the texts' ends by a place."""
    before = dict(zip(order[1:], order, strict=False))
    out, held, last = {}, 0, -2
    for i in places:
        j = before.get(i, -1)
        h = held - 1 if i == last + 1 and held > gram else 0
        if j >= 0:
            most = ends[i] - max(i, j) if ends[i] == ends[j] else 0
            while h < most and ids[i + h] == ids[j + h]:
                h += 1
        else:
            h = 0
        out[i] = held = h
        last = i
    return out


class Places:
    """The places of an LCP interval: all, sorted, and those of each word before, sorted."""

    __slots__ = ("all", "by")

    def __init__(self, place: int, before: int):
        self.all, self.by = [place], {before: [place]}

    def others(self, place: int, before: int, reach: int) -> Iterator[int]:
        """The places at most ``reach`` from this one whose word before is another."""
        every, own = self.all, self.by.get(before, ())
        lo, hi = bisect_left(every, place - reach), bisect_right(every, place + reach)
        if lo == hi:
            return
        at, to = bisect_left(own, place - reach), bisect_right(own, place + reach)
        while hi - lo > to - at:
            # `own` is a part of `every`; the two agree up to the first place that isn't in it.
            low, high = 0, hi - lo
            while low < high:
                mid = (low + high) // 2
                if at + mid >= to or every[lo + mid] != own[at + mid]:
                    high = mid
                else:
                    low = mid + 1
            yield every[lo + low]
            at, lo = at + low, lo + low + 1

    def add(self, other: Places) -> None:
        if len(other.all) < 20:
            for x in other.all:
                insort(self.all, x)
            for before, some in other.by.items():
                mine = self.by.setdefault(before, [])
                for x in some:
                    insort(mine, x)
            return
        self.all += other.all
        self.all.sort()
        for before, some in other.by.items():
            mine = self.by.setdefault(before, [])
            mine += some
            mine.sort()


def maximal_pairs(order: list[int], lengths: dict[int, int], before: list[int], gram: int) -> Iterator[tuple[int, int, int]]:
    """(place, other place, words shared) of the maximal pairs that share ``gram`` words or more and lie no further apart than
    they share words."""
    open_: list[tuple[int, Places]] = []  # intervals from the outermost, each with what its children so far hold

    def joined(left: Places, right: Places, length: int) -> Iterator[tuple[int, int, int]]:
        small, large = (left, right) if len(left.all) < len(right.all) else (right, left)
        for word, some in small.by.items():
            for i in some:
                for j in large.others(i, word, length):
                    yield min(i, j), max(i, j), length
        large.add(small)
        held.append(large)

    held: list[Places] = []
    now = None
    for place in [*order, -1]:
        shared = lengths[place] if place >= 0 and now is not None else 0
        while open_ and open_[-1][0] >= max(shared, gram):
            length, left = open_.pop()
            yield from joined(left, now, length)
            now = held.pop()
            if length == shared:
                break
        if shared >= gram:
            open_.append((shared, now))
        now = Places(place, before[place]) if place >= 0 else None


def runs_of(texts: list[bytes], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period."""
    gram = max(1, (least + 1) // 2)
    number: dict[bytes, int] = defaultdict(count().__next__)
    parts, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for t, raw in enumerate(texts):
        for words in word_parts(raw):
            parts.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
            sizes[t] += len(words)
    ids = np.concatenate([np.zeros(0, dtype=np.int64), *parts])
    n_words = len(number)
    del parts, number
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    places = repeated_places(ids, text, ends[text], gram)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(places):
        return out
    # From here only the texts with such places, laid one after another anew.
    with_some = np.zeros(len(texts), dtype=bool)
    with_some[text[places]] = True
    kept = with_some[text]
    places = (np.cumsum(kept) - 1)[places]
    ids, text, sizes = ids[kept] + text[kept] * n_words, text[kept], np.where(with_some, sizes, 0)
    ends = np.cumsum(sizes)
    begins, end_of = ends - sizes, ends[text]
    order = places[np.argsort(suffix_ranks(ids, end_of)[places])]
    before = np.concatenate([[-1], ids[:-1]])
    before[begins[with_some]] = -1
    at, numbers = places.tolist(), ids.tolist()
    in_order = order.tolist()
    lengths = common_lengths(numbers, at, in_order, dict(zip(at, end_of[places].tolist(), strict=True)), gram)
    found: dict[tuple[int, int], int] = {}
    for i, j, shared in maximal_pairs(in_order, lengths, before.tolist(), gram):
        period = j - i
        if shared + period >= least:
            key = (i, shared + period)
            found[key] = min(period, found.get(key, period))
    for (start, length), period in found.items():
        out[t := int(text[start])].append((start - int(begins[t]), length, period))
    for some in out:
        some.sort(key=lambda x: (x[0], x[2]))
    return out


def collapse(raw: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The text's words joined by one blank, without those that stand in a run after its first period."""
    if not runs:
        return b" ".join(b" ".join(x) for x in word_parts(raw) if x)
    last = max(start + length for start, length, _ in runs)
    turns = np.zeros(last + 1, dtype=np.int64)
    for start, length, period in runs:
        turns[start + period] += 1
        turns[start + length] -= 1
    stays, out, at = np.cumsum(turns) == 0, [], 0
    for words in word_parts(raw):
        some = stays[at : at + len(words)]
        kept = list(compress(words, some.tolist())) + words[len(some) :]
        if kept:
            out.append(b" ".join(kept))
        at += len(words)
    return b" ".join(out)


def found_runs(text: Column, least: int) -> Column:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @F.arrow_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:binary>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                runs = runs_of(part, least)
                short = pa.array(list(map(collapse, part, runs)), type=pa.binary())
                listed = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in some] for some in runs], type=kind)
                yield pa.StructArray.from_arrays([listed, short], names=["runs", "collapsed"])

    return found(F.coalesce(text, F.lit("")).cast("binary"))


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with ``runs`` (start, length and period in words, by start and period; of ``least`` words and two periods or more)
    and ``collapsed``, the text with one period of each run; columns of these names are replaced."""
    kept, name = [c for c in df.columns if c not in ("runs", "collapsed")], unused(df.columns, "__found")
    out = df.select(*kept, F.explode(F.array(found_runs(F.col(text), least))).alias(name))
    return out.select(*kept, F.col(f"{name}.runs").alias("runs"), F.col(f"{name}.collapsed").cast("string").alias("collapsed"))
