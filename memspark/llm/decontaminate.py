"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of 13 words of every benchmark item (a shorter item is one window). For the patterns of one
length, the shift table says how far a block of two words that was just read lets the search skip: to the nearest place
where the block stands in a pattern, or past it if it stands in none. It is a table of bytes at the hash of the block; of
blocks with one hash the least shift holds. Where the shift is 0, the block is looked up among the patterns' last blocks;
those of its bucket that begin with the window's first block are tested, and comparing all words confirms them.

Words are numbers here and a pattern is a place in the items' numbers, so an index takes some 30 bytes a pattern beside its
vocabulary, in each Python worker.

The benchmark is the stated query set: it goes to the tasks in blocks of at most `BLOCK_BYTES` (one longer item is a block of
its own), each a broadcast of its own, and every document is searched for every block. Documents are never shuffled for one
block. Of several, one block after another is read, broadcast, searched for and its hits written; these come back to the
documents by a hash of the text.

Null, empty and wordless texts have no words and no hits; an item without words has no window; repeated items and repeated
rows each count as themselves; an item without an id counts, as null at the end of the ids; the longest text is searched
whole. Empty tables of documents or items are allowed. The input's own columns stay, but for those of the result's names.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.batches import ID_TYPES, id_type, slices, unused
from memspark.llm.words import alphanumeric_words
from memspark.plans.shared import materialize, release

WINDOW = 13
#: Bytes of benchmark text in a broadcast block.
BLOCK_BYTES = 8 << 20
#: An odd factor that mixes a block's number before its upper bits are taken.
MIX = 0x9E3779B97F4A7C15


class Table:
    """The patterns of ``m`` words: shifts by hashed block, and places of patterns in order of their last and first blocks."""

    def __init__(self, m: int, starts: np.ndarray, words: np.ndarray, count: int):
        self.m, self.block, self.count = m, min(2, m), count
        first = self.keys(words, starts)
        last = self.keys(words, starts + m - self.block)
        order = np.lexsort((first, last))
        self.first, self.last, self.starts = (array("q", x[order].astype("<i8").tobytes()) for x in (first, last, starts))
        bits = max(10, int(8 * len(starts)).bit_length())
        self.down = 64 - bits
        self.shift = bytearray([m - self.block + 1]) * (1 << bits)
        table = np.frombuffer(self.shift, dtype=np.uint8)
        for end in range(self.block, m + 1):
            at = ((self.keys(words, starts + end - self.block).astype(np.uint64) * np.uint64(MIX)) >> np.uint64(self.down)).astype(np.int64)
            np.minimum.at(table, at, np.uint8(m - end))

    def keys(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of the block at each place."""
        return words[at].astype(np.int64) * self.count + words[at + 1] if self.block == 2 else words[at].astype(np.int64)

    def search(self, text: list[int], words: array) -> Iterator[tuple[int, int]]:
        """(first word, place of the pattern) of every occurrence; -1 is a word that no item has."""
        m, block, count, shift, down, last, first = self.m, self.block, self.count, self.shift, self.down, self.last, self.first
        n, at, skip = len(text), m, m - block + 1
        while at <= n:
            key = text[at - 1]
            if block == 2:
                before = text[at - 2]
                key = before * count + key if key >= 0 <= before else -1
            if key < 0:
                at += skip
                continue
            far = shift[(key * MIX & 0xFFFFFFFFFFFFFFFF) >> down]
            if far:
                at += far
                continue
            lo = bisect_left(last, key)
            if lo < len(last) and last[lo] == key:
                hi, start = bisect_right(last, key, lo), at - m
                begin = text[start] * count + text[start + 1] if block == 2 else text[start]
                window = array("i", text[start:at])
                for k in range(bisect_left(first, begin, lo, hi), bisect_right(first, begin, lo, hi)):
                    place = self.starts[k]
                    if words[place : place + m] == window:
                        yield start, place
            at += 1


class WuManber:
    """The windows of some items; an item is what it is called and its text."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        self.size, self.number = size, {}
        self.words, self.names = array("i"), []
        ends = array("q")
        for name, text in items:
            own = alphanumeric_words(text)
            if own:
                self.words.extend(self.number.setdefault(w, len(self.number)) for w in own)
                ends.append(len(self.words))
                self.names.append(name)
        stops = np.array(ends, dtype=np.int64)
        self.begins = array("q", (begins := np.concatenate([[0], stops[:-1]]) if len(stops) else stops).astype("<i8").tobytes())
        words = np.array(self.words, dtype=np.int32)
        lengths = np.minimum(stops - begins, size)
        self.tables = []
        for m in np.unique(lengths).tolist():
            own = lengths == m
            counts = (stops - begins)[own] - m + 1
            starts = np.repeat(begins[own], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            self.tables.append(Table(m, starts, words, max(1, len(self.number))))

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(words, (first word, words) of every occurrence, names of the items)."""
        words, get = alphanumeric_words(text), self.number.get
        found, items = [], set()
        if self.tables and len(words) >= self.tables[0].m:
            text_numbers = [get(w, -1) for w in words]
            for table in self.tables:
                for start, place in table.search(text_numbers, self.words):
                    found.append((start, table.m))
                    items.add(self.names[bisect_right(self.begins, place) - 1])
        return len(words), sorted(set(found)), items


def joined(found: list[tuple[int, int]]) -> list[dict]:
    """Sorted occurrences as spans; those that touch are one."""
    spans: list[dict] = []
    for start, n in found:
        if spans and start <= spans[-1]["start"] + spans[-1]["n"]:
            spans[-1]["n"] = max(spans[-1]["n"], start + n - spans[-1]["start"])
        else:
            spans.append({"start": start, "n": n})
    return spans


#: The index of the block that this worker searched last, by the name of its search.
_built: dict[str, WuManber] = {}


def index_of(name: str, shared, size: int) -> WuManber:
    """A block's index, built once in a worker, not in each of its tasks; only one is held."""
    if name not in _built:
        _built.clear()
        _built[name] = WuManber(shared.value, size)
    return _built[name]


def search_block(text: Column, shared, size: int, kind: str) -> Column:
    """shared: a broadcast list of (item id, text). (n_words, spans, items) of each text."""
    name = uuid.uuid4().hex

    @F.arrow_udf(f"struct<n_words:bigint,spans:array<struct<start:bigint,n:bigint>>,items:array<{kind}>>")
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = index_of(name, shared, size)
        row = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))), ("items", pa.list_(ID_TYPES[kind]))])
        for batch in batches:
            out = []
            for x in (x for part in slices(batch) for x in part):
                n, found, items = index.search(x)
                out.append({"n_words": n, "spans": joined(found), "items": sorted(items, key=lambda i: (i is None, i))})
            yield pa.array(out, type=row)

    return searched(text)


def merged(spans: Column) -> Column:
    """Sorted spans of several blocks, those that touch as one."""
    kind = "array<struct<start:bigint,n:bigint>>"

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        end = last["start"] + last["n"]
        grown = F.struct(last["start"].alias("start"), (F.greatest(end, x["start"] + x["n"]) - last["start"]).alias("n"))
        return F.when(end >= x["start"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(x))).cast(kind)

    return F.aggregate(spans, F.lit([]).cast(kind), step)


def blocks_of(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The items (item, body) with the block that each is in, by the order of a hash, and the number of blocks. The benchmark
    is numbered by 1,024 groups, so that no task sorts it all."""
    rows = items.withColumns({"group": F.pmod(F.xxhash64("item", "body"), F.lit(1024)), "size": F.octet_length("body").cast("long")})
    upto = lambda *by: Window.partitionBy(*by)
    sizes = rows.groupBy("group").agg(F.sum("size").alias("all"))
    total = sizes.agg(F.sum("all").alias("b")).first()["b"] or 0
    if total <= most:
        return items.withColumn("block", F.lit(0)), 1
    # At most 1,024 rows.
    sizes = sizes.withColumn("before", F.sum("all").over(upto().orderBy("group")) - F.col("all"))
    own = F.sum("size").over(upto("group").orderBy("item", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = rows.withColumn("own", own).join(F.broadcast(sizes.drop("all")), "group")
    # Items that begin in one stretch of half a block end within the next one, if they are no longer than it.
    half = max(1, most // 2)
    return placed.select("item", "body", F.floor((F.col("before") + F.col("own")) / half).cast("int").alias("block")), -(-total // half)


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with ``n_words``, ``n_hit`` (words inside an occurrence), ``hit_spans`` (word spans), ``item_ids`` (items with
    occurrences, sorted, in their own type if that is text or an integer, else as text) and ``contaminated``
    (``n_hit > 0 and share * n_hit >= n_words``); such columns are replaced."""
    spark = df.sparkSession
    kind = id_type(dict(benchmark.dtypes)[item_id])
    items = benchmark.select(F.col(item_id).cast(kind).alias("item"), F.coalesce(item_text, F.lit("")).alias("body"))
    numbered, n_blocks = blocks_of(items, block_bytes)
    taken = lambda i: spark.sparkContext.broadcast([(r["item"], r["body"]) for r in numbered.where(F.col("block") == i).toLocalIterator()])
    results = ("n_words", "hit_spans", "item_ids", "n_hit", "contaminated")
    kept = [c for c in df.columns if c not in results]
    one, none, key, some = (unused(df.columns, x) for x in ("__found", "__none", "__text", "__hits"))
    if n_blocks == 1:
        # A generator of one row: the function runs once, whatever reads its fields.
        found = df.select(*kept, F.explode(F.array(search_block(F.col(text), taken(0), window, kind))).alias(one))
    else:
        hits, numbered = None, materialize(numbered, "benchmark")
        of = F.sha2(F.coalesce(text, F.lit("")), 256).alias(key)
        for i in range(n_blocks):
            block = taken(i)
            rows = df.select(of, F.explode(F.array(search_block(F.col(text), block, window, kind))).alias("x")).where(F.size("x.spans") > 0)
            part = materialize(rows.groupBy(key).agg(F.first("x").alias("x")), "hits")
            block.destroy()
            hits = part if hits is None else hits.unionByName(part)
        release(numbered)
        ids = F.array_distinct(F.flatten(F.collect_list("x.items")))
        hits = hits.groupBy(key).agg(merged(F.array_sort(F.flatten(F.collect_list("x.spans")))).alias("spans"), F.array_sort(ids).alias("items"))
        hits = hits.select(key, F.struct("spans", "items").alias(some))
        empty = search_block(F.col(text), spark.sparkContext.broadcast([]), window, kind)
        rows = df.select(*kept, of, F.explode(F.array(empty)).alias(none)).join(hits, key, "left")
        spans, ids = (F.coalesce(F.col(f"{some}.{c}"), F.col(f"{none}.{c}")).alias(c) for c in ("spans", "items"))
        found = rows.select(*kept, F.struct(F.col(f"{none}.n_words").alias("n_words"), spans, ids).alias(one))
    n_hit = F.aggregate(f"{one}.spans", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = found.select(*kept, F.col(f"{one}.n_words").alias("n_words"), F.col(f"{one}.spans").alias("hit_spans"), F.col(f"{one}.items").alias("item_ids"), n_hit.alias("n_hit"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
