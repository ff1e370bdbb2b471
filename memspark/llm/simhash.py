"""SimHash near-duplicates: fingerprints of word shingles, bit-sliced comparison, connected components.

1. A fingerprint bit is 1 if it is set in over half of the XXH64 values of a text's shingles.
2. Equal fingerprints become one row with their smallest id, so that copies cost nothing further on.
3. The 64 bits are cut into `PARTS` parts. Two fingerprints within the radius agree in `PARTS - radius` of them, so each
   choice of so many parts is a key; candidates are fingerprints that share a key. A key that more than `BLOCK` share is cut
   again in the same way by the 20 to 22 bits that it leaves open: each of its fingerprints gets 15 further keys, which leave
   at most 8 bits open, so at most 2^8 fingerprints share one, whatever the input. Work stays linear without a cap.
4. Fingerprints are laid down as bit planes: plane b holds bit b of many of them, 64 in a word, those of one key side by
   side. Comparing the planes with themselves moved on by s lanes compares every fingerprint with the s-th one after it, of
   all keys at once: the differing bits go into saturating carry-save counters, and a block of 64 lanes is given up as soon
   as every pair in it is past the radius. A pair is given by the first key that it shares only. A fingerprint has at most
   2,080 others within radius 2, so links grow with the number of fingerprints.
5. Components by labels: each round takes the least label among the neighbours, hooks it to the label's own row and
   follows labels of labels. Rounds end when nothing changes. Each round's labels are a table in the shared folder.

A null text counts as empty; a text without words has fingerprint zero and links like any other; a text with fewer words
than a shingle is one shingle. Repeated ids are one document with several fingerprints; the rows stay. An empty table gives
an empty table. Of the input's columns only the id comes back. The two tables that the result is read from stay in the shared
folder until it is emptied.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.batches import slices, unused
from memspark.llm.words import words
from memspark.plans.shared import materialize, release

PARTS = 6
#: A key with more fingerprints is cut again by its open bits.
BLOCK = 256


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of each shingle of a text, in their order."""
    import xxhash

    found, hashed = words(text), xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return np.array([hashed(b" ".join(found), seed)], dtype="<u8")
    grams = zip(*(found[i:] for i in range(shingle)), strict=False)
    return np.fromiter((hashed(b" ".join(x), seed) for x in grams), dtype="<u8", count=len(found) - shingle + 1)


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed)) if text and words(text) else 0


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a long with the same 64 bits."""

    @F.arrow_udf("bigint")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.fromiter((fingerprint_of(x, shingle, seed) for part in slices(batch) for x in part), dtype=np.uint64, count=len(batch))
            yield pa.array(out.view(np.int64))

    return fingerprints(text)


def masks_of(radius: int, within: int = (1 << 64) - 1, parts: int = PARTS) -> list[int]:
    """The mask of each choice of ``parts - radius`` of the parts into which the bits of ``within`` are cut."""
    bits = [b for b in range(64) if within >> b & 1]
    ends = [len(bits) * i // parts for i in range(parts + 1)]
    pieces = [sum(1 << b for b in bits[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
    return [sum(x) for x in combinations(pieces, parts - radius)]


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row b holds bit b of all the values, 64 of them a word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return np.ascontiguousarray(packed).view("<u8")


def lanes(flags: np.ndarray) -> np.ndarray:
    """Booleans as packed bits, 64 a word."""
    packed = np.packbits(flags, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view("<u8")


def within(differ, live: np.ndarray, radius: int) -> np.ndarray:
    """The lanes (sorted) of ``live`` whose differing bits are ``radius`` at most. ``differ(b, at)`` gives the words ``at`` of
    plane b of the differences. Counters count to radius + 1 and stay there; words whose lanes are all past it are given up."""
    width = (radius + 1).bit_length()
    at = np.flatnonzero(live)
    open_, counters = live[at], np.zeros((width, len(at)), dtype=np.uint64)
    for b in range(64):
        carry = differ(b, at) & open_
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        past = open_.copy()
        for k in range(width):
            past &= counters[k] if (radius + 1) >> k & 1 else ~counters[k]
        open_ = open_ & ~past
        if b >= radius and (kept := open_ != 0).mean() < 0.75:
            at, open_, counters = at[kept], open_[kept], counters[:, kept]
            if not len(at):
                break
    word, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(open_).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return at[word] * 64 + bit


def near_lanes(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Whether the fingerprints of each pair differ in ``radius`` bits at most; pair i is lane i of one set of planes."""
    out = np.zeros(len(left), dtype=bool)
    if len(left):
        apart = planes(left ^ right)
        out[within(lambda b, at: apart[b][at], lanes(np.ones(len(left), dtype=bool)), radius)] = True
    return out


def near_in_units(values: np.ndarray, unit: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs of one unit within the radius. Equal units stand side by side."""
    block = np.pad(planes(values), ((0, 0), (0, 2)))
    n, s = len(values), 1
    while s < n and (same := unit[:-s] == unit[s:]).any():
        live = lanes(np.pad(same, (0, s)))
        word, bit = divmod(s, 64)
        low, high = np.uint64(bit), np.uint64((64 - bit) % 64)

        def differ(b: int, at: np.ndarray, word=word, bit=bit, low=low, high=high) -> np.ndarray:
            moved = block[b][at + word] >> low
            return block[b][at] ^ (moved | block[b][at + word + 1] << high if bit else moved)

        i = within(differ, live, radius)
        yield i, i + s
        s += 1


def within_radius(left: Column, right: Column, radius: int) -> Column:
    """Whether two fingerprints (long) differ in ``radius`` bits at most, by bit planes of many pairs at once."""

    @F.arrow_udf("boolean")
    def near(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in pairs:
            yield pa.array(near_lanes(*(x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b)), radius))

    return near(left, right)


def links(fingerprints: DataFrame, radius: int = 2, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of the distinct values of ``fp`` (long) that differ in 1 to ``radius`` bits, each pair once."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = masks_of(radius, parts=parts)
    open_masks = [masks_of(radius, (1 << 64) - 1 & ~m, parts) for m in masks]
    keyed = fingerprints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks))).alias("k", "key"))
    held = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Unit (k, key, -1, 0) of a key, or, of one that many share, units (k, key, j, further key).
    unit = lambda j, sub: F.struct(j.cast("int").alias("j"), sub.alias("sub"))
    further = F.get(F.lit([[signed(m) for m in some] for some in open_masks]), F.col("k"))
    cut = F.transform(further, lambda m, j: unit(j, F.col("fp").bitwiseAND(m)))
    whole = F.array(unit(F.lit(-1), F.lit(0).cast("long")))
    units = keyed.join(held, ["k", "key"]).select("fp", "k", "key", F.inline(F.when(F.col("n") > block, cut).otherwise(whole)))
    numbers, open_numbers = np.array(masks, dtype=np.uint64), np.array(open_masks, dtype=np.uint64)

    def first_shared(differ: np.ndarray, k: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether unit (k, j) is the first that a pair with these differing bits shares."""
        first = ((differ[:, None] & numbers) == 0).argmax(axis=1) == k
        return first & ((j < 0) | (((differ[:, None] & open_numbers[k]) == 0).argmax(axis=1) == j))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; the last unit of a batch waits for the next batch."""
        waiting = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if waiting is None else [*waiting.to_batches(), batch]).combine_chunks()
            k, key, j, sub = (rows.column(c).to_numpy() for c in UNIT)
            change = (k[1:] != k[:-1]) | (key[1:] != key[:-1]) | (j[1:] != j[:-1]) | (sub[1:] != sub[:-1])
            last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
            yield from found(rows.slice(0, last))
            waiting = rows.slice(last)
        if waiting is not None:
            yield from found(waiting)

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        k, key, j, sub = (rows.column(c).to_numpy() for c in UNIT)
        values = rows.column("fp").to_numpy().view(np.uint64)
        change = (k[1:] != k[:-1]) | (key[1:] != key[:-1]) | (j[1:] != j[:-1]) | (sub[1:] != sub[:-1])
        for x, y in near_in_units(values, np.concatenate([[0], np.cumsum(change)]), radius):
            own = first_shared(values[x] ^ values[y], k[x], j[x])
            a, b = values[x[own]].view(np.int64), values[y[own]].view(np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # A number of partitions of its own, so that these few bytes of much work aren't put together into one task.
    spread = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.select(*UNIT, "fp").repartition(spread, *UNIT).sortWithinPartitions(*UNIT).mapInArrow(pairs, "a bigint, b bigint")


UNIT = ["k", "key", "j", "sub"]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of ``edges`` (a, b): the least node that can be reached."""
    edges = materialize(edges.select("a", "b"), "edges")
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    now = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    changed = True
    while changed:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        seen = now.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        # What a member has seen is the label's own row's to take, too.
        hooked = seen.select("node", "least").union(seen.select(F.col("label"), "least")).groupBy("node").agg(F.min("least").alias("label"))
        hooked = materialize(hooked, "hooked")
        over = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(hooked.join(over, "label").select("node", F.least("label", "further").alias("label")), "labels")
        release(hooked)
        changed = now.withColumnRenamed("label", "old").join(new, "node").where("old <> label").limit(1).count() > 0
        release(now)
        now = new
    release(edges)
    return now


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): a row per row of ``df``; the component is its smallest id."""
    rows = materialize(df.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle, seed).alias("fp")), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = links(distinct, radius)
    labels = components(edges)
    # The label is a fingerprint; a component's id is the least of its fingerprints' first ids.
    member = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = member.groupBy("label").agg(F.min("first").alias("component_id"))
    of = materialize(member.join(least, "label").select("fp", "component_id"), "members")
    release(distinct)
    release(labels)
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def first_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of ``df`` of each component: that with the smallest id, of these the one with the least hash of the row."""
    row, name = F.xxhash64(*df.columns), unused(df.columns, "__row")
    made = near_duplicates(df.select(F.struct(F.col(doc_id).alias("id"), row.alias("row")).alias("id"), F.col(text).alias("text")), "id", "text", **how)
    kept = made.where("doc_id = component_id").select(F.col("doc_id.row").alias(name)).distinct()
    return df.withColumn(name, row).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
