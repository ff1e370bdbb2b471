"""Spelling variants grouped by one-edit neighbours, found by words reduced to an alphabet of a few symbols.

1. Words are counted: a text's maximal runs of Latin letters, A-Z lower-cased. Each task adds its texts' counts up before the
   shuffle, `HELD` words at a time.
2. Each word of the vocabulary (``least_chars`` code points, ``least_count`` times) is reduced: a hash makes one of `SYMBOLS`
   symbols of each letter. Its full one-edit neighbourhood is made over that alphabet: the reduced word itself (an edit between
   letters of one symbol), all its deletions, replacements and insertions, as 64-bit polynomial hashes. That is about
   (2 * SYMBOLS - 1) keys a letter, where the letters themselves would take over 170.
3. The neighbourhoods' keys are joined with the reduced vocabulary. Words one edit apart have reduced words at most one edit
   apart, so no pair is lost, and each is met once from either side; whether the strings differ in exactly one edit is then
   looked at on the strings. The join is by key alone; a key that many words share is split as any skewed join is. No join
   here is a broadcast: all tables grow with the vocabulary, and their files' sizes tell too little of what they take in memory.
4. A word's form is the near word of the largest count (ties: the smallest in code-point order) if that is ``factor`` times
   its own or more. Counts grow by this factor along a chain, so it has at most log(largest count) steps; roots are found by
   doubling, each round a table in the shared folder, and only words with forms take part.

Null, empty and blank texts have no words; long texts are taken a part at a time; repeated rows count each for themselves. An
empty table gives an empty table. Extra columns of the input aren't looked at. The table that the result is read from stays in
the shared folder until it is emptied.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.batches import blank_parts, slices
from memspark.llm.words import UPPER_TO_LOWER
from memspark.plans.shared import materialize, release

LETTERS = "[a-zÀ-ÿ]+"
#: Symbols of the reduced alphabet. More of them make more keys a word and fewer words a key.
SYMBOLS = 4
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_symbols(points: np.ndarray, symbols: int) -> np.ndarray:
    """A symbol of each code point, from the high bits of a product."""
    return (points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(symbols)


def neighbourhoods(words: list[str], symbols: int = SYMBOLS) -> list[tuple[int, np.ndarray]]:
    """Of each word the hash of its reduced word, and the distinct hashes of all reduced words within one edit."""
    out: list = [None] * len(words)
    by_length: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        by_length.setdefault(len(word), []).append(at)
    every = np.arange(symbols, dtype=np.uint64)
    for n, members in by_length.items():
        points = np.frombuffer("".join(words[x] for x in members).encode("utf-32-le"), dtype="<u4").reshape(-1, n)
        own = letter_symbols(points, symbols) + np.uint64(1)
        power = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n + 1, _BASE)]), dtype=np.uint64)
        m = len(members)
        # before[k]: hash of the first k symbols; behind[k]: what those from k on add to the word's hash.
        before, behind = np.zeros((n + 1, m), dtype=np.uint64), np.zeros((n + 1, m), dtype=np.uint64)
        for k in range(n):
            before[k + 1] = before[k] * _BASE + own[:, k]
            behind[n - 1 - k] = behind[n - k] + own[:, n - 1 - k] * power[k]
        whole = before[n]
        keys = [whole[:, None]]
        for k in range(n):
            keys.append((before[k] * power[n - 1 - k] + behind[k + 1])[:, None])
            keys.append(whole[:, None] + (every + np.uint64(1) - own[:, k, None]) * power[n - 1 - k])
        for k in range(n + 1):
            keys.append((before[k] * power[n - k + 1] + behind[k])[:, None] + (every + np.uint64(1)) * power[n - k])
        near = np.sort(np.concatenate(keys, axis=1), axis=1)
        fresh = np.concatenate([np.ones((m, 1), dtype=bool), near[:, 1:] != near[:, :-1]], axis=1)
        for row, at in enumerate(members):
            out[at] = int(whole[row].view(np.int64)), near[row][fresh[row]].view(np.int64)
    return out


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """(own, near): the key of a word's reduced form, and those of all forms within one edit of it."""

    @F.arrow_udf("struct<own:bigint,near:array<bigint>>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch, 1 << 18):
                own, near = zip(*neighbourhoods(part, symbols), strict=True)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in near])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(near)))
                yield pa.StructArray.from_arrays([pa.array(own, type=pa.int64()), listed], names=["own", "near"])

    # Marked so that Spark doesn't work it out again in filters of its own making.
    return keys.asNondeterministic()(word)


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 6, change: Callable[[str, list[str]], list[str]] | None = None) -> DataFrame:
    """(word, n) of all words of ``least_chars`` or more. ``change`` gives what the distinct words of a document (its id as text)
    are counted as: for tests and measurements that plant misspellings."""
    letters = re.compile(LETTERS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            pairs = list(total.items())
            total.clear()
            for at in range(0, len(pairs), 50_000):
                words, counts = zip(*pairs[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array(counts, type=pa.int64())], names=["word", "n"])

        for batch in batches:
            ids, at = batch.column(0), 0
            for part in slices(batch.column(1)):
                for own in part:
                    name = ids[at].as_py() or ""
                    at += 1
                    for piece in blank_parts(own):
                        found = Counter(letters.findall(piece.encode().translate(UPPER_TO_LOWER).decode()))
                        if change is None:
                            words = [x for x in found if len(x) >= least_chars]
                            for x in words:
                                total[x] += found[x]
                        else:
                            words = [x for x in found if len(x) >= least_chars]
                            for x, y in zip(words, change(name, words), strict=True):
                                if len(y) >= least_chars:
                                    total[y] += found[x]
                        if len(total) > HELD:
                            yield from told()
        yield from told()

    made = df.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(counted, "word string, n bigint")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n): every ordered pair of words (word, n) of the vocabulary that are one edit apart. The join is never a
    broadcast: Spark takes the exploded keys to be no larger than the words and would send them all through the driver."""
    keyed = vocabulary.withColumn("of", reduced(F.col("word"), symbols))
    left = keyed.select("word", F.explode("of.near").alias("key"))
    right = keyed.select(F.col("of.own").alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return left.join(right.hint("merge"), "key").where("word <> near").where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): where following forms ends."""
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(now)
        now = new.drop("moved")
        now._shared_path = new._shared_path
        if not new.where("moved").limit(1).count():
            return now


def group_variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 6, least_count: int = 5, factor: int = 5, symbols: int = SYMBOLS, change: Callable[[str, list[str]], list[str]] | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of the vocabulary."""
    vocabulary = materialize(word_counts(df, doc_id, text, least_chars, change).where(F.col("n") >= least_count), "vocabulary")
    # Of the near words the largest count, of equal ones the smallest word.
    best = near_words(vocabulary, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    joined = vocabulary.join(best.hint("merge"), "word", "left")
    found = -F.col("best.less") >= factor * F.col("n")
    rows = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(found, F.col("best.near")).alias("form"), F.when(found, -F.col("best.less")).alias("form_n")), "forms")
    release(vocabulary)
    ends = roots(rows.where("form is not null"))
    out = rows.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
