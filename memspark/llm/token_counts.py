"""Token counts of whole texts by a sentencepiece model, in Arrow functions that return lengths only.

No piece of the model has a blank after another character, so no merge crosses the place before a run of blanks: there a
text may be split, and the parts' counts add up to the text's. Each part is one run of blanks with the word after it; parts
seen before in the worker are looked up, the others go to the library in batches of bounded bytes. The library puts a blank
before a text, which stands for the first blank of a part. For a model that breaks this rule (`splits_safely`), whole texts
go to the library, in batches of bounded bytes. A long text is cut at such places first, so that the parts of about a
million characters stand in memory at once; only a word longer than that is longer.

A null or empty text has no tokens. Repeated rows count each for themselves and alike; an empty table gives an empty table;
the input's own columns stay, but for those of the result's names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.batches import Memo, blank_parts, slices

MARK = "▁"


def model_file(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    def __init__(self, path: str | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file(path))
        #: Tokens of one blank at a text's end, which the library can't be given alone.
        self.blank = len(self.library.encode("a ")) - len(self.library.encode("a"))
        self.safe = self.splits_safely()
        self.memo = Memo(self.part_lengths)

    def splits_safely(self) -> bool:
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any(MARK in x.lstrip(MARK) for x in pieces):
            return False
        probe = ("  a", "a  ", "a 　b ﬁ", f"x{MARK}{MARK}y", " ", "x </s> <unk>")
        return all(sum(self.part_lengths(self.parts(x))) == len(self.library.encode(x)) for x in probe)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for part in slices(pa.array(texts, type=pa.string()), 1 << 20) for x in self.library.encode(part, num_threads=1)]

    def part_lengths(self, parts: list[str]) -> list[int]:
        return [n if x else self.blank for x, n in zip(parts, self.lengths(parts), strict=True)]

    @staticmethod
    def parts(text: str) -> list[str]:
        """The parts without the first of their blanks, which the library puts back."""
        return [x for part in blank_parts(text.replace(MARK, " ")) for x in Counter.parts_of(part)] if text else []

    @staticmethod
    def parts_of(text: str) -> list[str]:
        words = text.split(" ")
        return [x[1:] for x in re.findall(" +[^ ]*", " " + text)] if "" in words else words

    def groups(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        """(place of the text, some of its parts): of a long text several."""
        for i, text in enumerate(texts):
            for part in blank_parts(text.replace(MARK, " ")) if text else ():
                yield i, self.parts_of(part)

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.lengths(texts)
        out, get = [0] * len(texts), self.memo.__getitem__
        for some in bounded(self.groups(texts)):
            self.memo.fill(set().union(*(x for _, x in some)))
            for i, parts in some:
                out[i] += sum(map(get, parts))
        return out


def bounded(groups: Iterator[tuple[int, list[str]]], most: int = 250_000) -> Iterator[list[tuple[int, list[str]]]]:
    """The groups in lists of about ``most`` parts."""
    held, n = [], 0
    for group in groups:
        held.append(group)
        n += len(group[1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


_loaded: dict[str | None, Counter] = {}


def counter(path: str | None = None) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_length(text: Column, path: str | None = None) -> Column:
    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = counter(path)
        for batch in batches:
            yield pa.array([n for part in slices(batch) for n in tokens.count(part)], type=pa.int64())

    return lengths(text)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, limit: int = 4096) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; columns of these names are replaced."""
    out = df.withColumn("n_tokens", token_length(F.col(text), path))
    return out.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
