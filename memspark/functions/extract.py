"""Tags, key sentences, entity codes and classes of texts, and the compact dialect built of them."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import SPACE, any_of, as_column, blank_trim, bound, contained, or_default, stem
from memspark.functions.wordlists import DECISION_WORDS, EMOTION_CODES, EMOTION_SIGNALS, FLAG_SIGNALS, MEMORY_PATTERNS, TOPIC_STOPWORDS


def signal_tags(text: Column | str, signals: dict = EMOTION_SIGNALS, limit: int = 3) -> Column:
    """The first distinct codes whose word is in the text, in the order of the words."""
    codes = lambda lowered: F.array_compact(F.array(*(F.when(lowered.contains(word), F.lit(code)) for word, code in signals.items())))
    return F.slice(F.array_distinct(bound(F.lower(as_column(text)), codes)), 1, limit)


def memory_type(text: Column | str, patterns: dict = MEMORY_PATTERNS) -> Column:
    """The first class with a matching pattern, else null. Whether any pattern matches is asked first."""
    text = as_column(text)
    cases = F.coalesce(*(F.when(text.rlike(any_of(some)), F.lit(name)) for name, some in patterns.items()))
    return F.when(text.rlike(any_of([p for some in patterns.values() for p in some])), cases)


def extract_memories(df: DataFrame, text: str = "text", patterns: dict = MEMORY_PATTERNS, sep: str = "\n\n") -> DataFrame:
    """A row with chunk_index, content and memory_type for each paragraph of a class. The index counts paragraphs that
    aren't blank."""
    pieces = F.filter(F.split(F.col(text), sep), lambda p: F.length(blank_trim(p)) > 0)
    typed = F.transform(pieces, lambda p, i: F.struct(i.alias("chunk_index"), p.alias("content"), memory_type(p, patterns).alias("memory_type")))
    # Typed before they become rows: a filter on rows would work the patterns out twice.
    return df.select("*", F.inline(F.filter(typed, lambda x: x["memory_type"].isNotNull())))


def classify_summary(text: Column | str) -> Column:
    """person, place or concept, by plain words of a summary."""
    lowered = F.lower(as_column(text))
    return F.when(lowered.contains("name"), "person").when(lowered.contains("city") | lowered.contains("country"), "place").otherwise("concept")


def key_sentence(text: Column | str, words=DECISION_WORDS) -> Column:
    """The sentence with the best score of decision words and shortness, the first of equals; cut to 55 characters."""
    sentences = F.filter(F.transform(F.split(as_column(text), "[.!?\n]+"), blank_trim), lambda s: F.length(s) > 10)

    def scored(s: Column, i: Column) -> Column:
        n = F.length(s)
        score = 2 * contained(F.lower(s), words) + (n < 80).cast("int") + (n < 40).cast("int") - 2 * (n > 150).cast("int")
        return F.struct(score.alias("score"), (-i).alias("order"), s.alias("s"))

    best = F.array_max(F.transform(sentences, scored))["s"]
    return bound(best, lambda s: F.coalesce(F.when(F.length(s) > 55, F.concat(F.substring(s, 1, 52), F.lit("..."))).otherwise(s), F.lit("")))


def entity_codes(text: Column | str, codes: dict | None = None, stopwords=TOPIC_STOPWORDS) -> Column:
    """Codes of the known names in a text (names with an upper-case letter); without any, the first three letters of up to
    three capitalized words after the first word."""
    text = as_column(text)
    lowered = F.lower(text)
    named = [(n, c) for n, c in (codes or {}).items() if n != n.lower()]
    known = F.array_distinct(F.array_compact(F.array(*(F.when(lowered.contains(n.lower()), F.lit(c)) for n, c in named)))) if named else F.lit([]).cast("array<string>")
    guessed = guessed_codes(text, stopwords)
    return F.coalesce(bound(known, lambda k: F.when(F.size(k) > 0, k)), guessed) if named else guessed


#: A word with a capital that a blank stands before: the first word of a text has none. Java's \s, which is in `SPACE`, is ASCII.
_BLANKS = SPACE.replace("\\s", " \t\n\x0b\f\r")
_CAPITAL = re.compile(f"(?<=[{_BLANKS}])[^{_BLANKS}A-Z]*+[A-Z][^{_BLANKS}]*+")
_NO_LETTERS, _NAME = re.compile("[^a-zA-Z]+"), re.compile("[A-Z][a-z]+")


def first_codes(text: str, k: int, stopwords: frozenset[str]) -> list[str]:
    """The first k distinct codes of the capitalized words; the text behind them isn't read."""
    out: list[str] = []
    for found in _CAPITAL.finditer(text):
        word = _NO_LETTERS.sub("", found[0])
        if _NAME.fullmatch(word) and word.lower() not in stopwords and (code := word[:3].upper()) not in out:
            out.append(code)
            if len(out) == k:
                break
    return out


def guessed_codes(text: Column, stopwords=TOPIC_STOPWORDS, k: int = 3) -> Column:
    """`first_codes` over Arrow batches: built-in functions would list and clean every capitalized word of a text first."""
    stop = frozenset(stopwords)

    @F.arrow_udf("array<string>")
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((None if x is None else first_codes(x, k, stop) for x in (y.as_py() for y in batch)), type=pa.list_(pa.string()), size=len(batch))

    return codes(text)


TERMS = "array<struct<score:int,first:int,term:string>>"
_TOKEN = re.compile("[a-zA-Z][a-zA-Z_-]{2,}")
#: Characters of a text whose words are listed at once.
PART = 1 << 20


def term_scores(text: str, k: int, stopwords: frozenset[str]) -> list[dict]:
    """The k best words of a text. Equal words are weighed once, with their number and first place."""
    score: dict[str, int] = {}
    first: dict[str, int] = {}
    at = seen = 0
    while at < len(text):
        end = at + PART
        while end < len(text) and (text[end].isalpha() or text[end] in "_-"):  # not within a word
            end += 1
        words = _TOKEN.findall(text, at, end)
        places = dict(zip(reversed(words), range(seen + len(words) - 1, seen - 1, -1), strict=True))
        for word, n in Counter(words).items():
            term = word.lower()
            if term not in stopwords:
                weight = 1 if word.islower() and word.isalpha() else 1 + 2 * word[0].isupper() + 2 * ("_" in word or "-" in word or not word[1:].islower())
                score[term] = score.get(term, 0) + n * weight
                first[term] = min(first.get(term, places[word]), places[word])
        at, seen = end, seen + len(words)
    best = heapq.nsmallest(k, score, key=lambda t: (-score[t], first[t], t))
    return [{"score": score[t], "first": first[t], "term": t} for t in best]


def best_terms(text: Column | str, k: int = 3, stopwords=TOPIC_STOPWORDS) -> Column:
    """(score, first, term) of the k best words of a text, best first. A word counts one for each occurrence, two more where it
    starts with a capital, two more where it has a sign or an inner capital; the first seen of equals. Words are counted by a
    small function over Arrow batches: interpreted lambdas over the words took ten times as long."""
    stop = frozenset(stopwords)

    @F.arrow_udf(TERMS)
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("score", pa.int32()), ("first", pa.int32()), ("term", pa.string())]))
        for batch in batches:
            yield pa.array((None if x is None else term_scores(x, k, stop) for x in (y.as_py() for y in batch)), type=kind, size=len(batch))

    return terms(as_column(text))


def topic_terms(docs: DataFrame, k: int = 3, doc_id: str = "doc_id", text: str = "text", stopwords=TOPIC_STOPWORDS) -> DataFrame:
    """(doc_id, rank, term, score): `best_terms` as rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(best_terms(text, k, stopwords)).alias("rank", "t"))
    return rows.select("doc_id", (F.col("rank") + 1).alias("rank"), "t.term", "t.score")


def token_estimate(text: Column | str) -> Column:
    words = F.size(F.filter(F.split(as_column(text), f"[{SPACE}]+"), lambda w: w != ""))
    return F.greatest(F.lit(1).cast("long"), F.floor(words * F.lit(1.3)))


def compress(docs: DataFrame, codes: dict | None = None, header: bool = True, text: str = "text") -> DataFrame:
    """``docs`` with ``compressed``: entities, topics, key sentence, feelings and flags of a text in one line, after a line of
    wing, room, date and file where ``docs`` has these columns."""
    topics = F.array_join(F.transform(best_terms(text, 3), lambda x: x["term"]), "_")
    some = F.array_join(F.slice(entity_codes(text, codes), 1, 3), "+")
    tags = lambda signals: bound(F.array_join(signal_tags(text, signals), "+"), lambda x: F.nullif(x, F.lit("")))
    body = F.concat_ws(
        "|",
        F.concat(F.lit("0:"), bound(some, lambda x: or_default(x, "???"))),
        bound(topics, lambda x: or_default(x, "misc")),
        bound(key_sentence(text), lambda quote: F.when(quote != "", F.concat(F.lit('"'), quote, F.lit('"')))),
        tags(EMOTION_SIGNALS),
        tags(FLAG_SIGNALS),
    )
    there = lambda c: F.nullif(F.col(c), F.lit("")) if c in docs.columns else F.lit(None).cast("string")
    if header and {"wing", "source_file"} & set(docs.columns):
        line = F.concat_ws("|", *(F.coalesce(x, F.lit("?")) for x in (there("wing"), there("room"), there("date"), F.nullif(stem(there("source_file")), F.lit("")))))
        body = F.when(there("wing").isNotNull() | there("source_file").isNotNull(), F.concat(line, F.lit("\n"), body)).otherwise(body)
    # A generator of one row, so that what reads the text later doesn't make it again.
    return docs.select(*(c for c in docs.columns if c != "compressed"), F.explode(F.array(body)).alias("compressed"))


def compression_stats(df: DataFrame, text: str = "text", compressed: str = "compressed") -> DataFrame:
    before, after = token_estimate(text), token_estimate(compressed)
    return df.withColumns(
        {"original_tokens": before, "summary_tokens": after, "size_ratio": F.round(before / F.greatest(after, F.lit(1)), 1), "original_chars": F.length(text).cast("long"), "summary_chars": F.length(compressed).cast("long")}
    )


def decode(df: DataFrame, compressed: str = "compressed") -> DataFrame:
    """``df`` with header (file, entities, date, title), arc, records and tunnels of the lines; of several headers or arcs
    the last."""
    lines = F.split(blank_trim(compressed), "\n")
    is_arc, is_tunnel = (lambda x, p=p: x.startswith(p) for p in ("ARC:", "T:"))
    is_record = lambda x: ~is_arc(x) & ~is_tunnel(x) & x.contains("|") & F.substring_index(x, "|", 1).contains(":")
    is_header = lambda x: ~is_arc(x) & ~is_tunnel(x) & x.contains("|") & ~F.substring_index(x, "|", 1).contains(":")
    head = F.split(F.try_element_at(F.filter(lines, lambda x: is_header(x)), F.lit(-1)), "\\|")
    part = lambda i: F.coalesce(F.get(head, F.lit(i)), F.lit(""))
    header = F.when(head.isNotNull(), F.struct(part(0).alias("file"), part(1).alias("entities"), part(2).alias("date"), part(3).alias("title")))
    arc = F.coalesce(F.substring(F.try_element_at(F.filter(lines, lambda x: is_arc(x)), F.lit(-1)), 5, 1 << 30), F.lit(""))
    return df.withColumns({"header": header, "arc": arc, "records": F.filter(lines, lambda x: is_record(x)), "tunnels": F.filter(lines, lambda x: is_tunnel(x))})


def encode_entity(name: Column | str, codes: dict | None = None, skip=()) -> Column:
    name = as_column(name)
    lowered = F.lower(name)
    codes = codes or {}
    out = F.upper(F.substring(name, 1, 3))
    for key, code in reversed(list(codes.items())):
        out = F.when(lowered.contains(key.lower()), F.lit(code)).otherwise(out)
    for form in (lowered, name):
        for key, code in codes.items():
            out = F.when(form == key, F.lit(code)).otherwise(out)
    return F.when(contained(lowered, [s.lower() for s in skip]) > 0, F.lit(None)).otherwise(out) if skip else out


def encode_emotions(emotions: Column | str, codes: dict = EMOTION_CODES) -> Column:
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    named = F.array_distinct(F.transform(as_column(emotions), lambda e: F.coalesce(table[e], F.substring(e, 1, 4))))
    return F.array_join(F.slice(named, 1, 3), "+")


def encode_record(df: DataFrame, codes: dict | None = None, skip=(), quote: str = '"test quote"', weight: str = "0.5") -> DataFrame:
    """``df`` (id, people, topics, emotional_tone) with ``encoded``."""
    people = F.array_sort(F.array_distinct(F.array_compact(F.transform("people", lambda p: encode_entity(p, codes, skip)))))
    names = or_default(F.array_join(people, "+"), "???")
    topics = or_default(F.array_join(F.slice("topics", 1, 2), "_"), "misc")
    feelings = F.nullif(encode_emotions(F.coalesce("emotional_tone", F.lit([]).cast("array<string>"))), F.lit(""))
    first = F.concat(F.element_at(F.split("id", "-"), -1), F.lit(":"), F.coalesce(names, F.lit("???")))
    return df.withColumn("encoded", F.concat_ws("|", first, F.coalesce(topics, F.lit("misc")), F.lit(quote), F.lit(weight), feelings))


def encode_tunnel(df: DataFrame) -> DataFrame:
    """``df`` (from_id, to_id, label) with ``encoded``."""
    end = lambda c: F.element_at(F.split(c, "-"), -1)
    label = F.coalesce("label", F.lit(""))
    short = F.when(label.contains(":"), F.substring_index(label, ":", 1)).otherwise(F.substring(label, 1, 30))
    return df.withColumn("encoded", F.concat(F.lit("T:"), end("from_id"), F.lit("<->"), end("to_id"), F.lit("|"), short))
