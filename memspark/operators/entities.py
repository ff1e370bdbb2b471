"""Entity candidates of texts, and a registry of people and projects."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.extract import classify_summary, entity_codes
from memspark.functions.text import ascii_words, bound, runs, strings
from memspark.functions.wordlists import AMBIGUOUS_WORDS, NAME_STOPWORDS, PERSON_PATTERNS, PROJECT_PATTERNS
from memspark.plans.shared import materialize, release

NAME = "[A-Z][a-z]{2,}"
#: Bytes of names in one automaton, which takes some fifty times as much.
NAMES_BLOCK = 1 << 20


class Registry(NamedTuple):
    """people: (name, type, source, confidence, relationship, aliases); projects: (name); summaries: (word, type,
    confidence, confirmed); ambiguous: (name)."""

    people: DataFrame
    projects: DataFrame
    summaries: DataFrame | None
    ambiguous: DataFrame
    mode: str = "personal"


def fixed_word(pattern: str) -> str:
    """The longest run of letters that every match of a pattern has."""
    plain = re.sub(r"\(\?:[^)]*\)\??|[a-z]\?|\\[a-z]\+?|\{name\}", " ", pattern)
    return max(re.findall("[a-z]+", plain), key=len, default="")


def names_beside(text: Column, lowered: Column, pattern: str) -> Column:
    """All capitalized words of a text that stand at the pattern's place. What comes after the name is only looked at, so that
    one match doesn't hide the next. Texts without the pattern's fixed word are not searched."""
    before, after = pattern.split("{name}")
    rule = f"(?i:{ascii_words(before)})({NAME})(?={ascii_words(after) if after == chr(92) + 'b' else '(?i:' + ascii_words(after) + ')'})"
    return F.when(lowered.contains(fixed_word(pattern)), F.array_distinct(F.regexp_extract_all(text, F.lit(rule), F.lit(1)))).otherwise(strings(()))


def detect_entities(docs: DataFrame, registry: Registry | None = None, doc_id: str = "doc_id", text: str = "text", stopwords=NAME_STOPWORDS) -> DataFrame:
    """(doc_id, name, score): occurrences of capitalized words of three letters or more, and two for each pattern of people or
    projects that the name meets in the text. A stopword counts only where a pattern met it, a registered name always. A
    text's names are counted within its row."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.regexp_extract_all(body, F.lit(ascii_words(rf"\b({NAME})\b")), F.lit(1))
    beside = bound(F.lower(body), lambda lowered: F.concat(*(names_beside(body, lowered, p) for p in PERSON_PATTERNS + PROJECT_PATTERNS)))
    item = lambda w, n, met: F.struct(w.alias("name"), F.lit(n).alias("n"), F.lit(met).alias("met"))
    items = F.concat(F.transform(found, lambda w: item(w, 1, 0)), F.transform(beside, lambda w: item(w, 0, 1)))
    total = lambda run, field: F.aggregate(run, F.lit(0), lambda a, x: a + x[field])
    counted = runs(items, "name", lambda run: F.struct(run[0]["name"].alias("name"), total(run, "n").alias("n"), total(run, "met").alias("met")))
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.inline(counted)).where("n > 0")
    stop = F.lower("name").isin(*stopwords)
    if registry is not None:
        known = registry.people.select(F.lower("name").alias("__known")).union(registry.projects.select(F.lower("name"))).distinct()
        scored = scored.join(known, F.lower("name") == F.col("__known"), "left")
        stop = stop & F.col("__known").isNull()
    return scored.where(~stop | (F.col("met") > 0)).select("doc_id", "name", (F.col("n") + 2 * F.col("met")).cast("long").alias("score"))


#: The automaton that this worker searched with last, by its name.
_automata: dict[str, object] = {}


def automaton(name: str, keys) -> object:
    """An Aho-Corasick automaton of a broadcast list of keys, made once in a worker; only one is held."""
    if name not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, key in enumerate(keys.value):
            made.add_word(key, i)
        made.make_automaton()
        _automata.clear()
        _automata[name] = made
    return _automata[name]


def found_keys(lowered: Column, keys) -> Column:
    """The places in the list of the keys that stand in a text, each once."""
    name = uuid.uuid4().hex

    @F.arrow_udf("array<int>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            search = automaton(name, keys).iter
            yield pa.array((sorted({i for _, i in search(x)}) if x else [] for x in (y.as_py() for y in batch)), type=pa.list_(pa.int32()), size=len(batch))

    return found(lowered)


def names_in(docs: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = NAMES_BLOCK) -> DataFrame:
    """(doc_id, key): the lower-cased names (name) that stand anywhere in a text, whatever their number. Names go to the tasks in
    automata of about ``block`` bytes, one after another; a text is gone through once for each, not once for each name."""
    spark = docs.sparkSession
    keys = materialize(names.select(F.lower("name").alias("key")).where("key <> ''").distinct(), "names")
    n = -(-(keys.agg(F.sum(F.octet_length("key"))).first()[0] or 0) // block)
    kind, out = dict(docs.dtypes)[doc_id], None
    for i in range(n):
        part = [r["key"] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).toLocalIterator()]
        if not part:
            continue
        shared = spark.sparkContext.broadcast(part)
        listed = spark.createDataFrame(list(enumerate(part)), "i int, key string")
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(found_keys(F.lower(text), shared)).alias("i")).join(F.broadcast(listed), "i").select("doc_id", "key")
        if n > 1:
            rows = materialize(rows, "found")
            shared.destroy()
        out = rows if out is None else out.unionByName(rows)
    release(keys) if n else None
    return spark.createDataFrame([], f"doc_id {kind}, key string") if out is None else out


def registered_codes(docs: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = NAMES_BLOCK) -> DataFrame:
    """``docs`` with ``codes``: what `entity_codes` gives with the names (seq, name, code) in their order, for any number of them. Ids are
    unique."""
    named = names.where(F.col("name") != F.lower("name")).select(F.lower("name").alias("key"), "seq", "code")
    hits = names_in(docs, named.select(F.col("key").alias("name")), doc_id, text, block).join(named, "key")
    first = hits.groupBy("doc_id", "code").agg(F.min("seq").alias("seq"))
    known = first.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"]).alias("__known")).withColumnRenamed("doc_id", doc_id)
    rows = docs.drop("codes").join(known, doc_id, "left")
    return rows.withColumn("codes", F.coalesce("__known", entity_codes(text))).drop("__known")


def seed_registry(people: DataFrame, projects: DataFrame, mode: str = "personal", ambiguous_words=AMBIGUOUS_WORDS) -> Registry:
    """people: (seq, name, relationship, aliases). The last entry of a name wins; names that are common words are flagged."""
    last = people.groupBy("name").agg(F.max_by(F.struct("relationship", "aliases"), "seq").alias("p"))
    rows = last.select("name", F.lit("person").alias("type"), F.lit("onboarding").alias("source"), F.lit(1.0).alias("confidence"), F.col("p.relationship").alias("relationship"), F.coalesce("p.aliases", F.lit([]).cast("array<string>")).alias("aliases"))
    return Registry(rows, projects.select("name").distinct(), None, rows.where(F.lower("name").isin(*ambiguous_words)).select("name"), mode)


def lookup_entities(words: DataFrame, registry: Registry) -> DataFrame:
    """(word, name, type, confidence, source): a person by name or alias, else a project, else a confirmed summary."""
    asked = words.select("word").distinct().withColumn("k", F.lower("word"))
    named = registry.people.select(F.explode(F.concat(F.array("name"), "aliases")).alias("k"), "name", "confidence", "source")
    person = named.groupBy(F.lower("k").alias("k")).agg(F.min(F.struct("name", F.lit("person").alias("type"), "confidence", "source")).alias("person"))
    project = registry.projects.groupBy(F.lower("name").alias("k")).agg(F.min(F.struct("name", F.lit("project").alias("type"), F.lit(1.0).alias("confidence"), F.lit("onboarding").alias("source"))).alias("project"))
    joined = asked.join(person, "k", "left").join(project, "k", "left")
    known = [F.col("person"), F.col("project")]
    if registry.summaries is not None:
        summary = registry.summaries.where("confirmed").groupBy(F.lower("word").alias("k")).agg(F.min(F.struct(F.col("word").alias("name"), "type", "confidence", F.lit("wiki").alias("source"))).alias("summary"))
        joined = joined.join(summary, "k", "left")
        known.append(F.col("summary"))
    none = F.struct(F.col("word").alias("name"), F.lit("unknown").alias("type"), F.lit(0.0).alias("confidence"), F.lit("inferred").alias("source"))
    return joined.withColumn("e", F.coalesce(*known, none)).select("word", "e.name", "e.type", "e.confidence", "e.source")


def classified_summaries(summaries: DataFrame) -> DataFrame:
    """(word, type, confidence, confirmed) of (word, summary)."""
    return summaries.select("word", classify_summary("summary").alias("type"), F.lit(0.8).alias("confidence"), F.lit(False).alias("confirmed"))


def registry_summary(registry: Registry) -> DataFrame:
    rows = registry.people.select(F.lit(1).alias("person")).union(registry.projects.select(F.lit(0)))
    return rows.agg(F.count_if(F.col("person") == 1).alias("people"), F.count_if(F.col("person") == 0).alias("projects")).withColumn("mode", F.lit(registry.mode))
