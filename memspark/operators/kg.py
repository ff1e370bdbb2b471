"""A temporal knowledge graph: entities, triples with closed text intervals, batch inserts and as-of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions.text import as_column, or_default

ENTITY = T.StructType().add("id", "string").add("name", "string").add("type", "string").add("properties", "string").add("created_at", "string")
TRIPLE = T.StructType().add("id", "string").add("subject", "string").add("predicate", "string").add("object", "string").add("valid_from", "string").add("valid_to", "string").add("confidence", "double").add("source_closet", "string").add("source_file", "string").add("extracted_at", "string")


def entity_id(name: Column | str) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(as_column(name))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def predicate_name(predicate: Column | str) -> Column:
    return F.regexp_replace(F.lower(as_column(predicate)), "\\s+", "_")


def triple_id(seq: Column, short: Column | None = None) -> Column:
    """The id of a row (subject, predicate, object, valid_from), which are ids, and its number."""
    text = F.concat_ws("|", "subject", "predicate", "object", F.coalesce("valid_from", F.lit("")), seq.cast("string"))
    end = F.substring(F.md5(text.cast("binary")), 1, 8) if short is None else short
    return F.concat(F.lit("t_"), F.concat_ws("_", "subject", "predicate", "object"), F.lit("_"), end)


def upsert_entities(entities: DataFrame, incoming: DataFrame, now: str = "") -> DataFrame:
    """incoming: (name, type, properties, seq). The last of one id replaces name, type and properties; created_at stays."""
    new = incoming.select(entity_id("name").alias("id"), F.struct(F.col("seq"), F.col("name"), or_default("type", "unknown").alias("type"), or_default("properties", "{}").alias("properties")).alias("v")).groupBy("id").agg(F.max_by("v", "v.seq").alias("v"))
    old = entities.select("id", F.struct(*(c for c in entities.columns if c != "id")).alias("o"))
    joined = old.join(new, "id", "full_outer")
    return joined.select("id", *(F.coalesce(f"v.{c}", f"o.{c}").alias(c) for c in ("name", "type", "properties")), F.coalesce("o.created_at", F.lit(now)).alias("created_at"))


def add_triples(entities: DataFrame, triples: DataFrame, incoming: DataFrame, now: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """incoming: (seq, subject, predicate, object, valid_from, valid_to[, confidence, source_file]), names as given; ``seq`` is a
    whole number of its own for each row, 0 or more. What is first is found by hash aggregations of numbers alone. Returns (entities, triples, ids): the new stores and (seq, id, added). Missing entities are made, the first name of an
    id wins. A triple that is active already (valid_to null), in the store or earlier in the batch, isn't added again."""
    has = lambda c, kind: F.col(c) if c in incoming.columns else F.lit(None).cast(kind)
    rows = incoming.select(
        "seq", F.col("subject").alias("s_name"), F.col("object").alias("o_name"), entity_id("subject").alias("subject"), predicate_name("predicate").alias("predicate"), entity_id("object").alias("object"),
        F.nullif("valid_from", F.lit("")).alias("valid_from"), F.nullif("valid_to", F.lit("")).alias("valid_to"), or_default(has("confidence", "double"), 1.0).alias("confidence"),
        has("source_closet", "string").alias("source_closet"), has("source_file", "string").alias("source_file"),
    )
    # The place of a name: twice the row's number, and one more for objects.
    ends = rows.select(F.explode(F.array(F.struct(F.col("subject").alias("id"), (2 * F.col("seq")).alias("place")), F.struct(F.col("object").alias("id"), (2 * F.col("seq") + 1).alias("place")))).alias("e"))
    first = ends.groupBy("e.id").agg(F.min("e.place").alias("place")).join(entities.select("id"), "id", "left_anti").select("id", F.floor(F.col("place") / 2).alias("seq"), (F.col("place") % 2 == 0).alias("is_subject"))
    named = first.join(rows.select("seq", "s_name", "o_name"), "seq").select("id", F.when(F.col("is_subject"), F.col("s_name")).otherwise(F.col("o_name")).alias("name"))
    made = named.select("id", "name", F.lit("unknown").alias("type"), F.lit("{}").alias("properties"), F.lit(now).alias("created_at"))
    key = ["subject", "predicate", "object"]
    active = triples.where("valid_to is null").groupBy(*key).agg(F.min("id").alias("active_id"))
    rows = rows.withColumn("id", triple_id(F.col("seq")))
    # The first active one of each triple with the end of its id, in one number that a hash aggregation takes: a triple with
    # most of the rows isn't one task's.
    step = F.lit(1 << 32).cast("decimal(11,0)")
    packed = (F.col("seq").cast("decimal(20,0)") * step + F.conv(F.right("id", F.lit(8)), 16, 10).cast("decimal(11,0)")).cast("decimal(34,0)")
    opened = rows.where("valid_to is null").groupBy(*key).agg(F.min("seq").alias("first_seq"), F.min(packed).alias("packed"))
    end = F.lower(F.lpad(F.hex((F.col("packed") - F.col("first_seq").cast("decimal(20,0)") * step).cast("long")), 8, "0"))
    opened = opened.select(*key, "first_seq", triple_id(F.col("first_seq"), end).alias("first_id"))
    rows = rows.join(opened, key, "left").join(active, key, "left")
    added = F.col("active_id").isNull() & (F.col("first_seq").isNull() | (F.col("seq") <= F.col("first_seq")))
    rows = rows.withColumn("added", added)
    ids = rows.select("seq", F.when(F.col("added"), F.col("id")).otherwise(F.coalesce("active_id", "first_id")).alias("id"), "added")
    new = rows.where("added").select("id", *key, "valid_from", "valid_to", "confidence", "source_closet", "source_file", F.lit(now).alias("extracted_at"))
    return entities.unionByName(made), triples.unionByName(new), ids


def closing_keys(closings: DataFrame, today: str) -> DataFrame:
    """(subject, predicate, object, ended) by ids of closings with names as given, the first end of each."""
    ends = closings.select(entity_id("subject").alias("subject"), predicate_name("predicate").alias("predicate"), entity_id("object").alias("object"), F.coalesce(F.nullif("ended", F.lit("")), F.lit(today)).alias("ended"))
    return ends.groupBy("subject", "predicate", "object").agg(F.min("ended").alias("ended"))


def invalidate(triples: DataFrame, closings: DataFrame, today: str) -> DataFrame:
    """closings: (subject, predicate, object, ended), names as given. Active triples that match get valid_to."""
    ends = closing_keys(closings, today)
    joined = triples.join(ends, ["subject", "predicate", "object"], "left")
    return joined.withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("ended")).otherwise(F.col("valid_to"))).select(*triples.columns)


#: Questions of one entity that are compared with all of its triples.
FEW = 16
#: Levels of the bins of months; a month is year and month as one number of six digits.
LEVELS = 20


def month(date: Column | str) -> Column:
    """A date's year and month as a number, in the order of the texts; null for texts that don't begin with both."""
    date = as_column(date)
    return F.when(date.rlike("^[0-9]{4}-[0-9]{2}"), F.concat(F.substring(date, 1, 4), F.substring(date, 6, 2)).cast("int"))


def bins(first: Column, last: Column) -> Column:
    """The bins (level, bin) that cover the months from first to last, at most two a level: bin b of level l is the 2^l months
    from b * 2^l on. Each month lies in exactly one of them."""
    every = F.sequence(F.lit(0), F.lit(LEVELS))

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("long")
        low, high = F.ceil(first / size), F.floor((last + 1) / size) - 1
        node = lambda b: F.struct(level.alias("level"), b.cast("long").alias("bin"))
        left, right = F.when((low % 2 == 1) & (low <= high), node(low)), F.when((high % 2 == 0) & (low <= high), node(high))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(every, at))


def bins_of(point: Column) -> Column:
    """The bins that a month lies in, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.struct(level.alias("level"), F.floor(point / F.pow(F.lit(2), level)).cast("long").alias("bin")))


def valid_at(triples: DataFrame, asked: DataFrame, mine: str) -> DataFrame:
    """The triples of each asked entity (query, query_id, as_of) that are valid at its time, or all where it has none.

    An entity with at most `FEW` dated questions meets its triples by the entity alone: that is no more than `FEW` pairs a triple, and a triple
    is sent once. Of the others, times meet by equi-keys: a triple stands in the bins that cover its months, a question looks into those of its own month.
    So an entity with many triples and many questions makes only the pairs that are valid in the month, which are then compared
    by the whole texts. Dates that aren't of the usual form count as open in the bins; questions with such ones meet
    all triples of their entity."""
    inside = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("as_of"))) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("as_of")))
    at = asked.withColumn("__month", month("as_of"))
    columns = [*triples.columns, "query", "as_of"]
    crowded = at.where("__month is not null").groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("query_id")
    has_crowds = crowded.limit(1).count() > 0
    rest = at.where("__month is null").unionByName(at.where("__month is not null").join(crowded, "query_id", "left_anti")) if has_crowds else at
    every = triples.join(rest.drop("__month").withColumnRenamed("query_id", mine), mine).where(F.col("as_of").isNull() | inside).select(*columns)
    if not has_crowds:
        return every
    dated = at.where("__month is not null").join(crowded, "query_id", "left_semi").select("query", "query_id", "as_of", F.inline(bins_of(F.col("__month"))))
    months = bins(F.coalesce(month("valid_from"), F.lit(0)), F.coalesce(month("valid_to"), F.lit((1 << LEVELS) - 1)))
    placed = triples.join(crowded.withColumnRenamed("query_id", mine), mine, "left_semi").select("*", F.inline(months))
    met = placed.join(dated.withColumnRenamed("query_id", mine), [mine, "level", "bin"]).where(inside)
    return met.select(*columns).unionByName(every)


def query_entities(entities: DataFrame, triples: DataFrame, queries: DataFrame, direction: str = "outgoing") -> DataFrame:
    """queries: (name[, as_of]). (query, direction, subject, predicate, object, valid_from, valid_to, confidence,
    source_closet, current): the triples of each name, valid at its time where it has one (both ends count)."""
    if direction == "both":
        return query_entities(entities, triples, queries, "outgoing").unionByName(query_entities(entities, triples, queries, "incoming"))
    mine, other = ("subject", "object") if direction == "outgoing" else ("object", "subject")
    as_of = F.col("as_of") if "as_of" in queries.columns else F.lit(None).cast("string")
    asked = queries.select(F.col("name").alias("query"), entity_id("name").alias("query_id"), as_of.alias("as_of"))
    names = entities.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    found = valid_at(triples, asked, mine) if "as_of" in queries.columns else triples.join(asked.withColumnRenamed("query_id", mine), mine)
    rows = found.join(names, F.col(other) == F.col("other_id"))
    given = {mine: F.col("query"), other: F.col("other_name")}
    return rows.select("query", "as_of", F.lit(direction).alias("direction"), given["subject"].alias("subject"), "predicate", given["object"].alias("object"), "valid_from", "valid_to", "confidence", "source_closet", F.col("valid_to").isNull().alias("current"))


def timeline(entities: DataFrame, triples: DataFrame, entity: str | None = None, limit: int = 100) -> DataFrame:
    """Triples (of one entity) with both names, earliest first, those without a date before all."""
    name = lambda c: entities.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    rows = triples.withColumnsRenamed({"subject": "s", "object": "o"})
    if entity is not None:
        rows = rows.where((F.col("s") == entity_id(F.lit(entity))) | (F.col("o") == entity_id(F.lit(entity))))
    rows = rows.join(name("s"), F.col("s") == F.col("s_id")).join(name("o"), F.col("o") == F.col("o_id"))
    rows = rows.orderBy(F.asc_nulls_first("valid_from"), "id").limit(limit)
    return rows.select("id", F.col("s_name").alias("subject"), "predicate", F.col("o_name").alias("object"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current"))


def kg_stats(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: entities, triples, current, expired, and the sorted predicates."""
    kinds = triples.select(F.lit(0).alias("entity"), F.col("valid_to").isNull().alias("current"), "predicate")
    rows = kinds.unionByName(entities.select(F.lit(1).alias("entity"), F.lit(None).cast("boolean").alias("current"), F.lit(None).cast("string").alias("predicate")))
    return rows.agg(
        F.count_if(F.col("entity") == 0).alias("triples"), F.count_if("current").alias("current"), F.count_if(~F.col("current")).alias("expired"),
        F.sort_array(F.collect_set("predicate")).alias("predicates"), F.count_if(F.col("entity") == 1).alias("entities"),
    )
