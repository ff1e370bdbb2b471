"""Queries of the drawer store, registries, the dialect's parts, context texts and streams over the given tables, and SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import extract
from memspark.functions.wordlists import AMBIGUOUS_WORDS, EMOTION_CODES
from memspark.operators import drawers, entities, evaluate, kg, similarity, versions
from memspark.plans.queries import _NEAR, _SIM, _SPOKEN, _TWENTIETH_METRICS, KG, L1, SQL, built_kg, document_drawers, empty_kg, kg_rows, query, quoted, searchers, spoken, sql_compressed, t, twentieth_metrics, vectors
from memspark.plans.shared import materialize, shared_path
from memspark.sources import files
from memspark.streaming import jobs


def filed_documents(spark, d) -> DataFrame:
    """Documents as drawers: a wing for each source, a room for each language."""
    docs = t(spark, d, "documents")
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("wing"), F.col("lang").alias("room"), F.concat(F.lit("/in/"), F.floor(F.col("doc_id") / 7).cast("string")).alias("source_file"), (F.col("n_chars") * 1.0).alias("source_mtime"), F.lpad((F.col("doc_id") % 1000).cast("string"), 4, "0").alias("filed_at"))


@query
def stored_mtime(spark, d):
    return drawers.file_mtime(filed_documents(spark, d), "/in/11")


SQL["stored_mtime"] = "SELECT nullif(max(n_chars * 1.0::DOUBLE), 0) AS source_mtime FROM documents WHERE doc_id // 7 = 11"


@query
def appended_drawers(spark, d):
    """Two appends of the documents, one with fewer columns, read back; equal ids stay."""
    path, rows = shared_path(spark, "drawers"), filed_documents(spark, d)
    drawers.append_drawers(rows, path)
    drawers.append_drawers(rows.where("length(id) > 3").select("id", "wing"), path)
    stored = drawers.read_drawers(spark, path)
    return stored.groupBy("wing", "room").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.length("content")).cast("long").alias("n_chars"), F.sum("source_mtime").alias("mtimes"), F.count_if(F.col("importance").isNull()).alias("unrated"))


SQL["appended_drawers"] = """
WITH x AS (SELECT 'd' || doc_id AS id, source AS wing, lang AS room, coalesce(text, '') AS content, n_chars AS mtime FROM documents
UNION ALL SELECT 'd' || doc_id, source, '', '', 0 FROM documents WHERE length('d' || doc_id) > 3)
SELECT wing, room, count(*) AS n, count(DISTINCT id) AS ids, sum(length(content))::BIGINT AS n_chars, sum(mtime)::DOUBLE AS mtimes, count(*) AS unrated FROM x GROUP BY wing, room"""


@query
def deleted_drawers(spark, d):
    gone = t(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("id"))
    return drawers.delete_drawers(filed_documents(spark, d), gone).select("id", "wing", "room")


SQL["deleted_drawers"] = "SELECT 'd' || doc_id AS id, source AS wing, lang AS room FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"


@query
def cleared_store(spark, d):
    path = shared_path(spark, "cleared")
    drawers.append_drawers(filed_documents(spark, d), path)
    before = drawers.read_drawers(spark, path).count()
    drawers.clear_drawers(spark, path)
    return drawers.read_drawers(spark, path).agg(F.lit(before).cast("long").alias("before"), F.count("*").alias("after"))


SQL["cleared_store"] = "SELECT count(*) AS before, 0::BIGINT AS after FROM documents"


@query
def listed_columns(spark, d):
    """Some columns of the drawers, in the store's form: defaults where a column is missing."""
    return drawers.as_drawers(filed_documents(spark, d)).select("id", "wing", "hall", "chunk_index", "source_mtime", "importance")


SQL["listed_columns"] = "SELECT 'd' || doc_id AS id, source AS wing, '' AS hall, 0::INT AS chunk_index, n_chars * 1.0::DOUBLE AS source_mtime, NULL::INT AS importance FROM documents"


@query
def stored_kg(spark, d):
    path = shared_path(spark, "kg")
    files.write_kg(*built_kg(spark, d), path)
    found, triples = files.read_kg(spark, path)
    return triples.join(found.select(F.col("id").alias("object"), "name"), "object").select("id", "subject", "predicate", F.col("name").alias("object_name"), "valid_from", "valid_to", "confidence")


SQL["stored_kg"] = f"WITH {KG} SELECT id, subject, predicate, o_name AS object_name, valid_from, valid_to, 1.0::DOUBLE AS confidence FROM tri"


def diary(spark, d) -> DataFrame:
    rows = t(spark, d, "documents").select(F.concat(F.upper(F.substring("source", 1, 1)), F.substring("source", 2, 99)).alias("agent"), F.col("text").alias("entry"), F.when(F.col("lang") != "de", F.col("lang")).otherwise("").alias("topic"))
    return drawers.diary_entries(rows, "2026-01-01")


_DIARY = """
WITH x AS (SELECT upper(substr(source, 1, 1)) || substr(source, 2) AS agent, text, CASE WHEN lang = 'de' THEN 'general' ELSE lang END AS topic FROM documents),
e AS (SELECT 'diary_' || md5('agent_' || lower(agent) || '|2026-01-01|' || coalesce(text, '')) AS id, 'agent_' || lower(agent) AS wing, topic, agent, coalesce(text, '') AS content FROM x)"""


@query
def diary_entries(spark, d):
    return diary(spark, d).select("id", "wing", "room", "topic", "type", "agent", "added_by", "filed_at")


SQL["diary_entries"] = _DIARY + " SELECT id, wing, 'diary' AS room, topic, 'diary_entry' AS type, agent, agent AS added_by, '2026-01-01' AS filed_at FROM e"


@query
def diary_read(spark, d):
    return drawers.read_diary(diary(spark, d), "SRC1", 10).select("id", "content")


SQL["diary_read"] = _DIARY + " SELECT id, content FROM e WHERE wing = 'agent_src1' ORDER BY id LIMIT 10"

_NAME = "CASE WHEN s_suppkey % 10 = 0 THEN ['May', 'Grace', 'Bill', 'River'][(s_suppkey // 10 % 4 + 1)::INT] ELSE s_name END"


def people(spark, d) -> DataFrame:
    """Suppliers as people, some with names that are words; those with one name come twice."""
    word = F.element_at(F.lit(["May", "Grace", "Bill", "River"]), (F.floor(F.col("s_suppkey") / 10) % 4 + 1).cast("int"))
    name = F.when(F.col("s_suppkey") % 10 == 0, word).otherwise(F.col("s_name"))
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), name.alias("name"), F.concat(F.lit("of "), "s_nationkey").alias("relationship"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.concat(F.lit("Al"), "s_suppkey"))).alias("aliases"))


def registry(spark, d) -> entities.Registry:
    return entities.seed_registry(people(spark, d), t(spark, d, "part").select(F.col("p_brand").alias("name")), "work")


_PEOPLE = f"""
p AS (SELECT * FROM (SELECT {_NAME} AS name, 'of ' || s_nationkey AS relationship, CASE WHEN s_suppkey % 3 = 0 THEN 'Al' || s_suppkey END AS alias, row_number() OVER (PARTITION BY {_NAME} ORDER BY s_suppkey DESC) AS k FROM supplier) WHERE k = 1)"""


@query
def registry_seed(spark, d):
    found = registry(spark, d)
    flagged = found.ambiguous.withColumn("ambiguous", F.lit(True))
    return found.people.join(flagged, "name", "left").select("name", "type", "source", "confidence", "relationship", F.array_join("aliases", ",").alias("aliases"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


SQL["registry_seed"] = f"""
WITH {_PEOPLE} SELECT name, 'person' AS type, 'onboarding' AS source, 1.0::DOUBLE AS confidence, relationship, coalesce(alias, '') AS aliases,
lower(name) IN ({", ".join(map(quoted, AMBIGUOUS_WORDS))}) AS ambiguous FROM p"""


@query
def registry_lookup(spark, d):
    """Customers, aliases of people, brands and words of confirmed summaries."""
    known = registry(spark, d)
    summaries = t(spark, d, "part").select(F.lower("p_name").alias("word"), F.lit("concept").alias("type"), F.lit(0.8).alias("confidence"), (F.col("p_partkey") % 2 == 0).alias("confirmed"))
    known = known._replace(summaries=summaries.groupBy("word").agg(F.min("type").alias("type"), F.min("confidence").alias("confidence"), F.max("confirmed").alias("confirmed")))
    words = t(spark, d, "customer").select(F.concat(F.lit("aL"), "c_custkey").alias("word")).union(t(spark, d, "part").select(F.upper("p_brand"))).union(t(spark, d, "part").select(F.upper("p_name"))).union(t(spark, d, "supplier").select(F.lower("s_name")))
    return entities.lookup_entities(words, known)


SQL["registry_lookup"] = f"""
WITH {_PEOPLE}, w AS (SELECT DISTINCT word FROM (SELECT 'aL' || c_custkey AS word FROM customer UNION ALL SELECT upper(p_brand) FROM part UNION ALL SELECT upper(p_name) FROM part UNION ALL SELECT lower(s_name) FROM supplier)),
keys AS (SELECT lower(k) AS k, min(name) AS name FROM (SELECT name AS k, name FROM p UNION ALL SELECT alias, name FROM p WHERE alias IS NOT NULL) GROUP BY lower(k)),
b AS (SELECT lower(p_brand) AS k, min(p_brand) AS name FROM part GROUP BY lower(p_brand)),
s AS (SELECT lower(p_name) AS k FROM part GROUP BY lower(p_name) HAVING bool_or(p_partkey % 2 = 0))
SELECT w.word, coalesce(keys.name, b.name, s.k, w.word) AS name, CASE WHEN keys.k IS NOT NULL THEN 'person' WHEN b.k IS NOT NULL THEN 'project' WHEN s.k IS NOT NULL THEN 'concept' ELSE 'unknown' END AS type,
       CASE WHEN keys.k IS NOT NULL OR b.k IS NOT NULL THEN 1.0 WHEN s.k IS NOT NULL THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence,
       CASE WHEN keys.k IS NOT NULL OR b.k IS NOT NULL THEN 'onboarding' WHEN s.k IS NOT NULL THEN 'wiki' ELSE 'inferred' END AS source
FROM w LEFT JOIN keys ON keys.k = lower(w.word) LEFT JOIN b ON b.k = lower(w.word) LEFT JOIN s ON s.k = lower(w.word)"""


@query
def registry_totals(spark, d):
    return entities.registry_summary(registry(spark, d))


SQL["registry_totals"] = f"WITH {_PEOPLE} SELECT (SELECT count(*) FROM p) AS people, (SELECT count(DISTINCT p_brand) FROM part) AS projects, 'work' AS mode"


@query
def registry_documents(spark, d):
    """Registries as JSON documents, one for each fifty suppliers, written and read."""
    path = shared_path(spark, "registries")
    person = F.struct(F.lit("person").alias("type"), F.lit("seen").alias("source"), (F.col("s_suppkey") % 5 / 4).alias("confidence"), F.concat(F.lit("of "), "s_nationkey").alias("relationship"), F.array(F.concat(F.lit("Al"), "s_suppkey")).alias("aliases"))
    rows = t(spark, d, "supplier").select(F.floor(F.col("s_suppkey") / 50).alias("part"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 > 0, person).otherwise(F.from_json(F.lit("{}"), "type string, source string, confidence double, relationship string, aliases array<string>")).alias("p"))
    made = F.struct(F.lit("work").alias("mode"), F.map_from_entries(F.collect_list(F.struct("name", "p"))).alias("people"), F.collect_list("name").alias("projects"))
    rows.groupBy("part").agg(F.to_json(made).alias("value")).write.partitionBy("part").text(path)
    found = files.read_registry(spark, path)
    return found.people.join(found.projects, "name").select("name", "type", "source", "confidence", "relationship", F.array_join("aliases", ",").alias("aliases"), F.lit(found.mode).alias("mode"))


SQL["registry_documents"] = """
SELECT s_name AS name, 'person' AS type, CASE WHEN s_suppkey % 4 > 0 THEN 'seen' END AS source, (CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 5) / 4 ELSE 1.0 END)::DOUBLE AS confidence,
       CASE WHEN s_suppkey % 4 > 0 THEN 'of ' || s_nationkey END AS relationship, CASE WHEN s_suppkey % 4 > 0 THEN 'Al' || s_suppkey ELSE '' END AS aliases, 'work' AS mode FROM supplier"""


@query
def summary_classes(spark, d):
    return entities.classified_summaries(t(spark, d, "documents").select(F.concat(F.lit("w"), "doc_id").alias("word"), F.concat("text", F.when(F.col("doc_id") % 9 == 0, " its Name").when(F.col("doc_id") % 9 == 1, " a CITY").otherwise("")).alias("summary")))


SQL["summary_classes"] = """
WITH x AS (SELECT doc_id, lower(text || CASE doc_id % 9 WHEN 0 THEN ' its Name' WHEN 1 THEN ' a CITY' ELSE '' END) AS s FROM documents)
SELECT 'w' || doc_id AS word, CASE WHEN contains(s, 'name') THEN 'person' WHEN contains(s, 'city') OR contains(s, 'country') THEN 'place' ELSE 'concept' END AS type, 0.8::DOUBLE AS confidence, false AS confirmed FROM x"""


@query
def decoded_records(spark, d):
    """Lines of the dialect made of the documents' fields; of two headers and arcs the last counts."""
    line = F.concat(F.lit("f"), "doc_id", F.lit("|A+B|"), "lang", F.lit("|old\n0:ABC|topic|"), "source", F.lit("\nT:1<->2|x\nnothing here\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("g|"), "source", F.lit("|2026|title|more\n"))).otherwise(""), F.lit("ARC:rise\n1:DEF|x\n"), F.when(F.col("doc_id") % 3 == 0, F.lit("ARC:fall and "),).otherwise(""), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(""))
    rows = extract.decode(t(spark, d, "documents").select("doc_id", line.alias("compressed")))
    return rows.select("doc_id", "header.file", "header.entities", "header.date", "header.title", "arc", F.array_join("records", ";").alias("records"), F.array_join("tunnels", ";").alias("tunnels"))


SQL["decoded_records"] = """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'g' ELSE 'f' || doc_id END AS file, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'A+B' END AS entities, CASE WHEN doc_id % 2 = 0 THEN '2026' ELSE lang END AS date,
       CASE WHEN doc_id % 2 = 0 THEN 'title' ELSE 'old' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'fall and ' || lang ELSE 'rise' END AS arc, '0:ABC|topic|' || source || ';1:DEF|x' AS records, 'T:1<->2|x' AS tunnels FROM documents"""


@query
def decoded_texts(spark, d):
    """What `compress` writes of whole texts, read back: its header and its record."""
    docs = spoken(t(spark, d, "documents")).withColumns({"wing": F.concat(F.lit("w"), (F.col("doc_id") % 2).cast("string")), "room": F.lit("r"), "date": F.lit("2026-01-01"), "source_file": F.concat(F.lit("/a/f"), "doc_id", F.lit(".md"))})
    rows = extract.decode(extract.compress(docs))
    return rows.select("doc_id", "header.file", "header.entities", "header.date", "header.title", F.size("records").cast("long").alias("n_records"), F.array_join("records", ";").alias("records"))


SQL["decoded_texts"] = f"""
WITH {sql_compressed(_SPOKEN, "''")}
SELECT doc_id, 'w' || (doc_id % 2) AS file, 'r' AS entities, '2026-01-01' AS date, 'f' || doc_id AS title, 1::BIGINT AS n_records, compressed AS records FROM comp"""
_CODES = {"BUILDING": "BLD", "Auto": "AUT", "mach": "MCH", "000000012": "TWL"}


@query
def encoded_names(spark, d):
    """By exact name, lower case, a known part, or the first letters; skipped names give null."""
    rows = t(spark, d, "customer")
    return rows.select("c_custkey", extract.encode_entity("c_mktsegment", _CODES, ("house",)).alias("segment"), extract.encode_entity("c_name", _CODES).alias("name"))


SQL["encoded_names"] = """
SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'house') THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'BLD' WHEN contains(lower(c_mktsegment), 'building') THEN 'BLD' WHEN contains(lower(c_mktsegment), 'auto') THEN 'AUT' WHEN contains(lower(c_mktsegment), 'mach') THEN 'MCH' ELSE upper(substr(c_mktsegment, 1, 3)) END AS segment,
       CASE WHEN contains(c_name, '000000012') THEN 'TWL' ELSE upper(substr(c_name, 1, 3)) END AS name FROM customer"""
_FEELINGS = ("joy", "joyful", "rage", "serenity", "anger", "hope")
_FELT = "[" + ", ".join(quoted(EMOTION_CODES.get(x, x[:4])) for x in _FEELINGS) + "]"


@query
def encoded_feelings(spark, d):
    three = F.array(*(F.element_at(F.lit(list(_FEELINGS)), (F.floor(F.col("event_id") / k) % 6 + 1).cast("int")) for k in (1, 6, 36, 216)))
    return t(spark, d, "events").select("event_id", extract.encode_emotions(three).alias("feelings"))


SQL["encoded_feelings"] = f"""
WITH x AS (SELECT event_id, [{_FELT}[(event_id % 6 + 1)::INT], {_FELT}[(event_id // 6 % 6 + 1)::INT], {_FELT}[(event_id // 36 % 6 + 1)::INT], {_FELT}[(event_id // 216 % 6 + 1)::INT]] AS f FROM events)
SELECT event_id, array_to_string((list_filter(f, lambda c, i: list_position(f, c) = i))[1:3], '+') AS feelings FROM x"""


@query
def encoded_records(spark, d):
    rows = t(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("rec-x-"), "o_orderkey").alias("id"), F.array(F.concat(F.lit("Kim"), "o_orderstatus"), F.lit("Ada"), F.concat(F.lit("kim"), "o_orderstatus")).alias("people"),
        F.when(F.col("o_orderkey") % 3 > 0, F.array("o_orderpriority", F.lit("b"), F.lit("c"))).otherwise(F.lit([]).cast("array<string>")).alias("topics"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("joy"), F.lit("dark_humor"))).alias("emotional_tone"),
    )
    return extract.encode_record(rows, {"Ada": "ADA"}).select("o_orderkey", "encoded")


SQL["encoded_records"] = """
SELECT o_orderkey, o_orderkey || ':ADA+KIM|' || CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority || '_b' ELSE 'misc' END || '|"test quote"|0.5' || CASE WHEN o_orderkey % 2 = 0 THEN '|joy+humor' ELSE '' END AS encoded FROM orders"""


@query
def encoded_tunnels(spark, d):
    label = F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderpriority", F.lit(": of "), "o_orderstatus")).when(F.col("o_orderkey") % 3 == 1, F.lit("a label of many more than thirty characters"))
    rows = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("a-"), "o_orderkey").alias("from_id"), F.concat(F.lit("b-c-"), "o_custkey").alias("to_id"), label.alias("label"))
    return extract.encode_tunnel(rows).select("o_orderkey", "encoded")


SQL["encoded_tunnels"] = "SELECT o_orderkey, 'T:' || o_orderkey || '<->' || o_custkey || '|' || CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN substr('a label of many more than thirty characters', 1, 30) ELSE '' END AS encoded FROM orders"


@query
def embedded_texts(spark, d):
    """Vectors by a function of the caller's; rows that have one keep it."""
    of = lambda texts: np.array([[len(x), x.count("e")] for x in texts], dtype=np.float32).reshape(-1, 2)
    own = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0.5).cast("float"), F.lit(2.0).cast("float")))
    rows = similarity.embed(t(spark, d, "documents").select("doc_id", "text", own.alias("vector")), "text", of)
    return rows.select("doc_id", F.col("vector")[0].cast("double").alias("x"), F.col("vector")[1].cast("double").alias("y"))


SQL["embedded_texts"] = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE length(coalesce(text, '')) END::DOUBLE AS x, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) END::DOUBLE AS y FROM documents"


def held_texts(spark, d) -> DataFrame:
    """The vectors' drawers: those with a document of their number have its text."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.concat(F.lit("/d/f"), "doc_id", F.lit(".txt")).alias("source_file"))
    rows = vectors(spark, d).select("id", "wing", F.when(F.col("label") % 2 == 0, "even").alias("room"))
    return rows.join(docs, "id", "left").withColumn("content", F.coalesce("content", F.lit("none")))


_RENDERED = """
r AS (SELECT n.query_id, n.rank, '  [' || n.rank || '] w' || e.label || '/' || CASE WHEN e.label % 2 = 0 THEN 'even' ELSE '?' END || ' (sim=' || n.similarity || ')' || chr(10) || '      ' ||
      CASE WHEN length(c) > 300 THEN substr(c, 1, 297) || '...' ELSE c END || CASE WHEN d.doc_id IS NOT NULL THEN chr(10) || '      src: f' || d.doc_id || '.txt' ELSE '' END AS line
      FROM found n JOIN embeddings e ON e.vec_id = n.id LEFT JOIN documents d ON d.doc_id = n.id, LATERAL (SELECT replace(coalesce(d.text, 'none'), chr(10), ' ') AS c))
SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS text FROM r GROUP BY query_id"""


@query
def rendered_results(spark, d):
    found = similarity.topk(vectors(spark, d).select("id", "vector"), searchers(spark, d), 3)
    return similarity.render_results(found, held_texts(spark, d))


SQL["rendered_results"] = f"WITH {_NEAR}, found AS (SELECT * FROM near WHERE rank <= 3), {_RENDERED}"


@query
def deep_search(spark, d):
    """The search of one vector in a wing, rendered."""
    one = t(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]
    found = similarity.search(vectors(spark, d), one, 5, "w3").select(F.lit(7).cast("long").alias("query_id"), "id", "similarity")
    ranked = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("less"), "id"))).alias("x")).select("query_id", F.posexplode("x").alias("rank", "x"))
    return similarity.render_results(ranked.select("query_id", (F.col("rank") + 1).alias("rank"), "x.id", (-F.col("x.less")).alias("similarity")), held_texts(spark, d))


SQL["deep_search"] = f"""
WITH found AS (SELECT 7::BIGINT AS query_id, b.vec_id AS id, {_SIM} AS similarity, row_number() OVER (ORDER BY {_SIM} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.label = 3 QUALIFY rank <= 5), {_RENDERED}"""


@query
def mean_metrics(spark, d):
    rows = evaluate.mean_metrics(twentieth_metrics(spark, d))
    return rows.select(*(F.round(c, 6).alias(c) for c in ("recall_any", "recall_all", "ndcg")), "questions")


SQL["mean_metrics"] = f"SELECT round(avg(recall_any), 6) AS recall_any, round(avg(recall_all), 6) AS recall_all, round(avg(ndcg), 6) AS ndcg, count(*) AS questions FROM ({_TWENTIETH_METRICS})"


@query
def identities(spark, d):
    """The identity text before the first lines of each wing's listing, and its tokens."""
    rows = t(spark, d, "documents").groupBy(F.col("source").alias("wing")).agg(F.count("*").alias("n"))
    own, none = drawers.identity_text("  I am the store. \n"), drawers.identity_text(" ")
    text = F.when(F.col("wing") == "src1", none).otherwise(own)
    return rows.select("wing", "n", text.alias("text"), drawers.identity_tokens(text).alias("tokens"))


SQL["identities"] = "SELECT source AS wing, count(*) AS n, CASE WHEN source = 'src1' THEN '## L0 — IDENTITY' || chr(10) || 'No identity configured.' ELSE 'I am the store.' END AS text, (CASE WHEN source = 'src1' THEN 40 ELSE 15 END // 4)::BIGINT AS tokens FROM documents GROUP BY source"


@query
def compactions(spark, d):
    rows = t(spark, d, "events").select(F.concat(F.lit("s/"), "user_id").alias("session_id"), F.when(F.col("event_type") == "error", "compaction").otherwise(F.col("event_type")).alias("event"), F.col("event_id").alias("ts"))
    return jobs.compaction_checkpoints(rows)


SQL["compactions"] = "SELECT 's' || user_id AS session_id, event_id AS ts FROM events WHERE event_type = 'error'"


@query
def streamed_files(spark, d):
    """Documents as a stream of files, mined into a store that has every fourth already, and again, when nothing is new."""
    path, name = shared_path(spark, "mined"), F.concat(F.lit("/s/"), "doc_id", F.lit(".md"))
    rows = materialize(t(spark, d, "documents").select(F.concat(F.lit("notes/"), "doc_id", F.lit(".md")).alias("rel_path"), name.alias("source_file"), (F.col("n_chars") + 1.0).alias("source_mtime"), "text"), "incoming")
    drawers.append_drawers(rows.where("cast(regexp_extract(source_file, '([0-9]+)', 1) as long) % 4 = 0").select("source_file", "source_mtime", F.lit("old").alias("id"), F.lit("w").alias("wing")), path)
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(rows._shared_path)
        jobs.mine_stream(stream, lambda: drawers.read_drawers(spark, path), path, shared_path(spark, f"from-{k}"), "w").awaitTermination()
    stored = drawers.read_drawers(spark, path).where("id <> 'old'")
    return stored.groupBy("source_file").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.length("content")).cast("long").alias("n_chars"), F.min("room").alias("room"))


SQL["streamed_files"] = f"""
WITH c AS ({SQL["fixed_chunks"]})
SELECT '/s/' || doc_id || '.md' AS source_file, count(*) AS n, count(*) AS ids, sum(length(content))::BIGINT AS n_chars, 'documentation' AS room FROM c WHERE doc_id % 4 > 0 GROUP BY doc_id"""


@query
def streamed_triples(spark, d):
    """Orders as a stream of triples, then the closings of every second customer's."""
    path = shared_path(spark, "streamed")
    files.write_kg(*empty_kg(spark), f"{path}/v0")
    rows = materialize(kg_rows(spark, d), "triples")
    jobs.kg_stream(spark.readStream.schema(rows.schema).parquet(rows._shared_path), path, f"{path}/adds").awaitTermination()
    ends = t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("Customer #"), "c_custkey").alias("subject"), F.lit("has 1-URGENT").alias("predicate"), F.lit("Status O").alias("object"), F.lit("").alias("ended"))
    ends = materialize(ends, "closings")
    jobs.kg_stream(spark.readStream.schema(ends.schema).parquet(ends._shared_path), path, f"{path}/ends", closings=True, today="2026-01-01").awaitTermination()
    return jobs.latest_kg(spark, path)[1].select("id", "valid_from", "valid_to")


SQL["streamed_triples"] = SQL["kg_invalidate"].replace("SELECT id, CASE WHEN valid_to IS NULL", "SELECT id, valid_from, CASE WHEN valid_to IS NULL")

@query
def stateful_triples(spark, d):
    """The same by states of buckets of triples, in two runs of one stream: the second goes on from the checkpoint and reads neither the
    store nor what the first one wrote."""
    path = shared_path(spark, "keyed")
    events = kg_rows(spark, d).withColumn("ended", F.lit(None).cast("string")).select("seq", "subject", "predicate", "object", "valid_from", "valid_to", "ended")
    ends = t(spark, d, "customer").where("c_custkey % 2 = 0")
    closing = ends.select((F.col("c_custkey") + (1 << 40)).alias("seq"), F.concat(F.lit("Customer #"), "c_custkey").alias("subject"), F.lit("has 1-URGENT").alias("predicate"), F.lit("Status O").alias("object"), *(F.lit(None).cast("string").alias(c) for c in ("valid_from", "valid_to")), F.lit("").alias("ended"))
    for rows in (events, closing):
        rows.select([F.col(c).cast(k) for c, k in events.dtypes]).write.mode("append").parquet(f"{path}/in")
        with jobs.keyed_state(spark):
            jobs.keyed_triples(spark.readStream.schema(events.schema).parquet(f"{path}/in"), path, f"{path}/state", today="2026-01-01").awaitTermination()
    return jobs.logged_triples(spark, path).select("id", "valid_from", "valid_to")


SQL["stateful_triples"] = SQL["streamed_triples"]


@query
def idle_checkpoints(spark, d):
    """Events in four runs of one stream, in the order of time, each from the checkpoint of the one before: sessions end after six
    idle hours, by event time."""
    path, idle = shared_path(spark, "sessions"), 6 * 3_600_000
    rows = t(spark, d, "events").select(F.concat(F.lit("s/"), F.col("user_id").cast("string")).alias("session_id"), F.when(F.col("event_type") == "error", "assistant").otherwise("user").alias("role"), F.col("event_type").alias("content"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    cuts = rows.select(F.unix_millis("ts").alias("ms")).approxQuantile("ms", [0.25, 0.5, 0.75], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        at = F.unix_millis("ts")
        part = rows.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.write.mode("append").parquet(f"{path}/in")
        made = jobs.save_checkpoints(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), 3, idle_ms=idle)
        with jobs.keyed_state(spark):
            sink = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
            sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(jobs.CHECKPOINT).parquet(f"{path}/out")


SQL["idle_checkpoints"] = """
WITH e AS (SELECT user_id, ts, event_id, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events WHERE event_type <> 'error'),
c AS (SELECT *, count(*) FILTER (gap > 21600000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM e)
SELECT 's' || user_id AS session_id, n, 3::BIGINT AS since_last FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS n FROM c) WHERE n % 3 = 0"""


@query
def mined_once(spark, d):
    """Documents as a stream of files into a store of versions; then a run without the checkpoint delivers the same micro-batch again."""
    path, name = shared_path(spark, "once"), F.concat(F.lit("/s/"), "doc_id", F.lit(".md"))
    store = versions.DrawerStore(spark, path).create()
    rows = materialize(t(spark, d, "documents").select(F.concat(F.lit("notes/"), "doc_id", F.lit(".md")).alias("rel_path"), name.alias("source_file"), (F.col("n_chars") + 1.0).alias("source_mtime"), "text"), "incoming")
    for k in range(2):
        jobs.mine_into(spark.readStream.schema(rows.schema).parquet(rows._shared_path), store, f"{path}/from-{k}", "w", "files").awaitTermination()
    stored = store.read().groupBy("source_file").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.length("content")).cast("long").alias("n_chars"))
    return stored.withColumn("last_version", F.lit(store.versions()[-1]).cast("long"))


SQL["mined_once"] = f"""
WITH c AS ({SQL["fixed_chunks"]})
SELECT '/s/' || doc_id || '.md' AS source_file, count(*) AS n, count(*) AS ids, sum(length(content))::BIGINT AS n_chars, 1::BIGINT AS last_version FROM c GROUP BY doc_id"""


@query
def versioned_store(spark, d):
    """Documents appended; the German ones upserted with another room; the toxic ones deleted. Each version is read; a wing that a
    change doesn't touch keeps its folder."""
    store = versions.DrawerStore(spark, shared_path(spark, "versions")).create()
    rows = filed_documents(spark, d).withColumns({"wing": F.col("room"), "filed_at": F.lit("1")})
    store.append(rows)
    store.upsert(rows.where("wing = 'de'").withColumns({"room": F.lit("new"), "filed_at": F.lit("2")}))
    store.delete(t(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("id")))
    out = None
    for n in store.versions()[1:]:
        kept = spark.createDataFrame([(wing, folder in dict(store.folders(1))) for folder, wing in store.folders(n)], "wing string, first boolean")
        part = store.read(n).groupBy("wing", "room").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("n_chars")).join(kept, "wing")
        part = part.select(F.lit(n).cast("long").alias("version"), "wing", "room", "n", "n_chars", "first")
        out = part if out is None else out.unionByName(part)
    return out


SQL["versioned_store"] = """
WITH x AS (SELECT 'd' || doc_id AS id, lang AS wing, coalesce(text, '') AS content, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone FROM documents),
hit AS (SELECT wing, bool_or(gone) AS hit FROM x GROUP BY wing),
v AS (SELECT 1 AS version, wing, wing AS room, content, true AS first FROM x
UNION ALL SELECT 2, wing, CASE wing WHEN 'de' THEN 'new' ELSE wing END, content, wing <> 'de' FROM x
UNION ALL SELECT 3, x.wing, CASE x.wing WHEN 'de' THEN 'new' ELSE x.wing END, content, x.wing <> 'de' AND NOT hit FROM x JOIN hit ON hit.wing = x.wing WHERE NOT gone)
SELECT version::BIGINT AS version, wing, room, count(*) AS n, sum(length(content))::BIGINT AS n_chars, first FROM v GROUP BY ALL"""


@query
def wake_up(spark, d):
    return drawers.wake_up(document_drawers(spark, d), "I am the store.")


SQL["wake_up"] = f"WITH {L1} SELECT wing, 'I am the store.' || chr(10) || chr(10) || text AS text FROM story"


@query
def many_names(spark, d):
    """Every document's first word as a registered name, if it has a capital and four letters; the codes of those that stand in each document."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    names = docs.select(F.regexp_extract("text", "^([A-Z][a-z]{3,})", 1).alias("name")).where("name <> ''").distinct()
    names = names.select("name", F.upper(F.substring("name", 1, 4)).alias("code"), F.col("name").alias("seq"))
    found = entities.registered_codes(docs, names)
    return found.select("doc_id", F.size("codes").cast("long").alias("n_codes"), F.array_join(F.slice("codes", 1, 5), "+").alias("codes")).where("length(codes) > 3 and substring(codes, 4, 1) <> '+'")


SQL["many_names"] = """
WITH n AS (SELECT DISTINCT regexp_extract(text, '^([A-Z][a-z]{3,})', 1) AS name FROM documents WHERE regexp_matches(text, '^[A-Z][a-z]{3,}')),
h AS (SELECT doc_id, upper(substr(name, 1, 4)) AS code, min(name) AS seq FROM documents JOIN n ON contains(lower(text), lower(name)) GROUP BY ALL),
k AS (SELECT doc_id, list(code ORDER BY seq) AS codes FROM h GROUP BY doc_id)
SELECT doc_id, len(codes)::BIGINT AS n_codes, array_to_string(codes[1:5], '+') AS codes FROM k"""
