"""The operators' queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import bpe, chat, decontaminate, packing, periodic_runs, pii, quality_model, quality_rules, sharding, simhash, spelling, token_counts, toxicity

CONTROL_CASE = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return whole.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "fail_bits")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.canonical_table(table(spark, sf_dir, "conversations"))
    case = '{"messages": [' + ", ".join(f'{{"role": "{r}", "content": "{CONTROL_CASE}"}}' for r in ("user", "assistant")) + "]}"
    one = chat.canonical_json(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(case).alias("record"))).drop("record")
    read = chat.read_back(chat.format_turns(rows.unionByName(one)))
    told = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))


def planted_misspellings(doc_id: str, words: list[str]) -> list[str]:
    """The words of a document; of those whose checksum with its id 199 divides, one letter is missing."""
    begun, out = zlib.crc32(f"{doc_id}:".encode()), []
    for word in words:
        h = zlib.crc32(word.encode(), begun)
        out.append(word if h % 199 else word[: (at := h % len(word))] + word[at + 1 :])
    return out


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), change=planted_misspellings)


def planted_repeats(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text), of which every tenth (by the checksum of its id) has its words from a place on repeated from there."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    some = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    cut = some.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = n - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    whole = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest))
    return cut.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(whole, " ")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # The greatest length; of equal ones the smallest start, then period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.expr("(1000 * best.length) div (-best.less)").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_toxicity, op3_simhash, op4_quality_rules, op5_decontaminate, op6_quality_model, op7_sharding, op8_chat, op9_token_counts, op10_packing, op11_pii, op12_spelling, op13_periodic_runs)
}

_BLANK = "[\\x20\\x09-\\x0D]"
SQL: dict[str, str] = {
    "op4_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         length(regexp_replace(t, '{_BLANK}+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN rep r ON r.doc_id = b.doc_id),
f AS (
  SELECT *, n_words < 10 AS f0, 100 * n_repeat_words > 20 * n_words AS f1, 10 * n_symbols > 3 * n_words AS f2,
         n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines AS f3, word_chars < 2 * n_words AS f4, word_chars > 20 * n_words AS f5
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
       f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5) AS kept,
       (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT)::BIGINT AS fail_bits
FROM f""",
    "op5_decontaminate": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM p),
win AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT win.doc_id, win.i, win.k, p.item_id FROM win JOIN p ON win.k = p.k AND win.g = p.g),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
    "op8_chat": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(text, chr(92), repeat(chr(92), 2)), '<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|\\[ROLE\\]|\\[/ROLE\\]', '\\0x', 'g')) AS body,
         length(regexp_replace(replace(role, chr(92), repeat(chr(92), 2)), '<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|\\[ROLE\\]|\\[/ROLE\\]', '\\0x', 'g')) AS name
  FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(body + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 7 WHEN 'system' THEN 22 ELSE 20 + name END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    # The checksum is worked out byte by byte with its table; letters past ASCII are two bytes, 195 and the code point less 64.
    "op12_spelling": """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS i))),
run AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY doc_id, w),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(
           list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))),
           lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]))) AS h
  FROM run, crc),
v AS (
  SELECT w, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
cut AS (SELECT w, n, k, left(w, k - 1) AS a, substr(w, k + 1) AS b FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS k FROM v)),
near AS (
  SELECT x.w, y.w AS o, y.n AS m FROM cut x JOIN cut y ON x.k = y.k AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION SELECT cut.w, v.w, v.n FROM cut JOIN v ON cut.a || cut.b = v.w
  UNION SELECT v.w, cut.w, cut.n FROM cut JOIN v ON cut.a || cut.b = v.w),
best AS (SELECT w, count(*) AS n_near, first(o ORDER BY m DESC, o) AS o, max(m) AS m FROM near GROUP BY w),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN o END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN best ON best.w = v.w),
walk(w, place) AS (SELECT w, w FROM f UNION ALL SELECT walk.w, f.form FROM walk JOIN f ON f.w = walk.place WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, walk.place AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON walk.w = f.w JOIN f AS last ON last.w = walk.place WHERE last.form IS NULL""",
}
