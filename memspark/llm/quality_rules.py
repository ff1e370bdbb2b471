"""Quality rules as a ledger of bits, by DataFrame functions only.

Every rule is evaluated once: `measure` writes the measurements, `ledger` one failure bit per rule. Policies are versioned
masks over those bits, so a new policy, its verdicts and its ablations come from the ledger alone, by bitwise
aggregation, and never from the texts again.

A null text has no words and no lines; an empty or blank one likewise. Equal rows give equal rows. Columns of `df` that have
a measurement's name are replaced. An empty table gives an empty table; the longest text is measured whole.

Windows are compared by 64-bit hashes within one text: for a text of n windows the chance of a wrong match is below
n^2 / 2^65, one in 10^11 for 20,000 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Names that `measure` uses in between.
INTERNAL = ("__words", "__lines", "__n", "__n_lines", "__n_dup", "__hashes", "__sorted")
#: (name, fails) in bit order; the first two are the base rules.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_dup_lines >= 3 and 2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
#: Rules of each policy version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(x) for x in POLICIES[policy])


def measure(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines and n_repeat_words (long)."""
    aside = {c: f"{c}_of_input" for c in df.columns if c.lower() in INTERNAL}
    df = df.withColumnsRenamed(aside)
    body = F.coalesce(F.col(text), F.lit(""))
    word = lambda i: F.get("__words", i)
    df = df.withColumns(
        {
            "__words": F.array_remove(F.split(body, BLANKS), ""),
            "__lines": F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\r\x0b\x0c", "")) > 0),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]+", ""))).cast("long"),
            "word_chars": F.length(F.regexp_replace(body, BLANKS, "")).cast("long"),
        }
    )
    n = F.size("__words")
    hashes = F.transform(F.slice("__words", 1, F.greatest(n - (window - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(word(i + k) for k in range(1, window))))
    df = df.select(
        "*",
        n.cast("long").alias("__n"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup"),
        hashes.alias("__hashes"),
    ).drop("__words", "__lines")
    repeated = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    placed = F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.select("*", F.when(repeated, placed).alias("__sorted")).drop("__hashes")
    at = lambda i: F.get("__sorted", i)["h"]
    twice = F.filter("__sorted", lambda x, i: at(i - 1).eqNullSafe(x["h"]) | at(i + 1).eqNullSafe(x["h"]))
    places = F.array_sort(F.transform(twice, lambda x: x["p"]))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    add = lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(a["end"], p)).alias("n"))
    covered = F.aggregate(places, none, add, lambda a: a["n"])
    made = F.struct(
        F.col("__n").alias("n_words"),
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dup").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("__sorted").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # A generator of one row: what filters on the measurements later can't copy their expressions.
    kept = [c for c in df.columns if c not in ("__n", "__n_lines", "__n_dup", "__sorted", "n_words", "n_lines", "n_dup_lines", "n_repeat_words")]
    return df.select(*kept, F.inline(F.array(made))).withColumnsRenamed({new: old for old, new in aside.items()})


def ledger(measured: DataFrame) -> DataFrame:
    """With ``fail_bits`` (long): bit i is set where rule i fails."""
    bits = [F.when(F.expr(fails), F.lit(1 << i)).otherwise(0) for i, (_, fails) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("fail_bits", total.cast("long"))


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """With ``base_failed``, ``kept`` and ``policy``."""
    return ledger_rows.withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy), "policy": F.lit(policy)})


def ablations(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, failed, only_this, kept_without): how many documents each rule of a policy fails, fails alone, and how many
    would be kept without it. The rows are first counted by their bits, of which there are at most 2^rules."""
    whole = mask(policy)
    counted = ledger_rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    names = [name for name, _ in RULES]
    rules = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(1 << names.index(x)).alias("bit")) for x in POLICIES[policy]))).alias("r")
    hit = F.col("fail_bits").bitwiseAND(F.lit(whole))
    one = F.col("r.bit")
    return (
        counted.select("fail_bits", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit.bitwiseAND(one) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(hit == one, F.col("n")).otherwise(0)).alias("only_this"),
            F.sum(F.when((hit == 0) | (hit == one), F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def judge(df: DataFrame, text: str = "text", policy: str = "v1") -> DataFrame:
    """Measurements, failure bits and the verdict of a policy for every row of ``df``."""
    return apply_policy(ledger(measure(df, text)), policy)
