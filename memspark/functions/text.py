"""Text helpers whose results don't depend on the regex engine's own ideas of blanks and word boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: A boundary of ASCII word characters; Java's own \b takes accented letters for word characters.
BOUNDARY = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_trim(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


def ascii_words(pattern: str) -> str:
    return pattern.replace("\\b", BOUNDARY)


def any_of(patterns) -> str:
    """One case-insensitive alternation. Of patterns that begin at a boundary before a word character, the boundary is looked
    at once, and those that begin with one letter stand together behind it, so that few are tried at a place."""
    begun = [p[2:] for p in patterns if p.startswith("\\b") and (p[2:3].isalnum() or p[2:4] == "\\d" or p[2:3] == "(")]
    rest = [p for p in patterns if p[2:] not in begun]
    plain = [p for p in begun if p[0].isalpha() and p[1:2] not in ("?", "*", "+", "{", "")]
    letters = {p[0].lower(): [q[1:] for q in plain if q[0].lower() == p[0].lower()] for p in plain}
    grouped = [f"{first}(?:{'|'.join(map(ascii_words, ends))})" for first, ends in letters.items()]
    begun = grouped + [ascii_words(p) for p in begun if p not in plain]
    parts = [f"(?<!\\w)(?:{'|'.join(begun)})"] if begun else []
    return "(?i)" + "|".join(parts + [f"(?:{ascii_words(p)})" for p in rest])


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.lit([]).cast("array<string>")


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def runs(items: Column, key: str, f) -> Column:
    """f of each group of the structs with equal ``key``, their first field, in sorted order: an array is sorted and cut where
    the key changes, so a row's groups are made in the row."""

    def cut(ordered: Column) -> Column:
        changed = lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1)[key] != x[key]), i)
        starts = F.filter(F.transform(ordered, changed), lambda i: i.isNotNull())
        return bound(starts, lambda s: F.transform(s, lambda at, n: bound(F.slice(ordered, at + 1, F.coalesce(F.get(s, n + 1), F.size(ordered)) - at), f)))

    return bound(F.sort_array(items), cut)


def contained(lowered: Column, keywords) -> Column:
    """How many of the keywords stand in the text."""
    total = F.lit(0)
    for k in keywords:
        total = total + lowered.contains(k).cast("int")
    return total


def best_scored(scores: list[tuple[str, Column]], default: Column | str) -> Column:
    """The name with the highest positive score; the first of equals."""
    ranked = F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores)))
    otherwise = default if isinstance(default, Column) else F.lit(default)
    return bound(F.array_max(ranked), lambda best: F.when(best["score"] > 0, best["name"]).otherwise(otherwise))


def snippet(text: Column | str, most: int = 300) -> Column:
    text = as_column(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def base_name(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def stem(path: Column | str) -> Column:
    """The file name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), "(?<=.)\\.[^.]*$", "")


def or_default(value: Column | str, default) -> Column:
    """The default for null, '' and 0."""
    value = as_column(value)
    return F.coalesce(F.nullif(value, F.lit("" if isinstance(default, str) else 0)), F.lit(default))
