"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and scores of the words around each hit.

1. The lexicon is learned from labelled rows of the training folds: words, and beginnings of words, that stand almost only
   in toxic texts, outside quotation marks; a term's weight is the share of them. Words of clean texts that lie within the
   edits of a term are kept as exceptions; a term that lies among many such words (`CROWD`) gets no edits.
2. The Levenshtein automaton of the lexicon's trie reads a word letter by letter. A state is a set of places in the trie,
   each with the edits spent so far; two letters that changed places are one edit. It accepts terms within 0 edits (of terms
   under 5 letters), 1, or 2 (from 9 letters), and beginnings within as many before any rest of the word. States are made
   when a word first needs them and are kept, so most letters of most words are one look-up. Digits and signs that
   stand for letters are read as those, too, and signs inside a word are also left out.
3. Each hit has a severity: the term's weight, less for every edit, less inside quotation marks or after a verb of saying
   within the window, more beside a word of address. A text's severities give four numbers to a small logistic model.

At most `MOST_LABELLED` labelled rows (by a hash of the id) are learned from; every text is scored whole. What bounds the
lexicon is evidence, not a count: a term must stand in at least `LEAST` toxic texts of the sample, after `CONTEXTS` different
words, and be so much likelier in toxic texts that chance would give its counts less than once in a million (`EVIDENCE`).
Words of over 40 letters aren't learned. Without labelled rows of both kinds every score is 0.

Null, empty and wordless texts score as texts without hits. Repeated rows get equal scores; in the model's fit, rows of one
id count once. Of equally good terms the first by name counts. An empty table gives an empty table; the input's own columns
stay, but for those of the result's names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.batches import Memo, slices
from memspark.llm.samples import adam, first_by_hash, fold, sigmoid

MOST_LABELLED = 10_000
FOLDS, HELD_OUT = 5, 0
WINDOW = 8
LEAST, CONTEXTS = 4, 4
#: Natural logarithm of how much likelier a term's counts are at its own share of toxic texts than at the sample's.
EVIDENCE = 14.0
PREFIX = range(4, 9)
#: A term is met as it stands only if so many more words of clean texts than of toxic ones are near it.
CROWD = 3
#: States of the automaton that a worker keeps.
MOST_STATES = 100_000

LOOKALIKE = str.maketrans("013457@$!|", "oieastasii")
LETTERS = re.compile(r"[^\W\d_]+")
OPENING, CLOSING = "\"“„«‹‘'", "\"”“»›’'"
SAYING = frozenset("said says saying called calls wrote writes quoted quote quotes told sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split())
ADDRESS = frozenset("you your youre you're u ur du dich dein deine ihr tu toi ton ta vous tú tu te usted".split())


def parts(token: str) -> list[str]:
    """The words in a lower-cased token: as it stands, with look-alikes read as letters, then each without inner signs."""
    found = LETTERS.findall(token)
    if not token.isalpha():
        core = token.rstrip("!?.,;:|\"')]»”").lstrip("\"'([«“¡¿|")
        if core and not core.isalpha() and any(c.isalpha() for c in core):
            read = LETTERS.findall(core.translate(LOOKALIKE))
            for x in (*read, "".join(LETTERS.findall(core)), "".join(read)):
                if x not in found:
                    found.append(x)
    return found


def edits_for(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """Of two (weight, edits, term) the one that counts more."""
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda x: (-x[0] * 0.85 ** x[1], x[1], x[2]))


class State:
    """Places in the trie, each as node * 4 + edits, and half-read swaps; what they accept; the states after each letter."""

    __slots__ = ("begins", "ends", "next", "places", "swaps")

    def __init__(self, places: dict[int, int], swaps: frozenset):
        self.places, self.swaps = places, swaps
        self.next: dict[str, State] = {}
        self.ends = self.begins = None


class Automaton:
    """Accepts what lies within a number of edits of the terms of a trie. ``terms``: (term, edits, is a beginning, weight), or
    one term, of which ``edits`` are allowed. With ``swaps`` two neighbours that changed places are one edit."""

    def __init__(self, terms: str | list[tuple[str, int, bool, float]], edits: int = 0, swaps: bool = False):
        self.swaps = swaps
        # Terms with different numbers of edits have tries of their own, so that a place knows how many it has left.
        self.below: list[dict[str, int]] = []
        self.limit: list[int] = []
        self.ends: dict[int, tuple] = {}
        self.begins: dict[int, tuple] = {}
        roots: dict[int, int] = {}
        for term, most, beginning, weight in [(terms, edits, False, 1.0)] if isinstance(terms, str) else terms:
            node = roots[most] if most in roots else roots.setdefault(most, self.node(most))
            for c in term:
                if c not in self.below[node]:
                    self.below[node][c] = self.node(most)
                node = self.below[node][c]
            (self.begins if beginning else self.ends)[node] = (weight, term)
        self.roots = list(roots.values())
        self.known: dict[tuple, State] = {}
        self.first = self.state(self.closed({root: 0 for root in self.roots}), frozenset())

    def node(self, most: int) -> int:
        self.below.append({})
        self.limit.append(most)
        return len(self.below) - 1

    def closed(self, places: dict[int, int]) -> dict[int, int]:
        """With the places that leaving letters out of the word leads to."""
        todo = list(places.items())
        while todo:
            node, spent = todo.pop()
            if places[node] == spent < self.limit[node]:
                for child in self.below[node].values():
                    if spent + 1 < places.get(child, 99):
                        places[child] = spent + 1
                        todo.append((child, spent + 1))
        return places

    def state(self, places: dict[int, int], swaps: frozenset) -> State:
        key = (frozenset(places.items()), swaps)
        found = self.known.get(key)
        if found is None:
            found = State(places, swaps)
            for accepted, name in ((self.ends, "ends"), (self.begins, "begins")):
                best = None
                for node, spent in places.items():
                    if node in accepted:
                        best = better(best, (accepted[node][0], spent, accepted[node][1]))
                setattr(found, name, best)
            if len(self.known) >= MOST_STATES:
                # States in use live on; the others are made again when they are needed.
                for old in self.known.values():
                    old.next.clear()
                self.known.clear()
            self.known[key] = found
        return found

    def start(self) -> State:
        return self.first

    def step(self, state: State, char: str) -> State:
        out: dict[int, int] = {}
        half = []

        def put(node: int, spent: int) -> None:
            if spent < out.get(node, 99):
                out[node] = spent

        for node, spent in state.places.items():
            below = self.below[node]
            if (child := below.get(char)) is not None:
                put(child, spent)
            if spent < self.limit[node]:
                put(node, spent + 1)
                for letter, child in below.items():
                    put(child, spent + 1)
                    if self.swaps and letter != char and (last := self.below[child].get(char)) is not None:
                        half.append((last, letter, spent + 1))
        for last, letter, spent in state.swaps:
            if letter == char:
                put(last, spent)
        found = self.state(self.closed(out), frozenset(half))
        state.next[char] = found
        return found

    def edits_at_end(self, state: State) -> int | None:
        return state.ends and state.ends[1]

    def best(self, word: str) -> tuple[float, int, str] | None:
        """(weight, edits, term) of the best term for a word."""
        state, best = self.first, None
        for c in word:
            state = state.next.get(c) or self.step(state, c)
            if state.begins:
                best = better(best, state.begins)
            if not state.places and not state.swaps:
                return best
        return better(best, state.ends)


class Lexicon:
    """terms: (term, is a beginning, weight); exceptions: clean words near a term, which match terms as they stand only;
    exact: terms that are met as they stand only."""

    def __init__(self, terms: list[tuple[str, bool, float]], exceptions: set[str] = frozenset(), exact: set[str] = frozenset()):
        self.terms, self.exceptions, self.exact = terms, set(exceptions), set(exact)
        self.automaton = Automaton([(t, 0 if t in exact else edits_for(len(t)), begins, weight) for t, begins, weight in terms], swaps=True)
        self.plain = Automaton([(t, 0, begins, weight) for t, begins, weight in terms])
        self.memo = Memo(lambda tokens: [self.match(x) for x in tokens], 200_000)

    def near(self, word: str) -> tuple[float, int, str] | None:
        """(weight, edits, term) of the best term for a word."""
        return (self.plain if word in self.exceptions else self.automaton).best(word)

    def match(self, token: str) -> tuple[float, int, str] | None:
        best = None
        for word in parts(token):
            best = better(best, self.near(word))
        return best

    def hits(self, text: str | None) -> tuple[int, list[dict]]:
        """The number of words, and each hit with its severity in context."""
        tokens = (text or "").lower().split()
        self.memo.fill(set(tokens))
        get = self.memo.__getitem__
        out = []
        for i, token in enumerate(tokens):
            if (found := get(token)) is None:
                continue
            weight, edits, term = found
            quoted = self.quoted(tokens, i)
            around = tokens[max(0, i - 3) : i] + tokens[i + 1 : i + 4]
            addressed = any(x.strip(".,!?;:") in ADDRESS for x in around)
            severity = weight * 0.85**edits * (0.35 if quoted else 1.0) * (1.2 if addressed else 1.0)
            out.append({"at": i, "term": term, "edits": edits, "quoted": quoted, "severity": min(1.0, severity)})
        return len(tokens), out

    @staticmethod
    def quoted(tokens: list[str], i: int) -> bool:
        """Inside marks that open and close within the window, or told of by a verb of saying before it and marks after."""
        token = tokens[i]
        before, behind = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
        opened = token[0] in OPENING
        for x in reversed(before):
            if opened or x.rstrip(".,!?;:")[-1:] in CLOSING and len(x) > 1:
                break
            opened = x[0] in OPENING
        closed = token.rstrip(".,!?;:")[-1:] in CLOSING and len(token) > 1
        for x in behind:
            if closed or x[0] in OPENING:
                break
            closed = x.rstrip(".,!?;:")[-1:] in CLOSING
        said = any(x.strip(".,!?;:\"'") in SAYING for x in before[-3:])
        return opened and closed or said and (opened or closed)

    def features(self, text: str | None) -> list[float]:
        n, found = self.hits(text)
        severe = [x["severity"] for x in found]
        return [max(severe, default=0.0), math.log1p(sum(severe)), min(1.0, 20 * sum(severe) / max(1, n)), math.log1p(len({x["term"] for x in found}))]


class ToxicModel:
    """A lexicon and the weights of a text's four numbers."""

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, decay: float = 1e-3):
        self.lexicon = lexicon
        x = np.hstack([x, np.ones((len(x), 1))])
        share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        keep = np.array([1, 1, 1, 1, 0.0])
        self.weights = adam(lambda w: x.T @ (share * (sigmoid(x @ w) - y)) + decay * keep * w, 5, 800, 0.1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.hstack([x, np.ones((len(x), 1))]) @ self.weights)


def first_places(tokens: list[str]) -> dict[str, int]:
    """Each token's first place outside quotation, if it has one."""
    quoted: set[int] = set()
    for i in (i for i, x in enumerate(tokens) if x[0] in OPENING):
        quoted.update(j for j in range(i, min(len(tokens), i + WINDOW + 1)) if j not in quoted and Lexicon.quoted(tokens, j))
    first: dict[str, int] = {}
    for i, token in enumerate(tokens):
        if i not in quoted:
            first.setdefault(token, i)
    return first


def words_in_context(text: Column) -> Column:
    """Each distinct word that a text has outside quotation once, and one of 63 bits that the token before it gives."""

    @F.arrow_udf("array<struct<word:string,before:bigint>>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("word", pa.string()), ("before", pa.int64())]))
        for batch in batches:
            out = []
            for text in (x for part in slices(batch) for x in part):
                tokens = text.lower().split()
                found = {w: 1 << zlib.crc32((tokens[i - 1] if i else "").encode()) % 63 for token, i in first_places(tokens).items() for w in parts(token) if len(w) <= 40}
                out.append([{"word": w, "before": n} for w, n in found.items()])
            yield pa.array(out, type=kind)

    return words(text)


def learn_lexicon(sample: DataFrame, precision: float = 0.9, least: int = LEAST, evidence: float = EVIDENCE) -> Lexicon:
    """sample: (text, toxic). See the module's docstring for what makes a term. What copies of one text share stands after
    one word and is no term."""
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    base = min(0.99, max(0.01, counts.get(1, 0) / max(1, sum(counts.values()))))
    context = F.bit_or(F.when(F.col("toxic") == 1, F.col("w.before")).otherwise(0)).alias("contexts")
    seen = sample.select("toxic", F.explode(words_in_context(F.col("text"))).alias("w")).groupBy(F.col("w.word").alias("word")).agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"), context).persist()
    share = (F.col("pos") + 0.5) / (F.col("pos") + F.col("neg") + 1)
    ratio = F.col("pos") * F.log(share / base) + F.col("neg") * F.log((1 - share) / (1 - base))
    enough = (F.bit_count("contexts") >= CONTEXTS) & (F.col("pos") >= least) & (F.col("pos") >= precision * (F.col("pos") + F.col("neg"))) & (ratio >= evidence)
    # Each term has several toxic texts of the bounded sample, so that there are far fewer terms than words in those.
    words = {r["word"]: r["share"] for r in seen.where(enough & (F.length("word") >= 3)).select("word", share.alias("share")).collect()}
    begins = seen.select("pos", "neg", "contexts", F.explode(F.array(*(F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in PREFIX))).alias("begin")).where("begin is not null")
    begins = begins.groupBy("begin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_or("contexts").alias("contexts"), F.count("*").alias("forms")).where(enough)
    found = {r["begin"]: (r["pos"], r["forms"], r["share"]) for r in begins.select("begin", "pos", "forms", share.alias("share")).collect()}
    longer: dict[str, int] = {}
    for begin, (n, _, _) in found.items():
        for k in (k for k in PREFIX if k < len(begin)):
            longer[begin[:k]] = max(n, longer.get(begin[:k], 0))
    chosen: dict[str, float] = {}
    for begin, (n, forms, weight) in sorted(found.items(), key=lambda x: (len(x[0]), x[0])):
        # A beginning counts where many forms share it and none of its own longer beginnings has as many texts.
        shorter = any(found[begin[:k]][0] < 1.2 * n for k in PREFIX if k < len(begin) and begin[:k] in found)
        own = longer.get(begin, 0) < (0.6 if shorter else 0.9) * n
        if forms >= 5 and own and not any(begin[:k] in chosen for k in PREFIX if k < len(begin)):
            chosen[begin] = weight
    covered = lambda word: any(word[:k] in chosen for k in PREFIX if k <= len(word))
    terms = sorted([(w, False, n) for w, n in words.items() if not covered(w)] + [(b, True, n) for b, n in chosen.items()])

    @F.arrow_udf("string")
    def near_term(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(terms)
        for batch in batches:
            yield pa.array([x[2] if (x := lexicon.near(w)) is not None and x[1] else None for w in batch.to_pylist()], type=pa.string())

    clean = (F.col("neg") > 0) & (F.col("pos") < 0.5 * (F.col("pos") + F.col("neg")))
    near = seen.where(F.length("word") >= 4).select("word", clean.alias("clean"), near_term(F.col("word")).alias("term")).where("term is not null").collect()
    seen.unpersist()
    crowd: dict[str, int] = {}
    for r in near:
        crowd[r["term"]] = crowd.get(r["term"], 0) + (1 if r["clean"] else -1)
    return Lexicon(terms, {r["word"] for r in near if r["clean"]}, {t for t, n in crowd.items() if n >= CROWD})


def feature_column(text: Column, lexicon: Lexicon) -> Column:
    plain = (lexicon.terms, lexicon.exceptions, lexicon.exact)

    @F.arrow_udf("array<double>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Lexicon(*plain)
        for batch in batches:
            yield pa.array([own.features(x) for part in slices(batch) for x in part], type=pa.list_(pa.float64()))

    return made(text)


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELLED, folds: int = FOLDS, held_out: int = HELD_OUT) -> ToxicModel | None:
    known = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max(label).alias("toxic"))
    # The bound of the sample is the bound of what is broadcast.
    sample = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(first_by_hash(known, most, 3)), "doc_id").persist()
    try:
        lexicon = learn_lexicon(sample)
        made = sample.select("doc_id", "toxic", feature_column(F.col("text"), lexicon).alias("x"))
        # Rows of one id count once, so that repeated ids don't break the bound.
        rows = sorted((r["toxic"], r["x"]) for r in made.groupBy("doc_id", "toxic").agg(F.max("x").alias("x")).collect())
    finally:
        sample.unpersist()
    if len({y for y, _ in rows}) < 2:
        return None
    return ToxicModel(lexicon, np.array([x for _, x in rows]), np.array([y for y, _ in rows]))


def score_column(text: Column, model: ToxicModel | None) -> Column:
    if model is None:
        return F.lit(0.0)
    plain, weights = (model.lexicon.terms, model.lexicon.exceptions, model.lexicon.exact), model.weights

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Lexicon(*plain)
        for batch in batches:
            x = np.array([[*own.features(x), 1.0] for part in slices(batch) for x in part]).reshape(-1, 5)
            yield pa.array(sigmoid(x @ weights))

    return scored(text)


def find_hits(text: Column, lexicon: Lexicon) -> Column:
    """The hits themselves: word index, term, edits, quoted, severity."""
    plain = (lexicon.terms, lexicon.exceptions, lexicon.exact)
    kind = "array<struct<at:bigint,term:string,edits:bigint,quoted:boolean,severity:double>>"

    @F.arrow_udf(kind)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Lexicon(*plain)
        row = pa.struct([("at", pa.int64()), ("term", pa.string()), ("edits", pa.int64()), ("quoted", pa.bool_()), ("severity", pa.float64())])
        for batch in batches:
            yield pa.array([own.hits(x)[1] for part in slices(batch) for x in part], type=pa.list_(row))

    return hits(text)


def classify(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """``df`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on); such columns are replaced."""
    model = fit(df, labels, doc_id, text, **how)
    out = df.withColumn("score", score_column(F.col(text), model))
    return out.withColumns({"held_out": fold(F.col(doc_id), how.get("folds", FOLDS)) == how.get("held_out", HELD_OUT), "predicted": (F.col("score") >= threshold).cast("int")})
