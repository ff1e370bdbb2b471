"""A quality classifier learned from trusted positives and unlabelled text (positive-unlabelled learning).

1. Every text gives `FEATURES` numbers about its bytes, words and lines.
2. The class prior is estimated: a first model tells positives from unlabelled rows on one half of the sample; on the other
   half, the lowest ratio of unlabelled to positive rows above a threshold is the share of positives (best bin).
3. The classifier minimises the non-negative unbiased risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic
   loss; while the second part is below zero, the step goes against it.

Only labels of the training folds are read, and of those only the positives. The fit uses at most `MOST_POSITIVE` of them
and `MOST_UNLABELLED` rows of text, chosen by a hash of the id; every row is scored.

Without positives every score is 0. Null, empty and blank texts have all features of an empty text and a score like any other.
Repeated rows get equal scores; in the fit, rows of one id count once. An empty table gives an empty table; the input's own
columns stay, but for those of the result's names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.batches import slices
from memspark.llm.samples import adam, first_by_hash, fold, sigmoid

MOST_POSITIVE = 8_000
MOST_UNLABELLED = 12_000
FOLDS, HELD_OUT = 4, 2

CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".,", ";:", "!", "?", "'\"", "()[]{}", "-_", "/\\", "#", "*", "$%", "&", "|", "<>", "@~^`+=")
_class_of = np.full(256, len(CLASSES))
for _k, _chars in enumerate(CLASSES):
    for _c in _chars:
        _class_of[ord(_c)] = _k
N_CLASSES = len(CLASSES) + 1
#: Shares of the byte classes, then what `features` adds.
FEATURES = N_CLASSES + 14


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    out = np.zeros(FEATURES)
    n = len(raw)
    if n:
        shares = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        out[:N_CLASSES] = np.sqrt(np.bincount(_class_of, weights=shares, minlength=N_CLASSES) / n)
        upper, lower = shares[65:91].sum(), shares[97:123].sum()
        p = shares[shares > 0] / n
        out[N_CLASSES] = upper / max(1, upper + lower)
        out[N_CLASSES + 1] = -(p * np.log2(p)).sum()
    words = raw.split()
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[N_CLASSES + 2] = math.log1p(m)
    if m:
        distinct = len(set(words))
        out[N_CLASSES + 3] = (n - m) / m / 10
        out[N_CLASSES + 4] = distinct / m
        out[N_CLASSES + 5] = math.log(distinct + 1) / math.log(m + 1)
        out[N_CLASSES + 6] = sum(map(bytes.__eq__, words, words[1:])) / m
        out[N_CLASSES + 7] = sum(map(bytes.isupper, words)) / m
        out[N_CLASSES + 8] = sum(map(bytes.istitle, words)) / m
        out[N_CLASSES + 9] = max(map(len, words)) > 40
        out[N_CLASSES + 10] = 1 - len(set(lines)) / max(1, len(lines))
        out[N_CLASSES + 11] = math.log1p(m / max(1, len(lines)))
        out[N_CLASSES + 12] = m < 10
        out[N_CLASSES + 13] = m < 3
    return out


def feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([features(x) for part in slices(batch) for x in part], type=pa.list_(pa.float64()))

    return made(text)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: int = 100) -> float:
    """The share of positives among the unlabelled, from scores that tell the two apart."""
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)[::-1]
    least = max(1, min(least, len(p) // 2))
    at = p[np.arange(least - 1, len(p))]
    share_p = np.arange(least, len(p) + 1) / len(p)
    share_u = np.searchsorted(-u, -at, side="right") / len(u)
    slack = np.sqrt(np.log(40) / 2 / len(u)) + np.sqrt(np.log(40) / 2 / len(p))
    best = np.argmin((share_u + slack) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


class PuModel:
    """A linear model with its scaling; `prior` is the estimated share of positives."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, decay: float = 1e-3):
        both = np.vstack([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), np.maximum(both.std(axis=0), 0.02)
        p, u = self.scaled(positive), self.scaled(unlabelled)

        def apart(w: np.ndarray) -> np.ndarray:
            a, b = p[::2], u[::2]
            return a.T @ (sigmoid(a @ w) - 1) / len(a) + b.T @ sigmoid(b @ w) / len(b) + decay * w

        first = adam(apart, p.shape[1], 300)
        self.prior = estimate_prior(p[1::2] @ first, u[1::2] @ first)
        pi = self.prior

        def risk(w: np.ndarray) -> np.ndarray:
            zp, zu = p @ w, u @ w
            negative = np.logaddexp(0, zu).mean() - pi * np.logaddexp(0, zp).mean()
            step = u.T @ sigmoid(zu) / len(u) - pi * (p.T @ sigmoid(zp)) / len(p)
            if negative < 0:
                return -step
            return pi * (p.T @ (sigmoid(zp) - 1)) / len(p) + step + decay * w

        self.weights = adam(risk, p.shape[1])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scaled(x) @ self.weights)


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, folds: int = FOLDS, held_out: int = HELD_OUT) -> PuModel | None:
    """None without positives or text. Only ``most_positive + most_unlabelled`` rows of features reach the driver."""
    trusted = labels.where((F.col(label) == 1) & (fold(F.col("doc_id"), folds) != held_out)).select("doc_id").distinct()
    trusted = first_by_hash(trusted, most_positive, 1).withColumn("positive", F.lit(True))
    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    web = first_by_hash(texts.select("doc_id").distinct(), most_unlabelled, 2).withColumn("positive", F.lit(False))
    # The bound of the sample is the bound of what is broadcast.
    made = texts.join(F.broadcast(trusted.union(web)), "doc_id").select("positive", "doc_id", feature_column(F.col("text")).alias("x"))
    # Rows of one id count once, so that repeated ids don't break the bound.
    rows = made.groupBy("positive", "doc_id").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r["positive"], r["doc_id"], r["x"]))
    positive, unlabelled = (np.array([r["x"] for r in rows if r["positive"] is kind]) for kind in (True, False))
    return PuModel(positive, unlabelled) if len(positive) >= 4 and len(unlabelled) >= 4 else None


def score_column(text: Column, model: PuModel | None) -> Column:
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array([features(x) for part in slices(batch) for x in part]).reshape(-1, FEATURES)
            yield pa.array(model.scores(x))

    return scored(text)


def classify(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7, **how) -> DataFrame:
    """``df`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on); such columns are replaced."""
    model = fit(df, labels, doc_id, text, **how)
    out = df.withColumn("score", score_column(F.col(text), model))
    return out.withColumns({"held_out": fold(F.col(doc_id), how.get("folds", FOLDS)) == how.get("held_out", HELD_OUT), "predicted": (F.col("score") >= threshold).cast("int")})
