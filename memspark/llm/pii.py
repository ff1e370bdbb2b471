"""Personal data in texts: fixed rules, and a character-level bidirectional LSTM with CRF transitions for what is disguised.

Kinds are email, ip, card and phone. The rules (`base_spans`) find what is written plainly. The network adds what is not:
"name (at) host dot org", "10 . 0 . 0 . 1", a card in groups with points, a phone number without its plus sign.

1. Labelled spans: stretches of text around base spans of at most ``most_rows`` documents, chosen by a hash of the id, `WINDOWS` of
   each. In training, new values of the span's kind stand in its place, plainly or in a disguise, beside numbers that are no
   personal data (dates, prices, versions, hex keys); so the labels are known, and no value of the corpus is learned.
2. The network is written in numpy: one LSTM over the characters' classes in either direction, stepped side by side, emissions
   for the tags (outside; begin and inside of each kind), transitions between tags. It is trained on the driver by the exact
   likelihood of the CRF and sent to the tasks: `CHARS` x 8 x `HIDDEN` numbers and a few more.
3. A disguised span holds a digit, an at sign or a spelled "at" or "dot" (`HINT`). All characters within `REACH` of such a hint that
   no base span covers are read, in windows of `WIDTH` that overlap by half, so that a span of up to half a window is whole in one.
4. Each window is decoded (Viterbi). The windows' spans are reconciled over the whole text: of all sets of spans that don't
   overlap the one of the largest evidence, by weighted interval scheduling. Spans that meet a base span or that, undisguised,
   break their kind's rule (a card's checksum, an address's parts, a number's digits) are dropped. Base spans stay.

Places are code points, ends exclusive. Null and empty texts have no spans; a long text is one of its own, its windows are
read `BATCH` at a time. Repeated rows get equal spans; in the fit rows of one id count once. Without documents, or without base spans
in them, there is no network and base spans alone are found. An empty table gives an empty table; the input's own columns stay,
but for ``spans``, which is replaced.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.batches import slices
from memspark.llm.samples import first_by_hash

KINDS = ("email", "ip", "card", "phone")
#: Documents whose base spans give the fit its places, and places of one document.
MOST_ROWS, WINDOWS = 1_000, 4
WIDTH, REACH, BATCH, HIDDEN = 128, 64, 2_048, 20
STEPS, TRAIN_WIDTH, TRAIN_ROWS = 400, 112, 48
HINT = re.compile(r"[0-9@＠]|\b[dD][oO][tT]\b|[(\[{<]\s?[aA][tT]\s?[)\]}>]|\b[aA][tT] [A-Za-z0-9-]+\.[A-Za-z]")
#: The same for Spark: texts that can hold base spans.
BASE_HINT = "@|[0-9]\\.[0-9]|\\+[0-9]|[0-9]([ -]?[0-9]){11}"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the checksum of a card's digits holds."""
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(int(x) if k % 2 == 0 else double[int(x)] for k, x in enumerate(reversed(digits))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The longest run of local characters before each at sign with a domain after it, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at + 1)
        begin = at
        if found:
            while begin > done and text[begin - 1] in LOCAL_CHARS:
                begin -= 1
        if begin < at:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Numbers with points between them, four at a time from the left."""
    for found in DOTTED.finditer(text):
        if found[0].count(".") >= 3:
            at, parts = found.start(), found[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(map(small_part, four)):
                    yield at, at + size
                at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by the rules, in this order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(a, 1, b) for a, b in addresses(text)]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(x := digits_of(m[0])) <= 19 and luhn(x)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def undisguised(kind: int, text: str) -> bool:
    """Whether a span that the network found keeps its kind's rule once its disguise is taken off."""
    if kind == 0:
        plain = re.sub(r"\s*[(\[{<]\s*(?:at|@)\s*[)\]}>]\s*|\s+at\s+|\s*[@＠]\s*", "@", text, count=1, flags=re.I)
        plain = re.sub(r"\s*[(\[{<]\s*(?:dot|\.)\s*[)\]}>]\s*|\s+dot\s+|\s*\.\s*", ".", plain, flags=re.I)
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", plain))
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        between = {x.strip().lower() for x in re.split("[0-9]+", text)[1:-1]}
        return len(parts) == 4 and all(map(small_part, parts)) and len(between) == 1 and text[0].isdigit() and text[-1].isdigit()
    digits = digits_of(text)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9](?:[ ._/-]{0,2}[0-9])+", text))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[0-9]", text)) and len(re.findall("[^0-9]+", text)) >= 2


# Characters.
ALONE = "@.+-()[]{}<>/_,:;=#\"'*$%&|!? \n"
#: Class 0 is what stands after a text's end; then letters, a digit, the signs above, other ASCII, and other letters.
_class = np.full(129, 28 + len(ALONE), dtype=np.int64)
_class[128] = 29 + len(ALONE)
for _k in range(26):
    _class[ord("a") + _k] = _class[ord("A") + _k] = 1 + _k
_class[ord("0") : ord("9") + 1] = 27
for _k, _c in enumerate(ALONE):
    _class[ord(_c)] = 28 + _k
CHARS = 30 + len(ALONE)
TAGS = 1 + 2 * len(KINDS)


def classes(text: str, width: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    out = np.zeros(width, dtype=np.int64)
    out[: len(points)] = _class[np.where(points == 0xFF20, ord("@"), np.minimum(points, 128))]
    return out


# Labelled spans.
def made_value(kind: int, r: random.Random) -> str:
    """A new value of a kind, written plainly."""
    some = lambda chars, least, most: "".join(r.choice(chars) for _ in range(r.randint(least, most)))
    letters, digits = "abcdefghijklmnopqrstuvwxyzetaoinsr", "0123456789"
    if kind == 0:
        local = some(letters, 2, 12) + r.choice(["", "." + some(letters, 2, 9), "." + some(digits, 1, 3), "_" + some(letters, 2, 6), some(digits, 1, 4)])
        host = ".".join([some(letters, 2, 9) + r.choice(["", some(digits, 1, 2)]) for _ in range(r.choice([1, 1, 2]))])
        return f"{local}@{host}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'example'])}"
    if kind == 1:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == 2:
        number = some(digits, 11, 18) if r.random() < 0.3 else some(digits, 15, 15)
        return number + next(x for x in digits if luhn(number + x))
    a, b, c, d = some(digits[1:], 1, 2), some(digits, 3, 3), some(digits, 3, 3), some(digits, 4, 4)
    return r.choice([f"+{a} ({b}) {c}-{d}", f"+{a} {b} {c} {d}", f"+{a}-{b}-{c}-{d}", f"+{a}{b}{c}{d}"])


def disguised(kind: int, value: str, r: random.Random) -> str:
    """The value as people write it to get past rules."""
    if kind == 0:
        local, host = value.split("@")
        dot = r.choice([".", ".", " dot ", " [dot] ", " (dot) ", "[.]", " DOT "])
        at = r.choice([" (at) ", " [at] ", " at ", " @ ", "(at)", "[at]", " AT ", "＠", " {at} ", "(@)"])
        return (local.replace(".", dot) if " " in dot and r.random() < 0.3 else local) + at + host.replace(".", dot)
    if kind == 1:
        return value.replace(".", r.choice([" . ", "[.]", " dot ", "(.)", ",", "-", "[dot]", ". "]))
    if kind == 2:
        sign = r.choice([".", "/", "_", "  ", " - ", ". "])
        groups = [value[k : k + 4] for k in range(0, len(value), 4)]
        return sign.join(groups)
    digits = digits_of(value)
    first, b, c, d = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    return r.choice([f"({b}) {c}-{d}", f"{b}-{c}-{d}", f"{b}.{c}.{d}", f"00{first} {b} {c} {d}", f"{first}-{b}-{c}-{d}", f"{b} {c} {d}", f"{b}/{c}-{d}", f"({b}){c}.{d}", f"+{first}/{b}/{c}/{d}"])


def no_value(r: random.Random) -> str:
    """A number or word that is no personal data."""
    n = r.randint
    return r.choice([
        f"{n(1990, 2035)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2035)}", f"{n(0, 23)}:{n(0, 59):02}", f"${n(1, 99)},{n(100, 999)}.{n(10, 99)}",
        f"{n(0, 9)}.{n(0, 20)}.{n(0, 9)}", f"{n(0, 99999)}", f"{n(0, 999)}.{n(0, 9999)}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 32, 40]))),
        f"{n(1, 99)} at {n(1, 99)}", "the dot on the", "at the end. Of", f"v{n(1, 9)}.{n(0, 9)}", f"{n(1, 9)} of {n(10, 99)}", f"#{n(1, 999999)}", f"{n(10**6, 10**10)}", f"{n(1, 50)}-{n(51, 99)}", f"{n(100, 999)},{n(100, 999)},{n(100, 999)}",
    ])


def example(context: str, r: random.Random, plainly: float = 0.25) -> tuple[str, list[tuple[int, int, int]]]:
    """A stretch of text with new values at the places of its base spans, and their spans (start, kind, end)."""
    out, spans, at = "", [], 0
    for start, kind, end in base_spans(context):
        if start < at:
            continue
        out += context[at:start]
        if r.random() < 0.3:
            out += no_value(r)
        else:
            kind = r.randrange(len(KINDS)) if r.random() < 0.7 else kind
            value = made_value(kind, r)
            value = value if r.random() < plainly else disguised(kind, value, r)
            spans.append((len(out), kind, len(out) + len(value)))
            out += value
        at = end
    return out + context[at:], spans


def stretches(text: str, most: int = WINDOWS, around: int = 60) -> list[str]:
    """Stretches around at most ``most`` base spans of a text, cut at blanks, the spans chosen evenly over it."""
    spans = base_spans(text)
    out = []
    for k in range(min(most, len(spans))):
        start, _, end = spans[k * len(spans) // min(most, len(spans))]
        if end - start <= around:
            a, b = max(0, start - around), end + around
            a = a and max(text.find(" ", a, start) + 1, 0) or a
            out.append(text[a:b])
    return out


# The network.
def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (1 + np.tanh(np.float32(0.5) * x))


class Tagger:
    """Weights: wx (2, CHARS, 4H) of the characters, wh (2, H, 4H), wo (2, H, TAGS), bo (TAGS), trans (TAGS, TAGS), first (TAGS).
    Gates stand in the order in, forget, out, cell; direction 1 reads from the end."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 11):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.hidden = hidden
        self.w = {"wx": normal(2, CHARS, 4 * hidden, scale=0.3), "wh": normal(2, hidden, 4 * hidden, scale=0.5 / hidden**0.5), "wo": normal(2, hidden, TAGS, scale=0.3), "bo": np.zeros(TAGS, dtype=np.float32), "trans": normal(TAGS, TAGS, scale=0.1), "first": np.zeros(TAGS, dtype=np.float32)}
        self.w["wx"][:, :, hidden : 2 * hidden] += 1  # what a cell holds stays, at first
        self.w["bo"][0] = 2

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """The states (2, T, B, H) of windows of classes (B, T); direction 1's stand from the end. With what training needs."""
        n, width, h = len(x), x.shape[1], self.hidden
        both = (x.T, x.T[::-1])
        state, cell = np.zeros((2, n, h), dtype=np.float32), np.zeros((2, n, h), dtype=np.float32)
        states, kept = np.empty((2, width, n, h), dtype=np.float32), []
        for t in range(width):
            z = np.matmul(state, self.w["wh"])
            z[0] += self.w["wx"][0][both[0][t]]
            z[1] += self.w["wx"][1][both[1][t]]
            gates = sigmoid(z[:, :, : 3 * h])
            g = np.tanh(z[:, :, 3 * h :])
            before, cell = cell, gates[:, :, h : 2 * h] * cell + gates[:, :, :h] * g
            tanh = np.tanh(cell)
            if keep:
                kept.append((state, before, gates, g, tanh))
            state = gates[:, :, 2 * h :] * tanh
            states[:, t] = state
        return states, kept

    def emissions(self, states: np.ndarray) -> np.ndarray:
        """(T, B, TAGS)"""
        return states[0] @ self.w["wo"][0] + states[1][::-1] @ self.w["wo"][1] + self.w["bo"]

    def gradient(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The CRF's negative log likelihood of a batch, a window, and its gradient by backpropagation through time."""
        n, width, h = len(x), x.shape[1], self.hidden
        states, kept = self.run(x, keep=True)
        e, trans = self.emissions(states).astype(np.float64), self.w["trans"].astype(np.float64)
        y = tags.T
        rows = np.arange(n)

        def total(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.w["first"]
        for t in range(1, width):
            alpha[t] = total(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(width - 2, -1, -1):
            beta[t] = total(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = total(alpha[-1], 1)
        gold = self.w["first"][y[0]].sum() + np.take_along_axis(e, y[:, :, None], 2).sum() + trans[y[:-1], y[1:]].sum()
        loss = (z.sum() - gold) / n
        de = np.exp(alpha + beta - z[:, None])
        np.add.at(de, (np.arange(width)[:, None], rows[None], y), -1)
        dtrans = np.zeros_like(trans)
        for t in range(1, width):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(dtrans, (y[:-1], y[1:]), -1)
        de = (de / n).astype(np.float32)
        out = {"bo": de.sum(axis=(0, 1)), "first": de[0].sum(axis=0), "trans": (dtrans / n).astype(np.float32)}
        own = np.stack([de, de[::-1]])
        flat = states.reshape(2, -1, h)
        out["wo"] = np.matmul(flat.transpose(0, 2, 1), own.reshape(2, -1, TAGS))
        down = np.matmul(own, self.w["wo"].transpose(0, 2, 1)[:, None])
        dz_all = np.empty((2, width, n, 4 * h), dtype=np.float32)
        dstate, dcell = np.zeros((2, n, h), dtype=np.float32), np.zeros((2, n, h), dtype=np.float32)
        back = self.w["wh"].transpose(0, 2, 1)
        dwh = np.zeros_like(self.w["wh"])
        for t in range(width - 1, -1, -1):
            state, before, gates, g, tanh = kept[t]
            i, f, o = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :]
            dh = dstate + down[:, t]
            dcell = dcell + dh * o * (1 - tanh * tanh)
            dz = dz_all[:, t]
            dz[:, :, :h] = dcell * g * i * (1 - i)
            dz[:, :, h : 2 * h] = dcell * before * f * (1 - f)
            dz[:, :, 2 * h : 3 * h] = dh * tanh * o * (1 - o)
            dz[:, :, 3 * h :] = dcell * i * (1 - g * g)
            dwh += np.matmul(state.transpose(0, 2, 1), dz)
            dstate = np.matmul(dz, back)
            dcell = dcell * f
        out["wh"] = dwh
        out["wx"] = np.zeros_like(self.w["wx"])
        for d, some in enumerate((x.T, x.T[::-1])):
            hot = np.zeros((width * n, CHARS), dtype=np.float32)
            hot[np.arange(width * n), some.ravel()] = 1
            out["wx"][d] = hot.T @ dz_all[d].reshape(-1, 4 * h)
        return float(loss), out

    def fit(self, contexts: list[str], steps: int = STEPS, rate: float = 0.02, seed: int = 5) -> Tagger:
        r = random.Random(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for step in range(1, steps + 1):
            x, tags = np.zeros((TRAIN_ROWS, TRAIN_WIDTH), dtype=np.int64), np.zeros((TRAIN_ROWS, TRAIN_WIDTH), dtype=np.int64)
            for row in range(TRAIN_ROWS):
                text, spans = example(r.choice(contexts), r)
                # The window's place is any that shows some of the text, so spans are cut by its edges as in use.
                off = r.randint(-20, max(0, len(text) - TRAIN_WIDTH + 20))
                part = text[max(0, off) : max(0, off) + TRAIN_WIDTH]
                x[row] = classes(part, TRAIN_WIDTH)
                for start, kind, end in spans:
                    a, b = max(0, start - max(0, off)), min(TRAIN_WIDTH, end - max(0, off))
                    if a < b:
                        tags[row, a:b] = 2 + 2 * kind
                        if start >= off:
                            tags[row, a] = 1 + 2 * kind
            _, g = self.gradient(x, tags)
            norm = sum(float((y * y).sum()) for y in g.values()) ** 0.5
            now = rate * min(1, step / 20) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
            for k in self.w:
                y = g[k] / max(1.0, norm / 5)
                m[k] = 0.9 * m[k] + 0.1 * y
                v[k] = 0.99 * v[k] + 0.01 * y * y
                self.w[k] = self.w[k] - (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (B, T) of windows, and how much each place's emission of its tag is above that of outside."""
        e = self.emissions(self.run(x)[0])
        width, n = e.shape[:2]
        score, came = e[0] + self.w["first"], np.zeros((width, n, TAGS), dtype=np.int8)
        for t in range(1, width):
            by = score[:, :, None] + self.w["trans"]
            came[t] = by.argmax(axis=1)
            score = by.max(axis=1) + e[t]
        tags = np.zeros((n, width), dtype=np.int64)
        tags[:, -1] = score.argmax(axis=1)
        rows = np.arange(n)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = came[t, rows, tags[:, t]]
        over = np.take_along_axis(e.transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0] - e[:, :, 0].T
        return tags, over


def tagged(tags: list[int]) -> Iterator[tuple[int, int, int]]:
    """The spans (start, kind, end) of a window's tags; a span that a window's edge cuts begins without its beginning's tag."""
    at, n = 0, len(tags)
    while at < n:
        if tags[at] == 0:
            at += 1
            continue
        kind, to = (tags[at] - 1) // 2, at + 1
        while to < n and tags[to] == 2 + 2 * kind:
            to += 1
        yield at, kind, to
        at = to


def best_set(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans (start, kind, end, evidence) a set that doesn't overlap and has the largest evidence."""
    spans = sorted(spans, key=lambda s: (s[2], s[0], s[1]))
    ends, best, take = [s[2] for s in spans], [0.0], []
    for k, (start, _, _, evidence) in enumerate(spans):
        fit = bisect_right(ends, start, 0, k)
        take.append(fit if best[fit] + evidence > best[k] else -1)
        best.append(max(best[k], best[fit] + evidence))
    out, k = [], len(spans)
    while k:
        if take[k - 1] < 0:
            k -= 1
        else:
            out.append(spans[k - 1][:3])
            k = take[k - 1]
    return sorted(out)


def windows(text: str, base: list[tuple[int, int, int]]) -> list[int]:
    """Where the windows begin: over all that lies within `REACH` of a hint outside the base spans, half a window apart."""
    covered = sorted((a, b) for a, _, b in base)
    out: list[int] = []
    k = end = begin = 0

    def laid() -> None:
        at = begin
        while at == begin or at + WIDTH // 2 < end:
            out.append(at)
            at += WIDTH // 2

    for found in HINT.finditer(text):
        at = found.start()
        while k < len(covered) and covered[k][1] <= at:
            k += 1
        if k < len(covered) and covered[k][0] <= at:
            continue
        if at - REACH > end or not end:
            if end:
                laid()
            begin = max(0, at - REACH)
        end = found.end() + REACH
    if end:
        laid()
    return out


def all_spans(texts: list[str], model: Tagger | None) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, base) of each text."""
    bases = list(map(base_spans, texts))
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]

    def read(places: list[tuple[int, int]]) -> None:
        tags, over = model.decode(np.stack([classes(texts[t][at : at + WIDTH], WIDTH) for t, at in places]))
        for row in np.flatnonzero(tags.any(axis=1)):
            t, at = places[row]
            sums = np.concatenate([[0.0], np.cumsum(over[row])])
            for start, kind, end in tagged(tags[row].tolist()):
                found[t].append((at + start, kind, min(at + end, len(texts[t])), float(sums[end] - sums[start])))

    if model is not None:
        waiting: list[tuple[int, int]] = []
        for t, text in enumerate(texts):
            for at in windows(text, bases[t]):
                waiting.append((t, at))
                if len(waiting) == BATCH:
                    read(waiting)
                    waiting = []
        if waiting:
            read(waiting)
    out = []
    for text, base, more in zip(texts, bases, found, strict=True):
        spans = [(*s, True) for s in base]
        if more:
            begins, k, reach = sorted((a, b) for a, _, b in base), 0, 0
            for start, kind, end in best_set([s for s in more if s[3] > 0]):
                while start < end and not (text[start].isalnum() or text[start] in "(+"):
                    start += 1
                while end > start and not text[end - 1].isalnum():
                    end -= 1
                while k < len(begins) and begins[k][0] < end:
                    reach = max(reach, begins[k][1])
                    k += 1
                if start < end and reach <= start and undisguised(kind, text[start:end]):
                    spans.append((start, kind, end, False))
            spans.sort()
        out.append(spans)
    return out


# On Spark.
def contexts(df: DataFrame, doc_id: str, text: str, most_rows: int) -> list[str]:
    """Stretches around base spans of at most ``most_rows`` ids."""

    @F.arrow_udf("array<string>")
    def around(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([stretches(x) for part in slices(batch) for x in part], type=pa.list_(pa.string()))

    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(BASE_HINT))
    ids = first_by_hash(texts.select("doc_id"), most_rows, 3).distinct()
    # The bound of the sample is the bound of what is broadcast; rows of one id count once.
    rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", around(F.col("text")).alias("x")).groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    return [x for r in sorted(rows, key=lambda r: (r["doc_id"], r["x"])) for x in r["x"]]


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, steps: int = STEPS) -> Tagger | None:
    """None where no document has a base span."""
    found = contexts(df, doc_id, text, most_rows)
    return Tagger().fit(found, steps) if found else None


def span_column(text: Column, model: Tagger | None) -> Column:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in some] for some in all_spans(part, model)], type=kind)

    return found(text)


def find_personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Tagger | None = None, **how) -> DataFrame:
    """``df`` with ``spans``: kind, start, end and whether a rule found it, by start and kind. Without a ``model`` one is fitted."""
    return df.withColumn("spans", span_column(F.col(text), model or fit(df, doc_id, text, **how)))
