"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns give spans of the kinds ``KINDS``; their spans always stay.  The field tags every token of a text as
beginning a secret, inside one or outside (B, I, O) and adds spans of kind ``learned`` that touch no pattern span.
It scores a token by its shape, length and mix of characters, by its neighbouring words, by the classes of the tokens
around it and by measures of the whole text; an I follows only B or I.

It is trained here, by gradients of the conditional likelihood, on windows of a bounded sample of documents, at most
``PER_CLASS`` with and without pattern matches each, in the order of a hash of the text.  Labels are what the patterns
find.  Windows with a secret are repeated with the secret drawn anew from other alphabets and the words before it
changed, so that shape and surroundings each have to speak for themselves.  Without a match in the table nothing is
learned and nothing is added.

Decoding is Viterbi's, exact.  Where the outside score of a token leads by more than all that transitions could bring
back, the best path is outside there; only the stretches between such tokens are decoded, all of a batch in step.

Rows: null and empty texts have no spans.  Repeated rows give equal results each; keys play no part.  Very long texts
are read whole, alone.  Empty tables give empty results; other columns stay, or take no part, under any name.  Spans
count code points, end exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mix64
from quarry.llm.wordhash import _POW

KINDS = ("assign", "access", "hex", "learned")
PER_CLASS = 400
WINDOW = 40
WINDOWS = 2
#: Characters that are decoded together, unless one text is longer.
PIECE = 1 << 20
O, B, I = 0, 1, 2

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ of 32 or more
_ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"


def pattern_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, start of the secret itself) of the pattern matches, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(0, m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(2, m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


#: Kinds of characters: space, lower, upper, digit, sign of a word, beyond ASCII, mark, full stop.
SPACE, LOWER, UPPER, DIGIT, SIGN, BEYOND, MARK, STOP = range(8)
_KIND = np.full(129, MARK, np.uint8)
_KIND[[*range(33), 127]] = SPACE
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128] = LOWER, UPPER, DIGIT, BEYOND
_KIND[[ord(x) for x in "+/_-"]] = SIGN
_KIND[ord(".")] = STOP
_BIT = np.array([0, 1, 2, 4, 8, 16, 0, 0], np.uint8)
_NOT_HEX = np.ones(129, bool)
_NOT_HEX[[*range(48, 58), *range(97, 103), *range(33), 127]] = False
_LENGTHS = np.array([4, 8, 12, 16, 24, 40])
#: Classes are below CLASSES: a mark by its code point, a word by its mix of characters and its length; 0 stands beyond a text.
CLASSES = 512
#: Places of the neighbouring words that are features, and the pairs of places whose classes are.
NEIGHBOURS = (-3, -2, -1, 1)
PAIRS = ((-2, -1), (-1, 0), (0, 1))
#: Templates of features: name and number of values; a word's value is its place in the vocabulary, from 1.
TEMPLATES = {"shape": 6**6, "class": CLASSES, "turns": 64, "hex": 16} | {f"pair {p}": CLASSES**2 for p in PAIRS} | {f"file {i}": 64 for i in range(4)}


class Tokens:
    """Tokens of a few texts, with what each says about itself.

    A token is a run of letters, digits, characters beyond ASCII and the signs + / _ -, with full stops inside it; every
    other character but white space is a token alone.
    """

    def __init__(self, texts: list[str]) -> None:
        points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) + 1 for t in texts])
        self.origin = np.cumsum(size) - size
        kind = _KIND[np.minimum(points, 128)]
        kind[(points == 0x85) | (points == 0xA0) | (points >= 0x2000) & (points < 0x2070) | (points >= 0x3000) & (points < 0x3004)] = SPACE
        word = (kind >= LOWER) & (kind <= BEYOND)
        stops = np.flatnonzero(kind == STOP)
        within = word[stops - 1] & word[np.minimum(stops + 1, len(kind) - 1)] & (stops > 0)
        kind[stops] = np.where(within, SIGN, MARK)
        word[stops[within]] = True
        before = np.concatenate([[False], word[:-1]])
        first = word & ~before | (kind == MARK)
        last = word & ~np.concatenate([word[1:], [False]]) | (kind == MARK)
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(np.cumsum(size), self.start, "right")
        self.whole = self._measures(points, kind, size)
        n = len(self.start)
        if not n:
            self.kind, self.bucket, self.hashes = (np.zeros(0, np.int64) for _ in range(3))
            self.own: dict[str, np.ndarray] = {}
            return
        self.bucket = np.searchsorted(_LENGTHS, self.stop - self.start, "right")
        mix = np.bitwise_or.reduceat(_BIT[kind], self.start).astype(np.int64)
        mark = kind[self.start] == MARK
        self.kind = np.where(mark, points[self.start], 128 + 8 * mix + self.bucket)
        change = word & before & (np.concatenate([[0], kind[:-1]]) != kind)
        turns = np.add.reduceat(change, self.start, dtype=np.int64)
        share = np.minimum(7, 8 * turns // (self.stop - self.start))
        token_of = np.cumsum(first) - 1
        runs = np.flatnonzero(word & (first | change))
        owner = token_of[runs]
        number = np.arange(len(runs)) - np.searchsorted(owner, owner, "left")
        early = number < 6
        shape = np.bincount(owner[early], kind[runs[early]] * 6.0 ** number[early], n).astype(np.int64)
        not_hex = np.logical_or.reduceat(_NOT_HEX[np.minimum(points, 128)], self.start)
        place = np.arange(len(points)) - self.start[np.maximum(token_of, 0)]
        low = np.where(kind == SPACE, 0, points.astype(np.uint64) + np.where(kind == UPPER, 33, 1).astype(np.uint64))
        self.hashes = mix64(np.add.reduceat(low * _POW[place & 4095], self.start)).view(np.int64)
        self.own = {"shape": shape, "class": self.kind, "turns": 8 * share + self.bucket, "hex": 8 * not_hex + self.bucket}

    @staticmethod
    def _measures(points: np.ndarray, kind: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Four small numbers a text: its share of digits and of marks, how often it assigns, the length of its lines."""
        if not len(size):
            return np.zeros((0, 4), np.int64)
        first = np.cumsum(size) - size
        digits, marks, assigns, lines = (np.add.reduceat(x, first, dtype=np.int64) for x in (kind == DIGIT, (kind == MARK) | (kind == SIGN), points == ord("="), points == 10))
        long = np.searchsorted(np.array([40, 120]), size // lines, "right")
        return np.stack([np.minimum(4, 40 * digits // size), np.minimum(4, 40 * marks // size), np.minimum(3, 400 * assigns // size), long], 1)

    def shifted(self, d: int) -> np.ndarray:
        """Token at distance d in the same text, or -1."""
        to = np.arange(len(self.start)) + d
        ok = (to >= 0) & (to < len(to))
        to[~ok] = 0
        return np.where(ok & (self.text[to] == self.text), to, -1)

    def features(self, vocabulary: np.ndarray, whole: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """The value of every template for every token; ``whole``: measures of texts to take for these texts' own."""
        out = dict(self.own)
        if len(self.start):
            known = np.minimum(np.searchsorted(vocabulary, self.hashes), max(0, len(vocabulary) - 1))
            word = np.where(vocabulary[known] == self.hashes, known + 1, 0) if len(vocabulary) else np.zeros(len(self.start), np.int64)
            kinds, words = np.append(self.kind, 0), np.append(word, 0)
            for d in NEIGHBOURS:
                out[f"word {d}"] = words[self.shifted(d)]
            for a, b in PAIRS:
                out[f"pair {(a, b)}"] = kinds[self.shifted(a)] * CLASSES + kinds[self.shifted(b)]
            for i in range(4):
                out[f"file {i}"] = 8 * (self.whole if whole is None else whole)[self.text, i] + self.bucket
        return out


@dataclass
class Field:
    """A trained field: the vocabulary of neighbouring words, for each template the values met and their weights for O, B
    and I, and the transitions."""

    vocabulary: np.ndarray
    weights: dict[str, tuple[np.ndarray, np.ndarray]]
    turn: np.ndarray

    def tables(self) -> dict[str, np.ndarray]:
        """The weights of a template by value."""
        out = {}
        for name, (values, w) in self.weights.items():
            out[name] = np.zeros((TEMPLATES.get(name, len(self.vocabulary) + 1), 3))
            out[name][values] = w
        return out


def likelihood(emit: np.ndarray, turn: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of ``tags`` (sequences x places) and the differences observed - expected for emissions and turns.

    Before the first and after the last place a sequence is outside.
    """
    n, length, _ = emit.shape
    ahead, back = np.zeros((n, length, 3)), np.zeros((n, length, 3))
    ahead[:, 0] = emit[:, 0] + turn[O]
    for t in range(1, length):
        ahead[:, t] = emit[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + turn, axis=1)
    back[:, -1] = turn[:, O]
    for t in range(length - 2, -1, -1):
        back[:, t] = np.logaddexp.reduce(turn + (emit[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(ahead[:, -1] + turn[:, O], axis=1)
    share = np.exp(ahead + back - total[:, None, None])
    seen = np.eye(3)[tags]
    inner = np.exp(ahead[:, :-1, :, None] + turn + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum((0, 1))
    pairs = np.zeros((3, 3))
    padded = np.pad(tags, ((0, 0), (1, 1)))
    np.add.at(pairs, (padded[:, :-1].ravel(), padded[:, 1:].ravel()), 1)
    inner[O] += share[:, 0].sum(0)
    inner[:, O] += share[:, -1].sum(0)
    score = np.take_along_axis(emit, tags[:, :, None], 2).sum() + (pairs * np.where(np.isfinite(turn), turn, 0)).sum() - total.sum()
    return float(score), seen - share, pairs - inner


def train(tokens: Tokens, tags: np.ndarray, whole: np.ndarray, rounds: int = 40, rate: float = 0.2, shrink: float = 1e-3, least: int = 3) -> Field:
    """A field from the tokens of short texts, their tags and the measures of the texts they come from.

    Steps of the sample's gradient, each weight's by the running size of its own; features met fewer than ``least`` times are left out.
    """
    turn = np.zeros((3, 3))
    turn[O, I] = -np.inf
    if not (tags == B).any():
        return Field(np.zeros(0, np.int64), {}, turn)
    words, counts = np.unique(tokens.hashes, return_counts=True)
    vocabulary = words[counts >= least]
    ids, names, width = [], [], 0
    for name, values in tokens.features(vocabulary, whole).items():
        met, back, counts = np.unique(values, return_inverse=True, return_counts=True)
        often = counts >= least
        at = np.cumsum(often) - 1 + width
        ids.append(np.where(often, at, -1)[back])
        names.append((name, met[often]))
        width += int(often.sum())
    which = np.stack(ids, 1)
    row, col = np.nonzero(which >= 0)
    which = which[row, col]
    size = np.bincount(tokens.text)
    first = np.cumsum(size) - size
    at = tokens.text, np.arange(len(tags)) - first[tokens.text]
    ys = np.zeros((len(size), size.max()), np.int64)
    ys[at] = tags
    w, past, past_turn = np.zeros((width, 3)), np.zeros((width, 3)), np.zeros((3, 3))
    for r in range(rounds):
        emit = np.zeros((*ys.shape, 3))
        emit[..., 1:] = -1e9  # after the end of a text
        emit[at] = np.stack([np.bincount(row, w[which, y], len(tags)) for y in range(3)], 1)
        _, diff, pairs = likelihood(emit, turn, ys)
        diff = diff[at]
        grad = np.stack([np.bincount(which, diff[row, y], width) for y in range(3)], 1) - shrink * len(size) / 100 * w
        pairs[O, I] = 0
        step = rate / (1 + r / 10)
        past, past_turn = 0.8 * past + 0.2 * grad**2, 0.8 * past_turn + 0.2 * pairs**2
        w += step * grad / (np.sqrt(past) + 1e-3)
        turn += step * pairs / (np.sqrt(past_turn) + 1e-3)
    out, start = {}, 0
    for name, met in names:
        out[name] = (met, w[start : start + len(met)])
        start += len(met)
    return Field(vocabulary, out, turn)


def decode(emit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The best tags of a sequence of tokens, outside before and after it."""
    n = len(emit)
    tags = np.zeros(n, np.int64)
    if not n:
        return tags
    finite = np.where(np.isfinite(turn), turn, -np.inf)
    # what transitions can lose at most when B or I becomes O: the next tag stays, or is made a B where it was I
    stay = max(turn[a, y] - turn[a, O] + turn[y, b] - turn[O, b] for a in range(3) for y in (B, I) for b in (O, B) if finite[a, y] > -np.inf)
    moved = max(turn[a, y] - turn[a, O] + turn[y, I] - turn[O, B] + turn[I, c] - turn[B, c] for a in range(3) for y in (B, I) for c in range(3) if finite[a, y] > -np.inf)
    follow = np.append(emit[1:, I] - emit[1:, B], -np.inf)
    lead = emit[:, O] - np.maximum(emit[:, B], emit[:, I])
    open_ = lead <= np.maximum(stay, moved + follow)
    edge = np.diff(open_.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = stop - start
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # stretches longer than k
    best = np.zeros((len(start), 3))
    come = np.zeros((n, 3), np.int8)
    for k, m in enumerate(active):
        here = start[:m] + k
        if k == 0:
            best[:m] = turn[O] + emit[here]
        else:
            ways = best[:m, :, None] + turn
            come[here] = ways.argmax(1)
            best[:m] = ways.max(1) + emit[here]
    state = (best + turn[:, O]).argmax(1)
    for k in range(len(active) - 1, -1, -1):
        m = active[k]
        here = start[:m] + k
        tags[here] = state[:m]
        state[:m] = come[here, state[:m]]
    return tags


class Tagger:
    """A field ready to tag texts."""

    def __init__(self, field: Field) -> None:
        self.field, self.tables = field, field.tables()

    def tags(self, tokens: Tokens) -> np.ndarray:
        """Tags of all tokens; a token outside for certain is laid between texts, so that they are decoded together."""
        emit = np.zeros((len(tokens.start), 3))
        for name, values in tokens.features(self.field.vocabulary).items():
            emit += self.tables[name][values]
        gaps = np.flatnonzero(np.diff(tokens.text, prepend=-1))
        at = np.arange(len(emit)) + np.cumsum(np.diff(tokens.text, prepend=-1) > 0)
        laid = np.tile(np.array([0.0, -1e9, -1e9]), (len(emit) + len(gaps), 1))
        laid[at] = emit
        return decode(laid, self.field.turn)[at]

    def learned(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, start, end) of the secrets that the field tags."""
        if not self.field.weights:
            return []
        t = Tokens(texts)
        tags = self.tags(t)
        begins = np.flatnonzero(tags == B)
        out = []
        for i in begins:
            j = i + 1
            while j < len(tags) and tags[j] == I and t.text[j] == t.text[i]:
                j += 1
            zero = t.origin[t.text[i]]
            out.append((int(t.text[i]), int(t.start[i] - zero), int(t.stop[j - 1] - zero)))
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of all spans of each text, by start, then kind."""
        out = [[s[:3] for s in pattern_spans(t)] for t in texts]
        found: dict[int, list[tuple[int, int]]] = {}
        for i, start, end in self.learned(texts):
            found.setdefault(i, []).append((start, end))
        for i, more in found.items():
            base = out[i]
            reach = list(accumulate((e for _, _, e in base), max))  # the furthest end so far
            starts = [s for _, s, _ in base]
            free = []
            for start, end in more:
                k = bisect_left(starts, end)  # spans that begin before this one ends
                if not k or reach[k - 1] <= start:
                    free.append((3, start, end))
            out[i] = sorted(base + free, key=lambda s: (s[1], s[0]))
        return out


def windows_of(text: str) -> list[tuple[list[str], list[int], list[int]]]:
    """Windows (tokens, tags, measures of the text) around secrets that the patterns find, or of other places of a text without."""
    t = Tokens([text])
    n = len(t.start)
    if not n:
        return []
    tags = np.zeros(n, np.int64)
    for start, end in sorted({(s, e) for _, _, e, s in pattern_spans(text)}, key=lambda s: (-s[1], s[0])):
        low, high = np.searchsorted(t.stop, start, "right"), np.searchsorted(t.start, end, "left")
        tags[low:high] = I
        tags[low : low + 1] = B
    marked = np.flatnonzero(tags == B)
    rng = random.Random(len(text))
    places = [int(marked[rng.randrange(len(marked))]) for _ in range(min(WINDOWS, len(marked)))] if len(marked) else [rng.randrange(n) for _ in range(min(WINDOWS, 1 + n // WINDOW))]
    out = []
    for p in sorted(set(places)):
        low = max(0, p - WINDOW // 2)
        while low and tags[low] == I:
            low -= 1
        high = min(n, low + WINDOW)
        out.append(([text[a:b] for a, b in zip(t.start[low:high], t.stop[low:high], strict=True)], tags[low:high].tolist(), t.whole[0].tolist()))
    return out


_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_BEFORE = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "pwd", "credential", "auth", "bearer")
_SIGNS = ("=", ":", "is", "was")


def redrawn(tokens: list[str], tags: list[int], rng: random.Random) -> tuple[list[str], list[int]]:
    """A window with its secrets drawn anew from another alphabet, in other surroundings."""
    out, ys = [], []
    for token, y in zip(tokens, tags, strict=True):
        if y == I:
            continue
        if y == B:
            letters = rng.choice(_ALPHABETS)
            value = "".join(rng.choice(letters) for _ in range(rng.choice((16, 20, 24, 32, 40, 44, 64))))
            token = rng.choice(("", "", "", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 5))) + rng.choice("_-"))) + value.strip("+/_-")
        elif token.lower() in _BEFORE:
            token = rng.choice(_BEFORE) if rng.random() < 0.7 else rng.choice(tokens)
            if len(token) >= 16:  # not another secret
                token = "key"
        elif token in ("=", ":") and rng.random() < 0.5:
            token = rng.choice(_SIGNS)
        elif token in ('"', "'") and rng.random() < 0.4:
            continue
        out.append(token)
        ys.append(y)
    return out, ys


def plain(rng: random.Random) -> str:
    """Something that is long or mixed and no secret: an address, a path, a date, a number, a name of several words."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    number = lambda: str(rng.randrange(10 ** rng.randrange(1, 9)))
    return rng.choice((
        lambda: "https : //" + "/".join([f"{word()}.{rng.choice(('com', 'org', 'net'))}", *(rng.choice((word, word, number))() for _ in range(rng.randrange(4)))]),
        lambda: "/" + "/".join(word() for _ in range(rng.randrange(2, 6))),
        lambda: f"{word()}{number()} @ {word()}.example.com",
        lambda: f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
        lambda: ".".join(number() for _ in range(rng.randrange(2, 5))),
        lambda: str(rng.randrange(10 ** rng.randrange(9, 20))),
        lambda: rng.choice("-_").join(rng.choice((word, word, number))() for _ in range(rng.randrange(2, 6))),
        lambda: word() + word() + word() + word(),
        lambda: f"{word()}.{word()}.{word()}",
    ))()


def with_plain(tokens: list[str], tags: list[int], rng: random.Random) -> tuple[list[str], list[int]]:
    """A window with something plain put in place of one of its tokens outside secrets, at times after a sign of assignment."""
    at = rng.choice([i for i, y in enumerate(tags) if y == O] or [len(tags)])
    more = rng.choice(([], [], ["="], [":"], ["id", "="], ["url", ":"], ["="], ["file", "=", '"'])) + plain(rng).split()
    return tokens[:at] + more + tokens[at + 1 :], tags[:at] + [O] * len(more) + tags[at + 1 :]


def fit(df: DataFrame, per_class: int = PER_CLASS, text: str = "text", rounds: int = 40) -> Field:
    """A field learned from at most ``per_class`` different texts with and ``per_class`` without a pattern match."""
    own = df.select(F.col(text).cast("string").alias("t")).where(F.length("t") > 0).withColumn("h", F.xxhash64("t"))
    marked = own.select("h", F.col("t").rlike(_ANY).alias("has"))
    chosen = [r.h for has in (True, False) for r in marked.where(F.col("has") == has).select("h").distinct().orderBy("h").limit(per_class).collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, i, *w) for h, t in zip(batch["h"], batch["t"], strict=True) for i, w in enumerate(windows_of(t))]
            yield pd.DataFrame(rows, columns=["h", "i", "tokens", "tags", "whole"])

    sample = own.where(F.col("h").isin(chosen)).select("h", "t").mapInPandas(run, "h long, i int, tokens array<string>, tags array<int>, whole array<int>").dropDuplicates(["h", "i"])
    rng, texts, tags, whole = random.Random(7), [], [], []
    for _, row in sample.toPandas().sort_values(["h", "i"]).iterrows():
        window = list(row["tokens"]), [int(y) for y in row["tags"]]
        for ts, ys in [window, with_plain(*window, rng), *(with_plain(*redrawn(*window, rng), rng) for _ in range(2) if B in window[1])]:
            texts.append(" ".join(ts))
            tags += ys
            whole.append(list(row["whole"]))
    return train(Tokens(texts), np.array(tags, np.int64), np.array(whole, np.int64).reshape(-1, 4), rounds)


def scan(df: DataFrame, field: Field, text: str = "text", name: str = "spans") -> DataFrame:
    """``df`` with an array of (kind, start, end), by start, then kind; replaces a column of that name."""
    held = df.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(held.value)
        for s in batches:
            texts, out, start, size = [t or "" for t in s], [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= PIECE or i == len(texts) - 1:
                    out += tagger.spans(texts[start : i + 1])
                    start, size = i + 1, 0
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans] for spans in out], dtype=object)

    return df.withColumn(name, run(F.col(text).cast("string")))


def joined(spans: str, base: bool = False) -> Column:
    """The spans of a column as kind:start:end, comma-joined; ``base``: those of the patterns alone."""
    kept = F.filter(spans, lambda s: s["kind"] != KINDS[3]) if base else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans of each row."""
    found = scan(df.select(F.col(key), F.col(text).alias("text")), field)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(key, *counts, F.sha2(joined("spans", True), 256).alias("base_sha256"), joined("spans").alias("spans"))
