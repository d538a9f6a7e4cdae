"""Toxicity: a support vector machine on a string-subsequence kernel over sentences, with Nyström landmarks.

Texts are cut into sentences and long sentences into overlapping pieces of ``PIECE`` characters.  The kernel of two
pieces counts their common subsequences of four characters, each weighted by ``DECAY`` to the power of the span it
covers, spans of at most ``SPAN``; blanks and marks are characters like others, so a subsequence may cross words, and
characters put between the letters of an insult only lower its weight.  In a word spelled out, of three letters or more
that each stand alone, blanks and marks are gaps of no width, and digits that look like letters are taken for them.
Letters beyond the Latin ones fall into three classes, so words of other scripts are told apart by their pattern alone.  Pieces are scaled by the length that their
subsequences would have if all were different.

Learning, from a bounded sample of labelled documents: a sentence carries its document's label.  All sentences of a
clean document are clean; of a toxic document at least one is toxic, so this is learning from bags: each toxic document
gives the piece, or the ``MANY`` pieces, that the evidence of their subsequences (log-likelihood ratio of their document
counts) sets apart from clean documents, and then the piece that the machine trained before finds most toxic, for
``ROUNDS`` rounds.  Each is an example also with a blank, a mark or a letter once more put in at random, and so are clean
pieces.  The clean pieces that the machine finds
most toxic join the examples each time.  Landmarks are the cores (``CORE`` characters of the highest score) of toxic
and of such clean pieces, and other clean pieces.  The machine is linear in the Nyström features
K(x, landmarks) K(landmarks, landmarks)^(-1/2), which folds back into one weight per subsequence, so scoring a text is
one pass over its characters.  A document's score is a logistic function of its largest piece margins, fitted on the
same sample.

Nulls and empty texts have no pieces and get the score of that point.  Very long texts are scored whole, in blocks.
Repeated rows are scored each; of a labelled key with several texts one is learned from.  With no labels, or one class
only, scores are the smoothed share of that class.  Empty tables give empty results; further columns take no part.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out
from quarry.llm.sampling import labelled_sample, predictions

#: Bounds of the sample of labelled documents: toxic and clean documents, and characters of each.
PER_CLASS, CHARS = {1: 1_500, 0: 2_500}, 8_000_000
THRESHOLD = 0.5
DECAY, SPAN, PIECE, HOP = 0.8, 7, 24, 12
CORE, LANDMARKS, ROUNDS, EVIDENCE, COST = 12, 256, 2, 8.0, 20.0
#: Toxic pieces of one document, and of all, that become examples at once.
MANY, PIECES = 4, 2_000
#: Symbols: blank, 26 letters without accents, other marks, three classes of other letters, limit of a sentence.
BLANK, MARK, OTHER, END, BITS = 0, 27, 28, 31, 20
_END = re.compile(r"[.!?]\s+|\n")
_BLOCK = 1 << 20


#: Digits and signs that stand for letters.
LOOKS_LIKE = dict(zip("013457@$", "oieastas", strict=True))


def _symbols() -> np.ndarray:
    """The symbol of every character below U+0250: letters, and what looks like one, by their base letter."""
    out = np.full(0x250, MARK, np.uint8)
    for c in range(1, len(out)):
        x = LOOKS_LIKE.get(chr(c)) or unicodedata.normalize("NFKD", chr(c).lower())[0]
        out[c] = BLANK if chr(c).isspace() else ord(x) - 96 if "a" <= x <= "z" else OTHER + c % 3 if x.isalpha() else MARK
    out[0] = END
    return out


SYMBOLS = _symbols()


def symbols(text: str | None) -> np.ndarray:
    """Symbols of a text, sentences between limits and blanks."""
    marked = f" {_END.sub(f' {chr(0)} ', (text or '').lower())} "
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
    return closed(np.where(points < len(SYMBOLS), SYMBOLS[np.minimum(points, len(SYMBOLS) - 1)], OTHER + points % 3).astype(np.int32))


def closed(s: np.ndarray) -> np.ndarray:
    """``s`` without the gaps inside a word spelled out: blanks and marks between two letters that each stand alone."""
    letter = (s != BLANK) & (s != MARK) & (s != END)
    runs = np.diff(letter.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1)
    if len(start) < 3:
        return s
    alone = end - start == 1
    ends = np.concatenate([[0], np.cumsum(s == END)])
    join = alone[:-1] & alone[1:] & (ends[start[1:]] == ends[end[:-1]])
    spelled = join.copy()  # two letters alone are no word: three are joined at least
    spelled[1:-1] &= join[:-2] | join[2:]
    spelled[:1] &= join[1:2]
    spelled[-1:] &= join[-2:-1]
    drop = np.zeros(len(s) + 1, np.int8)
    np.add.at(drop, end[:-1][spelled], 1)
    np.add.at(drop, start[1:][spelled], -1)
    return s[np.cumsum(drop[:-1]) == 0]


def pieces(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pieces of four symbols or more."""
    limits = np.flatnonzero(s == END)
    start, end = np.r_[0, limits + 1], np.r_[limits, len(s)]
    long = end - start >= 4
    start, end = start[long], end[long]
    n = 1 + -(-np.maximum(0, end - start - PIECE) // HOP)
    at = np.repeat(start, n) + HOP * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return at, np.minimum(at + PIECE, np.repeat(end, n))


def subsequences(s: np.ndarray, reach: int = SPAN) -> Iterator[tuple[int, np.ndarray]]:
    """(last, names): for every shape of a subsequence, the name of the one that starts at each symbol; its last symbol is ``last`` further."""
    first, second, third = s << 15, s << 10, s << 5
    for last in range(3, reach):
        n = len(s) - last
        if n <= 0:
            return
        for i in range(1, last - 1):
            head = first[:n] + second[i : i + n]
            for j in range(i + 1, last):
                yield last, head + third[j : j + n] + s[last:]


def summed(s: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray, decay: float = DECAY, reach: int = SPAN) -> np.ndarray:
    """Sum over the subsequences of every piece of their weight times ``decay`` to their span."""
    total, now, sums = np.zeros(len(start)), 0, None
    for last, names in [*subsequences(s, reach), (0, None)]:
        if last != now:
            if sums is not None:
                c = np.r_[0.0, np.cumsum(sums, dtype=np.float64)]
                total += (c[np.clip(end - now, start, len(sums))] - c[np.minimum(start, len(sums))]) * decay ** (now + 1)
            now, sums = last, np.zeros(max(0, len(s) - last), np.float32)
        if names is not None:
            sums += weights[names]
    return total


def lengths(n: np.ndarray) -> np.ndarray:
    """Length of the feature vector of a piece of n symbols whose subsequences are all different."""
    total = np.zeros(len(n))
    for last in range(3, SPAN):
        total += np.maximum(0, n - last) * (last - 1) * (last - 2) / 2 * DECAY ** (2 * last + 2)
    return np.sqrt(total)


def features(examples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, name, weight) of all subsequences of the pieces, in the order of the pieces, scaled."""
    size = np.array([len(x) for x in examples])
    joined, owner = np.concatenate(examples), np.repeat(np.arange(len(size)), size)
    who, name, weight = [], [], []
    for last, names in subsequences(joined):
        inside = owner[: len(names)] == owner[last:]
        who.append(owner[: len(names)][inside])
        name.append(names[inside])
        weight.append(np.full(len(who[-1]), DECAY ** (last + 1)))
    who = np.concatenate(who)
    order = np.argsort(who, kind="stable")
    who = who[order]
    return who, np.concatenate(name)[order], np.concatenate(weight)[order] / lengths(size)[who]


def gram(examples: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """Kernel values of pieces (rows) and landmarks (columns)."""
    who, name, weight = features(landmarks)
    used, at = np.unique(name, return_inverse=True)
    table = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(table, (at, who), weight)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(examples), len(landmarks)))
    for i in range(0, len(examples), 100):
        who, name, weight = features(examples[i : i + 100])
        hit = place[name] >= 0
        who, at, weight = who[hit], place[name[hit]], weight[hit].astype(np.float32)
        if len(who):
            first = np.flatnonzero(np.diff(who, prepend=-1))
            out[i + who[first]] = np.add.reduceat(table[at] * weight[:, None], first)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    logistic: np.ndarray | None
    prior: float

    def margins(self, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start))
        for lo in range(0, len(s), _BLOCK):
            i, j = np.searchsorted(start, [lo, lo + _BLOCK])
            part = s[lo : lo + _BLOCK + PIECE]
            out[i:j] = summed(part, start[i:j] - lo, end[i:j] - lo, self.weights)
        return out / lengths(end - start) + self.bias

    def points(self, texts: list[str | None]) -> np.ndarray:
        """The two largest piece margins of each text, and its length."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(symbols(t))
            size += len(group[-1])
            if size > _BLOCK:
                out.append(self._points(group))
                group, size = [], 0
        return np.concatenate([*out, self._points(group)]) if group else np.concatenate(out) if out else np.zeros((0, 3))

    def _points(self, group: list[np.ndarray]) -> np.ndarray:
        limit = np.full(SPAN, END, np.int32)
        sizes = np.array([len(s) for s in group])
        joined = np.concatenate([x for s in group for x in (s, limit)])
        start, end = pieces(joined)
        owner = np.searchsorted(np.cumsum(sizes + SPAN), start, side="right")
        m = self.margins(joined, start, end)
        order = np.lexsort((-m, owner))
        m, owner = m[order], owner[order]
        place = np.arange(len(m)) - np.searchsorted(owner, owner)
        out = np.zeros((len(group), 3))
        out[:, :2] = -2.0
        for i in range(2):
            out[owner[place == i], i] = np.clip(m[place == i], -2, 2)
        out[:, 2] = np.log1p(sizes) / 10
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.logistic is None:
            return np.full(len(texts), self.prior)
        x = np.column_stack([self.points(texts), np.ones(len(texts))])
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic, -30, 30)))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Linear support vector machine with the squared hinge loss, by Newton steps; the last column is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xs = x[on] * cost[on, None]
        step = np.linalg.solve(np.eye(len(w)) + xs.T @ x[on], w - xs.T @ (y[on] * slack[on]))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2) -> np.ndarray:
    """Weighted so that the classes count as in the population, where ``share`` is of class 1."""
    w = np.zeros(x.shape[1])
    c = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (c * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (c * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def evidence(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio, against independence of the label, of every short subsequence that marks toxic documents."""
    held = np.zeros((2, 1 << BITS))
    for s, label in zip(docs, y, strict=True):
        names = [names[(s[: len(names)] != END) & (s[last:] != END)] for last, names in subsequences(s, 5)]
        if names:
            held[int(label), np.unique(np.concatenate(names))] += 1
    clean, toxic = held
    p = y.mean()
    n = np.maximum(1, toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.nan_to_num(toxic * np.log(toxic / (n * p))) + np.nan_to_num(clean * np.log(clean / (n * (1 - p))))
    return np.where((toxic > n * p) & (g > EVIDENCE), g, 0).astype(np.float32)


def middle(piece: np.ndarray, *score) -> np.ndarray:
    """The part of ``CORE`` symbols of a piece that scores highest."""
    at = np.arange(max(1, len(piece) - CORE + 1))
    i = int(summed(piece, at, np.minimum(at + CORE, len(piece)), *score).argmax())
    return piece[i : i + CORE]


def varied(piece: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A piece with a blank, a mark or a letter once more put between two of its symbols."""
    i = int(rng.integers(1, len(piece)))
    return np.insert(piece, i, rng.choice([BLANK, MARK, piece[i - 1]]))[:PIECE]


def train(texts: list[str], y: np.ndarray, share: float | None = None) -> Model:
    """A model from labelled texts, all in memory: the caller bounds them."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    none = Model(np.zeros(1 << BITS, np.float32), -1.0, None, prior)
    if not 0 < y.sum() < len(y):
        return none
    docs = [symbols(t) for t in texts]
    cut = [pieces(s) for s in docs]
    marks, rng = evidence(docs, y), np.random.default_rng(3)

    def tops(score) -> list[tuple[float, np.ndarray]]:
        """Of every document the piece of the largest score, with it; empty pieces where it has none."""
        out = []
        for s, (start, end) in zip(docs, cut, strict=True):
            if len(start):
                m = score(s, start, end)
                i = int(m.argmax())
                out.append((float(m[i]), s[start[i] : end[i]]))
            else:
                out.append((-np.inf, s[:0]))
        return out

    def several(score, least: float) -> list[np.ndarray]:
        """Of every toxic document up to ``MANY`` pieces that score over ``least``, apart from each other; one of less if none does."""
        out = []
        for s, (start, end), label in zip(docs, cut, y, strict=True):
            if label and len(start):
                m, taken = score(s, start, end), []
                for i in np.argsort(-m, kind="stable"):
                    if taken and m[i] <= least or m[i] <= 0 or len(taken) == MANY:
                        break
                    if all(start[i] >= b or end[i] <= a for a, b in taken):
                        taken.append((start[i], end[i]))
                        out.append(s[start[i] : end[i]])
        return out

    some = []  # two pieces of every clean document
    for s, (start, end), label in zip(docs, cut, y, strict=True):
        if not label and len(start):
            some += [s[start[i] : end[i]] for i in rng.integers(0, len(start), 2)]
    if not some:
        return none
    known = lambda s, a, b: summed(s, a, b, marks, 1.0, 5) / lengths(b - a)
    best, model, score = tops(known), none, (marks, 1.0, 5)
    usual = [m for (m, _), label in zip(best, y, strict=True) if not label and m > -np.inf]
    spread = lambda x, n: [x[i] for i in np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)] if x else []
    sure = spread(several(known, float(np.quantile(usual, 0.99)) if usual else 0.0), PIECES)
    for turn in range(ROUNDS):
        toxic = sure + spread([p for (m, p), label in zip(best, y, strict=True) if label and turn and m > 0], PIECES)
        near = [p for _, p in sorted(((m, p) for (m, p), label in zip(best, y, strict=True) if not label and len(p)), key=lambda x: -x[0])]
        if not toxic:
            break
        core = [middle(p, *score) for p in spread(toxic, LANDMARKS // 2) + near[: LANDMARKS // 4]]
        landmarks = core + spread(some, LANDMARKS // 4)
        values, vectors = np.linalg.eigh(gram(landmarks, landmarks))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        gapped = [[varied(p, rng) for p in x for _ in range(n)] for x, n in ((toxic, 2), (some[::2], 1))]
        examples = toxic + gapped[0] + near + some + gapped[1]
        label = np.array([1.0] * (len(toxic) + len(gapped[0])) + [-1.0] * (len(near) + len(some) + len(gapped[1])))
        cost = np.where(label > 0, COST, 2 * COST)
        w = svm(np.column_stack([gram(examples, landmarks) @ root, np.ones(len(label))]), label, cost)
        who, name, weight = features(landmarks)
        folded = np.bincount(name, weight * (root @ w[:-1])[who], 1 << BITS)
        model = Model(folded.astype(np.float32), float(w[-1]), None, prior)
        best, score = tops(model.margins), (model.weights,)
    if model is none:
        return none
    x = np.column_stack([model.points(texts), np.ones(len(texts))])
    return Model(model.weights, model.bias, logistic(x, y, share or float(y.mean())), prior)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: dict[int, int] | None = None, chars: int = CHARS) -> Model:
    rows = sorted(labelled_sample(documents, labels, label, per_class or PER_CLASS, chars).toLocalIterator(), key=lambda r: r["k"])
    counts = {r["y"]: r["n"] for r in labels.where(~held_out("doc_id")).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).where("y in (0, 1)").collect()}
    return train([r["text"] for r in rows], np.array([r["y"] for r in rows], np.float64), counts.get(1, 0) / max(1, sum(counts.values())))


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.scores(list(s)), dtype=float)

    return df.withColumn(name, run(F.col(text)))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """Key, held_out, score, predicted for every document."""
    scored = score(documents.select(key, "text"), fit(documents, labels))
    return predictions(scored, F.col("score"), threshold, key)
