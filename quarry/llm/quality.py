"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are shares of byte classes, word and line counts and repetition measures of the whole text.
Trees are grown on binned statistics of a bounded sample of labelled documents (``PER_CLASS`` of each class)
with the logistic loss, then flattened into arrays; scoring walks all documents of a batch through all trees
with numpy.  Null and empty texts have all-zero statistics and get the score of that point.  If the sample
holds one class only, every score is that class's smoothed share; without labels it is 0.5.  Very long texts are read
whole, one at a time.  Repeated rows are scored each; of a labelled key with several texts one is learned from.  Empty
tables give empty results; further columns take no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.sampling import labelled_sample, predictions

PER_CLASS = 8_000
THRESHOLD = 0.3
NAMES = ("chars", "words", "word_len", "upper", "lower", "digit", "space", "punct", "bang", "pipe", "symbol", "high", "entropy", "distinct", "top_word", "line_words", "distinct_lines", "long_word", "stop", "end_marks")

_KIND = np.zeros((256, 9), np.float64)
for _b in range(256):
    _c = chr(_b)
    for _k, _is in enumerate((65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _c in " \t\n\r", _c in ".,;:'\"()-?", _c == "!", _c == "|", _c in "#$%&*+/<=>@[\\]^_`{}~", _b >= 128)):
        _KIND[_b, _k] = _is


def statistics(text: str | None) -> np.ndarray:
    """One row of ``NAMES``."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = counts.sum()
    p = counts[counts > 0] / n
    words = text.split()
    lines = text.split("\n")
    m = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    out[0], out[1], out[2] = np.log1p(n), np.log1p(len(words)), len(text) / m
    out[3:12] = counts @ _KIND / n
    out[12] = -(p * np.log2(p)).sum()
    out[13] = len(seen) / m**0.8
    out[14] = max(seen.values(), default=0) / m
    out[15] = np.log1p(m / len(lines))
    out[16] = len(set(lines)) / len(lines)
    out[17] = sum(c for w, c in seen.items() if len(w) > 14) / m
    out[18] = sum(c for w, c in seen.items() if len(w) <= 3) / m
    out[19] = text.count(". ") / m
    return out


@dataclass
class Forest:
    """Trees flattened into arrays; node 0 of each tree is its root, leaves point to themselves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least: int = 10) -> Forest:
    """Boosting with the logistic loss; splits from histograms of gradients over quantile bins."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T, strict=True)], 1)
        f = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            roots.append(len(nodes))
            todo = [(np.arange(len(y)), 0)]
            nodes.append([0, 0.0, 0, 0, 0.0])
            at = [roots[-1]]
            while todo:
                rows, level = todo.pop()
                me = at.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                nodes[me][2] = nodes[me][3] = me
                nodes[me][4] = rate * gs / (hs + smooth)
                f_best = None
                if level < depth and len(rows) >= 2 * least:
                    for j in range(x.shape[1]):
                        b = binned[rows, j]
                        size = len(cuts[j]) + 1
                        gl, hl, nl = (np.bincount(b, w, size).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                        gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                        gain[(nl < least) | (len(rows) - nl < least)] = -1
                        if len(gain) and gain.max() > (f_best[0] if f_best else 1e-6):
                            f_best = (gain.max(), j, int(gain.argmax()))
                if f_best:
                    _, j, k = f_best
                    nodes[me][:4] = [j, float(cuts[j][k]), len(nodes), len(nodes) + 1]
                    nodes.extend([[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]])
                    low = binned[rows, j] <= k
                    for part, child in ((rows[low], nodes[me][2]), (rows[~low], nodes[me][3])):
                        todo.append((part, level + 1))
                        at.append(child)
                else:
                    f[rows] += nodes[me][4]
    cols = list(zip(*nodes, strict=True)) if nodes else [[]] * 5
    return Forest(base, *(np.array(c, t) for c, t in zip(cols, (np.int64, np.float64, np.int64, np.int64, np.float64), strict=True)), np.array(roots, np.int64), depth)


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The named columns and an array ``x`` of statistics."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in s], dtype=object)

    return df.select(*keep, run(F.col(text)).alias("x"))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Forest:
    sample = with_statistics(labelled_sample(documents, labels, label, {0: per_class, 1: per_class}), ["k", "y"]).toPandas().sort_values("k")
    x = np.stack(sample["x"].to_list()) if len(sample) else np.zeros((0, len(NAMES)))
    return fit_forest(x, sample["y"].to_numpy(np.float64))


def score(df: DataFrame, forest: Forest, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the score column (replacing one of that name); the forest travels with the function."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.stack([statistics(t) for t in s]) if len(s) else np.zeros((0, len(NAMES)))
            yield pd.Series(forest.scores(x))

    return df.withColumn(name, run(F.col(text)))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """Key, held_out, score, predicted for every document."""
    scored = score(documents.select(key, "text"), fit(documents, labels))
    return predictions(scored, F.col("score"), threshold, key)
