"""Language identification with language-bitmask n-gram filters.

A filter is one array of words; word i holds, for every language, bit i of that language's Bloom filter
(bit-sliced).  An n-gram's hash picks ``HASHES`` words; their bitwise AND is the set of all languages that
contain the n-gram.  A document's languages are counted over its n-grams (distinct words count once per
occurrence), each language's count is corrected for its filter's false-positive rate, and the largest wins;
ties go to the first language in order.

A language's n-grams are those of lengths ``LENGTHS`` (with word borders) that are at least ``RATIO`` times
as frequent in it as in the languages' average, the ``TOP`` most frequent of them, counted over a bounded
sample of ``PER_LANG`` documents of each language, for every value of the column; what that brings to the driver, ``TOP``
hashes a language, has its bound by an error beyond ``LANGUAGES`` values.  Up to 64 languages fit a word; more take further words.

Texts without any letter and null texts are ``und`` with score 0.  With nothing to learn from all are ``und``.  Very
long texts are read whole.  Repeated rows are answered each; rows that share a key and a language are all learned from.
Empty tables give empty results; further columns take no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import held_out, mix64, released, written

PER_LANG, TOP, LENGTHS, RATIO, HASHES, BITS, LANGUAGES = 1_000, 4_000, (2, 3, 4), 1.3, 3, 18, 8_192
#: Keys of the sample that a broadcast may hold.
MAX_BROADCAST = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> np.ndarray:
    """Hashes of all letter n-grams of the text, words lower case and marked by blanks; empty without letters."""
    if not text:
        return np.zeros(0, np.uint64)
    low = " " + text.lower() + " "
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letters = (codes >= 97) & (codes <= 122)
    letters = ascii_letters.copy()
    high = np.flatnonzero(codes >= 128)
    if len(high):
        kinds, back = np.unique(codes[high], return_inverse=True)
        letters[high] = np.array([chr(c).isalpha() for c in kinds])[back]
    if not letters.any():
        return np.zeros(0, np.uint64)
    codes = np.where(letters, codes, 32).astype(np.uint64)
    codes = codes[(codes != 32) | np.r_[True, codes[:-1] != 32]]
    out, h = [], codes.copy()
    for n in range(2, max(LENGTHS) + 1):
        h = h[:-1] * _MIX + codes[n - 1 :]
        if n in LENGTHS:
            inner = np.ones(len(h), bool)
            for i in range(1, n - 1):  # no gram reaches over a word's border
                inner &= codes[i : i + len(h)] != 32
            out.append(mix64(h[inner] + np.uint64(n)))
    return np.concatenate(out)


@dataclass
class Filters:
    langs: list[str]
    words: np.ndarray  # (positions, ceil(languages / 64)) uint64
    false_rate: np.ndarray

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Per language: n-grams it contains, less the expected false positives."""
        if not len(hashes):
            return np.zeros(len(self.langs))
        mask = np.uint64(len(self.words) - 1)
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
        found = self.words[(low & mask).astype(np.int64)]
        for k in range(1, HASHES):
            found = found & self.words[((low + np.uint64(k) * (high | np.uint64(1))) & mask).astype(np.int64)]
        raw = np.array([np.count_nonzero((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(self.langs))], float)
        return (raw - len(hashes) * self.false_rate) / (1 - self.false_rate)

    def predict(self, text: str | None) -> tuple[str, float]:
        hashes = grams(text)
        if not len(hashes) or not self.langs:
            return "und", 0.0
        c = np.clip(self.counts(hashes), 0, None) + 1e-3
        best = int(c.argmax())
        return self.langs[best], float(c[best] / c.sum())


def build(tops: dict[str, np.ndarray], bits: int = BITS) -> Filters:
    """Filters from each language's n-gram hashes."""
    langs = sorted(tops)
    words = np.zeros((1 << bits, max(1, -(-len(langs) // 64))), np.uint64)
    rate = np.zeros(len(langs))
    mask = np.uint64((1 << bits) - 1)
    for i, lang in enumerate(langs):
        h = tops[lang]
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        at = np.unique(np.concatenate([((low + np.uint64(k) * (high | np.uint64(1))) & mask).astype(np.int64) for k in range(HASHES)])) if len(h) else np.zeros(0, np.int64)
        words[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        rate[i] = (len(at) / (1 << bits)) ** HASHES
    return Filters(langs, words, rate)


def fit(df: DataFrame, per_lang: int = PER_LANG, top: int = TOP, languages: int = LANGUAGES, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Counts n-grams in Spark; what reaches the driver is ``top`` hashes for each language.

    Every value of ``lang`` is learned; more than ``languages`` of them are an error, none is passed over.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    names = sorted(r["l"] for r in known.select("l").distinct().limit(languages + 1).collect())
    if len(names) > languages:
        raise ValueError(f"more than {languages} languages")
    if not names:
        return build({})
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))
    ids = written(known.select("l", "k").distinct().withColumn("place", place).where(F.col("place") <= per_lang).drop("place"), "sample-keys")
    sample = known.join(ids.hint("broadcast" if ids.count() <= MAX_BROADCAST else "merge"), ["l", "k"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, texts in pdf.groupby("l")["t"]:
                h, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"l": name, "g": h.view(np.int64), "n": n})

    counts = written(sample.select("l", "t").mapInPandas(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")), "grams")
    released(ids)
    totals = counts.groupBy("l").agg(F.sum("n").alias("all"))
    share = counts.join(F.broadcast(totals), "l").withColumn("f", F.col("n") / F.col("all"))
    mean = share.groupBy("g").agg((F.sum("f") / len(names)).alias("mean"))
    own = share.join(mean.hint("merge"), "g").where(F.col("f") >= min(RATIO, len(names)) * F.col("mean"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))
    rows = own.select("l", "g", "n").withColumn("place", place).where(F.col("place") <= top).select("l", "g").toPandas()
    released(counts)
    found = {name: g.to_numpy(np.int64).view(np.uint64) for name, g in rows.groupby("l")["g"]}
    return build({name: found.get(name, np.zeros(0, np.uint64)) for name in names})


def identify(df: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, held_out, lang_pred, score for every row."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([filters.predict(t) for t in s], columns=["lang_pred", "score"])

    return df.select(key, held_out(key).alias("held_out"), run(F.col(text)).alias("r")).select(key, "held_out", "r.*")
