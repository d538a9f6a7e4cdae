"""Source divergence audit: how far the term shares of each source stand from those of its language and of other sources.

A term is a run of ASCII letters and characters beyond ASCII, only A-Z lower-cased.  A language keeps the terms found in
at least ``MIN_DOCS`` of its documents.  They are found by iceberg prefix refinement: no prefix is rarer than a term
that begins with it, so terms are looked at through byte prefixes of 4, 8, 16, ... bytes.  At each level the documents
of every (language, prefix) are counted; prefixes below the threshold are discarded with all terms behind them, terms
that end within the level are settled by their exact counts, and the rest goes on until nothing is left.

Counts are partial sums before they are shuffled, so a hot language, source or prefix is one row a task.  What survived
reaches the tasks as a Bloom filter of at most ``MAX_BITS`` bits: a false answer lets a prefix live a level longer, where
its terms are settled by exact counts all the same, so the size of the filter never shows in a result.

Rows: every row is a document, repeated keys and rows included.  Null text, lang and source are ''.  A group whose
documents hold no kept term still has its rows; a language without kept terms has pairs of value 0 and no terms.  Empty
tables give empty results; other columns take no part and may have any name.  Very long texts and terms are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import mix64, scratch, written
from quarry.llm.wordhash import _POW

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTH = 5
SCALE = 1_000_000_000
FIRST_BYTES = 4
MAX_BITS = 1 << 27
#: Groups of (language, source) that a broadcast may hold.
MAX_BROADCAST = 50_000
SALTS = 64
#: Bytes of text that a task looks at together; a longer text is looked at alone.
PIECE = 1 << 22

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(97, 123), *range(128, 256)]] = True


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str], list[bytes]]]:
    """Languages, sources and UTF-8 texts of rows in order, about ``PIECE`` bytes at a time."""
    for batch in batches:
        langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
        texts = batch.column(2).cast(pa.binary())
        start = size = 0
        for i, x in enumerate(texts):
            size += len(x.as_buffer())
            if size >= PIECE or i == len(texts) - 1:
                yield langs[start : i + 1], sources[start : i + 1], texts[start : i + 1].to_pylist()
                start, size = i + 1, 0


class Terms:
    """All term occurrences of a few texts: where each begins, its length and its row."""

    def __init__(self, langs: list[str], texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # bytes.lower touches A-Z alone
        edge = np.diff(_INSIDE[self.data].astype(np.int8), prepend=0, append=0)
        self.start = np.flatnonzero(edge == 1)
        self.size = np.flatnonzero(edge == -1) - self.start
        self.row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, "right")
        self.langs = langs

    def keep(self, which: np.ndarray) -> None:
        self.start, self.size, self.row = self.start[which], self.size[which], self.row[which]

    def heads(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``most`` bytes of each term in one array, the place of each byte, and the offsets."""
        size = np.minimum(self.size, most)
        offsets = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
        return self.data[np.repeat(self.start, size) + place], place, offsets

    def found(self, most: int, held: np.ndarray) -> np.ndarray:
        """Which terms have their first ``most`` bytes in the filter ``held``."""
        if not len(self.start):
            return np.zeros(0, bool)
        h = hashes(*self.heads(most), lang_hashes(self.langs)[self.row])
        mask = np.uint64(len(held) * 64 - 1)
        ok = np.ones(len(h), bool)
        for at in (h & mask, (h >> np.uint64(32)) & mask):
            ok &= (held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok

    def codes(self, most: int) -> tuple[np.ndarray, pa.Array]:
        """A number for each term's first ``most`` bytes, and the bytes of each number."""
        data, _, offsets = self.heads(most)
        heads = pa.BinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        return heads.indices.to_numpy().astype(np.int64), heads.dictionary.cast(pa.binary())


def hashes(data: np.ndarray, place: np.ndarray, offsets: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mix64(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POW[place & 4095], offsets[:-1]) + salt)


def lang_hashes(langs: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh64_intdigest(x) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def survivor_filter(prefixes: DataFrame) -> np.ndarray:
    """A Bloom filter of two bits each for (lang, p), 16 bits a prefix as long as ``MAX_BITS`` allows; made of 64-bit words."""
    bits, n = 1 << 10, prefixes.count()
    while bits < min(16 * n, MAX_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                terms = batch.column(1).to_pylist()
                size = np.array([len(t) for t in terms])
                offsets = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
                h = hashes(np.frombuffer(b"".join(terms), np.uint8), place, offsets, lang_hashes(batch.column(0).to_pylist()))
                at = np.concatenate([h, h >> np.uint64(32)]) & np.uint64(bits - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["at"])

    at = prefixes.select("lang", "p").mapInArrow(run, "at long")
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out.view(np.uint64)


def level(documents: DataFrame, size: int, before: int, survivors: np.ndarray) -> DataFrame:
    """(lang, p, ends, docs): documents that hold the prefix ``p`` of ``size`` bytes, in terms that end with it or go on.

    Only terms longer than ``before`` bytes whose first ``before`` bytes survived are looked at.  One text counts once
    for a prefix; a task adds up what it can before the rows are shuffled.
    """
    words = documents.sparkSession.sparkContext.broadcast(survivors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, _, texts in pieces(batches):
            t = Terms(langs, texts)
            if before:
                t.keep(t.size > before)
                t.keep(t.found(before, words.value))
            code, heads = t.codes(size)
            code = 2 * code + (t.size <= size)
            once = np.unique(t.row * np.int64(2 * len(heads) + 1) + code)  # (text, prefix)
            row, code = np.divmod(once, 2 * len(heads) + 1)
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.int64)
            key, docs = np.unique(code * len(names) + number[row], return_counts=True)
            code, lang = np.divmod(key, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(lang)), heads.take(pa.array(code >> 1)), pa.array(code & 1 == 1), pa.array(docs)], ["lang", "p", "ends", "docs"])

    return documents.mapInArrow(run, "lang string, p binary, ends boolean, docs long").groupBy("lang", "p", "ends").agg(F.sum("docs").alias("docs"))


def occurrences(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, source, term, n) of the terms in ``vocabulary`` (lang, p), where there are any."""
    words = documents.sparkSession.sparkContext.broadcast(survivor_filter(vocabulary))
    whole = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, sources, texts in pieces(batches):
            t = Terms(langs, texts)
            t.keep(t.found(whole, words.value))
            code, terms = t.codes(whole)
            names = sorted(set(zip(langs, sources, strict=True)))
            at = {x: i for i, x in enumerate(names)}
            number = np.array([at[x] for x in zip(langs, sources, strict=True)], np.int64)
            key, n = np.unique(code * len(names) + number[t.row], return_counts=True)
            code, group = np.divmod(key, len(names))
            heads = [pa.array([x[i] for x in names], pa.string()).take(pa.array(group)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*heads, terms.take(pa.array(code)), pa.array(n)], ["lang", "source", "term", "n"])

    counted = documents.mapInArrow(run, "lang string, source string, term binary, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return counted.join(vocabulary.select("lang", F.col("p").alias("term")).hint("merge"), ["lang", "term"]).select("lang", "source", "term", "n")


def kept_terms(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, p): the terms in at least ``min_docs`` texts of a language, for ``documents`` of lang, source and text."""
    size, before, survivors, settled = FIRST_BYTES, 0, np.zeros(0, np.uint64), []
    while True:
        held = written(level(documents, size, before, survivors).where(F.col("docs") >= min_docs), "prefixes")
        settled.append(held.where("ends").select("lang", "p"))
        going = held.where(~F.col("ends")).select("lang", "p")
        if going.isEmpty():
            return written(reduce(DataFrame.unionByName, settled), "vocabulary")
        size, before, survivors = 2 * size, size, survivor_filter(going)


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kinds)), in exact decimals."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + F.lit(SMOOTH).cast("decimal(1,0)"))
    down = total.cast("decimal(20,0)") + F.lit(SMOOTH).cast("decimal(1,0)") * kinds.cast("decimal(18,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, down)


def of_language(rows: DataFrame, groups: DataFrame, few: bool, key: str) -> DataFrame:
    """``rows`` joined with the groups of their language: broadcast if few, else salted by ``key``, as one language may hold most rows."""
    if few:
        return rows.join(F.broadcast(groups), "lang")
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), ["lang", "salt"]).drop("salt")


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(lang, source, part, item, q, value, rank) of each group.

    Part 'pair': every other source of the language by the sum over kept terms of the distance of shares, all ranks;
    q is null.  Part 'term': the ``top`` kept terms of the group whose share lies furthest over that of the language, q.
    """
    with scratch() as keep:
        named = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
        found = written(occurrences(named, kept_terms(named, min_docs)), "occurrences")
        vocabulary = written(found.groupBy("lang", "term").agg(F.sum("n").alias("all_n")), "vocabulary")
        sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("all_n").alias("all_total"))
        own = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = named.select("lang", "source").distinct().join(sizes.hint("merge"), "lang", "left").join(own.hint("merge"), ["lang", "source"], "left")
        groups = written(groups.na.fill(0, ["kinds", "all_total", "total"]), "groups")
        few = groups.count() <= max_broadcast
        dense = of_language(vocabulary, groups, few, "term").join(found.hint("merge"), ["lang", "source", "term"], "left").na.fill(0, ["n"])
        dense = dense.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), share(F.col("all_n"), F.col("all_total"), F.col("kinds")).alias("q"))
        dense = written(dense, "shares")
        other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
        near = dense.select("lang", "term", "source", "p").join(other.hint("merge"), ["lang", "term"]).where("source < item")
        sums = near.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other"))).alias("value"))
        ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
        none = of_language(groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item")), few, "source").where("source < item")
        pairs = sums.unionByName(none.withColumn("value", F.lit(0).cast("long"))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        pairs = pairs.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", F.lit(None).cast("long").alias("q"), "value")
        over = dense.where("n > 0 and p > q").select("lang", "source", F.col("term").cast("string").alias("item"), "q", (F.col("p") - F.col("q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
        parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "q", "value", rank) for part, df in (("pair", pairs), ("term", over))]
        return keep(written(parts[0].unionByName(parts[1].where(F.col("rank") <= top)), "audit"))
