"""MinHash near-duplicates: consistent weighted samples of TF-IDF shingles, banded and verified.

A text is a weighted set of five-word shingles, weight = count in the text times the inverse document
frequency.  Document frequencies are counted over all rows, by shingle names whose width grows with the corpus
(``WIDTH`` bits more than its characters need, so a name is shared by chance with a probability below 2^-14 at any
size).  Rows are dealt into chunks; a chunk sends its distinct names with their local counts, cut at ranges of the
name; each range adds them up and sends every chunk the sums in the order of its names.  So no shingle is a hot key
and nothing of the corpus is broadcast; a text carries the counts of its shingles, in their order, from there on.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per text; two texts share a sample with
the probability of their weighted Jaccard similarity.  Texts that share all ``ROWS`` samples of a band are
candidates: at a similarity of 0.8 a pair is missed with probability (1 - 0.8^3)^16 = 1e-5.  Candidates are
verified by their weighted Jaccard similarity, computed from the texts.

Equal texts are one node from the start, and so are texts of equal shingle counts.  A bucket of up to
``SMALL`` texts gives all its pairs.  A larger bucket is verified against its most popular text (the one with
most bucket mates in all bands, in a group of edited copies the one nearest to what they were copied from).
That finds many links with rows in proportion to rows, but not all: so the texts of large buckets that still hold
several components are joined once more, exactly, by prefix filtering.  Shingles stand in order of rising document
frequency; a similar pair has a first common shingle, and from there on each of the two must weigh what their common
part needs, 0.8 / 1.8 of both together.  So only the few rarest shingles of each text are joined, only between
components, and only where both sides leave that room.
Classes are the connected components of verified links.

By frequencies alone a group of copies pulls its own texts apart: what its members share loses weight as the group
grows, an edited word keeps the highest.  So ``share`` takes a shingle as held by at least that part of the documents:
whatever fewer hold weighs alike, and only what is commoner loses weight.

Null texts are alone in their class; empty texts equal each other.  A text of fewer than five words is one
shingle; very long texts are read whole, in one task each.  Rows with equal key and text are one document in the
report (each row counts in the document frequencies); null keys sort first.  Empty tables give empty tables.
Columns beyond key and text take no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, mix64, released, scratch, written
from quarry.llm.components import components
from quarry.llm.wordhash import shingles

N, SIMILARITY, BANDS, ROWS, SMALL, MAX_BROADCAST, BLOCK = 5, 0.8, 16, 3, 16, 500_000, 512
#: The ``share`` of the corpus's near-duplicates.
SHARE = 0.5
#: Characters of text for a chunk of rows and for a range of names; bits of a name beyond those of the corpus's length.
CHUNK_CHARS, RANGE_CHARS, WIDTH = 1_000_000, 8_000_000, 16


def _gamma_table(bits: int = 12) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, whose distribution function is 1 - (1 + x) exp(-x)."""
    q = (np.arange(1 << bits) + 0.5) / (1 << bits)
    lo, hi = np.zeros_like(q), np.full_like(q, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < q
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return ((lo + hi) / 2).astype(np.float32)


GAMMA = _gamma_table()
LOG_GAMMA, _PER_GAMMA = np.log(GAMMA), 1 / GAMMA
_ODD = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and how often the text has them."""
    return np.unique(shingles(text, N), return_counts=True)


def weights(tf: np.ndarray, counts: np.ndarray, docs: int, share: float = 0.0) -> np.ndarray:
    """TF-IDF from the counts of documents that hold each shingle, taken as ``share`` of the documents at least."""
    return tf * np.log1p(docs / np.maximum(counts, share * docs))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (shingles in order, weights); 0 if either is empty."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    common = np.minimum(wa, wb[at])[hb[at] == ha].sum()
    return float(common / (wa.sum() + wb.sum() - common))


def samples(h: np.ndarray, w: np.ndarray, number: int) -> np.ndarray:
    """Consistent weighted samples of a weighted set, one 64-bit name per sample.

    The random numbers of sample j and shingle h are bits of h times an odd number of j.
    """
    best, at, step = np.full(number, np.inf, np.float32), np.zeros(number, np.int64), np.zeros(number, np.float32)
    lw, each = np.log(w).astype(np.float32), np.arange(number)
    for i in range(0, len(h), 1024):
        z = h[None, i : i + 1024] * _ODD[:number, None]
        k = (z >> np.uint64(52)).astype(np.int32)
        beta = ((z >> np.uint64(40)).astype(np.int32) & 4095).astype(np.float32)
        beta *= np.float32(1 / 4096)
        t = _PER_GAMMA.take(k)
        t *= lw[None, i : i + 1024]
        t += beta
        np.floor(t, out=t)
        log_a = LOG_GAMMA.take((z >> np.uint64(28)).astype(np.int32) & 4095)
        beta -= t
        beta -= 1
        beta *= GAMMA.take(k)
        log_a += beta
        j = log_a.argmin(1)
        low = log_a[each, j]
        new = low < best
        best[new], at[new], step[new] = low[new], i + j[new], t[each, j][new]
    return mix64(h[at] + step.astype(np.int64).view(np.uint64) * np.uint64(0xA0761D6478BD642F))


def packed(names: np.ndarray) -> bytes:
    """Names in order as differences, byte by byte place, so that their zeros compress."""
    return np.diff(names, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def chunked(df: DataFrame, key: str, text: str, chars: int) -> DataFrame:
    """(chunk, t, x) of every row with a text: t names the text; copies fall into different chunks."""
    chunk = F.pmod(F.xxhash64(F.col(key), F.col(text), F.spark_partition_id()), F.lit(1 + chars // CHUNK_CHARS))
    return df.where(F.col(text).isNotNull()).select(chunk.alias("chunk"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))


def frequencies(rows: DataFrame, chars: int) -> DataFrame:
    """(chunk, part, n): for the distinct names of each chunk of rows (chunk, x), in order, the rows of the corpus that hold them."""
    bits, ranges = name_bits(chars), np.uint64(1 + chars // RANGE_CHARS)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        names, n = np.unique(np.concatenate([np.unique(shingles(x, N) >> np.uint64(64 - bits)) for x in pdf["x"]]), return_counts=True)
        part = ((names >> np.uint64(bits - 32)) * ranges >> np.uint64(32)).astype(np.int64)
        cuts = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), len(names)]
        n, chunk = n.astype(np.uint32), pdf["chunk"].iloc[0]
        return pd.DataFrame([(chunk, part[i], packed(names[i:j]), n[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], columns=["chunk", "part", "names", "n"])

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [unpacked(x) for x in pdf["names"]]
        counts = np.frombuffer(b"".join(pdf["n"]), np.uint32)
        every, at = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(at, counts, len(every)).astype(np.uint32)[at]
        ends = np.cumsum([len(x) for x in names])
        return pd.DataFrame({"chunk": pdf["chunk"], "part": pdf["part"], "n": [total[e - len(x) : e].tobytes() for x, e in zip(names, ends, strict=True)]})

    parts = rows.groupBy("chunk").applyInPandas(local, "chunk long, part long, names binary, n binary")
    return parts.groupBy("part").applyInPandas(add_up, "chunk long, part long, n binary")


def name_bits(chars: int) -> int:
    return min(64, max(40, WIDTH + int(chars).bit_length()))


def sketches(rows: DataFrame, docs: int, chars: int, share: float = 0.0) -> DataFrame:
    """(t, counts, bag, bands) of every row (chunk, t, x): counts of documents by shingle, bag names the weighted set; no bands without words."""
    bits = name_bits(chars)

    def bands(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        held = np.frombuffer(b"".join(found.sort_values("part")["n"]), np.uint32)
        sets = [counted(x) for x in pdf["x"]]
        names = [h >> np.uint64(64 - bits) for h, _ in sets]
        every, out = np.unique(np.concatenate([np.zeros(0, np.uint64), *names])), []
        for t, (h, tf), own in zip(pdf["t"], sets, names, strict=True):
            if len(h):
                counts = held[np.searchsorted(every, own)]
                w = weights(tf, counts, docs, share)
                z = samples(h, w, BANDS * ROWS).reshape(BANDS, ROWS)
                name = np.arange(BANDS, dtype=np.uint64)
                for i in range(ROWS):
                    name = mix64(name * np.uint64(0x9E3779B97F4A7C15) + z[:, i])
                bag = int(mix64(h ^ mix64(w.view(np.uint64))).sum().view(np.int64))
                out.append((t, counts.tobytes(), bag, name.view(np.int64)))
            else:
                out.append((t, b"", 0, np.zeros(0, np.int64)))
        return pd.DataFrame(out, columns=["t", "counts", "bag", "bands"])

    found = frequencies(rows.select("chunk", "t", "x"), chars)
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(bands, "t long, counts binary, bag long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, docs: int, share: float = 0.0) -> DataFrame:
    """(a, b, sim) of candidate pairs of text names."""

    @F.pandas_udf("double")
    def sim(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        memo = {}

        def get(k: int, t: str, counts: bytes):
            if k not in memo:
                if len(memo) >= 64:
                    memo.clear()
                h, tf = counted(t)
                memo[k] = h, weights(tf, np.frombuffer(counts, np.uint32), docs, share)
            return memo[k]

        for a, x, m, b, y, n in batches:
            yield pd.Series([similarity(get(*p), get(*q)) for p, q in zip(zip(a, x, m, strict=True), zip(b, y, n, strict=True), strict=True)], dtype=float)

    left = texts.select(F.col("t").alias("a"), F.col("x").alias("xa"), F.col("counts").alias("ca")).hint("merge")
    right = texts.select(F.col("t").alias("b"), F.col("x").alias("xb"), F.col("counts").alias("cb")).hint("merge")
    return pairs.join(left, "a").join(right, "b").select("a", "b", sim("a", "xa", "ca", "b", "xb", "cb").alias("sim"))


def spokes_of(large: DataFrame) -> DataFrame:
    """(a, b): every text of large buckets (band, t, pop) with its bucket's most popular text."""
    pivots = written(large.groupBy("band").agg(F.max_by("t", F.struct("pop", F.xxhash64("t", "band"))).alias("pivot")), "pivots").hint("merge")
    return large.join(pivots, "band").where("t <> pivot").select(F.least("t", "pivot").alias("a"), F.greatest("t", "pivot").alias("b"))


def pairs_of(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): all pairs of buckets (band, t, n, pop) up to ``SMALL``, and the spokes of the others."""
    few = rows.where(F.col("n") <= SMALL).select("band", "t")
    pairs = few.withColumnRenamed("t", "a").join(few.withColumnRenamed("t", "b").hint("merge"), "band").where("a < b").select("a", "b")
    return pairs.unionByName(spokes_of(rows.where(F.col("n") > SMALL).select("band", "t", "pop"))).distinct()


def prefixes(texts: DataFrame, docs: int, least: float, share: float = 0.0) -> DataFrame:
    """(t, label, s, w, rest) of texts (t, label, x, counts): the shingles s of which one is the first shared with any similar text.

    w is the text's weight, rest that of s and all shingles after it.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, label, x, held in zip(pdf["t"], pdf["label"], pdf["x"], pdf["counts"], strict=True):
                h, tf = counted(x)
                counts = np.frombuffer(held, np.uint32)
                order = np.lexsort((h, counts))
                w = weights(tf, counts, docs, share)[order]
                total = w.sum()
                rest = total - np.cumsum(w) + w
                kept = (rest >= (least - 1e-9) * total) & (counts[order] > 1)  # what one row holds is shared with none
                yield pd.DataFrame({"t": t, "label": label, "s": h[order][kept].view(np.int64), "w": total, "rest": rest[kept]})

    return texts.select("t", "label", "x", "counts").mapInPandas(rows, "t long, label long, s long, w double, rest double")


def several(rows: DataFrame, key: str) -> DataFrame:
    """(key, main, blocks) of groups with more than one label: the commonest label, and blocks for the texts of all others."""
    parts = rows.groupBy(key, "label").agg(F.count("*").alias("n"))
    groups = parts.groupBy(key).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("parts"))
    return groups.where("parts > 1").select(key, "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("blocks"))


def rest_of(buckets: DataFrame, labels: DataFrame, texts: DataFrame, docs: int, least: float, share: float = 0.0) -> DataFrame:
    """Candidate pairs (a, b) among texts of ``buckets`` (band, t) between the components ``labels`` (node, label) that links leave apart.

    At each shingle the texts outside its commonest component are dealt into blocks and meet all others.
    """
    labels = labels.select(F.col("node").alias("t"), "label").hint("merge")
    rows = written(buckets.join(labels, "t", "left").select("band", "t", F.coalesce("label", "t").alias("label")), "labelled")
    mixed = written(rows.join(several(rows, "band").hint("merge"), "band").select("t", "label").distinct(), "mixed").hint("merge")
    rows = written(prefixes(texts.join(mixed, "t"), docs, least, share), "prefixes")
    rows = written(rows.join(written(several(rows, "s"), "several").hint("merge"), "s"), "prefixes")
    few = rows.where("label <> main").select("s", F.col("t").alias("ta"), F.col("label").alias("la"), F.col("w").alias("wa"), F.col("rest").alias("ra"), F.pmod(F.xxhash64("t", "s"), "blocks").alias("block"))
    every = rows.select("s", F.col("t").alias("tb"), F.col("label").alias("lb"), "main", F.col("w").alias("wb"), F.col("rest").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    once = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("main")) | (F.col("ta") < F.col("tb")))
    room = F.least("ra", "rb") >= (F.col("wa") + F.col("wb")) * (least / (1 + least) - 1e-9)
    pairs = few.join(every.hint("merge"), ["s", "block"]).where(once & room)
    return pairs.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()


def links(texts: DataFrame, sketch: DataFrame, docs: int, least: float, share: float = 0.0) -> DataFrame:
    """(a, b), a < b: pairs of different texts of one class that join all of it; texts are rows (t, x)."""
    named = written(sketch.where(F.size("bands") > 0).groupBy("t").agg(F.first("bag").alias("bag"), F.first("bands").alias("bands"), F.first("counts").alias("counts")), "named")
    released(sketch)
    first = written(named.groupBy("bag").agg(F.min("t").alias("a"), F.count("*").alias("n")), "bags").hint("merge")
    alike = named.select("bag", F.col("t").alias("b")).join(first.where("n > 1"), "bag").where("a < b").select("a", "b")
    rows = named.join(first.select(F.col("a").alias("t")).hint("merge"), "t", "left_semi").select("t", F.explode("bands").alias("band"))
    size = written(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "sizes").hint("merge")
    rows = written(rows.join(size, "band"), "bands")
    pops = written(rows.groupBy("t").agg(F.sum("n").alias("pop")), "band-texts")
    rows = written(rows.join(pops.hint("merge"), "t").select("band", "t", "pop", "n"), "bands")
    wanted = pops.select("t")
    wanted = wanted.hint("broadcast") if pops.count() <= MAX_BROADCAST else wanted.hint("merge")
    texts = texts.join(wanted, "t", "left_semi").groupBy("t").agg(F.first("x").alias("x"))
    texts = written(texts.join(named.select("t", "counts").join(wanted, "t", "left_semi").hint("merge"), "t"), "texts")

    found = written(verify(pairs_of(rows), texts, docs, share), "verified")
    good = found.where(F.col("sim") >= least).select("a", "b")
    large = rows.where(F.col("n") > SMALL).select("band", "t")
    if not large.isEmpty():
        labels = components(good)
        pairs = rest_of(large, labels, texts, docs, least, share)
        pairs = pairs.join(found.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        more = written(verify(pairs, texts, docs, share), "verified").where(F.col("sim") >= least).select("a", "b")
        good = labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(more)  # a link a text holds what many do
    return good.unionByName(alike)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, share: float = 0.0) -> DataFrame:
    """(key, class_id, class_text, class_size, t) of every distinct (key, text): class_id is the smallest key of its class.

    Classes that share their smallest key (a key of several texts, or null) differ in class_text, the smallest name of
    the class's texts; it is null for null texts.  With ``share`` shingles that a smaller part of the documents holds weigh
    alike; without it the weights are plain TF-IDF.
    """
    with scratch() as keep:
        docs, chars = df.agg(F.count(text), F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0))).first()
        rows = chunked(df, key, text, chars)
        sketch = written(sketches(rows, docs, chars, share), "sketches")
        labels = components(links(rows.select("t", "x"), sketch, docs, least, share)).select(F.col("node").alias("t"), "label")
        members = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t")).distinct()
        members = keep(written(members.join(labels.hint("merge"), "t", "left").select("k", "t", F.coalesce("label", "t").alias("label")), "members"))
        heads = keep(written(members.groupBy("label").agg(F.min("k").alias("class_id"), F.count("*").alias("class_size")), "heads")).hint("merge")
    out = members.join(heads, "label").select(F.col("k").alias(key), "class_id", F.col("label").alias("class_text"), "class_size", "t")
    nothing = F.lit(None).cast("long")
    alone = df.where(F.col(text).isNull()).select(F.col(key), F.col(key).alias("class_id"), nothing.alias("class_text"), F.lit(1).cast("long").alias("class_size"), nothing.alias("t")).distinct()
    return out.unionByName(alone)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, share: float = 0.0) -> DataFrame:
    """The rows of ``df`` that stay: of each class the document of the smallest key; null texts all stay."""
    k, t, h = fresh(df, "head_key", "head_text", "own_text")
    with scratch() as keep:
        classes = near_duplicates(df.select(key, text), key, text, least, share).where(F.col("t").isNotNull())
        heads = classes.where(F.col(key).eqNullSafe(F.col("class_id"))).groupBy("class_text").agg(F.min("t").alias(t), F.first("class_id").alias(k))
        heads = keep(written(heads.select(k, t), "heads")).hint("merge")
    kept = df.withColumn(h, F.xxhash64(F.col(text))).join(heads, F.col(key).eqNullSafe(F.col(k)) & (F.col(h) == F.col(t)), "left_semi")
    counts = kept.groupBy(key, h).agg(F.count("*").alias(k)).where(F.col(k) > 1)
    if not counts.isEmpty():  # rows repeated in key and text
        kept = kept.dropDuplicates([key, h])
    return kept.drop(h).unionByName(df.where(F.col(text).isNull()))
