"""Target-distribution importance resampling: the documents whose words look most like a target, drawn without replacement.

A feature is a run of 1 to ``NGRAM`` successive words, hashed into ``BUCKETS`` buckets.  The gain of a bucket is the log
ratio of its smoothed shares in the target and in the documents, in thousandths; a document's weight is the mean gain of
its features.  Gumbel noise from a hash of the key is added, so that the highest scores are a draw without replacement
in proportion to the weights, the same in every run.

The k-th score is found by distributed quickselect: random pivot keys of the documents still in question are counted
against all of them, below, at and above, until a pivot is the k-th key.  Each round brings the pivots and their counts
to the driver and nothing else.  Only the winners are sorted: by ranges, each written once with its number and ranked
within itself, after the sizes of the ranges before it.

Rows: null text has no words, weight 0; null keys are hashed as ''.  Repeated keys are drawn row by row; ties of score go to the
smaller key, null first, then to fewer features; rows equal in all of it give equal results whichever is drawn.  Empty
tables, or fewer candidates than one draw needs, give no rank.  Other columns take no part and may have any name.  Very
long texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import scratch, written

BUCKETS = 10_000
NGRAM = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
PIVOTS = 32
#: Words whose bucket a task remembers.
MEMO = 1 << 18

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_KEY = ("low", "no_id", "id", "n", "tie")


class Buckets(dict):
    """Bucket of each feature, remembered for a bounded number of them."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.size
        return out


def bucket_rows(df: DataFrame, key: str | None, text: str, ngram: int, size: int) -> DataFrame:
    """(id, words, buckets): the bucket of every feature of each text, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(size)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                words, found = [], []
                for t in part.column(1).cast(pa.binary()):
                    w = _WORD.findall(t.as_buffer().to_pybytes().lower()) if t.is_valid else []  # bytes.lower touches A-Z alone
                    at = [known[x] for x in w]
                    for n in range(2, ngram + 1):
                        at += [known[b" ".join(w[i : i + n])] for i in range(len(w) - n + 1)]
                    words.append(len(w))
                    found.append(np.array(at, np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(found, pa.binary())], ["id", "words", "buckets"])

    return df.select((F.col(key) if key else F.lit(None)).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "id long, words long, buckets binary")


def bucket_counts(rows: DataFrame, size: int) -> list[int]:
    """Features of each bucket over all rows: a task adds up an array, which bounds what is shuffled and collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), np.int32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["b", "n"])

    out = [0] * size
    for b, n in rows.select("buckets").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(have: list[int], want: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored, for each bucket."""
    s, t, size = sum(have), sum(want), len(have)
    return np.array([math.floor(1000 * math.log((float(y + 1) * float(s + size)) / (float(x + 1) * float(t + size)))) for x, y in zip(have, want, strict=True)], np.int64)


def scored(rows: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(id, words, n, weight, score) of each row."""
    table = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for k, x in zip(ids, batch.column(2), strict=True):
                at = np.frombuffer(x.as_buffer(), np.int32)
                weight = int(table.value[at].sum()) // len(at) if len(at) else 0
                h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
                out.append((len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "words", "n", "weight", "score"])

    return rows.mapInArrow(run, "id long, words long, n long, weight long, score long")


def composite(key: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(_KEY, key, strict=True)])


def select_kth(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple:
    """The k-th smallest (from 1) of the distinct composite keys ``_KEY`` of ``rows``, which has k rows or more."""
    key = F.struct(*_KEY)
    low = high = None
    below, turn = 0, 0  # rows below the range (low, high), which holds the k-th
    while True:
        inside = rows
        if low:
            inside = inside.where((F.col("low") >= low[0]) & (key > composite(low)))
        if high:
            inside = inside.where((F.col("low") <= high[0]) & (key < composite(high)))
        drawn = inside.select(*_KEY).orderBy(F.xxhash64(F.lit(turn), *_KEY)).limit(pivots).collect()
        points = sorted(tuple(r) for r in drawn)
        counts = inside.agg(*[c for i, p in enumerate(points) for c in (F.count_if(key < composite(p)).alias(f"b{i}"), F.count_if(key == composite(p)).alias(f"e{i}"))]).first()
        start = below
        for i, p in enumerate(points):
            under, at = start + counts[f"b{i}"], counts[f"e{i}"]
            if under < k <= under + at:
                return p
            if under >= k:
                high = p
                break
            low, below = p, under + at
        turn += 1


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with their rank from 1, in the order of ``_KEY``."""
    dealt = written(winners.repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id()), "winners")
    sizes = dealt.groupBy("part").count().orderBy("part").collect()  # one row a partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    spark = winners.sparkSession
    offsets = spark.createDataFrame(before, "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*_KEY)) + F.col("before")
    return dealt.join(F.broadcast(offsets), "part").withColumn("rank", rank)


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, ngram: int = NGRAM, seed: int = SEED, pivots: int = PIVOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_features, weight, score, rank) of every document; rank is null where it was not drawn.

    Of the N documents with ``least_words`` words or more floor(percent * N / 100) are drawn.
    """
    with scratch() as keep:
        rows = written(bucket_rows(documents, key, text, ngram, buckets), "buckets")
        gain = gains(bucket_counts(rows, buckets), bucket_counts(bucket_rows(target, None, text, ngram, buckets), buckets))
        table = scored(rows, gain, seed).withColumns({"low": -F.col("score"), "no_id": F.col("id").isNotNull().cast("long"), "tie": F.monotonically_increasing_id()})
        table = written(table, "scores").withColumn("id", F.coalesce("id", F.lit(0)))
        able = table.where(F.col("words") >= least_words)
        k = able.count() * percent // 100
        rest = table.withColumn("rank", F.lit(None).cast("long"))
        if k:
            last = composite(select_kth(able, k, pivots))
            won = (F.col("words") >= least_words) & (F.struct(*_KEY) <= last)
            rest = rest.where(~won).unionByName(ranked(table.where(won)).select(rest.columns))
        back = F.when(F.col("no_id") == 1, F.col("id")).alias(key)
        return keep(written(rest.select(back, F.col("n").alias("n_features"), "weight", "score", F.col("rank").cast("long").alias("rank")), "resampled"))
