"""Approximate nearest neighbours by inner product: an inverted multi-index.

Vectors are cut into two halves, each quantised by its own ``CENTROIDS`` centroids, fitted by k-means on a
bounded sample (``SAMPLE`` vectors, by hash order).  A cell is a pair of centroids; every vector is indexed
in its cell.  A query walks the pairs with a heap in the order of the sum of the two halves' distances.  As the
nearness is the inner product, a half's distance to a centroid is the negative of what its members can reach: their
mean product with the query, plus ``SPREADS`` times the query's length times the deviation of the centroid's members
in one direction.  (Euclidean distances would pass over long vectors, which have the largest products.)

The walk goes on until the cells it has met hold a share of all vectors, and the entries of those cells are reranked
by their exact inner product in double precision, ties to the smaller id.  The share is measured, not set: ``ASKED``
vectors of the sample are asked against the whole sample, and the share is the least with which ``RECALL`` of their
true neighbours are met.  Neighbours in the full table are nearer than those in a sample of it and are met sooner.

Cells are packed into blocks of about ``BLOCK`` vectors; a cell of more is dealt over several blocks, so a
hot cell never meets in one task, and queries come in crowds of ``QUERIES``.  The cell counts (CENTROIDS^2 at most)
and the centroids are all that reaches the driver besides the sample.  Of equal vectors only the ``k + 1`` smallest
ids can be among anyone's k nearest, so the others leave the search before it starts; nothing else is cut.

Vectors that are null, all zero, of another length than most, or with null or non-finite components take no
part.  Of several rows of one id the smallest vector counts.  Fewer than k candidates: all are returned.  An empty
table gives an empty result; further columns take no part and may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

CENTROIDS, SAMPLE, BLOCK, QUERIES = 64, 8_000, 4_096, 8_192
SPREADS, RECALL, ASKED = 1.5, 0.97, 200


def valid(v: Column) -> Column:
    """A vector that takes part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of the rows, started from the first distinct rows."""
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(7).permutation(len(c))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)


class Index:
    """Centroids of both halves, cell counts and the blocks of every cell; fitted on the rows of a sample."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS):
        self.half = sample.shape[1] // 2
        parts = sample[:, : self.half], sample[:, self.half :]
        self.first, self.second = (kmeans(x, centroids) for x in parts)
        self.spreads = [self.spread(x, c) for x, c in zip(parts, (self.first, self.second), strict=True)]

    @staticmethod
    def spread(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Root mean square deviation of each centroid's members from it, in one direction."""
        near = nearest(x, c)
        off = np.bincount(near, ((x - c[near]) ** 2).mean(1), len(c))
        return np.sqrt(off / np.maximum(1, np.bincount(near, minlength=len(c))))

    def distances(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half, every centroid's negative reach towards the query."""
        halves = q[: self.half], q[self.half :]
        return [-(c @ part) - SPREADS * np.sqrt(part @ part) * s for c, part, s in zip((self.first, self.second), halves, self.spreads, strict=True)]

    def share(self, sample: np.ndarray, k: int, recall: float = RECALL) -> float:
        """The share of all vectors that a walk must meet so that ``recall`` of the k nearest are among them, by the sample."""
        if len(sample) < 2:
            return 1.0
        cells, met = self.cells(sample), []
        for i in np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int):
            a, b = self.distances(sample[i])
            far = (a[:, None] + b[None, :]).ravel()[cells]
            score = sample @ sample[i]
            score[i] = -np.inf
            near = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
            met.append(np.searchsorted(np.sort(far), far[near], side="right") / len(sample))
        return float(np.quantile(np.concatenate(met), recall, method="higher"))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def deal(self, counts: np.ndarray) -> None:
        """Blocks: cells of up to BLOCK vectors share one, larger ones have several of their own."""
        self.counts, self.start, self.parts = counts, np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        block, room = 0, BLOCK
        for c, n in enumerate(counts.tolist()):
            if n > BLOCK:
                block += room < BLOCK
                self.start[c], self.parts[c] = block, -(-n // BLOCK)
                block, room = block + int(self.parts[c]), BLOCK
            else:
                if n > room:
                    block, room = block + 1, BLOCK
                self.start[c], room = block, room - n

    def walk(self, q: np.ndarray, want: float) -> list[int]:
        """Non-empty cells by summed distance, until they hold ``want`` vectors."""
        d = self.distances(q)
        order = [np.argsort(x, kind="stable") for x in d]
        a, b = (x[o].tolist() for x, o in zip(d, order, strict=True))
        heap, out, have, width = [(a[0] + b[0], 0, 0)], [], 0, len(self.second)
        while heap and have < want:
            _, i, j = heapq.heappop(heap)
            cell = int(order[0][i]) * width + int(order[1][j])
            if self.counts[cell]:
                out.append(cell)
                have += self.counts[cell]
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out


def search(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", visit: float | None = None) -> DataFrame:
    """(query_id, rank, key, score): for every row with ``queries`` its k nearest other rows.

    visit: the share of all vectors to meet, 1 for an exact search; measured on the sample if not given.
    """
    spark = df.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.where(F.col(key).isNotNull() & valid(F.col(vector))).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = size[0]["n"] if size else 2
    rows = rows.where(F.size("v") == size)
    if size == 1:  # a zero changes no product and gives the second half something to hold
        rows = rows.withColumn("v", F.concat("v", F.array(F.lit(0.0))))
    rows = written(rows, "vectors")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    schema = f"query_id long, rank int, {key} long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    x = np.stack(sample["v"].to_list())
    index = Index(x)
    visit = index.share(x, k) if visit is None else visit

    @F.pandas_udf("int")
    def cell(s: pd.Series) -> pd.Series:
        return pd.Series(index.cells(np.stack(s.to_list())) if len(s) else [], dtype="int32")

    base = rows.withColumn("twin", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("twin") <= k + 1)
    base = written(base.select("id", "v", cell("v").alias("cell")), "cells")
    counts = base.groupBy("cell").count().toPandas()  # CENTROIDS^2 rows at most
    all_counts = np.zeros(len(index.first) * len(index.second), np.int64)
    all_counts[counts["cell"].to_numpy()] = counts["count"].to_numpy()
    index.deal(all_counts)
    want = max(k + 1, visit * all_counts.sum())

    @F.pandas_udf("int")
    def block(cells: pd.Series, h: pd.Series) -> pd.Series:
        c = cells.to_numpy(np.int64)
        return pd.Series(index.start[c] + h.to_numpy(np.int64) % index.parts[c], dtype="int32")

    blocks = base.withColumn("block", block("cell", F.xxhash64("id")))
    asked = rows.where("asks").select("id", "v")
    crowds = max(1, -(-asked.count() // QUERIES))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, q in zip(pdf["id"], pdf["v"], strict=True):
                mine: dict[int, list[int]] = {}
                for c in index.walk(np.asarray(q), want):
                    for b in range(int(index.start[c]), int(index.start[c] + index.parts[c])):
                        mine.setdefault(b, []).append(c)
                out.extend((i, q, b, cs) for b, cs in mine.items())
            yield pd.DataFrame(out, columns=["query", "q", "block", "cells"])

    visits = asked.repartition(max(crowds, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id").mapInPandas(walk, "query long, q array<double>, block int, cells array<int>")
    visits = written(visits.withColumn("crowd", F.pmod(F.xxhash64("query"), F.lit(crowds)).cast("int")), "visits")
    pairs = written(visits.select("block", "crowd").distinct(), "blocks").hint("merge")
    entries = blocks.join(pairs, "block").select("block", "crowd", "id", "v", "cell")

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", key, "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names}).astype({"query_id": "int64", key: "int64", "score": "float64"})
        e, ids, cells = np.stack(right["v"].to_list()), right["id"].to_numpy(), right["cell"].to_numpy()
        found = []
        for at in range(0, len(left), 256):
            part = left.iloc[at : at + 256]
            q = np.stack(part["q"].to_list())
            near = q @ e.T
            for i, (query, met) in enumerate(zip(part["query"], part["cells"], strict=True)):
                ok = np.flatnonzero(np.isin(cells, met) & (ids != query))
                if len(ok) > k:
                    s = near[i, ok]
                    ok = ok[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * (1 + np.abs(s).max())]
                s = (e[ok] * q[i]).sum(1)  # the same sum for equal vectors, wherever they lie
                best = np.lexsort((ids[ok], -s))[:k]
                found.append((np.full(len(best), query), ids[ok][best], s[best]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*found, strict=True), strict=True)})

    by = ["block", "crowd"]
    near = visits.groupBy(*by).cogroup(entries.groupBy(*by)).applyInPandas(rerank, f"query_id long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), key, "score")
