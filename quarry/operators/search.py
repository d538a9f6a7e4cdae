"""Keyword, vector and blended search; context for answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.functions import columns as C
from quarry.operators.tables import cut, first_n, sized, spread

UNICODE_WORDS, ASCII_WORDS = r"[\p{L}\p{N}]+", "[a-z]+"
K1, B = 1.2, 0.75


def tokens(text: Column | str, pattern: str = UNICODE_WORDS) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def query_terms(query: str) -> list[str]:
    """Terms of a query: words of two characters or more; each matches as a prefix and any suffices."""
    import re

    return list(dict.fromkeys(w for w in re.findall(r"\w+", query.lower()) if len(w) >= 2))


def build_postings(df: DataFrame, key: str, columns: list[str], pattern: str = UNICODE_WORDS, words: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl): one row per document and term; dl counts the tokens of all columns.

    With ``words`` (word) only these are terms, chosen before anything of a document is shuffled; dl counts all.
    """
    both = df.select(F.col(key), F.concat(*[tokens(c, pattern) for c in columns]).alias("toks"))
    rows = both.select(key, F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("term"))
    if words is not None:
        rows = rows.join(sized(cut(words.select(F.col("word").alias("term")).distinct())), "term", "left_semi")
    return rows.groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def statistics(df: DataFrame, columns: list[str], pattern: str = UNICODE_WORDS) -> DataFrame:
    """One row (docs, avgdl): documents and their mean number of tokens, counted without building the postings."""
    count = sum((F.regexp_count(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(pattern)) for c in columns), F.lit(0))
    return df.agg(F.count("*").alias("docs"), F.avg(count).alias("avgdl"))


def vocabulary(df: DataFrame, columns: list[str], pattern: str = UNICODE_WORDS) -> DataFrame:
    """(word, n): every word of the columns with its occurrences."""
    words = df.select(F.explode(F.concat(*[tokens(c, pattern) for c in columns])).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def prefix_matches(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term, word): the words that start with a term, by a dictionary of the words' prefixes.

    Each word is listed under its prefixes of the lengths that the terms have, so that words and terms meet on whole
    strings; what comes is one row a word and asking query.  The lengths, one number each, reach the driver.
    """
    asked = terms.select("query_id", "term").distinct()
    lengths = [r.n for r in asked.select(F.length("term").alias("n")).distinct().collect() if r.n]
    if not lengths:
        return asked.withColumn("word", F.col("term")).where("false")
    prefixes = F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in sorted(lengths)])
    listed = words.select("word").distinct().select("word", F.explode(F.filter(prefixes, lambda p: p.isNotNull())).alias("term"))
    return listed.join(sized(asked), "term").select("query_id", "term", "word")


def saturated(f: Column, dl: Column, avgdl: Column) -> Column:
    """BM25's share of a frequency, before the weight of the term; at most K1 + 1."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def rarity(docs: Column, n: Column) -> Column:
    """BM25's weight of a term that n of all documents hold."""
    idf = F.ln((docs - n + 0.5) / (n + 0.5))
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)


def scores_of_hits(hits: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) from (query_id, term, key, dl, f)."""
    df = hits.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    j = hits.join(sized(cut(df)), ["query_id", "term"]).join(F.broadcast(stats))
    part = rarity(F.col("docs"), F.col("n")) * saturated(F.col("f"), F.col("dl"), F.col("avgdl"))
    return j.withColumn("part", part).groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def bm25(postings: DataFrame, stats: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score): BM25 over (query_id, term) prefixes; stats is one row (docs, avgdl).

    A prefix counts as one phrase: its frequency is that of all words that start with it.  Postings meet the words
    that the dictionary of prefixes gives, on whole words.
    """
    words = postings.withColumnRenamed("term", "word")
    hits = words.join(sized(cut(prefix_matches(words, terms))), "word")
    return scores_of_hits(hits.groupBy("query_id", "term", key, "dl").agg(F.sum("tf").alias("f")), stats, key)


def terms_of(df: DataFrame, queries: list[tuple[int, str]]) -> DataFrame:
    """(query_id, term) of queries from the caller's code."""
    return df.sparkSession.createDataFrame([(i, t) for i, q in queries for t in query_terms(q)], "query_id int, term string")


def keyword_scores(df: DataFrame, terms: DataFrame, key: str, columns: list[str], pattern: str = UNICODE_WORDS) -> DataFrame:
    """(query_id, key, score) of every document that a query of (query_id, term) hits, not ranked.

    Without a stored index: one pass lists the words, which give the mean length and the words that the terms
    begin; a second one keeps the hits alone, before anything of a document is shuffled.
    """
    df = spread(df.select(key, *columns), key)  # a file of one row group would be one task's
    words = cut(vocabulary(df, columns, pattern))
    stats = counted(words, df)
    rows = df.select(F.col(key), F.concat(*[tokens(c, pattern) for c in columns]).alias("toks"))
    rows = rows.select(key, F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("word"))
    hits = rows.join(sized(cut(prefix_matches(words, terms))), "word")
    return scores_of_hits(cut(hits.groupBy("query_id", "term", key, "dl").agg(F.count("*").alias("f"))), cut(stats), key)


def keyword_candidates(df: DataFrame, terms: DataFrame, key: str, columns: list[str], k: int, pattern: str = UNICODE_WORDS, among: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score): the k best documents of every query of (query_id, term), as keyword_scores would give them.

    For many queries at once: a term's share of a document's score is made once, whoever asks for it, and slices of the
    documents meet crowds of queries, where a task adds up one query after the other and keeps its own k best.  What all
    queries hit together is never a row.  ``among`` (key) are the documents that may be found; rarity counts them all.
    """
    df = spread(df.select(key, *columns), key)  # a file of one row group would be one task's
    words = cut(vocabulary(df, columns, pattern))
    stats = cut(counted(words, df))
    asked = cut(terms.select("query_id", "term").distinct())
    meant = prefix_matches(words, asked.select(F.lit(0).alias("query_id"), "term").distinct()).select("term", "word")
    rows = df.select(F.col(key), F.concat(*[tokens(c, pattern) for c in columns]).alias("toks"))
    rows = rows.select(key, F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("word"))
    hits = cut(rows.join(sized(cut(meant)), "word").groupBy(key, "dl", "term").agg(F.count("*").alias("f")))
    n = cut(hits.groupBy("term").agg(F.count("*").alias("n")))
    part = rarity(F.col("docs"), F.col("n")) * saturated(F.col("f"), F.col("dl"), F.col("avgdl"))
    parts = hits.join(sized(n), "term").join(F.broadcast(stats)).select(key, "term", part.alias("part"))
    if among is not None:
        parts = parts.join(among.select(key).hint("merge"), key, "left_semi")
    fields = [terms.schema["query_id"], df.schema[key], StructField("score", DoubleType())]

    def block(x: pa.Table, asking: pa.Table) -> pa.Table:
        x, asking = x.sort_by(key), asking.sort_by("query_id")
        found = []
        if x.num_rows and asking.num_rows:
            ids = pd.factorize(x[key].to_pandas(), use_na_sentinel=False)[0]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            mine, wanted = alike(x, asking, "term", "term")
            order = np.argsort(mine, kind="stable")
            ids, part, mine = ids[order], x["part"].to_numpy()[order], mine[order]
            lo, hi = np.searchsorted(mine, wanted), np.searchsorted(mine, wanted, "right")
            who = pd.factorize(asking["query_id"].to_pandas(), use_na_sentinel=False)[0]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            total = np.zeros(len(starts))
            for a, b in zip(first, np.r_[first[1:], len(who)]):
                met = [slice(lo[t], hi[t]) for t in range(a, b) if hi[t] > lo[t]]
                for t in met:
                    total[ids[t]] += part[t]  # a term has a document once
                if met:
                    i = np.unique(np.concatenate([ids[t] for t in met])) if len(met) > 1 else ids[met[0]]
                    w = total[i].copy()
                    total[i] = 0.0
                    if len(w) > k:
                        near = w >= np.partition(w, len(w) - k)[len(w) - k] - 2e-6
                        i, w = i[near], w[near]
                    w = np.round(w, 6)
                    best = np.lexsort((i, -w))[:k]
                    found.append((np.full(len(best), a), starts[i[best]], w[best]))
        r, i, w = (np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([asking["query_id"].take(pa.array(r)), x[key].take(pa.array(i)), pa.array(w)], names=[f.name for f in fields])

    best = in_blocks(parts, asked, key, block, StructType(fields), crowd=100_000, rows=1_000_000)
    return first_n(best, ["query_id"], [F.desc("score"), F.asc(key)], k)


def keyword_search(df: DataFrame, queries: list[tuple[int, str]], key: str, columns: list[str], k: int = 10, offset: int = 0, pattern: str = UNICODE_WORDS) -> DataFrame:
    """(query_id, key, score, rank) of the best documents of every query, from the offset on."""
    scored = keyword_scores(df, terms_of(df, queries), key, columns, pattern)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= offset + k).where(F.col("rank") > offset)


class Segments:
    """Postings in segments below one path: a main one and smaller ones of later changes, read together.

    Each segment holds the postings of the documents indexed by it and the keys that it replaces or deletes, so a change
    costs what it touches.  A key's postings count where no later segment names the key.  ``merge`` writes one segment of
    what counts once the named keys are a share of all documents; older files go when the new main segment is marked.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, columns: list[str], pattern: str = UNICODE_WORDS) -> None:
        self.spark, self.path, self.key, self.columns, self.pattern = spark, path, key, columns, pattern

    def _path(self, *parts) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, parts)]))
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _numbers(self, what: str) -> list[int]:
        p, store = self._path(what)
        return sorted(int(x.getPath().getName()) for x in store.listStatus(p)) if store.exists(p) else []

    def live(self) -> list[int]:
        """Numbers of the segments that are read: the main one and all after it."""
        done, main = self._numbers("_done"), self._numbers("_main")
        return [n for n in done if not main or n >= main[-1]]

    def _write(self, postings: DataFrame, gone: DataFrame, main: bool = False) -> int:
        number = max(self._numbers("_done"), default=0) + 1
        postings.write.mode("overwrite").parquet(f"{self.path}/postings/segment={number}")
        gone.write.mode("overwrite").parquet(f"{self.path}/gone/segment={number}")
        for mark in ("_done", "_main")[: 1 + main]:  # nothing is read before it is marked
            p, store = self._path(mark, number)
            store.mkdirs(p)
        return number

    def add(self, changed: DataFrame, deleted: DataFrame | None = None) -> int:
        """Indexes documents, new ones and new versions, and forgets the ``deleted`` (key); the segment's number."""
        keys = changed.select(self.key)
        gone = (keys if deleted is None else keys.unionByName(deleted.select(self.key))).where(F.col(self.key).isNotNull()).distinct()
        return self._write(build_postings(changed, self.key, self.columns, self.pattern), gone)

    def _table(self, what: str, numbers: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/segment={n}" for n in numbers])

    def read(self) -> DataFrame:
        """(key, dl, term, tf) as build_postings would give them for the documents as they are now."""
        live = self.live()
        if len(live) == 1:
            return self._table("postings", live).drop("segment")
        last = self._table("gone", live[1:]).groupBy(self.key).agg(F.max("segment").alias("__last"))
        return self._table("postings", live).join(sized(last), self.key, "left").where("__last is null or __last <= segment").drop("segment", "__last")

    def merge(self, share: float = 0.1) -> bool:
        """Makes one segment of all if the keys named after the main one are at least ``share`` of its documents."""
        live = self.live()
        if len(live) < 2 or self._table("gone", live[1:]).count() < share * self._table("gone", live[:1]).count():
            return False
        number = self._write(self.read(), self.read().select(self.key).distinct(), True)
        for n in live:
            for what in ("postings", "gone"):
                p, store = self._path(what, f"segment={n}")
                store.delete(p, True)
        return number > live[-1]


def counted(words: DataFrame, df: DataFrame) -> DataFrame:
    """One row (docs, avgdl) from the vocabulary (word, n) of the documents."""
    return df.agg(F.count("*").alias("docs")).join(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))).select("docs", (F.col("total") / F.col("docs")).alias("avgdl"))


def impact_blocks(postings: DataFrame, stats: DataFrame, lengths: list[int], key: str = "doc_id", block: int = 128, slices: int = 16, phrases: DataFrame | None = None) -> DataFrame:
    """An index for searches that end early: (phrase, slice, block, bound, n, entries), entries being (key, f, dl).

    A phrase is a word's prefix of one of the lengths, with the frequencies of all its words.  Its entries are dealt into
    slices by a hash of the key, so that no frequent phrase is one task's, sorted by their share of a score and cut into
    blocks; ``bound`` is the largest share in the block.  Write it partitioned or sorted by phrase.  With ``phrases``
    (phrase) only these are indexed, each with all its entries, for searches that are known beforehand.
    """
    prefixes = F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in sorted(set(lengths))])
    rows = postings.select(key, "dl", "tf", F.explode(F.filter(prefixes, lambda p: p.isNotNull())).alias("phrase"))
    if phrases is not None:
        rows = rows.join(sized(phrases.select("phrase").distinct()), "phrase", "left_semi")
    rows = rows.groupBy("phrase", key, "dl").agg(F.sum("tf").alias("f")).join(F.broadcast(stats))
    rows = rows.select("phrase", key, "dl", "f", saturated(F.col("f"), F.col("dl"), F.col("avgdl")).alias("share"), F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("slice"))
    place = F.row_number().over(Window.partitionBy("phrase", "slice").orderBy(F.desc("share"), key)) - 1
    rows = rows.withColumn("block", F.floor(place / block).cast("int"))
    entry = F.struct(F.col(key), "f", "dl")
    return rows.groupBy("phrase", "slice", "block").agg(F.max("share").alias("bound"), F.count("*").alias("n"), F.collect_list(entry).alias("entries"))


def blocks_asked(index: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """The blocks of the query terms with the term's weight, and the most that a document outside the block's phrase can add.

    The directory (phrase, documents, largest share) is one row a phrase, added up before terms meet it.
    """
    directory = index.groupBy("phrase").agg(F.sum("n").alias("docs_of"), F.max("bound").alias("top"))
    asked = terms.select("query_id", F.col("term").alias("phrase")).distinct()
    known = directory.join(sized(asked), "phrase").join(F.broadcast(stats)).select("query_id", "phrase", "top", rarity(F.col("docs"), F.col("docs_of")).alias("idf"), "avgdl")
    known = cut(known)  # one row a query term
    total = known.groupBy("query_id").agg(F.sum(F.col("idf") * F.col("top")).alias("total"))
    known = known.join(total.hint("merge"), "query_id").withColumn("rest", F.col("total") - F.col("idf") * F.col("top"))
    return index.join(sized(cut(known.select("query_id", "phrase", "idf", "avgdl", "rest"))), "phrase")


def block_scores(blocks: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) from the entries of blocks_asked's rows."""
    rows = blocks.select("query_id", "idf", "avgdl", F.explode("entries").alias("e")).select("query_id", F.col(f"e.{key}").alias(key), (F.col("idf") * saturated(F.col("e.f"), F.col("e.dl"), F.col("avgdl"))).alias("part"))
    return rows.groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def blocks_read(index: DataFrame, stats: DataFrame, terms: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The blocks that can hold a document of a query's first k; all others are passed over.

    The first block of every slice gives scores that are too low, if wrong; their k-th is a floor for the true k-th.  A
    document of another block reaches at most the block's bound and the tops of all other terms, so where that lies
    below the floor no document of the block is among the first k, and what is left scores them in full.
    """
    asked = blocks_asked(index, stats, terms)
    low = first_n(block_scores(asked.where("block = 0"), key), ["query_id"], [F.desc("score"), F.asc(key)], k)
    floor = low.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    reach = F.col("idf") * F.col("bound") + F.col("rest")
    return asked.join(sized(cut(floor)), "query_id").where(F.col("floor").isNull() | (reach >= F.col("floor") - 2e-6))


def keyword_topk(index: DataFrame, stats: DataFrame, terms: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score, rank): the same rows as a full search, from the blocks that matter."""
    scored = block_scores(blocks_read(index, stats, terms, k, key), key)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def updated_postings(postings: DataFrame, changed: DataFrame, key: str, columns: list[str], pattern: str = UNICODE_WORDS) -> DataFrame:
    """Postings after the changed documents were indexed anew."""
    return postings.join(changed.select(key).distinct().hint("merge"), key, "left_anti").unionByName(build_postings(changed, key, columns, pattern))


def index_gaps(df: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """(key, missing): documents without postings and postings without document; empty if all is well."""
    a, b = df.select(key).distinct(), postings.select(key).distinct()
    return a.join(b.hint("merge"), key, "left_anti").withColumn("missing", F.lit("postings")).unionByName(b.join(a.hint("merge"), key, "left_anti").withColumn("missing", F.lit("document")))


def by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (places, unit vectors)}; null vectors are in none, null components are NaN."""
    v = vectors.combine_chunks()
    size = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        out[d] = at, unit(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
    return out


def slabs(base: pa.Table, asking: pa.Table, scores: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, cosines of some queries with the whole base), of about ``scores`` numbers each; NaN where one has no cosine, 0 where a vector is zero."""
    x, q, n, m = by_length(base["embedding"]), by_length(asking["q"]), base.num_rows, asking.num_rows
    step = max(1, scores // max(1, n))
    for lo in range(0, m, step):
        hi = min(m, lo + step)
        out = None
        for d, (to, u) in q.items():
            if d in x:
                some = (to >= lo) & (to < hi)
                part = u[some] @ x[d][1].T
                if part.shape == (hi - lo, n):
                    out = part
                else:
                    out = np.full((hi - lo, n), np.nan) if out is None else out
                    out[np.ix_(to[some] - lo, x[d][0])] = part
        yield lo, np.full((hi - lo, n), np.nan) if out is None else out


def kept_places(score: np.ndarray, k: int | None, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k largest of every row, ties to the first column; a score that is NaN comes last."""
    worth = np.where(np.isnan(score), -2.0, score)
    if allowed is not None:
        worth[~allowed] = -np.inf
    if k is not None and worth.shape[1] > k:  # what rounding could lift to the k-th stays in
        worth[worth < np.partition(worth, worth.shape[1] - k, axis=1)[:, [worth.shape[1] - k]] - 2e-6] = -np.inf
    r, i = np.nonzero(worth > -np.inf)
    w = np.round(worth[r, i], 6) + 0.0
    if k is not None:
        order = np.lexsort((i, -w, r))
        r, i, w = r[order], i[order], w[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, i, w = r[first], i[first], w[first]
    return r, i, np.where(w == -2, np.nan, w)


def alike(base: pa.Table, asking: pa.Table, column: str, other: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values of both columns, the same for equal ones; -1 and -2 for nulls."""
    x, y = base[column].to_pandas(), asking[other].to_pandas()
    codes = pd.factorize(pd.concat([x, y], ignore_index=True))[0]
    return codes[: len(x)], np.where(codes[len(x) :] < 0, -2, codes[len(x) :])


def in_blocks(base: DataFrame, queries: DataFrame, key: str, block: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType, crowd: int = 4_096, rows: int = 65_536) -> DataFrame:
    """The rows that ``block`` gives for every slice of ``base``, by hash of ``key``, with every crowd of queries (query_id, q, ...).

    Slices hold about ``rows``, crowds about ``crowd``; each slice meets each crowd in one task, so neither side is broadcast.
    """
    crowds = max(1, -(-queries.count() // crowd))
    slices = max(16, -(-base.count() // rows))
    tasks = min(crowds * slices, 2_000)
    b = base.withColumn("__s", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")).withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))))
    q = queries.withColumn("__c", F.pmod(F.xxhash64("query_id"), F.lit(crowds)).cast("int")).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    b, q = (x.repartition(tasks, "__c", "__s").groupBy("__c", "__s") for x in (b, q))
    return b.cogroup(q).applyInArrow(block, schema)


def cosine_topk(base: DataFrame, queries: DataFrame, k: int = 10, least: float | None = None, apart: Iterable[tuple[str, str]] = (), within: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """(query_id, chunk_id, score, ...): the k most similar vectors of every query, exact, for a query set of any size.

    queries is (query_id, q[, ...]); other columns of both sides stay.  Each task multiplies blocks and keeps its own k best
    of a query, so no pair beyond those leaves it.  Pairs equal in the columns of ``apart`` (base, query) or not equal
    in those of ``within`` are left out, nulls too.  Null vectors come last, without a score; zero vectors have 0.
    """
    apart, within = list(apart), list(within)
    mine = [c for c in queries.columns if c not in ("q", "query_id")]
    own = [c for c in base.columns if c != "embedding"]
    fields = [queries.schema["query_id"], *[base.schema[c] for c in own], *[queries.schema[c] for c in mine], StructField("score", DoubleType())]

    def block(x: pa.Table, asking: pa.Table) -> pa.Table:
        x = x.sort_by("chunk_id")
        tests = [(*alike(x, asking, a, b), False) for a, b in apart] + [(*alike(x, asking, a, b), True) for a, b in within]
        found = []
        for lo, score in slabs(x, asking) if x.num_rows and asking.num_rows else ():
            allowed = None
            for left, right, equal in tests:
                some = right[lo : lo + len(score), None]
                part = (left == some) == equal
                part &= (left >= 0) & (some >= 0)
                allowed = part if allowed is None else allowed & part
            if least is not None:
                enough = np.round(score, 6) >= least
                allowed = enough if allowed is None else allowed & enough
            r, i, w = kept_places(score, k, allowed)
            found.append((r + lo, i, w))
        r, i, w = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        left, right = x.select(own).take(pa.array(i)), asking.select(["query_id", *mine]).take(pa.array(r))
        return pa.table([right["query_id"], *left.columns, *[right[c] for c in mine], pa.array(w, from_pandas=True)], names=[f.name for f in fields])

    near = in_blocks(base, queries, "chunk_id", block, StructType(fields))
    return first_n(near, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


@dataclass
class VectorLists:
    """Directions of the lists that vectors are dealt into, and how many lists a query looks into."""

    centers: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n lists nearest to each vector, nearest first."""
        return np.argsort(-(unit(vectors) @ self.centers.T), axis=1, kind="stable")[:, :n]


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def vector_lists(base: DataFrame, key: str = "chunk_id", vector: str = "embedding", lists: int = 64, sample: int = 8_000, asked: int = 200, k: int = 10, recall: float = 0.97) -> VectorLists:
    """Lists by spherical k-means over at most ``sample`` vectors, in the order of a hash of their key.

    The number of lists to look into is measured: the least with which ``recall`` of the true ``k`` nearest of ``asked``
    vectors of the sample are met in the sample.  Neighbours in the whole table are nearer and are met sooner.
    """
    rows = base.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("v")).orderBy("h", "i").limit(sample).toPandas()
    x = unit(np.array(rows["v"].to_list(), np.float64)) if len(rows) else np.zeros((0, 1))
    if not len(x):
        return VectorLists(np.zeros((0, 1)), 0)
    centers = x[np.random.default_rng(5).permutation(len(x))[:lists]]
    for _ in range(12):
        at = (x @ centers.T).argmax(1)
        total = np.zeros_like(centers)
        np.add.at(total, at, x)
        held = np.linalg.norm(total, axis=1) > 0
        centers[held] = unit(total[held])
    out = VectorLists(centers, len(centers))
    home = out.nearest(x, 1)[:, 0]
    order = out.nearest(x[:asked], len(centers))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centers))[None, :].repeat(len(order), 0), 1)
    true = np.argsort(-(x[:asked] @ x.T), axis=1)[:, : k + 1]
    needed = np.sort(np.take_along_axis(place, home[true], 1).ravel())
    out.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
    return out


def near_vectors(base: DataFrame, queries: DataFrame, lists: VectorLists, k: int = 10, probes: int | None = None, key: str = "chunk_id", vector: str = "embedding", block: int = 4_096, crowd: int = 4_096) -> DataFrame:
    """(query_id, key, score): the k most similar vectors found for every query (query_id, q), by exact cosine.

    Every vector lies in one list, lists are cut into blocks of about ``block`` by a hash of the key, so a full list is no
    one task's, and queries come in crowds, so no task holds more than a block and a crowd.  ``probes`` of all lists is exact.
    """
    probes = min(len(lists.centers), probes or lists.probes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(base.dtypes)[key]}, score double"
    if not probes:
        return base.sparkSession.createDataFrame([], schema)

    @F.pandas_udf("array<int>")
    def into(v: pd.Series, n: pd.Series) -> pd.Series:
        found = lists.nearest(np.array(v.to_list(), np.float64), int(n.max()) if len(n) else 1) if len(v) else []
        return pd.Series([f.tolist() for f in found], dtype=object)

    def best(pair: tuple, vectors: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asking):
            return pd.DataFrame({"query_id": asking["query_id"][:0], key: vectors[key][:0], "score": pd.Series(dtype=float)})
        ids = vectors[key].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], unit(np.array(vectors["v"].to_list(), np.float64)[order])
        score = np.round(unit(np.array(asking["q"].to_list(), np.float64)) @ x.T, 6)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ties to the smaller key
        return pd.DataFrame({"query_id": np.repeat(asking["query_id"].to_numpy(), top.shape[1]), key: ids[top.ravel()], "score": np.take_along_axis(score, top, 1).ravel()})

    dealt = cut(base.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).select(key, "v", into("v", F.lit(1))[0].alias("list")))
    blocks = dealt.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # one row a list
    crowds = max(1, -(-queries.count() // crowd))
    places = dealt.join(F.broadcast(blocks), "list").select(key, "v", "list", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))).alias("crowd"))
    ask = queries.where(F.col("q").isNotNull()).select("query_id", F.col("q").cast("array<double>").alias("q"))
    ask = ask.select("query_id", "q", F.explode(into("q", F.lit(probes))).alias("list"), F.pmod(F.xxhash64("query_id"), F.lit(crowds)).cast("int").alias("crowd"))
    ask = ask.join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    met = places.groupBy("list", "block", "crowd").cogroup(ask.groupBy("list", "block", "crowd")).applyInPandas(best, schema)
    return first_n(met, ["query_id"], [F.desc("score"), F.asc(key)], k)


def hybrid_search(base: DataFrame, queries: DataFrame, keywords: list[str], k: int = 10, weight: float = 0.7) -> DataFrame:
    """Cosine blended with the share of keywords present in the text, over the 2k nearest."""
    near = cosine_topk(base.drop("text"), queries, 2 * k).join(base.select("chunk_id", "text").hint("merge"), "chunk_id")
    present = sum((F.when(F.contains(F.lower("text"), F.lit(w.lower())), 1).otherwise(0) for w in keywords), F.lit(0)) / F.lit(max(1, len(keywords)))
    scored = near.withColumn("combined", F.round(weight * F.col("score") + (1 - weight) * present, 6))
    return first_n(scored, ["query_id"], [F.desc("combined"), F.asc("chunk_id")], k)


def best_per_document(scored: DataFrame) -> DataFrame:
    """(query_id, doc_id, best) from chunk scores."""
    return scored.groupBy("query_id", "doc_id").agg(F.max("score").alias("best"))


def ranked_search(keyword: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, keyword_weight: float = 0.3, semantic_weight: float = 0.7, candidates: int = 5) -> DataFrame:
    """Two-stage search: (query_id, doc_id, score).

    keyword is (query_id, doc_id, score); its best k * candidates are divided by the query's largest score and
    blended with the best cosine of their own chunks (0 without one), so only candidates' vectors are compared.
    A query (query_id, q) without keyword hits falls back to its nearest documents.
    """
    total = keyword_weight + semantic_weight
    wk, ws = keyword_weight / total, semantic_weight / total
    cand = first_n(keyword, ["query_id"], [F.desc("score"), F.asc("doc_id")], k * candidates)
    top = F.max("score").over(Window.partitionBy("query_id"))
    cand = cand.withColumn("kw", F.when(top > 0, F.col("score") / top).otherwise(0.0)).select("query_id", "doc_id", "kw")
    cand = cut(cand)  # used three times
    near = cand.join(vectors.select("doc_id", "embedding"), "doc_id").join(queries.select("query_id", "q").hint("merge"), "query_id")
    sem = best_per_document(near.select("query_id", "doc_id", C.cosine(F.col("embedding"), F.col("q")).alias("score")))
    blended = cand.join(sem, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(wk * F.col("kw") + ws * F.coalesce("best", F.lit(0.0)), 6).alias("score"))
    none = queries.select("query_id", "q").join(cand.select("query_id").distinct().hint("merge"), "query_id", "left_anti")
    only = best_documents(vectors, cut(none), k).withColumnRenamed("best", "score")
    return first_n(blended.unionByName(only), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def cross_document_evidence(scored: DataFrame, min_sources: int = 2) -> DataFrame:
    """Best chunk of every document of a claim, if enough documents support it."""
    best = first_n(scored, ["query_id", "doc_id"], [F.desc("score"), F.asc("chunk_id")], 1)
    n = best.groupBy("query_id").agg(F.count("*").alias("sources")).where(F.col("sources") >= min_sources)
    return best.join(n, "query_id")


def context(chunks: DataFrame, measurements: DataFrame, relations: DataFrame, species_of_chunk: DataFrame, most_species: int = 5, used: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(species, measurements, relations) around retrieved chunks (query_id, chunk_id)."""
    s = chunks.join(species_of_chunk, "chunk_id").groupBy("query_id", "species_id").agg(F.count("*").alias("n"))
    s = first_n(s, ["query_id"], [F.desc("n"), F.asc("species_id")], most_species)
    few = first_n(s, ["query_id"], [F.desc("n"), F.asc("species_id")], used).select("query_id", "species_id")
    m = measurements.join(few.hint("merge"), "species_id")
    out = relations.join(few.withColumnRenamed("species_id", "subject").hint("merge"), "subject").select("query_id", "subject", "object", "type")
    back = relations.join(few.withColumnRenamed("species_id", "object").hint("merge"), "object").select("query_id", "subject", "object", "type")
    return s, m, out.unionByName(back).distinct()


def context_text(passages: DataFrame, n: int = 5, width: int = 800) -> DataFrame:
    """(query_id, context): the best passages of a query, cut and numbered."""
    best = first_n(passages, ["query_id"], [F.desc("score"), F.asc("chunk_id")], n)
    best = best.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))))
    line = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.substring("text", 1, width))
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))), lambda s: s["line"]), "\n").alias("context"))


def species_context(species_id: int, vectors: DataFrame, mentions: DataFrame, measurements: DataFrame, relations: DataFrame, chunks: int = 15, hops: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, measurements, relations) of one species: its first chunks, all its values, its network over ``hops``."""
    from quarry.operators.analytics import k_hop_edges

    docs = mentions.where(F.col("species_id") == species_id).select("doc_id").distinct()
    c = vectors.join(docs.hint("merge"), "doc_id", "left_semi").orderBy("chunk_id").limit(chunks)
    return c, measurements.where(F.col("species_id") == species_id), k_hop_edges(relations, species_id, hops)


def recent_years(keyword: DataFrame, papers: DataFrame, as_of: int, years: int = 5) -> DataFrame:
    """Hits of papers from the last years before and up to ``as_of``; for ranked_search as for a keyword search."""
    return keyword.join(papers.where(F.col("year") >= as_of - years).select("doc_id").hint("merge"), "doc_id", "left_semi")


def in_domain(keyword: DataFrame, papers: DataFrame, domain: str) -> DataFrame:
    """Hits of papers of one primary domain."""
    return keyword.join(papers.where(F.col("primary_domain") == domain).select("doc_id").hint("merge"), "doc_id", "left_semi")


def top_papers(keyword: DataFrame, papers: DataFrame, as_of: int, years: int | None = None, domain: str | None = None) -> DataFrame:
    """Hits of papers of the last years, of one primary domain, or both; what is not given does not filter."""
    out = recent_years(keyword, papers, as_of, years) if years else keyword
    return in_domain(out, papers, domain) if domain else out


def best_documents(base: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, best): of every query the k documents whose best chunk is nearest; without k every document.

    A document's chunks meet a crowd in one task, which takes their maximum before anything leaves it.
    """
    fields = [queries.schema["query_id"], base.schema["doc_id"], StructField("best", DoubleType())]

    def block(x: pa.Table, asking: pa.Table) -> pa.Table:
        x = x.sort_by("doc_id")
        ids = pd.factorize(x["doc_id"].to_pandas(), use_na_sentinel=False)[0]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
        found = [(r + lo, starts[i], w) for lo, s in (slabs(x, asking) if len(ids) and asking.num_rows else ()) for r, i, w in [kept_places(np.fmax.reduceat(s, starts, axis=1), k)]]
        r, i, w = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([asking["query_id"].take(pa.array(r)), x["doc_id"].take(pa.array(i)), pa.array(w, from_pandas=True)], names=[f.name for f in fields])

    small = {} if k else {"crowd": 1_024, "rows": 8_192}  # without k a block gives as many rows as it has pairs
    best = in_blocks(base.select("doc_id", "embedding"), queries.select("query_id", "q"), "doc_id", block, StructType(fields), **small)
    return best if k is None else first_n(best, ["query_id"], [F.desc("best"), F.asc("doc_id")], k)


def by_author(keyword: DataFrame, papers: DataFrame, name: str) -> DataFrame:
    """Hits of papers with an author (authors[]) whose name contains the text."""
    return keyword.join(papers.where(F.exists("authors", lambda a: F.lower(a).contains(name.lower()))).select("doc_id").hint("merge"), "doc_id", "left_semi")
