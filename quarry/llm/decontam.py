"""Benchmark decontamination: MinHash containment search, size-partitioned, then exact containment.

Texts become sets of five-word shingles (lower case, words are runs of letters and digits; an item of fewer
words is one shingle of all its words).  A document holds an item when it has at least ``threshold`` of the
item's shingles.

Items are partitioned by the size of their shingle set.  Sets of up to 16 shingles are searched whole; a
larger set is represented by its minima under a number of hash functions that grows with the size class.
The minimum under a random hash is a uniform draw from the set, so the share of an item's minima found in a
document estimates its containment, whatever the document's length, and an item of containment 0.8 has none
of 12 minima in the document with probability 0.2^12.  Documents that meet a minimum are candidates; the
containment of each pair is then counted on all shingles.

All steps are DataFrame operations.  Benchmark tables are broadcast below ``MAX_BROADCAST`` counted rows and
merge-joined beyond.  Documents and items are recognised by a 64-bit hash of their text, whatever their key: equal texts share
their result, and a null or repeated key never passes one document's finding on to another.  In the report rows equal
in key are one document, and rows of the benchmark equal in item_id one item (of several containments the largest
counts); null keys are reported as null.  Null or wordless texts and items hold nothing and are never
reported; very long texts are read whole; empty tables give an empty report and keep all documents.  Further columns
stay and may have any name but ``__bad``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, scratch, written

N, THRESHOLD, WHOLE, MAX_BROADCAST = 5, 0.8, 16, 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, n: int) -> Column:
    """Hashes of all runs of n words; empty array below n words."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    some = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
    return F.when(F.size(words) >= n, some).otherwise(F.array().cast("array<bigint>"))


def item_shingles(benchmark: DataFrame, text: str) -> DataFrame:
    """(u, n, s, size): every distinct shingle of every item, named u by its text's hash; n words each."""
    base = benchmark.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("u"), words(F.col(text)).alias("w")).where("size(w) > 0")
    parts = [base.where(F.size("w") >= N if n == N else F.size("w") == n).select("u", F.lit(n).alias("n"), F.explode(shingles(F.col("w"), n)).alias("s")) for n in range(1, N + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.distinct()
    return out.join(out.groupBy("u").agg(F.count("*").alias("size")).hint("merge"), "u")


def minima(items: DataFrame) -> DataFrame:
    """(u, n, s): what represents each item in the search."""
    small = items.where(F.col("size") <= WHOLE).select("u", "n", "s")
    functions = F.lit(12) + 2 * (F.floor(F.log2("size")).cast("int") - 4)
    large = items.where(F.col("size") > WHOLE).withColumn("f", F.explode(F.sequence(F.lit(1), functions)))
    large = large.groupBy("u", "n", "f").agg(F.min_by("s", F.xxhash64("s", "f")).alias("s")).select("u", "n", "s").distinct()
    return small.unionByName(large)


def sized(df: DataFrame) -> DataFrame:
    """A stored table with the join strategy that its row count allows."""
    return df.hint("broadcast") if df.count() <= MAX_BROADCAST else df.hint("merge")


def document_shingles(df: DataFrame, lengths: list[int]) -> DataFrame:
    """(t, n, s) of documents (t, w); the words are computed once for all lengths."""
    if len(lengths) == 1:
        return df.select("t", F.lit(lengths[0]).alias("n"), F.explode(shingles(F.col("w"), lengths[0])).alias("s"))

    def tag(n: int) -> Column:
        return F.transform(shingles(F.col("w"), n), lambda s: F.struct(F.lit(n).alias("n"), s.alias("s")))

    tagged = [tag(n) for n in lengths]
    return df.select("t", F.explode(F.concat(*tagged)).alias("e")).select("t", "e.n", "e.s")


def held(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_text: str = "text") -> DataFrame:
    """(t, u, size, shared) of every text and item it holds, both by their texts' hashes."""
    items = written(item_shingles(benchmark, item_text), "items")
    lengths = [r.n for r in items.select("n").distinct().collect()] or [N]  # five values at most
    probe = sized(written(minima(items), "items-min"))
    docs = documents.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))
    found = written(document_shingles(docs.select("t", words(F.col("x")).alias("w")), lengths).join(probe, ["n", "s"]).select("t", "u").distinct(), "candidates")
    texts = sized(written(found.select("t").distinct(), "candidate-texts"))
    again = docs.join(texts, "t", "left_semi").select("t", words(F.col("x")).alias("w"))
    shared = document_shingles(again, lengths).join(sized(items), ["n", "s"]).groupBy("t", "u").agg(F.count_distinct("s").alias("shared"), F.max("size").alias("size"))
    return shared.join(sized(found), ["t", "u"], "left_semi").where(F.col("shared") >= F.lit(threshold) * F.col("size"))


def contained(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_shingles, n_shared, containment) of every document and item it holds."""
    names = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.xxhash64(F.col(item_text)).alias("u")).distinct()
    with scratch() as keep:
        hits = held(documents, benchmark, threshold, text, item_text).join(sized(names), "u").select("t", "item", "size", "shared")
        hits = sized(keep(written(hits, "held")))
    keys = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"))
    best = F.max(F.struct((F.col("shared") / F.col("size")).alias("containment"), "size", "shared"))
    out = keys.join(hits, "t").groupBy("k", "item").agg(best.alias("b"))
    return out.select(F.col("k").alias(key), F.col("item").alias(item), F.col("b.size").alias("n_shingles"), F.col("b.shared").alias("n_shared"), "b.containment")


def decontaminate(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item."""
    (name,) = fresh(documents, "bad_text")
    with scratch() as keep:
        bad = keep(written(held(documents, benchmark, threshold, text).select(F.col("t").alias(name)).distinct(), "contaminated"))
    return documents.join(sized(bad), (F.xxhash64(F.col(text)) == F.col(name)) & F.col(text).isNotNull(), "left_anti")
