"""Bounded samples of labelled documents, from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import held_out


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], chars: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, text, y) of at most ``per_class[y]`` labelled documents of each class, none of them held out.

    The bounds are the caller's documented parameters; documents come in the order of a hash of their key, so
    the sample is the same in every run.  ``chars`` also bounds the characters of a class: the sample ends before the
    document that would pass it.  Rows with a null label or text are passed over; of several labels of one key the
    largest counts, of several texts the one of the smallest hash.
    """
    y = F.col(label).cast("int")
    marked = labels.where(y.isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.max(y).alias("y"))
    order = (F.xxhash64("k"), F.col("k"))
    chosen = None
    for value, n in per_class.items():
        part = marked.where(F.col("y") == value).orderBy(*order).limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    sizes = texts.select("k", F.struct("h", F.length("text").alias("n")).alias("s")).join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("s").alias("s"))
    total = F.sum("s.n").over(Window.partitionBy("y").orderBy(*order))  # over the chosen keys alone
    one = sizes.select("k", "y", F.col("s.h").alias("h"), total.alias("total"))
    one = (one if chars is None else one.where(F.col("total") <= chars)).drop("total")
    return texts.join(F.broadcast(one), ["k", "h"]).dropDuplicates(["k"]).select("k", "text", "y")


def predictions(df: DataFrame, score: Column, threshold: float, key: str = "doc_id") -> DataFrame:
    return df.select(key, held_out(key).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
