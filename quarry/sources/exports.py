"""Sinks and sources: JSON, CSV, BibTeX, Markdown; documents from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators.tables import cut
from quarry.operators.tables import drop_empty_columns


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(doc_id, source_path, text) of all matching files below a folder; equal files get equal ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(C.content_id("content").alias("doc_id"), F.col("path").alias("source_path"), F.decode("content", "utf-8").alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, columns without any value left out."""
    drop_empty_columns(df).write.mode("overwrite").option("header", True).csv(path)


def bibtex(papers: DataFrame, most_authors: int = 5) -> DataFrame:
    """(doc_id, bibtex): key = last word of the first author, year and the row's place, from 0, in the order of doc_id.

    Rows of one doc_id stand in the order of their authors.  Missing fields are left out; braces and line breaks are taken
    from the abstract, of which nothing may be left.

    The place needs one global order: a user exports a selection, and places are counted per range of ids.
    """
    # stored, since ranges are drawn anew and merged anew in each run of a plan, and both uses must see the same ones
    rows = cut(papers.repartitionByRange(F.col("doc_id")).withColumn("__p", F.spark_partition_id()))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy("doc_id", "authors", "title", "year")))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__c"))  # one row per partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    rows = rows.join(F.broadcast(before), "__p").withColumn("__i", F.col("__n") + F.col("__before") - 1)
    field = lambda name, c, given=None: F.when(F.coalesce((c if given is None else given).cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), c.cast("string"), F.lit("},\n"))).otherwise("")
    has = lambda name: F.col(name) if name in papers.columns else F.lit(None).cast("string")
    first = F.coalesce(C.last_name(F.get("authors", 0)), F.lit("Unknown"))
    key = F.concat(first, F.coalesce(F.col("year").cast("string"), F.lit("XXXX")), F.lit("_"), F.col("__i").cast("string"))
    fields = [field("title", F.col("title")), field("author", F.array_join(F.slice("authors", 1, most_authors), " and ")), field("year", F.col("year")), field("journal", has("journal")), field("doi", has("doi"))]
    abstract = F.replace(F.translate(has("abstract"), "{}", ""), F.lit("\n"), F.lit(" "))
    entry = F.concat(F.lit("@article{"), key, F.lit(",\n"), *fields, field("abstract", abstract, has("abstract")), F.lit("}\n"))
    return rows.select("doc_id", entry.alias("bibtex"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
