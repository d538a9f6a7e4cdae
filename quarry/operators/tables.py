"""Table maintenance: upserts, deletes, change logs, filters, first-n per key, fallbacks.

A Spark table is not updated in place here: each operator returns the new content, to be written as a new
version of the table.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Where the plain copies of ``cut`` lie.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
INFER = "spark.sql.constraintPropagation.enabled"


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = sc.getConf().get("spark.checkpoint.dir", None)
        if base is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="quarry-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def cut(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` stored in the shared folder of spark.checkpoint.dir: written and read again, or with ``keys`` dealt by them.

    A table dealt by the key of later joins is checkpointed and not shuffled again by them; it carries what Spark
    inferred of its columns along, so where columns change places from round to round a plain copy is made.  Where no folder is set a temporary one
    takes its place on a single machine; on a cluster that is an error.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    if not keys:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        _PLACES[out] = path
        return out
    df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    # a checkpoint keeps what was inferred of its columns, which would double with every round of an iteration
    before = spark.conf.get(INFER)
    spark.conf.set(INFER, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(INFER, before)


def place_of(df: DataFrame) -> str:
    """Where a plain copy of ``cut`` lies."""
    return _PLACES[df]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all tasks, for work on long rows whose files have few row groups."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def released(*tables: DataFrame) -> None:
    """Deletes the plain copies that ``cut`` made, once nothing reads them any more; other tables stay."""
    for df in tables:
        path = _PLACES.pop(df, None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key in the given order; the order must be total within a key."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Insert or replace by key: incoming rows win over existing ones, the last of several incoming wins."""
    incoming = latest(incoming, keys, order) if order else incoming
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert_buckets(incoming: DataFrame, keys: list[str], path: str, buckets: int = 64, order: list[Column] | None = None) -> list[int]:
    """Upserts into the Parquet table at ``path``, dealt into hash buckets of the keys; the buckets that were written.

    Only buckets that an incoming key falls into are read and written, so a batch costs what it meets; files of other
    buckets stay as they are.  Of several incoming rows of a key the last in ``order`` counts, without it any.  A bucket
    too large for a task is written by several.  Repeating a batch, also one that failed half way, changes nothing more.
    The number of buckets is the table's for good: another one is an error.  Readers drop the column __bucket.
    """
    spark = incoming.sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_buckets")
    store = mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    known = [x.getPath().getName() for x in store.listStatus(mark)] if store.exists(mark) else []
    if known and known != [str(buckets)]:
        raise ValueError(f"the table at {path} has {known[0]} buckets")
    new = latest(incoming, keys, order) if order else incoming.dropDuplicates(keys)
    new = cut(new.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    met = [r["__bucket"] for r in new.select("__bucket").distinct().collect()]  # at most one number a bucket
    if known:
        schema = spark.read.parquet(path).schema
        old = spark.read.schema(schema).parquet(path).where(F.col("__bucket").isin(met))
        new = old.join(new.select(*keys).hint("merge"), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    if met:
        new.hint("rebalance", "__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(path)
        store.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_buckets/{buckets}"))
    return sorted(met)


def upsert_keeping(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or update by key, where a null in the incoming row keeps the old value."""
    a, b = existing.alias("a"), incoming.alias("b")
    values = [c for c in existing.columns if c not in keys]
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    return joined.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in values])


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def missing_from(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other table does not have (what a backfill has to do)."""
    return df.join(other.select(*keys), keys, "left_anti")


def coalesce_sources(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the first store, and of the second those whose key the first lacks."""
    return primary.unionByName(missing_from(secondary, primary, keys))


def change_log(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, action): add, delete or modify, for every key that differs between two versions."""
    values = [c for c in new.columns if c != key]
    a = old.select(key, F.struct(*values).alias("v")).alias("a")
    b = new.select(key, F.struct(*values).alias("v")).alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    action = F.when(F.col(f"a.{key}").isNull(), "add").when(F.col(f"b.{key}").isNull(), "delete").when(~F.col("a.v").eqNullSafe(F.col("b.v")), "modify")
    return j.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), action.alias("action")).where("action is not null")


def purge_before(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    return df.where(F.col(ts) >= cutoff)


def emptied(df: DataFrame) -> DataFrame:
    """The cleared table: same schema, no rows."""
    return df.limit(0)


def repaired_titles(papers: DataFrame, other: DataFrame, key: str = "doc_id") -> DataFrame:
    """Title and year of the other table where the own title is null or "Unknown"."""
    o = other.select(key, F.col("title").alias("__t"), F.col("year").alias("__y"))
    bad = F.col("title").isNull() | (F.col("title") == "Unknown")
    usable = F.col("__t").isNotNull() & (F.col("__t") != "Unknown")
    j = papers.join(o, key, "left")
    return j.withColumns({"title": F.when(bad & usable, F.col("__t")).otherwise(F.col("title")), "year": F.when(bad & usable, F.coalesce(F.col("__y"), F.col("year"))).otherwise(F.col("year"))}).drop("__t", "__y")


def quality_of_titles(papers: DataFrame) -> DataFrame:
    """One row: how many titles are good and bad."""
    bad = F.col("title").isNull() | (F.col("title") == "Unknown")
    return papers.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))


@dataclass
class SearchFilters:
    """Bounds and lists; a bound of 0 or None and an empty list set no limit."""

    year_min: int | None = None
    year_max: int | None = None
    journals: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    study_types: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)


def apply_filters(df: DataFrame, f: SearchFilters) -> DataFrame:
    """All limits must hold; of several author fragments one suffices (case ignored)."""
    tests = []
    if f.year_min:
        tests.append(F.col("year") >= f.year_min)
    if f.year_max:
        tests.append(F.col("year") <= f.year_max)
    for column, wanted in (("journal", f.journals), ("primary_domain", f.domains), ("study_type", f.study_types)):
        if wanted:
            tests.append(F.col(column).isin(*wanted))
    if f.authors:
        tests.append(F.exists("authors", lambda a: reduce(lambda x, y: x | y, [F.lower(a).contains(n.lower()) for n in f.authors])))
    return reduce(lambda d, t: d.where(t), tests, df)


def contains_any(df: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """Rows in which any word occurs in any of the columns, case ignored."""
    tests = [F.lower(F.col(c)).contains(w.lower()) for c in columns for w in words]
    return df.where(reduce(lambda x, y: x | y, tests, F.lit(False)))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key; Spark cuts each task's part before it shuffles."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def first_tier(*tiers: DataFrame) -> DataFrame:
    """Rows of the first input that has any, in one plan."""
    tagged = [t.withColumn("__tier", F.lit(i)) for i, t in enumerate(tiers)]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    least = union.agg(F.min("__tier").alias("__least"))  # one row
    return union.join(F.broadcast(least), F.col("__tier") == F.col("__least")).drop("__tier", "__least")


def paged(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns without any value dropped; one aggregate decides."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if n[c]])


def checked(df: DataFrame, column: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows with an allowed value, rejects)."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.where(ok), df.where(~ok)


def sized(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with a join hint: broadcast if it is counted to be small, else merge."""
    return df.hint("broadcast" if df.count() <= most else "merge")


def paper_record(papers: DataFrame, doc_id, lists: tuple[str, ...] = ("authors", "keywords"), maps: tuple[str, ...] = ("domains",)) -> DataFrame:
    """The row of one paper with its JSON columns decoded, empty where null; doi is null where the table has no such column."""
    out = papers.where(F.col("doc_id") == doc_id)
    for c in lists:
        out = out.withColumn(c, F.from_json(F.coalesce(c, F.lit("[]")), "array<string>"))
    for c in maps:
        out = out.withColumn(c, F.from_json(F.coalesce(c, F.lit("{}")), "map<string,double>"))
    return out if "doi" in out.columns else out.withColumn("doi", F.lit(None).cast("string"))


def chunks_of_document(chunks: DataFrame, doc_id) -> DataFrame:
    """The chunks of one document in order."""
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_idx")
