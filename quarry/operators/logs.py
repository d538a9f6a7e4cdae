"""Query log, update log and ingestion ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.tables import latest

STORES = 3


def popular_queries(log: DataFrame, as_of: Column | None = None, days: int | None = None, limit: int = 10) -> DataFrame:
    """Non-empty queries by count; of the last days only, if both as_of and days are given."""
    if as_of is not None and days:
        log = log.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    return log.where(F.coalesce(F.col("query"), F.lit("")) != "").groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(limit)


def log_stats(log: DataFrame, as_of: Column, updates: DataFrame | None = None) -> DataFrame:
    """One row: queries in all, today's, mean latency (0 if none); with an update log (action) all updates and adds."""
    out = log.agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= F.date_trunc("day", as_of)).alias("today"), F.round(F.coalesce(F.avg("execution_time_ms"), F.lit(0.0)), 6).alias("mean_ms"))
    if updates is None:
        return out
    return out.join(F.broadcast(updates.agg(F.count("*").alias("updates"), F.count_if(F.col("action") == "add").alias("adds"))))  # one row each


def search_log(asked: DataFrame, results: DataFrame, filters: dict[str, str], ts: Column) -> DataFrame:
    """(query, filters, result_count, ts): a log row for every query of (query_id, query), 0 where it found nothing."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    kept = F.lit(None).cast("map<string,string>") if not filters else F.create_map(*[F.lit(x) for kv in filters.items() for x in kv])
    return asked.join(n.hint("merge"), "query_id", "left").select("query", F.to_json(kept).alias("filters"), F.coalesce("n", F.lit(0)).cast("int").alias("result_count"), ts.alias("ts"))


def append_log(log: DataFrame, rows: DataFrame, key: str = "query_id") -> DataFrame:
    """The log with further rows, numbered on from its largest key: rows are placed by range partition, then inside it."""
    top = log.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))  # one row
    dealt = rows.repartitionByRange(F.col("ts"), F.col("query")).withColumn("__p", F.spark_partition_id())
    dealt = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy("ts", "query")))
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__c"))  # one row per partition
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"))
    new = dealt.join(F.broadcast(before), "__p").join(F.broadcast(top)).withColumn(key, (F.col("__top") + F.col("__before") + F.col("__n")).cast(log.schema[key].dataType))
    return log.unionByName(new.drop("__p", "__n", "__before", "__top"), allowMissingColumns=True)


def recent(df: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(key)).limit(limit)


def current_ledger(events: DataFrame, order: list[str]) -> DataFrame:
    """The last status of every (doc_id, store)."""
    return latest(events, ["doc_id", "store"], [F.col(c) for c in order])


def partial_ingestions(ledger: DataFrame, stores: int = STORES) -> DataFrame:
    """Documents with fewer successes than stores, newest first, with their statuses."""
    g = ledger.groupBy("doc_id").agg(F.count_if(F.col("status") == "success").alias("successes"), F.max("ts").alias("last_ts"), F.sort_array(F.collect_list(F.concat_ws("=", "store", "status"))).alias("statuses"))
    return g.where(F.col("successes") < stores).withColumn("statuses", F.array_join("statuses", ",")).orderBy(F.desc("last_ts"), "doc_id")


def status_map(ledger: DataFrame) -> DataFrame:
    """doc_id -> map of store to struct(status, ts); a document has few stores."""
    return ledger.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("store", F.struct("status", "ts")))).alias("stores"))


def ledger_matrix(ledger: DataFrame, statuses: tuple[str, ...] = ("failed", "pending", "success")) -> DataFrame:
    """Store x status counts, absent ones 0."""
    return ledger.groupBy("store").pivot("status", list(statuses)).count().na.fill(0)


def ledger_totals(ledger: DataFrame, stores: int = STORES) -> DataFrame:
    """One row: documents in all, in every store, in some."""
    g = ledger.groupBy("doc_id").agg(F.count_if(F.col("status") == "success").alias("s"))
    return g.agg(F.count("*").alias("documents"), F.count_if(F.col("s") >= stores).alias("complete"), F.count_if(F.col("s").between(1, stores - 1)).alias("partial"))


def success_rate(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("store").agg(F.round(F.avg((F.col("status") == "success").cast("int")) * 100, 6).alias("success_percent"))


def failures(ledger: DataFrame, store: str | None = None) -> DataFrame:
    df = ledger.where(F.col("status") == "failed")
    return (df.where(F.col("store") == store) if store else df).orderBy(F.desc("ts"), "doc_id", "store")


def failure_runs(events: DataFrame, key: str, order: list[str], least: int = 3) -> DataFrame:
    """Stretches of at least ``least`` successive failures of a key: (key, run, length)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("run", F.sum((F.col("status") != "failed").cast("long")).over(w)).where(F.col("status") == "failed")
    return runs.groupBy(key, "run").agg(F.count("*").alias("length")).where(F.col("length") >= least)
