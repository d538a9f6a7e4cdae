"""The driver's tables seen as a literature corpus: the same SELECTs for Spark and for the oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "papers": "SELECT o_orderkey AS doc_id, concat('order ', cast(o_orderkey as varchar(20)), ' ', lower(o_orderpriority)) AS title, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus AS study_type, o_custkey AS author_id FROM orders",
    "species": "SELECT p_partkey AS species_id, p_name AS common_name, p_brand AS family, p_type AS genus FROM part",
    "mentions": "SELECT l_orderkey AS doc_id, l_partkey AS species_id, max(1 - l_discount) AS confidence FROM lineitem GROUP BY l_orderkey, l_partkey",
    "paper_domains": "SELECT l_orderkey AS doc_id, p_type AS domain, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_type",
    "locations": "SELECT n_nationkey AS location_id, n_name AS name, r_name AS region, CAST((n_nationkey * 37) % 181 - 90 AS DOUBLE) AS latitude, CAST((n_nationkey * 73) % 361 - 180 AS DOUBLE) AS longitude FROM nation JOIN region ON n_regionkey = r_regionkey",
    "references_location": "SELECT DISTINCT l_orderkey AS doc_id, s_nationkey AS location_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "measurements": "SELECT l_orderkey AS doc_id, l_partkey AS species_id, 'quantity' AS parameter, l_quantity AS value, 'ind' AS unit, l_returnflag AS life_stage FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'price', l_extendedprice, 'cu', l_returnflag FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'discount', l_discount, 'ratio', l_returnflag FROM lineitem",
    "relations": "SELECT DISTINCT a.l_partkey AS subject, b.l_partkey AS object, CASE a.l_returnflag WHEN 'A' THEN 'predation' WHEN 'N' THEN 'competition' ELSE 'symbiosis' END AS type FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey",
    "vectors": "SELECT vec_id AS chunk_id, CAST(floor(vec_id / 5) AS BIGINT) AS doc_id, label AS domain, embedding FROM embeddings",
    "ledger": "SELECT user_id AS doc_id, event_type AS store, CASE WHEN value < 5 THEN 'failed' WHEN value < 10 THEN 'pending' ELSE 'success' END AS status, ts AS ts, event_id FROM events",
    "query_log": "SELECT event_id AS query_id, event_type AS query, props AS filters, CAST(user_id AS INT) AS result_count, value AS execution_time_ms, ts AS ts FROM events",
    "citations": "SELECT citing, cited FROM (SELECT o_orderkey AS citing, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS cited FROM orders) q WHERE cited IS NOT NULL",
    "authored_by": "SELECT o_orderkey AS doc_id, o_custkey AS author_id FROM orders UNION SELECT l_orderkey, 100000 + l_suppkey FROM lineitem",
    "authors": "SELECT c_custkey AS author_id, c_name AS name FROM customer UNION ALL SELECT 100000 + s_suppkey, s_name FROM supplier",
    "occurrences": "SELECT l_partkey AS species_id, n_name AS country, CAST((n_nationkey * 37) % 181 - 90 AS DOUBLE) AS latitude, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST((n_nationkey * 73) % 361 - 180 AS DOUBLE) END AS longitude, CAST(year(l_shipdate) AS INT) AS year, l_returnflag = 'R' AS issue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
}


def from_tables(sql: str, sf_dir: str) -> str:
    """The statement with every driver table read from its Parquet files."""
    names = "|".join(TABLES)
    return re.sub(rf"\b(FROM|JOIN) ({names})\b(?! *\.)", lambda m: f"{m[1]} parquet.`{sf_dir.rstrip('/')}/{m[2]}.parquet` {m[2]}" if not re.match(r"\s+(?:AS\s+)?[a-z]\b(?!\w)", sql[m.end() : m.end() + 4]) else f"{m[1]} parquet.`{sf_dir.rstrip('/')}/{m[2]}.parquet`", sql)


class Corpus:
    """Attribute access to driver tables and views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        if name in VIEWS:
            return self.spark.sql(from_tables(VIEWS[name], self.sf_dir))
        raise AttributeError(name)


def oracle(sql: str) -> str:
    """The statement with the views it names as leading CTEs."""
    used = [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN|,)\s+{v}\b", sql)]
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH " and body[5:14].upper() != "RECURSIVE":
        return f"WITH {ctes}, {body[5:]}"
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes} {body}"
