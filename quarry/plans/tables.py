"""Queries over ids, filters, upserts, logs and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import logs, tables as T
from quarry.plans.registry import query
from quarry.plans.views import Corpus, oracle

AS_OF = "2024-01-20 00:00:00"


def q(name, sql=None):
    """Registers a function of a Corpus."""
    return lambda f: query(name, oracle(sql) if sql else None)(lambda spark, sf_dir, f=f: f(Corpus(spark, sf_dir))) and f


@q("content_ids", "SELECT doc_id, substr(md5(text), 1, 12) AS content_id FROM documents")
def _(c):
    return c.documents.select("doc_id", C.content_id("text").alias("content_id"))


@q("duplicate_contents", "SELECT substr(md5(text), 1, 12) AS content_id, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(c):
    return c.documents.groupBy(C.content_id("text").alias("content_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@q("point_ids", "SELECT chunk_id, ('0x' || substr(md5(cast(chunk_id as varchar)), 1, 15))::BIGINT AS point_id FROM vectors")
def _(c):
    return c.vectors.select("chunk_id", C.point_id(F.col("chunk_id").cast("string")).alias("point_id"))


@q("author_ids", "SELECT author_id, replace(replace(lower(name), ' ', '_'), '.', '') AS author_key FROM authors")
def _(c):
    return c.authors.select("author_id", C.author_id("name").alias("author_key"))


@q("location_ids", "SELECT location_id, replace(lower(concat_ws('_', name, coalesce(region, 'unknown'))), ' ', '_') AS location_key FROM locations")
def _(c):
    return c.locations.select("location_id", C.location_id("name", "region").alias("location_key"))


@q("measurement_ids", "SELECT doc_id, species_id, parameter, substr(md5(concat_ws('_', cast(doc_id as varchar), parameter, cast(cast(value * 100 as bigint) as varchar), cast(species_id as varchar))), 1, 12) AS measurement_id FROM measurements")
def _(c):
    cents = (F.col("value") * 100 + F.lit(0.0)).cast("double")
    return c.measurements.select("doc_id", "species_id", "parameter", C.measurement_id(F.col("doc_id"), F.col("parameter"), F.bround(cents, 0).cast("bigint"), F.col("species_id")).alias("measurement_id"))


@q("filter_papers", "SELECT doc_id, title, year FROM papers WHERE year >= 1994 AND year <= 1996 AND study_type IN ('F', 'O')")
def _(c):
    return T.apply_filters(c.papers, T.SearchFilters(1994, 1996, study_types=["F", "O"])).select("doc_id", "title", "year")


@q("filter_by_author", "SELECT p.doc_id FROM papers p JOIN authors a ON p.author_id = a.author_id WHERE lower(a.name) LIKE '%customer#00000001%' OR lower(a.name) LIKE '%00000007%'")
def _(c):
    with_names = c.papers.join(c.authors, "author_id").withColumn("authors", F.array("name"))
    return T.apply_filters(with_names, T.SearchFilters(year_min=0, authors=["Customer#00000001", "00000007"])).select("doc_id")


@q("doc_ids_of_filter", "SELECT v.chunk_id FROM vectors v WHERE v.doc_id IN (SELECT doc_id FROM papers WHERE study_type = 'F')")
def _(c):
    return c.vectors.join(T.apply_filters(c.papers, T.SearchFilters(study_types=["F"])).select("doc_id"), "doc_id", "left_semi").select("chunk_id")


@q("snippets", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE coalesce(text, '') END AS snippet FROM documents")
def _(c):
    return c.documents.select("doc_id", C.snippet("text").alias("snippet"))


@q("like_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'license') OR contains(lower(source), 'idiot') OR contains(lower(source), 'license') ORDER BY doc_id LIMIT 50")
def _(c):
    return T.contains_any(c.documents, ["text", "source"], ["idiot", "License"]).select("doc_id", "lang").orderBy("doc_id").limit(50)


#: Vectors with what their table holds of a chunk besides: the title and the species of its paper.
PAYLOAD = "pay AS (SELECT v.chunk_id, v.doc_id, v.domain, p.title, m.species FROM vectors v LEFT JOIN papers p ON p.doc_id = v.doc_id LEFT JOIN (SELECT doc_id, list_sort(list(DISTINCT species_id)) AS species FROM mentions GROUP BY 1) m ON m.doc_id = v.doc_id)"


def payloads(c):
    sp = c.mentions.groupBy("doc_id").agg(F.sort_array(F.collect_set("species_id")).alias("species"))
    return c.vectors.join(c.papers.select("doc_id", "title").hint("merge"), "doc_id", "left").join(sp.hint("merge"), "doc_id", "left")


@q("vector_payloads", f"WITH {PAYLOAD} SELECT chunk_id, doc_id, domain, title, coalesce(array_to_string(species, ','), '') AS species FROM pay")
def _(c):
    old = payloads(c).where("chunk_id % 2 = 0").withColumn("title", F.lit("old"))
    new = T.upsert_latest(old, payloads(c), ["chunk_id"])
    return new.select("chunk_id", "doc_id", "domain", "title", F.coalesce(F.array_join(F.transform("species", lambda x: x.cast("string")), ","), F.lit("")).alias("species"))


@q("vector_payload_filter", f"WITH {PAYLOAD} SELECT chunk_id FROM pay WHERE domain IN (1, 2, 3) AND doc_id <> 7 AND list_has_any(species, (SELECT list(species_id) FROM species WHERE species_id % 3 = 0))")
def _(c):
    wanted = c.species.where("species_id % 3 = 0").select("species_id")
    hit = c.mentions.join(wanted.hint("merge"), "species_id", "left_semi").select("doc_id").distinct()
    return c.vectors.where(F.col("domain").isin(1, 2, 3) & (F.col("doc_id") != 7)).join(hit.hint("merge"), "doc_id", "left_semi").select("chunk_id")


@q("vector_species_filter", f"WITH {PAYLOAD} SELECT chunk_id FROM pay WHERE list_has_any(species, [7, 11, 13])")
def _(c):
    return payloads(c).where(F.arrays_overlap("species", F.array(*[F.lit(x).cast("long") for x in (7, 11, 13)]))).select("chunk_id")


@q("paper_record", "SELECT doc_id, title, lower(study_type) || ',x' AS keywords, name AS authors, 0.5::DOUBLE AS share, NULL AS doi FROM papers p JOIN authors a ON a.author_id = p.author_id WHERE doc_id = 7")
def _(c):
    p = c.papers.join(c.authors, "author_id")
    stored = p.select("doc_id", "title", F.to_json(F.array("name")).alias("authors"), F.to_json(F.array(F.lower("study_type"), F.lit("x"))).alias("keywords"), F.to_json(F.create_map("study_type", F.lit(0.5))).alias("domains"), F.col("study_type"))
    r = T.paper_record(stored, 7)
    return r.select("doc_id", "title", F.array_join("keywords", ",").alias("keywords"), F.array_join("authors", ",").alias("authors"), F.element_at("domains", F.col("study_type")).alias("share"), "doi")


@q("chunks_of_document", "SELECT doc_id, chunk_idx, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS chunk_idx FROM documents) t WHERE doc_id = 3")
def _(c):
    return T.chunks_of_document(c.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_idx", "text")), 3).select("doc_id", "chunk_idx", "text")


@q("bad_metadata", "SELECT doc_id, (title IS NULL OR title = 'Untitled' OR starts_with(title, '<!--') OR length(title) < 5) AS bad_title, (text IS NULL OR length(text) < 30 OR starts_with(text, 'abstract') OR contains(text, 'abstractCls')) AS bad_abstract FROM (SELECT doc_id, split_part(text, ' ', 1) AS title, CASE doc_id % 4 WHEN 0 THEN 'abstract' || text WHEN 1 THEN text || ' abstractCls' ELSE text END AS text FROM documents) t")
def _(c):
    i = F.col("doc_id") % 4
    d = c.documents.withColumn("title", F.split("text", " ")[0]).withColumn("text", F.when(i == 0, F.concat(F.lit("abstract"), "text")).when(i == 1, F.concat("text", F.lit(" abstractCls"))).otherwise(F.col("text")))
    return d.select("doc_id", C.bad_title("title").alias("bad_title"), C.bad_abstract("text").alias("bad_abstract"))


@q("name_and_count_filter", "SELECT s.common_name, count(DISTINCT m.doc_id) AS paper_count FROM species s JOIN mentions m ON s.species_id = m.species_id WHERE contains(lower(s.common_name), 'red') GROUP BY 1 HAVING count(DISTINCT m.doc_id) >= 2")
def _(c):
    s = c.species.where(F.lower("common_name").contains("red")).join(c.mentions, "species_id")
    return s.groupBy("common_name").agg(F.count_distinct("doc_id").alias("paper_count")).where("paper_count >= 2")


@q("title_substring_groups", "SELECT source, count(*) AS chunks, min(doc_id) AS first_doc FROM documents WHERE contains(lower(text), 'license') GROUP BY source")
def _(c):
    return c.documents.where(F.lower("text").contains("license")).groupBy("source").agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first_doc"))


@q("flag_nodes", "SELECT species_id, contains(lower(common_name), 'blue') AS hit FROM species")
def _(c):
    return c.species.select("species_id", F.lower("common_name").contains("blue").alias("hit"))


@q("occurrence_filter", "SELECT species_id, country, year FROM occurrences WHERE year BETWEEN 1996 AND 1997 AND longitude IS NOT NULL AND NOT issue AND country = 'NATION_3'")
def _(c):
    return c.occurrences.where(F.col("year").between(1996, 1997) & F.col("longitude").isNotNull() & ~F.col("issue") & (F.col("country") == "NATION_3")).select("species_id", "country", "year")


# -- upserts, deletes, differences ------------------------------------------------------------------------

OLD = "SELECT o_custkey AS id, max(o_orderkey) AS v, max(o_totalprice) AS price FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey"
NEW = "SELECT o_custkey AS id, o_orderkey AS v, o_totalprice AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"


def _old_new(c):
    o = c.orders
    old = o.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("v"), F.max("o_totalprice").alias("price"))
    new = o.where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("price"))
    return old, new


@q("upsert_papers", f"WITH old AS ({OLD}), new AS ({NEW}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS n FROM new) t WHERE n = 1) SELECT id, v, price FROM last UNION ALL SELECT id, v, price FROM old WHERE id NOT IN (SELECT id FROM last)")
def _(c):
    old, new = _old_new(c)
    return T.upsert_latest(old, new, ["id"], [F.col("v")])


@q("upsert_by_buckets", f"WITH old AS ({OLD}), new AS ({NEW}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS n FROM new) t WHERE n = 1) SELECT id, v, price FROM last UNION ALL SELECT id, v, price FROM old WHERE id NOT IN (SELECT id FROM last)")
def _(c):
    old, new = _old_new(c)
    path = T.shared_path(c.spark)
    T.upsert_buckets(old, ["id"], path, 16)
    T.upsert_buckets(new, ["id"], path, 16, [F.col("v")])
    return c.spark.read.parquet(path).select("id", "v", "price")


@q("upsert_species", f"WITH old AS ({OLD}), last AS (SELECT id, v, CASE WHEN v % 2 = 0 THEN price END AS price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS n FROM ({NEW}) x) t WHERE n = 1) SELECT coalesce(o.id, n.id) AS id, coalesce(n.v, o.v) AS v, coalesce(n.price, o.price) AS price FROM old o FULL JOIN last n ON o.id = n.id")
def _(c):
    old, new = _old_new(c)
    new = T.latest(new, ["id"], [F.col("v")]).withColumn("price", F.when(F.col("v") % 2 == 0, F.col("price")))
    return T.upsert_keeping(old, new, ["id"])


@q("delete_papers", "SELECT doc_id FROM papers WHERE doc_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(c):
    return T.delete_keys(c.papers, c.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id")), ["doc_id"]).select("doc_id")


@q("backfill_candidates", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.doc_id = d.doc_id)")
def _(c):
    return T.missing_from(c.documents.select("doc_id"), c.vectors, ["doc_id"])


@q("fallback_store", "SELECT doc_id, 'vector' AS store FROM vectors UNION ALL SELECT doc_id, 'text' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM vectors)")
def _(c):
    return T.coalesce_sources(c.vectors.select("doc_id", F.lit("vector").alias("store")), c.documents.select("doc_id", F.lit("text").alias("store")), ["doc_id"])


@q("change_log", f"WITH old AS ({OLD}), new AS (SELECT id, max(v) AS v, max(price) AS price FROM ({NEW}) x GROUP BY id) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'add' WHEN n.id IS NULL THEN 'delete' ELSE 'modify' END AS action FROM old o FULL JOIN new n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.v <> n.v OR o.price <> n.price")
def _(c):
    old, new = _old_new(c)
    return T.change_log(old, new.groupBy("id").agg(F.max("v").alias("v"), F.max("price").alias("price")), "id")


@q("purge_log", f"SELECT query_id FROM query_log WHERE ts >= TIMESTAMP '{AS_OF}'")
def _(c):
    return T.purge_before(c.query_log, "ts", F.lit(AS_OF).cast("timestamp_ntz")).select("query_id")


@q("clear_table", "SELECT doc_id, title FROM papers WHERE 1 = 0")
def _(c):
    return T.emptied(c.papers.select("doc_id", "title"))


@q("repair_titles", "WITH broken AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Unknown' WHEN doc_id % 7 = 0 THEN NULL ELSE title END AS title, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE year END AS year FROM papers) SELECT b.doc_id, CASE WHEN (b.title IS NULL OR b.title = 'Unknown') AND p.title IS NOT NULL THEN p.title ELSE b.title END AS title, CASE WHEN (b.title IS NULL OR b.title = 'Unknown') AND p.title IS NOT NULL THEN coalesce(p.year, b.year) ELSE b.year END AS year FROM broken b LEFT JOIN papers p ON b.doc_id = p.doc_id AND p.study_type <> 'P'")
def _(c):
    i = F.col("doc_id")
    broken = c.papers.select("doc_id", F.when(i % 5 == 0, "Unknown").when(i % 7 == 0, None).otherwise(F.col("title")).alias("title"), F.when(i % 5 == 0, None).otherwise(F.col("year")).alias("year"))
    return T.repaired_titles(broken, c.papers.where("study_type <> 'P'"))


@q("title_quality", "SELECT count(*) FILTER (WHERE doc_id % 5 <> 0) AS good, count(*) FILTER (WHERE doc_id % 5 = 0) AS bad FROM papers")
def _(c):
    return T.quality_of_titles(c.papers.withColumn("title", F.when(F.col("doc_id") % 5 == 0, "Unknown").otherwise(F.col("title"))))


@q("first_chunks_per_paper", "SELECT doc_id, species_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, species_id) AS n FROM mentions) t WHERE n <= 3")
def _(c):
    return T.first_n(c.mentions, ["doc_id"], [F.desc("confidence"), F.asc("species_id")], 3).select("doc_id", "species_id")


@q("fallback_search", "SELECT doc_id, 'like' AS tier FROM documents WHERE contains(lower(text), 'license')")
def _(c):
    none = c.documents.where(F.col("lang") == "xx").select("doc_id", F.lit("ranked").alias("tier"))
    return T.first_tier(none, T.contains_any(c.documents, ["text"], ["license"]).select("doc_id", F.lit("like").alias("tier")))


@q("papers_page", "SELECT doc_id, title, year FROM papers ORDER BY year DESC NULLS LAST, title, doc_id LIMIT 200 OFFSET 100")
def _(c):
    return T.paged(c.papers.select("doc_id", "title", "year"), [F.col("year").desc_nulls_last(), F.col("title"), F.col("doc_id")], 200, 100)


@q("checked_ledger", "SELECT status, count(*) AS n FROM ledger WHERE status IN ('success', 'failed') GROUP BY status")
def _(c):
    return T.checked(c.ledger, "status", ("success", "failed"))[0].groupBy("status").agg(F.count("*").alias("n"))


@q("export_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(c):
    return T.drop_empty_columns(c.orders.select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("nothing")))


# -- logs and ledger --------------------------------------------------------------------------------------

CUR = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, store ORDER BY ts DESC, event_id DESC) AS n FROM ledger) t WHERE n = 1"


@q("popular_queries", f"SELECT query, count(*) AS n FROM query_log WHERE query <> '' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY query ORDER BY n DESC, query LIMIT 10")
def _(c):
    return logs.popular_queries(c.query_log, F.lit(AS_OF).cast("timestamp_ntz"), 7)


@q("log_stats", f"SELECT count(*) AS total, count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}') AS today, round(coalesce(avg(execution_time_ms), 0), 6) AS mean_ms, (SELECT count(*) FROM ledger) AS updates, (SELECT count(*) FROM ledger WHERE status = 'success') AS adds FROM query_log")
def _(c):
    updates = c.ledger.select(F.when(F.col("status") == "success", "add").otherwise("modify").alias("action"))
    return logs.log_stats(c.query_log, F.lit(AS_OF).cast("timestamp_ntz"), updates)


@q("recent_queries", "SELECT query_id, query FROM query_log ORDER BY ts DESC, query_id DESC LIMIT 20")
def _(c):
    return logs.recent(c.query_log, "ts", "query_id", 20).select("query_id", "query")


@q("current_ledger", f"SELECT doc_id, store, status, event_id FROM ({CUR}) c")
def _(c):
    return logs.current_ledger(c.ledger, ["ts", "event_id"]).select("doc_id", "store", "status", "event_id")


@q("partial_ingestions", f"SELECT doc_id, count(*) FILTER (WHERE status = 'success') AS successes, max(ts) AS last_ts, string_agg(concat_ws('=', store, status), ',' ORDER BY concat_ws('=', store, status)) AS statuses FROM ({CUR}) c GROUP BY doc_id HAVING count(*) FILTER (WHERE status = 'success') < 3")
def _(c):
    return logs.partial_ingestions(logs.current_ledger(c.ledger, ["ts", "event_id"]))


@q("status_of_documents", f"SELECT doc_id, max(CASE WHEN store = 'click' THEN status END) AS click, count(*) AS stores FROM ({CUR}) c GROUP BY doc_id")
def _(c):
    m = logs.status_map(logs.current_ledger(c.ledger, ["ts", "event_id"]))
    return m.select("doc_id", F.try_element_at("stores", F.lit("click"))["status"].alias("click"), F.size("stores").cast("bigint").alias("stores"))


@q("ledger_matrix", f"SELECT store, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'success') AS success FROM ({CUR}) c GROUP BY store")
def _(c):
    return logs.ledger_matrix(logs.current_ledger(c.ledger, ["ts", "event_id"]))


@q("ledger_totals", f"SELECT count(*) AS documents, count(*) FILTER (WHERE s >= 3) AS complete, count(*) FILTER (WHERE s BETWEEN 1 AND 2) AS partial FROM (SELECT doc_id, count(*) FILTER (WHERE status = 'success') AS s FROM ({CUR}) c GROUP BY doc_id) t")
def _(c):
    return logs.ledger_totals(logs.current_ledger(c.ledger, ["ts", "event_id"]))


@q("success_rate", f"SELECT store, round(avg(CASE WHEN status = 'success' THEN 1 ELSE 0 END) * 100, 6) AS success_percent FROM ({CUR}) c GROUP BY store")
def _(c):
    return logs.success_rate(logs.current_ledger(c.ledger, ["ts", "event_id"]))


@q("failed_ingestions", f"SELECT doc_id, store, event_id FROM ({CUR}) c WHERE status = 'failed' AND store = 'view'")
def _(c):
    return logs.failures(logs.current_ledger(c.ledger, ["ts", "event_id"]), "view").select("doc_id", "store", "event_id")


@q("failure_runs", "WITH r AS (SELECT doc_id, status, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM ledger) SELECT doc_id, CAST(run AS BIGINT) AS run, count(*) AS length FROM r WHERE status = 'failed' GROUP BY 1, 2 HAVING count(*) >= 3")
def _(c):
    return logs.failure_runs(c.ledger, "doc_id", ["ts", "event_id"])


# -- sizes and flags --------------------------------------------------------------------------------------


@q("row_counts", "SELECT 'papers' AS name, count(*) AS n FROM papers UNION ALL SELECT 'species', count(*) FROM species UNION ALL SELECT 'locations', count(*) FROM locations UNION ALL SELECT 'measurements', count(*) FROM measurements UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'mentions', count(*) FROM mentions UNION ALL SELECT 'references_location', count(*) FROM references_location UNION ALL SELECT 'authored_by', count(*) FROM authored_by UNION ALL SELECT 'citations', count(*) FROM citations UNION ALL SELECT 'authors', count(*) FROM authors")
def _(c):
    parts = [getattr(c, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("papers", "species", "locations", "measurements", "relations", "mentions", "references_location", "authored_by", "citations", "authors")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@q("domain_distribution", "SELECT study_type AS domain, count(*) AS n FROM papers WHERE study_type IS NOT NULL GROUP BY 1")
def _(c):
    return c.papers.where("study_type is not null").groupBy(F.col("study_type").alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain")


@q("year_range", "SELECT coalesce(min(year), 0) AS first_year, coalesce(max(year), 0) AS last_year FROM papers")
def _(c):
    return c.papers.agg(F.coalesce(F.min("year"), F.lit(0)).alias("first_year"), F.coalesce(F.max("year"), F.lit(0)).alias("last_year"))


@q("study_type_groups", "SELECT coalesce(study_type, 'unknown') AS study_type, count(*) AS n FROM (SELECT CASE WHEN study_type = 'P' THEN NULL ELSE study_type END AS study_type FROM papers) p GROUP BY 1")
def _(c):
    p = c.papers.withColumn("study_type", F.when(F.col("study_type") != "P", F.col("study_type")))
    return p.groupBy(F.coalesce("study_type", F.lit("unknown")).alias("study_type")).agg(F.count("*").alias("n"))


@q("token_estimates", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 4 + greatest(10, CAST(floor((length(text) // 4) * 0.1::DOUBLE) AS BIGINT)) END AS tokens, length(text) // 4 + greatest(10, CAST(floor((length(text) // 4) * 0.1::DOUBLE) AS BIGINT)) + 500 <= 2048 AS fits FROM documents")
def _(c):
    return c.documents.select("doc_id", C.estimated_tokens("text").alias("tokens"), C.fits_in_context("text").alias("fits"))


@q("word_counts", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words, length(text) AS chars FROM documents")
def _(c):
    return c.documents.select("doc_id", C.word_count("text").alias("words"), F.length("text").cast("bigint").alias("chars"))


@q("reference_flags", r"SELECT doc_id, regexp_matches(lower(t), 'table\s*\d+') AS has_table, regexp_matches(lower(t), 'fig(ure)?\s*\.?\s*\d+') AS has_figure FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' see Table 3' WHEN 1 THEN ' in FIG. 2' WHEN 2 THEN ' the table' WHEN 3 THEN ' figure12' ELSE '' END AS t FROM documents) x")
def _(c):
    n = F.col("doc_id") % 5
    t = F.concat("text", F.when(n == 0, " see Table 3").when(n == 1, " in FIG. 2").when(n == 2, " the table").when(n == 3, " figure12").otherwise(""))
    return c.documents.select("doc_id", C.mentions_table(t).alias("has_table"), C.mentions_figure(t).alias("has_figure"))


@q("chunk_ids", "SELECT doc_id, substr(md5(concat_ws(':', cast(doc_id as varchar), '0', substr(text, 1, 50))), 1, 16) AS chunk_id FROM documents")
def _(c):
    return c.documents.select("doc_id", C.chunk_id("doc_id", F.lit(0), "text").alias("chunk_id"))


@q("labels_and_ranks", "SELECT species_id, CASE WHEN length(common_name) > 8 THEN substr(common_name, 1, 8) || '…' ELSE common_name END AS short, concat_ws(' > ', genus, family, common_name) AS hierarchy, regexp_extract(trim(common_name), '(\\S+)$', 1) AS last_name FROM species")
def _(c):
    return c.species.select("species_id", C.truncated("common_name", 8).alias("short"), C.hierarchy(F.col("genus"), F.col("family"), F.col("common_name")).alias("hierarchy"), C.last_name("common_name").alias("last_name"))
