"""Queries over graph analytics, cross-domain links and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import analytics as A, enrich as E, links as L
from quarry.operators.tables import cut
from quarry.plans.tables import q

# -- similarity and concept graphs ------------------------------------------------------------------------

@q("paper_similarity_classes", "WITH k AS (SELECT s, count(*) AS papers FROM (SELECT doc_id, list_sort(list(DISTINCT domain)) AS s FROM paper_domains GROUP BY 1) t GROUP BY 1), p AS (SELECT a.s AS sa, b.s AS sb, a.papers AS papers_a, b.papers AS papers_b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM k a, k b) SELECT array_to_string(sa, ',') AS class_a, array_to_string(sb, ',') AS class_b, papers_a, papers_b, round(j, 6) AS similarity FROM p WHERE array_to_string(sa, ',') <= array_to_string(sb, ',') AND round(j, 6) >= 0.55")
def _(c):
    return A.similarity_classes(c.paper_domains)


@q("lifted_pairs", "WITH s AS (SELECT doc_id, list(DISTINCT domain) AS s FROM paper_domains GROUP BY 1), k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM mentions a JOIN mentions b ON a.species_id = b.species_id AND a.doc_id < b.doc_id GROUP BY 1, 2), j AS (SELECT k.a, k.b, k, coalesce(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 0) AS j FROM k LEFT JOIN s x ON x.doc_id = k.a LEFT JOIN s y ON y.doc_id = k.b) SELECT a, b, round(j + 0.1::DOUBLE * k, 6) AS similarity FROM j WHERE j < 0.55 AND round(j + 0.1::DOUBLE * k, 6) >= 0.55")
def _(c):
    return A.lifted_pairs(c.paper_domains, c.mentions.select("doc_id", F.col("species_id").alias("keyword")))


@q("related_papers", "WITH d AS (SELECT DISTINCT doc_id, domain FROM paper_domains), s AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), sh AS (SELECT b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.domain = b.domain AND a.doc_id <> b.doc_id WHERE a.doc_id = 5 GROUP BY 1), ks AS (SELECT b.doc_id AS b, count(*) AS k FROM mentions a JOIN mentions b ON a.species_id = b.species_id AND a.doc_id <> b.doc_id WHERE a.doc_id = 5 GROUP BY 1), j AS (SELECT sh.b, c / (s.n + (SELECT n FROM s WHERE doc_id = 5) - c) AS j FROM sh JOIN s ON s.doc_id = sh.b), al AS (SELECT coalesce(j.b, ks.b) AS doc_id, coalesce(j, 0) + 0.1::DOUBLE * coalesce(k, 0) AS s FROM j FULL JOIN ks ON j.b = ks.b) SELECT doc_id, round(s, 6) AS similarity FROM al WHERE s >= 0.55 ORDER BY similarity DESC, doc_id LIMIT 5")
def _(c):
    one = c.papers.where("doc_id = 5").select("doc_id")
    return A.strongest_neighbours(A.paper_similarity(c.paper_domains, c.mentions.select("doc_id", F.col("species_id").alias("keyword")), paper=one), 5)


@q("concept_graph", "WITH d AS (SELECT DISTINCT doc_id, domain AS c FROM paper_domains), p AS (SELECT a.c AS a, b.c AS b, a.doc_id FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.c < b.c), f AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY a, b) AS papers FROM p) SELECT a, b, papers, string_agg(cast(doc_id AS varchar), ',' ORDER BY doc_id) AS sample FROM f WHERE n <= 5 AND papers >= 2 GROUP BY 1, 2, 3")
def _(c):
    return A.concept_graph(c.paper_domains.select("doc_id", F.col("domain").alias("concept")))


@q("domain_paper_graph", "SELECT DISTINCT 'domain:' || domain AS a, 'paper:' || doc_id AS b FROM paper_domains")
def _(c):
    return c.paper_domains.select(F.concat(F.lit("domain:"), "domain").alias("a"), F.concat(F.lit("paper:"), F.col("doc_id").cast("string")).alias("b")).distinct()


@q("concepts_of_papers", "WITH st AS (SELECT unnest(string_split('" + " ".join(C.STOP) + "', ' ')) AS w), w AS (SELECT doc_id, unnest(list_transform(string_split(lower(CASE WHEN doc_id % 2 = 0 THEN title || ' (new), \"method\": -between- study.' ELSE title END), ' '), lambda w: trim(w, '.,;:!?()[]\"''-–—'))) AS w FROM papers UNION ALL SELECT doc_id, lower(study_type) || 'xx' FROM papers) SELECT p.doc_id, count(DISTINCT w.w) AS n FROM papers p LEFT JOIN w ON w.doc_id = p.doc_id AND length(w.w) > 2 AND (length(w.w) > 3 OR ends_with(w.w, 'xx')) AND w.w NOT IN (SELECT w FROM st) GROUP BY 1")
def _(c):
    title = F.when(F.col("doc_id") % 2 == 0, F.concat("title", F.lit(' (new), "method": -between- study.'))).otherwise(F.col("title"))
    con = C.concepts(title, F.array(F.concat("study_type", F.lit("xx"))), F.array().cast("array<string>"))
    return c.papers.select("doc_id", F.size(con).cast("bigint").alias("n"))


# -- centralities, hops, components ------------------------------------------------------------------------

EDGES = "e AS (SELECT DISTINCT subject AS a, object AS b FROM relations), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def edges(c):
    return c.relations.select(F.col("subject").alias("a"), F.col("object").alias("b")).distinct()


@q("degree_centrality", f"WITH {EDGES}, g AS (SELECT a AS node, count(*) AS d FROM u GROUP BY 1) SELECT s.species_id AS node, coalesce(d, 0) AS degree, round(coalesce(d, 0) / ((SELECT count(*) FROM species) - 1), 9) AS centrality FROM species s LEFT JOIN g ON g.node = s.species_id")
def _(c):
    return A.degree_centrality(c.species.select(F.col("species_id").alias("node")), edges(c))


@q("k_hop_network", "WITH e AS (SELECT * FROM relations), n1 AS (SELECT DISTINCT unnest([subject, object]) AS n FROM e WHERE subject = 11 OR object = 11), n2 AS (SELECT DISTINCT unnest([subject, object]) AS n FROM e WHERE subject IN (SELECT n FROM n1) OR object IN (SELECT n FROM n1)) SELECT DISTINCT subject, object, type FROM e WHERE subject IN (SELECT n FROM n2) OR object IN (SELECT n FROM n2)")
def _(c):
    return A.k_hop_edges(c.relations, 11, 3)


@q("ego_network", "WITH n1 AS (SELECT 'species:11' AS n UNION SELECT 'species:' || object FROM relations WHERE subject = 11 UNION SELECT 'species:' || subject FROM relations WHERE object = 11) SELECT DISTINCT 'species:' || subject AS a, 'species:' || object AS b, type FROM relations WHERE 'species:' || subject IN (SELECT n FROM n1) AND 'species:' || object IN (SELECT n FROM n1)")
def _(c):
    named = lambda x: F.concat(F.lit("species:"), F.col(x).cast("string"))
    return A.ego_network(c.relations.select(named("subject").alias("a"), named("object").alias("b"), "type"), "species:11", 1)


@q("similar_nodes", f"WITH {EDGES}, n AS (SELECT a, count(*) AS n FROM u GROUP BY 1), m AS (SELECT b FROM u WHERE a = 11), sh AS (SELECT u.a, count(*) AS c FROM u JOIN m ON m.b = u.b WHERE u.a <> 11 GROUP BY 1) SELECT sh.a AS node, round(c / (n + (SELECT count(*) FROM m) - c), 6) AS similarity FROM sh JOIN n ON n.a = sh.a ORDER BY similarity DESC, node LIMIT 10")
def _(c):
    return A.similar_nodes(edges(c), 11)


@q("similar_nodes_of_many", f"WITH {EDGES}, n AS (SELECT a, count(*) AS n FROM u GROUP BY 1), sh AS (SELECT m.a AS query_id, u.a, count(*) AS c FROM u m JOIN u ON m.b = u.b AND m.a <> u.a WHERE m.a % 50 = 0 GROUP BY 1, 2), s AS (SELECT query_id, sh.a AS node, round(c / (n.n + m.n - c), 6) AS similarity FROM sh JOIN n ON n.a = sh.a JOIN n m ON m.a = query_id) SELECT query_id, node, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node) AS k FROM s) x WHERE k <= 10")
def _(c):
    return A.similar_nodes_of(edges(c), c.species.where("species_id % 50 = 0").select(F.col("species_id").alias("node")))


@q("k_hop_networks", f"WITH {EDGES}, near AS (SELECT species_id AS start, species_id AS node FROM species WHERE species_id % 50 = 0 UNION SELECT a, b FROM u WHERE a % 50 = 0) SELECT DISTINCT start, subject, object, type FROM near JOIN relations r ON r.subject = near.node UNION SELECT start, subject, object, type FROM near JOIN relations r ON r.object = near.node")
def _(c):
    return A.k_hop_edges_of(c.relations, c.species.where("species_id % 50 = 0").select(F.col("species_id").alias("node")))


#: Citations of an author form chains: components of many sizes, which SQL finds as the chain's smallest paper.
@q("components", "WITH RECURSIVE e AS (SELECT citing AS a, cited AS b FROM citations UNION SELECT cited, citing FROM citations), r AS (SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders) SELECT node, component FROM r WHERE node IN (SELECT a FROM e)")
def _(c):
    return A.components(c.citations.select(F.col("citing").alias("a"), F.col("cited").alias("b")))


PR = "WITH e AS (SELECT DISTINCT subject AS a, object AS b FROM relations), sh AS (SELECT a, b, 1.0::DOUBLE / count(*) OVER (PARTITION BY a) AS w FROM e), nd AS (SELECT a AS node FROM e UNION SELECT b FROM e), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS rank, node NOT IN (SELECT a FROM e) AS open FROM nd)"
for _i in range(1, 31):
    PR += f", r{_i} AS MATERIALIZED (SELECT p.node, 0.15::DOUBLE / (SELECT count(*) FROM nd) + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank) FILTER (WHERE open), 0) FROM r{_i - 1}) / (SELECT count(*) FROM nd)) AS rank, p.open FROM r{_i - 1} p LEFT JOIN (SELECT sh.b, sum(r.rank * sh.w) AS got FROM sh JOIN r{_i - 1} r ON r.node = sh.a GROUP BY 1) g ON g.b = p.node)"


#: Both sides run until nothing moves any more; thirty rounds are more than these graphs need.
@q("pagerank", PR + " SELECT node, round(rank, 9) AS rank FROM r30")
def _(c):
    return A.pagerank(edges(c), tolerance=1e-12).select("node", F.round("rank", 9).alias("rank"))


#: The sample of sources that the sampled betweenness is defined by.
SOURCES = 100


@q("label_propagation")
def _(c):
    return A.label_propagation(edges(c))


@q("louvain")
def _(c):
    return A.louvain(edges(c))


@q("greedy_communities")
def _(c):
    return A.greedy_communities(edges(c))


@q("betweenness_sampled")
def _(c):
    e = cut(edges(c))  # read for the graph and for its sources
    return A.betweenness(e, e.select(F.col("a").alias("node")).distinct().orderBy(F.xxhash64("node")).limit(SOURCES)).select("node", F.round("betweenness", 6).alias("betweenness"))


#: Citations form one chain for each customer, so the paths between others through a node can be counted.
@q("betweenness", "SELECT node, ((i - 1) * (n - i))::DOUBLE AS betweenness FROM (SELECT o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) t WHERE n > 1")
def _(c):
    return A.betweenness(c.citations.select(F.col("citing").alias("a"), F.col("cited").alias("b")))


# -- links ------------------------------------------------------------------------------------------------

AFF = [("ECONOMY", "SMALL", 0.9), ("PROMO", "LARGE", 0.6), ("STANDARD", "MEDIUM", 0.9)]
AFFV = "af AS (SELECT a, b, s FROM (VALUES " + ", ".join(f"('{a}', '{b}', {s}::DOUBLE), ('{b}', '{a}', {s}::DOUBLE)" for a, b, s in AFF) + ") v(a, b, s))"
STUD = "st AS (SELECT DISTINCT s.common_name AS entity, s.genus AS domain, m.doc_id FROM species s JOIN mentions m ON m.species_id = s.species_id)"


def affinity_table(c):
    return c.spark.createDataFrame(AFF, "a string, b string, score double")


def studied(c):
    return c.species.join(c.mentions, "species_id").select(F.col("common_name").alias("entity"), F.col("genus").alias("domain"), "doc_id").distinct()


SHARED = f"{AFFV}, {STUD}, g AS (SELECT entity, domain, count(DISTINCT doc_id) AS n FROM st GROUP BY 1, 2), ln AS (SELECT x.entity, x.domain AS a, y.domain AS b, x.n AS source_papers, y.n AS target_papers, coalesce(af.s, 0.3::DOUBLE) AS affinity, substr(md5('shared_entity|' || x.entity || '|' || x.domain || '|' || y.domain), 1, 12) AS link_id FROM g x JOIN g y ON x.entity = y.entity AND x.domain < y.domain LEFT JOIN af ON af.a = x.domain AND af.b = y.domain)"


@q("domain_affinity", f"WITH {AFFV}, d AS (SELECT DISTINCT p_type AS d FROM part) SELECT x.d AS a, y.d AS b, CASE WHEN x.d = y.d THEN 1.0::DOUBLE ELSE coalesce(af.s, 0.3::DOUBLE) END AS affinity FROM d x, d y LEFT JOIN af ON af.a = x.d AND af.b = y.d")
def _(c):
    return L.affinity(L.domain_pairs(c.part.select(F.col("p_type").alias("domain"))), affinity_table(c)).select("a", "b", "affinity")


@q("shared_entity_links", f"WITH {SHARED} SELECT entity, a, b, source_papers, target_papers, affinity, link_id FROM ln")
def _(c):
    return L.shared_links(studied(c), affinity_table(c)).drop("link_type")


@q("multi_domain_entities", f"WITH {STUD} SELECT entity, count(DISTINCT domain) AS domains FROM st GROUP BY 1 HAVING count(DISTINCT domain) >= 2 ORDER BY domains DESC, entity LIMIT 20")
def _(c):
    return L.multi_domain(studied(c))


@q("semantic_bridges", "WITH f AS (SELECT * FROM vectors WHERE domain = 1 ORDER BY chunk_id LIMIT 10), s AS (SELECT f.chunk_id AS c, f.doc_id AS d, v.chunk_id, v.doc_id, round(list_dot_product(v.embedding::DOUBLE[], f.embedding::DOUBLE[]) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(f.embedding::DOUBLE[], f.embedding::DOUBLE[])), 6) AS score FROM f, vectors v WHERE v.domain = 2 AND v.doc_id <> f.doc_id), b AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, chunk_id) AS n FROM s WHERE score >= 0.1), o AS (SELECT *, row_number() OVER (PARTITION BY d, doc_id ORDER BY score DESC, c) AS k FROM b WHERE n = 1) SELECT c AS chunk_id, d AS doc_id, chunk_id AS other_chunk, doc_id AS other_doc, score FROM o WHERE k = 1 ORDER BY score DESC, c LIMIT 5")
def _(c):
    return L.semantic_bridges(c.vectors.where("domain = 1"), c.vectors.where("domain = 2"), least=0.1)


@q("cascades", "WITH r AS (SELECT row_number() OVER () AS e, subject, object FROM relations), u AS (SELECT e, subject AS a, object AS b FROM r UNION SELECT e, object, subject FROM r), p1 AS (SELECT [a, b] AS path, [e] AS es, b AS x FROM u WHERE a = 11), p2 AS (SELECT list_append(path, b) AS path, list_append(es, e) AS es, b AS x FROM p1 JOIN u ON a = x WHERE NOT list_contains(es, e)), p3 AS (SELECT list_append(path, b) AS path, list_append(es, e) AS es, b AS x FROM p2 JOIN u ON a = x WHERE NOT list_contains(es, e)), al AS (SELECT DISTINCT path, x FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) t), d AS (SELECT m.species_id, count(DISTINCT p.domain) AS domains, count(DISTINCT p.doc_id) AS papers FROM mentions m JOIN paper_domains p ON p.doc_id = m.doc_id GROUP BY 1 HAVING count(DISTINCT p.domain) >= 2) SELECT array_to_string(path, '>') AS path, len(path)::INT - 1 AS depth, domains, papers FROM al JOIN d ON d.species_id = x")
def _(c):
    s = c.mentions.join(c.paper_domains, "doc_id").select(F.col("species_id").alias("entity"), "domain", "doc_id")
    return L.cascades(c.relations, s, 11, 3)


HYP = f"{SHARED}, hy AS (SELECT substr(md5('h:' || link_id), 1, 12) AS hypothesis_id, 'shared_entity' AS type, entity || ' is studied in ' || a || ' and in ' || b || '; findings may carry over.' AS statement, 'medium' AS level, affinity AS score FROM ln)"


@q("hypotheses", f"WITH {HYP} SELECT * FROM hy")
def _(c):
    return L.hypotheses(L.shared_links(studied(c), affinity_table(c)))


@q("hypothesis_report", f"WITH {HYP} SELECT type, count(*) OVER (PARTITION BY type) AS n, statement FROM hy")
def _(c):
    return L.hypothesis_report(L.hypotheses(L.shared_links(studied(c), affinity_table(c))))


@q("hypothesis_batch", f"WITH {HYP} SELECT hypothesis_id, type, statement, level, score FROM (SELECT hy.*, ln.link_id FROM hy JOIN ln ON hy.hypothesis_id = substr(md5('h:' || ln.link_id), 1, 12) ORDER BY ln.link_id LIMIT 10) t")
def _(c):
    return L.hypothesis_batch(L.shared_links(studied(c), affinity_table(c)))


@q("hypothesis_markdown", f"WITH {HYP} SELECT hypothesis_id, '### ' || type || chr(10) || statement || chr(10) || printf('Confidence: %.2f (%s)', score, level) AS markdown FROM hy")
def _(c):
    return L.hypothesis_markdown(L.hypotheses(L.shared_links(studied(c), affinity_table(c))))


@q("strongest_links", f"WITH {SHARED} SELECT link_id, affinity FROM ln ORDER BY affinity DESC, link_id LIMIT 10")
def _(c):
    return L.capped(L.shared_links(studied(c), affinity_table(c)), 10).select("link_id", "affinity")


@q("knowledge_gaps", "WITH d AS (SELECT DISTINCT name FROM locations), st AS (SELECT species_id, count(DISTINCT country) AS n FROM occurrences WHERE country IN (SELECT name FROM d) GROUP BY 1) SELECT s.species_id AS entity, coalesce(n, 0) AS covered, (SELECT count(*) FROM d) - coalesce(n, 0) AS missing FROM species s LEFT JOIN st ON st.species_id = s.species_id WHERE (SELECT count(*) FROM d) > coalesce(n, 0)")
def _(c):
    s = c.occurrences.select(F.col("species_id").alias("entity"), F.col("country").alias("domain"))
    return L.knowledge_gaps(c.species.select(F.col("species_id").alias("entity")), c.locations.select(F.col("name").alias("domain")), s)


@q("topic_links", f"WITH {AFFV}, d AS (SELECT DISTINCT p_type AS d FROM part), p AS (SELECT x.d AS a, y.d AS b, coalesce(af.s, 0.3::DOUBLE) AS affinity FROM d x JOIN d y ON x.d < y.d LEFT JOIN af ON af.a = x.d AND af.b = y.d) SELECT *, CASE WHEN affinity >= 0.8 THEN 'strong' WHEN affinity >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength FROM p")
def _(c):
    return L.topic_links(c.part.select(F.col("p_type").alias("domain")).distinct(), affinity_table(c))


# -- enrichment -------------------------------------------------------------------------------------------

WORKS = "wk AS (SELECT o_orderkey AS work_id, '10.1/' || o_orderkey AS doi, 'order ' || o_orderkey || ' ' || lower(o_orderpriority) AS title, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE o_orderstatus = 'F')"


def works(c):
    return c.papers.where("study_type = 'F'").select(F.col("doc_id").alias("work_id"), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"), "title", "year")


@q("works_by_doi", f"WITH {WORKS} SELECT p.doc_id, w.work_id FROM papers p LEFT JOIN wk w ON w.doi = '10.1/' || p.doc_id")
def _(c):
    p = c.papers.select("doc_id", F.concat(F.lit("https://doi.org/10.1/"), F.col("doc_id").cast("string")).alias("doi"))
    return E.works_by_doi(p, works(c).select("work_id", "doi")).select("doc_id", "work_id")


NORM = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@q("works_by_title", f"WITH pp AS (SELECT l_orderkey AS doc_id, min(l_partkey) AS k, min(l_suppkey) AS y FROM lineitem GROUP BY 1), p AS (SELECT doc_id, {NORM.format(x='p_name')} AS t, CAST(y % 10 AS INT) AS year FROM pp JOIN part ON p_partkey = k), w AS (SELECT p_partkey AS work_id, {NORM.format(x='p_name')} AS u, CAST(p_partkey % 10 AS INT) AS year FROM part), j AS (SELECT doc_id, work_id, levenshtein(t, u) AS distance, greatest(length(t), length(u)) AS m, split_part(t, ' ', 1) = split_part(u, ' ', 1) AS same FROM p JOIN w ON p.year = w.year) SELECT doc_id, work_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, work_id) AS n FROM j WHERE distance <= 0.2::DOUBLE * m AND (same OR distance <= 2)) x WHERE n = 1")
def _(c):
    pp = c.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_partkey").alias("p_partkey"), F.min("l_suppkey").alias("y"))
    p = pp.join(c.part, "p_partkey").select("doc_id", F.col("p_name").alias("title"), (F.col("y") % 10).cast("int").alias("year"))
    w = c.part.select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), (F.col("p_partkey") % 10).cast("int").alias("year"))
    return E.works_by_title(p, w)


@q("matched_citations", "SELECT citing AS citation_id, cited AS doc_id, 1.0::DOUBLE AS match_confidence FROM citations WHERE cited % 2 = 0 UNION ALL SELECT citing, cited, 0.95::DOUBLE FROM citations WHERE cited % 2 = 1")
def _(c):
    p = c.papers.withColumn("doi", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))))
    cit = c.citations.join(p.withColumnRenamed("doc_id", "cited"), "cited").select(F.col("citing").alias("citation_id"), "doi", F.upper("title").alias("title"), "year")
    return E.match_citations(cit, p.select("doc_id", "doi", "title", "year"))


@q("merged_works", "SELECT doc_id, title, CASE WHEN year >= 1997 THEN 'J' END AS journal, CASE WHEN study_type = 'F' THEN 'A' END AS abstract, CASE WHEN year >= 1997 AND study_type = 'F' THEN greatest(author_id, 500) WHEN year >= 1997 THEN author_id WHEN study_type = 'F' THEN 500 END AS citations, concat_ws(',', CASE WHEN year >= 1997 THEN 'first' END, CASE WHEN study_type = 'F' THEN 'second' END) AS sources FROM papers")
def _(c):
    none = F.array().cast("array<string>").alias("authors")
    a = c.papers.where("year >= 1997").select("doc_id", "title", F.lit("J").alias("journal"), F.col("author_id").alias("citations"), none)
    b = c.papers.where("study_type = 'F'").select("doc_id", "title", F.lit("A").alias("abstract"), F.lit(500).cast("long").alias("citations"), none)
    return E.merge_works(c.papers, a, b).drop("authors").withColumn("sources", F.array_join("sources", ","))


BB = "bb AS (SELECT min(p_partkey) AS taxon_id, lower(p_name) AS sci FROM part GROUP BY 2)"


def backbone(c):
    b = c.part.groupBy(F.col("p_name").alias("scientific_name")).agg(F.min("p_partkey").alias("taxon_id"))
    return b.select("taxon_id", "scientific_name", F.lit(None).cast("long").alias("accepted_id"))


@q("resolved_names", f"WITH {BB}, n AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN 'x' || p_name || 'x' ELSE 'no such thing' END AS name FROM part), j AS (SELECT name, taxon_id, CASE WHEN lower(name) = sci THEN 1 ELSE 2 END AS tier, levenshtein(lower(name), sci) AS d FROM n, bb), b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, d, taxon_id) AS k FROM j WHERE d <= 2) SELECT n.name, b.taxon_id AS accepted_id, b.tier FROM n LEFT JOIN b ON b.name = n.name AND b.k = 1")
def _(c):
    k = F.col("p_partkey") % 3
    names = c.part.select(F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit("x"), "p_name", F.lit("x"))).otherwise("no such thing").alias("name"))
    return E.resolve_names(names, backbone(c))


@q("vernacular_names", f"WITH {BB} SELECT DISTINCT upper(p_name) AS name, bb.taxon_id FROM part JOIN bb ON bb.sci = lower(p_name)")
def _(c):
    v = c.part.select(F.col("p_name").alias("vernacular"), F.col("p_partkey").alias("taxon_id"))
    return E.resolve_vernacular(c.part.select(F.upper("p_name").alias("name")).distinct(), v)


@q("validated_species", f"WITH {BB}, s AS (SELECT species_id, CASE WHEN species_id % 2 = 0 THEN common_name ELSE 'x' || common_name END AS common_name, family FROM species), n AS (SELECT DISTINCT common_name AS name FROM s), b AS (SELECT name, taxon_id, row_number() OVER (PARTITION BY name ORDER BY levenshtein(lower(name), sci) > 0, levenshtein(lower(name), sci), taxon_id) AS k FROM n, bb WHERE levenshtein(lower(name), sci) <= 2) SELECT s.species_id, s.common_name, coalesce(t.p_brand, s.family) AS family, b.taxon_id IS NOT NULL AS validated FROM s LEFT JOIN b ON b.name = s.common_name AND b.k = 1 LEFT JOIN part t ON t.p_partkey = b.taxon_id")
def _(c):
    s = c.species.withColumn("common_name", F.when(F.col("species_id") % 2 == 0, F.col("common_name")).otherwise(F.concat(F.lit("x"), "common_name")))
    r = E.resolve_names(s.select(F.col("common_name").alias("name")), backbone(c))
    return E.write_back(s, r, c.part.select(F.col("p_partkey").alias("taxon_id"), F.col("p_brand").alias("family")))


@q("species_cards", "SELECT s.species_id, p.p_size AS length_cm, n.names FROM species s LEFT JOIN part p ON p.p_partkey = s.species_id LEFT JOIN (SELECT p_partkey AS species_id, p_brand || ',' || p_name AS names FROM part) n ON n.species_id = s.species_id")
def _(c):
    cards = c.part.select(F.col("p_partkey").alias("species_id"), F.col("p_size").alias("length_cm"))
    names = c.part.select(F.col("p_partkey").alias("species_id"), F.explode(F.array("p_name", "p_brand")).alias("name"))
    return E.species_cards(c.species.select("species_id"), cards, names)


STATUS = "SELECT species_id, CASE WHEN genus = 'ECONOMY' THEN 'CR' WHEN family = 'Brand#2' THEN 'LC' END AS category, CASE WHEN genus = 'ECONOMY' THEN 'first' WHEN family = 'Brand#2' THEN 'fallback' END AS source, CASE WHEN genus = 'ECONOMY' THEN 'Critically Endangered' WHEN family = 'Brand#2' THEN 'Least Concern' END AS category_name, genus = 'ECONOMY' AS threatened FROM species"


def status(c):
    s = c.species
    return E.conservation(s.select("species_id"), s.where("genus = 'ECONOMY'").withColumn("category", F.lit("CR")), s.where("family = 'Brand#2'").withColumn("category", F.lit("LC")))


@q("conservation_status", STATUS)
def _(c):
    return status(c)


@q("species_report", f"WITH o AS (SELECT species_id, count(*) AS total, count(DISTINCT country) AS countries FROM occurrences GROUP BY 1), st AS ({STATUS}) SELECT s.species_id, p.p_size AS length_cm, total, countries, category, source, category_name, threatened FROM species s LEFT JOIN part p ON p.p_partkey = s.species_id LEFT JOIN o ON o.species_id = s.species_id LEFT JOIN st ON st.species_id = s.species_id")
def _(c):
    cards = c.part.select(F.col("p_partkey").alias("species_id"), F.col("p_size").alias("length_cm"))
    return E.species_report(c.species.select("species_id"), c.occurrences, cards, status(c))


@q("knowledge_gaps_by_kind", "WITH kinds AS (SELECT 'places' AS kind, name FROM locations GROUP BY 1, 2 UNION ALL SELECT 'measurements', parameter FROM measurements GROUP BY 1, 2 UNION ALL SELECT 'domains', p_type FROM part GROUP BY 1, 2), known AS (SELECT 'places' AS kind, species_id, country AS name FROM occurrences UNION SELECT 'measurements', species_id, parameter FROM measurements UNION SELECT 'domains', species_id, domain FROM mentions JOIN paper_domains ON paper_domains.doc_id = mentions.doc_id), n AS (SELECT known.kind, species_id, count(*) AS covered FROM known JOIN kinds ON kinds.kind = known.kind AND kinds.name = known.name GROUP BY 1, 2), t AS (SELECT kind, count(*) AS total FROM kinds GROUP BY 1) SELECT t.kind, s.species_id AS entity, coalesce(covered, 0) AS covered, total - coalesce(covered, 0) AS missing FROM species s CROSS JOIN t LEFT JOIN n ON n.kind = t.kind AND n.species_id = s.species_id WHERE total > coalesce(covered, 0)")
def _(c):
    known = lambda df, name: df.select(F.col("species_id").alias("entity"), F.col(name).alias("domain"))
    there = lambda df, name: df.select(F.col(name).alias("domain"))
    of = c.mentions.join(c.paper_domains.hint("merge"), "doc_id")
    return L.gaps_of_kinds(
        c.species.select(F.col("species_id").alias("entity")),
        places=(there(c.locations, "name"), known(c.occurrences, "country")),
        measurements=(there(c.measurements, "parameter"), known(c.measurements, "parameter")),
        domains=(there(c.part, "p_type"), known(of, "domain")),
    )


@q("clean_names", "SELECT species_id, common_name AS name, upper(substr(common_name, 1, 1)) || lower(substr(split_part(common_name, ' ', 1), 2)) AS genus, lower(split_part(common_name, ' ', 2)) AS epithet FROM species")
def _(c):
    n = C.clean_species_name(F.concat("common_name", F.lit(" (Author, 1900) [sic]")))
    return c.species.select("species_id", n.alias("name"), C.genus_epithet("common_name").alias("g")).select("species_id", "name", "g.genus", "g.epithet")


DISCOVER = f"WITH {SHARED}, md AS (SELECT entity FROM (SELECT entity, count(DISTINCT domain) AS n FROM st GROUP BY 1 HAVING count(DISTINCT domain) >= 2) t ORDER BY n DESC, entity LIMIT 20) SELECT 'shared_entity' AS link_type, link_id, affinity FROM ln WHERE entity IN (SELECT entity FROM md) ORDER BY affinity DESC, link_id LIMIT 10"


@q("discovered_links", DISCOVER)
def _(c):
    return L.discover(studied(c), affinity_table(c))


@q("discovered_cascades")
def _(c):
    s = c.mentions.join(c.paper_domains, "doc_id").select(F.col("species_id").alias("entity"), "domain", "doc_id")
    return L.discover(s, affinity_table(c), c.relations)
