"""Queries over the graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.plans.tables import q

DOCS_OF = "SELECT DISTINCT doc_id FROM mentions WHERE species_id = 7"


@q("species_profile", "SELECT s.species_id, s.family, coalesce(p.papers, 0) AS papers, coalesce(m.vals, 0) AS \"values\", coalesce(r.relations, 0) AS relations FROM species s LEFT JOIN (SELECT species_id, count(DISTINCT doc_id) AS papers FROM mentions GROUP BY 1) p ON p.species_id = s.species_id LEFT JOIN (SELECT species_id, count(DISTINCT (parameter, value)) AS vals FROM measurements GROUP BY 1) m ON m.species_id = s.species_id LEFT JOIN (SELECT species_id, count(DISTINCT (way, other, type)) AS relations FROM (SELECT subject AS species_id, 'out' AS way, object AS other, type FROM relations UNION ALL SELECT object, 'in', subject, type FROM relations) x GROUP BY 1) r ON r.species_id = s.species_id")
def _(c):
    return G.species_profile(c.species.select("species_id", "family"), c.mentions, c.measurements, c.relations)


@q("compare_species", "WITH a AS MATERIALIZED (SELECT parameter, value, unit FROM measurements WHERE species_id = 7), b AS MATERIALIZED (SELECT parameter, value, unit FROM measurements WHERE species_id = 8) SELECT a.parameter, a.value AS value_a, a.unit AS unit_a, b.value AS value_b, b.unit AS unit_b FROM a JOIN b ON a.parameter = b.parameter")
def _(c):
    return G.compare_species(c.measurements, 7, 8)


@q("cooccurring_of_many", "WITH p AS (SELECT a.species_id AS query_id, b.species_id, count(*) AS papers FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.species_id <> b.species_id WHERE a.species_id % 50 = 0 GROUP BY 1, 2) SELECT query_id, species_id, papers FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY papers DESC, species_id) AS n FROM p) x WHERE n <= 20")
def _(c):
    return G.cooccurring_of(c.mentions, c.species.where("species_id % 50 = 0"))


@q("cooccurring_species", f"SELECT species_id, count(DISTINCT doc_id) AS papers FROM mentions WHERE species_id <> 7 AND doc_id IN ({DOCS_OF}) GROUP BY 1 ORDER BY papers DESC, species_id LIMIT 20")
def _(c):
    return G.cooccurring(c.mentions, 7)


@q("species_pairs", "SELECT a.species_id AS a, b.species_id AS b, count(*) AS papers FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.species_id < b.species_id GROUP BY 1, 2 HAVING count(*) >= 1")
def _(c):
    return G.cooccurrence(c.mentions)


@q("top_species_pairs", "WITH t AS (SELECT species_id FROM (SELECT species_id, count(DISTINCT doc_id) AS n FROM mentions GROUP BY 1) x ORDER BY n DESC, species_id LIMIT 100) SELECT a.species_id AS a, b.species_id AS b, count(*) AS papers FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.species_id < b.species_id WHERE a.species_id IN (SELECT * FROM t) AND b.species_id IN (SELECT * FROM t) GROUP BY 1, 2")
def _(c):
    return G.cooccurrence(c.mentions.join(F.broadcast(G.top_by_papers(c.mentions, 100)), "species_id", "left_semi"))


@q("paper_links_by_species", "WITH t AS (SELECT doc_id FROM (SELECT doc_id, count(DISTINCT species_id) AS n FROM mentions GROUP BY 1) x ORDER BY n DESC, doc_id LIMIT 200), m AS (SELECT DISTINCT doc_id, species_id FROM mentions WHERE doc_id IN (SELECT * FROM t)) SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM m a JOIN m b ON a.species_id = b.species_id AND a.doc_id < b.doc_id GROUP BY 1, 2")
def _(c):
    return G.papers_by_shared_species(c.mentions, 200)


@q("habitat_associations", "SELECT m.species_id, count(DISTINCT m.doc_id) AS papers, string_agg(DISTINCT l.name, ',' ORDER BY l.name) AS places FROM locations l JOIN references_location r ON l.location_id = r.location_id JOIN mentions m ON m.doc_id = r.doc_id WHERE l.region = (SELECT min(region) FROM locations) GROUP BY 1")
def _(c):
    region = c.locations.agg(F.min("region").alias("region"))  # one row
    return G.habitat_associations(c.locations.join(F.broadcast(region), "region", "left_semi").withColumn("region", F.lit("x")), c.references_location, c.mentions, "x")


@q("place_species", "SELECT m.species_id, l.name, l.region, count(DISTINCT m.doc_id) AS papers FROM locations l JOIN references_location r ON l.location_id = r.location_id JOIN mentions m ON m.doc_id = r.doc_id WHERE contains(lower(l.name), '_1') OR contains(lower(l.region), '_1') GROUP BY 1, 2, 3")
def _(c):
    return G.place_species(c.locations, c.references_location, c.mentions, "_1")


@q("species_with_samples", "WITH m AS (SELECT DISTINCT species_id, doc_id FROM mentions), few AS (SELECT species_id, string_agg(cast(doc_id AS varchar), ',' ORDER BY doc_id) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY species_id ORDER BY doc_id) AS n FROM m) x WHERE n <= 3 GROUP BY 1) SELECT s.species_id, coalesce(n.papers, 0) AS papers, f.sample FROM species s LEFT JOIN (SELECT species_id, count(*) AS papers FROM m GROUP BY 1) n ON n.species_id = s.species_id LEFT JOIN few f ON f.species_id = s.species_id")
def _(c):
    out = G.species_with_samples(c.species.select("species_id"), c.mentions)
    return out.withColumn("sample", F.array_join(F.transform("sample", lambda x: x.cast("string")), ","))


@q("geographic_range", f"SELECT l.location_id, l.name, l.latitude, l.longitude, count(DISTINCT r.doc_id) AS papers FROM references_location r JOIN locations l ON l.location_id = r.location_id WHERE r.doc_id IN ({DOCS_OF}) GROUP BY ALL")
def _(c):
    return G.geographic_range(c.locations, c.references_location, c.mentions, 7)


KM = "round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({a}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({a})) * pow(sin((radians({c}) - radians({d})) / 2), 2)))), 6)"


@q("near_studies", f"SELECT * FROM (SELECT location_id, name, {KM.format(a='10.0', b='latitude', c='20.0', d='longitude')} AS km FROM locations) t WHERE km <= 5000")
def _(c):
    return G.near(c.locations, 10.0, 20.0, 5000.0).select("location_id", "name", "km")


@q("radius_join", f"SELECT * FROM (SELECT b.location_id AS centre_id, a.location_id, {KM.format(a='b.latitude', b='a.latitude', c='b.longitude', d='a.longitude')} AS km FROM locations a, locations b) t WHERE km <= 3000")
def _(c):
    return G.radius_join(c.locations, c.locations.withColumnRenamed("location_id", "centre_id"), 3000.0)


@q("author_species", "SELECT m.species_id, count(DISTINCT m.doc_id) AS papers FROM authored_by a JOIN mentions m ON m.doc_id = a.doc_id WHERE a.author_id = 100003 GROUP BY 1")
def _(c):
    return G.author_species(c.authored_by, c.mentions, 100003)


@q("prolific_authors", f"SELECT author_id, count(DISTINCT doc_id) AS papers FROM authored_by WHERE doc_id IN ({DOCS_OF}) GROUP BY 1 ORDER BY papers DESC, author_id LIMIT 10")
def _(c):
    return G.prolific_authors(c.authored_by, c.mentions, 7)


@q("collaborations", "WITH t AS (SELECT author_id FROM (SELECT author_id, count(DISTINCT doc_id) AS n FROM authored_by GROUP BY 1) x ORDER BY n DESC, author_id LIMIT 50), m AS (SELECT DISTINCT doc_id, author_id FROM authored_by WHERE author_id IN (SELECT * FROM t)) SELECT a.author_id AS a, b.author_id AS b, count(*) AS papers FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.author_id < b.author_id GROUP BY 1, 2")
def _(c):
    return G.collaborations(c.authored_by, 50)


@q("measurement_synthesis", "SELECT m.doc_id, m.value, p.title, p.year FROM measurements m LEFT JOIN papers p ON p.doc_id = m.doc_id WHERE m.species_id = 7 AND m.parameter = 'quantity'")
def _(c):
    return G.measurement_synthesis(c.measurements, c.papers, 7, "quantity").select("doc_id", "value", "title", "year")


@q("places_by_papers", "WITH n AS (SELECT location_id, count(DISTINCT doc_id) AS papers FROM references_location GROUP BY 1 ORDER BY papers DESC, location_id LIMIT 10) SELECT n.location_id, n.papers, l.name, f.doc_ids FROM n JOIN locations l ON l.location_id = n.location_id JOIN (SELECT location_id, string_agg(cast(doc_id AS varchar), ',' ORDER BY doc_id) AS doc_ids FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY doc_id) AS k FROM references_location) x WHERE k <= 10 GROUP BY 1) f ON f.location_id = n.location_id")
def _(c):
    out = G.places_by_papers(c.locations, c.references_location, 10)
    return out.withColumn("doc_ids", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ","))


@q("places_of_papers", "SELECT DISTINCT r.location_id, l.name FROM references_location r JOIN locations l ON l.location_id = r.location_id WHERE r.doc_id IN (SELECT doc_id FROM papers WHERE year = 1995)")
def _(c):
    return c.references_location.join(c.papers.where("year = 1995"), "doc_id", "left_semi").join(c.locations, "location_id").select("location_id", "name").distinct()


@q("place_with_papers", "SELECT l.location_id, l.name, r.doc_id, p.title FROM locations l LEFT JOIN references_location r ON r.location_id = l.location_id LEFT JOIN papers p ON p.doc_id = r.doc_id WHERE l.location_id = 3")
def _(c):
    papers = c.references_location.join(c.papers.select("doc_id", "title").hint("merge"), "doc_id", "left").where("location_id = 3")
    return c.locations.where("location_id = 3").select("location_id", "name").join(papers, "location_id", "left").select("location_id", "name", "doc_id", "title")


@q("paper_metadata", "WITH a AS (SELECT b.doc_id, string_agg(DISTINCT a.name, '|' ORDER BY a.name) AS v FROM authored_by b JOIN authors a ON a.author_id = b.author_id GROUP BY 1), s AS (SELECT m.doc_id, string_agg(DISTINCT s.common_name, '|' ORDER BY s.common_name) AS v FROM mentions m JOIN species s ON s.species_id = m.species_id GROUP BY 1), l AS (SELECT r.doc_id, string_agg(DISTINCT l.name, '|' ORDER BY l.name) AS v FROM references_location r JOIN locations l ON l.location_id = r.location_id GROUP BY 1) SELECT p.doc_id, p.title, p.year, coalesce(a.v, '') AS authors, coalesce(s.v, '') AS species, coalesce(l.v, '') AS locations FROM papers p LEFT JOIN a ON a.doc_id = p.doc_id LEFT JOIN s ON s.doc_id = p.doc_id LEFT JOIN l ON l.doc_id = p.doc_id")
def _(c):
    a = c.authored_by.join(c.authors, "author_id").select("doc_id", "name")
    s = c.mentions.join(c.species, "species_id").select("doc_id", F.col("common_name").alias("name"))
    out = G.paper_metadata(c.papers.select("doc_id", "title", "year"), a, s, c.references_location.join(c.locations, "location_id").select("doc_id", "name"))
    return out.select("doc_id", "title", "year", *[F.array_join(x, "|").alias(x) for x in ("authors", "species", "locations")])


@q("species_profile_lists", "SELECT s.species_id, s.family, (SELECT string_agg(m.doc_id || ':' || p.year, ',' ORDER BY m.doc_id) FROM (SELECT DISTINCT doc_id FROM mentions WHERE species_id = 7) m JOIN papers p ON p.doc_id = m.doc_id) AS papers, (SELECT string_agg(parameter || ':' || unit || ':' || n, ',' ORDER BY parameter) FROM (SELECT parameter, unit, count(DISTINCT value) AS n FROM measurements WHERE species_id = 7 GROUP BY 1, 2) x) AS measured, (SELECT string_agg(way || ':' || type || ':' || other, ',' ORDER BY way, type, other) FROM (SELECT DISTINCT 'incoming' AS way, type, subject AS other FROM relations WHERE object = 7 UNION SELECT DISTINCT 'outgoing', type, object FROM relations WHERE subject = 7) y) AS relations FROM species s WHERE s.species_id = 7")
def _(c):
    one = "species_id = 7"
    papers = c.mentions.where(one).select("species_id", "doc_id").distinct().join(c.papers.select("doc_id", "year").hint("merge"), "doc_id")
    measured = c.measurements.where(one).groupBy("species_id", "parameter", "unit").agg(F.count_distinct("value").alias("n"))
    out = c.relations.select(F.col("subject").alias("species_id"), F.lit("outgoing").alias("way"), "type", F.col("object").alias("other"))
    rel = out.unionByName(c.relations.select(F.col("object").alias("species_id"), F.lit("incoming").alias("way"), "type", F.col("subject").alias("other"))).where(one)
    lists = G.lists_of(c.species.where(one).select("species_id", "family"), "species_id", ("papers", papers, ["doc_id", "year"]), ("measured", measured, ["parameter", "unit", "n"]), ("relations", rel, ["way", "type", "other"]))
    flat = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",").alias(name)
    return lists.select("species_id", "family", flat("papers", "doc_id", "year"), flat("measured", "parameter", "unit", "n"), flat("relations", "way", "type", "other"))


@q("papers_of_species", "SELECT m.doc_id, p.title, p.year, m.confidence FROM mentions m JOIN papers p ON p.doc_id = m.doc_id WHERE m.species_id = 7")
def _(c):
    return G.papers_of_species(c.papers, c.mentions, 7)


@q("recent_papers", "SELECT m.doc_id, p.year FROM mentions m JOIN papers p ON p.doc_id = m.doc_id WHERE m.species_id = 7 ORDER BY p.year DESC NULLS FIRST, m.doc_id LIMIT 10")
def _(c):
    return G.papers_of_species(c.papers, c.mentions, 7).limit(10).select("doc_id", "year")


@q("title_enrichment", "SELECT d.doc_id, coalesce(p.title, 'Unknown') AS title, p.year FROM documents d LEFT JOIN papers p ON p.doc_id = d.doc_id")
def _(c):
    return c.documents.select("doc_id").join(c.papers, "doc_id", "left").select("doc_id", F.coalesce("title", F.lit("Unknown")).alias("title"), "year")


@q("known_names", "SELECT DISTINCT name FROM (SELECT upper(p_name) AS name FROM part UNION SELECT 'no such name') t WHERE lower(name) IN (SELECT lower(common_name) FROM species)")
def _(c):
    names = c.part.select(F.upper("p_name").alias("name")).distinct().withColumn("k", F.lower("name"))
    return names.join(c.species.select(F.lower("common_name").alias("k")), "k", "left_semi").select("name")


CHUNKS = "SELECT doc_id, i AS chunk_idx, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) t"


def chunks(c):
    return c.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", F.col("i").cast("bigint").alias("chunk_idx"), "text")


@q("species_evidence", f"WITH ch AS ({CHUNKS}), e AS (SELECT DISTINCT lang AS entity, doc_id FROM documents), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS n FROM e) x WHERE n <= 5) SELECT entity, doc_id, chunk_idx FROM (SELECT f.entity, f.doc_id, ch.chunk_idx, row_number() OVER (PARTITION BY f.entity, f.doc_id ORDER BY ch.chunk_idx) AS k FROM f JOIN ch ON ch.doc_id = f.doc_id WHERE contains(lower(ch.text), CASE entity WHEN 'en' THEN 'the' WHEN 'de' THEN 'die' ELSE 'de' END)) y WHERE k <= 3")
def _(c):
    name = F.when(F.col("lang") == "en", "The").when(F.col("lang") == "de", "die").otherwise("de")
    m = c.documents.select(F.col("lang").alias("entity"), "doc_id")
    names = c.documents.select(F.col("lang").alias("entity"), name.alias("name")).distinct()
    return G.species_evidence(chunks(c), m, names).select("entity", "doc_id", "chunk_idx")


@q("domain_evidence", f"WITH ch AS ({CHUNKS}), f AS (SELECT * FROM (SELECT lang AS domain, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) x WHERE n <= 5) SELECT f.domain, f.doc_id, ch.chunk_idx FROM f JOIN ch ON ch.doc_id = f.doc_id WHERE ch.chunk_idx < 3")
def _(c):
    return G.domain_evidence(chunks(c), c.documents.select(F.col("lang").alias("domain"), "doc_id")).select("domain", "doc_id", "chunk_idx")


@q("parameter_range", "SELECT m.species_id, s.family, m.unit, min(m.value) AS lowest, max(m.value) AS highest, round(avg(m.value), 6) AS mean FROM measurements m JOIN species s ON s.species_id = m.species_id WHERE m.parameter = 'quantity' GROUP BY 1, 2, 3")
def _(c):
    return G.parameter_range(c.measurements, c.species, "quantity")


@q("species_of_family", "SELECT s.species_id, s.common_name, count(DISTINCT m.doc_id) AS papers FROM species s LEFT JOIN mentions m ON m.species_id = s.species_id WHERE s.family = 'Brand#2' GROUP BY 1, 2")
def _(c):
    return G.species_of_family(c.species, c.mentions, "Brand#2")


@q("food_web", "SELECT r.subject, r.object, a.common_name AS predator, b.common_name AS prey FROM relations r JOIN species a ON a.species_id = r.subject JOIN species b ON b.species_id = r.object WHERE r.type = 'predation'")
def _(c):
    return G.food_web(c.relations, c.species)


@q("relation_degree", "WITH e AS (SELECT subject AS s FROM relations UNION ALL SELECT object FROM relations WHERE object <> subject) SELECT s.species_id, count(e.s) AS degree FROM species s LEFT JOIN e ON e.s = s.species_id GROUP BY 1 ORDER BY degree DESC, species_id LIMIT 20")
def _(c):
    return G.relation_degree(c.species, c.relations)


@q("bridge_species", "WITH h AS (SELECT row_number() OVER () AS e, subject, object FROM relations), d AS (SELECT e, subject AS mid, object AS other FROM h UNION SELECT e, object, subject FROM h), f AS (SELECT d.e, d.mid, o.family, m.family AS own FROM d JOIN species o ON o.species_id = d.other JOIN species m ON m.species_id = d.mid) SELECT a.mid AS species_id, count(DISTINCT a.family) + count(DISTINCT b.family) AS bridge_score FROM f a JOIN f b ON a.mid = b.mid AND a.e <> b.e AND a.family <> b.family AND a.family <> a.own GROUP BY 1 ORDER BY bridge_score DESC, species_id LIMIT 20")
def _(c):
    return G.bridge_species(c.species, c.relations)


@q("top_papers_by_species", "SELECT doc_id, count(*) AS mentions, string_agg(DISTINCT cast(species_id AS varchar), ',' ORDER BY cast(species_id AS varchar)) AS species FROM mentions GROUP BY 1 HAVING count(*) >= 2 ORDER BY mentions DESC, doc_id LIMIT 100")
def _(c):
    return G.explorer(c.mentions, 2, 100)


@q("top_species_with_titles", "WITH t AS (SELECT species_id, count(DISTINCT doc_id) AS papers FROM mentions GROUP BY 1 ORDER BY papers DESC, species_id LIMIT 20), j AS (SELECT DISTINCT t.species_id, t.papers, p.title FROM t JOIN mentions m ON m.species_id = t.species_id JOIN papers p ON p.doc_id = m.doc_id) SELECT species_id, papers, string_agg(title, '|' ORDER BY title) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY species_id ORDER BY title) AS n FROM j) x WHERE n <= 3 GROUP BY 1, 2")
def _(c):
    return G.top_species_with_titles(c.mentions, c.papers, 20)


@q("family_histogram", "SELECT family, count(*) AS n FROM species GROUP BY 1 ORDER BY n DESC, family LIMIT 15")
def _(c):
    return c.species.groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family").limit(15)


@q("papers_per_species_histogram", "SELECT papers, count(*) AS n FROM (SELECT species_id, count(DISTINCT doc_id) AS papers FROM mentions GROUP BY 1) t GROUP BY 1 ORDER BY papers LIMIT 20")
def _(c):
    return c.mentions.groupBy("species_id").agg(F.count_distinct("doc_id").alias("papers")).groupBy("papers").agg(F.count("*").alias("n")).orderBy("papers").limit(20)


@q("degree_subgraph", "WITH d AS (SELECT node FROM (SELECT unnest([subject, object]) AS node FROM relations) x GROUP BY 1 ORDER BY count(*) DESC, node LIMIT 50) SELECT subject AS a, object AS b, type FROM relations WHERE subject IN (SELECT node FROM d) AND object IN (SELECT node FROM d)")
def _(c):
    return G.degree_subgraph(c.relations.withColumnsRenamed({"subject": "a", "object": "b"}), 50)


@q("mixed_graph_nodes", "WITH t AS (SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM mentions GROUP BY 1) x ORDER BY n DESC, doc_id LIMIT 100) SELECT 'paper:' || doc_id AS id, 'paper' AS kind FROM t UNION SELECT 'species:' || species_id, 'species' FROM mentions WHERE doc_id IN (SELECT * FROM t) UNION SELECT 'place:' || location_id, 'place' FROM references_location WHERE doc_id IN (SELECT * FROM t)")
def _(c):
    return G.graph_view(c.papers, c.species, c.mentions, c.references_location, 100)[0]


@q("mixed_graph_edges", "WITH t AS (SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM mentions GROUP BY 1) x ORDER BY n DESC, doc_id LIMIT 100), m AS (SELECT DISTINCT doc_id, species_id FROM mentions WHERE doc_id IN (SELECT * FROM t)) SELECT 'paper:' || doc_id AS a, 'species:' || species_id AS b, 'species' AS type FROM m UNION SELECT 'paper:' || doc_id, 'place:' || location_id, 'place' FROM references_location WHERE doc_id IN (SELECT * FROM t) UNION SELECT 'species:' || x.species_id, 'species:' || y.species_id, 'together' FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.species_id < y.species_id")
def _(c):
    return G.graph_view(c.papers, c.species, c.mentions, c.references_location, 100)[1]


@q("occurrence_summary", "SELECT species_id, count(*) AS total, count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS georeferenced, count(DISTINCT country) AS countries, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east, min(year) AS first_year, max(year) AS last_year FROM occurrences GROUP BY 1")
def _(c):
    from quarry.operators.enrich import distribution

    return distribution(c.occurrences)


@q("country_facets", "SELECT species_id, string_agg(country || ':' || n, ',' ORDER BY n DESC, country) AS facets FROM (SELECT species_id, country, count(*) AS n FROM occurrences GROUP BY 1, 2) t GROUP BY 1")
def _(c):
    from quarry.operators.enrich import country_facets

    return country_facets(c.occurrences)


@q("graph_query_network", "WITH e AS (SELECT *, subject = 7 OR object = 7 AS touch FROM relations), d1 AS (SELECT DISTINCT unnest([subject, object]) AS n FROM e WHERE touch) SELECT subject, object, type FROM e WHERE touch OR subject IN (SELECT n FROM d1) OR object IN (SELECT n FROM d1) ORDER BY 1, 2, 3 LIMIT 15")
def _(c):
    return G.named_query("network", 7, papers=c.papers, mentions=c.mentions, measurements=c.measurements, relations=c.relations)


@q("graph_query_profile", "SELECT doc_id, confidence FROM mentions WHERE species_id = 7 ORDER BY confidence DESC, doc_id LIMIT 5")
def _(c):
    return G.named_query("profile", 7, papers=c.papers, mentions=c.mentions, measurements=c.measurements, relations=c.relations)


@q("graph_query_measurements", "SELECT * FROM measurements WHERE species_id = 7 ORDER BY parameter, value, doc_id LIMIT 20")
def _(c):
    return G.named_query("measurements", 7, papers=c.papers, mentions=c.mentions, measurements=c.measurements, relations=c.relations)


@q("authors_of_papers", "SELECT author_key, name FROM (SELECT replace(replace(lower(name), ' ', '_'), '.', '') AS author_key, name, row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id DESC) AS n FROM (SELECT b.doc_id, a.name FROM authored_by b JOIN authors a ON a.author_id = b.author_id) x) t WHERE n = 1")
def _(c):
    papers = c.authored_by.join(c.authors, "author_id").groupBy("doc_id").agg(F.collect_list("name").alias("authors"))
    return G.author_edges(papers)[0].withColumnRenamed("author_id", "author_key")


@q("citation_edges", "SELECT DISTINCT citing AS doc_id, p.title, p.year FROM citations c JOIN papers p ON p.doc_id = c.cited")
def _(c):
    rows = c.citations.join(c.papers.withColumnRenamed("doc_id", "cited"), "cited").select(F.col("citing").alias("doc_id"), "title", "year", F.lit(1.0).alias("match_confidence"), F.col("cited").alias("matches_doc_id"))
    return G.citation_tables(rows)[1]
