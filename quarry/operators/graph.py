"""Graph tables and named graph queries: papers, species, places, measurements, authors, relations.

Functions answer for every entity of a table at once; restrict the input to ask for one.  Where a pattern
would multiply several optional matches, each match is aggregated alone and joined by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators.tables import cut, first_n, sized


def joined(arr, sep: str = ","):
    """A sorted array as text, for reports."""
    return F.array_join(F.sort_array(arr), sep)


# -- building ---------------------------------------------------------------------------------------------


def build_graph(extractions: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables from rows (doc_id, chunk_id, species[], locations[], measurements[], relations[]).

    species: struct(scientific_name, original_name, family, confidence); locations: struct(name, region);
    measurements: struct(parameter, value, unit, species); relations: struct(subject, object, type, description).
    """
    base = ["doc_id", "chunk_id"]
    sp = extractions.select(*base, F.explode("species").alias("s")).select(*base, F.coalesce("s.scientific_name", "s.original_name").alias("name"), "s.original_name", "s.family", "s.confidence")
    loc = extractions.select(*base, F.explode("locations").alias("l")).select(*base, C.location_id("l.name", "l.region").alias("location_id"), "l.name", "l.region")
    mea = extractions.select(*base, F.explode("measurements").alias("m")).select(*base, "m.*").withColumn("measurement_id", C.measurement_id(F.col("doc_id"), F.col("parameter"), F.col("value"), F.coalesce("species", F.lit(""))))
    rel = extractions.select(*base, F.explode("relations").alias("r")).select(*base, "r.*")
    ends = rel.select(F.explode(F.array("subject", "object")).alias("name"))
    species = sp.groupBy("name").agg(F.max("family").alias("family")).join(ends.distinct().hint("merge"), "name", "full_outer")
    has = mea.join(species.select(F.col("name").alias("species")).hint("merge"), "species", "left_semi").select("species", "measurement_id").distinct()
    last = F.struct("doc_id", "chunk_id")
    return {
        "species": species,
        "mentions": sp.select("doc_id", "name", "original_name", "chunk_id", "confidence").distinct(),
        "locations": loc.groupBy("location_id").agg(F.max_by(F.struct("name", "region"), last).alias("l")).select("location_id", "l.*"),
        "references_location": loc.select("doc_id", "location_id", "chunk_id").distinct(),
        "measurements": mea.groupBy("measurement_id").agg(F.max_by(F.struct("parameter", "value", "unit"), last).alias("m")).select("measurement_id", "m.*"),
        "contains": mea.select("doc_id", "measurement_id", "chunk_id").distinct(),
        "has_measurement": has,
        "relations": rel.groupBy("subject", "object", "type").agg(F.max_by("description", last).alias("description")),
    }


def author_edges(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(authors, authored_by) from papers with authors[]; the last spelling of an author wins."""
    rows = papers.select("doc_id", F.explode("authors").alias("name")).withColumn("author_id", C.author_id("name"))
    return rows.groupBy("author_id").agg(F.max_by("name", "doc_id").alias("name")), rows.select("doc_id", "author_id").distinct()


def citation_tables(citations: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(citations, cites, cites_paper): first seen per (title, year); paper edges above the confidence."""
    nodes = citations.groupBy("title", "year").agg(F.min("doc_id").alias("first_doc"))
    edges = citations.select("doc_id", "title", "year").distinct()
    return nodes, edges, citations.where(F.col("match_confidence") > least).select(F.col("doc_id").alias("citing"), F.col("matches_doc_id").alias("cited")).distinct()


# -- species ----------------------------------------------------------------------------------------------


def species_profile(species: DataFrame, mentions: DataFrame, measurements: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts of papers, measurements and relations of every species, zeros included."""
    p = mentions.groupBy("species_id").agg(F.count_distinct("doc_id").alias("papers"))
    m = measurements.groupBy("species_id").agg(F.count_distinct("parameter", "value").alias("values"))
    r = relations.select(F.col("subject").alias("species_id"), F.lit("out").alias("way"), F.col("object").alias("other"), "type").unionByName(relations.select(F.col("object").alias("species_id"), F.lit("in").alias("way"), F.col("subject").alias("other"), "type"))
    r = r.groupBy("species_id").agg(F.count_distinct("way", "other", "type").alias("relations"))
    out = species.join(p, "species_id", "left").join(m, "species_id", "left").join(r, "species_id", "left")
    return out.na.fill(0, ["papers", "values", "relations"])


def compare_species(measurements: DataFrame, a: int, b: int) -> DataFrame:
    """Every pair of values of two species on a shared parameter."""
    x = measurements.where(F.col("species_id") == a).select("parameter", F.col("value").alias("value_a"), F.col("unit").alias("unit_a"))
    y = measurements.where(F.col("species_id") == b).select("parameter", F.col("value").alias("value_b"), F.col("unit").alias("unit_b"))
    return x.join(y, "parameter")


def cooccurrence(mentions: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, papers): species pairs by shared papers, each unordered pair once."""
    m = mentions.select("doc_id", "species_id").distinct()
    pairs = m.withColumnRenamed("species_id", "a").join(m.withColumnRenamed("species_id", "b"), "doc_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("papers")).where(F.col("papers") >= least)


def cooccurring(mentions: DataFrame, species_id: int, k: int = 20) -> DataFrame:
    """The species that share most papers with one."""
    docs = mentions.where(F.col("species_id") == species_id).select("doc_id").distinct()
    others = mentions.where(F.col("species_id") != species_id).join(docs, "doc_id", "left_semi")
    return others.groupBy("species_id").agg(F.count_distinct("doc_id").alias("papers")).orderBy(F.desc("papers"), "species_id").limit(k)


def cooccurring_of(mentions: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, species_id, papers): for every species of ``queries`` (species_id) the k that share most papers with it."""
    m = mentions.select("doc_id", "species_id").distinct()
    mine = m.join(queries.select("species_id").distinct().hint("merge"), "species_id").select("doc_id", F.col("species_id").alias("query_id"))
    pairs = mine.join(m.hint("merge"), "doc_id").where("species_id <> query_id").groupBy("query_id", "species_id").agg(F.count("*").alias("papers"))
    return first_n(pairs, ["query_id"], [F.desc("papers"), F.asc("species_id")], k)


def top_by_papers(mentions: DataFrame, n: int) -> DataFrame:
    return mentions.groupBy("species_id").agg(F.count_distinct("doc_id").alias("papers")).orderBy(F.desc("papers"), "species_id").limit(n)


def papers_by_shared_species(mentions: DataFrame, top: int) -> DataFrame:
    """Links between the papers with most species: (a, b, shared)."""
    best = mentions.groupBy("doc_id").agg(F.count_distinct("species_id").alias("n")).orderBy(F.desc("n"), "doc_id").limit(top)
    m = mentions.join(F.broadcast(best), "doc_id", "left_semi").select("doc_id", "species_id").distinct()
    pairs = m.withColumnRenamed("doc_id", "a").join(m.withColumnRenamed("doc_id", "b"), "species_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def species_with_samples(species: DataFrame, mentions: DataFrame, k: int = 3) -> DataFrame:
    """Paper counts, zeros included, and up to k papers as a sample."""
    n = mentions.groupBy("species_id").agg(F.count_distinct("doc_id").alias("papers"))
    few = first_n(mentions.select("species_id", "doc_id").distinct(), ["species_id"], [F.asc("doc_id")], k).groupBy("species_id").agg(F.sort_array(F.collect_list("doc_id")).alias("sample"))
    return species.join(n, "species_id", "left").join(few, "species_id", "left").na.fill(0, ["papers"])


def species_of_family(species: DataFrame, mentions: DataFrame, family: str) -> DataFrame:
    s = species.where(F.col("family") == family).join(mentions, "species_id", "left")
    return s.groupBy("species_id", "common_name").agg(F.count_distinct("doc_id").alias("papers"))


def food_web(relations: DataFrame, species: DataFrame) -> DataFrame:
    """Directed predation edges with names."""
    names = species.select("species_id", "common_name")
    e = relations.where("type = 'predation'")
    e = e.join(names.withColumnsRenamed({"species_id": "subject", "common_name": "predator"}), "subject")
    return e.join(names.withColumnsRenamed({"species_id": "object", "common_name": "prey"}), "object").select("subject", "object", "predator", "prey")


def relation_degree(species: DataFrame, relations: DataFrame, k: int = 20) -> DataFrame:
    """Species by number of relations at either end, a self-loop once; zeros kept."""
    ends = relations.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("species_id"))
    n = ends.groupBy("species_id").agg(F.count("*").alias("degree"))
    return species.select("species_id").join(n, "species_id", "left").na.fill(0, ["degree"]).orderBy(F.desc("degree"), "species_id").limit(k)


def bridge_species(species: DataFrame, relations: DataFrame, k: int = 20) -> DataFrame:
    """Species between two neighbours of different families, the first of another family than its own; by families connected.

    The score adds the families that can come first and those that can come second.  Both follow from the set of
    families next to a species, so the pairs of neighbours are never made: with two other families next to it, any of
    them can come first and every family second; with one, that one first and the species' own second, if it is there.
    """
    fam = species.select("species_id", "family").where("family is not null")
    out = relations.select(F.col("subject").alias("mid"), F.col("object").alias("other"))
    half = out.unionByName(relations.select(F.col("object").alias("mid"), F.col("subject").alias("other")))
    half = half.join(fam.select(F.col("species_id").alias("other"), "family"), "other").join(fam.select(F.col("species_id").alias("mid"), F.col("family").alias("own")), "mid")
    n = half.groupBy("mid").agg(F.count_distinct("family").alias("every"), F.count_distinct(F.when(F.col("family") != F.col("own"), F.col("family"))).alias("others"))
    score = F.when(F.col("others") >= 2, F.col("others") + F.col("every")).when((F.col("others") == 1) & (F.col("every") == 2), 2)
    return n.select(F.col("mid").alias("species_id"), score.alias("bridge_score")).where("bridge_score is not null").orderBy(F.desc("bridge_score"), "species_id").limit(k)


# -- measurements -----------------------------------------------------------------------------------------


def measurement_synthesis(measurements: DataFrame, papers: DataFrame, species_id: int, parameter: str) -> DataFrame:
    """Values with their source paper, if known, by year."""
    m = measurements.where((F.col("species_id") == species_id) & (F.col("parameter") == parameter))
    return m.join(papers.select("doc_id", "title", "year"), "doc_id", "left").orderBy(F.asc_nulls_last("year"), "doc_id", "value")


def parameter_range(measurements: DataFrame, species: DataFrame, parameter: str) -> DataFrame:
    m = measurements.where(F.col("parameter") == parameter).join(species, "species_id")
    return m.groupBy("species_id", "family", "unit").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.round(F.avg("value"), 6).alias("mean")).orderBy(F.desc("mean"), "species_id")


# -- places -----------------------------------------------------------------------------------------------


def place_species(locations: DataFrame, references: DataFrame, mentions: DataFrame, text: str) -> DataFrame:
    """Species in papers on places whose name or region contains the text."""
    places = locations.where(F.lower("name").contains(text.lower()) | F.lower("region").contains(text.lower()))
    j = references.join(sized(cut(places.select("location_id", "name", "region"))), "location_id").join(mentions.hint("merge"), "doc_id")
    return j.groupBy("species_id", "name", "region").agg(F.count_distinct("doc_id").alias("papers"))


def habitat_associations(locations: DataFrame, references: DataFrame, mentions: DataFrame, region: str) -> DataFrame:
    places = sized(cut(locations.where(F.col("region") == region).select("location_id", "name")))
    j = references.join(places, "location_id").join(mentions.hint("merge"), "doc_id")
    return j.groupBy("species_id").agg(F.count_distinct("doc_id").alias("papers"), joined(F.collect_set("name")).alias("places"))


def geographic_range(locations: DataFrame, references: DataFrame, mentions: DataFrame, species_id: int) -> DataFrame:
    docs = mentions.where(F.col("species_id") == species_id).select("doc_id").distinct()
    places = locations.where("latitude is not null and longitude is not null")
    return references.join(docs, "doc_id").join(places, "location_id").groupBy("location_id", "name", "latitude", "longitude").agg(F.count_distinct("doc_id").alias("papers"))


def near(points: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Points within km of one, nearest first; a latitude band prunes the scan."""
    band = km / 111.0
    d = C.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon))
    return points.where(F.col("latitude").between(lat - band, lat + band)).withColumn("km", F.round(d, 6)).where(F.col("km") <= km).orderBy("km", "location_id")


def radius_join(points: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """(centre_id, location_id, km) of all points within km of each centre (id, latitude, longitude).

    Both sides meet on bands of latitude as wide as the radius, cut into cells of longitude: a band has as many cells
    round the globe as are at least as wide as the radius at its narrower edge (one near the poles).  A centre looks
    into its own band and the two next to it, and there into its own cell and the two next to it, round the date line.
    """
    width = km / 111.0
    band = lambda lat: F.floor(lat / width).cast("long")
    edge = lambda b: F.least(F.lit(90.0), F.greatest(F.abs(b * width), F.abs((b + 1) * width)))
    # at the edge's latitude a radius spans asin(sin r / cos lat) degrees; one cell where that has no bound
    reach = lambda b: F.sin(F.lit(km * 1.02 / 6371.0)) / F.cos(F.radians(edge(b)))
    cells = lambda b: F.when((reach(b) < 1) & (edge(b) + width < 90), F.greatest(F.lit(1), F.floor(F.lit(360.0) / F.degrees(F.asin(reach(b)))))).otherwise(1).cast("long")
    cell = lambda lon, n: F.least(n - 1, F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n)).cast("long")
    p = points.where("latitude is not null and longitude is not null").select("location_id", F.col("latitude").alias("y"), F.col("longitude").alias("x"), band(F.col("latitude")).alias("band"))
    p = p.withColumn("cell", cell(F.col("x"), cells(F.col("band"))))
    c = centres.where("latitude is not null and longitude is not null").select("centre_id", F.col("latitude").alias("cy"), F.col("longitude").alias("cx"))
    c = c.withColumn("band", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: band(F.col("cy")) + i))).withColumn("n", cells(F.col("band")))
    around = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.pmod(cell(F.col("cx"), F.col("n")) + i, F.col("n")))
    c = c.withColumn("cell", F.explode(F.array_distinct(around))).drop("n")
    return p.join(c.hint("merge"), ["band", "cell"]).withColumn("km", F.round(C.haversine_km(F.col("y"), F.col("x"), F.col("cy"), F.col("cx")), 6)).where(F.col("km") <= km).select("centre_id", "location_id", "km")


def places_by_papers(locations: DataFrame, references: DataFrame, top: int, shown: int = 10) -> DataFrame:
    """Places with most papers, the first papers listed."""
    n = references.groupBy("location_id").agg(F.count_distinct("doc_id").alias("papers")).orderBy(F.desc("papers"), "location_id").limit(top)
    few = first_n(references.join(F.broadcast(n), "location_id", "left_semi").select("location_id", "doc_id").distinct(), ["location_id"], [F.asc("doc_id")], shown)
    few = few.groupBy("location_id").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    return n.join(few, "location_id").join(locations.select("location_id", "name"), "location_id")


# -- authors ----------------------------------------------------------------------------------------------


def author_species(authored: DataFrame, mentions: DataFrame, author_id: int) -> DataFrame:
    docs = authored.where(F.col("author_id") == author_id).select("doc_id").distinct()
    return mentions.join(docs, "doc_id").groupBy("species_id").agg(F.count_distinct("doc_id").alias("papers"))


def prolific_authors(authored: DataFrame, mentions: DataFrame, species_id: int, k: int = 10) -> DataFrame:
    docs = mentions.where(F.col("species_id") == species_id).select("doc_id").distinct()
    return authored.join(docs, "doc_id").groupBy("author_id").agg(F.count_distinct("doc_id").alias("papers")).orderBy(F.desc("papers"), "author_id").limit(k)


def collaborations(authored: DataFrame, top: int) -> DataFrame:
    """Pairs among the authors with most papers, by shared papers."""
    best = authored.groupBy("author_id").agg(F.count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "author_id").limit(top)
    m = authored.join(F.broadcast(best), "author_id", "left_semi").select("doc_id", "author_id").distinct()
    pairs = m.withColumnRenamed("author_id", "a").join(m.withColumnRenamed("author_id", "b"), "doc_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("papers"))


# -- papers -----------------------------------------------------------------------------------------------


def lists_of(base: DataFrame, key: str, *parts: tuple[str, DataFrame, list[str]]) -> DataFrame:
    """``base`` with a sorted list of distinct structs (of one column: values) from each (name, table, columns), empty where none."""
    for name, df, columns in parts:
        item = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
        g = df.select(key, item.alias("item")).groupBy(key).agg(F.sort_array(F.collect_set("item")).alias(name))
        empty = F.array().cast(g.schema[name].dataType)
        base = base.join(g.hint("merge"), key, "left").withColumn(name, F.coalesce(name, empty))
    return base


def paper_metadata(papers: DataFrame, authors: DataFrame, species: DataFrame, places: DataFrame) -> DataFrame:
    """Papers with the distinct names of their authors, species and places; each table is (doc_id, name)."""
    return lists_of(papers, "doc_id", ("authors", authors, ["name"]), ("species", species, ["name"]), ("locations", places, ["name"]))


def papers_of_species(papers: DataFrame, mentions: DataFrame, species_id: int) -> DataFrame:
    """Newest first; a null year comes first."""
    return mentions.where(F.col("species_id") == species_id).join(papers, "doc_id").select("doc_id", "title", "year", "confidence").orderBy(F.col("year").desc_nulls_first(), "doc_id")


def species_evidence(chunks: DataFrame, mentions: DataFrame, names: DataFrame, papers: int = 5, per_paper: int = 3) -> DataFrame:
    """Chunks of an entity's papers that contain its name: the first papers, the first chunks of each."""
    docs = first_n(mentions.select("entity", "doc_id").distinct(), ["entity"], [F.asc("doc_id")], papers)
    hits = docs.join(names, "entity").join(chunks, "doc_id").where(F.contains(F.lower("text"), F.lower("name")))
    return first_n(hits, ["entity", "doc_id"], [F.asc("chunk_idx")], per_paper)


def domain_evidence(chunks: DataFrame, domains: DataFrame, papers: int = 5, per_paper: int = 3) -> DataFrame:
    docs = first_n(domains.select("domain", "doc_id").distinct(), ["domain"], [F.asc("doc_id")], papers)
    return first_n(docs.join(chunks, "doc_id"), ["domain", "doc_id"], [F.asc("chunk_idx")], per_paper)


def explorer(mentions: DataFrame, least: int, max_nodes: int) -> DataFrame:
    """Papers with enough species, most first."""
    return mentions.groupBy("doc_id").agg(F.count("*").alias("mentions"), joined(F.collect_set(F.col("species_id").cast("string"))).alias("species")).where(F.col("mentions") >= least).orderBy(F.desc("mentions"), "doc_id").limit(max_nodes)


def top_species_with_titles(mentions: DataFrame, papers: DataFrame, k: int, titles: int = 3) -> DataFrame:
    best = top_by_papers(mentions, k)
    j = mentions.join(F.broadcast(best), "species_id").join(papers.select("doc_id", "title"), "doc_id").select("species_id", "papers", "title").distinct()
    return first_n(j, ["species_id"], [F.asc("title")], titles).groupBy("species_id", "papers").agg(joined(F.collect_list("title"), "|").alias("titles"))


def named_query(kind: str, species_id: int, *, papers: DataFrame, mentions: DataFrame, measurements: DataFrame, relations: DataFrame) -> DataFrame:
    """One of profile, network, measurements, papers, co_occurrence, cut to the size shown."""
    from quarry.operators.analytics import k_hop_edges

    if kind == "profile":
        return mentions.where(F.col("species_id") == species_id).select("doc_id", "confidence").orderBy(F.desc("confidence"), "doc_id").limit(5)
    if kind == "network":
        return k_hop_edges(relations, species_id, 2).orderBy("subject", "object", "type").limit(15)
    if kind == "measurements":
        return measurements.where(F.col("species_id") == species_id).orderBy("parameter", "value", "doc_id").limit(20)
    if kind == "papers":
        return papers_of_species(papers, mentions, species_id).limit(10)
    if kind == "co_occurrence":
        return cooccurring(mentions, species_id, 15)
    raise ValueError(kind)


def degree_subgraph(edges: DataFrame, n: int) -> DataFrame:
    """Edges among the n nodes of largest degree; edges are (a, b, ...)."""
    deg = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d")).orderBy(F.desc("d"), "node").limit(n)
    top = F.broadcast(deg.select("node"))
    return edges.join(top.withColumnRenamed("node", "a"), "a", "left_semi").join(top.withColumnRenamed("node", "b"), "b", "left_semi")


def graph_view(papers: DataFrame, species: DataFrame, mentions: DataFrame, references: DataFrame, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one mixed graph: the papers with most species, their species and places."""
    top = mentions.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(max_nodes).select("doc_id")
    m = mentions.join(F.broadcast(top), "doc_id", "left_semi")
    r = references.join(F.broadcast(top), "doc_id", "left_semi")
    node = lambda df, kind, key: df.select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind")).distinct()
    nodes = node(top, "paper", "doc_id").unionByName(node(m, "species", "species_id")).unionByName(node(r, "place", "location_id"))
    edge = lambda df, kind, key: df.select(F.concat(F.lit("paper:"), F.col("doc_id").cast("string")).alias("a"), F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("b"), F.lit(kind).alias("type")).distinct()
    both = cooccurrence(m).select(F.concat(F.lit("species:"), F.col("a").cast("string")).alias("a"), F.concat(F.lit("species:"), F.col("b").cast("string")).alias("b"), F.lit("together").alias("type"))
    return nodes, edge(m, "species", "species_id").unionByName(edge(r, "place", "location_id")).unionByName(both)
