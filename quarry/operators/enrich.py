"""Enrichment: joins with reference tables that the user loads in bulk (works, names, occurrences, cards)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators.tables import first_n


def normal_title(title: Column | str) -> Column:
    t = F.col(title) if isinstance(title, str) else title
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " "))


def works_by_doi(papers: DataFrame, works: DataFrame) -> DataFrame:
    """Papers with the work of their DOI; both sides' DOIs are cleaned, null ones match nothing."""
    w = works.withColumn("__doi", F.lower(C.clean_doi("doi"))).where("__doi is not null").drop("doi")
    return papers.withColumn("__doi", F.lower(C.clean_doi("doi"))).join(w, "__doi", "left").drop("__doi")


#: Strings up to SHORT characters meet on what is left when characters are removed, longer ones on a part of them.
SHORT = 10


def without(text: Column, edits: int) -> Column:
    """All strings that are left when up to ``edits`` characters are removed."""
    one = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))
    out = F.array(text)
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def meeting_keys(text: Column, edits: int, probe: bool) -> Column:
    """Hashes of which two strings within ``edits`` edits share one at least, if one side's are made with ``probe``.

    Short strings: by removing characters, which turns an edit on either side into a removal.  Longer ones: cut into
    edits + 1 parts, of which one is untouched; the probing side looks for each part of a string of its own length, give
    or take the edits, at the part's place, give or take the edits.
    """
    n = F.length(text)
    shorter = F.when(n <= SHORT, F.transform(without(text, edits), lambda x: F.xxhash64(F.lit("short"), x)))
    around = F.sequence(F.lit(-edits), F.lit(edits)) if probe else F.array(F.lit(0))

    def part(more: Column, i: Column, shift: Column) -> Column:
        size = n + more
        start, end = (F.floor(size * j / (edits + 1)).cast("int") for j in (i, i + 1))
        at = start + shift
        return F.when((at >= 0) & (at + end - start <= n), F.xxhash64(size, i, F.substring(text, at + 1, end - start)))

    parts = F.flatten(F.transform(around, lambda more: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda i: F.transform(around, lambda shift: part(more, i, shift))))))
    longer = F.when(n > SHORT - edits, F.filter(parts, lambda x: x.isNotNull()))
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(F.coalesce(shorter, none), F.coalesce(longer, none)))


def close_strings(left: DataFrame, right: DataFrame, s: str, t: str, edits: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides whose strings ``s`` and ``t`` are at most ``edits`` edits apart, wherever the edits lie, and the distance.

    The sides have no columns in common but ``by``, which must be equal too.  Every pair within reach is found; each comes once.
    """
    a = left.withColumn("__k", F.explode(meeting_keys(F.col(s), edits, True)))
    b = right.withColumn("__k", F.explode(meeting_keys(F.col(t), edits, False)))
    near = a.join(b.hint("merge"), ["__k", *by]).withColumn("distance", F.levenshtein(s, t, edits).cast("bigint")).where(F.col("distance") >= 0)
    return near.drop("__k").distinct()


def works_by_title(papers: DataFrame, works: DataFrame, most: float = 0.2, edits: int = 2) -> DataFrame:
    """(doc_id, work_id, distance): best work of the same year, by edit distance of the titles.

    A pair counts up to ``most`` edits per character of the longer title: titles of the same first word up to that, all
    others, where a slip may lie in the first word itself, up to ``edits``.
    """
    asked = papers.select("doc_id", "year", normal_title("title").alias("t"))
    p = asked.select("year", "t").distinct()
    w = works.groupBy("year", normal_title("title").alias("u")).agg(F.min("work_id").alias("work_id"))  # equal titles: the smallest id wins
    longest = F.greatest(F.length("t"), F.length("u"))
    head = lambda x: F.split(x, " ")[0].alias("head")
    j = p.select("*", head("t")).join(w.select("*", head("u")).hint("merge"), ["year", "head"]).where(F.abs(F.length("t") - F.length("u")) <= F.lit(most) * longest)
    j = j.select("year", "t", "u", "work_id", F.levenshtein("t", "u").cast("bigint").alias("distance"))
    near = close_strings(p, w, "t", "u", edits, ("year",)).select("year", "t", "u", "work_id", "distance")
    j = j.unionByName(near).where(F.col("distance") <= F.lit(most) * longest)
    best = first_n(j, ["year", "t"], [F.asc("distance"), F.asc("work_id")], 1).select("year", "t", "work_id", "distance")
    return asked.join(best.hint("merge"), ["year", "t"]).select("doc_id", "work_id", "distance")


def match_citations(citations: DataFrame, papers: DataFrame, least: float = 0.8) -> DataFrame:
    """(citation_id, doc_id, match_confidence): DOI first (1.0), then equal title and year (0.95), then titles alike.

    Titles are compared within the year: those of the same first word by the share of edits, all others up to two edits.
    """
    c = citations.select("citation_id", F.lower(C.clean_doi("doi")).alias("d"), normal_title("title").alias("t"), "year")
    p = papers.select("doc_id", F.lower(C.clean_doi("doi")).alias("d"), normal_title("title").alias("u"), "year")
    by_doi = c.join(p.select("doc_id", "d"), "d").select("citation_id", "doc_id", F.lit(1.0).alias("match_confidence"))
    p = p.select("doc_id", "u", "year")
    exact = c.join(p, (F.col("t") == F.col("u")) & (c["year"] == p["year"])).select("citation_id", "doc_id", F.lit(0.95).alias("match_confidence"))
    open_ones = c.join(by_doi.unionByName(exact).select("citation_id"), "citation_id", "left_anti")  # the rest alone is compared by edits
    head = lambda x: F.split(x, " ")[0]
    j = open_ones.withColumn("h", head("t")).join(p.withColumn("h", head("u")), ["year", "h"]).where("t <> u")
    slips = close_strings(open_ones.drop("d"), p, "t", "u", 2, ("year",)).where("distance > 0")
    j = j.select("citation_id", "doc_id", "t", "u").unionByName(slips.select("citation_id", "doc_id", "t", "u"))
    ratio = 1 - F.levenshtein("t", "u") / F.greatest(F.length("t"), F.length("u"), F.lit(1))
    fuzzy = j.select("citation_id", "doc_id", F.round(ratio * 0.9, 6).alias("match_confidence")).where(F.col("match_confidence") >= least * 0.9)
    return first_n(by_doi.unionByName(exact).unionByName(fuzzy), ["citation_id"], [F.desc("match_confidence"), F.asc("doc_id")], 1)


def merge_works(papers: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Papers with two sources (doi, title, journal, citations, abstract, authors[]): the first wins the
    publication fields, the second gives the abstract, citations are the greater, sources are listed."""
    a = first.select("doc_id", *[F.col(x).alias("a_" + x) for x in ("title", "journal", "citations", "authors")])
    b = second.select("doc_id", *[F.col(x).alias("b_" + x) for x in ("title", "abstract", "citations", "authors")])
    j = papers.select("doc_id", "title").join(a, "doc_id", "left").join(b, "doc_id", "left")
    have = lambda s: F.coalesce(F.size(s), F.lit(0)) > 0
    sources = F.filter(F.array(F.when(F.col("a_title").isNotNull(), "first"), F.when(F.col("b_title").isNotNull(), "second")), lambda x: x.isNotNull())
    return j.select(
        "doc_id",
        F.coalesce("title", "a_title", "b_title").alias("title"),
        F.col("a_journal").alias("journal"),
        F.col("b_abstract").alias("abstract"),
        F.greatest("a_citations", "b_citations").alias("citations"),
        F.when(have(F.col("a_authors")), F.col("a_authors")).otherwise(F.col("b_authors")).alias("authors"),
        sources.alias("sources"),
    )


def resolve_names(names: DataFrame, backbone: DataFrame, second: DataFrame | None = None, edits: int = 2) -> DataFrame:
    """(name, accepted_id, tier) of names against backbones (taxon_id, scientific_name, accepted_id).

    Tiers: exact, fuzzy (at most ``edits`` edits, in the genus as well), exact in the second backbone, vernacular is the
    caller's own table.  Synonyms are followed to their accepted taxon; unresolved names have null.
    """
    n = names.select("name").distinct().withColumn("clean", F.lower(F.coalesce(C.clean_species_name("name"), F.trim("name"))))
    b = backbone.select("taxon_id", F.lower("scientific_name").alias("sci"), F.coalesce("accepted_id", "taxon_id").alias("accepted_id"))
    exact = n.join(b, F.col("clean") == F.col("sci")).select("name", "accepted_id", F.lit(1).alias("tier"), F.lit(0).alias("d"))
    fuzzy = close_strings(n, b, "clean", "sci", edits).where("distance > 0").select("name", "accepted_id", F.lit(2).alias("tier"), F.col("distance").cast("int").alias("d"))
    hits = exact.unionByName(fuzzy)
    if second is not None:
        s = second.select(F.lower("scientific_name").alias("sci"), F.coalesce("accepted_id", "taxon_id").alias("accepted_id"))
        hits = hits.unionByName(n.join(s, F.col("clean") == F.col("sci")).select("name", "accepted_id", F.lit(3).alias("tier"), F.lit(0).alias("d")))
    best = first_n(hits, ["name"], [F.asc("tier"), F.asc("d"), F.asc("accepted_id")], 1)
    return n.select("name").join(best.select("name", "accepted_id", "tier"), "name", "left")


def resolve_vernacular(names: DataFrame, vernacular: DataFrame) -> DataFrame:
    """(name, taxon_id): scientific match failed, so by common name; smallest id wins."""
    v = vernacular.groupBy(F.lower("vernacular").alias("k")).agg(F.min("taxon_id").alias("taxon_id"))
    return names.withColumn("k", F.lower("name")).join(v, "k", "left").drop("k")


def write_back(species: DataFrame, resolved: DataFrame, taxa: DataFrame) -> DataFrame:
    """Species with the family of the accepted taxon and a flag, where their name was resolved."""
    t = taxa.select(F.col("taxon_id").alias("accepted_id"), F.col("family").alias("__family"))
    j = species.join(resolved, species["common_name"] == resolved["name"], "left").join(t, "accepted_id", "left")
    return j.select("species_id", "common_name", F.coalesce("__family", "family").alias("family"), F.col("accepted_id").isNotNull().alias("validated"))


def distribution(occurrences: DataFrame) -> DataFrame:
    """Per species over all its rows: totals, countries, bounding box, years."""
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return occurrences.groupBy("species_id").agg(
        F.count("*").alias("total"),
        F.count_if(both).alias("georeferenced"),
        F.count_distinct("country").alias("countries"),
        F.min("latitude").alias("south"),
        F.max("latitude").alias("north"),
        F.min("longitude").alias("west"),
        F.max("longitude").alias("east"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def country_facets(occurrences: DataFrame) -> DataFrame:
    """Per species "country:count" by count."""
    n = occurrences.groupBy("species_id", "country").agg(F.count("*").alias("n"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("country"))))
    return n.groupBy("species_id").agg(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["country"], (-r["m"]).cast("string"))), ",").alias("facets"))


def species_cards(species: DataFrame, cards: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """Species with their card and up to k common names."""
    few = first_n(names.distinct(), ["species_id"], [F.asc("name")], k).groupBy("species_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))
    return species.join(cards, "species_id", "left").join(few, "species_id", "left")


def conservation(species: DataFrame, first: DataFrame, fallback: DataFrame) -> DataFrame:
    """Category of the first source, else of the fallback, with its source and name."""
    a = first.select("species_id", F.col("category").alias("a"))
    b = fallback.select("species_id", F.col("category").alias("b"))
    j = species.join(a, "species_id", "left").join(b, "species_id", "left")
    code = F.coalesce("a", "b")
    return j.withColumns({"category": code, "source": F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "fallback"), "category_name": C.category_name(code), "threatened": F.coalesce(C.is_threatened(code), F.lit(False))}).drop("a", "b")


def species_report(species: DataFrame, occurrences: DataFrame, cards: DataFrame, status: DataFrame) -> DataFrame:
    """One row per species: card, distribution, status."""
    return species.join(cards, "species_id", "left").join(distribution(occurrences).select("species_id", "total", "countries"), "species_id", "left").join(status, "species_id", "left")
